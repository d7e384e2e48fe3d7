"""Near-duplicate lines by a deletion-neighbourhood join on words.

Two lines within one word edit share a variant: equal lines share themselves, a line and one with a word more share the shorter
one, and lines that differ in one word share what is left without it. Every line emits hashed keys of its variants, equal keys
meet, the earliest line of a meeting stands for it (so nothing is paired with everything), each such pair's edit distance is
verified on the words, and a line that has an earlier partner goes.

Variants are only emitted where a line can have a partner. One edit lies within one of a few stretches of the line, and leaves
the words before and behind that stretch as they are; so a word's variant is needed only if another line is equal around the
stretch that holds it. Texts are read once: that scan writes each line's key, the keys of its surroundings and, once a line as
far as a task remembers, its words. Surroundings that several lines share are found by grouping and joined back, so what is
emitted follows from the lines that share one, at any size of the input. A bit map of fixed size passes over most other lines
before that join; its false alarms cost time only, and fall to the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices

_LAST = (1 << 63) - 1
#: Lines a task remembers having told of; past that it begins anew, which repeats rows and changes nothing else.
_KNOWN_LINES = 200_000
_hash64 = xxhash.xxh3_64_intdigest
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LineParams:
    """Lines of fewer than `near_words` words must be equal, longer ones may differ by one word inserted, left out or
    replaced. A line is cut into `stretches`; `map_bits` is the size of the bit map of shared surroundings."""

    near_words: int = 8
    stretches: int = 4
    map_bits: int = 1 << 26


def line_words(line: str) -> list[str]:
    """The words of a line in lower case, parted by white space."""
    return line.lower().split()


def line_id(joined: str) -> bytes:
    return xxhash.xxh3_128_digest(joined)


def surroundings(words: list[str], joined: str, p: LineParams) -> list[tuple[int, int, int]]:
    """(key, start, stop): for each stretch of the line (`joined`: its words, one blank apart) a signed hash of what is around it.

    Stretches are counted from both ends in steps that lines of n and n + 1 words share: the step goes by n without its rest,
    and a line whose rest is nothing is cut by the step below too.
    """
    n, parts = len(words), p.stretches
    if n < p.near_words:
        return []
    out = []
    letters = [0, *accumulate(map(len, words))]  # word i begins at letters[i] + i
    full = n // parts
    for step in (full,) if n % parts else (full, full - 1):
        rest = n - parts * step
        for j in range(parts):
            start, stop = j * step, (j + 1) * step + rest
            key = _hash64(f"{joined[:letters[start] + start]}\x1f{joined[letters[stop] + stop:]}", step * parts + j)
            out.append((key - (1 << 64) if key >> 63 else key, start, stop))
    return out


def variant_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the line without each of its words, the same with the place mixed in, and the whole line's hash.

    A line hashes to the sum of its words' hashes times powers of an odd number, so all variants come from running sums.
    """
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    n = len(words)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(n + 1, _MULTIPLIER, np.uint64))
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n])])
        after = np.concatenate([np.cumsum((hashes[1:] * powers[:n - 1])[::-1])[::-1], np.zeros(1, np.uint64)])
        # The number of words takes part, at the place behind the last one.
        without = _mixed(before[:n] + after + np.uint64(n - 1) * powers[n - 1])
        whole = _mixed(before[n:] + np.uint64(n) * powers[n])
        placed = _mixed(without ^ (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return without.view(np.int64), placed.view(np.int64), int(whole.view(np.int64)[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether one word inserted, left out or replaced, or none, makes the lines equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    return a[same + (len(a) >= len(b)):] == b[same + (len(b) >= len(a)):]


def _texts(docs: DataFrame) -> DataFrame:
    """Rows to be scanned. Equal rows share `row`; they lose the same lines."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").alias("t"))


def _lines(batch: pd.DataFrame) -> Iterator[tuple[int, int, int, list[str], str]]:
    for d, row, text in zip(batch["d"].tolist(), batch["row"].tolist(), batch["t"]):
        if text:
            # A line feed ends a word, so the whole text turns to lower case as its lines do.
            for at, line in enumerate(text.lower().split("\n")):
                words = line.split()
                if words:
                    yield d, row, at, words, " ".join(words)


def _scan(p: LineParams):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for b in slices(batches):
            ds, rows, ats, lines, around, told = [], [], [], [], [], []
            if len(seen) > _KNOWN_LINES:
                seen.clear()
            for d, row, at, words, joined in _lines(b):
                line = line_id(joined)
                ds.append(d)
                rows.append(row)
                ats.append(at)
                lines.append(line)
                # A task tells the words of equal lines and what is around their stretches once, as far as it remembers them.
                new = len(words) >= p.near_words and line not in seen
                around.append([s[0] for s in surroundings(words, joined, p)] if new else None)
                told.append(joined if new else None)
                if new:
                    seen.add(line)
            names = np.frombuffer(b"".join(lines), ">i8")[::2].astype(np.int64)  # the first half of the hash
            yield pd.DataFrame({"d": np.array(ds, np.int64), "row": np.array(rows, np.int64), "at": np.array(ats, np.int32), "line": lines, "id": names,
                                "around": around, "words": told})

    return scan


def _marked(bits: np.ndarray, p: LineParams):
    """Of lines with their surroundings those that have one whose bit is set."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            around = b.column("around")
            keys = around.flatten().to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(p.map_bits - 1)
            hit = bits[keys >> np.uint64(6)] >> (keys & np.uint64(63)) & np.uint64(1)
            line = np.repeat(np.arange(len(b)), around.value_lengths().to_numpy(zero_copy_only=False))
            yield b.filter(pa.array(np.bincount(line[hit == 1], minlength=len(b)) > 0))

    return marked


def _emit(p: LineParams):
    """Variant rows of lines (`id`, `words`), within the numbered stretches (`open`) whose surroundings another line shares."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        for b in slices(batches):
            if len(done) > _KNOWN_LINES:
                done.clear()
            keys, roles, ids, texts = [], [], [], []
            for name, joined, numbers in zip(b["id"].tolist(), b["words"], b["open"]):
                if name in done:
                    continue
                done.add(name)
                words = joined.split(" ")
                cut = surroundings(words, joined, p)
                places = np.unique(np.concatenate([np.arange(0), *(np.arange(*cut[j][1:]) for j in numbers if j < len(cut))]))
                without, placed, whole = variant_keys(words)
                keys += [placed[places], without[places], np.array([whole])]
                n = len(places)
                roles.append(np.repeat(np.array([0, 1, 2], np.int8), [n, n, 1]))
                ids.append(np.full(2 * n + 1, name))
                texts += [None] * (2 * n) + [joined]
            if keys:
                yield pd.DataFrame({"k": np.concatenate(keys), "role": np.concatenate(roles), "id": np.concatenate(ids), "words": texts})

    return emit


def bit_map(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bit for each value of a long column modulo `bits`, as 64-bit words: of fixed size, however many keys there are."""
    low = F.col(key).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, CAST({key} & 63 AS INT))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(max(1, bits >> 6), np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return out.view(np.uint64)


def scanned_lines(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """Every line that holds a word, written as a table: its text (`d`, `row`), place, hash and the first half of it; where a
    task meets a line first also `around` (keys of its surroundings) and `words`."""
    return cut_lineage(_texts(docs).mapInPandas(_scan(p), "d long, row long, at int, line binary, id long, around array<long>, words string"), "zstd")


def shared_variants(lines: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """`k`, `role`, `id`, `words`: variants of the scanned lines that another line is equal to around a stretch."""
    told = lines.where("words is not null").select("id", "around", "words")
    # A surrounding is shared if its least and its greatest line differ.
    owners = told.select("id", F.explode("around").alias("_h")).groupBy("_h").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    shared = cut_lineage(owners.where("a <> b").select("_h"))
    told = cut_lineage(told.mapInArrow(_marked(bit_map(shared, "_h", p.map_bits), p), told.schema), "zstd")
    around = told.select("id", F.posexplode("around").alias("j", "h"))  # at most twice `stretches` a line
    open_ = around.join(shared, F.col("h") == F.col("_h"), "left_semi").groupBy(F.col("id").alias("_id")).agg(F.collect_set("j").alias("open"))
    told = told.select("id", "words").join(cut_lineage(open_), F.col("id") == F.col("_id"))
    return cut_lineage(told.select("id", "words", "open").mapInPandas(_emit(p), "k long, role byte, id long, words string"))


def dropped_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """`d`, `row`, `drop`: per text the numbers of the lines that have an equal or near line at an earlier place."""
    p = params
    lines = scanned_lines(docs, p)
    place = F.struct("d", "at")
    firsts = cut_lineage(lines.groupBy("line", "id").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    emitted = shared_variants(lines, p)
    meeting = emitted.groupBy("k").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select(F.col("k").alias("_k"))
    met = emitted.select("k", "role", "id").join(cut_lineage(meeting), F.col("k") == F.col("_k"), "left_semi").distinct()
    places = firsts.select(F.col("id").alias("_id"), "first")
    met = cut_lineage(met.join(places, F.col("id") == F.col("_id")).select("k", "role", "id", "first"))
    # The earliest line of each role: those left with the same words, those with a word more, and the whole line.
    least = lambda role: F.min(F.when(F.col("role") == role, F.struct("first", "id")))
    stands = cut_lineage(met.groupBy("k").agg(least(0).alias("same"), least(1).alias("longer"), least(2).alias("whole")).withColumnRenamed("k", "_k"))
    partner = F.when(F.col("role") == 0, F.col("same")).when(F.col("role") == 1, F.col("whole")).otherwise(F.col("longer"))
    pairs = met.join(stands, F.col("k") == F.col("_k")).select("id", partner.alias("o")).where("o is not null and o.id <> id")
    pairs = cut_lineage(pairs.select("id", F.col("o.id").alias("other"), F.col("o.first").alias("p")).distinct())
    linked = pairs.select(F.col("id").alias("_id")).union(pairs.select("other")).distinct()
    words = emitted.where("words is not null").join(linked, F.col("id") == F.col("_id"), "left_semi").groupBy("id").agg(F.min("words").alias("words"))
    words = cut_lineage(words)
    mine = words.select(F.col("id").alias("l1"), F.col("words").alias("w1"))
    its = words.select(F.col("id").alias("l2"), F.col("words").alias("w2"))

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one_edit(x.split(" "), y.split(" ")) for x, y in zip(a, b)], dtype=bool)

    verified = pairs.join(mine, F.col("id") == F.col("l1")).join(its, F.col("other") == F.col("l2")).where(near("w1", "w2"))
    earlier = cut_lineage(verified.groupBy("id").agg(F.min("p").alias("p")).select(F.col("id").alias("_id"), "p"))
    early = firsts.join(earlier, F.col("id") == F.col("_id"), "left").withColumn("from", F.least("first", F.coalesce("p", "first")))
    early = cut_lineage(early.where("n > 1 or from < first").select(F.col("line").alias("_line"), "from"))
    gone = lines.select("d", "row", "at", "line").join(early, F.col("line") == F.col("_line")).where(place > F.col("from"))
    return gone.groupBy("d", "row").agg(F.collect_set("at").alias("drop"))


def dedup_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """`docs` with the text of each row reduced to lines that have no equal or near line at an earlier place.

    Places go by `doc_id` (null last), then by line number; rows that repeat an id share its places, so none of their lines
    at one place is earlier than the other. Lines compare by their words in lower case (as 128-bit hashes; 64 bits of them name the lines of near pairs). Lines without a word are never
    compared and stay. Null texts stay null, an empty text stays empty; a text whose lines all go becomes empty. All other
    columns stay as they are, whatever their names; an empty table stays empty.
    """
    gone = cut_lineage(dropped_lines(docs, params)).select(F.col("d").alias("_d6"), F.col("row").alias("_row6"), F.col("drop").alias("_drop6"))

    @F.pandas_udf("string")
    def rest(texts: pd.Series, drops: pd.Series) -> pd.Series:
        out = []
        for text, drop in zip(texts, drops):
            if text is not None and drop is not None:
                drop = set(drop)
                text = "\n".join(line for at, line in enumerate(text.split("\n")) if at not in drop)
            out.append(text)
        return pd.Series(out, dtype=object)

    left = docs.withColumns({"_of6": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "_key6": F.xxhash64("doc_id", "text")})
    joined = left.join(gone, (F.col("_of6") == F.col("_d6")) & (F.col("_key6") == F.col("_row6")), "left")
    return joined.withColumn("text", rest("text", "_drop6")).select(*docs.columns)
