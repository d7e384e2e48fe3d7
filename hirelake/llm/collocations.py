"""Phrases of two and three words that occur together more often than their parts let expect.

The counts come from suffix trees over words, cut off at three words and built piecewise. Texts are scanned once for the
counts of single words. Those counts, in the order of (lang, word), are cut into groups of at most `group_rows` suffixes, so
that each group's tree fits into a task; a word that begins more suffixes than that is split into two-word prefixes, dealt
over several groups, and a pair that is still too frequent (a scan of its own counts pairs of such words) into three-word
ones. The last scan deals every suffix, counted and packed into one small tree a group within its task first, to the group of its
prefix. Each group sorts its suffixes, adds up equal ones (the leaves) and reads the counts of the inner nodes from the
totals of the leaves below them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc  # noqa: F401 - makes pa.ipc known
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinal import top_per_group
from ..session import cut_lineage

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Lower case for A-Z, a line feed for every end of a piece, a blank for a tab; bytes of longer characters stay.
_FOLD = bytes(10 if b in _PIECE_ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ROWS_OUT = 100_000

_WORDS = "lang string, w1 string, n long"
_PAIRS = "lang string, w1 string, w2 string, n long"
_PARTS = "part int, tree binary"
_NODES = "lang string, w1 string, w2 string, w3 string, n long"


@dataclass(frozen=True)
class CollocationParams:
    """Least occurrences of a candidate, the share (percent) of its occurrences within one longer candidate from which it
    goes, results a language, suffixes of a group, and words that a task reads before it hands their counts on."""

    least: int = 10
    covered_pct: int = 50
    top: int = 2000
    group_rows: int = 500_000
    task_rows: int = 1_000_000


def pieces_of(text: str) -> Iterator[list[bytes]]:
    """The words of each piece that has any, A-Z in lower case."""
    for piece in text.encode("utf-8", "replace").translate(_FOLD).split(b"\n"):
        words = piece.split()
        if words:
            yield words


class _Read:
    """Numbers of the words read so far, 0 after every piece; equal words of two languages have different numbers."""

    def __init__(self) -> None:
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.langs: list[str | None] = [None]
        self.words: list[bytes | None] = [None]
        self.sequence: list[int] = []

    def add(self, lang: str, words: list[bytes]) -> None:
        known = self.numbers.setdefault(lang, {})
        for word in words:
            number = known.get(word)
            if number is None:
                known[word] = number = len(self.words)
                self.words.append(word)
                self.langs.append(lang)
            self.sequence.append(number)
        self.sequence.append(0)

    def columns(self) -> tuple[pa.Array, pa.Array]:
        """Language and word by number."""
        return pa.array(self.langs, pa.string()), pa.array(self.words, pa.binary()).cast(pa.string())

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First, second (0: the piece ends) and third word of the suffix at every word."""
        first = np.array(self.sequence, np.int64)
        second = np.append(first[1:], 0)
        third = np.append(second[1:], 0)
        third[second == 0] = 0
        at = first > 0
        return first[at], second[at], third[at]


def _scan(count, task_rows: int):
    """Maps batches of (lang, text) to what `count` makes of every `task_rows` words; memory follows that bound and the longest piece."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Read()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for words in pieces_of(text):
                        read.add(lang, words)
                        if len(read.sequence) >= task_rows:
                            yield from count(read)
                            read = _Read()
        if read.sequence:
            yield from count(read)

    return scan


def _batches(names: list[str], columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.table(columns, names=names)
    for at in range(0, whole.num_rows, _ROWS_OUT):
        yield from whole.slice(at, _ROWS_OUT).combine_chunks().to_batches()


def _equal(high: np.ndarray, low: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of one of each kind of equal (high, low), the kind of every row, and how many rows each kind has."""
    _, at, kind, found = np.unique(high * size + low, return_index=True, return_inverse=True, return_counts=True)
    return at, kind, found


def _count_words(read: _Read) -> Iterator[pa.RecordBatch]:
    found = np.bincount(np.array(read.sequence, np.int64), minlength=len(read.words))[1:]
    langs, words = read.columns()
    yield from _batches(["lang", "w1", "n"], [langs[1:], words[1:], pa.array(found, pa.int64())])


def _count_pairs(heavy: frozenset[tuple[str, bytes]]):
    """Counts the pairs of two of the words named."""

    def count(read: _Read) -> Iterator[pa.RecordBatch]:
        wanted = np.array([key in heavy for key in zip(read.langs, read.words)])
        first, second, _ = read.suffixes()
        picked = wanted[first] & wanted[second]
        first, second = first[picked], second[picked]
        at, _, found = _equal(first, second, len(read.words))
        langs, words = read.columns()
        one, two = pa.array(first[at]), pa.array(second[at])
        yield from _batches(["lang", "w1", "w2", "n"], [langs.take(one), words.take(one), words.take(two), pa.array(found, pa.int64())])

    return count


@dataclass(frozen=True)
class _Groups:
    """Which group a suffix belongs to: the first word of each group of words; for words that no group can hold their first
    group and how many they have, told apart by the second word; for pairs that no group can hold the same, by the third."""

    starts: list[tuple[str, bytes]]
    words: dict[tuple[str, bytes], tuple[int, int]]
    pairs: dict[tuple[str, bytes, bytes], tuple[int, int]]


def _deal_suffixes(groups: _Groups):
    """Every suffix of at least two words with how often it stands in what was read, and its group."""

    def count(read: _Read) -> Iterator[pa.RecordBatch]:
        first, second, third = read.suffixes()
        long = second > 0
        first, second, third = first[long], second[long], third[long]
        size = len(read.words)
        pair_at, pair, _ = _equal(first, second, size)
        at, _, found = _equal(pair, third, size)
        of_word, heavy = np.full(size, -1, np.int64), {}
        for number in np.unique(first).tolist():
            key = (read.langs[number], read.words[number])
            if key in groups.words:
                heavy[number] = groups.words[key]
            else:
                of_word[number] = bisect_right(groups.starts, key) - 1
        of_pair, parts = of_word[first[pair_at]], np.ones(len(pair_at), np.int64)
        for p in np.flatnonzero(of_pair < 0).tolist():
            one, two = int(first[pair_at[p]]), int(second[pair_at[p]])
            split = groups.pairs.get((read.langs[one], read.words[one], read.words[two]))
            of_pair[p], parts[p] = split or (heavy[one][0] + _spread(read.words[two]) % heavy[one][1], 1)
        part, of = of_pair[pair[at]], parts[pair[at]]
        for row in np.flatnonzero(of > 1).tolist():
            part[row] += _spread(read.words[third[at[row]]]) % int(of[row])
        langs, words = read.columns()
        order = np.argsort(part, kind="stable")  # within a part the suffixes stay sorted by their words' numbers
        part, at, found = part[order], at[order], found[order]
        starts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
            rows = at[start:stop]
            tree = pack_tree(langs, words, first[rows], second[rows], third[rows], found[start:stop])
            yield pa.RecordBatch.from_arrays([pa.array([int(part[start])], pa.int32()), pa.array([tree], pa.binary())], ["part", "tree"])

    return count


def _spread(word: bytes | None) -> int:
    """A number of the word that is the same in every task."""
    out = 0
    for byte in word or b"":
        out = (out * 1_000_003 + byte + 1) & 0x7FFFFFFF
    return out


def _steps(*levels: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns changes, the first row included."""
    return np.append(0, 1 + np.flatnonzero(np.any([c[1:] != c[:-1] for c in levels], axis=0)))


def pack_tree(langs: pa.Array, words: pa.Array, first: np.ndarray, second: np.ndarray, third: np.ndarray, found: np.ndarray) -> bytes:
    """What one task knows of a group's tree, compressed: each first word once, each second word once a pair, each leaf."""
    ones, twos = _steps(first), _steps(first, second)
    lengths = [np.diff(np.append(np.searchsorted(twos, ones), len(twos))), np.diff(np.append(twos, len(first)))]
    columns = [langs.take(pa.array(first[ones])), words.take(pa.array(first[ones])), pa.array(lengths[0], pa.int32()),
               words.take(pa.array(second[twos])), pa.array(lengths[1], pa.int32()), words.take(pa.array(third)), pa.array(found, pa.int64())]
    one_row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], [f"c{i}" for i in range(7)])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, one_row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(one_row)
    return sink.getvalue().to_pybytes()


def unpack_tree(packed: bytes) -> pa.Table:
    """The suffixes of a packed tree: `lang`, `w1`, `w2`, `w3`, `n`."""
    row = pa.ipc.open_stream(packed).read_next_batch()
    lang, one, pairs, two, leaves, three, found = (row.column(i).flatten() for i in range(7))
    pair_of = np.repeat(np.arange(len(leaves)), leaves.to_numpy())
    first_of = pa.array(np.repeat(np.arange(len(pairs)), pairs.to_numpy())[pair_of])
    return pa.table([lang.take(first_of), one.take(first_of), two.take(pa.array(pair_of)), three, found], names=["lang", "w1", "w2", "w3", "n"])


def build_subtree(suffixes: pa.Table, least: int, whole_pairs: bool) -> pa.Table:
    """The nodes of two words (the third null) and three that occur at least `least` times among a group's suffixes.

    A node's count is the total of the leaves below it, which lie side by side once the suffixes are sorted. Where a pair is
    spread over groups (`whole_pairs` false) only its three-word nodes are read.
    """
    coded = []
    for name in ("lang", "w1", "w2", "w3"):
        codes = pc.dictionary_encode(suffixes[name].combine_chunks()).indices
        coded.append(pc.fill_null(codes, -1).to_numpy(zero_copy_only=False).astype(np.int64))
    order = np.lexsort(coded[::-1])
    coded, found = [c[order] for c in coded], suffixes["n"].to_numpy()[order]
    changes = [_steps(*coded), _steps(*coded[:3])]
    leaves = np.add.reduceat(found, changes[0])
    keep = (coded[3][changes[0]] >= 0) & (leaves >= least)
    rows, totals = [changes[0][keep]], [leaves[keep]]
    if whole_pairs:
        below = np.add.reduceat(leaves, np.searchsorted(changes[0], changes[1]))
        rows.append(changes[1][below >= least])
        totals.append(below[below >= least])
    picked = suffixes.take(pa.array(order[np.concatenate(rows)]))
    third = pa.array(np.arange(picked.num_rows) < len(rows[0]))
    third = pc.if_else(third, picked["w3"], pa.scalar(None, pa.string()))
    return pa.table([picked["lang"], picked["w1"], picked["w2"], third, pa.array(np.concatenate(totals), pa.int64())], names=["lang", "w1", "w2", "w3", "n"])


def _cut(words: DataFrame, room: int) -> tuple[list[tuple], list[tuple[tuple, int]]]:
    """The first word of each group of consecutive words (at most 2 x `room` suffixes each), and the words that begin more
    than `room` by themselves with their counts. Either has at most one entry for `room` suffixes of the table."""
    weight = F.when(F.col("n") <= room, F.col("n")).otherwise(0)
    spread = cut_lineage(words.select("lang", "w1", "n").repartitionByRange("lang", "w1").withColumn("_pid", F.spark_partition_id()))
    sizes = spread.groupBy("_pid").agg(F.sum(weight).alias("_n"))
    earlier = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_earlier"))
    running = F.sum(weight).over(Window.partitionBy("_pid").orderBy("lang", "w1").rowsBetween(Window.unboundedPreceding, 0))
    placed = spread.join(earlier, "_pid").withColumn("_g", F.floor((F.col("_earlier") + running - weight) / F.lit(room)))
    starts = placed.where(F.col("n") <= room).groupBy("_g").agg(F.min(F.struct("lang", "w1")).alias("k")).collect()
    heavy = words.where(F.col("n") > room).select("lang", "w1", "n").collect()
    return sorted((r["k"][0], r["k"][1].encode()) for r in starts), sorted(((r["lang"], r["w1"].encode()), r["n"]) for r in heavy)


def phrase_counts(docs: DataFrame, params: CollocationParams = CollocationParams()) -> tuple[DataFrame, DataFrame]:
    """Counts of all words (`lang`, `w1`, `n`) and of phrases (`lang`, `w1`, `w2`, `w3`, `n`; `w3` null for two words) that
    occur at least `least` times within pieces. Both are written tables."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text")).where(F.col("text").isNotNull())
    words = cut_lineage(texts.mapInArrow(_scan(_count_words, params.task_rows), _WORDS).groupBy("lang", "w1").agg(F.sum("n").alias("n")))
    room = max(1, params.group_rows // 2)
    starts, heavy = _cut(words, room)
    at, of_word, of_pair, split_pairs = len(starts), {}, {}, None
    for key, n in heavy:
        of_word[key] = (at, -(-n // room))
        at += of_word[key][1]
    first_split, least = at, params.least
    if heavy:  # a pair is too frequent for a group only if both its words are
        pairs = texts.mapInArrow(_scan(_count_pairs(frozenset(of_word)), params.task_rows), _PAIRS)
        pairs = cut_lineage(pairs.groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") > room))
        for r in pairs.orderBy("lang", "w1", "w2").collect():
            of_pair[(r["lang"], r["w1"].encode(), r["w2"].encode())] = (at, -(-r["n"] // room))
            at += -(-r["n"] // room)
        split_pairs = pairs.where(F.col("n") >= least).select("lang", "w1", "w2", F.lit(None).cast("string").alias("w3"), "n")

    def subtree(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        suffixes = pa.concat_tables([unpack_tree(tree) for tree in group["tree"].to_pylist()])
        return build_subtree(suffixes, least, key[0].as_py() < first_split)

    dealt = texts.mapInArrow(_scan(_deal_suffixes(_Groups(starts, of_word, of_pair)), params.task_rows), _PARTS)
    nodes = dealt.groupBy("part").applyInArrow(subtree, _NODES)
    return words, cut_lineage(nodes if split_pairs is None else nodes.unionAll(split_pairs))


def mine_collocations(docs: DataFrame, params: CollocationParams = CollocationParams()) -> DataFrame:
    """Each language's first `top` phrases of two or three words by score: `lang`, `rank` from 1, `phrase`, `a`, `l`, `r`, `n`, `score`.

    Texts are folded for A-Z only and end pieces at `.,;:!?`, line feed, vertical tab, form feed and carriage return; words
    are parted by blanks and tabs, and a phrase lies within one piece. `a` counts the phrase, `l` and `r` the two parts of the
    cut that gives the lowest score floor(1,000,000 a a / (l r)) (the earlier cut on ties), `n` all words of the language. A
    pair goes if a candidate of three words that holds it occurs at least `covered_pct` percent as often. Order: score and
    `a` descending, then the phrase by its UTF-8 bytes. Arithmetic is in decimals of 38 digits, exact while a < 10^16.

    A null language is `und`; null and empty texts count nothing; repeated rows count each time; an empty table gives no
    rows. Only `lang` and `text` are read, so further columns of any name do no harm. Texts of any length are read whole.
    """
    words, phrases = phrase_counts(docs, params)
    known = words.where(F.col("n") >= params.least)
    pairs, triples = phrases.where(F.col("w3").isNull()).drop("w3"), phrases.where(F.col("w3").isNotNull())

    def counted(of: DataFrame, count: str, *names: str) -> DataFrame:
        return of.select("lang", *[F.col(f"w{i + 1}").alias(name) for i, name in enumerate(names)], F.col("n").alias(count))

    longer = triples.select("lang", "w1", "w2", "n").unionAll(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "n"))
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("n").alias("in_longer"))
    whole = lambda name: F.col(name).cast("decimal(38,0)")
    covered = F.coalesce(100 * whole("in_longer") >= params.covered_pct * whole("n"), F.lit(False))
    two = pairs.join(longer, ["lang", "w1", "w2"], "left").where(~covered)
    two = two.join(counted(known, "l1", "w1"), ["lang", "w1"]).join(counted(known, "r1", "w2"), ["lang", "w2"])
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), F.array(F.struct(F.col("l1").alias("l"), F.col("r1").alias("r"))).alias("cuts"))
    three = triples.join(counted(known, "l1", "w1"), ["lang", "w1"]).join(counted(known, "r2", "w3"), ["lang", "w3"])
    three = three.join(counted(pairs, "l2", "w1", "w2"), ["lang", "w1", "w2"]).join(counted(pairs, "r1", "w2", "w3"), ["lang", "w2", "w3"])
    cuts = F.array(F.struct(F.col("l1").alias("l"), F.col("r1").alias("r")), F.struct(F.col("l2").alias("l"), F.col("r2").alias("r")))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), cuts.alias("cuts"))

    cut = two.unionAll(three).select("lang", "phrase", "a", F.posexplode("cuts").alias("k", "c")).select("lang", "phrase", "a", "k", "c.*")
    score = F.expr("(1000000 * CAST(a AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0))) div (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    ranked = top_per_group(best, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], params.top, "rank")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
