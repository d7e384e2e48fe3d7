"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of words. A CGK walk reads a sequence from its start, writes down the word it stands on and
moves on or stays by a random bit of the step and the word; two sequences a few edits apart fall back into step, so their
edit distance shows as a Hamming distance. Each repetition walks anew and samples a few steps of the walk as its key; a
window and an item that share a key in some repetition become a candidate, and the exact edit distance decides.

Walks drift apart with each inserted or deleted word, so a long item is walked from several places: it is cut into pieces of
lengths at which the keys reach the target recall. If the whole item is within its share of edits, so is at least one piece,
and windows are walked for the pieces; the whole item is verified.

Windows that can't match are never walked: an item's sequences of words that edits leave whole must occur in a matching
window a stated number of times, so Spark first cuts each text to the regions where enough of the benchmark's word triples
occur. The triples are kept as a bit map of fixed size; its false alarms cost time and never a match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices
from .line_dedup import bit_map

_WORDS = re.compile(r"\w+")
_CACHE_WORDS = 100_000


@dataclass(frozen=True)
class CgkParams:
    """`similarity`: an item of n words may be up to (1 - similarity) n word edits away. `gram` words make a gram.
    Items of more than `piece` words are cut into equal pieces of at most that many, for which `repetitions` walks of
    `samples` sampled steps each reach the target recall of 95 % (see tests). `reach`: steps a walk may be sampled from, as a
    multiple of the shortest piece of its class; classes grow by `growth`."""

    similarity: float = 0.8
    gram: int = 3
    repetitions: int = 24
    samples: int = 3
    piece: int = 35
    reach: float = 1.2
    growth: float = 1.3
    map_bits: int = 1 << 23
    seed: int = 11

    def edits(self, n: int) -> int:
        return int((1 - self.similarity) * n + 1e-9)

    def needed(self, n: int) -> int:
        """Grams of an item of n words that stay whole at least; where that can be none, a window needs no gram."""
        return max(0, n - self.gram + 1 - self.gram * self.edits(n))

    def steps(self, low: int) -> int:
        """Steps of a walk that may be sampled, for the class whose shortest items have `low` words."""
        return max(1, int(self.reach * low))

    def cuts(self, n: int) -> list[int]:
        """Where the pieces of an item of n words begin, and its end."""
        pieces = max(1, -(-n // self.piece))
        return [n * i // pieces for i in range(pieces + 1)]

    def piece_classes(self, n: int) -> set[tuple[int, int]]:
        """The classes of the pieces of an item of n words."""
        at = self.cuts(n)
        return {self.size_class(b - a) for a, b in zip(at, at[1:])}

    def size_class(self, n: int) -> tuple[int, int]:
        """The shortest and longest items of the class of n words."""
        low = 1
        while True:
            high = max(low, int(low * self.growth))
            if n <= high:
                return low, high
            low = high + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hasher():
    """A function from a text to the hashes of its words: runs of letters, digits and underscores in lower case."""
    known: dict[str, int] = {}

    def hashes(text: str | None) -> np.ndarray:
        words = _WORDS.findall(text.lower()) if text else []
        if len(known) > _CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) | 1
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    return hashes


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n words in a row."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - n + 1 + i]
        return _mix(total)


def walk_keys(words: np.ndarray, starts: np.ndarray, low: int, p: CgkParams) -> np.ndarray:
    """For each start the keys of all repetitions, of the walk over the words from there on."""
    steps = p.steps(low)
    padded = np.concatenate([words, np.zeros(steps + 1, np.uint64)])
    keys = np.empty((len(starts), p.repetitions), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(p.repetitions):
            rng = np.random.default_rng((p.seed, low, r))
            salts = rng.integers(1, 1 << 63, steps, dtype=np.uint64)
            sampled = np.sort(rng.choice(steps, min(p.samples, steps), replace=False))
            key = np.full(len(starts), low * 1000 + r, np.uint64)
            at = starts.copy()
            for j in range(int(sampled[-1]) + 1):
                here = padded[at]
                if j in sampled:
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + here)
                at = at + ((_mix(here ^ salts[j]) & np.uint64(1)).astype(np.int64))
            keys[:, r] = key
    return keys.view(np.int64)


def window_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The fewest word edits between the item and any stretch of the text, and that stretch (the first to end so)."""
    n = len(text)
    cost = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)
    for i, w in enumerate(item):
        up, slant = cost + 1, cost[:-1] + (text != w)
        new = np.empty(n + 1, np.int64)
        source = np.empty(n + 1, np.int64)
        new[0], source[0] = i + 1, 0
        take = slant <= up[1:]
        new[1:], source[1:] = np.where(take, slant, up[1:]), np.where(take, origin[:-1], origin[1:])
        # Words of the text left out: the running minimum of cost less place gives them all at once.
        slope = new - np.arange(n + 1)
        lead = np.minimum.accumulate(slope)
        best = np.maximum.accumulate(np.where(slope == lead, np.arange(n + 1), 0))
        cost, origin = lead + np.arange(n + 1), source[best]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def _regions(p: CgkParams, sizes: list[int], classes: list[tuple[int, int]], marks: np.ndarray):
    """Stretches of texts in which some window of some item class holds enough of the benchmark's grams, and for each word
    of them the piece classes (`classes`, those of items of `sizes` words) whose windows hold enough from there on."""
    of_items: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for n in sizes:
        of_items.setdefault(p.size_class(n), set()).update(p.piece_classes(n))
    rule = lambda low, high: (high + p.edits(high), min(p.needed(n) for n in range(low, high + 1)))
    rules = [(*rule(*c), [classes.index(x) for x in pieces]) for c, pieces in sorted(of_items.items())]
    piece_rules = [rule(*c) for c in classes]
    fewest = min((need for _, need, _ in rules), default=0)
    mask = np.uint64(p.map_bits - 1)

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = word_hasher()
        for b in slices(batches):
            out = []
            for doc, text in zip(b["doc_id"], b["t"]):
                words = hashes(text)
                if not len(words):
                    continue
                made = grams(words, p.gram) & mask
                hit = (marks[made >> np.uint64(6)] >> (made & np.uint64(63))) & np.uint64(1)
                if int(hit.sum()) < fewest:
                    continue
                upto = np.concatenate([[0], np.cumsum(hit.astype(np.int64))])
                starts = np.arange(len(words))
                begins = np.minimum(starts, len(made))

                def enough(span: int, need: int) -> np.ndarray:
                    stops = np.maximum(np.minimum(starts + max(0, span - p.gram + 1), len(made)), begins)
                    return upto[stops] - upto[begins] >= need

                inside = np.zeros(len(words) + 2, np.int8)
                near = [np.zeros(len(words), bool) for _ in classes]
                for span, need, pieces in rules:
                    ok = starts[enough(span, need)]
                    if not len(ok):
                        continue
                    change = np.bincount(ok, minlength=len(words) + 1) - np.bincount(np.minimum(ok + span, len(words)), minlength=len(words) + 1)
                    covered = np.cumsum(change[:-1]) > 0
                    inside[1:-1] |= covered
                    for c in pieces:
                        near[c] |= covered
                asked = np.zeros(len(words), np.uint64)
                for c, (span, need) in enumerate(piece_rules):
                    if near[c].any():
                        asked[near[c] & enough(span, need)] |= np.uint64(1 << (c & 63))
                edges = np.flatnonzero(np.diff(inside))
                for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    out.append((doc, start, words[start:stop].tobytes(), asked[start:stop].tobytes()))
            frame = pd.DataFrame(out, columns=["doc_id", "start", "words", "asked"])
            frame["doc_id"] = pd.array(frame["doc_id"], "Int64")
            yield frame

    return regions


def _window_keys(p: CgkParams, classes: list[tuple[int, int]]):
    """The keys of every window that may match, per class; regions of a batch are walked side by side, parted by gaps
    that no walk crosses."""
    gap = max((p.steps(low) for low, _ in classes), default=0) + 1

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at:at + 256]
                pieces = [np.frombuffer(w, np.uint64) for w in part["words"]]
                rest = np.zeros(gap, np.uint64)
                words = np.concatenate([x for w in pieces for x in (w, rest)])
                asked = np.concatenate([x for m in part["asked"] for x in (np.frombuffer(m, np.uint64), rest)])
                region = np.repeat(part["region"].to_numpy(np.int64), [len(w) + gap for w in pieces])
                for c, (low, _) in enumerate(classes):
                    starts = np.flatnonzero(asked >> np.uint64(c & 63) & np.uint64(1))
                    if len(starts):
                        made = walk_keys(words, starts, low, p)
                        yield pd.DataFrame({"region": np.repeat(region[starts], p.repetitions), "key": made.ravel()})

    return keys


def find_contamination(docs: DataFrame, benchmark: DataFrame, params: CgkParams = CgkParams()) -> DataFrame:
    """`doc_id`, `item_id`, `start_word`, `n_words`, `edits`: one row for each document and benchmark item of which the
    document holds a stretch at most (1 - similarity) x the item's words away; of several stretches that with the fewest
    edits, then the first.

    Words are compared in lower case without punctuation. Null and empty texts and items match nothing; items of equal words
    are found together; rows that repeat a `doc_id` answer as one document; null ids are answered as such. An empty table
    on either side gives none; further columns are not read.
    """
    p = params

    def read_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = word_hasher()
        for b in batches:
            words = [hashes(t) for t in b["t"]]
            yield pd.DataFrame({"item_id": pd.array(b["item_id"], "Int64"), "item": [w.tobytes() for w in words], "n": [len(w) for w in words]})

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t")).mapInPandas(read_items, "item_id long, item binary, n int")
    items = cut_lineage(items.where("n > 0"))
    # Lengths are few, and piece classes fewer: at most one for each growth step up to the longest piece.
    sizes = [r["n"] for r in items.select("n").distinct().collect()]
    classes = sorted(set().union(*(p.piece_classes(n) for n in sizes)))
    texts_of_items = cut_lineage(items.select("item").distinct().withColumn("name", F.monotonically_increasing_id()))

    def item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["item"]:
                yield pd.DataFrame({"g": grams(np.frombuffer(raw, np.uint64), p.gram).view(np.int64)})

    def item_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["name"].tolist(), b["item"]):
                words = np.frombuffer(raw, np.uint64)
                cuts = np.array(p.cuts(len(words)))
                lows = np.array([p.size_class(n)[0] for n in np.diff(cuts).tolist()])
                made = [walk_keys(words, cuts[:-1][lows == low], low, p).ravel() for low in np.unique(lows).tolist()]
                yield pd.DataFrame({"name": name, "key": np.unique(np.concatenate(made))})

    marks = bit_map(texts_of_items.mapInPandas(item_grams, "g long"), "g", p.map_bits)
    of_items = cut_lineage(texts_of_items.mapInPandas(item_keys, "name long, key long"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    regions = texts.mapInPandas(_regions(p, sizes, classes, marks), "doc_id long, start long, words binary, asked binary")
    regions = cut_lineage(regions.withColumn("region", F.monotonically_increasing_id()))
    windows = regions.select("region", "words", "asked").mapInPandas(_window_keys(p, classes), "region long, key long")
    met = cut_lineage(windows.join(of_items.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).select("region", "name").distinct())

    @F.pandas_udf("edits int, first int, last int")
    def verified(item: pd.Series, words: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(item, words):
            mine, its = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            allowed = p.edits(len(mine))
            shared = int(np.isin(mine, its).sum())
            out.append(window_distance(mine, its) if len(mine) - shared <= allowed else (len(mine), 0, 0))
        return pd.DataFrame(out, columns=["edits", "first", "last"]).astype("int32")

    held = regions.withColumnRenamed("region", "_region")
    named = texts_of_items.withColumnRenamed("name", "_name")
    near = met.join(named, F.col("name") == F.col("_name")).join(held, F.col("region") == F.col("_region")).select("doc_id", "start", "item", verified("item", "words").alias("v"))
    allowed = F.floor(F.lit(1 - p.similarity) * F.octet_length("item") / 8 + 1e-9)
    near = near.where(F.col("v.edits") <= allowed).select("doc_id", F.col("item").alias("_item"), F.struct(F.col("v.edits").alias("edits"), (F.col("start") + F.col("v.first")).alias("start_word"), (F.col("v.last") - F.col("v.first")).cast("long").alias("n_words")).alias("at"))
    best = near.groupBy("doc_id", "_item").agg(F.min("at").alias("at"))
    return best.join(items, F.col("_item") == F.col("item")).select("doc_id", "item_id", "at.start_word", "at.n_words", "at.edits")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, params: CgkParams = CgkParams()) -> DataFrame:
    """The rows of `docs` whose own text holds no benchmark item; all columns stay as they are.

    Rows are judged by their texts (as 64-bit hashes), so null and repeated ids neither save nor condemn another row.
    """
    key = F.xxhash64("text")
    found = find_contamination(docs.select(key.alias("doc_id"), "text"), benchmark, params)
    found = cut_lineage(found.select(F.col("doc_id").alias("_found7")).distinct())
    return docs.join(found, key == F.col("_found7"), "left_anti")
