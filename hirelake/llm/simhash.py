"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius meet in at least
one variant, and all fingerprints that meet in one variant lie within the radius of each other (each is half of it away from
the variant), so the smallest of them stands for the meeting: star pairs lose no link and nothing is paired with everything.
A meeting holds at most as many fingerprints as there are variants of one (65 at radius 2), so no group grows with the data;
equal texts share one fingerprint and are counted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SHINGLE_WORDS = 3
SEED = 42
BITS = 64
_SUM_ROWS = 1 << 16


def fingerprint_of(text: str | None, words_a_shingle: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit fingerprint of a whole text: a bit is 1 if set in over half of the shingles' hashes.

    A-Z become lower case; words are runs of bytes other than white space (0x20, 0x09-0x0D); shingles repeat as the
    text repeats them; a text of fewer words is one shingle; a text without words (null too) has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    width = min(words_a_shingle, len(words))
    starts = (ends - sizes + 1)[: len(words) - width + 1].tolist()
    stops = ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _SUM_ROWS):
        part = hashes[at:at + _SUM_ROWS].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column as a long."""

    @F.pandas_udf("long")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([fingerprint_of(t) for t in part], dtype="int64")

    return of_texts(text)


def ball_masks(radius: int) -> list[int]:
    """All differences of at most half the radius, as signed longs."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even, so that both halves of a pair meet in one variant")
    masks = [0]
    for n in range(1, radius // 2 + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def fingerprint_links(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """Links `(a, b)`, a < b, that join all fingerprints (`fp`, distinct) within `radius` bits of each other."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(radius)])
    variants = fingerprints.select("fp", F.explode(masks).alias("_m")).select("fp", F.col("fp").bitwiseXOR(F.col("_m")).alias("_v"))
    met = variants.withColumn("a", F.min("fp").over(Window.partitionBy("_v")))
    pairs = met.where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(links: DataFrame) -> DataFrame:
    """`(v, root)` for every end of a link: `root` is the smallest value that its links reach.

    Alternating star steps: each value hands its larger neighbours, then itself and its smaller ones, to the smallest
    value it knows, until the links no longer change. Smallest neighbours are aggregates and are written before the
    join, so Spark can split a value that holds most links; every step's links are written to the shared folder.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).where("u <> w").distinct())
    state = _digest(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = cut_lineage(both.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
        large = both.where("w > u").join(least, F.col("u") == F.col("k")).select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()
        large = cut_lineage(large)
        least = cut_lineage(large.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("k"), "m"))
        small = large.join(least, F.col("u") == F.col("k")).select(F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w")
        edges = cut_lineage(small.unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("w"))).distinct())
        before, state = state, _digest(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("v"), F.col("w").alias("root")).unionAll(edges.select(F.col("w").alias("v"), F.col("w").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first())


def link_classes(prints: DataFrame, radius: int = 2) -> DataFrame:
    """`fp`, `root`: one row for each distinct fingerprint of `prints`, equal roots for fingerprints that links join."""
    distinct = cut_lineage(prints.select("fp").distinct())
    roots = cut_lineage(components(fingerprint_links(distinct, radius)))
    return distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicate_components(docs: DataFrame, radius: int = 2) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hex digits), `component_id` (smallest `doc_id` reachable), one row per row of `docs`.

    Null and empty texts have fingerprint zero and link like any other. Null ids do not name a component unless all of
    its ids are null; a repeated row is one more member; further columns are not read; an empty table gives none.
    """
    prints = cut_lineage(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("_first"))
    known = cut_lineage(link_classes(prints, radius).join(first, "fp"))
    smallest = cut_lineage(known.groupBy("root").agg(F.min("_first").alias("component_id")))
    ids = cut_lineage(known.select("fp", "root").join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id"))
    joined = prints.join(ids, F.col("fp") == F.col("_fp"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The rows of `docs`, one of each component: the smallest `doc_id` (null last; among equal ids the smallest hash of
    id and text). All columns stay as they are."""
    held = docs.withColumns({"_fp4": fingerprint(F.col("text")), "_row4": F.monotonically_increasing_id()})
    held = cut_lineage(held)
    slim = held.select(F.col("_fp4").alias("fp"), F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.xxhash64("doc_id", "text").alias("h"), F.col("_row4").alias("r")).alias("_o"))
    best = slim.groupBy("fp").agg(F.min("_o").alias("_o"))
    kept = link_classes(slim, radius).join(best, "fp").groupBy("root").agg(F.min("_o").alias("_o")).select(F.col("_o.r").alias("_kept"))
    return held.join(cut_lineage(kept), F.col("_row4") == F.col("_kept"), "left_semi").select(*[held[c] for c in docs.columns])
