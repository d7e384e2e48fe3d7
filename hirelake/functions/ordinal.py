"""Order-dependent numbers computed without putting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def group_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """`row_number()` within `keys`, exact, for groups of any size.

    Rows are range-partitioned by key and order, so a large group spreads over consecutive
    partitions; each partition numbers its own rows, and the rows of earlier partitions are added
    from a table of one row per group and partition. The range step samples, so its outcome is
    written out before the two reads of it.
    """
    keys = list(keys)
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_pid", F.spark_partition_id())
    spread = cut_lineage(spread)
    local = spread.withColumn("_local", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order)))
    sizes = spread.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    matched = [local[k].eqNullSafe(offsets[k]) for k in ("_pid", *keys)]
    joined = local.join(offsets.select("_pid", *keys, "_before"), _all(matched))
    return joined.select(*[local[c] for c in df.columns], (F.col("_local") + F.col("_before")).alias(name))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    """The first `n` rows of each group with their place. Each part of a group is limited to `n`
    rows first, so a group that holds most rows never sorts in one task."""
    keys = list(keys)
    final = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    part = Window.partitionBy("_part", *keys).orderBy(*order)
    df = df.withColumn("_part", F.spark_partition_id()).withColumn("_in_part", F.row_number().over(part)).filter(F.col("_in_part") <= n).drop("_part", "_in_part")
    return df.withColumn(name, final).filter(F.col(name) <= n)


def _all(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out & c
    return out


def exact_percentiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = (), splits: int = 64,
                      nearest: bool = False, most: int = 200_000) -> DataFrame:
    """Exact percentiles per group, one row a group and share: inclusive and linear between
    neighbours, or with `nearest` the value at zero-based place `share * n`.

    Values are first counted, so equal ones cost one row. While a part holds over `most` distinct
    values, every part is cut at `splits` approximate quantiles and only the one or two pieces that
    hold each rank go on, so no task orders more than `most` values, however many a group has.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col(value).cast("double").alias("_v"))
    counted = cut_lineage(rows.groupBy(*named, "_v").agg(F.count("*").alias("_n")))
    totals = counted.groupBy(*named).agg(F.sum("_n").alias("_total"), F.count("*").alias("_size"))
    largest = totals.agg(F.max("_size")).first()[0] or 0
    # Rank positions are zero-based: share * (n - 1) lies between its floor and its ceiling.
    at = lambda s: F.least(F.floor(s * F.col("_total")), F.col("_total") - 1).cast("double") if nearest else s * (F.col("_total") - 1)
    rank = lambda s: F.struct(s.alias("share"), F.floor(at(s)).alias("lo"), F.ceil(at(s)).alias("hi"), (at(s) - F.floor(at(s))).alias("part"))
    ranks = totals.filter("_total > 0").select(*named, F.array(*[rank(F.lit(float(s))) for s in shares]).alias("_ranks"))
    within = lambda place, start, end: (place >= F.col(start)) & (place < F.col(end))
    touches = lambda start, end: lambda r: within(r["lo"], start, end) | within(r["hi"], start, end)

    # A part is known by its group and the number of values before it.
    held, part = counted.withColumn("_start", F.lit(0).cast("long")), [*named, "_start"]
    while largest > max(most, 1):
        cuts = F.percentile_approx("_v", [i / splits for i in range(1, splits)], 1000).alias("_cuts")
        pieces = _null_safe_join(held, held.groupBy(*part).agg(cuts), part)
        pieces = pieces.select(*part, "_v", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_piece"))
        sizes = pieces.groupBy(*part, "_piece").agg(F.sum("_n").alias("_n"), F.count("*").alias("_size"))
        sizes = sizes.withColumn("_to", F.col("_start") + F.sum("_n").over(Window.partitionBy(*part).orderBy("_piece")))
        sizes = sizes.withColumn("_from", F.col("_to") - F.col("_n")).drop("_n")
        sizes = _null_safe_join(sizes, ranks, named).filter(F.exists("_ranks", touches("_from", "_to"))).drop("_ranks", "_to")
        kept = _null_safe_join(pieces, sizes, [*part, "_piece"]).select(*named, "_v", "_n", F.col("_from").alias("_start"), "_size")
        held = cut_lineage(kept)
        smaller = held.agg(F.max("_size")).first()[0]
        held = held.drop("_size")
        if smaller >= largest:  # too few values for a cut to part them
            break
        largest = smaller

    ordered = Window.partitionBy(*part).orderBy("_v")
    held = held.withColumn("_to", F.col("_start") + F.sum("_n").over(ordered)).withColumn("_from", F.col("_to") - F.col("_n"))
    hits = _null_safe_join(held, ranks, named).withColumn("_r", F.explode(F.filter("_ranks", touches("_from", "_to"))))
    found = hits.groupBy(*named, F.col("_r.share").alias("share")).agg(
        F.max(F.when(within(F.col("_r.lo"), "_from", "_to"), F.col("_v"))).alias("_vl"), F.max(F.when(within(F.col("_r.hi"), "_from", "_to"), F.col("_v"))).alias("_vh"),
        F.max("_r.part").alias("_part"),
    )
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, named)], "share", (F.col("_vl") + (F.col("_vh") - F.col("_vl")) * F.col("_part")).alias("value"))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, null equal to null, each key kept once."""
    if not keys:
        return left.join(right, F.lit(True))
    renamed = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = _all([F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys])
    return left.join(renamed, on).drop(*[f"_r{k}" for k in keys])
