"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document starts at one copy. Among all rates between none and two that give each source its target number of words, the
ones closest to that start (in the entropy of a rate and its rest to two) are exponential tilts: rate / (2 - rate) =
exp(tilt x relative size), with one tilt a source. The tilts solve a smooth convex dual problem. Each Newton step is one
aggregate over the histogram of document sizes a source, whose size depends on how many different lengths documents have,
and a step that leaves the interval known to hold the solution is replaced by its middle.

Rates become whole copies so that the words taken stay at the target: from the longest size down, a size rounds its copies
and hands the words it is off to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinal import group_row_number
from ..session import cut_lineage
from .common import WORD

#: Sizes of a source that hand their error on one by one; smaller ones round by running sums. No size past these exceeds
#: the source's words divided by this number, which bounds the error.
_FOLDED = 1000
_STEPS = 80
_NEAR = 1e-10


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, weights: Sequence[float], most: float) -> DataFrame:
    """`k`, `source`, `source_size`, `documents`, `target` from `source`, `size`.

    Sources in code point order (null last) weigh `weights`, repeating, and share `share` of all words by weight; none gets
    more than `most` times its own words, and what is over goes to the others by weight until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    numbered = group_row_number(per, [], [F.col("source").asc_nulls_last()], "k")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    sources = cut_lineage(numbered.withColumn("w", weight))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("w") * F.lit(level) > F.col("source_size") * float(most)
        got = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("source_size"))).alias("s"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        if got["n"] == full or not got["w"]:
            break
        level, full = (total - most * (got["s"] or 0)) / got["w"], got["n"]
    return sources.withColumn("target", F.least(F.col("w") * F.lit(level), F.col("source_size") * float(most))).drop("w")


def balance(histogram: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """`k`, `tilt`: the dual solution of every source whose target lies between none and all it can give."""
    open_ = sources.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(most)))
    state = cut_lineage(open_.select("k", (F.col("target") * F.col("documents") / F.col("source_size")).alias("want"), F.lit(0.0).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(1.0).alias("off")))
    for _ in range(_STEPS):
        if (state.agg(F.max("off")).first()[0] or 0.0) <= _NEAR:
            break
        p = _logistic(F.col("tilt") * F.col("x"))
        gave = histogram.join(state, "k").groupBy("k").agg(F.sum(F.col("n") * most * p * F.col("x")).alias("gave"), F.sum(F.col("n") * most * p * (1 - p) * F.col("x") * F.col("x")).alias("bend"))
        step = state.join(gave, "k").withColumn("d", F.col("gave") - F.col("want"))
        step = step.withColumns({"low": F.when(F.col("d") < 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(F.col("d") > 0, F.col("tilt")).otherwise(F.col("high"))})
        newton = F.col("tilt") - F.col("d") / F.col("bend")
        # Without an end on one side, the middle is a doubling.
        middle = F.when(F.col("low") == float("-inf"), F.least(F.col("high") * 2, F.lit(-1.0))).when(F.col("high") == float("inf"), F.greatest(F.col("low") * 2, F.lit(1.0))).otherwise((F.col("low") + F.col("high")) / 2)
        inside = (F.col("bend") > 0) & (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton) <= 4 * F.abs(F.col("tilt")) + 4)
        done = F.abs(F.col("d")) <= _NEAR * F.col("want")
        state = cut_lineage(step.select("k", "want", F.when(done, F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt"), "low", "high", (F.abs(F.col("d")) / F.col("want")).alias("off")))
    return state.select("k", "tilt")


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -x))))


def whole_copies(rated: DataFrame, most: int) -> DataFrame:
    """`k`, `size`, `n`, `copies`: of each size's `n` documents with rate `r` how many copies are taken in all."""
    down = Window.partitionBy("k").orderBy(F.desc("size"))
    ranked = cut_lineage(rated.withColumn("place", F.row_number().over(down)))
    item = F.struct(F.col("place"), F.col("size"), F.col("n"), F.col("r"))
    heads = ranked.where(F.col("place") <= _FOLDED).groupBy("k").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def fold(acc: Column, x: Column) -> Column:
        want = x["n"] * x["r"] * x["size"] + acc["off"]
        copies = F.least(x["n"] * most, F.greatest(F.lit(0), F.rint(want / x["size"]).cast("long"))).cast("long")
        return F.struct((want - copies * x["size"]).alias("off"), F.concat(acc["out"], F.array(F.struct(x["size"].alias("size"), x["n"].alias("n"), copies.alias("copies")))).alias("out"))

    start = F.struct(F.lit(0.0).alias("off"), F.expr("CAST(array() AS array<struct<size:bigint,n:bigint,copies:bigint>>)").alias("out"))
    folded = cut_lineage(heads.select("k", F.aggregate("items", start, fold).alias("done")))
    head = folded.select("k", F.inline("done.out"))
    rest = ranked.where(F.col("place") > _FOLDED).join(folded.select("k", F.col("done.off").alias("off")), "k")
    upto = Window.partitionBy("k").orderBy("place")
    rest = rest.withColumn("end", F.sum(F.col("n") * F.col("r")).over(upto) + F.col("off") / F.first("size").over(upto))
    upper = F.floor(F.col("end") + 0.5)
    rest = rest.withColumn("copies", upper - F.coalesce(F.lag(upper).over(upto), F.lit(0)))
    rest = rest.select("k", "size", "n", F.least(F.col("n") * most, F.greatest(F.lit(0), F.col("copies"))).cast("long").alias("copies"))
    return head.unionByName(rest)


def mix_sources(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = (5, 2, 1), most: int = 2) -> DataFrame:
    """`doc_id`, `size`, `source_size`, `target`, `taken`, `copies`, one row per row of `docs`.

    `taken` is `copies` (0 to `most`) times `size`. Documents of one source and size share their copies evenly, the rest in
    the order of a hash of the id, so reruns agree. Null texts have size 0 and take nothing; a null source is one more
    source, the last; null and repeated ids are rows like any other (rows that are equal in id, source and size may swap
    their copies); an empty table gives none; further columns are not read.
    """
    sized = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    sources = cut_lineage(source_targets(sized, share, weights, most))
    named = sources.withColumnRenamed("source", "_source")
    sized = cut_lineage(sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "k", "source_size", "target", "documents"))
    counted = sized.where("size > 0").groupBy("k", "size").agg(F.count("*").alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("documents").alias("documents"))
    # Relative size: a source's mean is 1.
    histogram = cut_lineage(counted.withColumn("x", F.col("size") * F.col("documents") / F.col("source_size")))
    tilts = balance(histogram.select("k", "n", "x"), sources, most)
    rate = F.when(F.col("tilt").isNotNull(), most * _logistic(F.col("tilt") * F.col("x"))).when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)
    rated = histogram.join(tilts, "k", "left").select("k", "size", "n", rate.alias("r"))
    copies = cut_lineage(whole_copies(rated, most)).withColumnsRenamed({"k": "_k", "size": "_size", "copies": "_all"})
    numbered = group_row_number(sized, ["k", "size"], [F.xxhash64("doc_id"), F.col("doc_id"), F.monotonically_increasing_id()], "place")
    joined = numbered.join(copies, (F.col("k") == F.col("_k")) & (F.col("size") == F.col("_size")), "left")
    own = F.floor(F.col("_all") / F.col("n")) + (F.col("place") <= F.col("_all") % F.col("n")).cast("long")
    joined = joined.withColumn("copies", F.coalesce(own, F.lit(0)).cast("long"))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
