"""Facet counts: every option of every dimension in one scan."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import filters as R
from .filters import KEYS, Capabilities, capabilities, filter_clauses, is_set


def facet_options(caps: Capabilities) -> list[tuple[str, object]]:
    """`(dimension, value)` in display order; `None` is the dimension's "Any" row."""
    plan: list[tuple[str, object]] = []
    if caps.has("first_seen"):
        plan += [("seen_within", h) for h in R.SEEN_HOURS]
    plan += [("posted_within", d) for d in R.POSTED_DAYS]
    plan += [("max_years", n) for n in R.EXPERIENCE_CEILINGS]
    plan += [("etype", t) for t in R.EMPLOYMENT_TYPES]
    plan += [("remote", True)]
    if caps.has("min_salary_annual"):
        plan += [("has_salary", True)]
    plan += [("ats", a) for a in caps.ats]
    plan += [(d, None) for d in sorted({d for d, _ in plan} - {"remote", "has_salary"})]
    return plan


def _all(clauses) -> Column:
    clauses = list(clauses)
    return reduce(lambda a, b: a & b, clauses) if clauses else F.lit(True)


def facet_counts(df: DataFrame, filters: Mapping, now: str, ats=(), currencies=(), rates=None) -> DataFrame:
    """`(dimension, value, n)`: rows matched if that dimension were set to the value, every other
    filter kept and the dimension's own lifted; plus `total`.

    One pass. Clauses the facets never lift filter the scan. The rows are then reduced to their
    verdict on each liftable clause and option, and the options counted side by side; the result
    is a single row turned long, so the cost does not depend on how many options there are.
    """
    caps = capabilities(df, ats, currencies, rates)
    plan = facet_options(caps)
    dimensions = {d for d, _ in plan}
    clauses = filter_clauses(filters, caps, now)
    lifted = {k: c for k, c in clauses.items() if k in dimensions}
    fixed = [c for k, c in clauses.items() if k not in dimensions]

    verdicts: dict[str, Column] = {f"k_{k}": F.coalesce(c, F.lit(False)) for k, c in lifted.items()}
    option_names: list[tuple[str, object, str | None]] = []
    for i, (dimension, value) in enumerate(plan):
        if value is None:
            option_names.append((dimension, value, None))
            continue
        clause = filter_clauses({dimension: value, "include_non_tech": True}, caps, now)[dimension]
        verdicts[f"o_{i}"] = F.coalesce(clause, F.lit(False))
        option_names.append((dimension, value, f"o_{i}"))
    judged = df.filter(_all(fixed)).select(*[c.alias(n) for n, c in verdicts.items()])

    counts = [F.count_if(_all(F.col(f"k_{k}") for k in lifted)).alias("c_total")]
    for i, (dimension, _, column) in enumerate(option_names):
        kept = [F.col(f"k_{k}") for k in lifted if k != dimension]
        if column:
            kept.append(F.col(column))
        counts.append(F.count_if(_all(kept)).alias(f"c_{i}"))
    wide = judged.agg(*counts)

    rows = [F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value"), F.col("c_total").alias("n"))]
    for i, (dimension, value, _) in enumerate(option_names):
        text = "Any" if value is None else str(value)
        rows.append(F.struct(F.lit(dimension).alias("dimension"), F.lit(text).alias("value"), F.col(f"c_{i}").alias("n")))
    return wide.select(F.inline(F.array(*rows)))


def blocking_filter(df: DataFrame, filters: Mapping, now: str, ats=(), currencies=(), rates=None) -> DataFrame:
    """On a zero total, the one active filter whose removal recovers most rows, first in the
    vocabulary's order on ties; null when the total is not zero or nothing recovers a row."""
    caps = capabilities(df, ats, currencies, rates)
    clauses = filter_clauses(filters, caps, now)
    active = [k for k in KEYS if k in filters and is_set(k, filters[k]) and k not in R.NEVER_BLOCKING]
    counts = [F.count_if(_all(clauses.values())).alias("total")]
    for key in active:
        without = {k: v for k, v in filters.items() if k != key}
        counts.append(F.count_if(_all(filter_clauses(without, caps, now).values())).alias(f"r_{key}"))
    wide = df.agg(*counts)
    if not active:
        return wide.select("total", F.lit(None).cast("string").alias("blocking"), F.lit(0).cast("bigint").alias("recovers"))
    # Highest count first; among equals the smaller position, which is the vocabulary's order.
    best = F.array_max(
        F.array(*[
            F.struct(F.col(f"r_{k}").alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("key"))
            for i, k in enumerate(active)
        ])
    )
    blamed = (F.col("total") == 0) & (F.col("best.n") > 0)
    return wide.withColumn("best", best).select(
        "total",
        F.when(blamed, F.col("best.key")).alias("blocking"),
        F.when(blamed, F.col("best.n")).otherwise(F.lit(0)).alias("recovers"),
    )


def text_coverage(df: DataFrame, filters: Mapping, now: str, ats=(), currencies=()) -> DataFrame:
    """The keyword lifted: rows the other filters keep, and how many of them have stored text."""
    others = {k: v for k, v in filters.items() if k not in ("kw", "kw_in")}
    caps = capabilities(df, ats, currencies)
    return df.filter(_all(filter_clauses(others, caps, now).values())).agg(
        F.count("description").alias("covered"), F.count(F.lit(1)).alias("total")
    )


__all__ = ["blocking_filter", "facet_counts", "facet_options", "text_coverage"]
