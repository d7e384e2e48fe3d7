"""User-facing queries composed from the operators: searches, single postings, company pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import filters as flt
from ..operators import rank
from ..operators.diff import longest_prefix_join
from ..rules import trends as R
from . import ticks as T
from . import trends as P

RESULT_COLUMNS = ("id", "ats", "company", "title", "location", "remote", "employment_type", "min_years", "salary", "min_salary_annual",
                  "max_salary_annual", "salary_currency", "department", "url", "posted_at", "first_seen")


def search(df: DataFrame, filters: Mapping, now: str, query: Sequence[float] | Column | None = None, sort: str | None = None,
           per_company: int | None = None, k: int | None = None, page: int | None = None, ats=(), currencies=(), rates=None,
           window: int | None = None) -> DataFrame:
    """One page of results: ranked, sorted within relevance, spread over companies, or browsed.

    Only the result columns (and the vector while ranking) leave the scan. A `window` limits what is
    sorted or spread to the closest rows; without one all rows take part.
    """
    caps = flt.capabilities(df, ats, currencies, rates)
    if sort == "posted":
        filters = {**filters, "posted_sortable": True}
    kept = df.filter(flt.compile_filter(filters, caps, now))
    shown = [c for c in RESULT_COLUMNS if c in df.columns]
    currency = None
    if sort == "salary":
        asked = filters.get("salary_currency")
        currency = asked if asked in caps.currencies else ("USD" if "USD" in caps.currencies else None)
    if query is None:
        kept = kept.select(*shown)
        return rank.salary_browse(kept, currency, k=k, page=page) if currency else rank.browse(kept, sort=sort, k=k, page=page)
    ranked = kept.select(*shown, "vector")
    if sort:
        return rank.sort_within_relevance(ranked, query, sort, window=window, currency=currency, rates=caps.rates, k=k, page=page)
    if per_company:
        limit, offset = rank.page_bounds(k, page)
        spread = rank.spread_companies(rank.scored(ranked, query).drop("vector"), per_company, [F.desc("similarity"), F.asc("id")], window)
        return spread.offset(offset).limit(limit)
    return rank.vector_topk(ranked, query, k=k, page=page)


def job(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows by id in asked order; an absent one is explained with the served id most like it.
    `ids`: position, id."""
    shown = [c for c in RESULT_COLUMNS if c in df.columns and c != "id"]
    asked = ids.groupBy("id").agg(F.min("position").alias("position")).select("position", "id")
    served = df.join(asked.select("id"), "id", "left_semi").groupBy("id").agg(F.min(F.struct(*shown)).alias("_s")).select("id", *[F.col(f"_s.{c}").alias(c) for c in shown], F.lit(True).alias("_here"))
    found = asked.join(served, "id", "left").withColumn("found", F.coalesce("_here", F.lit(False))).drop("_here")
    missing = asked.join(df.select("id"), "id", "left_anti")
    near = rank.closest_ids(df, missing).select(F.col("asked").alias("id"), F.col("id").alias("closest"), F.col("title").alias("closest_title"))
    return found.join(near, "id", "left").orderBy("position")


def _on_boards(df: DataFrame, boards: Sequence[str] | DataFrame) -> DataFrame:
    shown = df.filter(~F.coalesce("is_confident_non_tech", F.lit(False))) if "is_confident_non_tech" in df.columns else df
    if isinstance(boards, DataFrame):
        return flt.scope_boards(shown, boards)
    if not boards:
        raise ValueError("name at least one board")
    return shown.filter(flt.board_clause(boards))


def company_locations(df: DataFrame, boards, per_country: int = 3) -> DataFrame:
    """Where a company's postings are, by country with top cities."""
    return agg.location_rollup(_on_boards(df, boards), per_country)


def company_levels(df: DataFrame, boards) -> DataFrame:
    """A company's postings per seniority band."""
    return agg.level_counts(_on_boards(df, boards))


def company_suggest(directory: DataFrame, query: str, limit: int = 10) -> DataFrame:
    return P.suggest_names(directory, query, limit)


def company_lookup(ids: DataFrame, directory: DataFrame) -> DataFrame:
    """`(id, owner, company)`: the company of a board key or posting id, through the longest listed
    board that prefixes it."""
    whole = ids.select("id", F.concat("id", F.lit(":")).alias("_key"))
    owned = longest_prefix_join(whole, directory, "_key").select("id", "owner", "listed")
    names = directory.groupBy(F.lower("board").alias("_b")).agg(F.min("company").alias("company"))
    return owned.join(names, F.lower("owner") == F.col("_b"), "left").select("id", "owner", F.when(F.col("listed"), F.col("company")).alias("company"))


def find_company(directory: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Directory candidates for a typed name, or the company of a typed board key, with how each
    matched. `directory`: company, board, name, openings."""
    by_key = directory.filter(F.lower("board") == query.lower()).select("name", "company", F.lit(-1).alias("tier"), F.lit("board key").alias("match"), "openings").limit(1)
    per = directory.groupBy("company").agg(F.min("name").alias("name"), F.sum("openings").alias("openings"))
    return by_key.unionByName(P.suggest_names(per, query, limit).select("name", "company", "tier", "match", "openings")).orderBy("tier", F.desc("openings"), "name").limit(limit)


def company_profile(df: DataFrame, directory: DataFrame, companies: Sequence[str], now: str, moves: DataFrame | None = None) -> DataFrame:
    """`(company, section, name, n)` for chosen companies: totals, out-of-domain and remote rows,
    levels, types, categories and how many of each are older than a year, and the trend's move."""
    chosen = directory.filter(F.col("company").isin(*companies)).select(F.lower("board").alias("_b"), F.col("company").alias("_company")).dropDuplicates(["_b"])
    rows = df.join(chosen, F.lower(df["board"]) == F.col("_b")).drop("_b")
    year_ago = F.date_sub(F.lit(now).cast("date"), 365).cast("string")
    shaped = F.coalesce(flt.date_shaped(F.col("posted_at")), F.lit(False))
    old = F.coalesce(shaped & (F.col("posted_at") < year_ago), F.lit(False))
    level = agg.band(F.col("min_years"), F.col("title"), F.col("employment_type"))
    types = flt.employment_flags(F.col("employment_type"), F.col("title"))
    type_names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in types.items()]))
    tags = F.concat(
        F.array(F.struct(F.lit("total").alias("section"), F.lit("postings").alias("name")), F.struct(F.lit("level").alias("section"), level.alias("name")),
                F.struct(F.lit("category").alias("section"), F.coalesce("department", F.lit("none")).alias("name"))),
        F.transform(type_names, lambda t: F.struct(F.lit("type").alias("section"), t.alias("name"))),
        F.when(F.coalesce("remote", F.lit(False)), F.array(F.struct(F.lit("remote").alias("section"), F.lit("remote").alias("name")))).otherwise(F.array().cast("array<struct<section:string,name:string>>")),
        F.when(F.coalesce("is_confident_non_tech", F.lit(False)), F.array(F.struct(F.lit("total").alias("section"), F.lit("non-tech").alias("name")))).otherwise(F.array().cast("array<struct<section:string,name:string>>")),
        F.when(old, F.array(F.struct(F.lit("older than a year").alias("section"), F.coalesce("department", F.lit("none")).alias("name")))).otherwise(F.array().cast("array<struct<section:string,name:string>>")),
    )
    counts = rows.select(F.col("_company").alias("company"), F.explode(tags).alias("t")).groupBy("company", "t.section", "t.name").agg(F.count("*").alias("n"))
    if moves is None:
        return counts
    figures = moves.filter(F.col("line").isin(*companies)).select(F.col("line").alias("company"), F.inline(F.array(*[
        F.struct(F.lit("trend").alias("section"), F.lit(f).alias("name"), F.col(f).cast("bigint").alias("n")) for f in ("latest", "hiring", "opened", "closed")
    ])))
    return counts.unionByName(figures.filter(F.col("n").isNotNull()))


def hiring_now(candidates: DataFrame, lens: str, span_days: float = R.NEW_WINDOW_DAYS) -> DataFrame:
    """One lens of the hot ranking, with each company's pace and flags on what may mislead: staffing
    firms and job boards, counts mostly found late, closures partly uncounted."""
    top = P.hot_ranking(candidates).filter(F.col("lens") == lens)
    facts = candidates.select("company", "operator", "stock", "opened", "closed", *[c for c in ("unseen", "opened_fresh", "opened_found_late") if c in candidates.columns])
    rows = top.join(facts, "company")
    late = T.mostly_found_late(F.col("opened"), F.col("opened_fresh"), F.col("opened_found_late")) if "opened_fresh" in candidates.columns else F.lit(False)
    return rows.select("place", "company", "figure", "operator", "stock", F.round(F.col("opened") / span_days, 4).alias("opened_a_day"),
                       F.col("operator").isin(*R.HIDDEN_BY_DEFAULT).alias("hidden_by_default"), late.alias("mostly_found_late"),
                       F.coalesce(F.col("unseen") > 0, F.lit(False)).alias("closures_partly_uncounted")).orderBy("place")
