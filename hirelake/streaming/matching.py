"""Rows matched to stored searches the other way round: searches are data that rows are joined to.

A search becomes clauses, each a list of tokens of which a row must have one ("ats=lever", "country=DE", "years=3"), and
bounds and text terms that are compared after the join. A row becomes the list of its tokens. Of a search's clauses only the
rarest among the rows at hand is joined; the others are checked on the pairs that meet. The plan has one size, however many
searches there are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_prefixes, keyword_terms
from ..operators.filters import KEYS, country_code, date_shaped, employment_flags, is_set
from ..rules import filters as R
from ..session import cut_lineage

#: Searches up to this many years become tokens; beyond it only the bound is compared.
_MOST_YEARS = 40
#: Searches of up to this many tokens and terms together are broadcast; beyond it both sides of a join are shuffled.
_MOST_SENT = 100_000
_PREFIX = 3
_ANY = "any"
_SHAPE = ("clauses array<array<string>>, terms array<struct<literal:string,pattern:string,title:boolean,description:boolean>>, posted_from string, posted_to string, posted_shaped boolean, "
          "seen_from string, seen_to string, seen_past string, years_to int, years_from int")
#: The column that a key is answered from.
_NEEDS = {
    "remote": "remote", "max_years": "min_years", "ats": "ats", "etype": "employment_type", "country": "countries", "india": "places", "boards": "id", "ids": "id", "family": "family", "has_salary": "min_salary_annual",
    "work_authorization": "stances", "posted_within": "posted_at", "posted_after": "posted_at", "posted_before": "posted_at", "posted_sortable": "posted_at", "seen_within": "first_seen", "seen_after": "first_seen",
    "seen_before": "first_seen", "first_seen_after": "first_seen", "required_years_at_least": "min_years", "title_words": "title", "kw": "title", "kw_in": "title", "include_non_tech": "id",
}


def parse_search(filters: Mapping, now: str, columns: frozenset[str]) -> dict:
    """One search as clauses, text terms and bounds. Keys that are unknown, or that rows can't answer by themselves (pay in a
    currency, an account's own lists), are refused."""
    unknown = sorted(set(filters) - set(KEYS))
    given = {k: v for k, v in filters.items() if is_set(k, v)}
    beyond = sorted(k for k in given if k not in _NEEDS or _NEEDS[k] not in columns)
    if unknown or beyond:
        raise ValueError(f"a stored search can't be matched by {', '.join(unknown or beyond)}")
    clauses: list[list[str]] = []
    out: dict = {name: None for name in ("posted_from", "posted_to", "posted_shaped", "seen_from", "seen_to", "seen_past", "years_to", "years_from")}
    if "remote" in given:
        clauses.append(["remote=true"])
    if "max_years" in given:
        out["years_to"] = int(given["max_years"])
        if out["years_to"] <= _MOST_YEARS:
            clauses.append(["years=none", *(f"years={n}" for n in range(out["years_to"] + 1))])
    if "etype" in given:
        if given["etype"] not in R.EMPLOYMENT_TYPES:
            raise ValueError(f"unknown value for etype: {given['etype']!r}")
        clauses.append([f"etype={given['etype']}"])
    if "country" in given:
        code = country_code(given["country"])
        if not code:
            raise ValueError(f"unknown value for country: {given['country']!r}")
        clauses.append([f"country={code}"])
    if "india" in given:
        clauses.append([f"place={given['india'].lower()}"])
    for key, name in (("ats", "ats"), ("family", "family")):
        if key in given:
            clauses.append([f"{name}={given[key]}"])
    if "boards" in given:
        clauses.append([f"board={b.lower()}" for b in given["boards"] if b])
    if "ids" in given:
        clauses.append([f"id={i}" for i in given["ids"]])
    if "has_salary" in given:
        clauses.append(["salary=yes"])
    if "work_authorization" in given:
        asked = given["work_authorization"]
        clauses.append([f"stance={s}" for s in ([asked, "offers_sponsorship"] if asked == "may_offer_sponsorship" else [asked])])
    if "is_confident_non_tech" in columns and not given.get("include_non_tech"):
        clauses.append(["tech=yes"])
    terms = []
    for key, scope in (("kw", R.KEYWORD_SCOPES.get(given.get("kw_in") or R.KEYWORD_DEFAULT_SCOPE, ())), ("title_words", ("title",))):
        scope = [c for c in scope if c in columns]
        for literal, pattern in keyword_terms(given[key], R.KEYWORD_MAX_TERMS, R.TERM_LENGTH) if key in given and scope else ():
            terms.append({"literal": literal, "pattern": pattern, "title": "title" in scope, "description": "description" in scope})
            # Where the term begins with a letter or digit, a word of the row begins as the term does.
            start = re.match(r"[a-z0-9]+", literal)
            if start:
                clauses.append([f"{c}={start[0][:_PREFIX]}" for c in scope])
    if "required_years_at_least" in given:
        out["years_from"] = int(given["required_years_at_least"])
    day = lambda text: date.fromisoformat(text)
    next_day = lambda text: (day(text) + timedelta(days=1)).isoformat()
    from_days = [day(given["posted_after"]).isoformat()] if "posted_after" in given else []
    if "posted_within" in given:
        from_days.append((datetime.fromisoformat(now) - timedelta(days=int(given["posted_within"]))).strftime("%Y-%m-%d"))
    out["posted_from"] = max(from_days, default=None)
    out["posted_to"] = next_day(given["posted_before"]) if "posted_before" in given else None
    out["posted_shaped"] = True if any(k.startswith("posted_") for k in given) else None
    from_seen = [day(given["seen_after"]).isoformat()] if "seen_after" in given else []
    if "seen_within" in given:
        from_seen.append((datetime.fromisoformat(now) - timedelta(hours=int(given["seen_within"]))).isoformat(timespec="seconds"))
    out["seen_from"] = max(from_seen, default=None)
    out["seen_to"] = next_day(given["seen_before"]) if "seen_before" in given else None
    out["seen_past"] = datetime.fromisoformat(given["first_seen_after"]).isoformat(timespec="seconds") if "first_seen_after" in given else None
    return {"clauses": clauses, "terms": terms, **out}


def parse_searches(subscriptions: DataFrame, now: str, columns: frozenset[str]) -> DataFrame:
    """Adds what `parse_search` makes of the JSON in `filter` to each subscription."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"subscription": s, "watermark": w, **parse_search(json.loads(f or "{}"), now, columns)} for s, w, f in zip(batch["subscription"], batch["watermark"], batch["filter"])]
            out = pd.DataFrame(rows, columns=["subscription", "watermark", *(c.split(" ")[0] for c in re.split(r", (?=\w+ )", _SHAPE))])
            yield out.astype({"years_to": "Int32", "years_from": "Int32"})

    return subscriptions.select("subscription", "watermark", "filter").mapInPandas(parse, f"subscription string, watermark string, {_SHAPE}")


def row_tokens(columns: frozenset[str], texts: Sequence[str] = ("title", "description")) -> Column:
    """All tokens of a row that its columns can give; words of `texts` only."""
    named = lambda prefix, value: F.transform(value, lambda v: F.concat(F.lit(prefix + "="), v.cast("string")))
    one = lambda value: F.array_compact(F.array(value))
    starts = lambda text: F.array_distinct(F.flatten(F.transform(
        F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""), lambda w: F.array(*[F.left(w, F.lit(n)) for n in range(1, _PREFIX + 1)]))))
    parts = [F.array(F.lit(_ANY))]
    if "remote" in columns:
        parts.append(one(F.when(F.col("remote"), F.lit("remote=true"))))
    if "min_years" in columns:
        parts.append(F.array(F.concat(F.lit("years="), F.coalesce(F.greatest(F.col("min_years"), F.lit(0)).cast("string"), F.lit("none")))))
    if "employment_type" in columns:
        flags = employment_flags(F.col("employment_type"))
        held = {name: F.col(rule["column"]) if rule["column"] in columns else flags[rule["column"]] for name, rule in R.EMPLOYMENT_TYPES.items()}
        parts.append(F.array_compact(F.array(*[F.when(flag, F.lit(f"etype={name}")) for name, flag in held.items()])))
    for prefix, column in (("country", "countries"), ("place", "places"), ("stance", "stances")):
        if column in columns:
            parts.append(named(prefix, F.col(column)))
    for prefix, column in (("ats", "ats"), ("family", "family"), ("id", "id")):
        if column in columns:
            parts.append(named(prefix, one(F.col(column))))
    if "id" in columns:
        parts.append(named("board", key_prefixes(F.lower("id"))))
    if "min_salary_annual" in columns:
        parts.append(one(F.when(F.col("min_salary_annual").isNotNull(), F.lit("salary=yes"))))
    if "is_confident_non_tech" in columns:
        parts.append(one(F.when(~F.coalesce(F.col("is_confident_non_tech"), F.lit(False)), F.lit("tech=yes"))))
    parts += [named(c, starts(F.col(c))) for c in texts if c in columns]
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(p, empty) for p in parts]))


def _few(searches: DataFrame) -> bool:
    """Whether all that the searches hold is small enough to be broadcast."""
    held = F.aggregate("clauses", F.size("terms") + 1, lambda n, c: n + 1 + F.size(c))
    return (searches.agg(F.sum(held).alias("n")).first()["n"] or 0) <= _MOST_SENT


def _meet(many: DataFrame, searched: DataFrame, on: str, few: bool, how: str = "inner") -> DataFrame:
    """`many` joined with what stems from the searches. Spark judges by the size of files, and tokens are many times as large
    as theirs: left to itself it sends all tokens of the rows through the driver."""
    return many.join(F.broadcast(searched), on, how) if few else many.hint("merge").join(searched, on, how)


def _anchors(searches: DataFrame, tokens: DataFrame, few: bool) -> DataFrame:
    """Each search with its rarest clause (`anchor`) by how many rows have its tokens; one without clauses meets every row."""
    each = searches.select("subscription", F.posexplode("clauses").alias("at", "clause")).select("subscription", "at", F.explode("clause").alias("token"))
    # Rows have a token for each id; only those that a search names are counted.
    counts = _meet(tokens, each.select("token").distinct(), "token", few, "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    cost = _meet(each, counts, "token", few, "left").groupBy("subscription", "at").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    best = cost.groupBy("subscription").agg(F.min(F.struct("n", "at")).alias("b")).select("subscription", F.col("b.at").alias("_at"))
    joined = _meet(searches, best, "subscription", few, "left")
    never = F.exists("clauses", lambda c: F.size(c) == 0)
    return joined.where(~never).withColumn("anchor", F.coalesce(F.get("clauses", F.col("_at")), F.array(F.lit(_ANY)))).drop("_at")


def match_subscriptions(batch: DataFrame, subscriptions: DataFrame, now: str) -> DataFrame:
    """The rows of `batch` beside each subscription (`subscription`, `watermark`) whose search keeps them.

    `subscriptions`: `subscription` (unique), `watermark` and `filter`, the search as JSON by the keys of `compile_filter`. A
    search without keys keeps every row. An unknown key, and one that the batch has no column for, raises.
    """
    columns = frozenset(batch.columns)
    searches = cut_lineage(parse_searches(subscriptions, now, columns))
    # Words of a long text become tokens only if some search asks for them.
    asked = [c for c in ("title", "description") if c in columns and searches.where(F.exists("terms", lambda t: t[c])).head(1)]
    rows = cut_lineage(batch.withColumns({"_row": F.monotonically_increasing_id(), "_tokens": row_tokens(columns, asked)}))
    tokens = rows.select("_row", F.explode("_tokens").alias("token"))
    few = _few(searches)
    # Read twice below, and all tokens are counted for it.
    anchored = cut_lineage(_anchors(searches, tokens, few))
    met = _meet(tokens, anchored.select("subscription", F.explode("anchor").alias("token")), "token", few).select("_row", "subscription").distinct()
    # The rows' files are far smaller than the rows, so Spark would send all of them through the driver.
    met = _meet(rows.hint("merge").join(met, "_row"), anchored, "subscription", few)
    kept = F.forall("clauses", lambda c: F.arrays_overlap(c, F.col("_tokens")))
    scopes = [c for c in ("title", "description") if c in columns]
    if scopes:
        says = lambda t, c: F.coalesce(t[c] & F.contains(F.lower(F.col(c)), t["literal"]) & F.regexp_like(F.col(c), t["pattern"]), F.lit(False))
        kept = kept & F.forall("terms", lambda t: _any([says(t, c) for c in scopes]))
    bound = lambda name, test: F.col(name).isNull() | F.coalesce(test, F.lit(False))
    if "posted_at" in columns:
        shaped = F.col("posted_at_comparable") if "posted_at_comparable" in columns else date_shaped(F.col("posted_at"))
        kept = kept & bound("posted_shaped", shaped) & bound("posted_from", F.col("posted_at") >= F.col("posted_from")) & bound("posted_to", F.col("posted_at") < F.col("posted_to"))
    if "first_seen" in columns:
        seen = F.col("first_seen")
        kept = kept & bound("seen_from", seen >= F.col("seen_from")) & bound("seen_to", seen < F.col("seen_to")) & bound("seen_past", seen > F.col("seen_past"))
    if "min_years" in columns:
        years = F.col("min_years")
        kept = kept & bound("years_to", years.isNull() | (years <= F.col("years_to"))) & bound("years_from", years >= F.col("years_from"))
    return met.where(kept).select(*batch.columns, "subscription", "watermark")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out
