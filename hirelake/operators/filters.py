"""The search filter vocabulary compiled to Column predicates.

`filter_clauses` gives one predicate per key that says something, so that facets can lift a single
key; `compile_filter` ANDs them. Flag columns written by `served_projection` are used where the
table has them, else the rule itself is evaluated.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, fold, fold_text, key_prefixes, keyword_terms, rx_escape
from ..rules import filters as R
from ..rules.places import CITY_GROUPS, COUNTRIES, COUNTRY_ALIASES

KEYS = (
    "remote", "max_years", "ats", "etype", "india", "country", "location", "company", "has_salary",
    "salary_min", "salary_max", "salary_currency", "posted_within", "posted_sortable", "seen_within",
    "posted_after", "posted_before", "seen_after", "seen_before", "first_seen_after", "kw", "kw_in",
    "title_words", "max_age_days", "required_years_at_least", "exclude_company", "work_authorization",
    "include_non_tech", "boards", "exclude_boards", "ids", "operators", "family", "followed", "hidden", "mine",
)
SWITCHES = ("remote", "has_salary", "posted_sortable", "include_non_tech", "mine")

ISO_SHAPE = r"^.{4}-.{2}-.{2}"


@dataclass(frozen=True)
class Capabilities:
    """What the open table supports: its columns, and the values two filters are checked against."""

    columns: frozenset[str]
    ats: tuple[str, ...] = ()
    currencies: tuple[str, ...] = ()
    rates: Mapping[str, float] = field(default_factory=lambda: R.FX_RATES)

    def has(self, *names: str) -> bool:
        return all(n in self.columns for n in names)


def capabilities(df: DataFrame, ats: Iterable[str] = (), currencies: Iterable[str] = (), rates=None) -> Capabilities:
    """Capabilities from a table's schema; the two value lists come from `dimension_values`."""
    return Capabilities(frozenset(df.columns), tuple(ats), tuple(currencies), dict(rates or R.FX_RATES))


def is_set(key: str, value) -> bool:
    """A zero is a constraint; an absent, empty or switched-off value is not."""
    if key in SWITCHES:
        return value is True
    if key in ("boards", "ids", "operators", "followed"):
        return value is not None
    return value is not None and value is not False and value != "" and value != ()


def employment_rule(etype: str, raw: Column, title: Column | None = None) -> Column:
    """Whether the raw employment text (and the title, for internships) reads as a type."""
    rule = R.EMPLOYMENT_TYPES[etype]
    text = F.lower(F.coalesce(raw, F.lit("")))
    hit = contains_any(text, rule["includes"])
    for include, veto in rule.get("unless", ()):
        hit = hit | (text.contains(include) & ~text.contains(veto))
    if rule.get("whole"):
        hit = hit | text.isin(*rule["whole"])
    if rule.get("excludes"):
        hit = hit & ~contains_any(text, rule["excludes"])
    if title is not None and rule.get("title"):
        hit = hit | F.coalesce(title.rlike(rule["title"]), F.lit(False))
    return hit


def employment_flags(raw: Column, title: Column | None = None) -> dict[str, Column]:
    """The four flag columns; text that no rule reads counts as full-time."""
    hits = {t: employment_rule(t, raw, title) for t in R.EMPLOYMENT_TYPES}
    none_read = ~reduce(lambda a, b: a | b, hits.values())
    hits["full-time"] = hits["full-time"] | none_read
    return {R.EMPLOYMENT_TYPES[t]["column"]: c for t, c in hits.items()}


def date_shaped(c: Column) -> Column:
    """The guard every posted-date comparison carries; null where the date is null."""
    return c.rlike(ISO_SHAPE)


def _now(now: str) -> datetime:
    return datetime.fromisoformat(now)


def _next_day(day: str) -> str:
    return (date.fromisoformat(day) + timedelta(days=1)).isoformat()


def _days_ago(now: str, days: int) -> str:
    return (_now(now) - timedelta(days=days)).strftime("%Y-%m-%d")


def company_contains(term: str) -> Column:
    """Case-blind substring; wildcard characters are literal because no pattern is built."""
    return F.lower(F.col("company")).contains(whole_term(term).lower())


def whole_term(term: str) -> str:
    """The term, refused where it is longer than a term may be."""
    if len(term) > R.TERM_LENGTH:
        raise ValueError(f"a term may have at most {R.TERM_LENGTH} characters")
    return term


def keyword_clause(kw: str, columns: Iterable[str]) -> Column | None:
    """Every term must start a word in one of the columns. The cheap literal test runs first."""
    clauses = []
    for literal, pattern in keyword_terms(kw, R.KEYWORD_MAX_TERMS, R.TERM_LENGTH):
        arms = [F.lower(F.col(c)).contains(literal) & F.col(c).rlike(pattern) for c in columns]
        clauses.append(reduce(lambda a, b: a | b, arms))
    return reduce(lambda a, b: a & b, clauses) if clauses else None


def location_clause(term: str) -> Column:
    """Accent-blind substring, or another spelling of a renamed city as a whole word."""
    asked = fold_text(whole_term(term))
    place = fold(F.col("location"))
    hit = place.contains(asked)
    for group in CITY_GROUPS:
        for spelling in group:
            found = [i for i in range(len(asked)) if asked.startswith(spelling, i)]
            whole = [
                i for i in found
                if (i == 0 or not asked[i - 1].isalnum())
                and (i + len(spelling) == len(asked) or not asked[i + len(spelling)].isalnum())
            ]
            for at in whole:
                for other in group:
                    variant = asked[:at] + other + asked[at + len(spelling):]
                    if asked not in variant:
                        hit = hit | place.rlike(f"(^|[^a-z0-9]){rx_escape(variant)}([^a-z0-9]|$)")
    return hit


def country_code(asked: str) -> str | None:
    """An ISO code, an English name or a common abbreviation, as the code."""
    squeezed = "".join(ch for ch in asked.casefold() if ch.isalpha())
    if squeezed.upper() in COUNTRIES:
        return squeezed.upper()
    for code, country in COUNTRIES.items():
        if squeezed == "".join(ch for ch in country["name"].casefold() if ch.isalpha()):
            return code
    return COUNTRY_ALIASES.get(squeezed)


def salary_bounds(floor, ceiling, currency: str, currencies: Iterable[str], rates: Mapping[str, float]):
    """`(currency, floor, ceiling)` rows: the bracket restated in every rated currency.

    The asked currency keeps its own numbers; converted bounds round outward. A currency without
    a rate is left out, and if the asked one has none only itself is compared.
    """
    rated = [c for c in currencies if c in rates] if currency in rates else []
    out = []
    for other in rated or [currency]:
        if other == currency:
            out.append((other, floor, ceiling))
        else:
            lo = None if floor is None else int(floor / rates[currency] * rates[other])
            hi = None if ceiling is None else int(ceiling / rates[currency] * rates[other]) + 1
            out.append((other, lo, hi))
    return out


def salary_clause(filters: Mapping, caps: Capabilities) -> Column | None:
    """The bracket: top of range over the floor, bottom under the ceiling, per currency."""
    floor, ceiling = filters.get("salary_min"), filters.get("salary_max")
    if floor is None and ceiling is None:
        return None
    asked = filters.get("salary_currency")
    currency = asked if asked in caps.currencies else R.SALARY_DEFAULT_CURRENCY
    if currency not in caps.currencies:
        return None
    arms = []
    for code, lo, hi in salary_bounds(floor, ceiling, currency, caps.currencies, caps.rates):
        arm = F.col("salary_currency") == code
        if lo is not None:
            arm = arm & (F.coalesce(F.col("max_salary_annual"), F.col("min_salary_annual")) >= lo)
        if hi is not None:
            arm = arm & (F.col("min_salary_annual") <= hi)
        arms.append(arm)
    return reduce(lambda a, b: a | b, arms)


def board_clause(boards: Iterable[str]) -> Column:
    """Rows whose id starts with one of the board keys and a colon, case-blind, in one pass."""
    keys = sorted({b.lower() for b in boards if b})
    if not keys:
        return F.lit(False)
    return F.arrays_overlap(key_prefixes(F.lower(F.col("id"))), F.array(*[F.lit(k) for k in keys]))


def age_clause(days: int, now: str, materialised: bool = False) -> Column:
    """Posted within N days; where the date is missing or unreadable, first seen within them."""
    cut = _days_ago(now, days)
    guard = F.col("posted_at_comparable") if materialised else date_shaped(F.col("posted_at"))
    shaped = F.coalesce(guard, F.lit(False))
    return F.coalesce(F.when(shaped, F.col("posted_at") >= cut).otherwise(F.col("first_seen") >= cut), F.lit(False))


def filter_clauses(filters: Mapping, caps: Capabilities, now: str, strict: bool = False) -> dict[str, Column]:
    """One predicate per key that constrains the table.

    An unknown key raises, and so does a filter whose column the table does not have: leaving its
    clause out would answer with rows that were not asked for. A country that nobody knows keeps
    nothing, or raises when `strict`; another unknown value drops its clause, or raises when `strict`.
    """
    out: dict[str, Column] = {}
    unknown = sorted(set(filters) - set(KEYS))
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(unknown)}")
    given = {k: v for k, v in filters.items() if is_set(k, v)}

    def need(key, *names):
        if not caps.has(*names):
            raise ValueError(f"the table can't answer {key}: it has no column {', '.join(n for n in names if n not in caps.columns)}")

    def refuse(key):
        if strict:
            raise ValueError(f"unknown value for {key}: {given[key]!r}")

    if "remote" in given:
        out["remote"] = F.col("remote")
    if "max_years" in given:
        n = int(given["max_years"])
        flag = f"experience_at_most_{n}"
        out["max_years"] = F.col(flag) if caps.has(flag) else F.col("min_years").isNull() | (F.col("min_years") <= n)
    if "ats" in given:
        if given["ats"] in caps.ats:
            out["ats"] = F.col("ats") == given["ats"]
        else:
            refuse("ats")
    if "etype" in given:
        if given["etype"] in R.EMPLOYMENT_TYPES:
            column = R.EMPLOYMENT_TYPES[given["etype"]]["column"]
            out["etype"] = F.col(column) if caps.has(column) else employment_flags(F.col("employment_type"))[column]
        else:
            refuse("etype")
    if "india" in given:
        need("india", "places")
        out["india"] = F.array_contains("places", given["india"].lower())
    if "country" in given:
        code = country_code(given["country"])
        need("country", "countries")
        if not code:
            refuse("country")
        out["country"] = F.array_contains("countries", code) if code else F.lit(False)
    if "location" in given:
        out["location"] = location_clause(given["location"])
    if "company" in given:
        out["company"] = company_contains(given["company"])
    if "exclude_company" in given:
        out["exclude_company"] = F.col("company").isNull() | ~company_contains(given["exclude_company"])
    if "kw" in given:
        scope = R.KEYWORD_SCOPES.get(given.get("kw_in") or R.KEYWORD_DEFAULT_SCOPE, ())
        columns = [c for c in scope if caps.has(c)]
        if scope and not columns:
            need("kw", *scope)
        if columns and (clause := keyword_clause(given["kw"], columns)) is not None:
            out["kw"] = clause
    if "title_words" in given and (clause := keyword_clause(given["title_words"], ["title"])) is not None:
        out["title_words"] = clause
    if "has_salary" in given:
        out["has_salary"] = F.col("min_salary_annual").isNotNull()
    if (clause := salary_clause(given, caps)) is not None:
        out["salary_min" if "salary_min" in given else "salary_max"] = clause
    posted = F.col("posted_at")
    shaped = F.col("posted_at_comparable") if caps.has("posted_at_comparable") else date_shaped(posted)
    if "posted_sortable" in given:
        out["posted_sortable"] = shaped
    if "posted_within" in given:
        out["posted_within"] = shaped & (posted >= _days_ago(now, int(given["posted_within"])))
    if "posted_after" in given:
        out["posted_after"] = shaped & (posted >= date.fromisoformat(given["posted_after"]).isoformat())
    if "posted_before" in given:
        out["posted_before"] = shaped & (posted < _next_day(given["posted_before"]))
    if any(key in given for key in ("seen_after", "seen_before", "seen_within", "first_seen_after")):
        need("first_seen", "first_seen")
        seen = F.col("first_seen")
        if "seen_after" in given:
            out["seen_after"] = seen >= date.fromisoformat(given["seen_after"]).isoformat()
        if "seen_before" in given:
            out["seen_before"] = seen < _next_day(given["seen_before"])
        if "seen_within" in given:
            since = (_now(now) - timedelta(hours=int(given["seen_within"]))).isoformat(timespec="seconds")
            out["seen_within"] = seen >= since
        if "first_seen_after" in given:
            out["first_seen_after"] = seen > datetime.fromisoformat(given["first_seen_after"]).isoformat(timespec="seconds")
    if "max_age_days" in given:
        out["max_age_days"] = age_clause(int(given["max_age_days"]), now, caps.has("posted_at_comparable"))
    if "required_years_at_least" in given:
        out["required_years_at_least"] = F.col("min_years") >= int(given["required_years_at_least"])
    if "work_authorization" in given:
        need("work_authorization", "stances")
        asked = given["work_authorization"]
        hit = F.array_contains("stances", asked)
        # Asking for jobs that at least may offer sponsorship keeps those that do.
        if asked == "may_offer_sponsorship":
            hit = hit | F.array_contains("stances", "offers_sponsorship")
        out["work_authorization"] = hit
    if caps.has("is_confident_non_tech") and not given.get("include_non_tech"):
        out["include_non_tech"] = F.col("is_confident_non_tech").isNull() | (F.col("is_confident_non_tech") == F.lit(False))
    if "boards" in given:
        out["boards"] = board_clause(given["boards"])
    if given.get("exclude_boards"):
        out["exclude_boards"] = ~board_clause(given["exclude_boards"])
    if given.get("mine"):
        out["mine"] = board_clause(filters.get("followed") or ())
    if given.get("hidden"):
        out["hidden"] = ~board_clause(given["hidden"])
    if "ids" in given:
        out["ids"] = F.col("id").isin(*given["ids"]) if given["ids"] else F.lit(False)
    if "operators" in given:
        need("operators", "operator")
        out["operators"] = F.col("operator").isin(*given["operators"])
    if "family" in given:
        need("family", "family")
        out["family"] = F.col("family") == given["family"]
    return out


def compile_filter(filters: Mapping, caps: Capabilities, now: str, strict: bool = False) -> Column:
    """The whole filter as one predicate; no constraint is `true`."""
    clauses = filter_clauses(filters, caps, now, strict)
    return reduce(lambda a, b: a & b, clauses.values()) if clauses else F.lit(True)


def apply_filter(df: DataFrame, filters: Mapping, now: str, ats=(), currencies=(), rates=None, strict=False) -> DataFrame:
    return df.filter(compile_filter(filters, capabilities(df, ats, currencies, rates), now, strict))


# Filters whose list is a table rather than literals. The joins carry no hint: Spark broadcasts the
# list when its measured size allows and shuffles both sides when it does not.

def keep_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in the id table; an empty table keeps nothing."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def scope_boards(df: DataFrame, boards: DataFrame, exclude: bool = False) -> DataFrame:
    """Whole boards kept or left out, case-blind, by the table's own board column."""
    keys = boards.select(F.lower("board").alias("_board_key")).distinct()
    return df.join(keys, F.lower(df["board"]) == F.col("_board_key"), "left_anti" if exclude else "left_semi")


def account_scope(df: DataFrame, followed: DataFrame, hidden: DataFrame, mine: bool) -> DataFrame:
    """Hidden boards never show; under `mine` only followed ones do, and none followed shows none."""
    out = scope_boards(df, hidden, exclude=True)
    return scope_boards(out, followed) if mine else out


def operator_scope(df: DataFrame, boards: DataFrame, operators: Iterable[str]) -> DataFrame:
    """Rows whose board's operator is listed; a board nobody classified is an employer."""
    dim = boards.select(F.lower("board").alias("_board_key"), F.col("operator").alias("_operator")).groupBy("_board_key").agg(F.min("_operator").alias("_operator"))
    joined = df.join(dim, F.lower(df["board"]) == F.col("_board_key"), "left")
    return joined.withColumn("_operator", F.coalesce("_operator", F.lit("employer"))).filter(
        F.col("_operator").isin(*operators)
    ).drop("_board_key", "_operator")


def operator_left_out(df: DataFrame, boards: DataFrame, operators: Iterable[str]) -> DataFrame:
    """Rows kept and rows the operator choice leaves out, in one pass."""
    dim = boards.groupBy(F.lower("board").alias("_board_key")).agg(F.min("operator").alias("operator"))
    joined = df.join(dim, F.lower(df["board"]) == F.col("_board_key"), "left")
    kept = F.coalesce("operator", F.lit("employer")).isin(*operators)
    return joined.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("left_out"))


def family_scope(df: DataFrame, assignments: DataFrame, family: str, retired: Mapping[str, str] | None = None) -> DataFrame:
    """Rows assigned to a family; an old name that the family replaced counts as it."""
    names = [family, *[old for old, new in (retired or {}).items() if new == family]]
    return keep_ids(df, assignments.filter(F.col("family").isin(*names)))


def role_scope(df: DataFrame, role: str, watchlist: Iterable[tuple]) -> DataFrame:
    """Rows whose title one of a watched role's patterns matches; an unknown role is refused."""
    patterns = next((p for name, _, p in watchlist if role.removeprefix("watch:") == name), None)
    if patterns is None:
        raise ValueError(f"role {role!r} has no watch pattern")
    return df.filter(reduce(lambda a, b: a | b, [F.col("title").rlike(p) for p in patterns]))
