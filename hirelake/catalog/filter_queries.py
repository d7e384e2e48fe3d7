"""Registered queries: one per search filter, each giving the ids it keeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as flt
from ..operators.annotate import annotate_country, annotate_region
from ..rules.filters import FX_RATES
from .bindings import NOW
from .registry import query

CURRENCIES = ("EUR", "INR", "USD", "XAU")


def _kept(filters, prepare=None, ats=("nation_1", "nation_2")):
    filters = {"include_non_tech": True, **filters}

    def run(b):
        df = prepare(b.postings) if prepare else b.postings
        return flt.apply_filter(df, filters, NOW, ats=ats, currencies=CURRENCIES).select("id")

    return run


def _add(name, filters, where, **kw):
    query(name, f"SELECT id FROM postings WHERE {where}")(_kept(filters, **kw))


def _types(prefix=""):
    """The raw employment rules as oracle SQL."""
    t = f"lower(coalesce({prefix}employment_type, ''))"
    full = (f"({t} LIKE '%full%' OR {t} LIKE '%\\_ft%' ESCAPE '\\' OR {t} LIKE '%temps plein%' OR {t} LIKE '%tiempo completo%' OR {t} LIKE '%vollzeit%' OR {t} LIKE '%全职%'"
            f" OR ({t} LIKE '%permanent%' AND {t} NOT LIKE '%part%') OR ({t} LIKE '%regular%' AND {t} NOT LIKE '%part%')"
            f" OR ({t} LIKE '%cdi%' AND {t} NOT LIKE '%part%') OR ({t} LIKE '%fte%' AND {t} NOT LIKE '%after%') OR {t} IN ('f', 'ft'))")
    part = f"({t} LIKE '%part%' OR {t} LIKE '%\\_pt%' ESCAPE '\\')"
    contract = f"({t} LIKE '%contract%' OR {t} LIKE '%freelance%' OR {t} LIKE '%fixed%' OR {t} LIKE '%temporary%')"
    intern = f"(({t} LIKE '%intern%' OR {t} LIKE '%co-op%' OR {t} LIKE '%coop%') AND {t} NOT LIKE '%international%')"
    return full, part, contract, intern


FULL, PART, CONTRACT, INTERN = _types()
FULL_OR_NONE = f"({FULL} OR NOT ({FULL} OR {PART} OR {CONTRACT} OR {INTERN}))"

# Accents as the oracle folds them; the bound places hold "ü" alone.
FOLDED = "translate(lower(location), 'üéè', 'uee')"

_add("filter_remote", {"remote": True}, "remote")
_add("filter_max_years", {"max_years": 5}, "min_years IS NULL OR min_years <= 5")
_add("filter_required_years_at_least", {"required_years_at_least": 6}, "min_years >= 6")
_add("filter_ats", {"ats": "nation_2"}, "ats = 'nation_2'")
_add("filter_etype_full_time", {"etype": "full-time"}, FULL_OR_NONE)
_add("filter_etype_part_time", {"etype": "part-time"}, PART)
_add("filter_etype_contract", {"etype": "contract"}, CONTRACT)
_add("filter_etype_internship", {"etype": "internship"}, INTERN)
_add("filter_location", {"location": "zurich"}, f"{FOLDED} LIKE '%zurich%' OR regexp_matches({FOLDED}, '(^|[^a-z0-9])zuerich([^a-z0-9]|$)')")
_add("filter_location_renamed", {"location": "Bangalore"},
     f"{FOLDED} LIKE '%bangalore%' OR regexp_matches({FOLDED}, '(^|[^a-z0-9])bengaluru([^a-z0-9]|$)')")
_add("filter_company", {"company": "acme furn"}, "lower(company) LIKE '%acme furn%'")
_add("filter_exclude_company", {"exclude_company": "Acme"}, "company IS NULL OR NOT lower(company) LIKE '%acme%'")
_add("filter_kw_title", {"kw": "eng data"},
     "regexp_matches(title, '(^|[^a-z0-9])eng', 'i') AND regexp_matches(title, '(^|[^a-z0-9])data', 'i')")
_add("filter_kw_description", {"kw": "c++ \"visa sponsorship\"", "kw_in": "description"},
     "regexp_matches(description, '(^|[^a-z0-9])c\\+\\+', 'i') AND regexp_matches(description, '(^|[^a-z0-9])visa[^a-z0-9]+sponsorship', 'i')")
_add("filter_kw_both", {"kw": "java", "kw_in": "both"},
     "regexp_matches(title, '(^|[^a-z0-9])java', 'i') OR regexp_matches(description, '(^|[^a-z0-9])java', 'i')")
_add("filter_title_words", {"title_words": "ai scientist"},
     "regexp_matches(title, '(^|[^a-z0-9])ai', 'i') AND regexp_matches(title, '(^|[^a-z0-9])scientist', 'i')")
_add("filter_has_salary", {"has_salary": True}, "min_salary_annual IS NOT NULL")


def _bracket(floor, ceiling, currency):
    arms = []
    for code in CURRENCIES:
        if code not in FX_RATES:
            continue
        if code == currency:
            lo, hi = str(floor), str(ceiling)
        else:
            lo = f"CAST(trunc(CAST({floor} AS DOUBLE) / {FX_RATES[currency]} * {FX_RATES[code]}) AS BIGINT)"
            hi = f"CAST(trunc(CAST({ceiling} AS DOUBLE) / {FX_RATES[currency]} * {FX_RATES[code]}) AS BIGINT) + 1"
        arms.append(f"(salary_currency = '{code}' AND coalesce(max_salary_annual, min_salary_annual) >= {lo} AND min_salary_annual <= {hi})")
    return " OR ".join(arms)


_add("filter_salary_bracket", {"salary_min": 100000, "salary_max": 250000, "salary_currency": "EUR"}, _bracket(100000, 250000, "EUR"))
_add("filter_salary_default_currency", {"salary_min": 90000, "salary_max": 300000, "salary_currency": "ZZZ"}, _bracket(90000, 300000, "USD"))
_add("filter_posted_within", {"posted_within": 90}, "posted_at LIKE '____-__-__%' AND posted_at >= '2001-05-04'")
_add("filter_posted_after", {"posted_after": "1999-06-15"}, "posted_at LIKE '____-__-__%' AND posted_at >= '1999-06-15'")
_add("filter_posted_before", {"posted_before": "1996-02-29"}, "posted_at LIKE '____-__-__%' AND posted_at < '1996-03-01'")
_add("filter_posted_sortable", {"posted_sortable": True}, "posted_at LIKE '____-__-__%'")
_add("filter_seen_within", {"seen_within": 168}, "first_seen >= '2001-07-26T00:00:00+00:00'")
_add("filter_seen_after", {"seen_after": "2000-01-01"}, "first_seen >= '2000-01-01'")
_add("filter_seen_before", {"seen_before": "1996-12-31"}, "first_seen < '1997-01-01'")
_add("filter_first_seen_after", {"first_seen_after": "2001-07-20T06:30:00+00:00"}, "first_seen > '2001-07-20T06:30:00+00:00'")
_add("filter_max_age_days", {"max_age_days": 400},
     "CASE WHEN coalesce(posted_at LIKE '____-__-__%', FALSE) THEN posted_at >= '2000-06-28' ELSE first_seen >= '2000-06-28' END")
_add("filter_boards", {"boards": ["NATION_2:0", "nation_19:1"]}, "lower(id) LIKE 'nation\\_2:0:%' ESCAPE '\\' OR lower(id) LIKE 'nation\\_19:1:%' ESCAPE '\\'")
_add("filter_exclude_boards", {"exclude_boards": ["nation_2:0"]}, "NOT lower(id) LIKE 'nation\\_2:0:%' ESCAPE '\\'")
_add("filter_mine_without_follows", {"mine": True, "followed": []}, "FALSE")
_add("filter_followed_hidden", {"mine": True, "followed": ["nation_2:0", "nation_19:1"], "hidden": ["nation_19:1"]},
     "lower(id) LIKE 'nation\\_2:0:%' ESCAPE '\\'")
_add("filter_ids", {"ids": ["nation_9:769:1", "absent:1:1"]}, "id IN ('nation_9:769:1', 'absent:1:1')")
query("filter_include_non_tech", "SELECT id FROM postings WHERE NOT coalesce(is_confident_non_tech, FALSE)")(
    lambda b: flt.apply_filter(b.postings, {}, NOW).select("id")
)
_add("filter_combined", {"etype": "full-time", "posted_after": "1997-01-01", "max_years": 5, "exclude_company": "acme", "has_salary": True},
     f"{FULL_OR_NONE} AND posted_at LIKE '____-__-__%' AND posted_at >= '1997-01-01' AND (min_years IS NULL OR min_years <= 5)"
     " AND (company IS NULL OR NOT lower(company) LIKE '%acme%') AND min_salary_annual IS NOT NULL")


# The bound locations per country, read by eye from the binding: what a right gazetteer answers.
_GERMANY = "location IN ('Berlin, Germany', 'Germany', 'Munich, Germany, Germany')"
_GB = "location IN ('London, UK', 'Toronto, Canada; London, UK')"
query("filter_country", f"SELECT id FROM postings WHERE {_GERMANY}")(
    _kept({"country": "germany"}, prepare=lambda df: annotate_country(df))
)
query("filter_country_abbreviation", f"SELECT id FROM postings WHERE {_GB}")(
    _kept({"country": "UK"}, prepare=lambda df: annotate_country(df))
)
query("filter_country_unknown", "SELECT count(*) FILTER (WHERE FALSE) AS kept, count(*) AS rows FROM postings")(
    lambda b: annotate_country(b.postings).agg(
        F.count_if(flt.compile_filter({"country": "Atlantis", "include_non_tech": True}, flt.Capabilities(frozenset(["countries"])), NOW)).alias("kept"), F.count("*").alias("rows"))
)


# Places drawn from keys, with the country a reader gives each.
TOWNS = (
    ("Warsaw, Poland", "PL"), ("Kraków", "PL"), ("São Paulo, Brazil", "BR"), ("Milan", "IT"), ("Dubai, UAE", "AE"), ("Istanbul, Türkiye", "TR"), ("Mexico City", "MX"), ("Albuquerque, New Mexico", "US"), ("Cape Town, South Africa", "ZA"),
    ("Seoul, Republic of Korea", "KR"), ("Denver, CO", "US"), ("Bogotá, Colombia", "CO"), ("Atlanta, Georgia, USA", "US"), ("Tbilisi", "GE"), ("Paris, Texas, US", "US"), ("Vienna, VA", "US"), ("Vienna, Austria", "AT"),
)
_TOWN = "CASE CAST(split_part(id, ':', 3) AS BIGINT) % 17 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _) in enumerate(TOWNS)) + " END"
_TOWN_CODE = "CASE CAST(split_part(id, ':', 3) AS BIGINT) % 17 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(TOWNS)) + " END"


def _served(b):
    """The served table over varied locations, with stances by key."""
    from ..operators.clean import served_projection

    rows = annotate_region(annotate_country(b.postings.withColumn("location", F.expr(_TOWN))))
    stance = "CASE CAST(split_part(id, ':', 3) AS BIGINT) % 4 WHEN 0 THEN array('offers_sponsorship') WHEN 1 THEN array('may_offer_sponsorship') WHEN 2 THEN array('no_sponsorship') ELSE CAST(array() AS array<string>) END"
    return served_projection(rows.withColumn("stances", F.expr(stance)))


@query("filter_country_served", "SELECT code, count(*) AS n FROM (SELECT " + _TOWN_CODE + " AS code FROM postings) t WHERE code IN ('PL', 'BR', 'US', 'AE', 'AT', 'GE', 'MX') GROUP BY code")
def _country_served(b):
    served = _served(b)
    caps = flt.capabilities(served)
    asked = {"PL": "Poland", "BR": "brazil", "US": "usa", "AE": "UAE", "AT": "AT", "GE": "Georgia", "MX": "mexico"}
    hits = F.array(*[F.when(flt.compile_filter({"country": v, "include_non_tech": True}, caps, NOW, strict=True), F.lit(c)) for c, v in asked.items()])
    return served.select(F.explode(F.array_compact(hits)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("filter_work_authorization_served", "SELECT id FROM postings WHERE CAST(split_part(id, ':', 3) AS BIGINT) % 4 IN (0, 1)")
def _authorization_served(b):
    served = _served(b)
    return served.filter(flt.compile_filter({"work_authorization": "may_offer_sponsorship", "include_non_tech": True}, flt.capabilities(served), NOW)).select("id")


query("filter_india", "SELECT id FROM postings WHERE location IN ('Bengaluru, Karnataka, India', 'Bangalore')")(
    _kept({"india": "bengaluru"}, prepare=lambda df: annotate_region(df))
)


@query("filter_boards_table", """
    SELECT p.id FROM postings p JOIN boards b ON lower(p.board) = lower(b.board) WHERE b.operator = 'staffing'""")
def _boards_table(b):
    return flt.scope_boards(b.postings, b.boards.filter("operator = 'staffing'")).select("id")


@query("filter_account", """
    SELECT p.id FROM postings p JOIN boards b ON p.board = b.board WHERE b.operator = 'staffing' AND b.jobs % 2 = 0""")
def _account(b):
    return flt.account_scope(b.postings, b.boards.filter("operator = 'staffing'"), b.boards.filter("jobs % 2 = 1"), mine=True).select("id")


@query("filter_operators", """
    SELECT count(*) FILTER (WHERE b.operator IN ('employer', 'services')) AS kept,
           count(*) FILTER (WHERE b.operator NOT IN ('employer', 'services')) AS left_out
    FROM postings p LEFT JOIN boards b ON p.board = b.board""")
def _operators(b):
    return flt.operator_left_out(b.postings, b.boards, ["employer", "services"])


@query("filter_operators_rows", "SELECT p.id FROM postings p JOIN boards b ON p.board = b.board WHERE b.operator IN ('staffing')")
def _operators_rows(b):
    return flt.operator_scope(b.postings, b.boards, ["staffing"]).select("id")


ASSIGNED = "SELECT id, CASE WHEN department = 'BUILDING' THEN 'old-data' ELSE lower(department) END AS family FROM {postings}"


@query("filter_family", "SELECT id FROM postings WHERE department IN ('FURNITURE', 'BUILDING')")
def _family(b):
    return flt.family_scope(b.postings, b.sql(ASSIGNED), "furniture", {"old-data": "furniture"}).select("id")


@query("filter_ids_table", "SELECT id FROM prior")
def _ids_table(b):
    return flt.keep_ids(b.postings, b.prior).select("id")


@query("filter_role", "SELECT id FROM postings WHERE regexp_matches(title, '\\bjava\\b', 'i')")
def _role(b):
    from ..rules.derivations import WATCHLIST

    return flt.role_scope(b.postings, "watch:java", WATCHLIST).select("id")
