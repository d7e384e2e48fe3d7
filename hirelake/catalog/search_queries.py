"""Registered queries: facets, browse orders and vector ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as fct
from ..operators import rank
from ..rules.filters import EMPLOYMENT_TYPES, EXPERIENCE_CEILINGS, FX_RATES, POSTED_DAYS, SEEN_HOURS
from .bindings import NOW
from .filter_queries import ASSIGNED, CONTRACT, FULL_OR_NONE, INTERN, PART
from .registry import query

FACET_FILTERS = {"etype": "full-time", "posted_after": "1999-01-01", "max_years": 5}
FACET_ATS = ("nation_1", "nation_2", "nation_19")


def _facet_oracle():
    """Each option counted on its own, the way a search engine without one-pass facets would."""
    types = {"full-time": FULL_OR_NONE, "part-time": PART, "contract": CONTRACT, "internship": INTERN}
    from datetime import datetime, timedelta

    now = datetime.fromisoformat(NOW)
    own = {"etype": FULL_OR_NONE, "max_years": "(min_years IS NULL OR min_years <= 5)"}
    fixed = "NOT coalesce(is_confident_non_tech, FALSE) AND posted_at LIKE '____-__-__%' AND posted_at >= '1999-01-01'"
    options = [("seen_within", str(h), f"first_seen >= '{(now - timedelta(hours=h)).isoformat(timespec='seconds')}'") for h in SEEN_HOURS]
    options += [("posted_within", str(d), f"posted_at >= '{(now - timedelta(days=d)).strftime('%Y-%m-%d')}'") for d in POSTED_DAYS]
    options += [("max_years", str(n), f"(min_years IS NULL OR min_years <= {n})") for n in EXPERIENCE_CEILINGS]
    options += [("etype", t, types[t]) for t in EMPLOYMENT_TYPES]
    options += [("remote", "True", "remote"), ("has_salary", "True", "min_salary_annual IS NOT NULL")]
    options += [("ats", a, f"ats = '{a}'") for a in FACET_ATS]
    options += [(d, "Any", "TRUE") for d in ("ats", "etype", "max_years", "posted_within", "seen_within")]
    options += [("total", "", "TRUE")]
    selects = []
    for dimension, value, clause in options:
        kept = " AND ".join([fixed, *[c for d, c in own.items() if d != dimension], clause])
        selects.append(f"SELECT '{dimension}' AS dimension, '{value}' AS value, count(*) AS n FROM postings WHERE {kept}")
    return "\nUNION ALL ".join(selects)


@query("facets", _facet_oracle())
def _facets(b):
    return fct.facet_counts(b.postings, FACET_FILTERS, NOW, ats=FACET_ATS)


@query("blocking_filter", """
    SELECT CAST(0 AS BIGINT) AS total, 'ats' AS blocking, count(*) AS recovers FROM postings
    WHERE NOT coalesce(is_confident_non_tech, FALSE) AND remote AND min_years >= 6 AND company IS NOT NULL
      AND lower(company) LIKE '%acme%' AND FALSE IS NOT TRUE""")
def _blocking(b):
    # No bound posting sits on this source name with more than a handful of rows kept otherwise.
    return fct.blocking_filter(
        b.postings, {"remote": True, "ats": "nowhere", "company": "acme", "required_years_at_least": 6}, NOW, ats=("nowhere",)
    )


@query("text_coverage", """
    SELECT count(description) AS covered, count(*) AS total FROM postings
    WHERE NOT coalesce(is_confident_non_tech, FALSE) AND remote""")
def _text_coverage(b):
    return fct.text_coverage(b.postings, {"remote": True, "kw": "java", "kw_in": "description"}, NOW)


BROWSE = ["id", "title", "first_seen", "posted_at", "min_salary_annual", "salary_currency"]


@query("browse", f"SELECT {', '.join(BROWSE)} FROM postings ORDER BY first_seen DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def _browse(b):
    return rank.browse(b.postings.select(*BROWSE), k=20, page=3)


@query("browse_posted", f"SELECT {', '.join(BROWSE)} FROM postings WHERE posted_at LIKE '____-__-__%' ORDER BY posted_at DESC NULLS LAST, id LIMIT 1000")
def _browse_posted(b):
    return rank.browse(b.postings.select(*BROWSE), where=F.col("posted_at").rlike(r"^.{4}-.{2}-.{2}"), sort="posted", k=1000)


@query("salary_browse", f"""
    SELECT {', '.join(BROWSE)} FROM postings
    ORDER BY CASE WHEN salary_currency = 'EUR' THEN 0 ELSE 1 END, salary_currency NULLS LAST, min_salary_annual DESC NULLS LAST, id
    LIMIT 100 OFFSET 100""")
def _salary_browse(b):
    return rank.salary_browse(b.postings.select(*BROWSE), "EUR", k=100, page=2)


# The query vector is row 7's own; similarity is compared as shown, rounded.
SIMILAR = """
    s AS (SELECT a.id, a.ats, a.company, a.label, list_dot_product(a.vector::DOUBLE[], q.vector::DOUBLE[])
                 / (sqrt(list_dot_product(a.vector::DOUBLE[], a.vector::DOUBLE[])) * sqrt(list_dot_product(q.vector::DOUBLE[], q.vector::DOUBLE[]))) AS sim
          FROM vectors a, (SELECT vector FROM vectors WHERE vec_id = 7) q)"""


def _query_vector(b):
    """The stored vector of one row: an argument a caller would pass as numbers."""
    return b.vectors.filter("vec_id = 7").first()["vector"]


@query("vector_topk", f"WITH {SIMILAR} SELECT id, label, round(sim, 3) AS score FROM s WHERE label <> 3 ORDER BY sim DESC, id LIMIT 10 OFFSET 10")
def _vector_topk(b):
    return rank.vector_topk(b.vectors, _query_vector(b), where=F.col("label") != 3, k=10, page=2).select("id", "label", "score")


@query("more_like", f"WITH {SIMILAR} SELECT id, round(sim, 3) AS score FROM s WHERE id <> 'src7:7' ORDER BY sim DESC, id LIMIT 15")
def _more_like(b):
    return rank.more_like(b.vectors, "src7:7", k=15).select("id", "score")


@query("sort_within_relevance", f"""
    WITH {SIMILAR}
    SELECT id, label, round(sim, 3) AS score FROM s WHERE round(sim, 3) >= 0.1 ORDER BY label DESC NULLS LAST, id DESC LIMIT 30""")
def _sort_within(b):
    return rank.sort_within_relevance(b.vectors, _query_vector(b), "label", floor=0.1, k=30).select("id", "label", "score")


@query("vector_topk_approx")
def _approx(b):
    return rank.vector_topk_approx(b.vectors, _query_vector(b), k=10).select("id", "score")


@query("vector_recall")
def _recall(b):
    q = _query_vector(b)
    return rank.recall_at_k(rank.vector_topk(b.vectors, q, k=10), rank.vector_topk_approx(b.vectors, q, k=10), 10)


@query("spread_companies", f"""
    WITH {SIMILAR}, r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM s),
    p AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY rank) AS place FROM r),
    f AS (SELECT *, min(place) OVER (PARTITION BY company, label) > 2 AS past_company_cap FROM p)
    SELECT id, company, rank, past_company_cap,
           CAST(CASE WHEN past_company_cap THEN 0 ELSE sum(CASE WHEN past_company_cap THEN 1 ELSE 0 END) OVER (PARTITION BY company) END AS BIGINT) AS more_from_company
    FROM f""")
def _spread(b):
    rows = rank.scored(b.vectors, _query_vector(b)).drop("vector").withColumn("posting", F.col("label"))
    out = rank.spread_companies(rows, 2, [F.desc("similarity"), F.asc("id")])
    return out.select("id", "company", "rank", "past_company_cap", "more_from_company")


ALERTS = """
    SELECT id, first_seen, CAST(min_salary_annual % 1000 AS INT) AS score, department AS subscription,
           CASE department WHEN 'FURNITURE' THEN '2001-05-01' ELSE '2000-11-15T06:30:00+00:00' END AS watermark
    FROM {postings} WHERE min_salary_annual IS NOT NULL"""


@query("alert_shortlist", f"""
    WITH h AS ({ALERTS.format(postings='postings')})
    SELECT subscription, id, score, row_number() OVER (PARTITION BY subscription ORDER BY score DESC, id) AS place
    FROM h WHERE first_seen > watermark QUALIFY place <= 30""")
def _alerts(b):
    return rank.alert_shortlist(b.sql(ALERTS)).select("subscription", "id", "score", "place")


@query("newest_in_family", """
    SELECT id, first_seen FROM postings WHERE department = 'MACHINERY' ORDER BY first_seen DESC NULLS LAST, id""")
def _newest(b):
    return rank.newest_in_family(b.postings, b.sql(ASSIGNED), "machinery").select("id", "first_seen")


@query("closest_in_family", f"""
    WITH {SIMILAR}
    SELECT id, round(sim, 3) AS score FROM s WHERE label = 4 ORDER BY sim DESC, id LIMIT 5""")
def _closest_family(b):
    members = b.vectors.select("id", F.col("label").cast("string").alias("family"))
    return rank.closest_in_family(b.vectors, members, "4", _query_vector(b), n=5).select("id", "score")


MISSING = "SELECT board || ':' || split_part(id, ':', 3) || '9' AS id FROM {postings}"


@query("closest_ids", f"""
    WITH m AS (SELECT DISTINCT id AS asked FROM ({MISSING.format(postings='postings')})),
    c AS (SELECT m.asked, p.id, p.title, round(1.0 - levenshtein(split_part(m.asked, ':', 3), split_part(p.id, ':', 3))
                 / greatest(length(split_part(m.asked, ':', 3)), length(split_part(p.id, ':', 3)))::DOUBLE, 6) AS ratio
          FROM m JOIN postings p ON split_part(m.asked, ':', 1) || ':' || split_part(m.asked, ':', 2) = p.board AND p.id <> m.asked)
    SELECT asked, id, title, ratio FROM c WHERE ratio >= 0.6 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY ratio DESC, id) = 1""")
def _closest_ids(b):
    return rank.closest_ids(b.postings, b.sql(MISSING), cutoff=0.6)


SLICE = """
    SELECT board, CASE WHEN jobs % 4 = 0 THEN NULL ELSE score END AS score, CAST(jobs AS BIGINT) AS unsettled,
           CASE WHEN jobs % 5 = 0 THEN NULL ELSE '2001-01-' || CAST(10 + jobs % 20 AS STRING) END AS last_look
    FROM {boards}"""


@query("pick_slice", f"""
    WITH x AS (SELECT *, md5('0:' || board) AS tie FROM ({SLICE.format(boards='boards')})),
    head AS (SELECT board, 'head' AS seat FROM x WHERE score > 0 ORDER BY score DESC, tie, board LIMIT 70),
    gap AS (SELECT board, 'gap' AS seat FROM x WHERE board NOT IN (SELECT board FROM head) AND unsettled > 0 ORDER BY unsettled DESC, tie, board LIMIT 2),
    tail AS (SELECT board, 'tail' AS seat FROM x WHERE board NOT IN (SELECT board FROM head) AND board NOT IN (SELECT board FROM gap)
             ORDER BY last_look ASC NULLS FIRST, tie, board LIMIT 28)
    SELECT * FROM head UNION ALL SELECT * FROM gap UNION ALL SELECT * FROM tail""")
def _slice(b):
    return rank.pick_slice(b.sql(SLICE), 100)


@query("round_robin", """
    SELECT id, source, turn FROM (SELECT id, ats AS source, row_number() OVER (PARTITION BY ats ORDER BY min_salary_annual DESC NULLS LAST, id) AS turn FROM postings)
    ORDER BY turn, source LIMIT 500""")
def _round_robin(b):
    edits = b.postings.select("id", F.col("ats").alias("source"), F.col("min_salary_annual").alias("score"))
    return rank.round_robin(edits, 500).select("id", "source", "turn")


@query("convert_currency", """
    SELECT id, round(CASE salary_currency WHEN 'EUR' THEN min_salary_annual::DOUBLE WHEN 'USD' THEN min_salary_annual::DOUBLE / 1.0 * 0.8611
           WHEN 'INR' THEN min_salary_annual::DOUBLE / 94.55 * 0.8611 END, 4) AS converted FROM postings""")
def _convert(b):
    amount = rank.convert(F.col("min_salary_annual"), F.col("salary_currency"), "EUR", FX_RATES)
    return b.postings.select("id", F.round(amount, 4).alias("converted"))
