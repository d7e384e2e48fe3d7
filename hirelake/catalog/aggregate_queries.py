"""Registered queries: counts, ledgers and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordinal import group_row_number
from ..operators import aggregate as agg
from ..operators import filters as flt
from ..operators.annotate import annotate_country, annotate_experience, classify_domain
from ..operators.stances import annotate_stances
from ..session import cut_lineage
from .bindings import NOW
from .diff_queries import N
from .filter_queries import CONTRACT
from .registry import query

BAND = "CASE WHEN regexp_matches(title, '\\bintern(ship)?s?\\b', 'i') OR coalesce(regexp_matches(employment_type, '\\bintern(ship)?s?\\b', 'i'), FALSE) THEN 'intern' WHEN min_years IS NULL THEN 'unspecified' " \
       "WHEN min_years <= 1 THEN 'entry' WHEN min_years <= 4 THEN 'mid' WHEN min_years <= 7 THEN 'senior' ELSE 'staff' END"
PLACED = "SELECT *, CASE WHEN department = 'HOUSEHOLD' THEN NULL ELSE lower(department) END AS family FROM {postings}"


@query("annotate_band", f"SELECT id, {BAND} AS band FROM postings")
def _band(b):
    from ..operators.annotate import annotate_band

    return annotate_band(b.postings).select("id", "band")


@query("count_groups", f"""
    WITH p AS (SELECT *, {BAND} AS band, coalesce(first_seen >= '2001-01-01', FALSE) AS is_new FROM ({PLACED.format(postings='postings')})),
    w AS (SELECT board, ats, 'watch:java' AS family, band, is_new FROM p WHERE family IS NOT NULL AND regexp_matches(title, '\\bjava\\b', 'i')
          UNION ALL SELECT board, ats, 'watch:llm', band, is_new FROM p WHERE family IS NOT NULL AND regexp_matches(title, '\\b(llm|gen(erative)?[ -]?ai|ai)\\b', 'i')
          UNION ALL SELECT board, ats, 'watch:data-anything', band, is_new FROM p WHERE family IS NOT NULL AND regexp_matches(title, '\\bdata\\b', 'i')
          UNION ALL SELECT board, ats, family, band, is_new FROM p WHERE family IS NOT NULL)
    SELECT board, ats AS source, 'stock' AS metric, family, band, count(*) AS n FROM w GROUP BY ALL
    UNION ALL SELECT board, ats, 'new', family, band, count(*) FROM w WHERE is_new GROUP BY ALL
    UNION ALL SELECT board, ats, 'stock', 'non-tech', 'all', count(*) FROM p WHERE family IS NULL GROUP BY ALL""")
def _groups(b):
    return agg.count_groups(b.sql(PLACED), "2001-01-01")


@query("placements", f"SELECT id, board, family, {BAND} AS band, ats AS source FROM ({PLACED.format(postings='postings')}) WHERE family IS NOT NULL")
def _placements(b):
    return agg.placements(b.sql(PLACED))


@query("transitions", "SELECT p.employment_type AS \"from\", f.title AS \"to\", count(*) AS n FROM prior p JOIN fresh f ON p.id = f.id GROUP BY 1, 2")
def _transitions(b):
    prev = b.prior.select("id", F.col("employment_type").alias("k"))
    return agg.transitions(prev, b.fresh.select("id", F.col("title").alias("k")), "k")


@query("reposts", """
    WITH a AS (SELECT board, lower(title) AS t FROM fresh WHERE id NOT IN (SELECT id FROM prior)), g AS (SELECT board, lower(title) AS t FROM prior WHERE id NOT IN (SELECT id FROM fresh))
    SELECT count(*) AS reposts FROM a WHERE (board, t) IN (SELECT board, t FROM g)""")
def _reposts(b):
    return agg.reposts(b.fresh.join(b.prior, "id", "left_anti"), b.prior.join(b.fresh, "id", "left_anti"))


PLACES = "(VALUES ('Berlin, Germany', 'DE', 'Berlin'), ('Bengaluru, Karnataka, India', 'IN', 'Bengaluru'), ('Zürich, Switzerland', 'CH', 'Zürich'), ('New York, NY, United States', 'US', 'New York'), ('London, UK', 'GB', 'London'), " \
         "('Paris, France', 'FR', 'Paris'), ('Bangalore', 'IN', 'Bangalore'), ('Germany', 'DE', 'Germany'), ('Toronto, Canada; London, UK', 'CA', 'Toronto'), ('Toronto, Canada; London, UK', 'GB', 'Toronto, Canada; London, UK'), " \
         "('Munich, Germany, Germany', 'DE', 'Munich'), ('Tokyo, Japan', 'JP', 'Tokyo'), ('Hyderabad, Telangana', 'IN', 'Hyderabad'), ('Zurich', 'CH', 'Zurich')) v(location, country, city)"


@query("location_rollup", f"""
    WITH c AS (SELECT country, city, CASE city WHEN 'Bangalore' THEN 'Bengaluru' WHEN 'Zürich' THEN 'Zurich' ELSE city END AS k, count(*) AS n FROM postings JOIN {PLACES} USING (location) GROUP BY 1, 2, 3),
    t AS (SELECT country, CAST(sum(n) AS BIGINT) AS country_jobs FROM c GROUP BY 1),
    f AS (SELECT country, k, CAST(sum(n) AS BIGINT) AS jobs, arg_max(city, (n, -ord)) AS place FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY city) AS ord FROM c) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY jobs DESC, place) AS n FROM f)
    SELECT t.country, r.place, r.jobs, t.country_jobs FROM t JOIN r ON t.country = r.country AND r.n <= 3
    UNION ALL SELECT '', 'Remote', count(*), count(*) FROM postings WHERE location = 'Remote'
    UNION ALL SELECT NULL, NULL, NULL, count(*) FROM postings WHERE location IS NULL""")
def _rollup(b):
    return agg.location_rollup(b.postings)


@query("level_counts", f"""
    WITH c AS (SELECT {BAND} AS band, count(*) AS n FROM postings GROUP BY 1)
    SELECT place, v.band, coalesce(n, 0) AS n FROM (VALUES (0, 'intern'), (1, 'entry'), (2, 'mid'), (3, 'senior'), (4, 'staff'), (5, 'unspecified')) v(place, band) LEFT JOIN c ON v.band = c.band""")
def _levels(b):
    return agg.level_counts(b.postings)


@query("recent_count", "SELECT count(*) FILTER (WHERE first_seen >= '2001-07-03T00:00:00+00:00') AS recent, count(*) AS served FROM postings WHERE NOT coalesce(is_confident_non_tech, FALSE)")
def _recent(b):
    return agg.recent_count(b.postings, 720, NOW)


@query("dimension_values", """
    SELECT DISTINCT 'ats' AS dimension, ats AS value FROM postings UNION ALL SELECT DISTINCT 'currency', salary_currency FROM postings WHERE salary_currency IS NOT NULL
    UNION ALL SELECT DISTINCT 'accented', 'zürich' FROM postings WHERE location LIKE 'Zürich%'""")
def _dimensions(b):
    return agg.dimension_values(b.postings)


SAMPLED = "SELECT *, row_number() OVER (ORDER BY first_seen DESC NULLS LAST, id) AS ord FROM (SELECT id, board, company, title, remote, min_years, CASE WHEN " + N + " % 3 = 0 THEN 'seniority' WHEN " + N + " % 3 = 1 THEN 'field' ELSE 'regex' END AS experience_source, " \
          "min_salary_annual, max_salary_annual, salary_currency, first_seen FROM {postings} WHERE department = 'MACHINERY') category"


@query("requirement_summary", f"""
    WITH s AS ({SAMPLED.format(postings='postings')}), c AS (SELECT *, lower(coalesce(company, board)) AS k FROM s),
    q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS n FROM c), r AS (SELECT * FROM q WHERE n <= 2),
    m AS (SELECT salary_currency, CASE WHEN max_salary_annual IS NOT NULL THEN (min_salary_annual + max_salary_annual) / 2.0 ELSE min_salary_annual END AS mid FROM r WHERE min_salary_annual IS NOT NULL),
    p AS (SELECT salary_currency, count(*) AS n, quantile_cont(mid, 0.25) AS p25, quantile_cont(mid, 0.5) AS p50, quantile_cont(mid, 0.75) AS p75 FROM m GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5)
    SELECT 'experience' AS section, CASE WHEN min_years IS NULL THEN 'not_stated' WHEN experience_source <> 'seniority' THEN 'stated ' || CASE WHEN min_years <= 1 THEN '0-1' WHEN min_years <= 4 THEN '2-4' WHEN min_years <= 7 THEN '5-7' ELSE '8+' END ELSE 'estimated_from_title' END AS name,
           count(*) AS n, NULL AS extra FROM r GROUP BY 2
    UNION ALL SELECT 'salary', salary_currency, n, CAST(CAST(floor(p25 + 0.5) AS BIGINT) AS STRING) || '/' || CAST(CAST(floor(p50 + 0.5) AS BIGINT) AS STRING) || '/' || CAST(CAST(floor(p75 + 0.5) AS BIGINT) AS STRING) FROM p
    UNION ALL SELECT * FROM (SELECT 'company', k, count(*) AS n, CAST(least(count(*), 2) AS STRING) FROM q GROUP BY 2 ORDER BY n DESC, k LIMIT 10)
    UNION ALL SELECT 'remote', 'remote', count(*) FILTER (WHERE remote), NULL FROM r
    UNION ALL SELECT 'sample', 'counted', count(*), NULL FROM r""")
def _requirements(b):
    return agg.requirement_summary(b.sql(SAMPLED), per_company=2)


SCORES = "SELECT board, score / 100 AS score, CAST(jobs AS DOUBLE) AS last FROM {boards} WHERE jobs % 3 <> 0"
SEEN = "SELECT board, CAST(jobs % 7 AS DOUBLE) AS value FROM {boards} WHERE jobs % 2 = 0"


@query("ewma_ledger", f"""
    WITH p AS ({SCORES.format(boards='boards')}), s AS ({SEEN.format(boards='boards')}),
    j AS (SELECT coalesce(p.board, s.board) AS board, p.score, p.last, s.value FROM p FULL JOIN s ON p.board = s.board)
    SELECT board, round(CASE WHEN value IS NULL THEN score ELSE 0.7 * value + 0.3 * coalesce(score, 0) END, 6) AS score, coalesce(value, last) AS last
    FROM j WHERE value IS NULL OR 0.7 * value + 0.3 * coalesce(score, 0) >= 0.05""")
def _ewma(b):
    return agg.ewma_ledger(b.sql(SCORES), b.sql(SEEN)).withColumn("score", F.round("score", 6))


COSTS = "SELECT board, abs(score) AS seconds, CASE WHEN jobs % 9 = 0 THEN NULL WHEN jobs % 4 = 0 THEN 0 ELSE jobs END AS jobs, CASE WHEN jobs % 8 = 1 THEN 'unreadable' ELSE CAST(DATE '2001-07-10' + CAST(jobs AS INT) AS STRING) END AS updated_at FROM {boards} WHERE jobs % 5 <> 2"
MEASURED = "SELECT board, CAST(jobs % 13 AS DOUBLE) * 20 AS seconds, CAST(jobs + 3 AS INT) AS jobs, jobs % 6 = 1 AS unfinished, jobs % 10 = 3 AS errored FROM {boards} WHERE jobs % 2 = 1"


@query("cost_ledger", f"""
    WITH p AS ({COSTS.format(boards='boards')}), m AS (SELECT * FROM ({MEASURED.format(boards='boards')}) WHERE seconds > 0)
    SELECT coalesce(p.board, m.board) AS board, round(CASE WHEN m.board IS NULL THEN p.seconds WHEN m.unfinished THEN greatest(m.seconds, coalesce(p.seconds, m.seconds)) WHEN p.board IS NULL THEN m.seconds ELSE 0.5 * m.seconds + 0.5 * p.seconds END, 6) AS seconds,
           CASE WHEN m.board IS NULL OR m.unfinished OR m.errored THEN p.jobs ELSE m.jobs END AS jobs
    FROM p FULL JOIN m ON p.board = m.board""")
def _cost(b):
    return agg.cost_ledger(b.sql(COSTS).drop("updated_at"), b.sql(MEASURED)).withColumn("seconds", F.round("seconds", 6))


@query("expected_cost", f"""
    WITH p AS (SELECT * FROM ({COSTS.format(boards='boards')}) WHERE board NOT LIKE 'nation\\_3:%' ESCAPE '\\'), m AS (SELECT split_part(board, ':', 1) AS source, median(seconds) AS med FROM p GROUP BY 1)
    SELECT b.board, round(coalesce(p.seconds, m.med, (SELECT median(med) FROM m)), 6) AS seconds, CASE WHEN p.board IS NOT NULL THEN 'own' WHEN m.med IS NOT NULL THEN 'source' ELSE 'overall' END AS basis
    FROM boards b LEFT JOIN p ON b.board = p.board LEFT JOIN m ON b.ats = m.source""")
def _expected(b):
    ledger = b.sql(COSTS).filter("NOT startswith(board, 'nation_3:')")
    return agg.expected_cost(b.boards, ledger).withColumn("seconds", F.round("seconds", 6))


STRIKES = "SELECT board, CAST(10 + jobs AS INT) AS strikes, '404' AS reason, CASE WHEN jobs % 6 = 0 THEN 'never' ELSE CAST(DATE '2001-07-01' + CAST(jobs AS INT) AS STRING) || 'T00:00:00+00:00' END AS last_gone FROM {boards} WHERE jobs % 3 <> 1"


@query("strike_ledger", f"""
    WITH p AS ({STRIKES.format(boards='boards')}), g AS (SELECT board, '410' AS reason FROM boards WHERE jobs % 4 = 1), a AS (SELECT board FROM boards WHERE jobs % 7 = 0),
    j AS (SELECT coalesce(p.board, g.board) AS board, CASE WHEN g.board IS NOT NULL THEN coalesce(strikes, 0) + 1 ELSE strikes END AS strikes, coalesce(g.reason, p.reason) AS reason,
                 CASE WHEN g.board IS NOT NULL THEN '{NOW}' ELSE last_gone END AS last_gone FROM p FULL JOIN g ON p.board = g.board)
    SELECT board, strikes, reason, last_gone, strikes >= 20 AS quarantined,
           strikes >= 20 AND (try_cast(substring(last_gone, 1, 10) AS DATE) IS NULL OR date_diff('day', try_cast(substring(last_gone, 1, 10) AS DATE), DATE '2001-08-02') >= 7) AS paroled, strikes > 20 AS reconfirmed
    FROM j WHERE board NOT IN (SELECT board FROM a)""")
def _strikes(b):
    return agg.strike_ledger(b.sql(STRIKES), b.boards.filter("jobs % 4 = 1").select("board", F.lit("410").alias("reason")), b.boards.filter("jobs % 7 = 0"), NOW)


GAP = """
    SELECT p.board, count(*) AS n FROM postings p WHERE p.description IS NULL AND p.ats NOT IN ('nation_4') AND p.board IN (SELECT board FROM boards WHERE jobs % 5 <> 1)
      AND (p.board NOT IN (SELECT board FROM boards WHERE in_scope) OR p.id IN (SELECT id FROM fresh)) GROUP BY 1"""


def _gap(b):
    return agg.gap_counts(b.postings, b.postings.filter("description IS NOT NULL"), b.boards.filter("jobs % 5 <> 1"), b.boards.filter("in_scope"), b.fresh, disabled=("nation_4",))


@query("gap_counts", GAP)
def _gap_counts(b):
    return _gap(b)


@query("gap_drain", f"""
    WITH n AS ({GAP.format()}), p AS (SELECT board, CAST(jobs % 4 AS BIGINT) AS n FROM boards WHERE jobs % 4 > 0), j AS (SELECT coalesce(p.n, 0) AS a, coalesce(n.n, 0) AS b FROM p FULL JOIN n ON p.board = n.board)
    SELECT CAST(sum(a) AS BIGINT) AS was, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS left_gap, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS joined_gap, CAST(sum(b - a) AS BIGINT) AS net FROM j""")
def _drain(b):
    prior = b.boards.select("board", (F.col("jobs") % 4).cast("bigint").alias("n")).filter("n > 0")
    return agg.gap_drain(prior, _gap(b))


@query("dormant_boards", """
    WITH d AS (SELECT board, CASE WHEN posted_at LIKE '____-__-__%' AND substring(posted_at, 1, 10) >= '2000-01-01' AND ats <> 'nation_4' THEN substring(posted_at, 1, 10) END AS day
               FROM postings WHERE posted_at >= '2000-01-01' AND posted_at < '2001-01-01')
    SELECT board, max(day) AS newest FROM d WHERE board NOT IN (SELECT board FROM boards WHERE jobs % 7 = 3) GROUP BY board HAVING NOT bool_or(day IS NULL) AND max(day) < CAST(DATE '2002-08-02' - 730 AS STRING)""")
def _dormant(b):
    rows = b.postings.filter("posted_at >= '2000-01-01' AND posted_at < '2001-01-01'")
    return agg.dormant_boards(rows, "2002-08-02", b.boards.filter("jobs % 7 = 3"), partial_sources=("nation_4",))


HISTORY = "SELECT upper(board) AS board, CASE WHEN jobs % 4 = 0 THEN NULL ELSE '2001-07-' || CAST(10 + jobs % 20 AS STRING) || 'T00:00:00' END AS last_authoritative, CASE WHEN jobs % 3 = 0 THEN '2001-06-01T00:00:00' END AS excluded_since, CAST(CASE WHEN jobs % 3 = 0 THEN 2 ELSE 0 END AS INT) AS consecutive FROM {boards}"


@query("freshness", f"""
    WITH h AS (SELECT lower(board) AS board, last_authoritative, excluded_since, consecutive FROM ({HISTORY.format(boards='boards')})), r AS (SELECT board, jobs % 7 <> 3 AS f FROM boards WHERE in_scope),
    j AS (SELECT h.board, CASE WHEN r.f THEN '2001-08-02T00:00:00' ELSE last_authoritative END AS last_authoritative, CASE WHEN r.f THEN NULL WHEN NOT r.f THEN coalesce(excluded_since, '2001-08-02T00:00:00') ELSE excluded_since END AS excluded_since,
                 CAST(CASE WHEN r.f THEN 0 WHEN NOT r.f THEN consecutive + 1 ELSE consecutive END AS INT) AS consecutive, coalesce(NOT r.f, FALSE) AS short FROM h LEFT JOIN r ON h.board = r.board),
    i AS (SELECT p.board, count(*) AS n, count(*) FILTER (WHERE f.id IS NULL) AS missing FROM prior p LEFT JOIN fresh f ON p.id = f.id GROUP BY 1)
    SELECT j.board, last_authoritative, excluded_since, consecutive, round(date_diff('second', CAST(last_authoritative AS TIMESTAMP), TIMESTAMP '2001-08-02') / 86400.0, 2) AS age_days, coalesce(n, 0) AS protected_rows,
           CASE WHEN short THEN coalesce(missing, 0) END AS not_reseen_rows FROM j LEFT JOIN i ON j.board = i.board WHERE consecutive > 0""")
def _freshness(b):
    reads = b.boards.filter("in_scope").select("board", (F.col("jobs") % 7 != 3).alias("authoritative"))
    return agg.freshness(b.sql(HISTORY), reads, b.boards, b.prior.select("id", "board"), b.fresh, "2001-08-02T00:00:00")


@query("shape_percentiles", """
    WITH o AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT l_returnflag, round(max(v) FILTER (WHERE i = least(n - 1, floor(0.5 * n))), 1) AS p50, round(max(v) FILTER (WHERE i = least(n - 1, floor(0.9 * n))), 1) AS p90,
           round(max(v) FILTER (WHERE i = least(n - 1, floor(0.99 * n))), 1) AS p99, round(max(v), 1) AS "max" FROM o GROUP BY 1""")
def _shape(b):
    return agg.shape_percentiles(b.lineitem, "l_extendedprice", ["l_returnflag"])


ERRORS = "SELECT board, CASE jobs % 3 WHEN 0 THEN 'Timeout: slow' WHEN 1 THEN 'HTTP: 404' ELSE 'Parse: bad' END AS message FROM {boards} WHERE jobs % 4 = 0"


@query("error_summary", f"""
    WITH e AS (SELECT split_part(message, ':', 1) AS type, split_part(board, ':', 1) AS source FROM ({ERRORS.format(boards='boards')}))
    SELECT type, source, count(*) AS n, CAST(grouping_id(type, source) AS BIGINT) AS level FROM e GROUP BY ROLLUP (type, source)""")
def _errors(b):
    return agg.error_summary(b.sql(ERRORS))


@query("scrape_health", """
    WITH r AS (SELECT ats AS source, count(*) AS boards, count(*) FILTER (WHERE NOT in_scope AND jobs % 9 = 0) AS unusable FROM boards GROUP BY ROLLUP (ats))
    SELECT source, boards, unusable, round(unusable / boards, 6) AS share, CASE WHEN round(unusable / boards, 6) >= 0.1 THEN 'critical' WHEN round(unusable / boards, 6) >= 0.02 THEN 'degraded' ELSE 'healthy' END AS verdict FROM r""")
def _health(b):
    return agg.scrape_health(b.boards.select("board", F.when(~F.col("in_scope") & (F.col("jobs") % 9 == 0), "failed").otherwise("ok").alias("outcome")))


GATED = """
    SELECT c.board, CASE WHEN c.jobs = 0 THEN 0.0 ELSE coalesce(b.score, 0) / 300 / (c.seconds / 60) END AS per_minute, c.seconds FROM c LEFT JOIN boards b ON c.board = b.board
    WHERE c.seconds > CASE WHEN c.jobs = 0 THEN 120 ELSE 600 END AND try_cast(substring(updated_at, 1, 10) AS DATE) IS NOT NULL AND date_diff('day', try_cast(substring(updated_at, 1, 10) AS DATE), DATE '2001-08-02') < 14"""


@query("value_gate", f"""
    WITH c AS ({COSTS.format(boards='boards')}), g AS ({GATED}) SELECT board, round(per_minute, 6) AS per_minute FROM g WHERE per_minute < 0.2""")
def _gate(b):
    scores = b.boards.select("board", (F.col("score") / 300).alias("score"))
    return agg.value_gate(b.sql(COSTS), scores, "2001-08-02", floor=0.2).select("board", F.round("per_minute", 6).alias("per_minute"))


@query("gate_impact", f"""
    WITH c AS ({COSTS.format(boards='boards')}), g AS ({GATED}), a AS (SELECT * FROM g WHERE per_minute < 0.1), z AS (SELECT * FROM g WHERE per_minute < 0.2)
    SELECT CASE WHEN a.board IS NULL THEN 'newly_dropped' WHEN z.board IS NULL THEN 'released' ELSE 'still_dropped' END AS change, count(*) AS boards, round(sum(coalesce(z.seconds, a.seconds)) / 60, 4) AS minutes
    FROM a FULL JOIN z ON a.board = z.board GROUP BY 1""")
def _impact(b):
    scores = b.boards.select("board", (F.col("score") / 300).alias("score"))
    gate = lambda floor: agg.value_gate(b.sql(COSTS), scores, "2001-08-02", floor=floor)
    return agg.gate_impact(gate(0.1), gate(0.2))


TECH_TITLES = "title NOT IN ('Registered Nurse', 'Sales Manager - International', 'Warehouse Associate', 'Mechanical Engineer', 'Product Designer')"


@query("domain_filter_report", f"""
    SELECT ats AS source, count(*) AS total, count(*) FILTER (WHERE {TECH_TITLES} AND title <> 'Head of Data' AND board NOT IN (SELECT board FROM boards WHERE jobs % 6 = 0)) + count(*) FILTER (WHERE title = 'Head of Data' AND board NOT IN (SELECT board FROM boards WHERE jobs % 6 = 0)) AS kept,
           count(*) FILTER (WHERE {TECH_TITLES} AND board IN (SELECT board FROM boards WHERE jobs % 6 = 0)) AS dormant_skipped, FALSE AS empty FROM postings GROUP BY 1""")
def _domain_report(b):
    return agg.domain_filter_report(classify_domain(b.postings), b.boards.filter("jobs % 6 = 0"))


@query("extraction_coverage", f"""
    WITH s AS (SELECT ats, CASE {N} % 4 WHEN 0 THEN 'field' WHEN 1 THEN 'regex' WHEN 2 THEN 'seniority' END AS t FROM postings),
    r AS (SELECT ats AS source, count(*) AS rows, count(*) FILTER (WHERE t = 'field') AS field, count(*) FILTER (WHERE t = 'regex') AS regex, count(*) FILTER (WHERE t = 'seniority') AS seniority, count(*) FILTER (WHERE t IS NULL) AS "none" FROM s GROUP BY ROLLUP (ats))
    SELECT *, round(100 * (rows - "none") / rows, 4) AS coverage FROM r""")
def _coverage(b):
    tier = F.expr(f"CASE {N} % 4 WHEN 0 THEN 'field' WHEN 1 THEN 'regex' WHEN 2 THEN 'seniority' END")
    return agg.extraction_coverage(b.postings.withColumn("experience_source", tier))


@query("sample_misses", f"""
    SELECT id FROM postings WHERE ats = 'nation_2' AND {N} % 4 = 3 AND length(description) >= 80 ORDER BY md5('7:' || id), id LIMIT 8""")
def _misses(b):
    tier = F.expr(f"CASE {N} % 4 WHEN 0 THEN 'field' WHEN 1 THEN 'regex' WHEN 2 THEN 'seniority' END")
    return agg.sample_misses(b.postings.withColumn("experience_source", tier), "nation_2", 8, min_chars=80).select("id")


@query("location_health", """
    WITH c AS (SELECT ats, CASE WHEN location IS NULL THEN 'missing' WHEN location = 'Remote' THEN 'placeless' WHEN location = 'Germany' THEN 'country' ELSE 'place' END AS s FROM postings)
    SELECT ats AS source, count(*) FILTER (WHERE s = 'missing') AS missing, CAST(0 AS BIGINT) AS dirty, count(*) FILTER (WHERE s = 'placeless') AS placeless, count(*) FILTER (WHERE s = 'country') AS country_only, count(*) FILTER (WHERE s = 'place') AS place
    FROM c GROUP BY 1""")
def _location_health(b):
    return agg.location_health(b.postings, ("germany", "france", "india"))


@query("gazetteer_audit", """
    WITH c AS (SELECT location, count(*) AS n, CASE WHEN location = 'Remote' THEN 'none' WHEN location LIKE '%;%' THEN 'several' ELSE 'one' END AS countries FROM postings WHERE location IS NOT NULL GROUP BY 1)
    SELECT countries, count(*) AS locations, CAST(sum(n) AS BIGINT) AS rows FROM c GROUP BY 1""")
def _gazetteer(b):
    return agg.gazetteer_audit(annotate_country(b.postings))


INDIA_PLACES = "location IN ('Bengaluru, Karnataka, India', 'Bangalore', 'Hyderabad, Telangana')"


@query("yield_by_source", f"""
    WITH c AS (SELECT ats AS source, count(*) AS rows, count(*) FILTER (WHERE {TECH_TITLES}) AS tech, count(*) FILTER (WHERE {INDIA_PLACES}) AS region, count(*) FILTER (WHERE {TECH_TITLES} AND {INDIA_PLACES}) AS tech_and_region FROM postings GROUP BY 1)
    SELECT *, round(100 * tech / rows, 4) AS tech_pct, round(100 * region / rows, 4) AS region_pct FROM c""")
def _yield(b):
    return agg.yield_by_source(annotate_country(classify_domain(b.postings)))


FLAPS = "SELECT CAST(date_diff(day, DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS run, 'u' || CAST(user_id AS STRING) || ':' || event_type AS id, 'u' || CAST(user_id AS STRING) AS board, CASE event_id % 4 WHEN 0 THEN 'evict' WHEN 1 THEN 'prune duplicate' ELSE 'add' END AS kind FROM {events}"
FLAPS_ORACLE = FLAPS.replace("date_diff(day,", "date_diff('day',").format(events="events")


@query("flap_audit", f"""
    WITH e AS ({FLAPS_ORACLE}), p AS (SELECT id, run, bool_or(kind = 'add') AS a, bool_or(kind <> 'add') AS o FROM e GROUP BY 1, 2)
    SELECT run, count(*) FILTER (WHERE o) AS out, count(*) FILTER (WHERE o AND EXISTS (SELECT 1 FROM p n WHERE n.id = p.id AND n.run = p.run + 1 AND n.a)) AS readded_next,
           count(*) FILTER (WHERE o AND EXISTS (SELECT 1 FROM p n WHERE n.id = p.id AND n.run > p.run AND n.a)) AS readded_later, count(*) FILTER (WHERE a) AS adds,
           count(*) FILTER (WHERE a AND EXISTS (SELECT 1 FROM p n WHERE n.id = p.id AND n.run < p.run)) AS known_adds FROM p GROUP BY 1""")
def _flaps(b):
    return agg.flap_audit(b.sql(FLAPS))


@query("flaps_by_label", f"""
    WITH e AS ({FLAPS_ORACLE}), k AS (SELECT o.id, o.run, o.kind, row_number() OVER (PARTITION BY o.id ORDER BY o.run DESC, o.kind DESC) AS n FROM e o WHERE kind <> 'add' AND run < (SELECT max(run) FROM e a WHERE a.id = o.id AND a.kind = 'add'))
    SELECT kind, count(*) AS n FROM k WHERE n = 1 GROUP BY 1""")
def _flaps_label(b):
    return agg.flaps_by(b.sql(FLAPS), "kind")


EXCLUDED = "SELECT CAST(date_diff(day, DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS run, 'U' || CAST(user_id AS STRING) AS board, max(value) < 60 AS excluded FROM {events} GROUP BY 1, 2"


@query("exclusion_streaks", f"""
    WITH r AS (SELECT lower(board) AS board, run FROM ({EXCLUDED.replace("date_diff(day,", "date_diff('day',").format(events='events')}) WHERE excluded), i AS (SELECT *, run - row_number() OVER (PARTITION BY board ORDER BY run) AS g FROM r)
    SELECT board, min(run) AS first_run, max(run) AS last_run, count(*) AS runs FROM i GROUP BY board, g""")
def _streaks(b):
    return agg.exclusion_streaks(b.sql(EXCLUDED))


HOLDOUT = "SELECT id, CASE WHEN {n} % 3 = 0 THEN 'dropped' ELSE 'kept' END AS stratum, 1 + {n} % 4 AS rows, CASE {n} % 7 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'not_tech' WHEN 2 THEN 'not_tech' ELSE 'tech' END AS label, {n} % 5 <> 0 AS kept FROM {{postings}}".format(n=N)


@query("holdout_estimate", f"""
    WITH s AS ({HOLDOUT.format(postings='postings')}), z AS (SELECT stratum, sum(rows) AS t FROM s GROUP BY 1),
    w AS (SELECT s.*, rows * CASE s.stratum WHEN 'kept' THEN 400000.0 ELSE 157580.0 END / t AS w FROM s JOIN z ON s.stratum = z.stratum WHERE label <> 'ambiguous'),
    a AS (SELECT sum(w) FILTER (WHERE label = 'tech') AS tech, sum(w) FILTER (WHERE label = 'tech' AND kept) AS tp, sum(w) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE label = 'tech') AS n, count(*) FILTER (WHERE label = 'tech' AND kept) AS k FROM w),
    p AS (SELECT *, k / n AS p FROM a)
    SELECT round(tp / tech, 6) AS recall, round(tp / kept, 6) AS "precision", k, n, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS low,
           round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS high FROM p""")
def _holdout(b):
    return agg.holdout_estimate(b.sql(HOLDOUT), {"kept": 400_000, "dropped": 157_580})


@query("holdout_draw", f"""
    SELECT id, stratum FROM ({HOLDOUT.format(postings='postings')}) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || id), id) <= CASE stratum WHEN 'kept' THEN 300 ELSE 500 END""")
def _draw(b):
    return agg.holdout_draw(b.sql(HOLDOUT), {"kept": 300, "dropped": 500}).select("id", "stratum")


@query("vote_names", """
    WITH c AS (SELECT ats AS board, company, count(*) AS n FROM postings WHERE company IS NOT NULL GROUP BY 1, 2), t AS (SELECT board, CAST(sum(n) AS BIGINT) AS stating FROM c GROUP BY 1)
    SELECT c.board, company AS name, n AS votes, stating FROM c JOIN t ON c.board = t.board WHERE n >= stating * 0.03 QUALIFY row_number() OVER (PARTITION BY c.board ORDER BY n DESC, company) = 1""")
def _votes(b):
    return agg.vote_names(b.postings.select(F.col("ats").alias("board"), "company"), share=0.03)


@query("verify_filters", f"""
    SELECT f AS filter, k AS kept, CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS missed FROM (
      SELECT 'max_years' AS f, count(*) FILTER (WHERE min_years IS NULL OR min_years <= 5) AS k FROM postings UNION ALL SELECT 'etype', count(*) FILTER (WHERE {CONTRACT}) FROM postings
      UNION ALL SELECT 'posted_within', count(*) FILTER (WHERE posted_at LIKE '____-__-__%' AND posted_at >= '2001-05-04') FROM postings UNION ALL SELECT 'has_salary', count(min_salary_annual) FROM postings)""")
def _verify(b):
    df = b.postings
    caps = flt.capabilities(df)
    compiled = {}
    for filters in ({"max_years": 5}, {"etype": "contract"}, {"posted_within": 90}, {"has_salary": True}):
        clauses = flt.filter_clauses({"include_non_tech": True, **filters}, caps, NOW)
        compiled.update(clauses)
    raw = F.lower(F.coalesce("employment_type", F.lit("")))
    independent = {
        "max_years": ~(F.coalesce("min_years", F.lit(0)) > 5), "etype": raw.rlike("contract|freelance|fixed|temporary"),
        "posted_within": F.substring("posted_at", 1, 10).try_cast("date") >= F.lit("2001-05-04").cast("date"), "has_salary": F.coalesce("min_salary_annual", F.lit(-1)) >= 0,
    }
    return agg.verify_filters(df, {k: (compiled[k], independent[k]) for k in independent})


@query("requirements", None)
def _requirements_full(b):
    """All rows of a category with countries, stances and skills, one row a requisition."""
    from ..operators.boards import requisition_groups
    from .annotate_queries import vocabulary

    # The places of SAMPLED, numbered without one task for all rows; the annotated rows are read twice.
    category = b.postings.filter("department = 'MACHINERY'")
    sample = group_row_number(category.select("id", "first_seen"), [], [F.desc_nulls_last("first_seen"), F.asc("id")], "ord").select("id", "ord")
    rows = cut_lineage(annotate_stances(annotate_experience(annotate_country(b.postings.join(sample, "id").drop("min_years")))))
    led = requisition_groups(rows).withColumnRenamed("leader", "requisition_leader")
    return agg.requirement_summary(rows.join(led, "id"), vocabulary(b.spark), per_company=3)
