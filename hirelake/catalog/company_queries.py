"""Registered queries: searches and company pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import search as srch
from ..plans import ticks as T
from ..plans import trends as P
from .aggregate_queries import BAND, PLACES
from .bindings import NOW
from .filter_queries import CURRENCIES
from .registry import query
from .search_queries import SIMILAR, _query_vector

# Postings given the vector and label of one document each.
VECTORED = "SELECT p.*, v.vector, v.label FROM {postings} p CROSS JOIN (SELECT count(*) AS n FROM {vectors}) c JOIN {vectors} v ON CAST(split_part(p.id, ':', 3) AS BIGINT) % c.n = v.vec_id"


@query("search", """
    SELECT id, title, first_seen, salary_currency FROM postings WHERE NOT coalesce(is_confident_non_tech, FALSE) AND remote AND posted_at LIKE '____-__-__%' AND posted_at >= '1998-01-01'
    ORDER BY first_seen DESC NULLS LAST, id LIMIT 50 OFFSET 50""")
def _search(b):
    return srch.search(b.postings, {"remote": True, "posted_after": "1998-01-01"}, NOW, k=50, page=2).select("id", "title", "first_seen", "salary_currency")


@query("search_ranked", f"""
    WITH {SIMILAR}, x AS (SELECT p.id, s.sim FROM postings p JOIN vectors v ON CAST(split_part(p.id, ':', 3) AS BIGINT) % (SELECT count(*) FROM vectors) = v.vec_id JOIN s ON s.id = v.id WHERE NOT coalesce(is_confident_non_tech, FALSE) AND (min_years IS NULL OR min_years <= 2))
    SELECT id, round(sim, 3) AS score FROM x ORDER BY round(sim, 9) DESC, id LIMIT 40""")
def _ranked(b):
    return srch.search(b.sql(VECTORED), {"max_years": 2}, NOW, query=_query_vector(b), k=40).select("id", "score")


@query("search_salary", """
    SELECT id, min_salary_annual, salary_currency FROM postings WHERE NOT coalesce(is_confident_non_tech, FALSE) AND min_salary_annual IS NOT NULL
    ORDER BY CASE WHEN salary_currency = 'INR' THEN 0 ELSE 1 END, salary_currency NULLS LAST, min_salary_annual DESC NULLS LAST, id LIMIT 25""")
def _salary(b):
    return srch.search(b.postings, {"has_salary": True, "salary_currency": "INR"}, NOW, sort="salary", k=25, currencies=CURRENCIES).select("id", "min_salary_annual", "salary_currency")


@query("job", """
    WITH a AS (SELECT CAST(split_part(id, ':', 3) AS BIGINT) AS position, id FROM prior)
    SELECT position, a.id, f.title, f.id IS NOT NULL AS found FROM a LEFT JOIN fresh f ON a.id = f.id""")
def _job(b):
    asked = b.sql("SELECT CAST(split_part(id, ':', 3) AS BIGINT) AS position, id FROM {prior}")
    return srch.job(b.fresh, asked).select("position", "id", "title", "found")


COMPANY = "(SELECT * FROM postings WHERE NOT coalesce(is_confident_non_tech, FALSE) AND board IN (SELECT board FROM boards WHERE ats IN ('nation_2', 'nation_7')))"


def _boards(b):
    return b.boards.filter("ats IN ('nation_2', 'nation_7')")


@query("company_locations", f"""
    WITH c AS (SELECT country, count(*) AS country_jobs FROM {COMPANY} JOIN (SELECT DISTINCT location, country FROM {PLACES}) USING (location) GROUP BY 1)
    SELECT country, CAST(country_jobs AS BIGINT) AS country_jobs FROM c""")
def _locations(b):
    return srch.company_locations(b.postings, _boards(b)).filter("country <> ''").select("country", "country_jobs").distinct()


@query("company_levels", f"""
    WITH c AS (SELECT {BAND} AS band, count(*) AS n FROM {COMPANY} GROUP BY 1)
    SELECT place, v.band, coalesce(n, 0) AS n FROM (VALUES (0, 'intern'), (1, 'entry'), (2, 'mid'), (3, 'senior'), (4, 'staff'), (5, 'unspecified')) v(place, band) LEFT JOIN c ON v.band = c.band""")
def _levels(b):
    return srch.company_levels(b.postings, _boards(b))


DIRECTORY = "SELECT company AS company, board, replace(company, 'company', 'Firm') AS name, CAST(length(board) AS BIGINT) AS openings FROM {directory}"


@query("company_suggest", """
    SELECT replace(company, 'company', 'Firm') AS name, company, CASE company WHEN 'company 2' THEN 0 ELSE 1 END AS tier, CAST(sum(length(board)) AS BIGINT) AS openings FROM directory
    WHERE company = 'company 2' OR company LIKE 'company 2_' GROUP BY company ORDER BY tier, openings DESC, name LIMIT 10""")
def _suggest(b):
    per = b.sql(DIRECTORY).groupBy("company", "name").agg(F.sum("openings").alias("openings"))
    return srch.company_suggest(per, "firm 2").select("name", "company", "tier", "openings")


@query("company_lookup", """
    SELECT p.id, p.board AS owner, b.company FROM postings p JOIN boards b ON p.board = b.board
    UNION ALL SELECT upper(board), upper(board), company FROM boards""")
def _lookup(b):
    ids = b.postings.select("id").unionByName(b.boards.select(F.upper("board").alias("id")))
    return srch.company_lookup(ids, b.boards)


@query("find_company", "SELECT 'Firm 7' AS name, 'company 7' AS company, -1 AS tier, 'board key' AS match, CAST(2 AS BIGINT) AS openings FROM directory WHERE board = 'b7'")
def _find(b):
    return srch.find_company(b.sql(DIRECTORY), "B7")


@query("company_profile", f"""
    WITH p AS (SELECT p.*, b.company AS c, {BAND} AS band FROM postings p JOIN (SELECT board, ats AS company FROM boards WHERE ats IN ('nation_2', 'nation_7')) b ON p.board = b.board)
    SELECT c AS company, 'total' AS section, 'postings' AS name, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT c, 'total', 'non-tech', count(*) FROM p WHERE is_confident_non_tech GROUP BY 1
    UNION ALL SELECT c, 'remote', 'remote', count(*) FROM p WHERE remote GROUP BY 1 UNION ALL SELECT c, 'level', band, count(*) FROM p GROUP BY 1, 3 UNION ALL SELECT c, 'category', department, count(*) FROM p GROUP BY 1, 3
    UNION ALL SELECT c, 'older than a year', department, count(*) FROM p WHERE posted_at LIKE '____-__-__%' AND posted_at < '2000-08-02' GROUP BY 1, 3""")
def _profile(b):
    directory = b.boards.select("board", F.col("ats").alias("company"))
    return srch.company_profile(b.postings, directory, ["nation_2", "nation_7"], "2001-08-02").filter("section <> 'type'")


@query("hiring_now")
def _hiring_now(b):
    week = T.trailing_week(b.ticks).first()
    return srch.hiring_now(P.hot_candidates(b.ticks, b.methods, b.directory, week["base"]), "expansion")
