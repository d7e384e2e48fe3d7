"""Registered queries: file sources, web sources, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import sets
from ..session import scratch_path
from ..sources import files, web
from .board_queries import LEDGER
from .registry import query

CARRIED = [c.split(" ")[0] for c in S.POSTING.split(", ")]


def _landed(b, name, rows, by="ats"):
    """The rows written as one folder of compressed JSON Lines per source, each file named after its source."""
    path = scratch_path(b.spark, name)
    columns = [c for c in CARRIED if c in rows.columns]
    rows.select(*columns, F.col(by).alias("_dir")).write.partitionBy("_dir").json(path, compression="gzip")
    return path


@query("read_postings", "SELECT id, title, location, remote, description FROM postings")
def _read_postings(b):
    """Written as JSON Lines, twice the same rows to a file, and read back."""
    path = _landed(b, "postings", b.postings.unionByName(b.postings).repartition(F.col("id")))
    return files.read_postings(b.spark, path, "*.json.gz").select("id", "title", "location", "remote", "description")


@query("union_fragments", "SELECT id, title FROM prior UNION SELECT id, title FROM fresh")
def _fragments(b):
    one, two = (_landed(b, n, getattr(b, n).withColumn("ats", F.split("board", ":").getItem(0))) for n in ("prior", "fresh"))
    return files.union_fragments(b.spark, [one, two]).select("id", "title")


@query("assemble_feed", "SELECT ats, count(*) AS rows FROM postings GROUP BY 1")
def _feed(b):
    rows = b.postings.select("id", "ats", "title")
    return files.assemble_feed(rows.unionByName(rows))[1]


LEDGER_ROWS = f"SELECT split_part(board, ':', 1) AS ats, split_part(board, ':', 2) AS tenant, status, jobs, checked_at FROM ({LEDGER})"


@query("read_ledger", LEDGER_ROWS.format(customer="customer", nation="nation"))
def _ledger(b):
    path = scratch_path(b.spark, "liveness")
    b.sql(LEDGER_ROWS).select("ats", "tenant", F.lit("https://example.com/a,b").alias("url"), "status", "jobs", "checked_at").write.csv(path, header=True)
    absent = files.read_ledger(b.spark, path + "-absent", "liveness")
    return files.read_ledger(b.spark, path, "liveness").unionByName(absent).drop("url")


@query("read_ticks", """
    SELECT ts, board, metric, family, band, delta FROM ticks UNION ALL SELECT ts, 'old:', 'stock', family, band, CAST(sum(delta) AS BIGINT) FROM ticks WHERE metric = 'stock' GROUP BY 1, 4, 5""")
def _ticks(b):
    path, old = scratch_path(b.spark, "ticks"), scratch_path(b.spark, "archive")
    files.append_tick(b.ticks, path)
    b.ticks.filter("metric = 'stock'").groupBy("ts", "metric", "family", "band").agg(F.sum("delta").alias("delta")).withColumn("ats", F.lit("old")).write.parquet(old)
    return files.read_ticks(b.spark, path, old)


@query("write_snapshot", "SELECT id, title, min_salary_annual FROM fresh")
def _snapshot(b):
    """Written twice; the second replaces the first whole."""
    path = scratch_path(b.spark, "snapshot")
    files.write_snapshot(b.prior.select("id", "title", "min_salary_annual"), path)
    files.write_snapshot(b.fresh.select("id", "title", "min_salary_annual"), path)
    return files.read_snapshot(b.spark, path)


@query("overwrite_partitions", """
    SELECT id, title, split_part(board, ':', 1) AS ats FROM prior WHERE split_part(board, ':', 1) <> 'nation_3' UNION ALL SELECT id, title, split_part(board, ':', 1) FROM fresh WHERE split_part(board, ':', 1) = 'nation_3'""")
def _partitions(b):
    path = scratch_path(b.spark, "partitions")
    rows = lambda n: getattr(b, n).select("id", "title", F.split("board", ":").getItem(0).alias("ats"))
    files.overwrite_partitions(rows("prior"), path, ["ats"])
    files.overwrite_partitions(rows("fresh").filter("ats = 'nation_3'"), path, ["ats"])
    return b.spark.read.parquet(path).select("id", "title", "ats")


# Every third page holds a list, every third a graph; every seventh has a broken block before it.
def _jsonld_pages(b):
    node = F.struct(
        F.lit("JobPosting").alias("@type"), F.col("title"), F.col("description"), F.col("posted_at").alias("datePosted"), F.array(F.col("employment_type"), F.lit("OTHER")).alias("employmentType"),
        F.struct(F.lit("Organization").alias("@type"), F.col("company").alias("name")).alias("hiringOrganization"),
        F.array(F.struct(F.struct(F.split("location", ", ").getItem(0).alias("addressLocality"), F.split("location", ", ").getItem(0).alias("addressRegion")).alias("address"))).alias("jobLocation"),
    )
    n = F.element_at(F.split("id", ":"), -1).cast("bigint")
    body = F.when(n % 3 == 0, F.to_json(F.array(node))).when(n % 3 == 1, F.to_json(F.struct(F.array(node).alias("@graph")))).otherwise(F.to_json(node))
    broken = F.when(n % 7 == 0, F.lit('<script type="application/ld+json">{"@type": oops</script>')).otherwise(F.lit(""))
    html = F.concat(F.lit("<html><head>"), broken, F.lit("<script type='application/ld+json'>"), body, F.lit("</script></head></html>"))
    return b.postings.select(F.col("id").alias("page_id"), html.alias("html"))


@query("extract_jsonld_postings", """
    SELECT id AS page_id, title, description, posted_at, CASE WHEN employment_type IS NULL THEN 'OTHER' ELSE employment_type || ', OTHER' END AS employment_type, split_part(location, ', ', 1) AS location, company FROM postings""")
def _jsonld(b):
    return web.extract_jsonld_postings(_jsonld_pages(b)).select("page_id", "title", "description", "posted_at", "employment_type", "location", "company")


@query("jsonld_problems", "SELECT id AS page_id FROM postings WHERE CAST(split_part(id, ':', 3) AS BIGINT) % 7 = 0")
def _problems(b):
    return web.jsonld_problems(_jsonld_pages(b))


# One payload per posting, as a board with one opening answers.
def _payloads(b, items, wrap):
    return b.postings.select(F.element_at(F.split("board", ":"), -1).alias("slug"), F.lit("Acme").alias("company"), wrap(F.array(items)).alias("payload"))


@query("normalize_feed", """
    SELECT 'greenhouse:' || split_part(id, ':', 2) || ':' || split_part(id, ':', 3) AS id, title, url, location, department, coalesce(first_seen, posted_at) AS posted_at FROM postings""")
def _normalize(b):
    item = F.struct(F.element_at(F.split("id", ":"), -1).cast("bigint").alias("id"), F.col("title"), F.col("url").alias("absolute_url"), F.col("posted_at").alias("updated_at"), F.col("first_seen").alias("first_published"),
                    F.struct(F.col("location").alias("name")).alias("location"), F.array(F.struct(F.col("department").alias("name"))).alias("departments"))
    raw = _payloads(b, item, lambda items: F.to_json(F.struct(items.alias("jobs"))))
    return web.normalize_feed(raw, "greenhouse").select("id", "title", "url", "location", "department", "posted_at")


@query("normalize_feed_xml", "SELECT 'personio:' || split_part(id, ':', 2) || ':' || split_part(id, ':', 3) AS id, title, department FROM postings")
def _normalize_xml(b):
    item = F.concat(F.lit("<position><id>"), F.element_at(F.split("id", ":"), -1), F.lit("</id><name>"), F.col("title"), F.lit("</name><department>"), F.col("department"), F.lit("</department></position>"))
    raw = _payloads(b, item, lambda items: F.concat(F.lit("<root>"), F.array_join(items, ""), F.lit("</root>")))
    return web.normalize_feed(raw, "personio").select("id", "title", "department")


@query("normalize_feed_html", "SELECT 'listing_page:' || split_part(id, ':', 2) || ':' || split_part(id, ':', 3) AS id, title, url FROM postings")
def _normalize_html(b):
    item = F.concat(F.lit('<li class="job" data-id="'), F.element_at(F.split("id", ":"), -1), F.lit('"><a href="'), F.col("url"), F.lit('"><h3>'), F.col("title"), F.lit("</h3></a></li>"))
    raw = _payloads(b, item, lambda items: F.concat(F.lit("<ul>"), F.array_join(items, "\n"), F.lit("</ul>")))
    return web.normalize_feed(raw, "listing_page").select("id", "title", "url")


@query("mine_tenants", """
    WITH x AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://(?:www\\.|m\\.)?([a-z0-9-]+)\\.example\\.(com|org)', 1)) AS tenant, regexp_extract(url, '^https?://(?:www\\.|m\\.)?[a-z0-9-]+\\.example\\.(com|org)', 1) AS tld FROM pages)
    SELECT tld || '-sites' AS provider, tenant, arg_min(url, page_id) AS url FROM x WHERE tenant <> '' GROUP BY 1, 2""")
def _mine(b):
    specs = [(f"{tld}-sites", f"example.{tld}", rf"^https?://(?:www\.|m\.)?([a-z0-9-]+)\.example\.{tld}") for tld in ("com", "org")]
    return web.mine_tenants(b.pages.select("url", F.col("page_id").alias("ord")), specs)


@query("mine_host_graph", """
    SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, CASE WHEN contains(url, '.example.com') THEN 'com.example.' ELSE 'org.example.' END AS prefix
    FROM pages WHERE regexp_matches(url, '^https?://[^/?#]*\\.example\\.(com|org)([/?#]|$)')""")
def _graph(b):
    path = scratch_path(b.spark, "hosts")
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    b.pages.select(F.concat(F.col("page_id").cast("string"), F.lit("\t"), F.array_join(F.reverse(F.split(host, r"\.")), ".")).alias("value")).write.text(path, compression="gzip")
    return web.mine_host_graph(b.spark, path, ["com.example.", "org.example."])


# Each page given the links a careers page carries: one per provider, named after its own host.
LINKED = "SELECT page_id, html || '<a href=\"https://Jobs.lever.co/' || label || '/1\">x</a><a href=\"https://jobs.ashbyhq.com/' || upper(label) || '\">y</a><a href=\"https://boards.greenhouse.io/www\">z</a>' AS html, label FROM (SELECT page_id, html, split_part(split_part(url, '/', 3), '.', 1) AS label FROM {pages}) p"


@query("fingerprint_pages", f"""
    WITH l AS (SELECT page_id, label FROM ({LINKED.format(pages='pages')}))
    SELECT page_id, provider, token FROM (SELECT page_id, 'lever' AS provider, lower(label) AS token FROM l UNION SELECT page_id, 'ashby', upper(label) FROM l)
    WHERE length(token) BETWEEN 3 AND 60 AND lower(token) NOT IN ('www', 'api', 'embed', 'static', 'assets', 'cdn', 'help', 'support', 'about')""")
def _fingerprint(b):
    return web.fingerprint_pages(b.sql(LINKED))


HARVEST = "SELECT 'p' || CAST(c_nationkey % 4 AS STRING) AS provider, 'T' || CAST(c_custkey AS STRING) AS tenant, 'u' || CAST(c_custkey AS STRING) AS url FROM {customer} WHERE c_custkey % "


@query("merge_tenants", f"""
    WITH a AS ({HARVEST.format(customer='customer')} 3 <> 0), b AS ({HARVEST.format(customer='customer')} 2 = 0)
    SELECT coalesce(a.provider, b.provider) AS provider, lower(coalesce(a.tenant, b.tenant)) AS tenant, coalesce(b.url, a.url) AS url, CASE WHEN a.tenant IS NOT NULL AND b.tenant IS NOT NULL THEN 'both' WHEN a.tenant IS NOT NULL THEN 'cc' ELSE 'wayback' END AS source
    FROM a FULL JOIN b ON a.provider = b.provider AND a.tenant = b.tenant""")
def _merge_tenants(b):
    return sets.merge_tenants(b.sql(HARVEST + "3 <> 0"), b.sql(HARVEST + "2 = 0"))[0]


@query("merge_tenants_lost", f"WITH e AS ({HARVEST.format(customer='customer')} 5 = 0) SELECT provider, lower(tenant) AS tenant FROM e WHERE CAST(substring(tenant, 2) AS INT) % 3 = 0 AND CAST(substring(tenant, 2) AS INT) % 2 <> 0")
def _lost(b):
    return sets.merge_tenants(b.sql(HARVEST + "3 <> 0"), b.sql(HARVEST + "2 = 0"), b.sql(HARVEST + "5 = 0"), force=True)[1]


@query("fold_tenants", f"""
    WITH p AS (SELECT provider, lower(tenant) AS tenant, url FROM ({HARVEST.format(customer='customer')} 3 <> 0)), x AS (SELECT provider, lower(tenant) AS tenant, url FROM ({HARVEST.format(customer='customer')} 2 = 0))
    SELECT coalesce(p.provider, x.provider) AS provider, coalesce(p.tenant, x.tenant) AS tenant, coalesce(p.url, x.url) AS url, CASE WHEN p.tenant IS NULL THEN 'links' WHEN x.tenant IS NOT NULL THEN 'cc+links' ELSE 'cc' END AS source
    FROM p FULL JOIN x ON p.provider = x.provider AND p.tenant = x.tenant""")
def _fold(b):
    pool = b.sql(HARVEST + "3 <> 0").withColumn("tenant", F.lower("tenant")).withColumn("source", F.lit("cc"))
    return sets.fold_tenants(pool, b.sql(HARVEST + "2 = 0"), "links")


LISTS = "SELECT CASE c_custkey % 3 WHEN 0 THEN 'Green House' WHEN 1 THEN 'lever.co' ELSE 'Unknown' END AS provider, CASE WHEN c_custkey % 10 = 0 THEN '!bad' ELSE 'Slug' || CAST(c_custkey % 300 AS STRING) END AS slug, 'list' || CAST(c_custkey % 2 AS STRING) AS src FROM {customer}"


@query("consolidate_lists", f"""
    WITH l AS (SELECT CASE provider WHEN 'Green House' THEN 'greenhouse' WHEN 'lever.co' THEN 'lever' END AS provider, lower(slug) AS slug, src FROM ({LISTS.format(customer='customer')}) WHERE provider <> 'Unknown' AND slug <> '!bad')
    SELECT provider, slug, string_agg(DISTINCT src, '+' ORDER BY src) AS sources FROM l WHERE (provider, slug) NOT IN (SELECT 'lever', 'slug' || CAST(c_custkey AS STRING) FROM customer WHERE c_custkey < 200) GROUP BY 1, 2""")
def _consolidate(b):
    held = b.customer.filter("c_custkey < 200").select(F.lit("lever").alias("provider"), F.concat(F.lit("SLUG"), F.col("c_custkey").cast("string")).alias("slug"))
    return sets.consolidate_lists(b.sql(LISTS), {"greenhouse": "greenhouse", "leverco": "lever"}, held)


SEEDS = "SELECT CASE WHEN c_custkey % 6 = 0 THEN 'Virtusa' ELSE 'Corp' || CAST(c_custkey % 500 AS STRING) || ' Inc' END AS name, CASE WHEN c_custkey % 17 = 0 THEN 'nodomain' ELSE 'https://WWW.corp' || CAST(c_custkey % 500 AS STRING) || '.com/jobs?x=1' END AS domain, CAST(c_custkey % 3 AS INT) AS part, c_custkey AS place FROM {customer}"


@query("merge_seeds", f"""
    WITH s AS (SELECT *, 'corp' || CAST(place % 500 AS STRING) || '.com' AS d FROM ({SEEDS.format(customer='customer')}) WHERE domain <> 'nodomain' AND place % 500 <> 3 AND name <> 'Virtusa')
    SELECT name, d AS domain, part, place, place % 500 < 50 AS covered FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY part, place, name) AS n FROM s) WHERE n = 1""")
def _seeds(b):
    seeded = b.customer.limit(1).select(F.lit("corp3.com").alias("domain"))
    covered = b.customer.filter("c_custkey < 50").select(F.concat(F.lit("corp "), F.col("c_custkey").cast("string"), F.lit("-inc")).alias("name"))
    return sets.merge_seeds(b.sql(SEEDS), seeded, covered)[0]


RESOLVED = "SELECT 'd' || CAST(c_custkey AS STRING) AS domain, CASE WHEN c_custkey % {m} = 0 THEN NULL ELSE 'p{m}' END AS provider, CASE WHEN c_custkey % {m} = 0 THEN NULL ELSE CAST(c_custkey AS STRING) END AS token FROM {{customer}} WHERE c_custkey % {k} <> 0"


@query("merge_resolutions", f"""
    WITH m AS ({RESOLVED.format(m=4, k=7).format(customer='customer')}), v AS ({RESOLVED.format(m=3, k=5).format(customer='customer')})
    SELECT coalesce(m.domain, v.domain) AS domain, coalesce(m.provider, v.provider) AS provider, coalesce(m.token, v.token) AS token, m.provider IS NULL AND v.provider IS NOT NULL AS recovered FROM m FULL JOIN v ON m.domain = v.domain""")
def _resolutions(b):
    return sets.merge_resolutions(b.sql(RESOLVED.format(m=4, k=7)), b.sql(RESOLVED.format(m=3, k=5)))


@query("coverage_audit", f"SELECT provider, lower(tenant) AS tenant FROM ({HARVEST.format(customer='customer')} 2 = 0) WHERE CAST(substring(tenant, 2) AS INT) % 3 = 0")
def _audit(b):
    return sets.coverage_audit(b.sql(HARVEST + "2 = 0"), b.sql(HARVEST + "3 <> 0"))
