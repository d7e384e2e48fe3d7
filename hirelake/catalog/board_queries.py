"""Registered queries: board ledgers, copies across boards, companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boards as brd
from ..operators.annotate import annotate_country, classify_operator, company_operator, settle_company
from ..operators.clean import company_words
from .registry import query

# Rows of one tenant's sites: supplier s lists part p as its requisition on site `s % 3`.
SITES = """
    SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'eightfold' ELSE 'workday' END AS source, 't' || CAST(s_nationkey AS STRING) AS tenant,
           CASE WHEN s_suppkey % 4 = 0 THEN 'eightfold:t' || CAST(s_nationkey AS STRING)
                ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'workday:T' ELSE 'workday:t' END || CAST(s_nationkey AS STRING) || '/' || CASE s_suppkey % 3 WHEN 0 THEN 'hidden' WHEN 1 THEN 'site' ELSE 'careers' END END AS board,
           CAST(l_partkey % 60 AS STRING) AS native, 'R' || CAST(l_partkey % 60 AS STRING) AS requisition
    FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4, 5"""
SITE_ROWS = f"SELECT *, board || ':' || native AS id FROM ({SITES}) s"
KEEP = f"SELECT min(board) AS board, CAST(count(*) AS BIGINT) AS jobs FROM ({SITES}) s WHERE board NOT LIKE '%9/%' GROUP BY lower(board)"

JUDGED = f"""
    r AS ({SITE_ROWS.format(lineitem='lineitem', supplier='supplier')}), k AS ({KEEP.format(lineitem='lineitem', supplier='supplier')}),
    x AS (SELECT r.*, k.board AS live, k.jobs, CASE WHEN source = 'workday' THEN 'workday:' || lower(tenant) ELSE lower(r.board) END || chr(31) || native AS own
          FROM r JOIN k ON lower(r.board) = lower(k.board)),
    f AS (SELECT id, min(w.own) AS grp FROM (SELECT * FROM x WHERE source = 'eightfold') e JOIN (SELECT own, tenant, native FROM x WHERE source = 'workday') w USING (tenant, native) GROUP BY id),
    y AS (SELECT x.*, coalesce(f.grp, x.own) AS grp, f.grp IS NOT NULL AS copied FROM x LEFT JOIN f ON x.id = f.id),
    e AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY source = 'eightfold', board LIKE '%hidden%', -jobs, lower(board), board <> live, id) AS n,
                 first_value(lower(board)) OVER (PARTITION BY grp ORDER BY source = 'eightfold', board LIKE '%hidden%', -jobs, lower(board), board <> live, id) AS winner FROM y)"""


def _site_rows(b):
    return b.sql(SITE_ROWS)


def _pairs(b):
    fronts = b.sql(SITES).filter("source = 'eightfold'").select("tenant", F.col("board").alias("front")).distinct()
    backs = b.sql(SITES).filter("source = 'workday'").select("tenant", F.col("board").alias("backing")).distinct()
    return fronts.join(backs, "tenant").select("front", "backing")


def _grouped(b):
    """Rows on kept boards, with their copy group."""
    kept = b.sql(KEEP).select(F.lower("board").alias("_k"), "jobs")
    rows = _site_rows(b)
    rows = rows.join(kept, F.lower(rows["board"]) == F.col("_k")).drop("_k")
    return rows.withColumn("group", brd.copy_group(F.col("source"), F.col("tenant"), F.col("board"), F.col("native")))


@query("backing_copies", f"WITH {JUDGED} SELECT id, grp AS \"group\" FROM f")
def _backing(b):
    return brd.backing_copies(_grouped(b), _pairs(b))


@query("dedupe_served", f"""
    WITH {JUDGED}
    SELECT id, CASE WHEN lower(board) <> winner AND copied THEN 'backing-requisition' WHEN lower(board) <> winner THEN 'tenant-requisition' ELSE 'case-variant' END AS rule FROM e WHERE n > 1
    UNION ALL SELECT id, 'off_board' FROM r WHERE lower(board) NOT IN (SELECT lower(board) FROM k)""")
def _dedupe(b):
    return brd.dedupe_served(_site_rows(b), b.sql(KEEP), brd.backing_copies(_grouped(b), _pairs(b)))


@query("dedup_evictions", f"""
    WITH {JUDGED}
    SELECT 'run-1' AS run, board, CASE WHEN lower(board) <> winner AND copied THEN 'backing-requisition' WHEN lower(board) <> winner THEN 'tenant-requisition' ELSE 'case-variant' END AS rule, count(*) AS rows
    FROM e WHERE n > 1 GROUP BY ALL""")
def _evictions(b):
    from ..operators.aggregate import dedup_evictions

    evicted = brd.dedupe_served(_site_rows(b), b.sql(KEEP), brd.backing_copies(_grouped(b), _pairs(b))).filter("rule <> 'off_board'")
    return dedup_evictions(evicted.join(_site_rows(b).select("id", "board"), "id"), "run-1")


@query("elect_survivor", """
    SELECT n_name AS "group", lower(board) AS board FROM (
      SELECT n_name, board, row_number() OVER (PARTITION BY n_name ORDER BY operator = 'staffing', jobs DESC, lower(board)) AS n FROM
        (SELECT split_part(board, ':', 1) AS n_name, CASE WHEN operator = 'staffing' THEN board || '/internal' ELSE board END AS board, operator, jobs FROM boards)) WHERE n = 1""")
def _elect(b):
    named = F.when(F.col("operator") == "staffing", F.concat("board", F.lit("/internal"))).otherwise(F.col("board"))
    return brd.elect_survivor(b.boards.select(F.col("ats").alias("group"), named.alias("board"), "jobs"))


@query("refuse_copies", f"""
    WITH {JUDGED},
    a AS (SELECT * FROM x WHERE source = 'workday' AND CAST(native AS INT) % 2 = 0 AND board LIKE '%t%'), s AS (SELECT * FROM x WHERE source = 'workday' AND CAST(native AS INT) % 4 = 0 AND board LIKE '%hidden%'),
    c AS (SELECT own, min(board LIKE '%hidden%') AS best FROM a GROUP BY own), o AS (SELECT own, min(board LIKE '%hidden%') AS best FROM s GROUP BY own),
    w AS (SELECT own, lower(board) AS winner, row_number() OVER (PARTITION BY own ORDER BY board LIKE '%hidden%', -jobs, lower(board)) AS n FROM a)
    SELECT a.id FROM a JOIN c ON a.own = c.own JOIN w ON a.own = w.own AND w.n = 1 LEFT JOIN o ON a.own = o.own
    WHERE CASE WHEN o.own IS NULL OR (o.best AND NOT c.best) THEN lower(a.board) <> w.winner ELSE lower(a.board) NOT IN (SELECT lower(board) FROM s WHERE s.own = a.own) END""")
def _refuse(b):
    rows = _grouped(b).filter("source = 'workday'")
    arriving = rows.filter("CAST(native AS INT) % 2 = 0 AND board LIKE '%t%'")
    return brd.refuse_copies(arriving, rows.filter("CAST(native AS INT) % 4 = 0 AND board LIKE '%hidden%'"))


@query("alias_filter", "SELECT p.id, 'alias:' || b.operator AS rule FROM postings p JOIN boards b ON p.board = b.board WHERE b.jobs % 6 = 0")
def _alias_filter(b):
    aliases = b.boards.filter("jobs % 6 = 0").select(F.upper("board").alias("board"), F.col("operator").alias("signal"))
    return brd.alias_filter(b.postings, aliases)


PROBED = """
    SELECT 's' || CAST(c_custkey AS STRING) AS slug,
           CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 13 = 1 THEN 'vendor.example' WHEN c_custkey % 13 = 2 THEN 'www.s' || CAST(c_custkey AS STRING)
                ELSE 's' || CAST(c_custkey - c_custkey % 5 AS STRING) END AS resolved
    FROM {customer}"""


@query("resolve_aliases", f"""
    WITH p AS ({PROBED.format(customer='customer')}), live AS (SELECT 's' || CAST(c_custkey AS STRING) AS slug FROM customer WHERE c_custkey % 4 <> 0),
    c AS (SELECT resolved, count(*) AS n, max(CASE WHEN slug = resolved THEN 1 ELSE 0 END) AS reached, min(CASE WHEN slug IN ('s7', 's26') THEN slug END) AS pref FROM p WHERE resolved IS NOT NULL GROUP BY resolved),
    v AS (SELECT p.slug, p.resolved, coalesce(pref, p.resolved) AS canon,
           CASE WHEN p.resolved IS NULL THEN 'unreachable' WHEN p.resolved = 'vendor.example' THEN 'tombstone'
                WHEN p.resolved NOT IN (SELECT slug FROM live) AND regexp_replace(p.resolved, '^www\\.', '') = regexp_replace(p.slug, '^www\\.', '') THEN 'www_variant'
                WHEN p.resolved NOT IN (SELECT slug FROM live) THEN 'migrated' WHEN reached = 0 THEN 'canonical_unconfirmed' WHEN n = 1 THEN 'ordinary'
                WHEN p.slug = coalesce(pref, p.resolved) THEN 'canonical' ELSE 'duplicate' END AS verdict FROM p LEFT JOIN c ON p.resolved = c.resolved)
    SELECT slug, resolved, CASE WHEN verdict IN ('canonical', 'duplicate') THEN canon END AS canonical, verdict FROM v""")
def _resolve(b):
    live = b.customer.filter("c_custkey % 4 <> 0").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("slug"))
    return brd.resolve_aliases(b.sql(PROBED), live, prefer=("s7", "s26"), vendor_hosts=("vendor.example",))


# A supplier's parts as four boards that hold ever more of its lines, so sets nest and the last two agree.
NESTED = """
    SELECT 'g' || CAST(s_nationkey AS STRING) AS grp, 's' || CAST(s_suppkey AS STRING) || '-' || CAST(k AS STRING) AS board, CAST(l_partkey AS STRING) AS id
    FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) z ON l_linenumber <= 2 * k + 1"""
CONTAINED = f"""
    n AS (SELECT DISTINCT * FROM ({NESTED.format(supplier='supplier', lineitem='lineitem')})), z AS (SELECT grp AS g, board, count(*) AS size FROM n GROUP BY 1, 2),
    h AS (SELECT a.grp AS g, a.board AS x, b.board AS y, count(*) AS shared FROM n a JOIN n b ON a.grp = b.grp AND a.id = b.id AND a.board <> b.board GROUP BY 1, 2, 3),
    i AS (SELECT h.g, x, y, zx.size AS sx, zy.size AS sy FROM h JOIN z zx ON h.g = zx.g AND h.x = zx.board JOIN z zy ON h.g = zy.g AND h.y = zy.board WHERE shared = zx.size)"""


@query("bury_contained", f"""
    WITH {CONTAINED}, c AS (SELECT *, row_number() OVER (PARTITION BY g, x ORDER BY sy DESC, y) AS n FROM i WHERE sy > sx OR (sy = sx AND y < x))
    SELECT g AS "group", x AS board, y AS onto FROM c WHERE n = 1""")
def _bury(b):
    return brd.bury_contained(b.sql(NESTED).withColumnRenamed("grp", "group"))


@query("equal_set_aliases", f"""
    WITH {CONTAINED} SELECT g AS "group", x AS board, min(y) AS canonical FROM i WHERE sx = sy AND y < x GROUP BY 1, 2""")
def _equal(b):
    return brd.equal_set_aliases(b.sql(NESTED).withColumnRenamed("grp", "group"))


WEB = "SELECT 'ats' || CAST(page_id % 4 AS STRING) AS ats, 'p' || CAST(page_id AS STRING) AS board, url FROM {pages}"
DOMAIN = "regexp_extract(regexp_extract(lower(url), '^https?://([^/?#]*)', 1), '([^.]+\\.[^.]+)$', 1)"


@query("cross_source_duplicates", f"""
    WITH w AS (SELECT *, {DOMAIN} AS domain FROM ({WEB.format(pages='pages')}))
    SELECT ats, board, url, domain FROM w WHERE domain <> '' AND domain IN (SELECT domain FROM w GROUP BY domain HAVING count(DISTINCT ats) >= 2)""")
def _cross(b):
    return brd.cross_source_duplicates(b.sql(WEB))


LEDGER = """
    SELECT CASE WHEN c_custkey % 3 = 0 THEN upper(lower(n_name) || ':' || CAST(c_custkey % 400 AS STRING)) ELSE lower(n_name) || ':' || CAST(c_custkey % 400 AS STRING) END AS board,
           CASE c_custkey % 5 WHEN 0 THEN 'dead' WHEN 1 THEN 'unknown' ELSE 'live' END AS status, CAST(c_custkey % 31 AS INT) AS jobs,
           CASE WHEN c_custkey % 23 = 0 THEN 'bad' ELSE CAST(DATE '2001-06-01' + CAST(c_custkey % 60 AS INT) AS STRING) END AS checked_at, c_custkey AS place
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""


@query("active_boards", f"""
    WITH l AS (SELECT * FROM ({LEDGER.format(customer='customer', nation='nation')}) WHERE lower(board) NOT LIKE 'nation\\_3:%' ESCAPE '\\' AND lower(board) NOT LIKE 'nation\\_4:%' ESCAPE '\\'),
    g AS (SELECT lower(board) AS k, max(CASE WHEN status = 'live' THEN checked_at END) AS live, max(CASE WHEN status = 'dead' THEN checked_at END) AS dead,
                 min(CASE WHEN status = 'live' THEN board END) AS key FROM l GROUP BY 1),
    w AS (SELECT l.*, row_number() OVER (PARTITION BY lower(l.board) ORDER BY l.checked_at DESC, l.place) AS n FROM l JOIN g ON lower(l.board) = g.k
          WHERE l.status = 'live' AND l.board = g.key AND (g.dead IS NULL OR g.dead <= g.live))
    SELECT board, jobs, checked_at, place FROM w WHERE n = 1 AND lower(board) NOT LIKE 'nation\\_5:%' ESCAPE '\\' AND jobs >= 4""")
def _active(b):
    ledger = b.sql(LEDGER)
    named = lambda n: ledger.filter(F.lower("board").startswith(n)).select("board")
    return brd.active_boards(ledger, excluded=named("nation_3:"), parked=named("nation_5:"), aliases=named("nation_4:"), min_jobs=4)


@query("due_for_check", f"""
    SELECT board, place FROM ({LEDGER.format(customer='customer', nation='nation')})
    WHERE try_cast(checked_at AS DATE) IS NULL OR date_diff('day', try_cast(checked_at AS DATE), DATE '2001-08-02') >= CASE status WHEN 'live' THEN 7 WHEN 'dead' THEN 90 ELSE 3 END""")
def _due(b):
    return brd.due_for_check(b.sql(LEDGER), "2001-08-02").select("board", "place")


@query("gone_pool", f"""
    SELECT board, place FROM ({LEDGER.format(customer='customer', nation='nation')}) WHERE lower(board) IN (SELECT lower(board) FROM boards WHERE jobs >= 20)""")
def _gone(b):
    return brd.gone_pool(b.boards.select(F.upper("board").alias("board"), F.col("jobs").alias("streak")), b.sql(LEDGER)).select("board", "place")


FRONT_POSTS = "SELECT 'f' || CAST(o_custkey % 40 AS STRING) AS board, CAST(o_orderkey AS STRING) AS id, CAST(o_orderkey % 900 AS STRING) AS key, o_orderkey % 3 = 0 AS tech FROM {orders}"
BACK_POSTS = "SELECT 'b' || CAST(o_custkey % 40 AS STRING) AS board, CAST(o_orderkey AS STRING) AS id, CAST(o_orderkey % 900 AS STRING) AS key, o_orderkey % 30 <> 0 AS tech FROM {orders} WHERE o_custkey % 40 < 12 OR o_orderkey % 50 <> 0"


@query("covered_by_backing", f"""
    WITH f AS ({FRONT_POSTS.format(orders='orders')}), k AS ({BACK_POSTS.format(orders='orders')}),
    h AS (SELECT board, key, bool_or(tech) AS served FROM k GROUP BY 1, 2),
    m AS (SELECT f.board AS front, count(*) AS n, count(*) FILTER (WHERE h.key IS NULL) AS missing, count(*) FILTER (WHERE f.tech AND NOT coalesce(served, FALSE)) AS unserved
          FROM f LEFT JOIN h ON 'b' || substring(f.board, 2) = h.board AND f.key = h.key GROUP BY 1)
    SELECT front, CASE WHEN CAST(substring(front, 2) AS INT) % 10 = 9 THEN 'a backing board is not live' WHEN unserved > 0 THEN 'in-domain postings without a served copy'
                  WHEN missing > n * 0.01 THEN 'postings on no backing board' ELSE 'buried' END AS verdict,
           CASE WHEN CAST(substring(front, 2) AS INT) % 10 <> 9 AND unserved = 0 AND missing <= n * 0.01 THEN 'b' || substring(front, 2) END AS onto
    FROM m""")
def _covered(b):
    posts = b.sql(FRONT_POSTS).unionByName(b.sql(BACK_POSTS))
    fronts = b.sql(FRONT_POSTS).select(F.col("board").alias("front")).distinct()
    pairs = fronts.select("front", F.concat(F.lit("b"), F.expr("substring(front, 2)")).alias("backing"))
    eligible = b.sql(BACK_POSTS).select("board").distinct().filter("CAST(substring(board, 2) AS INT) % 10 <> 9")
    return brd.covered_by_backing(posts, pairs, eligible)


@query("front_duplication", """
    WITH u AS (SELECT ats AS front, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS part FROM postings),
    h AS (SELECT 'jobs.' || ats || '.example.com' AS host, split_part(board, ':', 2) AS part FROM boards WHERE in_scope)
    SELECT front, count(*) AS postings, count(h.host) AS duplicated, round(count(h.host) / count(*), 6) AS share
    FROM u LEFT JOIN (SELECT DISTINCT * FROM h) h ON u.host = h.host AND u.part = h.part GROUP BY front""")
def _front(b):
    held = b.boards.filter("in_scope").select("board", F.concat(F.lit("https://jobs."), "ats", F.lit(".example.com/"), F.split("board", ":").getItem(1)).alias("url"))
    return brd.front_duplication(b.postings.select(F.col("ats").alias("front"), "url"), held)


COPIES = """
    SELECT id, board, CAST(split_part(id, ':', 3) AS BIGINT) AS ord, title, company, location, CAST(min_salary_annual / 100000 AS INT) AS min_salary_annual,
           CAST(NULL AS INT) AS max_salary_annual, salary_currency FROM {postings}"""


@query("posting_groups", """
    WITH c AS (SELECT id, board, CAST(split_part(id, ':', 3) AS BIGINT) AS ord, lower(title) AS t, CASE WHEN company LIKE 'Acme%' THEN lower(regexp_replace(company, ' GmbH', '')) ELSE lower(company) END AS w,
                      CASE WHEN location = 'Munich, Germany, Germany' THEN 'munich|Germany' ELSE
                        translate(lower(split_part(split_part(location, ';', 1), ',', 1)), 'ü', 'u') || '|' || CASE WHEN location LIKE '%Germany%' THEN 'Germany' WHEN location IN ('Bangalore', 'Bengaluru, Karnataka, India', 'Hyderabad, Telangana') THEN 'India'
                          WHEN location LIKE 'Zu%' OR location LIKE 'Zü%' THEN 'Switzerland' ELSE location END END AS p FROM postings),
    k AS (SELECT *, CASE WHEN w IS NULL OR p IS NULL THEN id ELSE concat_ws('#', t, w, p) END AS cls FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY cls, board ORDER BY ord, id) AS n FROM k)
    SELECT id, first_value(id) OVER (PARTITION BY cls, n ORDER BY ord, id) AS leader FROM r""")
def _posting_groups(b):
    return brd.posting_groups(annotate_country(b.sql(COPIES)))


@query("requisition_groups")
def _requisition_groups(b):
    return brd.requisition_groups(annotate_country(b.sql(COPIES)))


@query("requisition_pairs", """
    SELECT lower(title) AS stem, lower(company) AS name, count(*) AS rows, min(CAST(split_part(id, ':', 3) AS BIGINT)) AS first_row
    FROM postings WHERE company IS NOT NULL GROUP BY 1, 2""")
def _requisition_pairs(b):
    rows = b.sql(COPIES).filter("company IS NOT NULL")
    keyed = rows.select(F.lower("title").alias("stem"), F.lower("company").alias("name"), "ord")
    return keyed.groupBy("stem", "name").agg(F.count(F.lit(1)).alias("rows"), F.min("ord").alias("first_row"))


CURATED = "SELECT board, 'Brand ' || CAST(jobs % 9 AS STRING) AS name FROM {boards} WHERE jobs % 8 = 0"


@query("settle_company", f"""
    WITH v AS (SELECT board, company, count(*) AS n FROM postings GROUP BY 1, 2), s AS (SELECT board, sum(n) FILTER (WHERE company IS NOT NULL) AS stating FROM v GROUP BY 1),
    w AS (SELECT board, company, n, row_number() OVER (PARTITION BY board ORDER BY n DESC, company) AS r FROM v WHERE company IS NOT NULL), c AS ({CURATED.format(boards='boards')})
    SELECT s.board, coalesce(c.name, CASE WHEN w.n >= s.stating * 0.5 THEN w.company END) AS name,
           CASE WHEN c.name IS NOT NULL THEN 'curated' WHEN w.n >= s.stating * 0.5 THEN 'stated' END AS name_source
    FROM s LEFT JOIN w ON s.board = w.board AND w.r = 1 LEFT JOIN c ON s.board = c.board""")
def _settle(b):
    return settle_company(b.postings, b.sql(CURATED))


LISTS = "SELECT DISTINCT lower(c_mktsegment) AS form, CASE c_mktsegment WHEN 'BUILDING' THEN 'aggregator' WHEN 'FURNITURE' THEN 'staffing' WHEN 'MACHINERY' THEN 'services' ELSE 'verified' END AS kind FROM {customer} UNION ALL SELECT '7', 'exception' FROM {region} WHERE r_regionkey = 0"


@query("classify_operator", """
    WITH x AS (SELECT lower(n_name) || ':' || CAST(c_custkey AS STRING) AS board, 'Talent ' || c_mktsegment AS company, c_mktsegment AS m, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT board, company, CASE WHEN c_custkey = 7 THEN 'employer' WHEN m = 'BUILDING' THEN 'aggregator' WHEN m = 'FURNITURE' THEN 'staffing' WHEN m = 'MACHINERY' THEN 'services' ELSE 'employer' END AS operator,
           FALSE AS unverified FROM x""")
def _operator(b):
    return classify_operator(b.sql("SELECT lower(n_name) || ':' || CAST(c_custkey AS STRING) AS board, 'Talent ' || c_mktsegment AS company FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"), b.sql(LISTS))


@query("company_operator", """
    SELECT split_part(board, ':', 1) AS company, CASE min(CASE operator WHEN 'staffing' THEN 1 WHEN 'services' THEN 2 ELSE 3 END) WHEN 1 THEN 'staffing' WHEN 2 THEN 'services' ELSE 'employer' END AS operator
    FROM boards GROUP BY 1""")
def _company_operator(b):
    return company_operator(b.boards.select(F.col("ats").alias("company"), "operator"))


TENANTS = """
    SELECT 'x:' || CAST(c_custkey AS STRING) AS board, 'x' AS source, 't' || CAST(c_custkey % 500 AS STRING) AS tenant,
           CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Name ' || CAST(c_custkey % 2 AS STRING) END AS stated,
           CASE WHEN c_custkey % 41 = 0 THEN 'staffing' ELSE 'employer' END AS operator FROM {customer}"""
BRANDS = "SELECT 'X:' || CAST(c_custkey AS STRING) AS board, 'Brand ' || CAST(c_custkey % 10 AS STRING) AS name FROM {customer} WHERE c_custkey % 50 < 5"


# Tenants t(k mod 500); brand n (k mod 10) links tenants whose k mod 50 is n < 5, so the components are known in closed form.
@query("group_companies", f"""
    WITH t AS ({TENANTS.format(customer='customer')}), a AS (SELECT lower(board) AS board, min(name) AS alias FROM ({BRANDS.format(customer='customer')}) GROUP BY 1),
    k AS (SELECT t.*, a.alias, CASE WHEN CAST(substring(tenant, 2) AS INT) % 50 < 5 THEN 'brand' || CAST(CAST(substring(tenant, 2) AS INT) % 10 AS STRING) ELSE tenant END AS comp FROM t LEFT JOIN a ON t.board = a.board),
    f AS (SELECT comp, min(board) AS company_id, min(alias) AS alias, count(*) AS n, min(CASE operator WHEN 'staffing' THEN 1 ELSE 3 END) AS op FROM k GROUP BY 1),
    v AS (SELECT comp, stated, count(*) AS n, row_number() OVER (PARTITION BY comp ORDER BY count(*) DESC, stated) AS r FROM k WHERE stated IS NOT NULL GROUP BY 1, 2)
    SELECT k.board, f.company_id, coalesce(f.alias, CASE WHEN 2 * v.n >= f.n THEN v.stated END, 'T' || substring(z.tenant, 2)) AS name, CASE f.op WHEN 1 THEN 'staffing' ELSE 'employer' END AS operator
    FROM k JOIN f ON k.comp = f.comp LEFT JOIN v ON k.comp = v.comp AND v.r = 1 JOIN t z ON z.board = f.company_id""")
def _companies(b):
    return brd.group_companies(b.sql(TENANTS), b.sql(BRANDS))


@query("company_block_keys", """
    SELECT DISTINCT company, CASE WHEN company LIKE 'Acme%' THEN 'acme' ELSE split_part(lower(company), '#', 1) END AS head FROM postings WHERE company IS NOT NULL""")
def _block_keys(b):
    named = b.postings.filter("company IS NOT NULL").select("company").distinct()
    return named.select("company", F.try_element_at(company_words(F.col("company")), F.lit(1)).alias("head"))
