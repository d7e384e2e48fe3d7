"""Stand-in input tables, written once in SQL both Spark and the oracle engine read.

The test tables hold orders, customers, events and documents. Each text below derives a table of
the shape an operator expects from them, over every row. No operator logic lives here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: The moment the bound queries call "now"; the last order day is 2001-08-01.
NOW = "2001-08-02T00:00:00+00:00"

BINDINGS = {
    "postings": """
        SELECT lower(n_name) || ':' || CAST(c_custkey AS STRING) || ':' || CAST(o_orderkey AS STRING) AS id,
               lower(n_name) AS ats,
               lower(n_name) || ':' || CAST(c_custkey AS STRING) AS board,
               CASE WHEN o_custkey % 29 = 0 THEN NULL
                    WHEN o_custkey % 7 = 0 THEN 'Acme ' || c_mktsegment || ' GmbH'
                    ELSE c_name END AS company,
               CASE o_orderkey % 16
                    WHEN 0 THEN 'Senior Data Engineer' WHEN 1 THEN 'Machine Learning Engineer'
                    WHEN 2 THEN 'Software Engineer Intern' WHEN 3 THEN 'Registered Nurse'
                    WHEN 4 THEN 'Staff Backend Developer (C++)' WHEN 5 THEN 'Sales Manager - International'
                    WHEN 6 THEN 'Junior QA Analyst' WHEN 7 THEN 'Site Reliability Engineer'
                    WHEN 8 THEN 'Product Designer' WHEN 9 THEN 'Warehouse Associate'
                    WHEN 10 THEN 'Principal Security Engineer' WHEN 11 THEN 'Java Developer'
                    WHEN 12 THEN 'Head of Data' WHEN 13 THEN 'Data Scientist, AI Research'
                    WHEN 14 THEN 'Mechanical Engineer' ELSE 'Frontend Developer' END AS title,
               CASE o_orderkey % 15
                    WHEN 0 THEN 'Berlin, Germany' WHEN 1 THEN 'Bengaluru, Karnataka, India'
                    WHEN 2 THEN 'Zürich, Switzerland' WHEN 3 THEN 'New York, NY, United States'
                    WHEN 4 THEN 'London, UK' WHEN 5 THEN 'Paris, France' WHEN 6 THEN NULL
                    WHEN 7 THEN 'Bangalore' WHEN 8 THEN 'Remote' WHEN 9 THEN 'Germany'
                    WHEN 10 THEN 'Toronto, Canada; London, UK' WHEN 11 THEN 'Munich, Germany, Germany'
                    WHEN 12 THEN 'Tokyo, Japan' WHEN 13 THEN 'Hyderabad, Telangana' ELSE 'Zurich' END AS location,
               CASE WHEN o_orderkey % 5 = 0 THEN TRUE WHEN o_orderkey % 5 = 1 THEN NULL ELSE FALSE END AS remote,
               c_mktsegment AS department,
               'https://jobs.' || lower(n_name) || '.example.com/' || CAST(c_custkey AS STRING) || '/' || CAST(o_orderkey AS STRING) AS url,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '21-Apr-2026'
                    ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T08:00:00Z' END AS posted_at,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL
                    ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS STRING) || 'T06:30:00+00:00' END AS first_seen,
               CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE
                    'We build tools in Java, Python and C++ for ' || c_mktsegment || '. You bring at least '
                    || CAST(1 + o_orderkey % 11 AS STRING) || ' years of experience'
                    || CASE o_orderkey % 6 WHEN 0 THEN '. Pay: $' || CAST(60 + o_orderkey % 90 AS STRING) || ',000 - $' || CAST(90 + o_orderkey % 90 AS STRING) || ',000 per year'
                                           WHEN 1 THEN '. This role is fully remote'
                                           WHEN 2 THEN '. We do not offer visa sponsorship. Location: Austin, TX' 
                                           WHEN 3 THEN '. Applications close on 15 ' || CASE o_orderkey % 4 WHEN 0 THEN 'March' WHEN 1 THEN 'June' ELSE 'October' END || ' 2001. Relocation support is available'
                                           WHEN 4 THEN '. Salary EUR ' || CAST(40 + o_orderkey % 60 AS STRING) || '.000 per annum'
                                           ELSE '. This is an on-site position' END || '.' END AS description,
               CASE o_orderkey % 10 WHEN 0 THEN 'Full time' WHEN 1 THEN 'FT' WHEN 2 THEN 'Part-time' WHEN 3 THEN 'Contract'
                    WHEN 4 THEN 'Internship' WHEN 5 THEN 'parttime_permanent' WHEN 6 THEN 'Regular' WHEN 7 THEN NULL
                    WHEN 8 THEN 'Fixed Term' ELSE 'Employee' END AS employment_type,
               CASE o_orderkey % 13 WHEN 0 THEN '3-5 years' WHEN 1 THEN 'Senior' WHEN 2 THEN '24 months' WHEN 3 THEN 'Entry Level' WHEN 4 THEN '7+' ELSE NULL END AS experience,
               CASE o_orderkey % 14 WHEN 0 THEN 'USD 90000 - 120000 yearly' WHEN 1 THEN 'INR 12 - 18 lakh' WHEN 2 THEN '45 EUR hourly' WHEN 3 THEN 'GBP 5000 monthly' ELSE NULL END AS salary,
               CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderkey % 13 AS INT) END AS min_years,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS INT) END AS min_salary_annual,
               CASE WHEN o_orderkey % 3 = 1 THEN CAST(floor(o_totalprice) AS INT) + 20000 ELSE NULL END AS max_salary_annual,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN c_nationkey % 4 = 0 THEN 'EUR' WHEN c_nationkey % 4 = 1 THEN 'USD'
                    WHEN c_nationkey % 4 = 2 THEN 'INR' ELSE 'XAU' END AS salary_currency,
               CASE WHEN o_orderkey % 21 = 0 THEN TRUE WHEN o_orderkey % 21 = 1 THEN NULL ELSE FALSE END AS is_confident_non_tech,
               'R' || CAST(o_orderkey % 4000 AS STRING) AS requisition
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "texts": """
        SELECT d.source || ':' || CAST(d.doc_id AS STRING) AS id, d.source AS board, d.source AS ats,
               substring(d.text, 1, 60) AS title, d.text AS description, d.lang AS lang, d.doc_id AS doc_id,
               l.quality AS quality, l.toxic AS toxic
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "vectors": """
        SELECT 'src' || CAST(vec_id % 20 AS STRING) || ':' || CAST(vec_id AS STRING) AS id, vec_id,
               'src' || CAST(vec_id % 20 AS STRING) AS ats, 'company ' || CAST(vec_id % 37 AS STRING) AS company,
               label, embedding AS vector
        FROM {embeddings}""",
    # One row a day, board (user), family (event type) and band: how many postings are open, as a level.
    "levels": """
        SELECT CAST(CAST(ts AS DATE) AS STRING) AS ts, 'b' || CAST(user_id % 60 AS STRING) AS board, 'stock' AS metric,
               event_type AS family, CASE WHEN value < 20 THEN 'entry' WHEN value < 60 THEN 'mid' ELSE 'senior' END AS band,
               CAST(sum(1 + event_id % 9) AS BIGINT) AS level
        FROM {events} GROUP BY 1, 2, 3, 4, 5""",
    # The tick ledger: signed deltas per board, family and band; the sign keeps levels moving both ways.
    "ticks": """
        SELECT CAST(CAST(ts AS DATE) AS STRING) AS ts, 'b' || CAST(user_id % 60 AS STRING) AS board, 'stock' AS metric,
               event_type AS family, CASE WHEN value < 20 THEN 'entry' WHEN value < 60 THEN 'mid' ELSE 'senior' END AS band,
               CAST(sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 + event_id % 5 END) AS BIGINT) AS delta
        FROM {events} WHERE user_id % 60 < 40 OR CAST(ts AS DATE) >= DATE '2024-01-12'
        GROUP BY 1, 2, 3, 4, 5
        UNION ALL
        SELECT CAST(CAST(ts AS DATE) AS STRING), 'b' || CAST(user_id % 60 AS STRING),
               CASE event_id % 4 WHEN 0 THEN 'opened' WHEN 1 THEN 'closed' WHEN 2 THEN 'recounted_in' ELSE 'recounted_out' END,
               event_type, CASE WHEN value < 20 THEN 'entry' WHEN value < 60 THEN 'mid' ELSE 'senior' END,
               CAST(count(*) AS BIGINT)
        FROM {events} GROUP BY 1, 2, 3, 4, 5""",
    # One row a tick: the counting method in force.
    "methods": """
        SELECT CAST(CAST(ts AS DATE) AS STRING) AS ts,
               CASE WHEN max(CAST(ts AS DATE)) >= DATE '2024-01-20' THEN 'list-2' ELSE 'list-1' END AS family_list_fingerprint,
               CASE WHEN max(CAST(ts AS DATE)) >= DATE '2024-01-09' THEN 3 ELSE 2 END AS family_classifier_version,
               CASE WHEN max(CAST(ts AS DATE)) >= DATE '2024-01-20' THEN 8 ELSE 7 END AS tech_filter_version,
               1 AS derivations_version, 1 AS dedup_version
        FROM {events} GROUP BY 1""",
    # Company directory as its exploded bridge: which company owns which board.
    "directory": """
        SELECT 'company ' || CAST((user_id % 60) % 25 AS STRING) AS company, 'b' || CAST(user_id % 60 AS STRING) AS board,
               CASE (user_id % 60) % 25 % 6 WHEN 0 THEN 'staffing' WHEN 1 THEN 'services' ELSE 'employer' END AS operator
        FROM {events} GROUP BY 1, 2, 3""",
    "boards": """
        SELECT lower(n_name) || ':' || CAST(c_custkey AS STRING) AS board, lower(n_name) AS ats,
               CASE WHEN c_custkey % 11 = 0 THEN 'staffing' WHEN c_custkey % 13 = 0 THEN 'services' ELSE 'employer' END AS operator,
               c_name AS company, c_acctbal AS score, CAST(c_custkey % 31 AS INT) AS jobs, c_custkey % 3 <> 0 AS in_scope
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
}

#: Snapshots for the diffs: what was held, and what this run read.
BINDINGS["prior"] = (
    "SELECT id, board, title, location, employment_type, min_salary_annual, description FROM ("
    + BINDINGS["postings"]
    + ") p WHERE CAST(split_part(id, ':', 3) AS BIGINT) % 10 <> 0"
)
BINDINGS["fresh"] = (
    "SELECT id, board, title, location, employment_type, "
    "CASE WHEN CAST(split_part(id, ':', 3) AS BIGINT) % 11 = 0 THEN min_salary_annual + 1 ELSE min_salary_annual END AS min_salary_annual, "
    "CASE WHEN CAST(split_part(id, ':', 3) AS BIGINT) % 6 = 5 THEN NULL ELSE description END AS description FROM ("
    + BINDINGS["postings"]
    + ") p WHERE CAST(split_part(id, ':', 3) AS BIGINT) % 7 <> 0"
)


class Bindings:
    """The bound tables of one data directory, as lazy DataFrames: `b.postings`, `b.table('orders')`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run binding SQL, `{name}` standing for a test table or another binding."""
        used = {n: self.table(n) for n in TABLES if "{" + n + "}" in text}
        used.update({n: getattr(self, n) for n in BINDINGS if "{" + n + "}" in text})
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BINDINGS:
            # The test tables are single row groups, which one task reads: rows are dealt by id before any work on texts.
            out = self.sql(BINDINGS[name])
            return out.repartition("id") if "id" in out.columns else out
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def oracle_ctes(names: tuple[str, ...]) -> str:
    """The bindings as CTE text for the oracle engine, test tables named directly."""
    plain = {n: n for n in (*TABLES, *BINDINGS)}
    return ",\n".join(f"{n} AS ({BINDINGS[n].format(**plain)})" for n in names)
