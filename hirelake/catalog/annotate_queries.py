"""Registered queries: derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as ann
from ..operators.stances import annotate_stances
from .diff_queries import N
from .filter_queries import CONTRACT, FULL_OR_NONE, INTERN, PART
from .registry import query


@query("annotate_country", """
    SELECT id, coalesce(CASE WHEN location LIKE '%Germany%' THEN 'DE' WHEN location IN ('Bengaluru, Karnataka, India', 'Bangalore', 'Hyderabad, Telangana') THEN 'IN' WHEN location IN ('Zürich, Switzerland', 'Zurich') THEN 'CH'
           WHEN location LIKE 'New York%' THEN 'US' WHEN location = 'London, UK' THEN 'GB' WHEN location LIKE 'Paris%' THEN 'FR' WHEN location LIKE '%;%' THEN 'CA,GB' WHEN location LIKE 'Tokyo%' THEN 'JP' END, '') AS countries FROM postings""")
def _country(b):
    return ann.annotate_country(b.postings).select("id", F.array_join("countries", ",").alias("countries"))


@query("annotate_region", """
    SELECT id, CASE location WHEN 'Bengaluru, Karnataka, India' THEN 'bengaluru,karnataka' WHEN 'Bangalore' THEN 'bengaluru,karnataka' WHEN 'Hyderabad, Telangana' THEN 'hyderabad,telangana' ELSE '' END AS places FROM postings""")
def _region(b):
    return ann.annotate_region(b.postings).select("id", F.array_join("places", ",").alias("places"))


@query("annotate_employment", f"""
    WITH f AS (SELECT id, title, {PART} AS p, {CONTRACT} AS c, {INTERN} OR regexp_matches(title, '\\bintern(ship)?s?\\b', 'i') AS i, {FULL_OR_NONE.split(' OR NOT (')[0][1:]} AS f FROM postings)
    SELECT id, f OR NOT (f OR p OR c OR i) AS is_full_time, p AS is_part_time, c AS is_contract, i AS is_internship FROM f""")
def _employment(b):
    return ann.annotate_employment(b.postings).select("id", "is_full_time", "is_part_time", "is_contract", "is_internship")


@query("annotate_remote", """
    SELECT id, CASE WHEN contains(description, 'This role is fully remote') THEN TRUE ELSE remote END AS remote FROM postings""")
def _remote(b):
    return ann.annotate_remote(b.postings).select("id", "remote")


# The bound text states "at least N years of experience"; a field, where one is readable, comes first.
EXPERIENCE = """
    SELECT *, CASE experience WHEN '3-5 years' THEN 3 WHEN '24 months' THEN 2 WHEN '7+' THEN 7 END AS f_lo, CASE experience WHEN '3-5 years' THEN 5 END AS f_hi,
           TRY_CAST(regexp_extract(description, 'at least (\\d+) years of experience', 1) AS INT) AS t_lo,
           CASE WHEN regexp_matches(coalesce(experience, '') || ' ' || title, '(?i)\\b(principal|head of)\\b') THEN 10 WHEN regexp_matches(title, '(?i)\\bstaff\\b') THEN 7
                WHEN regexp_matches(coalesce(experience, '') || ' ' || title, '(?i)\\bsenior\\b') THEN 5 WHEN regexp_matches(coalesce(experience, '') || ' ' || title, '(?i)\\b(intern|junior|entry level)\\b') THEN 0
                WHEN regexp_matches(title, '(?i)\\bassociate\\b') THEN 3 END AS s_lo FROM postings"""


@query("annotate_experience", f"""
    WITH e AS ({EXPERIENCE}) SELECT id, coalesce(f_lo, t_lo, s_lo) AS min_years, f_hi AS max_years, CASE WHEN f_lo IS NOT NULL THEN 'field' WHEN t_lo IS NOT NULL THEN 'regex' WHEN s_lo IS NOT NULL THEN 'seniority' END AS experience_source,
           coalesce(CAST(t_lo AS STRING), '') AS stated_floors FROM e""")
def _experience(b):
    rows = ann.annotate_experience(b.postings)
    return rows.select("id", "min_years", "max_years", "experience_source", F.array_join(F.transform("stated_floors", lambda x: x.cast("string")), ",").alias("stated_floors"))


# Field: "USD 90000 - 120000 yearly", "INR 12 - 18 lakh", "45 EUR hourly", "GBP 5000 monthly". Text: "$X,000 - $Y,000 per year", "EUR X.000 per annum".
SALARY = """
    SELECT id, location, CASE salary WHEN 'USD 90000 - 120000 yearly' THEN 90000 WHEN 'INR 12 - 18 lakh' THEN 1200000 WHEN '45 EUR hourly' THEN 93600 WHEN 'GBP 5000 monthly' THEN 60000 END AS f_lo,
           CASE salary WHEN 'USD 90000 - 120000 yearly' THEN 120000 WHEN 'INR 12 - 18 lakh' THEN 1800000 END AS f_hi, CASE WHEN salary IS NOT NULL THEN regexp_extract(salary, '(USD|INR|EUR|GBP)', 1) END AS f_cur,
           TRY_CAST(regexp_extract(description, 'Pay: \\$(\\d+),000 - ', 1) AS INT) * 1000 AS d_a, TRY_CAST(regexp_extract(description, ' - \\$(\\d+),000 per year', 1) AS INT) * 1000 AS d_b, TRY_CAST(regexp_extract(description, 'Salary EUR (\\d+)\\.000', 1) AS INT) * 1000 AS e_lo FROM postings"""


@query("annotate_salary", f"""
    WITH s AS ({SALARY}) SELECT id, coalesce(f_lo, least(d_a, d_b), e_lo) AS min_salary_annual, CASE WHEN f_lo IS NOT NULL THEN f_hi ELSE greatest(d_a, d_b) END AS max_salary_annual,
           CASE WHEN f_lo IS NOT NULL THEN f_cur WHEN d_a IS NOT NULL THEN 'USD' WHEN e_lo IS NOT NULL THEN 'EUR' END AS salary_currency, CASE WHEN f_lo IS NOT NULL THEN 'field' WHEN d_a IS NOT NULL OR e_lo IS NOT NULL THEN 'regex' END AS salary_source FROM s""")
def _salary(b):
    return ann.annotate_salary(b.postings).select("id", "min_salary_annual", "max_salary_annual", "salary_currency", "salary_source")


@query("annotate_all", f"""
    WITH e AS ({EXPERIENCE}), s AS ({SALARY})
    SELECT e.id, CASE WHEN contains(e.description, 'This role is fully remote') THEN TRUE ELSE e.remote END AS remote, coalesce(e.f_lo, t_lo, s_lo) AS min_years,
           CASE WHEN e.f_lo IS NOT NULL THEN 'field' WHEN t_lo IS NOT NULL THEN 'regex' WHEN s_lo IS NOT NULL THEN 'seniority' END AS experience_source, coalesce(s.f_lo, least(d_a, d_b), e_lo) AS min_salary_annual,
           CASE WHEN s.f_lo IS NOT NULL THEN f_cur WHEN d_a IS NOT NULL THEN 'USD' WHEN e_lo IS NOT NULL THEN 'EUR' END AS salary_currency, CASE WHEN e.location LIKE '%Germany%' THEN 1 WHEN e.location LIKE '%;%' THEN 2 WHEN e.location IS NULL OR e.location = 'Remote' THEN 0 ELSE 1 END AS n_countries
    FROM e JOIN s ON e.id = s.id""")
def _all(b):
    return ann.annotate_all(b.postings).select("id", "remote", "min_years", "experience_source", "min_salary_annual", "salary_currency", F.size("countries").alias("n_countries"))


@query("classify_domain", """
    SELECT id, CASE WHEN title IN ('Registered Nurse', 'Warehouse Associate', 'Product Designer', 'Sales Manager - International') THEN FALSE WHEN title = 'Mechanical Engineer' THEN FALSE ELSE TRUE END AS is_tech,
           CASE title WHEN 'Registered Nurse' THEN 'no-tech-signal' WHEN 'Warehouse Associate' THEN 'no-tech-signal' WHEN 'Product Designer' THEN 'no-tech-signal' WHEN 'Sales Manager - International' THEN 'no-tech-signal'
                WHEN 'Mechanical Engineer' THEN 'generic-token-but-non-software' WHEN 'Head of Data' THEN 'generic-tech-token' ELSE 'strong-software-signal' END AS reason FROM postings""")
def _domain(b):
    return ann.classify_domain(b.postings).select("id", "is_tech", "reason")


@query("classify_title_rules", """
    SELECT p.id, v.family, v.tier FROM postings p LEFT JOIN (VALUES ('Senior Data Engineer', 'data-ai', 'sole-cue'), ('Machine Learning Engineer', 'data-ai', 'sole-cue'), ('Software Engineer Intern', 'software-engineering', 'generic-software'),
      ('Registered Nurse', 'non-tech', 'negative'), ('Staff Backend Developer (C++)', 'backend', 'precedence'), ('Sales Manager - International', 'non-tech', 'negative'), ('Junior QA Analyst', 'quality', 'sole-cue'),
      ('Site Reliability Engineer', 'infrastructure', 'sole-cue'), ('Product Designer', 'product', 'sole-cue'), ('Warehouse Associate', 'non-tech', 'negative'), ('Principal Security Engineer', 'security', 'sole-cue'),
      ('Java Developer', 'software-engineering', 'sole-cue'), ('Head of Data', 'engineering-management', 'sole-cue'), ('Data Scientist, AI Research', 'data-ai', 'sole-cue'), ('Mechanical Engineer', 'non-tech', 'negative'),
      ('Frontend Developer', 'frontend', 'precedence')) v(title, family, tier) ON p.title = v.title""")
def _titles(b):
    return ann.classify_title_rules(b.postings).select("id", "family", "tier")


@query("watch_roles", """
    SELECT id, role, parent FROM (SELECT id, title, 'watch:java' AS role, 'software-engineering' AS parent, regexp_matches(title, '\\bjava\\b', 'i') AS hit FROM postings
      UNION ALL SELECT id, title, 'watch:llm', 'data-ai', regexp_matches(title, '\\b(llm|gen(erative)?[ -]?ai|ai)\\b', 'i') FROM postings UNION ALL SELECT id, title, 'watch:data-anything', 'data-ai', regexp_matches(title, '\\bdata\\b', 'i') FROM postings) WHERE hit""")
def _watch(b):
    return ann.watch_roles(b.postings).select("id", "role", "parent")


def _head(b):
    rows = b.vectors.withColumn("copy_key", F.col("company"))
    return ann.train_family_head(rows, regs=(0.01, 0.1), folds=5, cap=2000)


@query("train_family_head")
def _train(b):
    model, scores, cutoff = _head(b)
    return scores.withColumn("cutoff", F.lit(cutoff)).withColumn("classes", F.lit(model.numClasses))


@query("score_family")
def _score(b):
    model, _, cutoff = _head(b)
    weights, bias = ann.head_weights(model)
    scored = ann.score_family(b.vectors, weights, bias, [str(i) for i in range(len(bias))], cutoff)
    return scored.select("id", "family", F.round("probability", 6).alias("probability"))


CALLED = "SELECT id, CASE WHEN " + N + " % 6 = 0 THEN 'non-tech' ELSE 'backend' END AS family, CAST(" + N + " % 100 AS DOUBLE) / 100 AS probability FROM {postings}"


@query("stamp_confident", f"""
    SELECT p.id, {N.replace('id', 'p.id')} % 6 = 0 AND {N.replace('id', 'p.id')} % 100 >= 90 AS is_confident_non_tech FROM postings p""")
def _stamp(b):
    out, _ = ann.stamp_confident(b.postings, b.sql(CALLED))
    return out.select("id", "is_confident_non_tech")


@query("stamp_report", f"""
    WITH w AS (SELECT {N} % 6 = 0 AND {N} % 100 >= 90 AS now, coalesce(is_confident_non_tech, FALSE) AS was FROM postings)
    SELECT count(*) AS rows, count(*) FILTER (WHERE now) AS stamped, count(*) FILTER (WHERE now AND NOT was) AS newly_stamped, count(*) FILTER (WHERE was AND NOT now) AS unstamped FROM w""")
def _stamp_report(b):
    return ann.stamp_confident(b.postings, b.sql(CALLED))[1]


@query("annotate_stances", """
    SELECT id, CASE WHEN contains(description, 'do not offer visa sponsorship') THEN 'refuses_sponsorship' WHEN contains(description, 'Relocation support is available') THEN 'offers_relocation' ELSE '' END AS stances FROM postings""")
def _stances(b):
    return annotate_stances(b.postings).select("id", F.array_join("stances", ",").alias("stances"))


# One statement a row, among wordings that mean the same, the opposite, or something else.
_STATEMENTS = (
    ("Visa sponsorship is available for this role", "offers_sponsorship"), ("Is visa sponsorship available? No", "refuses_sponsorship"),
    ("You must already be authorized to work in the U.S.", "refuses_sponsorship"), ("Applicants must be U.S. citizens", "refuses_sponsorship"),
    ("Some positions require U.S. citizenship", ""), ("You report to the executive sponsor of the project", ""),
    ("We will sponsor your security clearance", ""), ("We offer H-1B transfer sponsorship", "may_offer_sponsorship"),
    ("Visa sponsorship is considered on a case-by-case basis", "may_offer_sponsorship"), ("You must be willing to relocate", ""),
    ("Relocation: Yes", "offers_relocation"), ("We are not a big company, but we offer visa sponsorship", "offers_sponsorship"),
    ("All are considered regardless of gender, age, origin or citizenship", ""), ("Lead the relocation of the data center", ""),
    ("We offer visa sponsorship to full-time employees only", "CASE WHEN o_orderstatus = 'F' THEN 'refuses_sponsorship' ELSE 'offers_sponsorship' END"),
    ("We offer visa sponsorship for senior roles", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'offers_sponsorship' ELSE 'refuses_sponsorship' END"),
)
_SAID = "CASE o_orderkey % 16 " + " ".join(f"WHEN {i} THEN '{text}'" for i, (text, _) in enumerate(_STATEMENTS)) + " END"
_MEANT = "CASE o_orderkey % 16 " + " ".join(f"WHEN {i} THEN " + (want if want.startswith("CASE") else f"'{want}'") for i, (_, want) in enumerate(_STATEMENTS)) + " END"


@query("stances_of_statements", f"SELECT o_orderkey, {_MEANT} AS stances FROM orders")
def _stances_of_statements(b):
    rows = b.sql(f"""SELECT o_orderkey, 'We build tools. ' || {_SAID} || '. Join us.' AS description,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'Senior Engineer' ELSE 'Engineer' END AS title, CASE WHEN o_orderstatus = 'F' THEN 'Part-time' ELSE 'Full time' END AS employment_type FROM {{orders}}""")
    return annotate_stances(rows.repartition("o_orderkey")).select("o_orderkey", F.array_join("stances", ",").alias("stances"))


@query("filter_work_authorization", "SELECT id FROM postings WHERE contains(description, 'Relocation support is available')")
def _authorization(b):
    from ..operators.filters import apply_filter
    from .bindings import NOW

    return apply_filter(annotate_stances(b.postings), {"work_authorization": "offers_relocation", "include_non_tech": True}, NOW).select("id")


@query("mention_sentences", """
    SELECT id, CASE WHEN contains(description, 'visa sponsorship') THEN 'We do not offer visa sponsorship.' ELSE 'Relocation support is available.' END AS mention FROM postings
    WHERE contains(description, 'visa sponsorship') OR contains(description, 'Relocation support')""")
def _mentions(b):
    return ann.mention_sentences(b.postings).select("id", "mention")


# The bound year is outside the years a closing day is read in, so the text is moved on by twenty.
@query("stated_end_date", """
    SELECT id, strptime(regexp_extract(description, '15 (March|June|October) 2001', 1) || ' 15 2021', '%B %d %Y')::DATE AS end_day, regexp_replace(regexp_extract(description, 'Applications close on 15 (March|June|October) 2001'), '2001', '2021') AS end_said
    FROM postings WHERE contains(description, 'Applications close on')
    UNION ALL SELECT id, NULL, NULL FROM postings WHERE NOT coalesce(contains(description, 'Applications close on'), FALSE)""")
def _end(b):
    moved = b.postings.withColumn("description", F.regexp_replace("description", "2001", "2021"))
    return ann.stated_end_date(moved).select("id", "end_day", "end_said")


def vocabulary(spark):
    """A small vocabulary of our own: term, skill, exact_case, list_only, not_after."""
    rows = [("Java", "java", False, False, None), ("Python", "python", False, False, None), ("C++", "c++", False, False, None), ("Go", "go", True, True, None),
            ("machine learning", "machine learning", False, False, None), ("learning", "learning", False, False, None), ("visa", "visa cards", False, False, "offer"), ("remote", "remote work", False, False, None)]
    return spark.createDataFrame(rows, "term string, skill string, exact_case boolean, list_only boolean, not_after string")


@query("skill_mentions", """
    SELECT id, skill FROM (SELECT id, unnest(['java', 'python', 'c++']) AS skill FROM postings WHERE description IS NOT NULL
      UNION ALL SELECT id, 'remote work' FROM postings WHERE contains(description, 'fully remote'))""")
def _skills(b):
    return ann.skill_mentions(b.postings, vocabulary(b.spark))


@query("convert_salary_report", """
    SELECT salary_currency, count(*) AS rows, CAST(sum(CASE salary_currency WHEN 'USD' THEN min_salary_annual WHEN 'EUR' THEN floor(min_salary_annual / 0.8611 * 1.0) WHEN 'INR' THEN floor(min_salary_annual / 94.55 * 1.0) END) AS BIGINT) AS usd
    FROM postings WHERE min_salary_annual IS NOT NULL GROUP BY 1""")
def _convert_report(b):
    from ..operators.rank import convert
    from ..rules.filters import FX_RATES

    usd = F.floor(convert(F.col("min_salary_annual"), F.col("salary_currency"), "USD", FX_RATES))
    paid = b.postings.filter("min_salary_annual IS NOT NULL")
    return paid.groupBy("salary_currency").agg(F.count(F.lit(1)).alias("rows"), F.sum(usd).alias("usd"))




# One figure asked for among figures of other things: a text and the floor it asks for, `{y}` the figure.
_YEARS_SAID = (
    ("Founded 40 years ago. You bring {y} years of experience", "y"), ("You must be 18 years old. A minimum of {y} yrs building software", "y"), ("This is a {y} year contract", "NULL"),
    ("Celebrating {y} years of excellence", "NULL"), ("A 4-year degree and {y}+ years of experience", "y"), ("Up to {y} years of experience", "0"), ("Shares vest over {y} years", "NULL"),
    ("In the last {y} years we grew", "NULL"), ("Ideally {y} years leading teams", "NULL"), ("{y} to 15 years of experience in sales", "y"),
)
_Y = "CAST(1 + o_custkey % 12 AS INT)"


def _cases(texts) -> str:
    return "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


@query("experience_of_statements", f"""
    SELECT o_orderkey, CAST({_cases([_Y if want == 'y' else want for _, want in _YEARS_SAID])} AS INT) AS min_years,
           CAST(CASE o_orderkey % 10 WHEN 5 THEN {_Y} WHEN 9 THEN 15 END AS INT) AS max_years FROM orders""")
def _experience_of_statements(b):
    said = _cases(["'" + text.replace("{y}", f"' || CAST({_Y} AS STRING) || '") + "'" for text, _ in _YEARS_SAID])
    rows = b.sql(f"SELECT o_orderkey, 'We build tools. ' || {said} || '. Join us.' AS description, 'Clerk' AS title, CAST(NULL AS STRING) AS experience FROM {{orders}}")
    return ann.annotate_experience(rows.repartition("o_orderkey")).select("o_orderkey", "min_years", "max_years")
