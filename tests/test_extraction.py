"""Sentences and the spans they state."""

import pytest
from pyspark.sql import functions as F

from hirelake.operators import annotate as ann
from hirelake.operators.stances import annotate_stances
from hirelake.operators import clean, filters
from hirelake.sources import web


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


EXPERIENCE = [
    (None, "You bring 3-5 years of relevant experience.", "Engineer", (3, 5, "regex")),
    (None, "At least five years of experience with Go.", "Engineer", (5, None, "regex")),
    (None, "10 years of experience, or 6+ yrs experience with a degree.", "Engineer", (6, None, "regex")),
    (None, "Experience of 4 years in sales.", "Engineer", (4, None, "regex")),
    (None, "Founded 12 years ago. Great team.", "Senior Engineer", (5, None, "seniority")),
    (None, "Up to 2 years experience.", "Engineer", (0, 2, "regex")),
    ("24 months", "10 years of experience.", "Engineer", (2, None, "field")),
    ("3 to 99", None, "Engineer", (3, None, "field")),
    ("45", None, "Junior Engineer", (0, None, "seniority")),
    (None, None, "Software Engineer II", (3, None, "seniority")),
    (None, "Nothing said.", "Accountant", (None, None, None)),
]


def test_experience_cascade(spark):
    df = rows(spark, [(i, e, d, t, None) for i, (e, d, t, _) in enumerate(EXPERIENCE)], "id int, experience string, description string, title string, company string")
    got = {r["id"]: (r["min_years"], r["max_years"], r["experience_source"]) for r in ann.annotate_experience(df).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(EXPERIENCE)}


def test_company_ladder_and_floors(spark):
    df = rows(spark, [(1, None, "5 years of experience, or 3 years of experience.", "Engineer", "x"), (2, None, None, "Software Engineer (L6)", "Netflix")],
              "id int, experience string, description string, title string, company string")
    got = {r["id"]: r for r in ann.annotate_experience(df).collect()}
    assert got[1]["stated_floors"] == [3, 5]
    assert got[2]["min_years"] == 9


SALARY = [
    ("80000-100000 USD 1 YEAR", None, (80000, 100000, "USD", "field")),
    ("15-17.5 GBP HOUR", None, (31200, 37440, "GBP", "field")),
    ("12 - 18 lakh INR", None, (1200000, 1800000, "INR", "field")),
    ("49.000 EUR", None, (49000, None, "EUR", "field")),
    (None, "Salary: $120,000 - $150,000 per year.", (120000, 150000, "USD", "regex")),
    (None, "Salary: 40.000 € - 50.000 €.", (40000, 50000, "EUR", "regex")),
    (None, "CTC 12-18 LPA for this role.", (1200000, 1800000, "INR", "regex")),
    (None, "We raised $50,000,000 in funding. Our bonus is $5,000.", (None, None, None, None)),
    (None, "Pay: $100,000. Later: salary: $180,000.", (None, None, None, None)),
    (None, "Pay $25/hour at our site.", (52000, None, "USD", "regex")),
    (None, "Pays $90k - $120k.", (90000, 120000, "USD", "regex")),
    ("competitive", "No figure.", (None, None, None, None)),
]


def test_salary_cascade(spark):
    df = rows(spark, [(i, s, d) for i, (s, d, _) in enumerate(SALARY)], "id int, salary string, description string")
    got = {r["id"]: (r["min_salary_annual"], r["max_salary_annual"], r["salary_currency"], r["salary_source"]) for r in ann.annotate_salary(df).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(SALARY)}


def test_small_rupee_figure_abroad_is_dropped(spark):
    df = rows(spark, [(1, "INR 200000", ["DE"]), (2, "INR 200000", ["IN"]), (3, "INR 200000", [])], "id int, salary string, countries array<string>").withColumn("description", F.lit(None).cast("string"))
    got = {r["id"]: r["min_salary_annual"] for r in ann.annotate_salary(df).collect()}
    assert got == {1: None, 2: 200000, 3: 200000}


COUNTRIES = [
    ("Berlin, Germany", ["DE"]), ("Berlin, CT, US", ["US"]), ("London, ON", ["CA"]), ("Dublin", ["IE"]), ("Dublin, OH", ["US"]), ("Toronto, ON, CA", ["CA"]),
    ("Remote - US", ["US"]), ("Casablanca", ["MA"]), ("Castle Rock, CO", ["US"]), ("London; Paris", ["FR"]), ("Bangalore", ["IN"]), (None, []),
]


def test_countries(spark):
    df = rows(spark, [(i, loc) for i, (loc, _) in enumerate(COUNTRIES)], "id int, location string")
    got = {r["id"]: r["countries"] for r in ann.annotate_country(df).collect()}
    assert got[0] == ["DE"] and got[1] == ["US"] and got[4] == ["US"] and got[3] == ["IE"] and got[7] == ["MA"] and got[11] == []
    for i, (_, want) in enumerate(COUNTRIES):
        if i not in (9,):
            assert got[i] == want, COUNTRIES[i]


REMOTE = [
    (None, "This role is fully remote.", True), (False, "Remote work is not available here. We are remote-first elsewhere.", False), (None, "We use remote desktop tools.", None),
    (None, "#LI-Remote", True), (True, "This is an on-site position.", True), (None, "A hybrid schedule; we are remote-friendly.", None),
]


def test_remote_ladder(spark):
    df = rows(spark, [(i, r, d) for i, (r, d, _) in enumerate(REMOTE)], "id int, remote boolean, description string")
    assert {r["id"]: r["remote"] for r in ann.annotate_remote(df).collect()} == {i: w for i, (*_, w) in enumerate(REMOTE)}


@pytest.mark.parametrize(("text", "want"), [("San JosÃ©", "San José"), ("SÃO PAULO", "SÃO PAULO"), ("Zürich", "Zürich"), ("Âge", "Âge"), ("plain", "plain"), ("MÃ¼nchen", "München")])
def test_mojibake(spark, text, want):
    assert rows(spark, [(text,)], "t string").select(clean.repair_mojibake(F.col("t")).alias("t")).first()["t"] == want


def test_html_and_places(spark):
    df = rows(spark, [("<p>A&amp;B &lt;i&gt;</p><script>x</script>", "Berlin, Germany, Germany; berlin, germany; BLANK")], "h string, p string")
    got = df.select(clean.html_to_text(F.col("h")).alias("h"), clean.tidy_location(F.col("p")).alias("p")).first()
    assert got["h"] == "A&B" and got["p"] == "Berlin, Germany"


END = [
    ("Applications close on 17th of December 2025.", "2025-12-17"), ("Apply by: December 3, 2026 or closing date 2026-12-11.", "2026-12-11"), ("Deadline 25/09/2026", "2026-09-25"),
    ("Deadline 5/10/2026", None), ("We close on Fridays.", None), ("Closing date: 1 May 1999", None),
]


def test_stated_end(spark):
    df = rows(spark, [(i, t) for i, (t, _) in enumerate(END)], "id int, description string")
    got = {r["id"]: r["end_day"] and r["end_day"].isoformat() for r in ann.stated_end_date(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(END)}


STANCES = [
    ("We offer visa sponsorship.", "Engineer", None, ["offers_sponsorship"]), ("We may offer visa sponsorship case by case.", "Engineer", None, ["may_offer_sponsorship"]),
    ("We do not offer sponsorship. Relocation assistance is provided.", "Engineer", None, ["offers_relocation", "refuses_sponsorship"]),
    ("Visa sponsorship is available for full-time employees.", "Engineer", "Internship", []), ("Executive sponsors matter.", "Engineer", None, []),
]


def test_stances(spark):
    df = rows(spark, [(i, d, t, e) for i, (d, t, e, _) in enumerate(STANCES)], "id int, description string, title string, employment_type string")
    assert {r["id"]: r["stances"] for r in annotate_stances(df).collect()} == {i: w for i, (*_, w) in enumerate(STANCES)}


TYPES = [("FT", None, {"is_full_time"}), ("software", None, {"is_full_time"}), ("parttime_permanent", None, {"is_part_time"}), ("International", None, {"is_full_time"}),
         (None, "Internal Auditor", {"is_full_time"}), ("Full time", "Data Intern", {"is_full_time", "is_internship"}), ("Regular Part-Time", None, {"is_part_time"}), ("Second Shift (afternoon)", None, {"is_full_time"})]


def test_employment_types(spark):
    df = rows(spark, [(i, e, t) for i, (e, t, _) in enumerate(TYPES)], "id int, employment_type string, title string")
    out = ann.annotate_employment(df).collect()
    assert {r["id"]: {c for c in ("is_full_time", "is_part_time", "is_contract", "is_internship") if r[c]} for r in out} == {i: w for i, (*_, w) in enumerate(TYPES)}


def test_skills_longest_case_list_and_neighbours(spark):
    vocab = rows(spark, [("Go", "go", True, True, None), ("machine learning", "machine learning", False, False, None), ("learning", "learning", False, False, None), ("React", "react", False, False, "to"), ("Acme DB", "acme", False, False, None)],
                 "term string, skill string, exact_case boolean, list_only boolean, not_after string")
    df = rows(spark, [(1, "Acme", "We use Java, Go, machine learning. React well to React. Acme DB."), (2, "X", "go on, we Go there, learning")], "id int, company string, description string")
    got = {(r["id"], r["skill"]) for r in ann.skill_mentions(df, vocab).collect()}
    assert got == {(1, "go"), (1, "machine learning"), (1, "react"), (2, "learning")}


def test_jsonld(spark):
    html = """<script type="application/ld+json">{bad</script><script type='application/ld+json'>
      {"@graph":[{"@type":["Thing","JobPosting"],"title":"T","employmentType":"FULL_TIME","jobLocationType":"TELECOMMUTE","hiringOrganization":"Org",
      "jobLocation":[{"address":{"addressLocality":"Berlin","addressCountry":{"name":"Germany"}}},{"address":"Paris"}]},{"@type":"Person"}]}</script>"""
    pages = rows(spark, [(1, html), (2, "<p>none</p>")], "page_id int, html string")
    got = web.extract_jsonld_postings(pages).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["title"], r["employment_type"], r["company"], r["remote"], r["location"]) == ("T", "FULL_TIME", "Org", True, "Berlin, Germany; Paris")
    assert [p["page_id"] for p in web.jsonld_problems(pages).collect()] == [1]


def test_filter_refuses_unknown(spark):
    df = rows(spark, [("a:b:1", "x")], "id string, ats string")
    with pytest.raises(ValueError):
        filters.apply_filter(df, {"nonsense": 1}, "2026-01-01T00:00:00+00:00")
    with pytest.raises(ValueError):
        filters.apply_filter(df, {"ats": "nowhere"}, "2026-01-01T00:00:00+00:00", ats=("x",), strict=True)
    assert filters.apply_filter(df, {"ats": "nowhere"}, "2026-01-01T00:00:00+00:00", ats=("x",)).count() == 1


def test_wildcards_are_literal(spark):
    df = rows(spark, [("a", "100% Co"), ("b", "1000 Co")], "id string, company string")
    got = [r["id"] for r in filters.apply_filter(df, {"company": "100%"}, "2026-01-01T00:00:00+00:00").collect()]
    assert got == ["a"]


def test_may_offer_keeps_firm_offers(spark):
    df = rows(spark, [("a", ["offers_sponsorship"]), ("b", ["may_offer_sponsorship"]), ("c", [])], "id string, stances array<string>")
    kept = lambda asked: [r["id"] for r in filters.apply_filter(df, {"work_authorization": asked}, "2026-01-01T00:00:00+00:00").collect()]
    assert kept("may_offer_sponsorship") == ["a", "b"]
    assert kept("offers_sponsorship") == ["a"]


WORLD = [
    ("Warsaw, Poland", ["PL"]), ("São Paulo", ["BR"]), ("Milan, Italy", ["IT"]), ("Dubai", ["AE"]), ("Santa Fe, New Mexico", ["US"]), ("Mexico City, Mexico", ["MX"]), ("Seoul, Korea", ["KR"]), ("Atlanta, Georgia", ["US"]),
    ("Tbilisi, Georgia", ["GE"]), ("Belfast, Northern Ireland", ["GB"]), ("Cork, Ireland", ["IE"]), ("Cali, Colombia", ["CO"]), ("Amman, Jordan", ["JO"]), ("Ho Chi Minh City", ["VN"]), ("Louvain-la-Neuve, Belgium", ["BE"]),
    ("Vienna, VA", ["US"]), ("Wien", ["AT"]), ("Kinshasa, Democratic Republic of the Congo", ["CD"]), ("Springfield, IL, US", ["US"]), ("Berlin, NJ, USA", ["US"]),
]


def test_countries_of_the_world(spark):
    df = rows(spark, list(enumerate(loc for loc, _ in WORLD)), "id int, location string")
    got = {r["id"]: r["countries"] for r in ann.annotate_country(df).collect()}
    assert {WORLD[i][0]: c for i, c in got.items()} == dict(WORLD)


def test_asked_countries():
    from hirelake.operators.filters import country_code

    asked = {"gb": "GB", "U.K.": "GB", "Great Britain": "GB", "USA": "US", "united states of america": "US", "UAE": "AE", "Türkiye": "TR", "Turkey": "TR", "India": "IN", "Poland": "PL", "PL": "PL", "Brazil": "BR", "Deutschland": None, "America": None, "": None, "Atlantis": None}
    assert {a: country_code(a) for a in asked} == asked


def test_a_skill_of_four_words_and_covered_terms(spark):
    vocab = rows(spark, [(t, t, False, False, None) for t in ("natural language processing engineering", "language processing", "java", "java virtual machine")],
                 "term string, skill string, exact_case boolean, list_only boolean, not_after string")
    df = rows(spark, [(1, None, "We do Natural Language Processing Engineering and Java."), (2, "x", "language processing; the java virtual machine"), (3, None, None), (4, None, "")], "id int, company string, description string")
    got = {(r["id"], r["skill"]) for r in ann.skill_mentions(df, vocab).collect()}
    assert got == {(1, "natural language processing engineering"), (1, "java"), (2, "language processing"), (2, "java virtual machine")}


def test_filters_refuse_what_they_cannot_answer(spark):
    from hirelake.operators import filters as flt

    now = "2026-01-01T00:00:00+00:00"
    caps = flt.Capabilities(frozenset(["id", "title", "company", "location"]))
    for asked in ({"country": "DE"}, {"india": "pune"}, {"work_authorization": "offers_sponsorship"}, {"seen_within": 24}, {"operators": ["x"]}, {"family": "x"}, {"kw": "java", "kw_in": "description"},
                  {"kw": "one two three four five six"}, {"kw": "x" * 61}, {"company": "x" * 61}, {"location": "x" * 61}):
        with pytest.raises(ValueError):
            flt.filter_clauses(asked, caps, now)
    table = rows(spark, [(1, ["DE"]), (2, [])], "id int, countries array<string>")
    assert flt.apply_filter(table, {"country": "Atlantis"}, now).count() == 0
    with pytest.raises(ValueError):
        flt.apply_filter(table, {"country": "Atlantis"}, now, strict=True)


def test_pages_of_any_size():
    from hirelake.operators.rank import page_bounds

    assert page_bounds(1000, 30) == (1000, 29_000) and page_bounds(None, None) == (20, 0)
    with pytest.raises(ValueError):
        page_bounds(0, 1)


PAY_FIELDS = [
    ("JPY 8,000,000 per year", "ashby", (8_000_000, None, "JPY")), ("HUF 12,000,000 per year", None, (12_000_000, None, "HUF")), ("PHP 2,160,000 per year", "x", (2_160_000, None, "PHP")),
    ("COP 120,000,000 per year", "x", (120_000_000, None, "COP")), ("5000-7000 SGD 1 MONTH", "smartrecruiters", (60_000, 84_000, "SGD")), ("10500 RON 1 MONTH", "smartrecruiters", (126_000, None, "RON")),
    ("150000-190000 NZD per year", "recruitee", (150_000, 190_000, "NZD")), ("PHP 19000-20000 yearly", "personio", None), ("25000-31000 SAR YEAR", "teamtailor", None), ("USD 1,500,000 per year", "x", None),
    ("30000-40000 INR", "zoho", (360_000, 480_000, "INR")), ("110K+ INR", "zoho", (1_320_000, None, "INR")), ("300K INR", "zoho", None), ("50K INR", "x", None), ("50K INR per month", "x", (600_000, None, "INR")), ("100000-120000 INR", "zoho", (100_000, 120_000, "INR")), ("27500-45000 ZAR", "zoho", None), ("40000 or depends on the skill sets INR", "zoho", None), ("18000 to 21000 AED", "zoho", (216_000, 252_000, "AED")), ("30000-40000 INR", "lever", None), ("40000-50000 MXN 1 MONTH", "smartrecruiters", (480_000, 600_000, "MXN")),
]


def test_pay_fields_by_currency_and_source(spark):
    df = rows(spark, [(i, s, a) for i, (s, a, _) in enumerate(PAY_FIELDS)], "id int, salary string, ats string").withColumn("description", F.lit(None).cast("string"))
    got = {r["id"]: r["salary_currency"] and (r["min_salary_annual"], r["max_salary_annual"], r["salary_currency"]) for r in ann.annotate_salary(df).collect()}
    assert {PAY_FIELDS[i][:2]: v for i, v in got.items()} == {(s, a): w for s, a, w in PAY_FIELDS}
