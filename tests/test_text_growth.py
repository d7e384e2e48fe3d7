"""Work on texts is done once a row: plans that read no text twice, rules that are asked once."""

import re

from pyspark.sql import functions as F

from hirelake.catalog.annotate_queries import vocabulary
from hirelake.functions.phrases import pattern
from hirelake.operators import annotate as ann
from hirelake.operators import experience
from hirelake.rules import derivations as R
from hirelake.sources import web


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_skill_words_are_cut_once_and_meet_the_terms_without_a_shuffle(spark):
    rows = [("a", "Acme", "We use Java, Go,, C++. and machine learning.. Go home"), ("b", None, None), ("c", "", ""), (None, "x", ",Python . ."), ("a", "Acme", "offer visa, visa")]
    df = spark.createDataFrame(rows, "id string, company string, description string").repartition("id")
    found = ann.skill_mentions(df, vocabulary(spark))
    plan = plan_of(found)
    assert plan.count("(description#") == 1
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in found.collect()} == {("a", "java"), ("a", "go"), ("a", "c++"), ("a", "machine learning"), ("a", "visa cards"), (None, "python")}


def test_json_blocks_are_parsed_once(spark):
    block = "<script type='application/ld+json'>{}</script>"
    good = '{"@type": "JobPosting", "title": "Clerk", "jobLocation": [{"address": {"addressLocality": " ", "addressRegion": "Bern", "addressCountry": {"name": "CH"}}}, {"name": "Basel"}, {"address": 7}]}'
    pages = spark.createDataFrame([("p", block.format("{oops") + block.format(good) + block.format("null") + block.format("[1, null]"))], "page_id string, html string")
    found = web.extract_jsonld_postings(pages)
    assert len(re.findall(r"parse_json\(|parseJson", plan_of(found))) == 1
    assert [(r["block"], r["node"], r["title"], r["location"]) for r in found.collect()] == [(1, 0, "Clerk", "Bern, CH; Basel")]


def test_rows_are_not_shuffled_by_place(spark):
    rows = [(i, place, None, "x", None, None, None) for i, place in enumerate(["Berlin, Germany", None, "Zurich", "Nowhere", "Toronto, Canada; London, UK"])]
    df = spark.createDataFrame(rows, "id int, location string, remote boolean, title string, description string, experience string, salary string")
    found = ann.annotate_all(df)
    assert "SortMergeJoin" not in plan_of(found)
    assert {r["id"]: r["countries"] for r in found.collect()} == {0: ["DE"], 1: [], 2: ["CH"], 3: [], 4: ["CA", "GB"]}


def test_a_rule_is_asked_once_of_a_figure(spark):
    text = "You bring up to 3 years of experience. At least 5 - 7 yrs. Less than 9 years' background. 4-year degree. Minimum of two to ten years"
    df = spark.createDataFrame([(text,)], "t string").repartition(1)
    spans = df.select(experience.judged(experience.candidates(F.col("t"))).alias("s"))
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("less than|fewer than") == 1 and plan.count("expertise|track record") == 1 and "translate(" not in plan
    assert [tuple(s) for s in spans.first()["s"]] == [(0, 3, 0, "ceiling"), (5, 7, 1, "implied"), (0, 9, 2, "soft_ceiling"), (2, 10, 4, "implied")]


def test_patterns_pass_over_what_no_phrase_begins_with(spark):
    said = pattern(("new? #_x|# days", "100%|fully r&d", "on-site"))
    assert said.startswith(r"(?i)(?=[") and "z" not in said[: said.index("]")]
    texts = ["New 3 days", "NEW #_x days", "12 days", "112 days", "Fully R&D", "100% r&d", "On site", "onsite", "bon-site", "zzz"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(said), F.col("t").rlike(said.replace(said[4: said.index("]") + 2], ""))).collect()
    assert [a for a, _ in got] == [b for _, b in got] and sum(a for a, _ in got) >= 6


def test_pay_without_a_currency_is_not_scanned_for_one(spark):
    texts = ["Gives 90,000 - 120,000 a year", "From 90,000 - 120,000 usd", "CA$ 90k to 100k", "€50.000", "50.000 - 60.000 €", "Salary 50000", "12 - 18 LPA", "x $45 per hour"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, description string")
    spans = df.select("id", ann.salary_from_text(F.col("description")).alias("s"))
    got = {r["id"]: (r["s"]["lo"], r["s"]["currency"]) if r["s"] else None for r in spans.collect()}
    assert got == {0: None, 1: (90000, "USD"), 2: (90000, "CAD"), 3: None, 4: (50000, "EUR"), 5: (50000, None), 6: (1200000, "INR"), 7: (93600, "USD")}
    assert df.where(F.col("description").rlike(R.CURRENCY_MARK)).count() == 5
