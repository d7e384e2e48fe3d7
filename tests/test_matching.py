"""Stored searches matched as data, against each search compiled on its own."""

import json
import random

import pytest

from hirelake.operators.filters import apply_filter
from hirelake.session import scratch_path
from hirelake.streaming.jobs import deliver_alerts
from hirelake.streaming.matching import match_subscriptions, parse_search

NOW = "2026-02-01T00:00:00+00:00"
SCHEMA = ("id string, ats string, title string, description string, remote boolean, min_years int, employment_type string, countries array<string>, places array<string>, stances array<string>, family string, "
          "min_salary_annual int, posted_at string, first_seen string, is_confident_non_tech boolean, score double")


def batch_rows(n=300):
    rng = random.Random(3)
    pick = lambda *xs: rng.choice(xs)
    return [(
        f"{pick('lever', 'ashby')}:B{rng.randrange(6)}:{i}", pick("lever", "ashby", None), pick("Senior Java Developer", "JavaScript Engineer", "C++ Developer", "Nurse", None, "Data-Engineer (Go)", "Java, Go"),
        pick("We use Java and Go.", "Python shop", None, "C++ only"), pick(True, False, None), pick(None, 0, 2, 5, 12, 50), pick("Full time", "Part-time", "Contract", None, "Internship"),
        pick([], ["DE"], ["US", "DE"], None), pick([], ["bengaluru", "karnataka"]), pick([], ["offers_sponsorship"], ["may_offer_sponsorship"], ["refuses_sponsorship"]), pick("data", "backend", None),
        pick(None, 50_000), pick(None, "2026-01-10T00:00:00Z", "2026-01-30", "21-Apr-2026"), pick(None, "2026-01-05T00:00:00+00:00", "2026-01-31T12:00:00+00:00"), pick(None, True, False), float(i),
    ) for i in range(n)]


def searches(n=80):
    rng = random.Random(4)
    options = {
        "remote": [True, False], "max_years": [0, 2, 5, 60], "ats": ["lever", "ashby", "none"], "etype": ["full-time", "contract", "internship"], "country": ["Germany", "US"], "india": ["Bengaluru"],
        "boards": [["lever:b1", "ASHBY:B2"], []], "kw": ["java", "c++", '"senior java"', "go dev", "+"], "kw_in": ["both", "description", "title"], "title_words": ["java", "data engineer"], "has_salary": [True],
        "posted_after": ["2026-01-15"], "posted_before": ["2026-01-15"], "posted_within": [10], "seen_within": [24], "seen_after": ["2026-01-20"], "first_seen_after": ["2026-01-10T00:00:00+00:00"],
        "required_years_at_least": [3], "work_authorization": ["may_offer_sponsorship", "refuses_sponsorship"], "include_non_tech": [True], "family": ["data"], "posted_sortable": [True],
    }
    out = [{}, {"include_non_tech": True}]
    while len(out) < n:
        keys = rng.sample(sorted(options), rng.randrange(1, 4))
        out.append({k: rng.choice(options[k]) for k in keys})
    return out


def as_table(spark, filters):
    return spark.createDataFrame([(f"s{i}", "", json.dumps(f)) for i, f in enumerate(filters)], "subscription string, watermark string, filter string")


def test_equals_each_search_compiled(spark):
    batch = spark.createDataFrame(batch_rows(), SCHEMA).repartition(3).cache()
    filters = searches()
    got = {}
    for r in match_subscriptions(batch, as_table(spark, filters), NOW).select("subscription", "id").collect():
        got.setdefault(r["subscription"], []).append(r["id"])
    known = ("lever", "ashby", "none")
    for i, f in enumerate(filters):
        want = sorted(r["id"] for r in apply_filter(batch, f, NOW, ats=known).select("id").collect())
        assert sorted(got.get(f"s{i}", [])) == want, f


def test_the_plan_does_not_grow_with_the_subscriptions(spark):
    batch = spark.createDataFrame(batch_rows(40), SCHEMA)
    few, many = as_table(spark, searches(10)), as_table(spark, searches(10) * 1000)
    operators = lambda table: match_subscriptions(batch, table, NOW)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert operators(few) == operators(many)
    assert match_subscriptions(batch, many, NOW).count() == 1000 * match_subscriptions(batch, few, NOW).count()


def test_refused_searches_and_empty_tables(spark):
    columns = frozenset(["id", "title"])
    for bad in ({"colour": "red"}, {"salary_min": 5}, {"remote": True}, {"country": "Nowhereland"}):
        with pytest.raises(ValueError):
            parse_search(bad, NOW, columns if "country" not in bad else columns | {"countries"})
    batch = spark.createDataFrame(batch_rows(5), SCHEMA)
    assert match_subscriptions(batch.limit(0), as_table(spark, [{}]), NOW).count() == 0
    assert match_subscriptions(batch, as_table(spark, [{}]).limit(0), NOW).count() == 0


def test_delivered_by_stored_searches(spark):
    path, batch = scratch_path(spark, "alerts"), spark.createDataFrame(batch_rows(50), SCHEMA).where("first_seen IS NOT NULL")
    table = as_table(spark, [{"remote": True}, {"ats": "lever"}])
    deliver_alerts(batch, table, path, 0, now=NOW)
    deliver_alerts(batch, table, path, 1, now=NOW)
    sent = spark.read.parquet(f"{path}/sent")
    want = match_subscriptions(batch, table, NOW).count()
    assert sent.count() == want > 0 and sent.where("batch = 1").count() == 0
