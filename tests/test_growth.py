"""Steps that must grow no faster than their input."""

import random
import time

import pytest

from pyspark.sql import functions as F

from hirelake.operators import aggregate as agg
from hirelake.operators import boards as brd
from hirelake.session import cut_lineage
from hirelake.streaming import matching
from hirelake.streaming.matching import match_subscriptions


def _profiles(spark, names):
    rows = [(i, "engineer", words.split(" ")[0], name, words, "berlin", "DE", "1/2/EUR", {"ord": i, "id": f"p{i}"}) for i, (name, words) in enumerate(names)]
    return spark.createDataFrame(rows, "_p long, _stem string, _head string, _name string, _words string, _place string, _countries string, _pay string, first struct<ord:int,id:string>")


def test_names_that_only_share_a_first_word_never_meet(spark):
    """Before, all names of a block were paired with each other."""
    alone = [(f"customer#{i}", f"customer {i}") for i in range(500)]
    met = [("acme", "acme"), ("acme cloud", "acme cloud"), ("acme gmbh", "acme"), ("acmes", "acmes")]
    related = brd._related_names(_profiles(spark, alone + met))
    assert {r["_name"] for r in related.collect()} == {"acme", "acme cloud", "acme gmbh"}


def test_earliest_leader_of_another_name(spark):
    profiles = _profiles(spark, [("b", "b"), ("b gmbh", "b"), ("b", "b"), ("b labs", "b labs"), ("c labs", "c labs")])
    leaders = profiles.groupBy("_stem", "_head", "_name").agg(F.min(F.struct("first", "_words", "_place", "_countries", "_pay")).alias("l"))
    got = {r["_p"]: r["_to"]["id"] for r in brd._earliest_leader(profiles, leaders).collect()}
    assert got == {1: "p0", 2: "p1", 3: "p0"}


def test_requirement_summary_reads_its_rows_once(spark):
    """Before, each section computed the whole sample anew."""
    seen = spark.sparkContext.accumulator(0)

    def place(i):
        seen.add(1)
        return i

    rows = spark.range(40).select(
        F.col("id").cast("string").alias("id"), F.udf(place, "long")("id").alias("ord"), F.concat(F.lit("b"), F.col("id") % 3).alias("board"), F.concat(F.lit("Firm "), F.col("id") % 5).alias("company"),
        F.lit(3).alias("min_years"), F.lit("field").alias("experience_source"), F.lit(10).alias("min_salary_annual"), F.lit(20).alias("max_salary_annual"), F.lit("EUR").alias("salary_currency"),
        F.lit(True).alias("remote"), F.array(F.lit("DE")).alias("countries"), F.array(F.lit("offers_relocation")).alias("stances"))
    got = {(r["section"], r["name"]): r["n"] for r in agg.requirement_summary(rows, per_company=2).collect()}
    assert got[("sample", "counted")] == 10 and got[("company", "firm 0")] == 8 and got[("country", "DE")] == 10
    assert seen.value == 40


def test_matched_rows_are_not_sent_through_the_driver(spark, capsys):
    """Before, the whole batch with its tokens was broadcast."""
    batch = spark.range(60).select(F.concat(F.lit("a:b:"), "id").alias("id"), F.concat(F.lit("a"), F.col("id") % 3).alias("ats"), F.lit("Data Engineer").alias("title"))
    searches = spark.createDataFrame([("one", "", '{"ats": "a1", "include_non_tech": true}'), ("all", "", "{}")], "subscription string, watermark string, filter string")
    got = match_subscriptions(batch, searches, "2024-01-01T00:00:00+00:00")
    got.explain()
    assert "SortMergeJoin [_row#" in capsys.readouterr().out
    assert sorted(r["subscription"] for r in got.collect()) == ["all"] * 60 + ["one"] * 20


def test_tokens_of_rows_are_not_sent_through_the_driver(spark, capsys, monkeypatch):
    """Before, Spark took all tokens of the rows for smaller than the searches, as it went by the rows' files, and broadcast them."""
    batch = spark.range(60).select(F.concat(F.lit("a:b:"), "id").alias("id"), F.concat(F.lit("a"), F.col("id") % 3).alias("ats"), F.lit("Data Engineer").alias("title"))
    rows = [("one", "", '{"ats": "a1", "title_words": "engineer"}'), ("all", "", "{}"), ("none", "", '{"ids": []}'), (None, "", "{}")]
    searches = spark.createDataFrame(rows, "subscription string, watermark string, filter string")
    for most, built in ((100_000, "BuildRight"), (3, "")):
        monkeypatch.setattr(matching, "_MOST_SENT", most)
        got = match_subscriptions(batch, searches, "2024-01-01T00:00:00+00:00")
        got.explain()
        plan = capsys.readouterr().out
        assert "BuildLeft" not in plan and ("BroadcastExchange" in plan) == bool(built) and built in plan
        assert sorted(r["subscription"] for r in got.collect()) == ["all"] * 60 + ["one"] * 20


def _sets(spark, sets):
    return spark.createDataFrame([("g", b, i) for b, ids in sets.items() for i in ids], "group string, board string, id string")


def test_boards_of_one_fingerprint_are_told_apart(spark):
    """Where all sets are equal they are counted together; else each is compared with its canonical, and unknown ids equal none."""
    ids = _sets(spark, {"a": "12", "b": "12", "c": "13", "d": ["1", None], "e": ["1", None], "x": "12", "y": "12"})
    pairs = spark.createDataFrame([("g", b, c, 2) for b, c in (("b", "a"), ("c", "a"), ("e", "d"), ("y", "x"))], "group string, board string, canonical string, size long")
    assert {(r["board"], r["canonical"]) for r in brd._equal_verified(ids, pairs).collect()} == {("b", "a"), ("y", "x")}


def test_equal_sets_are_joined_to_their_ids_once(spark, capsys):
    """Before, the ids were made distinct three times and joined with themselves."""
    got = brd.equal_set_aliases(_sets(spark, {"a": "12", "b": "121", "c": "13"}))
    got.explain()
    assert "_shared" not in capsys.readouterr().out and [tuple(r) for r in got.collect() if r["board"] == "b"] == [("g", "b", "a")]
    assert got.count() == 1


@pytest.mark.parametrize("most,public", [(1000, False), (0, True)])
def test_contained_boards_equal_brute_force(spark, monkeypatch, capsys, most, public):
    """With ids that all share, rarest ids of boards that contain nothing, unknown ids and repeated rows. Before, the ids were
    joined with themselves in the answer's own plan, beside the shuffle files of all steps before."""
    monkeypatch.setattr(brd, "_MOST_SENT", most)
    rng = random.Random(5)
    sets = {f"b{i}" + rng.choice(["", "/internal"]): {"0", *(str(rng.randrange(1, 7)) for _ in range(rng.randrange(6)))} for i in range(40)} | {"n1": {None}, "n2": {None, "1"}, "n3": {"1", "7"}, "n4": {"7", "8", None}, "n5": {"8"}}
    rows = [(g, b, i) for g in ("g", "h") for b, ids in sets.items() for i in ids if g == "g" or b > "b2"]
    want = set()
    for g in ("g", "h"):
        own = {b: {i for x, y, i in rows if (x, y) == (g, b)} for b in sets}
        hidden = {r["b"] for r in spark.createDataFrame([(b,) for b in sets], "b string").filter(brd.is_non_public(F.col("b"))).collect()} if public else set()
        for b, ids in own.items():
            onto = [(-len(o), c) for c, o in own.items() if ids and None not in ids and c not in hidden and (ids < o or ids == o and (c < b or b in hidden and c != b))]
            if onto:
                want.add((g, b, min(onto)[1]))
    got = brd.bury_contained(spark.createDataFrame(rows + rows, "group string, board string, id string"), keep_public=public)
    got.explain()
    assert "_shared" not in capsys.readouterr().out
    assert {tuple(r) for r in got.collect()} == want


def test_shuffle_files_of_a_written_table_go(spark):
    """Before, they stayed until the driver happened to collect its garbage."""
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("/shuffle_")
    before = files()
    assert cut_lineage(spark.range(100).repartition(4, "id").distinct(), tidy=True).count() == 100
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.2)
    # What the count wrote is one file and its index at most.
    assert files() <= before + 2
