"""Registered queries: streams run over the event and conversation tables until they are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import jobs
from ..streaming.matching import match_subscriptions
from .bindings import NOW
from .registry import query


def _stream(b, table):
    """A test table as a stream, one file of a folder."""
    return b.spark.readStream.schema(b.table(table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(b.sf_dir)


def _run(b, stream, name):
    out = scratch_path(b.spark, name)
    jobs.run_to_table(stream, out, scratch_path(b.spark, name + "-state"))
    return b.spark.read.schema(stream.schema).parquet(out)


@query("stream_dedupe", "SELECT DISTINCT CAST(user_id AS STRING) || event_type AS id FROM events")
def _dedupe(b):
    rows = _stream(b, "events").select(F.concat(F.col("user_id").cast("string"), "event_type").alias("id"), F.col("ts").cast("timestamp").alias("seen"))
    return _run(b, jobs.stream_dedupe(rows, "seen", "60 days"), "dedupe").select("id")


@query("stream_tick_counts", """
    SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, 'b' || CAST(user_id % 60 AS STRING) AS board, event_type AS family, count(*) AS n FROM events
    WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL""")
def _ticks(b):
    """Days the watermark has closed."""
    rows = _stream(b, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("b"), (F.col("user_id") % 60).cast("string")).alias("board"), F.col("event_type").alias("family"))
    return _run(b, jobs.stream_tick_counts(rows), "ticks")


@query("stream_week_flow", """
    WITH d AS (SELECT CAST(range AS DATE) AS until FROM range(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 DAY))
    SELECT CAST(until AS STRING) AS until, event_type AS family, count(*) AS n FROM d JOIN events ON CAST(ts AS DATE) < until AND CAST(ts AS DATE) >= until - 7
    WHERE until <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL""")
def _flow(b):
    rows = _stream(b, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("family"))
    return _run(b, jobs.stream_week_flow(rows), "flow")



_RUNS = "SELECT 'u' || CAST(user_id AS STRING) AS id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS run, bool_or({said}) AS ok FROM events GROUP BY 1, 2"
# A streak is the runs since the last good one.
_STREAKS = "r AS ({runs}), k AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY id ORDER BY run) AS streak FROM r), m AS (SELECT *, row_number() OVER (PARTITION BY id, streak, ok ORDER BY run) AS n, lag(run) OVER (PARTITION BY id ORDER BY run) AS before FROM k)"


@query("stream_grace", f"WITH {_STREAKS.format(runs=_RUNS.format(said='value > 40'))} SELECT id, run, CASE WHEN n % 2 = 0 THEN 'delete' ELSE 'unconfirmed' END AS action FROM m WHERE NOT ok")
def _grace(b):
    run = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    rows = _stream(b, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), run.alias("run"), (F.col("value") > 40).alias("present"))
    return _run(b, jobs.stream_grace(rows), "grace")


@query("stream_strikes", f"""
    WITH {_STREAKS.format(runs=_RUNS.format(said='value > 150'))}
    SELECT id AS board, run, CAST(CASE WHEN ok THEN 0 ELSE n END AS INT) AS strikes,
           CASE WHEN ok THEN 'cleared' WHEN n > 5 AND run - before >= 7 THEN 'reconfirmed' WHEN n >= 5 THEN 'quarantined' ELSE 'struck' END AS verdict FROM m""")
def _strikes(b):
    run = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    outcome = F.when(F.col("value") > 150, "produced").otherwise("gone")
    rows = _stream(b, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("board"), run.alias("run"), outcome.alias("outcome"))
    return _run(b, jobs.stream_strikes(rows, quarantine_at=5), "strikes")


@query("stream_alerts", """
    WITH s AS (SELECT DISTINCT 's-' || event_type AS subscription, event_type AS topic, CASE event_type WHEN 'view' THEN '2024-01-20' ELSE '2024-01-10' END AS watermark FROM events)
    SELECT subscription, CAST(event_id AS STRING) AS id, row_number() OVER (PARTITION BY subscription ORDER BY value DESC, CAST(event_id AS STRING)) AS place FROM events JOIN s ON event_type = topic
    WHERE strftime(ts, '%Y-%m-%d %H:%M:%S') > watermark QUALIFY place <= 30""")
def _alerts(b):
    seen = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    rows = _stream(b, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("topic"), F.col("value").alias("score"), seen.alias("first_seen"))
    topics = b.events.select(F.col("event_type").alias("topic")).distinct()
    subscriptions = topics.select(F.concat(F.lit("s-"), "topic").alias("subscription"), "topic", F.when(F.col("topic") == "view", "2024-01-20").otherwise("2024-01-10").alias("watermark"))
    out = scratch_path(b.spark, "alerts")
    jobs.stream_alerts(rows, subscriptions, out, scratch_path(b.spark, "alerts-state")).awaitTermination()
    return b.spark.read.parquet(f"{out}/sent").select("subscription", "id", "place")


@query("match_subscriptions", """
    SELECT 's-' || CAST(n_nationkey AS STRING) AS subscription, id FROM postings JOIN nation ON ats = lower(n_name)
    WHERE (min_years IS NULL OR min_years <= n_nationkey % 6) AND (n_nationkey % 3 <> 0 OR contains(lower(title), 'engineer'))""")
def _match_subscriptions(b):
    """A stored search a nation, as data."""
    key = F.col("n_nationkey")
    search = F.struct(F.lower("n_name").alias("ats"), (key % 6).cast("int").alias("max_years"), F.when(key % 3 == 0, "engineer").alias("title_words"), F.lit(True).alias("include_non_tech"))
    searches = b.nation.select(F.concat(F.lit("s-"), key.cast("string")).alias("subscription"), F.lit("").alias("watermark"), F.to_json(search).alias("filter"))
    return match_subscriptions(b.postings, searches, NOW).select("subscription", "id")


@query("late_rows", """
    SELECT coalesce(date_diff('day', CAST(ts AS DATE) - CAST(floor(value) AS INT), CAST(ts AS DATE)) > 14, FALSE) AS found_late, count(*) AS n FROM events GROUP BY 1""")
def _late(b):
    day = F.col("ts").cast("date")
    rows = _stream(b, "events").select("event_id", day.cast("string").alias("first_seen"), F.date_sub(day, F.floor("value").cast("int")).cast("string").alias("posted_at"))
    flagged = _run(b, jobs.late_rows(rows), "late")
    return flagged.groupBy("found_late").agg(F.count("*").alias("n"))
