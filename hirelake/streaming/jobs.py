"""Streaming forms of the run-to-run state. Each gives its batch operator's answer on the same input."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.filters import capabilities, compile_filter
from ..plans.ticks import is_found_late
from ..rules.boards import PAROLE_DAYS, QUARANTINE_AT
from ..session import cut_lineage
from .matching import match_subscriptions


def stream_dedupe(postings: DataFrame, event_time: str, within: str = "7 days") -> DataFrame:
    """First sight of an id wins; its state is forgotten once the watermark passes `within`."""
    return postings.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["id"])


def stream_tick_counts(events: DataFrame, event_time: str = "ts", late: str = "1 day") -> DataFrame:
    """`(day, board, family, n)`: a tick's counts per board and family."""
    day = F.window(event_time, "1 day")
    return events.withWatermark(event_time, late).groupBy(day.alias("w"), "board", "family").agg(F.count("*").alias("n")).select(
        F.col("w.start").cast("date").cast("string").alias("day"), "board", "family", "n"
    )


def stream_week_flow(events: DataFrame, event_time: str = "ts", late: str = "1 day") -> DataFrame:
    """`(until, family, n)`: the trailing week's flow, moved on a day at a time."""
    week = F.window(event_time, "7 days", "1 day")
    return events.withWatermark(event_time, late).groupBy(week.alias("w"), "family").agg(F.count("*").alias("n")).select(
        F.col("w.end").cast("date").cast("string").alias("until"), "family", "n"
    )


GRACE_OUT = "id string, run long, action string"


def stream_grace(reads: DataFrame) -> DataFrame:
    """Two-miss eviction. `reads`: id, run, present, one row or more per held id of a board read that
    run (present in one is present); a board not read sends none, so its ids keep their state. The
    state is one counter an id, so a board of any size spreads over every task, and an id that was
    seen or evicted keeps none."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        misses, last = state.get if state.exists else (0, -1)
        out = []
        rows = pd.concat(list(batches)).groupby("run")["present"].any()
        for run, present in rows.sort_index().items():
            if run <= last:
                continue  # a run already counted, sent again
            last = int(run)
            misses = 0 if present else misses + 1
            if misses:
                out.append((key[0], last, "delete" if misses >= 2 else "unconfirmed"))
            misses = misses % 2
        if misses:
            state.update((misses, last))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["id", "run", "action"])

    return reads.groupBy("id").applyInPandasWithState(step, GRACE_OUT, "misses int, last long", "append", GroupStateTimeout.NoTimeout)


STRIKES_OUT = "board string, run long, strikes int, verdict string"


def stream_strikes(outcomes: DataFrame, quarantine_at: int = QUARANTINE_AT, parole_days: int = PAROLE_DAYS, runs_a_day: int = 1, timers: bool = False) -> DataFrame:
    """Consecutive-failure streaks. `outcomes`: board, run, outcome (gone or produced). Any output
    clears the streak; a quarantined board is paroled once its verdict is a week of runs old, which
    `timers` also reports when no outcome arrives."""
    span = parole_days * runs_a_day

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        strikes, last = state.get if state.exists else (0, -1)
        if state.hasTimedOut:
            yield pd.DataFrame([(key[0], last + span, strikes, "paroled")], columns=["board", "run", "strikes", "verdict"])
            return
        out = []
        rows = pd.concat(list(batches)).groupby("run")["outcome"].agg(lambda o: "produced" if (o == "produced").any() else "gone")
        for run, outcome in rows.sort_index().items():
            if outcome == "produced":
                strikes, last = 0, int(run)
                out.append((key[0], int(run), 0, "cleared"))
                continue
            paroled = strikes >= quarantine_at and run - last >= span
            strikes, last = strikes + 1, int(run)
            verdict = "reconfirmed" if paroled else "quarantined" if strikes >= quarantine_at else "struck"
            out.append((key[0], int(run), strikes, verdict))
        if strikes:
            state.update((strikes, last))
        elif state.exists:
            state.remove()  # a board that produces needs no state
        if timers and strikes >= quarantine_at:
            state.setTimeoutDuration(parole_days * 86_400_000)
        yield pd.DataFrame(out, columns=["board", "run", "strikes", "verdict"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    return outcomes.groupBy("board").applyInPandasWithState(step, STRIKES_OUT, "strikes int, last long", "append", timeout)


def late_rows(stream: DataFrame, days: int = 14) -> DataFrame:
    """Rows found long after their posting date, flagged rather than dropped."""
    return stream.withColumn("found_late", is_found_late(days))


def deliver_alerts(batch: DataFrame, subscriptions: DataFrame, delivered: str, batch_id: int, cap: int = 30, filters: Mapping[str, Mapping] | None = None, now: str | None = None) -> None:
    """One micro-batch of alerts: each row once a subscription, best `cap` a batch.

    `batch`: id, score, first_seen and what the criteria read. `subscriptions`: subscription, watermark
    (rows first seen after it are wanted) and topic. A subscription takes the rows its compiled search
    filter keeps, or those of its topic. The filters are JSON in a column `filter` of the subscriptions, of which there may
    be any number (`match_subscriptions`), or a few given as `filters`, by subscription.

    What a subscription was sent is known by id, so a row that arrives late or out of order is still
    sent, once. Rows past the cap wait beside the delivered ones and compete in the next batch. Both
    are partitions of the batch, so a retried batch overwrites its own and changes nothing else.
    """
    spark = batch.sparkSession
    wanted = _matches(batch, subscriptions, filters, now).filter(F.col("first_seen") > F.col("watermark")).select(*_ALERT)
    waiting = _alert_rows(spark, f"{delivered}/waiting", F.col("batch") == batch_id - 1)
    if waiting is not None:
        wanted = wanted.unionByName(waiting.select(*_ALERT))
    sent = _alert_rows(spark, f"{delivered}/sent", F.col("batch") < batch_id)
    best = wanted.groupBy("subscription", "id").agg(F.max(F.struct("score", "first_seen")).alias("_b")).select("subscription", "id", "_b.score", "_b.first_seen")
    if sent is not None:
        best = best.join(sent.select("subscription", "id"), ["subscription", "id"], "left_anti")
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("subscription").orderBy(F.desc("score"), F.asc("id"))))
    ranked = cut_lineage(ranked.withColumn("batch", F.lit(batch_id).cast("long")))
    for name, rows in (("sent", ranked.filter(F.col("place") <= cap)), ("waiting", ranked.filter(F.col("place") > cap))):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{delivered}/{name}")


_ALERT = ("subscription", "id", "score", "first_seen")


def _matches(batch: DataFrame, subscriptions: DataFrame, filters: Mapping[str, Mapping] | None, now: str | None) -> DataFrame:
    if "filter" in subscriptions.columns:
        return match_subscriptions(batch, subscriptions, now)
    if filters is None:
        return batch.join(subscriptions, "topic")
    caps = capabilities(batch)
    hits = F.array_compact(F.array(*[F.when(compile_filter(f, caps, now, strict=True), F.lit(s)) for s, f in filters.items()]))
    found = batch.withColumn("subscription", F.explode(hits))
    return found.join(subscriptions.select("subscription", "watermark"), "subscription")


def _alert_rows(spark: SparkSession, path: str, where: Column) -> DataFrame | None:
    from ..sources.files import exists

    if not exists(spark, path):
        return None
    schema = "subscription string, id string, score double, first_seen string, place int, batch long"
    return spark.read.schema(schema).parquet(path).filter(where)


def stream_alerts(rows: DataFrame, subscriptions: DataFrame, delivered: str, checkpoint: str, cap: int = 30, filters: Mapping[str, Mapping] | None = None, now: str | None = None):
    """Start the alert stream; each micro-batch is delivered by `deliver_alerts`, under `delivered/sent`."""
    write = lambda batch, batch_id: deliver_alerts(batch, subscriptions, delivered, batch_id, cap, filters, now)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run an append stream over all the input there is, into a Parquet table, and wait for it."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
