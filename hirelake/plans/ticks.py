"""The tick ledger: signed changes per (board, metric, family, band) and tick, read back as levels.

`history` is always (ts, board, metric, family, band, delta); `ts` is an ISO string, compared as
one. A history has as many ticks as there were runs, so tables with one row a tick are small and
joined without a hint; a window over one group's ticks is bounded by that number too, because the
rows of a tick are summed first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import derivations as D
from ..rules import trends as R

KEY = ("board", "metric", "family", "band")


def source_of(board: Column) -> Column:
    return F.split(board, ":").getItem(0)


def is_level(metric: Column) -> Column:
    return metric.isin(*R.LEVEL_METRICS)


def is_watched(family: Column) -> Column:
    return family.startswith("watch:")


def levels_at(history: DataFrame, ts: str | None = None) -> DataFrame:
    """`(board, metric, family, band, level)`: deltas summed up to a tick; empty groups left out."""
    rows = history.filter(is_level(F.col("metric")))
    if ts is not None:
        rows = rows.filter(F.col("ts") <= ts)
    return rows.groupBy(*KEY).agg(F.sum("delta").alias("level")).filter(F.col("level") != 0)


def record_tick(history: DataFrame, levels: DataFrame, turnover: DataFrame | None, ts: str) -> DataFrame:
    """The rows of a new tick: each group's change against the replayed level, zero changes left
    out, then its turnover counts. A group `levels` leaves out is at 0. A stamp not newer than the
    newest tick is refused."""
    newest = history.agg(F.max("ts").alias("ts")).first()["ts"]
    if newest is not None and ts <= newest:
        raise ValueError(f"tick {ts} is not newer than the newest, {newest}")
    held = levels_at(history).withColumnRenamed("level", "_was")
    now = levels.groupBy(*KEY).agg(F.sum("level").alias("_now"))
    change = now.join(held, list(KEY), "full_outer").withColumn("delta", F.coalesce("_now", F.lit(0)) - F.coalesce("_was", F.lit(0)))
    rows = change.filter(F.col("delta") != 0).select(F.lit(ts).alias("ts"), *KEY, F.col("delta").cast("bigint").alias("delta"))
    if turnover is None:
        return rows
    counts = turnover.groupBy(*KEY).agg(F.sum("delta").alias("delta"))
    return rows.unionByName(counts.select(F.lit(ts).alias("ts"), *KEY, F.col("delta").cast("bigint").alias("delta")))


def tick_positions(history: DataFrame) -> DataFrame:
    """`(ts, pos)`: the ticks in order, numbered from 0; one row a tick."""
    order = Window.orderBy("ts")
    return history.select("ts").distinct().withColumn("pos", F.row_number().over(order) - 1)


def _ticks_array(ticks: DataFrame) -> DataFrame:
    """The tick stamps as one row holding a sorted array."""
    return ticks.agg(F.array_sort(F.collect_list("ts")).alias("_ticks"))


def snap_to_tick(df: DataFrame, ticks: DataFrame, column: str = "ts", out: str = "at") -> DataFrame:
    """`out`: the first tick at or after the stamp; null past the last one. Looked up once per
    distinct stamp, of which there are about as many as ticks."""
    stamps = df.select(F.col(column).alias("_stamp")).distinct().join(F.broadcast(_ticks_array(ticks)), F.lit(True))
    snapped = stamps.select("_stamp", F.array_min(F.filter("_ticks", lambda t: t >= F.col("_stamp"))).alias(out))
    return df.join(snapped, F.col(column) == F.col("_stamp"), "left").drop("_stamp")


def applied_deltas(history: DataFrame, hold_days: int = R.NEW_WINDOW_DAYS) -> DataFrame:
    """History with each `new` delta of a board's first days moved to the tick its hold ends at: a
    board found with a backlog opened none of it that week. A hold past the last tick is dropped."""
    first = history.filter(F.col("metric") == "stock").groupBy("board").agg(F.min("ts").alias("_first"))
    ends = F.date_format(F.col("_first").cast("timestamp") + F.expr(f"interval {hold_days} days"), "yyyy-MM-dd'T'HH:mm:ss")
    # Compared as strings of one shape: a bare day sorts before any time on it.
    first = first.withColumn("_hold", F.when(F.length("_first") == 10, F.substring(ends, 1, 10)).otherwise(F.concat(ends, F.substring("_first", 20, 10))))
    held_until = snap_to_tick(first, tick_positions(history), "_hold", "_at").select("board", "_hold", "_at")
    rows = history.join(held_until, "board", "left")
    held = (F.col("metric") == "new") & (F.col("ts") < F.col("_hold"))
    return rows.withColumn("ts", F.when(held, F.col("_at")).otherwise(F.col("ts"))).filter(F.col("ts").isNotNull()).drop("_hold", "_at")


def replay_series(deltas: DataFrame, ticks: DataFrame, keys: Sequence[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """`(keys, ts, level)` at every charted tick from each group's first delta on.

    Deltas are summed per group and tick, run up, and each level is repeated over the ticks until
    the next change. Only cells of the answer are made: no group is paired with a tick before its
    first delta.
    """
    keys = list(keys)
    per_tick = deltas.groupBy(*keys, "ts").agg(F.sum("delta").alias("_d")).join(ticks, "ts")
    order = Window.partitionBy(*keys).orderBy("pos")
    run = per_tick.withColumn("level", F.sum("_d").over(order)).withColumn("_next", F.lead("pos").over(order))
    end = ticks.agg((F.max("pos") + 1).alias("_end"))
    spread = run.join(F.broadcast(end), F.lit(True)).withColumn("_until", F.coalesce("_next", "_end"))
    cells = spread.select(*keys, "level", F.explode(F.sequence(F.col("pos"), F.col("_until") - 1)).alias("pos"))
    out = cells.join(ticks, "pos").select(*keys, "ts", "level")
    if since is not None:
        out = out.filter(F.col("ts") >= since)
    if until is not None:
        out = out.filter(F.col("ts") <= until)
    return out


def index_series(history: DataFrame, sources: Sequence[str] = (), banded: Sequence[str] | None = None, since: str | None = None,
                 until: str | None = None) -> DataFrame:
    """`(metric, family, band, ts, level)` over chosen sources; a family outside `banded` is summed
    over its bands (band null), `None` keeps every family's."""
    rows = applied_deltas(history.filter(is_level(F.col("metric"))))
    if sources:
        rows = rows.filter(source_of(F.col("board")).isin(*sources))
    if banded is not None:
        rows = rows.withColumn("band", F.when(F.col("family").isin(*banded) if banded else F.lit(False), F.col("band")))
    return replay_series(rows, tick_positions(history), ["metric", "family", "band"], since, until)


def scoped_series(history: DataFrame, directory: DataFrame, companies: Sequence[str], base: str | None = None, since: str | None = None,
                  until: str | None = None) -> DataFrame:
    """`(company, metric, family, band, ts, level)` over the chosen companies' boards alone, or
    with `base` over those of them first counted by it."""
    chosen = directory.filter(F.col("company").isin(*companies)).select("board", "company").dropDuplicates(["board"])
    rows = applied_deltas(history.filter(is_level(F.col("metric"))))
    if base is not None:
        rows = comparable_rows(rows, history, base)
    return replay_series(rows.join(chosen, "board"), tick_positions(history), ["company", "metric", "family", "band"], since, until)


def counted_since(history: DataFrame, directory: DataFrame) -> DataFrame:
    """`(company, since)`: the first tick any board of a company was counted at."""
    first = history.filter(F.col("metric") == "stock").groupBy("board").agg(F.min("ts").alias("_f"))
    return directory.select("board", "company").distinct().join(first, "board").groupBy("company").agg(F.min("_f").alias("since"))


def comparable_rows(rows: DataFrame, history: DataFrame, base: str) -> DataFrame:
    """Rows of boards first counted at or before the first tick at or after `base`."""
    stock = history.filter(F.col("metric") == "stock")
    at = stock.filter(F.col("ts") >= base).agg(F.min("ts").alias("_base"))
    first = stock.groupBy("board").agg(F.min("ts").alias("_first"))
    cohort = first.join(F.broadcast(at), F.col("_first") <= F.coalesce("_base", F.lit("~"))).select("board")
    return rows.join(cohort, "board", "left_semi")


def comparable_series(history: DataFrame, base: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """`(metric, family, band, ts, level)` over boards first counted by the base tick."""
    rows = comparable_rows(applied_deltas(history.filter(is_level(F.col("metric")))), history, base)
    return replay_series(rows, tick_positions(history), ["metric", "family", "band"], since, until)


def shared_denominator(series: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The series with `total`, every served opening in scope at its tick, and `share`."""
    keys = [*scope, "ts"]
    served = series.filter((F.col("metric") == "stock") & ~is_watched(F.col("family")))
    totals = served.groupBy(*keys).agg(F.sum("level").alias("total"))
    return series.join(totals, keys, "left").withColumn("share", F.round(F.try_divide(F.col("level"), F.col("total")), 6))


def rename_families(rows: DataFrame, successors: Mapping[str, str]) -> DataFrame:
    """Retired names read as their successor where the successor has data of its own."""
    if not successors:
        return rows
    pairs = rows.sparkSession.createDataFrame(list(successors.items()), "family string, _successor string")
    present = rows.select(F.col("family").alias("_successor")).distinct()
    usable = pairs.join(present, "_successor", "left_semi")
    return rows.join(F.broadcast(usable), "family", "left").withColumn("family", F.coalesce("_successor", "family")).drop("_successor")


def predecessors(family: str, successors: Mapping[str, str]) -> list[str]:
    """The names an asked-for family reads: its own and every name it replaced."""
    return [family, *[old for old, new in successors.items() if new == family]]


# --- turnover --------------------------------------------------------------------------------


def turnover(previous: DataFrame, current: DataFrame, first_seen: DataFrame, counted_boards: DataFrame, evicted: DataFrame,
             previous_as_of: str) -> DataFrame:
    """`(board, metric, family, band, source, delta)` between two placements, so that opened −
    closed + recounted in − recounted out is every key's change.

    A new id opened only where it was first seen since and its board was counted before; a gone one
    closed only where it was evicted; a moved one is recounted out of one key and into the other.
    """
    place = lambda df, name: df.select("id", F.struct("board", "family", "band", "source").alias(name))
    both = place(current, "_now").join(place(previous, "_was"), "id", "full_outer")
    seen = first_seen.select("id", F.col("first_seen").alias("_seen"))
    gone = evicted.select("id").distinct().withColumn("_evicted", F.lit(True))
    counted = counted_boards.select(F.col("board").alias("_board")).distinct().withColumn("_counted", F.lit(True))
    rows = both.join(seen, "id", "left").join(gone, "id", "left").join(counted, F.col("_now.board") == F.col("_board"), "left")
    now, was = F.col("_now"), F.col("_was")
    fresh = F.coalesce(F.col("_seen") > previous_as_of, F.lit(False)) & F.coalesce("_counted", F.lit(False))
    event = lambda at, metric: F.struct(at["board"].alias("board"), metric.alias("metric"), at["family"].alias("family"), at["band"].alias("band"), at["source"].alias("source"))
    arrived = F.when(now.isNotNull() & was.isNull(), event(now, F.when(fresh, "opened").otherwise("recounted_in")))
    left = F.when(now.isNull(), event(was, F.when(F.coalesce("_evicted", F.lit(False)), "closed").otherwise("recounted_out")))
    moved = now.isNotNull() & was.isNotNull() & ~now.eqNullSafe(was)
    out = F.when(moved, event(was, F.lit("recounted_out")))
    into = F.when(moved, event(now, F.lit("recounted_in")))
    events = rows.select(F.explode(F.array_compact(F.array(arrived, left, out, into))).alias("e")).select("e.*")
    return events.groupBy("board", "metric", "family", "band", "source").agg(F.count("*").alias("delta"))


def turnover_identity(previous: DataFrame, current: DataFrame, booked: DataFrame) -> DataFrame:
    """Keys whose turnover does not equal their change; empty when the books balance."""
    key = ["board", "family", "band", "source"]
    count = lambda df, sign: df.groupBy(*key).agg(F.count("*").alias("_n")).select(*key, (F.col("_n") * sign).alias("_n"))
    change = count(current, 1).unionByName(count(previous, -1))
    sign = F.when(F.col("metric").isin("opened", "recounted_in"), -1).otherwise(1)
    all_rows = change.unionByName(booked.select(*key, (F.col("delta") * sign).alias("_n")))
    return all_rows.groupBy(*key).agg(F.sum("_n").alias("off_by")).filter(F.col("off_by") != 0)


def turnover_series(history: DataFrame, lines: Sequence[str], charted: DataFrame, left_out: DataFrame | None = None) -> DataFrame:
    """`(lines, ts, opened, closed, recounted)` at each charted tick.

    A tick's turnover lands on the first charted tick at or after it; the window's first one shows
    none, and neither does a left-out one. `recounted` is in less out.
    """
    lines = list(lines)
    rows = history.filter(F.col("metric").isin(*R.TURNOVER_METRICS))
    first = charted.agg(F.min("ts").alias("_first"))
    at = snap_to_tick(rows, charted).join(F.broadcast(first), F.lit(True)).filter(F.col("at") > F.col("_first"))
    if left_out is not None:
        at = at.join(left_out.select(F.col("ts").alias("at")).distinct(), "at", "left_anti")
    put = lambda metric, sign: F.sum(F.when(F.col("metric") == metric, F.col("delta") * sign).otherwise(0))
    return at.groupBy(*lines, F.col("at").alias("ts")).agg(
        put("opened", 1).alias("opened"), put("closed", 1).alias("closed"), (put("recounted_in", 1) + put("recounted_out", -1)).alias("recounted")
    )


def closures_uncounted(history: DataFrame, directory: DataFrame, since: str, until: str, marker: str = "unscoped") -> DataFrame:
    """`(company, boards, unseen, uncounted)`: boards with an incomplete read inside the window;
    a company gives no closed count when all of its boards had one."""
    marked = history.filter((F.col("metric") == marker) & (F.col("ts") > since) & (F.col("ts") <= until)).select("board").distinct().withColumn("_m", F.lit(True))
    rows = directory.select("board", "company").distinct().join(marked, "board", "left")
    return rows.groupBy("company").agg(F.count("*").alias("boards"), F.count("_m").alias("unseen")).withColumn("uncounted", F.col("boards") == F.col("unseen"))


def new_inflow(history: DataFrame, inflow_from: str, keys: Sequence[str] = ("family", "band"), days: int = R.NEW_WINDOW_DAYS) -> DataFrame:
    """`(keys, ts, level)`: jobs opened in the half-open trailing week at each charted tick; groups
    at zero left out. Every opened count is added to just the ticks its week covers."""
    keys = list(keys)
    ticks = tick_positions(history)
    opened = history.filter(F.col("metric") == "opened").groupBy(*keys, "ts").agg(F.sum("delta").alias("_n"))
    stamps = F.broadcast(_ticks_array(ticks))
    ends = F.col("ts").cast("timestamp") + F.expr(f"interval {days} days")
    covered = F.filter("_ticks", lambda t: (t >= F.col("ts")) & (t.cast("timestamp") < ends) & (t >= inflow_from))
    cells = opened.join(stamps, F.lit(True)).select(*keys, "_n", F.explode(covered).alias("at"))
    return cells.groupBy(*keys, F.col("at").alias("ts")).agg(F.sum("_n").alias("level")).filter(F.col("level") != 0)


# --- what happened to the counting -----------------------------------------------------------


def counting_changes(methods: DataFrame, fields: Sequence[str] = R.METHOD_FIELDS) -> DataFrame:
    """`(ts, fields)`: ticks counted by another method than the one before, with what moved."""
    order = Window.orderBy("ts")  # one row a tick
    rows = methods.withColumn("_before", F.lag("ts").over(order))
    moved = F.array_compact(F.array(*[
        F.when(~F.col(f).cast("string").eqNullSafe(F.lag(F.col(f).cast("string")).over(order)), F.lit(f)) for f in fields
    ]))
    return rows.withColumn("fields", moved).filter(F.col("_before").isNotNull() & (F.size("fields") > 0)).select("ts", "fields")


def left_out_runs(methods: DataFrame, ticks: DataFrame, movers: Sequence[str] = R.LINE_MOVING_FIELDS) -> DataFrame:
    """`(ts, scope)`: ticks hiring leaves out: a line-moving change's own and the one after it, for
    every board ("every"); a duplicate-removal change's, for boards it can move ("touched")."""
    changes = counting_changes(methods).join(ticks, "ts")
    moves = F.exists("fields", lambda f: f.isin(*movers))
    dedup = F.array_contains("fields", "dedup_version")
    scoped = changes.withColumn("scope", F.when(moves, "every").when(dedup, "touched")).filter(F.col("scope").isNotNull() & (F.col("pos") > 0))
    runs = scoped.select("scope", F.explode(F.array(F.col("pos"), F.col("pos") + 1)).alias("pos")).distinct()
    return runs.join(ticks, "pos").select("ts", "scope")


def board_facts(history: DataFrame) -> DataFrame:
    """`(board, first_counted, backlog, level, found_later)`: when each board was first counted,
    the openings that landed then, its newest level, and whether the history had begun before."""
    in_domain = (F.col("family") != D.NON_TECH) & ~is_watched(F.col("family"))
    per = history.filter(F.col("metric") == "stock").groupBy("board", "ts").agg(F.sum(F.when(in_domain, F.col("delta")).otherwise(0)).alias("_d"))
    facts = per.groupBy("board").agg(F.min(F.struct("ts", "_d")).alias("_f"), F.sum("_d").alias("level"))
    start = history.agg(F.min("ts").alias("_start"))
    return facts.join(F.broadcast(start), F.lit(True)).select(
        "board", F.col("_f.ts").alias("first_counted"), F.col("_f._d").alias("backlog"), "level", (F.col("_f.ts") > F.col("_start")).alias("found_later")
    )


def found_steps(history: DataFrame, lines: Sequence[str] = ("family",), since: str | None = None, until: str | None = None) -> DataFrame:
    """`(ts, lines, boards, openings)`: boards first counted inside the window, at their tick, with
    the openings they brought each line."""
    start = history.agg(F.min("ts").alias("_start"))
    stock = history.filter((F.col("metric") == "stock") & ~is_watched(F.col("family")))
    first = stock.groupBy("board").agg(F.min("ts").alias("ts"))
    floor = F.lit(since) if since is not None else F.col("_start")
    later = first.join(F.broadcast(start), F.lit(True)).filter((F.col("ts") > floor) & (F.col("ts") > F.col("_start"))).drop("_start")
    if until is not None:
        later = later.filter(F.col("ts") <= until)
    landed = stock.join(later, ["board", "ts"])
    return landed.groupBy("ts", *lines).agg(F.countDistinct("board").alias("boards"), F.sum("delta").alias("openings")).filter(F.col("openings") != 0)


def evicted_steps(evictions: DataFrame, directory: DataFrame, charted: DataFrame) -> DataFrame:
    """`(ts, company, count)`: duplicate rows removed, at the first charted tick at or after the
    removal; the window's first tick and anything past the last are left out."""
    first = charted.agg(F.min("ts").alias("_first"))
    rows = evictions.join(directory.select("board", "company").distinct(), "board")
    at = snap_to_tick(rows, charted).join(F.broadcast(first), F.lit(True)).filter(F.col("at") > F.col("_first"))
    return at.groupBy(F.col("at").alias("ts"), "company").agg(F.sum("count").alias("count")).filter(F.col("count") != 0)


def trailing_week(history: DataFrame, days: int = R.NEW_WINDOW_DAYS) -> DataFrame:
    """`(base, from, to, turnover_from)`: the last tick before the week began (the first tick where
    none is), the first measured after it, the newest, and the first of those with turnover."""
    stamps = _ticks_array(history.select("ts").distinct())
    turned = history.filter(F.col("metric").isin(*R.TURNOVER_METRICS)).agg(F.min("ts").alias("_turned"))
    rows = stamps.join(turned, F.lit(True)).withColumn("to", F.array_max("_ticks"))
    began = F.col("to").cast("timestamp") - F.expr(f"interval {days} days")
    before = F.filter("_ticks", lambda t: t.cast("timestamp") < began)
    rows = rows.withColumn("base", F.coalesce(F.array_max(before), F.array_min("_ticks")))
    rows = rows.withColumn("from", F.coalesce(F.array_min(F.filter("_ticks", lambda t: t > F.col("base"))), F.col("base")))
    return rows.select("base", "from", "to", F.when(F.col("_turned").isNotNull(), F.greatest("_turned", "from")).alias("turnover_from"))


def coverage_summary(history: DataFrame, base: str, since: str, until: str) -> DataFrame:
    """One row per side (cohort counted by the base, entrants after it): boards, openings at the
    start and now, the backlog they were first counted with, recorded activity, and boards whose
    closures went unseen."""
    in_domain = (F.col("family") != D.NON_TECH) & ~is_watched(F.col("family"))
    stock = history.filter((F.col("metric") == "stock") & in_domain)
    first = history.filter(F.col("metric") == "stock").groupBy("board").agg(F.min("ts").alias("_first")).filter(F.col("_first") <= until)
    first = first.withColumn("side", F.when(F.col("_first") <= base, "cohort").otherwise("entrants"))
    levels = stock.filter(F.col("ts") <= until).join(first, "board").groupBy("side").agg(
        F.sum(F.when(F.col("ts") <= since, F.col("delta")).otherwise(0)).alias("start"), F.sum("delta").alias("latest"),
        F.sum(F.when(F.col("ts") == F.col("_first"), F.col("delta")).otherwise(0)).alias("backlog"),
    )
    moved = history.filter(F.col("metric").isin(*R.TURNOVER_METRICS) & in_domain).join(first, "board")
    moved = moved.filter((F.col("ts") > F.greatest(F.lit(since), F.col("_first"))) & (F.col("ts") <= until))
    put = lambda m: F.sum(F.when(F.col("metric") == m, F.col("delta")).otherwise(0))
    activity = moved.groupBy("side").agg(put("opened").alias("opened"), put("closed").alias("closed"), (put("recounted_in") - put("recounted_out")).alias("recounted"))
    unseen = history.filter((F.col("metric") == "unscoped") & (F.col("ts") > since) & (F.col("ts") <= until)).select("board").distinct().withColumn("_u", F.lit(True))
    boards = first.join(unseen, "board", "left").groupBy("side").agg(F.count("*").alias("boards"), F.count("_u").alias("closures_unseen"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return boards.join(levels, "side", "left").join(activity, "side", "left").select(
        "side", "boards", *[zero(c) for c in ("start", "latest", "backlog", "opened", "closed", "recounted")], "closures_unseen"
    )


def found_late(postings: DataFrame, since: str | None = None, until: str | None = None, days: int = R.FOUND_LATE_DAYS) -> DataFrame:
    """`(board, fresh, found_late)`: postings first seen after `since` and by `until`, posted within
    two weeks of first sight or undated, against longer before."""
    rows = postings.filter(F.col("first_seen").isNotNull())
    if since is not None:
        rows = rows.filter(F.col("first_seen") > since)
    if until is not None:
        rows = rows.filter(F.col("first_seen") <= until)
    return rows.groupBy("board").agg(F.count_if(~is_found_late(days)).alias("fresh"), F.count_if(is_found_late(days)).alias("found_late"))


def is_found_late(days: int = R.FOUND_LATE_DAYS) -> Column:
    """Whether the posting's own date is more than `days` before its first sight."""
    shaped = F.coalesce(F.col("posted_at").rlike(r"^.{4}-.{2}-.{2}"), F.lit(False))
    age = F.datediff(F.substring("first_seen", 1, 10).try_cast("date"), F.substring("posted_at", 1, 10).try_cast("date"))
    return F.coalesce(shaped & (age > days), F.lit(False))


def mostly_found_late(opened: Column, fresh: Column, late: Column) -> Column:
    return F.coalesce((opened >= R.FOUND_LATE_MIN_OPENED) & (2 * fresh < opened) & (opened <= 2 * late), F.lit(False))


def diff_payloads(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of two versions of one answer that differ, with the side that has them."""
    only_a = a.exceptAll(b.select(*a.columns)).withColumn("side", F.lit("before"))
    only_b = b.select(*a.columns).exceptAll(a).withColumn("side", F.lit("after"))
    return only_a.unionByName(only_b)


def validate_reference(placements: DataFrame, history: DataFrame, ts: str) -> DataFrame:
    """`(board, family, band, counted, recorded)` where placements rebuilt at a tick do not count to
    the recorded level; empty when they agree."""
    counted = placements.groupBy("board", "family", "band").agg(F.count("*").alias("counted"))
    recorded = levels_at(history, ts).filter((F.col("metric") == "stock") & ~is_watched(F.col("family"))).select("board", "family", "band", F.col("level").alias("recorded"))
    both = counted.join(recorded, ["board", "family", "band"], "full_outer")
    both = both.select("board", "family", "band", F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("recorded", F.lit(0)).alias("recorded"))
    return both.filter(F.col("counted") != F.col("recorded"))
