"""Readings of the tick ledger: lines with what is not hiring taken out.

A line is (line, ts, level) with one row a charted tick; null levels are unmeasured. Folds over a
line's own ticks run inside one row's array, so they need no Python and no task sees two lines.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import derivations as D
from ..rules import trends as R
from ..functions.ordinal import group_row_number
from ..session import cut_lineage
from . import ticks as T


def half_up(c: Column) -> Column:
    """The nearest whole number, halves towards plus infinity."""
    return F.floor(c + 0.5).cast("bigint")


# --- partial reads ---------------------------------------------------------------------------


def drop_partial_reads(series: DataFrame, keys: Sequence[str] = ("line",)) -> DataFrame:
    """Levels that leap off the last kept one and are put straight back become null; the newest
    measured one is never judged. The last kept level depends on every verdict before it, so each
    line's ticks are folded in order."""
    keys = list(keys)
    packed = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", "level"))).alias("_p"))  # one line's ticks
    packed = packed.withColumn("_m", F.filter("_p", lambda p: p["level"].isNotNull()))
    n = F.size("_m")
    start = F.struct(F.element_at("_m", 1)["level"].cast("double").alias("prev"), F.array().cast("array<string>").alias("dropped"))

    def judge(acc: Column, i: Column) -> Column:
        here, after = F.element_at("_m", i), F.element_at("_m", i + 1)
        leap = F.abs(here["level"] - acc["prev"]) >= F.greatest(F.lit(float(R.PARTIAL_READ_MIN_LEAP)), acc["prev"] * 0.5)
        back = F.abs(after["level"] - acc["prev"]) <= F.greatest(F.lit(1.0), acc["prev"] * 0.1)
        partial = leap & back
        return F.struct(
            F.when(partial, acc["prev"]).otherwise(here["level"].cast("double")).alias("prev"),
            F.when(partial, F.concat(acc["dropped"], F.array(here["ts"]))).otherwise(acc["dropped"]).alias("dropped"),
        )

    inner = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    dropped = F.when(n > 0, F.aggregate(inner, start, judge)["dropped"]).otherwise(F.array().cast("array<string>"))
    rows = packed.withColumn("_dropped", dropped).select(*keys, "_dropped", F.inline("_p"))
    partial = F.array_contains("_dropped", F.col("ts"))
    return rows.select(*keys, "ts", F.when(~partial, F.col("level")).alias("level"), partial.alias("partial_read"))


# --- steps that are not hiring ---------------------------------------------------------------


def notes(history: DataFrame, methods: DataFrame, charted: DataFrame, directory: DataFrame | None = None, evictions: DataFrame | None = None,
          metric: str = "stock", joining: DataFrame | None = None) -> DataFrame:
    """`(ts, kind, company, line, size, fields, taken_out, source)`: every point of the window where
    lines move for a reason that is not hiring.

    counting: a change of method, and settling, the run after one that moves lines; echo: a
    domain-filter change a week later under `new`; found: boards first counted, with the openings
    they brought each family; duplicates: rows removed, per company; joining: a company counted
    from a later date. `size` null is a step whose size is only known from the jump.
    """
    ticks = charted.select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("pos"))
    none = F.lit(None).cast("string")
    moves = F.exists("fields", lambda f: f.isin(*R.LINE_MOVING_FIELDS))
    changes = T.counting_changes(methods).join(ticks, "ts").withColumn("moves", moves)
    row = lambda df, kind, company, line, size, fields, taken, source: df.select(
        "ts", F.lit(kind).alias("kind"), company.alias("company"), line.alias("line"), size.cast("bigint").alias("size"),
        fields.alias("fields"), taken.alias("taken_out"), source.alias("source"))
    no_size, joined = F.lit(None), F.array_join("fields", ",")
    out = row(changes, "counting", none, none, no_size, joined, F.col("moves") & (F.col("pos") > 0), F.col("ts"))
    settle = changes.filter(F.col("moves") & (F.col("pos") > 0)).select((F.col("pos") + 1).alias("pos"), "fields", F.col("ts").alias("source")).join(ticks, "pos")
    out = out.unionByName(row(settle, "settling", none, none, no_size, joined, F.lit(True), F.col("source")))
    if metric == "new":
        filtered = changes.filter(F.array_contains("fields", "tech_filter_version")).select(F.col("ts").alias("source"), "fields")
        week = F.date_format(F.col("source").cast("timestamp") + F.expr(f"interval {R.NEW_WINDOW_DAYS} days"), "yyyy-MM-dd")
        echo = T.snap_to_tick(filtered.withColumn("_at", week), charted, "_at", "ts").join(ticks, "ts").filter(F.col("pos") > 0)
        out = out.unionByName(row(echo, "echo", none, none, no_size, F.lit("tech_filter_version"), F.lit(True), F.col("source")))
    found = T.found_steps(history).join(ticks, "ts").filter(F.col("pos") > 0).withColumn("_all", F.sum("openings").over(Window.partitionBy("ts")))
    out = out.unionByName(row(found, "found", none, F.col("family"), F.col("openings"), none, F.abs("_all") >= R.SMALLEST_STEP, F.col("ts")))
    if metric == "stock" and evictions is not None and directory is not None:
        removed = T.evicted_steps(evictions, directory, charted).filter(F.col("count") >= R.SMALLEST_STEP)
        out = out.unionByName(row(removed, "duplicates", F.col("company"), none, -F.col("count"), none, F.lit(True), F.col("ts")))
    if joining is not None:
        late = T.snap_to_tick(joining, charted, "since", "ts").join(ticks, "ts").filter(F.col("pos") > 0)
        out = out.unionByName(row(late, "joining", F.col("company"), none, no_size, none, F.lit(True), F.col("ts")))
    return out


def land_steps(series: DataFrame, steps: DataFrame) -> DataFrame:
    """Each line's ticks with the steps that land on them: a step on an unmeasured tick lands on
    the next measured one.

    `series`: line, ts, level. `steps`: line, ts, size (null where unknown), known (found boards or
    removed duplicates), ratio (a removal's share kept, or null). Adds before, lowest_before,
    has_step, sized, size, known, duplicates_only, ratio.
    """
    per = steps.groupBy("line", "ts").agg(
        F.sum("size").alias("_size"), F.bool_and(F.col("size").isNotNull()).alias("_sized"), F.bool_or("known").alias("_known"),
        F.bool_and(F.col("kind") == "duplicates").alias("_dups"), F.product("ratio").alias("_ratio"),
    )
    rows = series.join(per, ["line", "ts"], "left")
    order = Window.partitionBy("line").orderBy("ts")  # one line's ticks
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.last("level", ignorenulls=True).over(past)).withColumn("lowest_before", F.min("level").over(past))
    # Ticks up to and including a measured one share a landing.
    rows = rows.withColumn("_landing", F.coalesce(F.count("level").over(past), F.lit(0)))
    same = Window.partitionBy("line", "_landing")
    stepped = F.col("_sized").isNotNull()
    land = {
        "size": F.sum("_size").over(same), "_all_sized": F.min(F.when(stepped, F.col("_sized").cast("int"))).over(same), "_any_known": F.max(F.when(stepped, F.col("_known").cast("int"))).over(same),
        "_all_dups": F.min(F.when(stepped, F.col("_dups").cast("int"))).over(same), "ratio": F.product("_ratio").over(same),
    }
    rows = rows.withColumns(land)
    sized = F.col("_all_sized") == 1
    # An unsized removal over which the line grew is hiring, not a step.
    grew = ~sized & (F.col("_all_dups") == 1) & (F.col("level") > F.coalesce("before", F.lit(0)))
    lands = F.col("level").isNotNull() & F.col("before").isNotNull() & F.col("_all_sized").isNotNull() & ~F.coalesce(grew, F.lit(False))
    return cut_lineage(rows.select(
        "line", "ts", "level", "before", "lowest_before", lands.alias("has_step"), F.when(lands & sized, F.col("size")).alias("size"),
        F.coalesce(lands & (F.col("_any_known") == 1), F.lit(False)).alias("known"), F.when(F.col("level").isNotNull(), F.col("ratio")).alias("ratio")))


def net_by_shift(landed: DataFrame) -> DataFrame:
    """`netted`: each level plus every later step's size, the latest level staying real. Exact where
    no step needs scaling; `net_series` is the general rule."""
    step = F.when(F.col("has_step"), F.coalesce("size", F.col("level") - F.col("before"))).otherwise(0)
    later = Window.partitionBy("line").orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    return landed.withColumn("_step", step).withColumn("netted", F.when(F.col("level").isNotNull(), F.col("level") + F.coalesce(F.sum("_step").over(later), F.lit(0)))).drop("_step")


def net_series(landed: DataFrame) -> DataFrame:
    """`(line, ts, level, netted, withheld, scale)`: what each level would be without the steps after it.

    Each step is a map of the levels before it onto the counting after it:

    - a removal of duplicates (it has a ratio) takes x to `ratio * x` plus what the step brought besides;
    - any other step takes x to `x + size`, or `x` plus the rise over it where the size is unknown;
    - where that rise is a guess and both sides hold enough openings, the step has a second map, the
      proportion of its sides, which stands if the first would take the lowest earlier level below zero.

    A level is netted by the maps of all steps after it, composed. Only steps are folded (from a line's
    end, since a guess looks at the maps behind it); ticks read their composition off the next step. A
    line that is taken below zero ends there: nothing earlier is shown.
    """
    level, before, size, ratio = F.col("level").cast("double"), F.col("before").cast("double"), F.col("size").cast("double"), F.col("ratio")
    measured, stepped = F.col("level").isNotNull(), F.col("has_step")
    rise = level - before
    removal = measured & ratio.isNotNull() & before.isNotNull()
    besides = F.when(stepped, F.coalesce(size, rise + (1 - ratio) * before)).otherwise(0.0)
    guess = measured & ~removal & stepped & size.isNull() & ~F.col("known") & (F.least(level, before) >= R.RATIO_FLOOR)
    plain = measured & ~removal & stepped
    steps = landed.select(
        "line", "ts",
        F.when(removal, ratio).when(plain, 1.0).when(~measured, ratio).alias("times"),
        F.when(removal, besides).when(plain, F.coalesce(size, rise)).otherwise(0.0).alias("plus"),
        F.when(guess, level / before).alias("proportion"),
        F.when(guess, F.col("lowest_before") + rise).alias("lowest"),
    ).where("times is not null")
    per_line = steps.groupBy("line").agg(F.reverse(F.array_sort(F.collect_list(F.struct("ts", "times", "plus", "proportion", "lowest")))).alias("_steps"))

    def compose(maps: Column, step: Column) -> Column:
        behind = F.element_at(maps, -1)
        below = F.coalesce(behind["times"] * step["lowest"] + behind["plus"] < 0, F.lit(False))
        times = behind["times"] * F.when(below, step["proportion"]).otherwise(step["times"])
        plus = behind["plus"] + F.when(below, 0.0).otherwise(behind["times"] * step["plus"])
        return F.concat(maps, F.array(F.struct(step["ts"].alias("ts"), times.alias("times"), plus.alias("plus"))))

    same = F.array(F.struct(F.lit(None).cast("string").alias("ts"), F.lit(1.0).alias("times"), F.lit(0.0).alias("plus")))
    maps = per_line.select("line", F.inline(F.aggregate("_steps", same, compose))).where("ts is not null")
    withheld = F.when(removal, F.when(stepped & size.isNull(), rise).otherwise(besides - (1 - ratio) * before)).when(plain, F.coalesce(size, rise))
    rows = landed.select("line", "ts", F.col("level").cast("bigint").alias("level"), withheld.alias("_withheld")).join(maps, ["line", "ts"], "left")
    backwards = Window.partitionBy("line").orderBy(F.desc("ts"))  # one line's ticks
    behind = backwards.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_times", F.coalesce(F.last("times", ignorenulls=True).over(behind), F.lit(1.0)))
    rows = rows.withColumn("_plus", F.coalesce(F.last("plus", ignorenulls=True).over(behind), F.lit(0.0)))
    rows = rows.withColumn("_netted", F.col("_times") * F.col("level") + F.col("_plus"))
    # The map at which a line ended stays its scale.
    rows = rows.withColumn("_end", F.first(F.when(F.col("_netted") < 0, F.col("_times")), ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0)))
    shown = F.col("_end").isNull() & F.col("level").isNotNull()
    # One row per line and tick, read by every figure of an answer, so the maps are composed once.
    return cut_lineage(rows.select(
        "line", "ts", "level", F.when(shown, F.col("_netted")).alias("netted"), F.when(shown, F.col("_withheld")).alias("withheld"),
        F.coalesce("_end", "_times").alias("scale")))


def hiring_turnover(turnover: DataFrame, left_out: DataFrame | None = None) -> DataFrame:
    """`(line, opened, closed)` over exactly the runs the hiring move counts."""
    rows = turnover if left_out is None else turnover.join(left_out.select("ts").distinct(), "ts", "left_anti")
    return rows.groupBy("line").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))


# --- moves -----------------------------------------------------------------------------------


def line_move(netted: DataFrame, totals: DataFrame | None = None, turnover: DataFrame | None = None, causes: DataFrame | None = None,
              whole_company: bool = False) -> DataFrame:
    """One row a line: start, latest, hiring, not_hiring, span_days, percent or why it is withheld,
    per_week, share at the start and now, opened and closed.

    `netted`: line, ts, level, netted. `totals`: ts, total (the share's denominator). `causes`:
    line, kind, size.
    """
    measured = netted.filter(F.col("level").isNotNull())
    ends = measured.groupBy("line").agg(
        F.min_by("level", "ts").alias("start"), F.max_by("level", "ts").alias("latest"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("netted", F.when(F.col("netted").isNotNull(), F.col("ts"))).alias("_net_start"),
    )
    newest = netted.agg(F.max("ts").alias("_newest"))
    rows = ends.join(F.broadcast(newest), F.lit(True))
    span = F.round((F.unix_timestamp(F.col("_newest").cast("timestamp")) - F.unix_timestamp(F.col("first_ts").cast("timestamp"))) / 86400.0, 4)
    rows = rows.withColumn("span_days", span).withColumn("hiring", half_up(F.col("latest") - F.coalesce("_net_start", "start")))
    rows = rows.withColumn("not_hiring", F.col("latest") - F.col("start") - F.col("hiring")).withColumn("netted_start", F.col("latest") - F.col("hiring"))
    if causes is not None:
        counting = causes.filter(F.col("kind").isin("counting", "settling", "echo")).groupBy("line").agg(F.sum("size").alias("_counting"))
        rows = rows.join(counting, "line", "left").withColumn("_counting", F.coalesce("_counting", F.lit(0)))
    else:
        rows = rows.withColumn("_counting", F.col("not_hiring"))
    recounted = F.lit(False) if whole_company else (F.col("_counting") < 0) & (
        (-F.col("_counting") > F.col("netted_start")) | ((F.col("start") >= R.MOVER_FLOOR) & (F.col("netted_start") < R.INDEX_BASE_FLOOR)))
    withheld = (
        F.when(recounted, "mostly re-counted").when(F.col("span_days") < R.MIN_SPAN_DAYS, "short window").when(F.col("start") < R.MOVER_FLOOR, "small start")
        .when(F.col("netted_start") < R.INDEX_BASE_FLOOR, "small start once steps are taken out")
    )
    rows = rows.withColumn("percent_withheld", withheld).withColumn("percent", F.when(withheld.isNull(), F.round(F.col("hiring") / F.col("netted_start") * 100, 6)))
    rows = rows.withColumn("per_week", F.when(F.col("span_days") >= R.MIN_SPAN_DAYS, half_up(F.col("hiring") / F.col("span_days") * 7)))
    if totals is not None:
        at = lambda name, when: totals.select(F.col("ts").alias(when), F.col("total").alias(name))
        rows = rows.join(at("_t0", "first_ts"), "first_ts", "left").join(at("_t1", "last_ts"), "last_ts", "left")
        rows = rows.withColumn("share_start", F.round(F.try_divide(F.col("netted_start") * 100.0, F.col("_t0")), 6)).withColumn(
            "share_latest", F.round(F.try_divide(F.col("latest") * 100.0, F.col("_t1")), 6)).drop("_t0", "_t1")
    if turnover is not None:
        rows = rows.join(turnover.select("line", "opened", "closed"), "line", "left")
    return rows.drop("_net_start", "_newest", "_counting")


def split_causes(netted: DataFrame, steps: DataFrame, landed: DataFrame) -> DataFrame:
    """`(line, kind, source, size)`: each line's not-hiring by cause, in whole openings that add up
    to it. Known sizes go to their own step; the rest of a run's withheld jump to its unsized steps,
    a new change before a settling run; growth a later scaling took out to that scaling."""
    held = netted.filter(F.col("withheld").isNotNull()).select("line", F.col("ts").alias("at"), "withheld")
    order = Window.partitionBy("line").orderBy("ts")
    # A step's landing is the first measured tick at or after it.
    landing = landed.withColumn("at", F.first(F.when(F.col("level").isNotNull(), F.col("ts")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    placed = steps.join(landing.select("line", "ts", "at"), ["line", "ts"]).join(held, ["line", "at"])
    known = placed.groupBy("line", "at").agg(F.sum(F.coalesce("size", F.lit(0))).alias("_known"), F.max("withheld").alias("_w"))
    rank = F.when(F.col("kind") == "counting", 0).when(F.col("kind") == "joining", 1).when(F.col("kind") == "echo", 2).otherwise(3)
    owner = placed.filter(F.col("size").isNull()).groupBy("line", "at").agg(F.min(F.struct(rank.alias("r"), "kind", "source")).alias("_o"))
    sized = placed.filter(F.col("size").isNotNull()).select("line", "kind", "source", F.col("size").cast("double").alias("size"))
    rest = known.join(owner, ["line", "at"], "left").select(
        "line", F.coalesce("_o.kind", F.lit("unexplained")).alias("kind"), F.coalesce("_o.source", "at").alias("source"), (F.col("_w") - F.col("_known")).alias("size"))
    causes = sized.unionByName(rest).groupBy("line", "kind", "source").agg(F.sum("size").alias("size")).filter(F.abs("size") > 1e-6)
    move = line_move(netted).select("line", F.col("not_hiring").alias("_target"))
    exact = causes.groupBy("line").agg(F.sum("size").alias("_sum"))
    scaled = move.join(exact, "line", "left").select("line", F.lit("rescaled growth").alias("kind"), F.lit("").alias("source"), (F.col("_target") - F.coalesce("_sum", F.lit(0.0))).alias("size"))
    every = causes.unionByName(scaled.filter(F.abs("size") > 0.5)).join(move, "line")
    whole = apportion(every.withColumn("_k", F.concat_ws("|", "kind", "source")), ["line"], "size", "_target", "_k")
    return whole.select("line", "kind", "source", F.col("whole").alias("size")).filter(F.col("size") != 0)


def apportion(rows: DataFrame, group: Sequence[str], value: str, target: str, key: str) -> DataFrame:
    """`whole`: values as whole numbers summing to their group's target, largest remainders first
    (smallest first where the target is under the sum of floors), ties by key.

    A group is the lines of one answer. Without a group column all rows are one, and their places
    are numbered over many tasks, for the lines may be all companies.
    """
    group = list(group)
    down = F.floor(F.col(value)).cast("bigint")
    out = rows.withColumn("_f", down).withColumn("_r", F.col(value) - F.col("_f"))
    if group:
        members = Window.partitionBy(*group)
        out = out.withColumn("_left", F.col(target) - F.sum("_f").over(members)).withColumn("_n", F.count("*").over(members))
        up = F.row_number().over(members.orderBy(F.desc("_r"), F.asc(key)))
        dn = F.row_number().over(members.orderBy(F.asc("_r"), F.asc(key)))
    else:
        out = group_row_number(group_row_number(out, [], [F.desc("_r"), F.asc(key)], "_up"), [], [F.asc("_r"), F.asc(key)], "_dn")
        up, dn = F.col("_up"), F.col("_dn")
        sums = out.agg(F.sum("_f").alias("_sum"), F.count("*").alias("_n"))
        out = out.join(F.broadcast(sums), F.lit(True)).withColumn("_left", F.col(target) - F.col("_sum"))
    each = F.floor(F.abs("_left") / F.col("_n")).cast("bigint")
    extra = F.abs("_left") - each * F.col("_n")
    step = F.when(F.col("_left") >= 0, each + F.when(up <= extra, 1).otherwise(0)).otherwise(-(each + F.when(dn <= extra, 1).otherwise(0)))
    return out.withColumn("whole", F.col("_f") + step).drop("_f", "_r", "_left", "_n", "_sum", "_up", "_dn")


def breakdown(lines: DataFrame, total: DataFrame) -> DataFrame:
    """`(line, start, latest, hiring, not_hiring)`: a breakdown's rows and its closing row, adding
    up to the first row in whole openings.

    `lines`: line, start, latest, hiring_exact. `total`: one row with the same columns. The closing
    row holds what the first row counts and the rows do not.
    """
    first = total.select(F.col("hiring_exact").alias("_th"))
    added = lines.agg(F.sum("hiring_exact").alias("_added"))  # one row, as the total is
    rows = lines.join(F.broadcast(first), F.lit(True)).join(F.broadcast(added), F.lit(True))
    rows = rows.withColumn("_closing", half_up(F.col("_th") - F.col("_added"))).drop("_added").withColumn("_target", half_up(F.col("_th")) - F.col("_closing"))
    whole = apportion(rows, [], "hiring_exact", "_target", "line")
    body = whole.select("line", "start", "latest", F.col("whole").alias("hiring"), (F.col("latest") - F.col("start") - F.col("whole")).alias("not_hiring"))
    close = whole.agg(F.max("_closing").alias("hiring")).filter(F.col("hiring") != 0).select(
        F.lit("closing row").alias("line"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("latest"), "hiring", (-F.col("hiring")).alias("not_hiring"))
    head = total.select(F.lit("first row").alias("line"), "start", "latest", half_up(F.col("hiring_exact")).alias("hiring"),
                        (F.col("latest") - F.col("start") - half_up(F.col("hiring_exact"))).alias("not_hiring"))
    return head.unionByName(body).unionByName(close)


def other_fold(lines: DataFrame, charted: int = R.LINES_CHARTED, hidden: Sequence[str] = ()) -> DataFrame:
    """The `charted` largest lines, the rest added into "Other": one uncounted closed figure makes
    Other's uncounted, and hidden families are always in it. `lines`: line, start, latest, hiring,
    not_hiring, opened, closed."""
    rows = lines.withColumn("_hidden", F.col("line").isin(*hidden) if hidden else F.lit(False))
    kept = rows.orderBy("_hidden", F.desc("latest"), "line").limit(charted).filter(~F.col("_hidden")).select("line").withColumn("_kept", F.lit(True))
    folded = rows.join(kept, "line", "left").withColumn("line", F.when(F.col("_kept"), F.col("line")).otherwise(F.lit("Other")))
    return folded.groupBy("line").agg(
        *[F.sum(c).alias(c) for c in ("start", "latest", "hiring", "not_hiring", "opened")],
        F.when(F.bool_or(F.col("closed").isNull()), F.lit(None)).otherwise(F.sum("closed")).alias("closed"), F.count("*").alias("lines"),
    )


def day_markers(steps: DataFrame, landed: DataFrame) -> DataFrame:
    """`(day, ts, changes)`: one marker a day naming each drawn change once, at the day's run where
    the lines' steps moved most, else the first change's own run. `steps`: ts, kind, source."""
    drawn = steps.filter(~F.col("kind").isin("found", "settling")).groupBy("kind", "source").agg(F.min("ts").alias("ts"))
    moved = landed.filter("has_step").groupBy("ts").agg(F.sum(F.abs(F.col("level") - F.col("before"))).alias("moved"))
    rows = drawn.join(moved, "ts", "left").withColumn("day", F.substring("ts", 1, 10)).withColumn("moved", F.coalesce("moved", F.lit(0)))
    # Most moved first, then the earliest run; changes of a day are few.
    return rows.groupBy("day").agg(
        F.min(F.struct((-F.col("moved")).alias("neg"), F.col("ts"))).alias("_at"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws("@", "kind", "source"))), ",").alias("changes"),
    ).select("day", F.col("_at.ts").alias("ts"), "changes")


def check_reading(lines: DataFrame, breakdown_rows: DataFrame | None = None, causes: DataFrame | None = None) -> DataFrame:
    """`(line, problem)`: every way a reading breaks its own arithmetic; empty when it reconciles."""
    bad = lambda df, condition, text: df.filter(F.coalesce(condition, F.lit(False))).select("line", F.lit(text).alias("problem"))
    c = F.col
    out = bad(lines, c("latest") - c("start") != c("hiring") + c("not_hiring"), "move is not hiring plus not hiring")
    out = out.unionByName(bad(lines, c("netted_start") != c("latest") - c("hiring"), "netted start is not latest less hiring"))
    out = out.unionByName(bad(lines, c("percent").isNotNull() & (c("netted_start") < R.INDEX_BASE_FLOOR), "a percentage off a small base"))
    out = out.unionByName(bad(lines, c("percent").isNotNull() & (F.abs(c("percent") - c("hiring") / c("netted_start") * 100) > 1e-4), "percentage is not hiring over the netted start"))
    out = out.unionByName(bad(lines, c("percent").isNotNull() & c("percent_withheld").isNotNull(), "a percentage both given and withheld"))
    out = out.unionByName(bad(lines, (c("span_days") < R.MIN_SPAN_DAYS) & c("per_week").isNotNull(), "a weekly rate over a short window"))
    if breakdown_rows is not None:
        first = F.col("line") == "first row"
        sums = breakdown_rows.agg(*[
            (F.sum(F.when(first, F.col(n)).otherwise(0)) - F.sum(F.when(first, F.lit(0)).otherwise(F.col(n)))).alias(n) for n in ("start", "latest", "hiring", "not_hiring")
        ])
        for n in ("start", "latest", "hiring", "not_hiring"):
            out = out.unionByName(sums.filter(F.col(n) != 0).select(F.lit("first row").alias("line"), F.lit(f"rows do not add up in {n}").alias("problem")))
    if causes is not None:
        sums = causes.groupBy("line").agg(F.sum("size").alias("_s"))
        joined = lines.join(sums, "line", "left")
        out = out.unionByName(bad(joined, F.coalesce(c("_s"), F.lit(0)) != c("not_hiring"), "causes do not add up to not hiring"))
    return out


# --- answers ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class TrendQuestion:
    """What a trends view asks: the metric, what its lines are, and which boards count."""

    metric: str = "stock"
    split_by: str = "family"  # family, band, role or company
    family: str | None = None
    companies: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None
    base: str | None = None  # set for comparable coverage
    successors: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.metric not in R.LEVEL_METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")
        if self.split_by not in ("family", "band", "role", "company"):
            raise ValueError(f"unknown split {self.split_by!r}")
        if self.since and self.until and self.since > self.until:
            raise ValueError("the window ends before it begins")
        if self.split_by == "band" and not self.family:
            raise ValueError("levels are read within one family")


def scoped_history(history: DataFrame, question: TrendQuestion, directory: DataFrame | None = None) -> DataFrame:
    """The rows of the question's boards, with `company` where companies are picked."""
    rows = T.rename_families(history, question.successors)
    if question.sources:
        rows = rows.filter(T.source_of(F.col("board")).isin(*question.sources))
    if question.base is not None:
        rows = T.comparable_rows(rows, history, question.base)
    if directory is not None and (question.companies or question.split_by == "company"):
        bridge = directory.select("board", "company").dropDuplicates(["board"])
        if question.companies:
            bridge = bridge.filter(F.col("company").isin(*question.companies))
        rows = rows.join(bridge, "board")
    return rows


def _line(question: TrendQuestion) -> Column:
    return {"family": F.col("family"), "role": F.col("family"), "band": F.col("band"), "company": F.col("company") if question.split_by == "company" else F.lit(None)}[question.split_by]


def trend_answer(history: DataFrame, question: TrendQuestion, directory: DataFrame | None = None, inflow_from: str | None = None) -> DataFrame:
    """`(line, ts, level, total, share)`: the question's lines at every charted tick, with every
    served opening in scope at it.

    Lines are role families, one family's levels, watched roles, or companies. Rows outside the
    domain are in the total alone.
    """
    rows = scoped_history(history, question, directory)
    ticks = T.tick_positions(history)
    level_rows = T.applied_deltas(rows.filter(T.is_level(F.col("metric"))))
    watched, outside = T.is_watched(F.col("family")), F.col("family") == D.NON_TECH
    in_view = watched if question.split_by == "role" else ~watched & ~outside
    if question.family:
        in_view = in_view & F.col("family").isin(*T.predecessors(question.family, question.successors))
    mine = level_rows.filter((F.col("metric") == question.metric) & in_view).withColumn("line", _line(question))
    series = T.replay_series(mine, ticks, ["line"], question.since, question.until)
    if question.metric == "new" and inflow_from is not None:
        opened = rows.filter(in_view).withColumn("line", _line(question))
        flow = T.new_inflow(opened, inflow_from, ["line"])
        if question.until is not None:
            flow = flow.filter(F.col("ts") <= question.until)
        series = series.filter(F.col("ts") < inflow_from).unionByName(flow.select("line", "ts", "level"))
    served = level_rows.filter((F.col("metric") == "stock") & ~watched).withColumn("_all", F.lit(1))
    totals = T.replay_series(served, ticks, ["_all"], question.since, question.until).select("ts", F.col("level").alias("total"))
    return series.join(totals, "ts", "left").select("line", "ts", "level", "total", F.round(F.try_divide("level", "total"), 6).alias("share"))


def trend_steps(history: DataFrame, methods: DataFrame, question: TrendQuestion, series: DataFrame, directory: DataFrame | None = None,
                evictions: DataFrame | None = None) -> DataFrame:
    """The question's notes as steps of its lines: (line, ts, kind, source, size, known, ratio)."""
    charted = series.select("ts").distinct()
    found = notes(scoped_history(history, question, directory), methods, charted, directory, evictions, question.metric).filter("taken_out")
    lines = series.select("line").distinct()
    # A counting change reaches every line. There are as many as the method moved: one row holds them.
    changed = found.filter(F.col("kind").isin("counting", "settling", "echo")).agg(F.collect_list(F.struct("ts", "kind", "source", "size")).alias("_c"))
    shared = lines.join(F.broadcast(changed), F.lit(True)).select("line", F.inline("_c"))
    by_line = found.filter(F.col("kind") == "found").select("line", "ts", "kind", "source", "size") if question.split_by == "family" else None
    steps = shared if by_line is None else shared.unionByName(by_line.join(lines, "line", "left_semi"))
    if question.split_by == "company":
        removed = found.filter(F.col("kind") == "duplicates").select(F.col("company").alias("line"), "ts", "kind", "source", "size")
        steps = steps.unionByName(removed.join(lines, "line", "left_semi"))
    known = F.col("kind").isin("found", "duplicates")
    return steps.select("line", "ts", "kind", "source", "size", known.alias("known"), F.lit(None).cast("double").alias("ratio"))


def trends(history: DataFrame, methods: DataFrame, question: TrendQuestion, directory: DataFrame | None = None, evictions: DataFrame | None = None) -> DataFrame:
    """One row a line: what moved and how much of it is hiring, with its turnover and share."""
    answer = cut_lineage(trend_answer(history, question, directory))
    clean = cut_lineage(drop_partial_reads(answer.select("line", "ts", "level")))
    steps = cut_lineage(trend_steps(history, methods, question, clean, directory, evictions))
    landed = land_steps(clean.select("line", "ts", "level"), steps)
    netted = net_series(landed)
    causes = cut_lineage(split_causes(netted, steps, landed))
    charted = answer.select("ts").distinct()
    rows = scoped_history(history, question, directory)
    if question.split_by != "company":
        rows = rows.withColumn("company", F.lit(None).cast("string"))
    if question.family:
        rows = rows.filter(F.col("family").isin(*T.predecessors(question.family, question.successors)))
    left_out = T.left_out_runs(methods, T.tick_positions(history)).filter(F.col("scope") == "every")
    turned = T.turnover_series(rows.filter(~T.is_watched(F.col("family"))).withColumn("line", _line(question)), ["line"], charted, left_out)
    totals = answer.select("ts", "total").distinct()
    return line_move(netted, totals, hiring_turnover(turned), causes, whole_company=question.split_by == "company")


def company_moves(history: DataFrame, methods: DataFrame, directory: DataFrame, since: str, evictions: DataFrame | None = None) -> DataFrame:
    """Every company's own move over a window at once: the same operators with the company as line."""
    return trends(history, methods, TrendQuestion(split_by="company", since=since), directory, evictions)


def hot_candidates(history: DataFrame, methods: DataFrame, directory: DataFrame, since: str, postings: DataFrame | None = None,
                   evictions: DataFrame | None = None) -> DataFrame:
    """Companies with openings, their move over the week, turnover, and why any is left out.

    `excluded`: below_min_stock, too_new, or null for a ranked one.
    """
    facts = T.board_facts(history)
    per = directory.select("board", "company", "operator").dropDuplicates(["board"]).join(facts, "board").groupBy("company").agg(
        F.sum("level").alias("stock"), F.min("first_counted").alias("counted_since"), F.min("operator").alias("operator"), F.count("*").alias("boards"))
    moves = company_moves(history, methods, directory, since, evictions).select(F.col("line").alias("company"), F.col("hiring").alias("net"), "opened", "closed")
    rows = per.join(moves, "company", "left")
    newest = history.agg(F.max("ts").alias("_newest"))
    rows = rows.join(F.broadcast(newest), F.lit(True))
    too_new = F.col("counted_since").cast("timestamp") > F.col("_newest").cast("timestamp") - F.expr(f"interval {R.HOT_MIN_DAYS} days")
    uncounted = T.closures_uncounted(history, directory, since, "~").select("company", "unseen", "uncounted")
    rows = rows.join(uncounted, "company", "left").withColumn("closed", F.when(~F.coalesce("uncounted", F.lit(False)), F.col("closed")))
    rows = rows.withColumn("excluded", F.when(F.col("stock") < R.HOT_MIN_STOCK, "below_min_stock").when(too_new | F.col("net").isNull(), "too_new"))
    rows = rows.withColumn("rate", F.when(F.col("closed").isNotNull(), F.bround(F.try_divide(100.0 * F.col("opened"), F.col("stock")))))
    rows = rows.withColumn("opened_less_closed", F.when(F.coalesce("unseen", F.lit(0)) == 0, F.col("opened") - F.col("closed")))
    if postings is not None:
        late = T.found_late(postings, since).join(directory.select("board", "company").distinct(), "board").groupBy("company").agg(
            F.sum("fresh").alias("opened_fresh"), F.sum("found_late").alias("opened_found_late"))
        rows = rows.join(late, "company", "left")
    return rows.drop("_newest")


def hot_ranking(candidates: DataFrame, top: int = R.HOT_TOP) -> DataFrame:
    """`(lens, place, company, figure)`: the four lenses, positive figures alone, ties by company."""
    ranked = candidates.filter(F.col("excluded").isNull())
    lens = lambda name, figure, rows=None: (ranked if rows is None else rows).filter(F.col(figure) > 0).select(
        F.lit(name).alias("lens"), "company", F.col(figure).cast("double").alias("figure"))
    growing = ranked.filter(F.col("net") > 0)
    every = lens("expansion", "net").unionByName(lens("opened_less_closed", "opened_less_closed")).unionByName(lens("volume", "opened")).unionByName(lens("rate", "rate", growing))
    order = Window.partitionBy("lens").orderBy(F.desc("figure"), F.asc("company"))
    return every.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select("lens", "place", "company", "figure")


def hot_counts(candidates: DataFrame) -> DataFrame:
    """How many companies are ranked and why others are not."""
    ranked = F.col("excluded").isNull()
    return candidates.agg(
        F.count_if(ranked).alias("ranked"), F.count_if(F.col("excluded") == "too_new").alias("too_new"),
        F.count_if((F.col("excluded") == "below_min_stock") & (F.col("stock") > 0)).alias("below_min_stock"),
        F.count_if(ranked & (F.col("opened") > 0) & F.col("closed").isNull()).alias("closures_uncounted"),
        F.count_if(ranked & (F.col("rate") > 0) & (F.col("net") <= 0)).alias("not_growing"),
    )


# --- names -----------------------------------------------------------------------------------


def suggest_names(directory: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """`(name, tier, match, openings)`: exact, prefix, every word a prefix, the same with one typo,
    and joined spelling; then openings, then name. One suggestion a name; test tenants left out.

    `directory`: company (its key), name, openings.
    """
    from ..operators.clean import company_words

    spark = directory.sparkSession
    typed_words = [w for w in spark.range(1).select(company_words(F.lit(query)).alias("w")).first()["w"]]
    alias_words = None
    if (alias := R.QUERY_ALIASES.get(" ".join(typed_words))) is not None:
        alias_words = alias.split()
    rows = directory.withColumn("_w", company_words(F.col("name")))
    rank = _tier(typed_words)
    match = F.element_at(F.array(*[F.lit(m) for m in ("exact", "prefix", "words", "typo", "joined")]), rank + 1)
    rows = rows.withColumn("tier", rank)
    rows = rows.withColumn("match", F.when(F.col("tier").isNotNull(), match))
    if alias_words is not None:
        aliased = _tier(alias_words)
        hit = (aliased == 0) | ((aliased == 1) & F.lit(len(alias_words) > 1))
        worse = F.col("tier").isNull() | (F.col("tier") > 1)
        rows = rows.withColumn("_alias", hit & worse).withColumn("tier", F.when(F.col("_alias"), 1).otherwise(F.col("tier"))).withColumn(
            "match", F.when(F.col("_alias"), "alias").otherwise(F.col("match")))
    test = (F.col("openings") == 0) & F.exists("_w", lambda w: w.rlike(R.TEST_TENANT))
    kept = rows.filter(F.col("tier").isNotNull() & ~test).withColumn("_name_key", F.array_join("_w", " "))
    best = kept.groupBy("_name_key").agg(F.min(F.struct("tier", (-F.col("openings")).alias("neg"), "name", "company", "match")).alias("b"))
    return best.select("b.name", "b.company", "b.tier", "b.match", (-F.col("b.neg")).alias("openings")).orderBy("tier", F.desc("openings"), "name", "company").limit(limit)


def _tier(query: Sequence[str]) -> Column:
    if not query:
        return F.lit(None).cast("int")
    words, joined, typed, squeezed = F.col("_w"), F.array_join("_w", " "), " ".join(query), "".join(query)
    begins = lambda q: F.exists(words, lambda w: w.startswith(q))
    near = lambda q: F.exists(words, lambda w: w.startswith(q) | one_typo(q, w))
    every = lambda test: _and([test(q) for q in query])
    out = F.when(joined == typed, 0).when(joined.startswith(typed), 1).when(every(begins), 2).when(every(near), 3)
    if len(squeezed) >= R.SQUEEZE_MIN:
        out = out.when(F.array_join(words, "").startswith(squeezed), 4)
    return out


def one_typo(typed: str, word: Column) -> Column:
    """One edit (or a swap of neighbours) from the word or its same-length prefix, never in the
    first letter; short words allow none."""
    if len(typed) < R.TYPO_MIN:
        return F.lit(False)
    swaps = [typed[:i] + typed[i + 1] + typed[i] + typed[i + 2:] for i in range(1, len(typed) - 1)]
    near = lambda w: (F.levenshtein(F.lit(typed), w) == 1) | w.isin(*swaps)
    return word.startswith(typed[0]) & (near(word) | near(F.substring(word, 1, len(typed))))


def _and(columns: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out

