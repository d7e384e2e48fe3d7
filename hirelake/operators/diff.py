"""Snapshot joins: what a run's read says about what was held, and the stores kept in step.

All of them join on a unique id, so rows spread evenly however large one board is. Conditions on a
board are joined from tables with one row a board.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinal import top_per_group
from ..functions.text import drop_last_part, key_prefixes, squash


def longest_prefix_join(ids: DataFrame, boards: DataFrame, id_col: str = "id", board_col: str = "board") -> DataFrame:
    """`owner`: the longest listed board key that prefixes the id at a colon, in the id's own
    casing, else the id without its last part; with its source and tenant.

    Prefixes are exploded for an equality join on the folded key, and the longest hit is a max that
    combines before its shuffle. No id is compared with a board it does not name.
    """
    keys = boards.select(F.lower(board_col).alias("_key")).distinct().withColumn("_listed", F.lit(True))
    distinct = ids.select(F.col(id_col).alias("_id")).distinct()
    prefixes = distinct.select("_id", F.explode_outer(key_prefixes(F.col("_id"))).alias("_prefix"))
    hits = prefixes.join(keys, F.lower("_prefix") == F.col("_key"), "left")
    longest = hits.groupBy("_id").agg(F.max(F.when(F.col("_listed"), F.length("_prefix"))).alias("_end"))
    owner = F.coalesce(F.substring(F.col("_id"), F.lit(1), F.col("_end")), drop_last_part(F.col("_id")))
    named = longest.select("_id", owner.alias("owner"), F.col("_end").isNotNull().alias("listed"))
    rest = F.substring(F.col("owner"), F.locate(":", F.col("owner")) + 1, F.length("owner"))
    named = named.withColumn("source", F.split("owner", ":").getItem(0)).withColumn(
        "tenant", F.split(F.regexp_replace(rest, "(?i)^https?://", ""), "/").getItem(0)
    )
    return ids.join(named, ids[id_col] == named["_id"], "left").drop("_id")


def scrape_scope(reads: DataFrame) -> DataFrame:
    """Boards whose absences are evidence: read this run, less those read short or failed.

    `reads`: board, outcome ("ok", "truncated", "failed", ...). Keys compare case-blind, and one
    bad read of a board takes it out.
    """
    by_board = reads.groupBy(F.lower("board").alias("board_key")).agg(
        F.bool_or(F.col("outcome") != "ok").alias("_bad"), F.min("board").alias("board")
    )
    return by_board.filter(~F.col("_bad")).select("board_key", "board")


def _with_scope(df: DataFrame, scope: DataFrame, name: str, board: str = "board") -> DataFrame:
    keys = scope.select(F.lower("board").alias("_scope_key")).distinct().withColumn(name, F.lit(True))
    return df.join(keys, F.lower(df[board]) == F.col("_scope_key"), "left").drop("_scope_key").withColumn(
        name, F.coalesce(name, F.lit(False))
    )


def diff_listing(seen: DataFrame, prior: DataFrame, authoritative: DataFrame, keep: DataFrame | None = None,
                 hash_col: str = "fields_hash") -> DataFrame:
    """`(id, board, kind)`: listed, changed, unchanged, unlisted, off_board or still_listed.

    A held id the run did not return is unlisted only where its board was read in full, off_board
    where its board left the keep list, and still listed otherwise. An id is counted once.
    """
    now = seen.groupBy("id").agg(F.min(F.struct("board", hash_col)).alias("_s"))
    held = prior.groupBy("id").agg(F.min(F.struct("board", hash_col)).alias("_p"))
    both = now.join(held, "id", "full_outer").select(
        "id", F.coalesce("_s.board", "_p.board").alias("board"), F.col("_s").isNotNull().alias("_seen"), F.col("_p").isNotNull().alias("_held"),
        (~F.col(f"_s.{hash_col}").eqNullSafe(F.col(f"_p.{hash_col}"))).alias("_moved"),
    )
    both = _with_scope(both, authoritative, "_full")
    both = _with_scope(both, keep, "_kept") if keep is not None else both.withColumn("_kept", F.lit(True))
    kind = (
        F.when(F.col("_seen") & ~F.col("_held"), "listed").when(F.col("_seen") & F.col("_moved"), "changed")
        .when(F.col("_seen"), "unchanged").when(F.col("_full"), "unlisted").when(~F.col("_kept"), "off_board").otherwise("still_listed")
    )
    return both.select("id", "board", kind.alias("kind"))


def sync_diff(index: DataFrame, fresh: DataFrame, scope: DataFrame, unconfirmed: DataFrame | None, live: DataFrame,
              rejected: DataFrame | None = None, refused: DataFrame | None = None) -> DataFrame:
    """`(id, board, action)`: add, refused, delete, unconfirmed or keep.

    Missing once on a read board leaves an id unconfirmed; missing again deletes it; an unread
    board's ids keep their state while the board is live. `unconfirmed` None turns the grace period
    off. A rejected id was seen by the scrape and is missing from `fresh`, whatever its board.
    """
    grace = unconfirmed is not None
    flag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    have = index.groupBy("id").agg(F.min("board").alias("_ib"))
    come = fresh.groupBy("id").agg(F.min("board").alias("_fb"))
    rows = have.join(come, "id", "full_outer")
    if grace:
        waiting = unconfirmed.groupBy("id").agg(F.min("board").alias("_ub"))
        rows = rows.join(waiting, "id", "full_outer")
    else:
        rows = rows.withColumn("_ub", F.lit(None).cast("string"))
    for df, name in ((rejected, "_rejected"), (refused, "_refused")):
        rows = rows.join(flag(df, name), "id", "left") if df is not None else rows.withColumn(name, F.lit(None).cast("boolean"))
    rows = rows.withColumn("board", F.coalesce("_ib", "_fb", "_ub"))
    rows = _with_scope(_with_scope(rows, scope, "_read"), live, "_live")
    indexed, seen, waited = F.col("_ib").isNotNull(), F.col("_fb").isNotNull(), F.col("_ub").isNotNull()
    judged = F.col("_read") | F.coalesce("_rejected", F.lit(False))
    missing = indexed & ~seen & judged
    action = (
        F.when(seen & ~indexed & F.coalesce("_refused", F.lit(False)), "refused").when(seen & ~indexed, "add")
        .when(missing & (waited if grace else F.lit(True)), "delete").when(missing, "unconfirmed")
        .when(waited & ~judged & F.col("_live"), "unconfirmed").when(indexed, "keep")
    )
    return rows.withColumn("action", action).filter(F.col("action").isNotNull()).select("id", "board", "action")


def apply_sync(table: DataFrame, add: DataFrame, delete: DataFrame) -> DataFrame:
    """The table without the deleted ids and with the added rows; an added id replaces its row."""
    gone = delete.select("id").unionByName(add.select("id")).distinct()
    return table.join(gone, "id", "left_anti").unionByName(add.select(*table.columns))


def added_removed_kept(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """`(id, change)` for the ids of two snapshots."""
    a = before.select(key).distinct().withColumn("_a", F.lit(True))
    b = after.select(key).distinct().withColumn("_b", F.lit(True))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("kept")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


# --- texts -----------------------------------------------------------------------------------


def lost_to_question_marks(held: Column, fresh: Column) -> Column:
    """Whether `fresh` is `held` with non-ASCII characters read back as "?", one for one."""
    # The held text with every non-ASCII character at a "?" of the fresh text masked must agree.
    same_length = F.length(held) == F.length(fresh)
    letters = F.zip_with(F.split(held, ""), F.split(fresh, ""), lambda h, f: (h == f) | ((f == "?") & h.rlike(r"[^\x00-\x7F]")))
    return (held != fresh) & same_length & fresh.contains("?") & F.forall(letters, lambda x: x)


def fill_descriptions(corpus: DataFrame, held: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Each corpus row with its settled `description` and an `outcome`: learned, replaced,
    reverted, same, kept_over_question_marks, filled or unrecorded; `change_count` and
    `previous_hash` are the change ledger's next row for it.

    `held`: id, description. `changes`: id, count, previous_hash.
    """
    store = held.select("id", F.col("description").alias("_held"))
    rows = corpus.withColumn("_fresh", F.nullif(F.trim("description"), F.lit(""))).join(store, "id", "left")
    if changes is not None:
        rows = rows.join(changes.select("id", F.col("count").alias("_count"), F.col("previous_hash").alias("_prev")), "id", "left")
    else:
        rows = rows.withColumn("_count", F.lit(None).cast("bigint")).withColumn("_prev", F.lit(None).cast("string"))
    fresh, old = F.col("_fresh"), F.col("_held")
    worse = F.coalesce(lost_to_question_marks(old, fresh), F.lit(False))
    outcome = (
        F.when(fresh.isNull() & old.isNull(), "unrecorded").when(fresh.isNull(), "filled").when(old.isNull(), "learned")
        .when(fresh == old, "same").when(worse, "kept_over_question_marks")
        .when(F.col("_prev") == F.md5(fresh), "reverted").otherwise("replaced")
    )
    rows = rows.withColumn("outcome", outcome)
    replaced = F.col("outcome").isin("replaced", "reverted")
    return rows.withColumn(
        "description", F.when(F.col("outcome").isin("filled", "kept_over_question_marks"), old).otherwise(fresh)
    ).withColumn("change_count", F.when(replaced, F.coalesce("_count", F.lit(0)) + 1).otherwise(F.col("_count"))).withColumn(
        "previous_hash", F.when(replaced, F.md5(old)).otherwise(F.col("_prev"))
    ).drop("_fresh", "_held", "_count", "_prev")


def compact_text_store(fragments: DataFrame, order: str = "seq") -> DataFrame:
    """The newest fragment per id. `max_by` keeps one row an id on each side of the shuffle."""
    rest = [c for c in fragments.columns if c != "id"]
    return fragments.groupBy("id").agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r")).select("id", *[f"_r.{c}" for c in rest])


def backfill_text(table: DataFrame, held: DataFrame) -> DataFrame:
    """Null text in the served table filled from the store."""
    return table.join(held.select("id", F.col("description").alias("_held")), "id", "left").withColumn(
        "description", F.coalesce("description", "_held")
    ).drop("_held")


def content_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per reference id: unchanged, different, no_current_description or not_returned."""
    digest = lambda c: F.sha2(squash(c), 256)
    a = before.select("id", F.col("description").alias("_b"))
    b = after.select("id", F.col("description").alias("_a"), F.lit(True).alias("_seen"))
    rows = a.join(b, "id", "left")
    status = (
        F.when(F.col("_seen").isNull(), "not_returned").when(F.coalesce(F.trim("_a"), F.lit("")) == "", "no_current_description")
        .when(digest(F.col("_b")) == digest(F.col("_a")), "unchanged").otherwise("different")
    )
    return rows.select("id", status.alias("status"), digest(F.col("_b")).alias("before_hash"), digest(F.col("_a")).alias("after_hash"),
                       F.length("_b").alias("before_chars"), F.coalesce(F.length("_a"), F.lit(0)).alias("after_chars"))


# --- facts and derivations -------------------------------------------------------------------


def derivation_change(before: dict[str, Column], after: dict[str, Column], source: str) -> Column:
    """gained, lost, retiered, moved or null, for a group of derived columns and their source."""
    same = F.lit(True)
    for name in before:
        same = same & before[name].eqNullSafe(after[name])
    old, new = before[source], after[source]
    return (
        F.when(same, F.lit(None).cast("string")).when(old.isNull() & new.isNotNull(), "gained").when(old.isNotNull() & new.isNull(), "lost")
        .when(old != new, "retiered").when(old.isNotNull(), "moved").otherwise("lost")
    )


def refresh_metadata(store: DataFrame, facts: DataFrame, fields: Sequence[str], none_is_unseen: Iterable[str] = (),
                     derived: Sequence[str] = (), source: str | None = None, derive=None, inputs: Sequence[str] = (),
                     version: int | None = None) -> DataFrame:
    """Stored facts overwritten by observed ones; a null of a `none_is_unseen` field was not
    observed. Where an input fact moved, or the row's `rule_version` is old, `derive` (a table
    transform) redoes the `derived` columns. Adds `facts_changed`, `redone` and `change`."""
    seen = facts.select("id", *[F.col(f).alias(f"_f_{f}") for f in fields], F.lit(True).alias("_seen"))
    rows = store.join(seen, "id", "left")
    unseen = set(none_is_unseen)
    news = {f: F.when(F.col("_seen").isNull(), F.col(f)).otherwise(F.coalesce(f"_f_{f}", f) if f in unseen else F.col(f"_f_{f}")) for f in fields}
    rows = rows.withColumns({f"_n_{f}": c for f, c in news.items()})
    changed = lambda names: _any(~F.col(f"_n_{f}").eqNullSafe(F.col(f)) for f in names)
    rows = rows.withColumn("facts_changed", changed(fields)).withColumn("redone", changed(inputs) if inputs else F.lit(False))
    if version is not None:
        rows = rows.withColumn("redone", F.col("redone") | (F.coalesce("rule_version", F.lit(-1)) < version))
    rows = rows.withColumns({f: F.col(f"_n_{f}") for f in fields}).drop("_seen", *[f"_f_{f}" for f in fields], *[f"_n_{f}" for f in fields])
    if derive is None or not derived:
        return rows
    old = {d: F.col(f"_o_{d}") for d in derived}
    rows = rows.withColumns({f"_o_{d}": F.col(d) for d in derived})
    rows = derive(rows).withColumns({d: F.when(F.col("redone"), F.col(d)).otherwise(F.col(f"_o_{d}")) for d in derived})
    if source is not None:
        rows = rows.withColumn("change", derivation_change(old, {d: F.col(d) for d in derived}, source))
    if version is not None:
        rows = rows.withColumn("rule_version", F.when(F.col("redone"), F.lit(version)).otherwise(F.col("rule_version")))
    return rows.drop(*[f"_o_{d}" for d in derived])


def _any(columns: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def refresh_served(table: DataFrame, store: DataFrame, columns: Sequence[str], carried: Sequence[str] = ("first_seen", "is_confident_non_tech")) -> DataFrame:
    """Served rows whose columns differ from the store's, rewritten with what they carry kept."""
    news = store.select("id", *[F.col(c).alias(f"_n_{c}") for c in columns])
    rows = table.join(news, "id")
    differs = ~F.struct(*[F.col(c) for c in columns]).eqNullSafe(F.struct(*[F.col(f"_n_{c}").alias(c) for c in columns]))
    kept = [c for c in carried if c in table.columns]
    return rows.filter(differs).select("id", *[F.col(f"_n_{c}").alias(c) for c in columns], *kept)


# --- vectors ---------------------------------------------------------------------------------


def classify_changes(corpus: DataFrame, prior: DataFrame, regate: DataFrame | None = None, cap: int | None = None,
                     scores: DataFrame | None = None) -> DataFrame:
    """`(id, status)`: new, upgraded, edited, deferred, rejected, dropped or done.

    `corpus`: id, source, board, doc_hash, has_description, kept (the language gate). `prior`: id,
    doc_hash, has_description. Text arrived over a title-only vector is an upgrade; a differing
    hash is an edit; where a `cap` a run is stated, edits are taken one source at a time and the rest deferred; a gate failure rejects a new
    document and drops a held one.
    """
    held = prior.select("id", F.col("doc_hash").alias("_ph"), F.col("has_description").alias("_pd"), F.lit(True).alias("_held"))
    rows = corpus.join(held, "id", "left")
    if regate is not None:
        rows = rows.join(regate.select("id").distinct().withColumn("_regate", F.lit(True)), "id", "left")
    else:
        rows = rows.withColumn("_regate", F.lit(None).cast("boolean"))
    described = (F.col("_pd") == F.lit(False)) & F.col("has_description")
    comparable = (F.col("_pd") == F.lit(False)) | F.col("has_description")
    edited = ~F.coalesce(described, F.lit(False)) & comparable & F.col("_ph").isNotNull() & (F.col("_ph") != F.col("doc_hash"))
    kept = F.col("kept")
    status = (
        F.when(F.col("_held").isNull(), F.when(kept, "new").otherwise("rejected"))
        .when(F.coalesce(described, F.lit(False)), F.when(kept, "upgraded").otherwise("dropped"))
        .when(F.coalesce(edited, F.lit(False)), F.when(kept, "edited").otherwise("dropped"))
        .when(F.coalesce("_regate", F.lit(False)) & ~kept, "dropped").otherwise("done")
    )
    rows = rows.withColumn("status", status)
    if cap is None:
        return rows.select("id", "status")
    edits = rows.filter(F.col("status") == "edited")
    if scores is not None:
        edits = edits.join(scores.select("board", "score"), "board", "left")
    else:
        edits = edits.withColumn("score", F.lit(0.0))
    # Only each source's first `cap` edits can be among the first `cap` taken in turn.
    turns = top_per_group(edits, ["source"], [F.desc_nulls_last("score"), F.asc("id")], cap, "_turn")
    taken = turns.orderBy("_turn", "source").limit(cap).select("id", F.lit(True).alias("_taken"))
    rows = rows.join(taken, "id", "left")
    return rows.select("id", F.when((F.col("status") == "edited") & F.col("_taken").isNull(), "deferred").otherwise(F.col("status")).alias("status"))


def merge_vectors(store: DataFrame, fragments: DataFrame, replaced: DataFrame, dropped: DataFrame) -> DataFrame:
    """The store with its fragments appended. An id to be replaced goes only if its replacement
    arrived, an id that failed the gate goes outright, and an id already held is not added twice.
    Of fragments repeating an id the lowest by value counts."""
    arrived = fragments.select("id").distinct()
    swap = replaced.select("id").distinct().join(arrived, "id", "left_semi")
    gone = swap.unionByName(dropped.select("id").distinct()).distinct()
    kept = store.join(gone, "id", "left_anti")
    others = [c for c in store.columns if c != "id"]
    single = fragments.groupBy("id").agg(F.min(F.struct(*others)).alias("_f")).select("id", *[F.col(f"_f.{c}").alias(c) for c in others])
    new = single.join(kept.select("id"), "id", "left_anti").join(dropped.select("id").distinct(), "id", "left_anti")
    return kept.unionByName(new.select(*store.columns))


def missing_fragments(planned: DataFrame, fragments: DataFrame) -> DataFrame:
    """Planned ids no fragment brought, per shard."""
    return planned.join(fragments.select("id").distinct(), "id", "left_anti").groupBy("shard").agg(F.count(F.lit(1)).alias("missing"))


def prune_store(store: DataFrame, served: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(kept, archived)`: vectors of ids neither served nor in this run's corpus leave the store.
    An empty served table is never evidence, so it is refused."""
    if served.limit(1).count() == 0:
        raise ValueError("the served table is empty: refusing to prune every vector")
    alive = served.select("id").unionByName(seen.select("id")).distinct()
    return store.join(alive, "id", "left_semi"), store.join(alive, "id", "left_anti")


def stale_shared_vectors(df: DataFrame) -> DataFrame:
    """Ids in a group of identical vectors whose normalised titles differ."""
    keyed = df.select("id", F.md5(F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")).alias("_v"), squash(F.lower(F.coalesce("title", F.lit("")))).alias("_t"))
    # One row a vector; the smallest and the largest title differ exactly when not all are equal.
    groups = keyed.groupBy("_v").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b")).filter(F.col("_a") != F.col("_b"))
    return keyed.join(groups.select("_v"), "_v", "left_semi").select("id")


def due_for_refetch(held: DataFrame, checked: DataFrame, served: DataFrame, now: str, period_days: int = 7) -> DataFrame:
    """`(id, checked_at, due)` of every held id: the ledger narrowed to held ids, an unknown one
    seeded with a time spread over the last period by its hash; due where served and a period old."""
    at = F.lit(now).cast("timestamp")
    hours = period_days * 24
    known = checked.groupBy("id").agg(F.max(F.col("checked_at").cast("timestamp")).alias("_at"))
    spread = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % hours
    seeded = F.timestamp_seconds(F.unix_timestamp(at) - spread * 3600)
    rows = held.select("id").distinct().join(known, "id", "left").withColumn("checked_at", F.coalesce("_at", seeded))
    rows = rows.join(served.select("id").distinct().withColumn("_served", F.lit(True)), "id", "left")
    due = F.coalesce("_served", F.lit(False)) & (F.unix_timestamp(at) - F.unix_timestamp("checked_at") >= hours * 3600)
    return rows.select("id", F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss").alias("checked_at"), due.alias("due"))


# --- served-input checkpoints ----------------------------------------------------------------


def next_checkpoint(previous: DataFrame, served: DataFrame, stamp: str) -> DataFrame:
    """The change checkpoint of a tick: rows present and new or different, and ids removed.

    `previous` and `served`: id, digest and the row's own columns.
    """
    cols = [c for c in served.columns if c not in ("id", "digest")]
    old = previous.select("id", F.col("digest").alias("_old"))
    rows = served.join(old, "id", "full_outer")
    gone = F.col("digest").isNull()
    moved = ~F.col("digest").eqNullSafe(F.col("_old"))
    kind = F.when(gone, "removed").otherwise("present")
    return rows.filter(moved).select(F.lit(stamp).alias("ts"), kind.alias("kind"), "id", "digest", *cols)


def as_of(changes: DataFrame, ts: str) -> DataFrame:
    """State at a tick: the last row of each id at or before it, removed ids left out."""
    rest = [c for c in changes.columns if c not in ("id", "ts")]
    last = changes.filter(F.col("ts") <= ts).groupBy("id").agg(F.max(F.struct("ts", *rest)).alias("_r"))
    return last.filter(F.col("_r.kind") != "removed").select("id", *[f"_r.{c}" for c in ["ts", *rest] if c != "kind"])


def checkpoint_chain(chain: DataFrame, ticks: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """`(ts, problem)`: what is wrong with a chain of checkpoints; empty when it is whole.

    `chain`: ts, previous, baseline. `ticks`: ts of every published tick. A parent must be the
    checkpoint just before; exactly the first is a baseline; every tick from the first on has a
    checkpoint; a removal names an id present before it.
    """
    # One row a tick: a chain is as long as the history has ticks.
    order = Window.orderBy("ts")
    linked = chain.withColumn("_before", F.lag("ts").over(order))
    broken = linked.filter(~F.coalesce("previous", F.lit("")).eqNullSafe(F.coalesce("_before", F.lit("")))).select("ts", F.lit("broken parent chain").alias("problem"))
    baseline = linked.filter(F.col("baseline") != F.col("_before").isNull()).select("ts", F.lit("missing or repeated baseline").alias("problem"))
    first = chain.agg(F.min("ts").alias("_first"))
    uncovered = ticks.select("ts").distinct().join(F.broadcast(first), F.col("ts") >= F.col("_first")).join(chain.select("ts"), "ts", "left_anti").select(
        "ts", F.lit("tick without a checkpoint").alias("problem")
    )
    problems = broken.unionByName(baseline).unionByName(uncovered)
    if changes is not None:
        # Rows of one id only: as many as the times that one posting changed.
        seen = F.lag("kind").over(Window.partitionBy("id").orderBy("ts"))
        unknown = changes.withColumn("_was", seen).filter((F.col("kind") == "removed") & (F.coalesce("_was", F.lit("removed")) == "removed"))
        problems = problems.unionByName(unknown.select("ts", F.lit("removal of an unknown id").alias("problem")).distinct())
    return problems


