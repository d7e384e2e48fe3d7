"""Board ledgers and copies of postings across boards.

Elections are `min` or `max` over a struct, which combine before the shuffle, so a group of copies
that holds most rows never meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordinal import group_row_number
from ..functions.text import fold, squash
from ..rules import boards as R
from ..rules.cleaning import LEGAL_FORMS
from ..session import cut_lineage
from .clean import host_of, registrable_domain

# --- survivors -------------------------------------------------------------------------------


def is_front(board: Column) -> Column:
    return F.lower(board).startswith(R.FRONT_SOURCE + ":")


def is_non_public(board: Column) -> Column:
    """A token in the site part, after the first slash, names an insiders' site."""
    site = F.lower(F.when(F.locate("/", board) > 0, F.substring(board, F.locate("/", board) + 1, F.length(board))).otherwise(F.lit("")))
    hit = F.lit(False)
    for token in R.NON_PUBLIC_TOKENS:
        hit = hit | site.contains(token)
    return hit


def survivor_rank(board: Column, jobs: Column) -> Column:
    """A struct whose minimum is the board that stays: no front, public, most postings, lowest key."""
    return F.struct(is_front(board).alias("front"), is_non_public(board).alias("hidden"), (-F.coalesce(jobs, F.lit(0))).alias("neg_jobs"), F.lower(board).alias("board"))


def elect_survivor(groups: DataFrame) -> DataFrame:
    """`(group, board)`: the board each group of copies is served from. `groups`: group, board, jobs."""
    return groups.groupBy("group").agg(F.min(survivor_rank(F.col("board"), F.col("jobs"))).alias("_w")).select("group", F.col("_w.board").alias("board"))


def copy_group(source: Column, tenant: Column, board: Column, native: Column) -> Column:
    """What identifies a posting: its tenant and requisition on a source whose boards share them
    and whose native id holds a digit, else its board and native id."""
    shared = source.isin(*R.TENANT_SOURCES) & native.rlike(r"\d")
    return F.concat_ws("\x1f", F.when(shared, F.concat(source, F.lit(":"), F.lower(tenant))).otherwise(F.lower(board)), native)


def backing_copies(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """`(id, group)`: a front's rows whose stamped requisition a row on a paired board also carries,
    with the lowest group of those rows. `rows`: id, board, requisition, group."""
    stamped = rows.filter(F.col("requisition").isNotNull()).withColumn("_key", F.lower("board"))
    links = pairs.select(F.lower("front").alias("_front"), F.lower("backing").alias("_backing")).distinct()
    held = stamped.filter(~is_front(F.col("board"))).groupBy("_key", "requisition").agg(F.min("group").alias("group"))
    fronts = stamped.filter(is_front(F.col("board"))).select("id", "requisition", F.col("_key").alias("_front"))
    found = fronts.join(links, "_front").join(held, (F.col("_backing") == held["_key"]) & (fronts["requisition"] == held["requisition"]))
    return found.groupBy("id").agg(F.min("group").alias("group"))


def dedupe_served(rows: DataFrame, keep: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """`(id, rule)` of rows to evict: off_board, tenant-requisition, backing-requisition or
    case-variant.

    `rows`: id, board (as the id spells it), source, tenant, native. `keep`: board (live casing),
    jobs. Among the rows of one group the elected board's stay; among those the live casing does,
    else the lowest id.
    """
    live = keep.groupBy(F.lower("board").alias("_key")).agg(F.min("board").alias("_live"), F.max("jobs").alias("_jobs"))
    placed = rows.join(live, F.lower(rows["board"]) == F.col("_key"), "left")
    off = placed.filter(F.col("_live").isNull()).select("id", F.lit("off_board").alias("rule"))
    on = placed.filter(F.col("_live").isNotNull()).withColumn("group", copy_group(F.col("source"), F.col("tenant"), F.col("board"), F.col("native")))
    if copies is not None:
        on = on.join(copies.select("id", F.col("group").alias("_copy_of")), "id", "left").withColumn("group", F.coalesce("_copy_of", "group"))
    else:
        on = on.withColumn("_copy_of", F.lit(None).cast("string"))
    row = F.struct((F.col("board") != F.col("_live")).alias("fossil"), F.col("id"))
    winners = on.groupBy("group").agg(F.min(F.struct(survivor_rank(F.col("board"), F.col("_jobs")).alias("who"), row.alias("row"))).alias("_w"))
    judged = on.join(winners, "group")
    lost = F.lower("board") != F.col("_w.who.board")
    rule = F.when(lost & F.col("_copy_of").isNotNull(), "backing-requisition").when(lost, "tenant-requisition").otherwise("case-variant")
    return off.unionByName(judged.filter(F.col("id") != F.col("_w.row.id")).select("id", rule.alias("rule")))


def refuse_copies(arriving: DataFrame, served: DataFrame) -> DataFrame:
    """`(id)` of arriving rows not to add, because their posting is served from another board.

    Both: id, board, group, jobs. An incumbent wins, unless the best class arriving (no front
    before front, public before non-public) beats the best class served; with no incumbent, or a
    displaced one, the elected survivor wins. A row on an incumbent's own board passes.
    """
    klass = lambda b: F.struct(is_front(b).alias("front"), is_non_public(b).alias("hidden"))
    come = arriving.groupBy("group").agg(F.min(klass(F.col("board"))).alias("_new"), F.min(survivor_rank(F.col("board"), F.col("jobs"))).alias("_elected"))
    have = served.groupBy("group").agg(F.min(klass(F.col("board"))).alias("_old"))
    decided = come.join(have, "group", "left").withColumn("_elects", F.col("_old").isNull() | (F.col("_new") < F.col("_old")))
    mine = served.select("group", F.lower("board").alias("_b")).distinct().withColumn("_own", F.lit(True))
    rows = arriving.withColumn("_b", F.lower("board")).join(decided.select("group", "_elects", F.col("_elected.board").alias("_winner")), "group")
    rows = rows.join(mine, ["group", "_b"], "left")
    passes = F.when(F.col("_elects"), F.col("_b") == F.col("_winner")).otherwise(F.coalesce("_own", F.lit(False)))
    return rows.filter(~passes).select("id")


def alias_filter(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """`(id, rule)` of rows on a board an alias ledger buries. `aliases`: board, signal."""
    buried = aliases.groupBy(F.lower("board").alias("_key")).agg(F.min("signal").alias("_signal"))
    return rows.join(buried, F.lower(rows["board"]) == F.col("_key")).select("id", F.concat(F.lit("alias:"), F.col("_signal")).alias("rule"))


# --- aliases and containment -----------------------------------------------------------------

#: Rows of up to so many boards are sent to all executors; beyond it both sides of a join are shuffled.
_MOST_SENT = 1_500_000


def resolve_aliases(probed: DataFrame, live: DataFrame, prefer: Sequence[str] = (), vendor_hosts: Sequence[str] = ()) -> DataFrame:
    """`(slug, resolved, canonical, verdict)` per probed slug.

    `probed`: slug, resolved (null where the probe failed). A cluster is aliased only when the key
    its members resolve to is live and was itself reached; the canonical is that key, or a
    preferred member. Verdicts: canonical, duplicate, ordinary, unreachable, tombstone,
    www_variant, migrated, canonical_unconfirmed.
    """
    keys = live.select(F.col("slug").alias("_live")).distinct()
    preferred = F.min(F.when(F.col("slug").isin(*prefer), F.col("slug"))) if prefer else F.min(F.lit(None).cast("string"))
    clusters = probed.filter(F.col("resolved").isNotNull()).groupBy("resolved").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("slug") == F.col("resolved")).alias("_reached"), preferred.alias("_preferred")
    ).join(keys, F.col("resolved") == F.col("_live"), "left")
    rows = probed.join(clusters, "resolved", "left")
    canonical = F.coalesce("_preferred", "resolved")
    bare = lambda c: F.regexp_replace(c, r"^www\.", "")
    verdict = (
        F.when(F.col("resolved").isNull(), "unreachable")
        .when(F.col("_live").isNull() & F.col("resolved").isin(*vendor_hosts) if vendor_hosts else F.lit(False), "tombstone")
        .when(F.col("_live").isNull() & (bare(F.col("resolved")) == bare(F.col("slug"))), "www_variant")
        .when(F.col("_live").isNull(), "migrated").when(~F.col("_reached"), "canonical_unconfirmed")
        .when(F.col("_n") == 1, "ordinary").when(F.col("slug") == canonical, "canonical").otherwise("duplicate")
    )
    return rows.select("slug", "resolved", F.when(verdict.isin("duplicate", "canonical"), canonical).alias("canonical"), verdict.alias("verdict"))


def _distinct_ids(board_ids: DataFrame) -> DataFrame:
    """Each board's ids once, written in the order of boards: a board's rows lie together, so that what is summed over
    them combines before a shuffle, and a large board still spans several files."""
    ids = board_ids.select("group", "board", "id").repartitionByRange("group", "board", "id").distinct()
    return cut_lineage(ids.sortWithinPartitions("group", "board", "id"), "zstd", tidy=True)


def _set_profile(ids: DataFrame) -> DataFrame:
    """Size and order-free fingerprints of each board's id set, summed before the shuffle. `ids` are distinct."""
    return ids.groupBy("group", "board").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("_x"),
        F.sum(F.xxhash64(F.lit(17), F.col("id")).cast("decimal(38,0)")).alias("_s"),
    )


def equal_set_aliases(board_ids: DataFrame, prefer: Sequence[str] = ()) -> DataFrame:
    """`(group, board, canonical)`: boards of one account with equal, non-empty id sets, aliased to
    the preferred, else the lowest key. Candidates share a fingerprint; each is then checked id by
    id against its canonical."""
    ids = _distinct_ids(board_ids)
    profile = cut_lineage(_set_profile(ids), tidy=True)
    first = F.min(F.struct((~F.col("board").isin(*prefer)).alias("other") if prefer else F.lit(True).alias("other"), F.col("board")))
    elected = profile.groupBy("group", "size", "_x", "_s").agg(first.alias("_c")).select("group", "size", "_x", "_s", F.col("_c.board").alias("canonical"))
    pairs = profile.join(elected, ["group", "size", "_x", "_s"]).filter(F.col("board") != F.col("canonical")).select("group", "board", "canonical", "size")
    return _equal_verified(ids, pairs, profile.count() <= _MOST_SENT).select("group", "board", "canonical")


def _by_board(ids: DataFrame, boards: DataFrame, on: list[str], few: bool, how: str = "inner") -> DataFrame:
    """`ids` joined with rows of boards, which are sent to all where there are few boards, so that the ids stay where they are."""
    return ids.join(F.broadcast(boards), on, how) if few else ids.hint("merge").join(boards, on, how)


def _equal_verified(ids: DataFrame, pairs: DataFrame, few: bool = False) -> DataFrame:
    """The pairs whose canonical, of `csize` ids (else of the board's `size`), lists every id of the board.

    All boards of a canonical are inside it if together with it they list no more ids than it does; only where they list
    more (or an unknown id) is each compared with its canonical. Boards that share a hash only add ids.
    """
    pairs = cut_lineage(pairs, tidy=True)
    csize = F.col("csize" if "csize" in pairs.columns else "size")
    number = lambda board: F.xxhash64("group", board)
    members = pairs.select(number("board").alias("_h"), number("canonical").alias("_c")).unionAll(pairs.select(number("canonical").alias("_h"), number("canonical").alias("_c"))).distinct()
    listed = _by_board(ids.select(number("board").alias("_h"), "id"), members, ["_h"], few).groupBy("_c", "id").agg(F.lit(1).alias("_one"))
    sets = cut_lineage(listed.groupBy("_c").agg(F.count("id").alias("_n"), F.count(F.lit(1)).alias("_rows")), tidy=True)
    judged = pairs.withColumn("_c", number("canonical")).join(sets, "_c")
    equal = (F.col("_n") == csize) & (F.col("_rows") == csize)
    sure = judged.filter(equal).select(*pairs.columns)
    unlike = judged.filter(~equal).select(*pairs.columns)
    return sure.unionByName(_verified(ids, unlike, few).select(*pairs.columns)) if unlike.head(1) else sure


def _verified(ids: DataFrame, pairs: DataFrame, few: bool = False) -> DataFrame:
    """The pairs whose canonical lists every id of the board. `ids` are distinct."""
    pairs = cut_lineage(pairs, tidy=True)
    mine = _by_board(ids, pairs, ["group", "board"], few)
    theirs = _by_board(ids.withColumnRenamed("board", "canonical"), pairs.select("group", "canonical").distinct(), ["group", "canonical"], few, "left_semi")
    shared = mine.join(theirs, ["group", "canonical", "id"]).groupBy(*pairs.columns).agg(F.count(F.lit(1)).alias("_shared"))
    return cut_lineage(shared.filter(F.col("_shared") == F.col("size")).select(*pairs.columns), tidy=True)


def bury_contained(board_ids: DataFrame, keep_public: bool = False) -> DataFrame:
    """`(group, board, onto)`: boards whose id set another board of their group contains.

    `board_ids`: group, board, id. Equal sets keep the lowest key; a strict subset goes to its
    largest container, then the lowest key; overlapping sets both stay. Under `keep_public` a
    non-public board is never kept by a public one's loss: only public boards can be containers.

    Only one board per distinct set is compared, and only with the boards that list its rarest id:
    a container must list every id, so it lists that one. No other pair is formed.
    """
    # Read many times below, so it is written once; so is each step, whose shuffle files then go.
    ids = _distinct_ids(board_ids)
    profile = cut_lineage(_set_profile(ids), tidy=True)
    few = profile.count() <= _MOST_SENT
    hosts = profile.filter(~is_non_public(F.col("board"))) if keep_public else profile
    reps = hosts.groupBy("group", "size", "_x", "_s").agg(F.min("board").alias("canonical"))
    equal = profile.join(reps, ["group", "size", "_x", "_s"]).filter(F.col("board") != F.col("canonical")).select("group", "board", "canonical", "size")
    equal = cut_lineage(_equal_verified(ids, equal, few).select("group", "board", F.col("canonical").alias("onto")), tidy=True)
    # Twins follow their canonical; the ids of the others, where known.
    lists = _by_board(ids.dropna(), equal.select("group", "board"), ["group", "board"], few, "left_anti")
    on_boards = cut_lineage(lists.groupBy("group", "id").agg(F.count(F.lit(1)).alias("_n")), tidy=True)
    rarest = lists.join(on_boards, ["group", "id"]).groupBy("group", "board").agg(F.min(F.struct("_n", "id")).alias("_r"))
    # Nobody else lists an id that is on one board.
    rarest = cut_lineage(rarest.filter(F.col("_r._n") > 1).select("group", "board", F.col("_r.id").alias("id")), tidy=True)
    key = F.xxhash64("group", "id")
    asked = _by_board(lists.withColumn("_k", key), rarest.select(key.alias("_k")).distinct(), ["_k"], few, "left_semi").select("group", "id", F.col("board").alias("canonical"))
    if keep_public:
        asked = asked.filter(~is_non_public(F.col("canonical")))
    sizes = profile.select("group", "board", "size")
    pairs = rarest.join(asked, ["group", "id"]).filter(F.col("board") != F.col("canonical")).join(sizes, ["group", "board"])
    pairs = pairs.join(sizes.select("group", F.col("board").alias("canonical"), F.col("size").alias("csize")), ["group", "canonical"])
    pairs = cut_lineage(pairs.filter(F.col("csize") > F.col("size")).select("group", "board", "canonical", "size", "csize"), tidy=True)
    # The largest container first; the others only of boards that it does not contain.
    place = F.struct((-F.col("csize")).alias("neg"), F.col("canonical").alias("onto"), F.col("size"))
    first = pairs.groupBy("group", "board").agg(F.min(place).alias("_o")).select("group", "board", F.col("_o.onto").alias("canonical"), F.col("_o.size").alias("size"), (-F.col("_o.neg")).alias("csize"))
    inside = cut_lineage(_equal_verified(ids, first, few), tidy=True)
    rest = pairs.join(inside.select("group", "board"), ["group", "board"], "left_anti").join(first.select("group", "board", "canonical"), ["group", "board", "canonical"], "left_anti")
    if rest.head(1):
        inside = inside.unionByName(_verified(ids, rest, False))
    strict = inside.groupBy("group", "board").agg(F.min(place).alias("_o")).select("group", "board", F.col("_o.onto").alias("onto"))
    # An equal set follows its twin, which may itself be buried.
    final = equal.select("group", "board", F.col("onto").alias("_twin")).join(
        strict.select("group", F.col("board").alias("_twin"), F.col("onto").alias("_up")), ["group", "_twin"], "left"
    ).select("group", "board", F.coalesce("_up", "_twin").alias("onto"))
    return strict.unionByName(final)


def cross_source_duplicates(boards: DataFrame) -> DataFrame:
    """Boards whose registrable domain at least two sources claim. `boards`: ats, board, url."""
    rows = boards.withColumn("domain", registrable_domain(host_of(F.col("url")))).filter(F.col("domain") != "")
    claimed = rows.groupBy("domain").agg(F.min("ats").alias("_a"), F.max("ats").alias("_b")).filter(F.col("_a") != F.col("_b"))
    return rows.join(claimed.select("domain"), "domain", "left_semi")


def covered_by_backing(postings: DataFrame, pairs: DataFrame, eligible: DataFrame, residual: float = R.RESIDUAL_SHARE) -> DataFrame:
    """`(front, verdict, onto)`: a front is buried onto its backing boards when every in-domain
    posting has a served copy there and few postings are on none of them; else why not.

    `postings`: board, id, key, tech. `pairs`: front, backing. A backing board that is itself
    buried is followed to what it was buried onto; fronts that back each other in a cycle are
    refused. Fronts are settled in rounds, as many as the longest chain of fronts.
    """
    links = pairs.select("front", "backing").distinct()
    settled = None
    waiting = cut_lineage(links)
    while True:
        pending = waiting.select(F.col("front").alias("backing")).distinct()
        blocked = waiting.join(pending, "backing", "left_semi").select("front").distinct()
        ready = waiting.join(blocked, "front", "left_anti")
        if ready.limit(1).count() == 0:
            break
        done = _cover_round(postings, ready, eligible, residual)
        settled = cut_lineage(done if settled is None else settled.unionByName(done))
        waiting = waiting.join(settled.select("front"), "front", "left_anti")
        # A buried partner is replaced by the boards it was buried onto.
        moved = settled.filter(F.col("verdict") == "buried").select(F.col("front").alias("backing"), F.explode(F.split("onto", ",")).alias("_to"))
        waiting = cut_lineage(waiting.join(moved, "backing", "left").select("front", F.coalesce("_to", "backing").alias("backing")).distinct())
    cycle = waiting.select("front").distinct().select("front", F.lit("backing boards form a cycle").alias("verdict"), F.lit(None).cast("string").alias("onto"))
    return cycle if settled is None else settled.unionByName(cycle)


def _cover_round(postings: DataFrame, links: DataFrame, eligible: DataFrame, residual: float) -> DataFrame:
    ok = eligible.select(F.col("board").alias("backing")).distinct().withColumn("_ok", F.lit(True))
    read = postings.select(F.col("board").alias("backing")).distinct().withColumn("_read", F.lit(True))
    partners = links.join(ok, "backing", "left").join(read, "backing", "left").groupBy("front").agg(
        F.bool_and(F.col("_ok").isNotNull()).alias("_eligible"), F.bool_and(F.col("_read").isNotNull()).alias("_readable"),
        F.array_join(F.array_sort(F.collect_set("backing")), ",").alias("onto"),
    )
    held = postings.join(links, postings["board"] == links["backing"]).groupBy("front", "key").agg(F.bool_or("tech").alias("_served"))
    mine = postings.join(links.select("front").distinct(), postings["board"] == F.col("front")).select("front", "key", "tech")
    matched = mine.join(held, ["front", "key"], "left").groupBy("front").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_served").isNull()).alias("_none"),
        F.count_if(F.col("tech") & ~F.coalesce("_served", F.lit(False))).alias("_unserved"),
    )
    rows = partners.join(matched, "front", "left")
    verdict = (
        F.when(~F.col("_eligible"), "a backing board is not live").when(~F.col("_readable"), "a backing board is unread")
        .when(F.coalesce("_n", F.lit(0)) == 0, "its own listing is unread or empty").when(F.col("_unserved") > 0, "in-domain postings without a served copy")
        .when(F.col("_none") > F.col("_n") * residual, "postings on no backing board").otherwise("buried")
    )
    return rows.select("front", verdict.alias("verdict"), F.when(verdict == "buried", F.col("onto")).alias("onto"))


def front_duplication(apply_urls: DataFrame, boards: DataFrame) -> DataFrame:
    """Per front, the share of postings whose apply link lands on a held board, by host and first
    path part where the board states one, else by host. `apply_urls`: front, url. `boards`: board, url."""
    part = lambda url: F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^https?://[^/]+/([^/?#]+)", 1)), F.lit("")), F.lit(""))
    held = boards.select(host_of(F.col("url")).alias("_host"), part(F.col("url")).alias("_part"), F.lower("board").alias("_board")).filter(F.col("_host") != "")
    held = held.groupBy("_host", "_part").agg(F.min("_board").alias("_board"))
    rows = apply_urls.select("front", host_of(F.col("url")).alias("_host"), part(F.col("url")).alias("_path"))
    by_path = rows.join(held, (rows["_host"] == held["_host"]) & (rows["_path"] == held["_part"]), "left").select("front", rows["_host"].alias("_host"), F.col("_board").alias("_by_path"))
    by_host = by_path.join(held.filter(F.col("_part") == "").select(F.col("_host").alias("_h"), F.col("_board").alias("_by_host")), F.col("_host") == F.col("_h"), "left")
    found = F.coalesce("_by_path", "_by_host")
    return by_host.groupBy("front").agg(F.count(F.lit(1)).alias("postings"), F.count(found).alias("duplicated")).withColumn(
        "share", F.round(F.col("duplicated") / F.col("postings"), 6)
    )


# --- ledgers ---------------------------------------------------------------------------------


def active_boards(ledger: DataFrame, excluded: DataFrame | None = None, parked: DataFrame | None = None,
                  aliases: DataFrame | None = None, min_jobs: int = 0) -> DataFrame:
    """`(board, jobs, checked_at, place)`: the boards whose newest verdict is live.

    `ledger`: board, status, jobs, checked_at, place (its position in the ledger). A dead verdict
    newer than the newest live one takes a board out; the same day keeps it; unknown never counts.
    The key is the smallest live spelling, the row its newest live row, first listed among equals.
    Excluded boards and aliases leave before the election, parked ones after it.
    """
    rows = ledger.withColumn("_key", F.lower("board"))
    for gone in (excluded, aliases):
        if gone is not None:
            rows = rows.join(gone.select(F.lower("board").alias("_key")).distinct(), "_key", "left_anti")
    live = F.col("status") == "live"
    per_spelling = rows.groupBy("_key", "board").agg(
        F.max(F.when(live, F.col("checked_at"))).alias("_live"), F.max(F.when(F.col("status") == "dead", F.col("checked_at"))).alias("_dead"),
        F.max(F.when(live, F.struct("checked_at", (-F.col("place")).alias("neg"), "jobs"))).alias("_row"),
    )
    per_board = per_spelling.groupBy("_key").agg(
        F.max("_live").alias("_live"), F.max("_dead").alias("_dead"),
        F.min(F.when(F.col("_live").isNotNull(), F.struct(F.col("board"), F.col("_row")))).alias("_w"),
    )
    kept = per_board.filter(F.col("_live").isNotNull() & (F.col("_dead").isNull() | (F.col("_dead") <= F.col("_live"))))
    if parked is not None:
        kept = kept.join(parked.select(F.lower("board").alias("_key")).distinct(), "_key", "left_anti")
    out = kept.select(F.col("_w.board").alias("board"), F.col("_w._row.jobs").alias("jobs"), F.col("_w._row.checked_at").alias("checked_at"), (-F.col("_w._row.neg")).alias("place"))
    return out.filter(F.coalesce("jobs", F.lit(0)) >= min_jobs)


def due_for_check(ledger: DataFrame, today: str, ttl: dict[str, int] | None = None) -> DataFrame:
    """Ledger rows never checked, past their verdict's time to live, or with an unreadable date."""
    days = ttl or R.RECHECK_DAYS
    limit = F.when(F.col("status") == "live", days["live"]).when(F.col("status") == "dead", days["dead"]).otherwise(days["unknown"])
    age = F.datediff(F.lit(today).cast("date"), F.col("checked_at").try_cast("date"))
    return ledger.filter(F.col("status").isNull() | age.isNull() | (age >= limit))


def gone_pool(failures: DataFrame, ledger: DataFrame, strikes: int = R.QUARANTINE_AT) -> DataFrame:
    """Ledger rows of boards that keep being found gone."""
    bad = failures.filter(F.col("streak") >= strikes).select(F.lower("board").alias("_key")).distinct()
    return ledger.join(bad, F.lower(ledger["board"]) == F.col("_key"), "left_semi")


# --- copies of one posting -------------------------------------------------------------------


def title_key(title: Column) -> Column:
    return squash(F.lower(F.coalesce(title, F.lit(""))))


def title_stem(title: Column) -> Column:
    """The title without its bracketed parts."""
    return squash(F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"\([^)]*\)|\[[^\]]*\]", " ")))


def employer_words(company: Column) -> Column:
    """The company's words without generic and legal ones, joined."""
    generic = [*LEGAL_FORMS, "group", "holdings", "technologies", "technology", "solutions", "services", "global", "international", "the"]
    words = F.filter(F.split(fold(F.coalesce(company, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*generic))
    return F.array_join(words, " ")


def first_place(location: Column) -> Column:
    """The words of the city a location names first, each once, in order of the alphabet."""
    head = F.split(F.split(F.coalesce(location, F.lit("")), "[;|]").getItem(0), ",").getItem(0)
    words = F.filter(F.split(fold(head), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def _copy_columns(df: DataFrame) -> DataFrame:
    countries = F.array_join("countries", ",") if "countries" in df.columns else F.lit("")
    pay = F.concat_ws("/", F.col("min_salary_annual").cast("string"), F.col("max_salary_annual").cast("string"), F.col("salary_currency"))
    return df.select(
        "id", F.lower("board").alias("board"), F.col("ord"), title_key(F.col("title")).alias("_title"), title_stem(F.col("title")).alias("_stem"),
        F.lower(F.trim(F.coalesce("company", F.lit("")))).alias("_name"), employer_words(F.col("company")).alias("_words"),
        first_place(F.col("location")).alias("_place"), countries.alias("_countries"),
        F.when(F.col("min_salary_annual").isNotNull() | F.col("max_salary_annual").isNotNull(), pay).alias("_pay"),
    )


def posting_groups(df: DataFrame) -> DataFrame:
    """`(id, leader)`: rows of one posting on several boards, led by the first.

    `df`: id, ord, board, title, company, location, countries, pay. Rows with one title, employer
    words, first place and countries are copies, at most one a board in each group; the k-th row of
    every board forms the k-th group, which is what taking the first group with a free board
    gives. The numbering never gathers a class in one task.
    """
    rows = _copy_columns(df)
    named = (F.col("_title") != "") & (F.col("_name") != "") & (F.col("_place") != "")
    key = F.when(named, F.concat_ws("\x1f", "_title", F.when(F.col("_words") != "", F.col("_words")).otherwise(F.col("_name")), "_place", "_countries"))
    classes = rows.select("id", "ord", "board", F.coalesce(key, F.concat(F.lit("\x1e"), F.col("id"))).alias("_class"))
    classes = cut_lineage(classes)  # read five times below
    # Most classes hold one row a board; only the others need their rows numbered.
    several = classes.groupBy("_class", "board").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_class", "board")
    single = classes.join(several, ["_class", "board"], "left_anti").withColumn("_k", F.lit(1).cast("bigint"))
    many = group_row_number(classes.join(several, ["_class", "board"], "left_semi").select("id", "ord", "board", "_class"), ["_class", "board"], [F.col("ord"), F.col("id")], "_k")
    numbered = single.unionByName(many.withColumn("_k", F.col("_k").cast("bigint")))
    leaders = numbered.groupBy("_class", "_k").agg(F.min(F.struct("ord", "id")).alias("_l"))
    return numbered.join(leaders, ["_class", "_k"]).select("id", F.col("_l.id").alias("leader"))


def requisition_groups(df: DataFrame) -> DataFrame:
    """`(id, leader)`: rows of one requisition, led by the first.

    A row belongs to the earliest leader it matches: the same title without brackets, and the same
    company name, or another spelling of it in the same first place and countries, or a name that
    begins with the other's words with the same pay and countries. Rows without a company match
    only on their own board.

    All rows of one title and name are one class and share one leader, so a class is one row here:
    its profiles (place, countries, pay) with the first row of each. Leaders are found by rounds
    over the profiles: each class keeps its first profile no earlier leader of another class
    matches, until nothing moves.
    """
    rows = _copy_columns(df).withColumn("_name", F.when(F.col("_name") == "", F.concat(F.lit("\x1e"), F.col("board"))).otherwise(F.col("_name")))
    rows = rows.withColumn("_stem", F.when(F.col("_stem") == "", F.concat(F.lit("\x1e"), F.col("id"))).otherwise(F.col("_stem")))
    unnamed = F.col("_name").startswith("\x1e")
    head = F.when(unnamed | (F.col("_words") == ""), F.col("_name")).otherwise(F.split("_words", " ").getItem(0))
    rows = rows.withColumn("_head", head)
    traits = ["_stem", "_head", "_name", "_words", "_place", "_countries", "_pay"]
    # A profile's number is written with it, so it stays the same in every read.
    profiles = cut_lineage(rows.groupBy(*traits).agg(F.min(F.struct("ord", "id")).alias("first")).withColumn("_p", F.monotonically_increasing_id()))
    classes = ["_stem", "_head", "_name"]
    first_profile = F.min(F.struct("first", "_words", "_place", "_countries", "_pay")).alias("l")
    # Only names that another name equals in words, or begins, can meet; all other classes keep their first row.
    open_profiles = cut_lineage(profiles.join(_related_names(profiles), ["_head", "_name"], "left_semi"))
    current = cut_lineage(open_profiles.groupBy(*classes).agg(first_profile))
    moving = current.head(1)
    while moving:  # each round settles at least the earliest open leader for good
        free = open_profiles.join(_earliest_leader(open_profiles, current), "_p", "left_anti")
        again = cut_lineage(free.groupBy(*classes).agg(first_profile))
        moved = again.join(current.select(*classes, F.col("l.first").alias("_was")), classes, "full_outer")
        moving = moved.filter(~F.col("l.first").eqNullSafe(F.col("_was"))).head(1)
        current = again
    own = profiles.groupBy(*classes).agg(F.min("first").alias("_own"))
    open_classes = open_profiles.select(*classes).distinct().withColumn("_open", F.lit(True))
    own = own.join(open_classes, classes, "left").join(current.select(*classes, F.col("l.first").alias("_own_open")), classes, "left")
    # A profile's candidates: another class's earliest matching leader, and its own class's.
    own = own.select(*classes, F.when(F.col("_open"), F.col("_own_open")).otherwise(F.col("_own")).alias("_own_first"))
    led = profiles.join(own, classes).join(_earliest_leader(open_profiles, current), "_p", "left")
    leader_rows = led.select(*[F.col(c).alias(f"t_{c}") for c in traits], F.least("_to", "_own_first").alias("_leader"))
    out = rows.join(leader_rows, _all_same(rows, leader_rows, traits))
    return out.select("id", F.col("_leader.id").alias("leader"))


def _all_same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[f"t_{n}"])
    return out


def _beginnings(words: Column) -> Column:
    """All proper beginnings of some words, by whole words."""
    parts = F.split(words, " ")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), " "))).otherwise(
        F.array().cast("array<string>"))


def _related_names(profiles: DataFrame) -> DataFrame:
    """`(_head, _name)` of names whose words another name of their block has, or begins with, or that begin with another's."""
    names = profiles.filter(F.col("_words") != "").select("_head", "_name", "_words").distinct()
    forms = names.select("_head", "_name", F.explode(F.concat(F.array("_words"), _beginnings(F.col("_words")))).alias("_form"), "_words")
    forms = forms.select("_head", "_name", "_form", (F.col("_form") == F.col("_words")).alias("_whole"))
    met = forms.groupBy("_head", "_form").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_whole").alias("_held")).filter((F.col("_n") > 1) & F.col("_held"))
    return forms.join(met, ["_head", "_form"], "left_semi").select("_head", "_name").distinct()


def _earliest_leader(profiles: DataFrame, leaders: DataFrame) -> DataFrame:
    """`(_p, _to)` of profiles that an earlier leader of another class in their block matches, with the earliest.

    The ways to match are equal keys: the words, place and countries, or the words that one begins with, pay and countries.
    A key carries its earliest leader, and its earliest of another name, so no pairs of classes are formed.
    """
    def keys(name, trait, words):
        return F.transform(words, lambda w: F.struct(F.lit(name).alias("_way"), w.alias("_form"), trait.alias("_trait")))

    def ways(place, pay, words, longer_of, shorter_of):
        none = F.array().cast("array<struct<_way:string,_form:string,_trait:string>>")
        alike = F.when(place != "", keys("alike", place, F.array(words))).otherwise(none)
        paid = (pay.isNotNull()) & (F.col("_lands") != "")
        return F.concat(alike, F.when(paid, F.concat(keys("longer", pay, longer_of), keys("shorter", pay, shorter_of))).otherwise(none))

    words, own = F.col("_words"), F.array(F.col("_words"))
    asks = profiles.filter(words != "").select("_p", "_stem", "_head", "_name", "_words", "first", F.col("_countries").alias("_lands"), "_place", "_pay")
    asks = asks.select("_p", "_stem", "_head", "_name", "first", "_lands", F.inline(ways(F.col("_place"), F.col("_pay"), words, _beginnings(words), own)))
    held = leaders.select("_stem", "_head", "_name", F.col("l.first").alias("_to"), F.col("l._words").alias("_words"), F.col("l._place").alias("_place"),
                          F.col("l._countries").alias("_lands"), F.col("l._pay").alias("_pay")).filter(words != "")
    held = held.select("_stem", "_head", "_name", "_to", "_lands", F.inline(ways(F.col("_place"), F.col("_pay"), words, own, _beginnings(words))))
    key = ["_stem", "_head", "_lands", "_way", "_form", "_trait"]
    best = held.groupBy(*key).agg(F.min(F.struct("_to", "_name")).alias("_b"))
    second = held.join(best, key).filter(F.col("_name") != F.col("_b._name")).groupBy(*key).agg(F.min("_to").alias("_next"))
    best = best.join(second, key, "left").select(*key, F.col("_b._to").alias("_to"), F.col("_b._name").alias("_by"), "_next")
    other = F.when(F.col("_by") == F.col("_name"), F.col("_next")).otherwise(F.col("_to"))
    met = asks.join(best, key).select("_p", "first", other.alias("_to")).filter(F.col("_to") < F.col("first"))
    return met.groupBy("_p").agg(F.min("_to").alias("_to"))


# --- companies -------------------------------------------------------------------------------


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`(node, component)`: the lowest node reachable over the edges (a, b).

    Labels travel by joins, and each round also jumps to the label of the label, so long chains
    settle in few rounds. Only labels are written between rounds.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:  # labels only fall, so rounds end
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("_near"))
        least = labels.join(around, labels["node"] == around["a"], "left").select("node", F.least("component", F.coalesce("_near", "component")).alias("_c"), F.col("component").alias("_old"))
        hop = least.select(F.col("node").alias("_n"), F.col("_c").alias("_cc"))
        jumped = cut_lineage(least.join(hop, least["_c"] == hop["_n"], "left").select("node", F.least("_c", F.coalesce("_cc", "_c")).alias("component"), "_old"))
        moved = jumped.filter(F.col("component") != F.col("_old")).limit(1).count()
        labels = jumped.select("node", "component")
        if not moved:
            return labels


def group_companies(boards: DataFrame, curated: DataFrame) -> DataFrame:
    """`(board, company_id, name, operator)`: boards joined by tenant or curated alias.

    `boards`: board, source, tenant, stated (its own name or null), operator. `curated`: board, name.
    The name is a curated alias, else one at least half the boards state, else the tenant of the
    first board. A key shared by many boards is a star to its first board, never all their pairs.
    """
    aliases = curated.groupBy(F.lower("board").alias("_key")).agg(F.min("name").alias("_alias"))
    rows = boards.join(aliases, F.lower(boards["board"]) == F.col("_key"), "left").drop("_key")
    keyed = rows.select("board", F.explode(F.array_compact(F.array(
        F.concat(F.col("source"), F.lit(":"), F.lower("tenant")), F.concat(F.lit("alias:"), F.lower("_alias"))
    ))).alias("_k"))
    hubs = keyed.groupBy("_k").agg(F.min("board").alias("_hub"))
    edges = keyed.join(hubs, "_k").filter(F.col("board") != F.col("_hub")).select(F.col("board").alias("a"), F.col("_hub").alias("b"))
    parts = connected_components(edges, rows.select(F.col("board").alias("node")))
    rows = rows.join(parts, rows["board"] == parts["node"]).drop("node")
    votes = rows.groupBy("component", "stated").agg(F.count(F.lit(1)).alias("_n"))
    named = votes.groupBy("component").agg(
        F.sum("_n").alias("_boards"), F.min(F.when(F.col("stated").isNotNull(), F.struct((-F.col("_n")).alias("neg"), F.col("stated")))).alias("_v")
    )
    kind = F.when(F.col("operator") == "aggregator", 0).when(F.col("operator") == "staffing", 1).when(F.col("operator") == "services", 2).otherwise(3)
    facts = rows.groupBy("component").agg(
        F.min("_alias").alias("_alias"), F.min(F.struct("board", "tenant")).alias("_first"), F.min(F.struct(kind.alias("k"), F.col("operator"))).alias("_op")
    )
    voted = F.when(-F.col("_v.neg") * 2 >= F.col("_boards"), F.col("_v.stated"))
    company = facts.join(named, "component").select(
        "component", F.coalesce("_alias", voted, F.initcap("_first.tenant")).alias("name"), F.col("_op.operator").alias("operator")
    )
    return rows.select("board", "component").join(company, "component").select("board", F.col("component").alias("company_id"), "name", "operator")
