"""Registered queries: snapshot diffs, texts, derivations, vectors and checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff
from ..operators.clean import content_fingerprints
from .registry import query

N = "CAST(split_part(id, ':', 3) AS BIGINT)"
HASH = "md5(concat_ws(chr(31), 'title=' || title, 'location=' || location, 'employment_type=' || employment_type, 'min_salary_annual=' || CAST(min_salary_annual AS STRING)))"
HASHED = "SELECT id, board, " + HASH + " AS fields_hash FROM {{{}}}"


def _hashed(b, name):
    return b.sql(HASHED.format(name))


# Ids with a colon in the native part, and board keys of two depths.
OWNED = "SELECT CASE WHEN " + N + " % 3 = 0 THEN upper(board) || ':' || split_part(id, ':', 3) WHEN " + N + " % 3 = 1 THEN board || ':REQ: ' || split_part(id, ':', 3) ELSE 'gone:' || id END AS id FROM {postings}"


@query("longest_prefix_join", f"""
    WITH x AS (SELECT DISTINCT id FROM ({OWNED.format(postings='postings')})),
    c AS (SELECT id, b.board AS hit FROM x LEFT JOIN (SELECT DISTINCT lower(board) AS board FROM boards WHERE in_scope) b
          ON lower(x.id) LIKE replace(b.board, '_', '\\_') || ':%' ESCAPE '\\' AND split_part(lower(x.id), ':', 1) = split_part(b.board, ':', 1)),
    m AS (SELECT id, max(length(hit)) AS n FROM c GROUP BY id)
    SELECT id, CASE WHEN n IS NOT NULL THEN substring(id, 1, n) ELSE regexp_replace(id, ':[^:]*$', '') END AS owner, n IS NOT NULL AS listed,
           split_part(id, ':', 1) AS source,
           regexp_extract(CASE WHEN n IS NOT NULL THEN substring(id, 1, n) ELSE regexp_replace(id, ':[^:]*$', '') END, '^[^:]*:([^/]*)', 1) AS tenant FROM m""")
def _prefix(b):
    ids = b.sql(OWNED).distinct()
    return diff.longest_prefix_join(ids, b.boards.filter("in_scope")).select("id", "owner", "listed", "source", "tenant")


READS = "SELECT CASE WHEN jobs % 2 = 0 THEN upper(board) ELSE board END AS board, CASE WHEN NOT in_scope THEN 'failed' WHEN jobs % 7 = 3 THEN 'truncated' ELSE 'ok' END AS outcome FROM {boards}"
FULL_BOARDS = "SELECT lower(board) AS board FROM boards WHERE in_scope AND jobs % 7 <> 3"
KEPT_BOARDS = "SELECT board FROM boards WHERE jobs % 5 <> 1"


@query("scrape_scope", FULL_BOARDS.replace("lower(board) AS board", "lower(board) AS board_key"))
def _scope(b):
    return diff.scrape_scope(b.sql(READS)).select("board_key")


@query("diff_listing", f"""
    WITH s AS (SELECT id, board, {HASH} AS h FROM fresh), p AS (SELECT id, board, {HASH} AS h FROM prior)
    SELECT coalesce(s.id, p.id) AS id, coalesce(s.board, p.board) AS board,
           CASE WHEN p.id IS NULL THEN 'listed' WHEN s.id IS NOT NULL AND s.h <> p.h THEN 'changed' WHEN s.id IS NOT NULL THEN 'unchanged'
                WHEN p.board IN ({FULL_BOARDS}) THEN 'unlisted' WHEN p.board NOT IN ({KEPT_BOARDS}) THEN 'off_board' ELSE 'still_listed' END AS kind
    FROM s FULL JOIN p ON s.id = p.id, (SELECT 1 FROM boards LIMIT 1) z""")
def _diff(b):
    scope = diff.scrape_scope(b.sql(READS))
    return diff.diff_listing(_hashed(b, "fresh"), _hashed(b, "prior"), scope, b.boards.filter("jobs % 5 <> 1"))


WAITING = "SELECT id, board FROM {postings} WHERE " + N + " % 14 = 7"


@query("sync_diff", f"""
    WITH u AS ({WAITING.format(postings='postings')}),
    a AS (SELECT coalesce(p.id, f.id, u.id) AS id, coalesce(p.board, f.board, u.board) AS board, p.id IS NOT NULL AS have, f.id IS NOT NULL AS seen, u.id IS NOT NULL AS waited
          FROM prior p FULL JOIN fresh f ON p.id = f.id FULL JOIN u ON coalesce(p.id, f.id) = u.id),
    j AS (SELECT a.*, a.board IN ({FULL_BOARDS}) OR CAST(split_part(id, ':', 3) AS BIGINT) % 35 = 14 AS judged, a.board IN ({KEPT_BOARDS}) AS live FROM a, (SELECT 1 FROM boards LIMIT 1) z)
    SELECT id, board, action FROM (SELECT id, board,
        CASE WHEN seen AND NOT have THEN 'add' WHEN have AND NOT seen AND judged AND waited THEN 'delete' WHEN have AND NOT seen AND judged THEN 'unconfirmed'
             WHEN waited AND NOT judged AND live THEN 'unconfirmed' WHEN have THEN 'keep' END AS action FROM j) WHERE action IS NOT NULL""")
def _sync(b):
    rejected = b.postings.select("id").filter(f"{N} % 35 = 14")
    return diff.sync_diff(b.prior.select("id", "board"), b.fresh.select("id", "board"), diff.scrape_scope(b.sql(READS)),
                          b.sql(WAITING), b.boards.filter("jobs % 5 <> 1"), rejected=rejected)


@query("apply_sync", f"""
    SELECT id, min_salary_annual FROM prior WHERE {N} % 4 <> 1 AND id NOT IN (SELECT id FROM fresh WHERE {N} % 11 = 0)
    UNION ALL SELECT id, min_salary_annual FROM fresh WHERE {N} % 11 = 0""")
def _apply(b):
    cols = ["id", "min_salary_annual"]
    return diff.apply_sync(b.prior.select(*cols), b.fresh.select(*cols).filter(f"{N} % 11 = 0"), b.prior.select("id").filter(f"{N} % 4 = 1"))


@query("added_removed_kept", """
    SELECT coalesce(p.id, f.id) AS id, CASE WHEN p.id IS NULL THEN 'added' WHEN f.id IS NULL THEN 'removed' ELSE 'kept' END AS change
    FROM prior p FULL JOIN fresh f ON p.id = f.id""")
def _arc(b):
    return diff.added_removed_kept(b.prior, b.fresh)


HELD = "SELECT id, CASE WHEN " + N + " % 4 = 1 THEN replace(description, 'Java', 'Jäva') WHEN " + N + " % 4 = 2 THEN 'old ' || description ELSE description END AS description FROM {prior} WHERE description IS NOT NULL"
CHANGES = "SELECT id, CAST(2 AS BIGINT) AS count, CASE WHEN " + N + " % 3 = 0 THEN md5(description) ELSE 'x' END AS previous_hash FROM {prior} WHERE " + N + " % 2 = 0"
FRESH = "SELECT id, CASE WHEN " + N + " % 4 = 1 THEN replace(description, 'Java', 'J?va') ELSE description END AS description FROM {fresh}"


@query("fill_descriptions", f"""
    WITH h AS ({HELD.format(prior='prior')}), g AS ({CHANGES.format(prior='prior')}), f AS ({FRESH.format(fresh='fresh')}),
    j AS (SELECT f.id, f.description AS fresh, h.description AS held, g.count, g.previous_hash FROM f LEFT JOIN h ON f.id = h.id LEFT JOIN g ON f.id = g.id),
    o AS (SELECT *, CASE WHEN fresh IS NULL AND held IS NULL THEN 'unrecorded' WHEN fresh IS NULL THEN 'filled' WHEN held IS NULL THEN 'learned' WHEN fresh = held THEN 'same'
                 WHEN {N} % 4 = 1 AND held LIKE '%Jäva%' THEN 'kept_over_question_marks' WHEN previous_hash = md5(fresh) THEN 'reverted' ELSE 'replaced' END AS outcome FROM j)
    SELECT id, outcome, CASE WHEN outcome IN ('filled', 'kept_over_question_marks') THEN held ELSE fresh END AS description,
           CASE WHEN outcome IN ('replaced', 'reverted') THEN coalesce(count, 0) + 1 ELSE count END AS change_count,
           CASE WHEN outcome IN ('replaced', 'reverted') THEN md5(held) ELSE previous_hash END AS previous_hash FROM o""")
def _fill(b):
    return diff.fill_descriptions(b.sql(FRESH), b.sql(HELD), b.sql(CHANGES)).select("id", "outcome", "description", "change_count", "previous_hash")


FRAGMENTS = "SELECT conv_id AS id, turn AS seq, text, role FROM {conversations}"


@query("compact_text_store", """
    SELECT id, seq, text FROM (SELECT conv_id AS id, turn AS seq, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations) WHERE n = 1""")
def _compact(b):
    return diff.compact_text_store(b.sql(FRAGMENTS).select("id", "seq", "role", "text")).select("id", "seq", "text")


@query("backfill_text", f"""
    WITH h AS ({HELD.format(prior='prior')})
    SELECT f.id, coalesce(f.description, h.description) AS description FROM fresh f LEFT JOIN h ON f.id = h.id""")
def _backfill(b):
    return diff.backfill_text(b.fresh.select("id", "description"), b.sql(HELD))


SQUASHED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query("content_drift", f"""
    WITH a AS ({HELD.format(prior='prior')}), c AS (SELECT id, description FROM fresh)
    SELECT a.id, CASE WHEN c.id IS NULL THEN 'not_returned' WHEN coalesce(trim(c.description), '') = '' THEN 'no_current_description'
           WHEN {SQUASHED.format('a.description')} = {SQUASHED.format('c.description')} THEN 'unchanged' ELSE 'different' END AS status,
           sha256({SQUASHED.format('a.description')}) AS before_hash, sha256({SQUASHED.format('c.description')}) AS after_hash,
           length(a.description) AS before_chars, coalesce(length(c.description), 0) AS after_chars
    FROM a LEFT JOIN c ON a.id = c.id""")
def _drift(b):
    return diff.content_drift(b.sql(HELD), b.fresh.select("id", "description"))


STORE = "SELECT id, title, location, employment_type, min_salary_annual, CAST(CASE WHEN min_salary_annual % 2 = 0 THEN 27 ELSE 26 END AS INT) AS rule_version, " \
        "CASE WHEN min_salary_annual IS NULL THEN NULL WHEN min_salary_annual % 5 = 0 THEN 'field' ELSE 'regex' END AS tier, min_salary_annual AS answer FROM {prior}"
SEEN_FACTS = "SELECT id, title, CASE WHEN " + N + " % 9 = 4 THEN NULL ELSE location END AS location, CASE WHEN " + N + " % 13 = 5 THEN NULL ELSE employment_type END AS employment_type, min_salary_annual FROM {fresh}"
FACTS = ("title", "location", "employment_type", "min_salary_annual")


def _derive(rows):
    """A stand-in rule: the answer follows the fact, its tier the answer's last digit."""
    tier = F.when(F.col("min_salary_annual").isNull(), F.lit(None)).when(F.col("min_salary_annual") % 5 == 0, "field").otherwise("regex")
    return rows.withColumns({"tier": tier, "answer": F.col("min_salary_annual")})


@query("refresh_metadata", f"""
    WITH s AS ({STORE.format(prior='prior')}), f AS ({SEEN_FACTS.format(fresh='fresh')}),
    j AS (SELECT s.*, f.id IS NOT NULL AS seen, CASE WHEN f.id IS NULL THEN s.location ELSE coalesce(f.location, s.location) END AS n_location,
                 CASE WHEN f.id IS NULL THEN s.employment_type ELSE f.employment_type END AS n_type,
                 CASE WHEN f.id IS NULL THEN s.min_salary_annual ELSE f.min_salary_annual END AS n_pay FROM s LEFT JOIN f ON s.id = f.id),
    r AS (SELECT *, n_location IS DISTINCT FROM location OR n_type IS DISTINCT FROM employment_type OR n_pay IS DISTINCT FROM min_salary_annual AS facts_changed,
                 n_pay IS DISTINCT FROM min_salary_annual OR coalesce(rule_version, -1) < 27 AS redone FROM j),
    d AS (SELECT *, CASE WHEN redone THEN n_pay ELSE answer END AS n_answer,
                 CASE WHEN redone THEN CASE WHEN n_pay IS NULL THEN NULL WHEN n_pay % 5 = 0 THEN 'field' ELSE 'regex' END ELSE tier END AS n_tier FROM r)
    SELECT id, n_location AS location, n_type AS employment_type, facts_changed, redone, n_tier AS tier, n_answer AS answer, CASE WHEN redone THEN 27 ELSE rule_version END AS rule_version,
           CASE WHEN n_answer IS NOT DISTINCT FROM answer AND n_tier IS NOT DISTINCT FROM tier THEN NULL WHEN tier IS NULL AND n_tier IS NOT NULL THEN 'gained'
                WHEN tier IS NOT NULL AND n_tier IS NULL THEN 'lost' WHEN tier <> n_tier THEN 'retiered' ELSE 'moved' END AS change FROM d""")
def _refresh(b):
    out = diff.refresh_metadata(b.sql(STORE), b.sql(SEEN_FACTS), FACTS, none_is_unseen=("location",), derived=("tier", "answer"), source="tier",
                                derive=_derive, inputs=("min_salary_annual",), version=27)
    return out.select("id", "location", "employment_type", "facts_changed", "redone", "tier", "answer", "rule_version", "change")


@query("refresh_served", """
    SELECT p.id, f.title, f.min_salary_annual, p.board AS first_seen FROM prior p JOIN fresh f ON p.id = f.id
    WHERE p.title IS DISTINCT FROM f.title OR p.min_salary_annual IS DISTINCT FROM f.min_salary_annual""")
def _refresh_served(b):
    served = b.prior.select("id", "title", "min_salary_annual", F.col("board").alias("first_seen"))
    return diff.refresh_served(served, b.fresh, ["title", "min_salary_annual"])


def _docs(b, name):
    rows = content_fingerprints(getattr(b, name)).withColumn("has_description", F.col("description").isNotNull())
    return rows.select("id", "board", F.split("board", ":").getItem(0).alias("source"), "doc_hash", "has_description")


DOC_HASH = "md5(trim(title) || chr(10) || trim(coalesce(description, '')))"


@query("classify_changes", f"""
    WITH c AS (SELECT id, board, split_part(board, ':', 1) AS source, {DOC_HASH} AS h, description IS NOT NULL AS d, {N} % 17 <> 0 AS kept FROM fresh),
    p AS (SELECT id, md5({DOC_HASH} || CASE WHEN {N} % 5 = 2 THEN 'x' ELSE '' END) AS h, description IS NOT NULL AND {N} % 8 <> 1 AS d FROM prior),
    s AS (SELECT c.id, c.source, c.board, CASE WHEN p.id IS NULL THEN CASE WHEN kept THEN 'new' ELSE 'rejected' END
                 WHEN NOT p.d AND c.d THEN CASE WHEN kept THEN 'upgraded' ELSE 'dropped' END
                 WHEN (NOT p.d OR c.d) AND p.h <> md5(c.h) THEN CASE WHEN kept THEN 'edited' ELSE 'dropped' END
                 WHEN c.id IN (SELECT id FROM prior WHERE {N} % 34 = 17) AND NOT kept THEN 'dropped' ELSE 'done' END AS status
          FROM c LEFT JOIN p ON c.id = p.id),
    t AS (SELECT s.id, source, row_number() OVER (PARTITION BY source ORDER BY b.score DESC NULLS LAST, s.id) AS turn FROM s LEFT JOIN boards b ON s.board = b.board WHERE status = 'edited'),
    k AS (SELECT id FROM t ORDER BY turn, source LIMIT 400)
    SELECT id, CASE WHEN status = 'edited' AND id NOT IN (SELECT id FROM k) THEN 'deferred' ELSE status END AS status FROM s""")
def _classify(b):
    corpus = _docs(b, "fresh").withColumn("kept", F.expr(f"{N} % 17 <> 0")).withColumn("doc_hash", F.md5("doc_hash"))
    prior = _docs(b, "prior").withColumn("doc_hash", F.expr(f"md5(concat(doc_hash, CASE WHEN {N} % 5 = 2 THEN 'x' ELSE '' END))"))
    prior = prior.withColumn("has_description", F.expr(f"has_description AND {N} % 8 <> 1"))
    regate = b.prior.select("id").filter(f"{N} % 34 = 17")
    return diff.classify_changes(corpus, prior, regate, cap=400, scores=b.boards.select("board", "score"))


VECS = "SELECT id, vec_id, label FROM vectors"


@query("merge_vectors", """
    SELECT id, label FROM vectors WHERE vec_id % 2 = 0 AND vec_id % 5 <> 0 AND NOT (vec_id % 4 = 0 AND vec_id % 3 <> 0)
    UNION ALL SELECT id, label + 100 FROM vectors WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 0 AND NOT (vec_id % 2 = 0 AND vec_id % 4 <> 0)""")
def _merge(b):
    v = b.vectors.select("id", "vec_id", "label")
    store = v.filter("vec_id % 2 = 0").select("id", "label")
    fragments = v.filter("vec_id % 3 <> 0").select("id", (F.col("label") + 100).alias("label"))
    return diff.merge_vectors(store, fragments.unionByName(fragments), v.filter("vec_id % 4 = 0"), v.filter("vec_id % 5 = 0"))


@query("missing_fragments", "SELECT label AS shard, count(*) AS missing FROM vectors WHERE vec_id % 3 = 0 GROUP BY 1")
def _missing(b):
    v = b.vectors
    return diff.missing_fragments(v.select("id", F.col("label").alias("shard")), v.filter("vec_id % 3 <> 0"))


@query("prune_store", """
    SELECT id, CASE WHEN vec_id % 2 = 0 OR vec_id % 7 = 0 THEN 'kept' ELSE 'archived' END AS fate FROM vectors""")
def _prune(b):
    kept, archived = diff.prune_store(b.vectors, b.vectors.filter("vec_id % 2 = 0"), b.vectors.filter("vec_id % 7 = 0"))
    return kept.select("id", F.lit("kept").alias("fate")).unionByName(archived.select("id", F.lit("archived").alias("fate")))


@query("stale_shared_vectors", """
    WITH v AS (SELECT a.id, coalesce(b.vector, a.vector) AS vector, CASE WHEN a.vec_id % 4 = 3 THEN 'other' ELSE 'same' END AS title
               FROM vectors a LEFT JOIN vectors b ON a.vec_id % 4 IN (1, 3) AND b.vec_id = a.vec_id - a.vec_id % 4)
    SELECT id FROM v WHERE vector IN (SELECT vector FROM v GROUP BY vector HAVING count(DISTINCT title) > 1)""")
def _stale(b):
    v = b.vectors
    base = v.select(F.col("vec_id").alias("_b"), F.col("vector").alias("_v"))
    shared = v.join(base, (F.col("vec_id") % 4).isin(1, 3) & (F.col("_b") == F.col("vec_id") - F.col("vec_id") % 4), "left")
    title = F.when(F.col("vec_id") % 4 == 3, " OTHER ").otherwise("same")
    return diff.stale_shared_vectors(shared.select("id", F.coalesce("_v", "vector").alias("vector"), title.alias("title")))


CHECKED = "SELECT id, first_seen AS checked_at FROM {postings} WHERE " + N + " % 5 <> 0 AND first_seen IS NOT NULL"


@query("due_for_refetch", f"""
    WITH c AS (SELECT id, CAST(substring(first_seen, 1, 19) AS TIMESTAMP) AS stamp FROM postings WHERE {N} % 5 <> 0 AND first_seen IS NOT NULL),
    h AS (SELECT p.id, coalesce(c.stamp, TIMESTAMP '2001-08-02 00:00:00' - to_hours(CAST(('0x' || substring(md5(p.id), 1, 8))::BIGINT % 168 AS INTEGER))) AS stamp FROM prior p LEFT JOIN c ON p.id = c.id)
    SELECT h.id, strftime(stamp, '%Y-%m-%d %H:%M:%S') AS checked_at, f.id IS NOT NULL AND date_diff('second', stamp, TIMESTAMP '2001-08-02 00:00:00') >= 168 * 3600 AS due
    FROM h LEFT JOIN fresh f ON h.id = f.id""")
def _refetch(b):
    return diff.due_for_refetch(b.prior, b.sql(CHECKED), b.fresh, "2001-08-02 00:00:00")


EVENTS_CHAIN = "SELECT CAST(CAST(ts AS DATE) AS STRING) AS ts, 'u' || CAST(user_id AS STRING) AS id, max(CASE WHEN event_id % 6 = 0 THEN 'removed' ELSE 'present' END) AS kind, CAST(count(*) AS STRING) AS digest FROM {events} GROUP BY 1, 2"


@query("as_of", f"""
    WITH c AS ({EVENTS_CHAIN.format(events='events')}), l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS n FROM c WHERE ts <= '2024-01-17')
    SELECT id, ts, digest FROM l WHERE n = 1 AND kind <> 'removed'""")
def _as_of(b):
    return diff.as_of(b.sql(EVENTS_CHAIN), "2024-01-17")


@query("next_checkpoint", f"""
    WITH p AS (SELECT id, {HASH} AS digest FROM prior), f AS (SELECT id, {HASH} AS digest, board FROM fresh)
    SELECT 't2' AS ts, CASE WHEN f.id IS NULL THEN 'removed' ELSE 'present' END AS kind, coalesce(p.id, f.id) AS id, f.digest, f.board
    FROM p FULL JOIN f ON p.id = f.id WHERE p.digest IS DISTINCT FROM f.digest""")
def _next(b):
    old = _hashed(b, "prior").select("id", F.col("fields_hash").alias("digest"))
    return diff.next_checkpoint(old, _hashed(b, "fresh").select("id", F.col("fields_hash").alias("digest"), "board"), "t2")


CHAIN = "SELECT ts, CASE WHEN ts = '2024-01-11' THEN '2024-01-08' ELSE before END AS previous, before IS NULL OR ts = '2024-01-15' AS baseline FROM (SELECT ts, lag(ts) OVER (ORDER BY ts) AS before FROM {methods} WHERE ts <> '2024-01-05')"


@query("checkpoint_chain", f"""
    WITH c AS ({EVENTS_CHAIN.format(events='events')}), w AS (SELECT *, lag(kind) OVER (PARTITION BY id ORDER BY ts) AS was FROM c)
    SELECT * FROM (VALUES ('2024-01-11', 'broken parent chain'), ('2024-01-15', 'missing or repeated baseline'), ('2024-01-05', 'tick without a checkpoint')) v(ts, problem)
    UNION ALL SELECT DISTINCT ts, 'removal of an unknown id' FROM w WHERE kind = 'removed' AND coalesce(was, 'removed') = 'removed'""")
def _chain(b):
    return diff.checkpoint_chain(b.sql(CHAIN), b.methods.select("ts"), b.sql(EVENTS_CHAIN))
