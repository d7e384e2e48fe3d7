"""Registered queries: the tick ledger and readings of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import ticks as T
from ..plans import trends as P
from ..rules.trends import METHOD_FIELDS
from .registry import query

LEVEL_KEY = "board, metric, family, band"


@query("levels_at", f"SELECT {LEVEL_KEY}, CAST(sum(delta) AS BIGINT) AS level FROM ticks WHERE metric = 'stock' AND ts <= '2024-01-15' GROUP BY ALL HAVING sum(delta) <> 0")
def _levels(b):
    return T.levels_at(b.ticks, "2024-01-15")


@query("record_tick", f"""
    WITH w AS (SELECT {LEVEL_KEY}, sum(delta) AS was FROM ticks WHERE metric = 'stock' AND ts < '2024-01-30' GROUP BY ALL), n AS (SELECT {LEVEL_KEY}, sum(level) AS now FROM levels WHERE ts = '2024-01-30' GROUP BY ALL)
    SELECT '2024-01-30' AS ts, coalesce(w.board, n.board) AS board, coalesce(w.metric, n.metric) AS metric, coalesce(w.family, n.family) AS family, coalesce(w.band, n.band) AS band, CAST(coalesce(now, 0) - coalesce(was, 0) AS BIGINT) AS delta
    FROM w FULL JOIN n USING ({LEVEL_KEY}) WHERE coalesce(now, 0) <> coalesce(was, 0)
    UNION ALL SELECT '2024-01-30', board, metric, family, band, CAST(sum(delta) AS BIGINT) FROM ticks WHERE metric <> 'stock' AND ts = '2024-01-30' GROUP BY ALL""")
def _record(b):
    history, last = b.ticks.filter("ts < '2024-01-30'"), b.ticks.filter("ts = '2024-01-30' AND metric <> 'stock'")
    return T.record_tick(history, b.levels.filter("ts = '2024-01-30'"), last, "2024-01-30")


def _series_oracle(rows, keys):
    """Running sums on a grid of the group's own ticks from its first delta on."""
    k = ", ".join(keys)
    return f"""
    r AS ({rows}), d AS (SELECT {k}, ts, sum(delta) AS d FROM r GROUP BY ALL), g AS (SELECT {k}, min(ts) AS began FROM d GROUP BY ALL), t AS (SELECT DISTINCT ts FROM ticks),
    c AS (SELECT g.*, t.ts FROM g JOIN t ON t.ts >= g.began)
    SELECT {', '.join('c.' + x for x in keys)}, c.ts, CAST(sum(coalesce(d.d, 0)) OVER (PARTITION BY {', '.join('c.' + x for x in keys)} ORDER BY c.ts) AS BIGINT) AS level
    FROM c LEFT JOIN d ON c.ts = d.ts AND {' AND '.join(f'c.{x} IS NOT DISTINCT FROM d.{x}' for x in keys)}"""


@query("replay_series", "WITH" + _series_oracle("SELECT * FROM ticks WHERE metric = 'stock'", ["board", "family", "band"]))
def _replay(b):
    return T.replay_series(b.ticks.filter("metric = 'stock'"), T.tick_positions(b.ticks), ["board", "family", "band"])


@query("index_series", "WITH" + _series_oracle("SELECT metric, family, CASE WHEN family IN ('click', 'view') THEN band END AS band, ts, delta FROM ticks WHERE metric = 'stock' AND board IN ('b1', 'b2', 'b3', 'b45')", ["metric", "family", "band"]))
def _index(b):
    return T.index_series(b.ticks, sources=("b1", "b2", "b3", "b45"), banded=("click", "view"))


@query("scoped_series", "WITH" + _series_oracle("SELECT company, metric, family, band, ts, delta FROM ticks JOIN directory USING (board) WHERE metric = 'stock' AND company IN ('company 3', 'company 21')", ["company", "metric", "family", "band"]))
def _scoped(b):
    return T.scoped_series(b.ticks, b.directory, ["company 3", "company 21"])


@query("comparable_series", "WITH" + _series_oracle("SELECT metric, family, band, ts, delta FROM ticks WHERE metric = 'stock' AND board IN (SELECT board FROM ticks WHERE metric = 'stock' GROUP BY board HAVING min(ts) <= '2024-01-05')", ["metric", "family", "band"]))
def _comparable(b):
    return T.comparable_series(b.ticks, "2024-01-05")


@query("counted_since", "SELECT company, min(ts) AS since FROM ticks JOIN directory USING (board) WHERE metric = 'stock' GROUP BY 1")
def _since(b):
    return T.counted_since(b.ticks, b.directory)


@query("shared_denominator", "WITH s AS (SELECT * FROM (WITH" + _series_oracle("SELECT * FROM ticks WHERE metric = 'stock'", ["metric", "family", "band"]) + ")) SELECT metric, family, band, ts, level, CAST(sum(level) OVER (PARTITION BY ts) AS BIGINT) AS total, round(level / sum(level) OVER (PARTITION BY ts), 6) AS share FROM s")
def _denominator(b):
    rows = b.ticks.filter("metric = 'stock'")
    return T.shared_denominator(T.replay_series(rows, T.tick_positions(b.ticks), ["metric", "family", "band"]))


SUCCESSORS = {"click": "view", "signup": "absent-family"}


@query("rename_families", f"SELECT ts, {LEVEL_KEY.replace('family', 'CASE WHEN family = ' + chr(39) + 'click' + chr(39) + ' THEN ' + chr(39) + 'view' + chr(39) + ' ELSE family END AS family')}, delta FROM ticks")
def _rename(b):
    return T.rename_families(b.ticks, SUCCESSORS).select("ts", "board", "metric", "family", "band", "delta")


PLACE = "SELECT id, board, title AS family, coalesce(employment_type, 'none') AS band, split_part(board, ':', 1) AS source FROM {%s}"
TURNOVER = f"""
    p AS ({(PLACE % 'prior').format(prior='prior')}), c AS ({(PLACE % 'fresh').format(fresh='fresh')}),
    j AS (SELECT coalesce(c.id, p.id) AS id, c AS c, p AS p, c.id IS NOT NULL AS now, p.id IS NOT NULL AS was FROM c FULL JOIN p ON c.id = p.id),
    q AS (SELECT j.*, coalesce(s.first_seen > '1999-06-01', FALSE) AS fresh, CAST(split_part(j.id, ':', 3) AS BIGINT) % 2 = 0 AS evicted FROM j LEFT JOIN postings s ON j.id = s.id),
    e AS (SELECT c.board, CASE WHEN fresh AND c.board IN (SELECT board FROM prior) THEN 'opened' ELSE 'recounted_in' END AS metric, c.family, c.band, c.source FROM q WHERE now AND NOT was
          UNION ALL SELECT p.board, CASE WHEN evicted THEN 'closed' ELSE 'recounted_out' END, p.family, p.band, p.source FROM q WHERE was AND NOT now)"""


def _turnover(b):
    seen = b.postings.select("id", "first_seen")
    evicted = b.postings.select("id").filter("CAST(split_part(id, ':', 3) AS BIGINT) % 2 = 0")
    return T.turnover(b.sql(PLACE % "prior"), b.sql(PLACE % "fresh"), seen, b.prior.select("board"), evicted, "1999-06-01")


@query("turnover", f"WITH {TURNOVER} SELECT board, metric, family, band, source, count(*) AS delta FROM e GROUP BY ALL")
def _turnover_query(b):
    return _turnover(b)


@query("turnover_identity", "SELECT '' AS board, '' AS family, '' AS band, '' AS source, CAST(0 AS BIGINT) AS off_by FROM ticks WHERE FALSE")
def _identity(b):
    return T.turnover_identity(b.sql(PLACE % "prior"), b.sql(PLACE % "fresh"), _turnover(b))


CHARTED = "c AS (SELECT DISTINCT ts FROM ticks WHERE ts >= '2024-01-04' AND CAST(right(ts, 2) AS INT) % 3 <> 0)"


def _charted(b):
    return b.ticks.select("ts").distinct().filter("ts >= '2024-01-04' AND CAST(right(ts, 2) AS INT) % 3 <> 0")


@query("turnover_series", f"""
    WITH {CHARTED}, r AS (SELECT family, metric, delta, (SELECT min(c.ts) FROM c WHERE c.ts >= ticks.ts) AS landing FROM ticks WHERE metric <> 'stock')
    SELECT family, landing AS ts, CAST(coalesce(sum(delta) FILTER (WHERE metric = 'opened'), 0) AS BIGINT) AS opened, CAST(coalesce(sum(delta) FILTER (WHERE metric = 'closed'), 0) AS BIGINT) AS closed,
           CAST(coalesce(sum(CASE metric WHEN 'recounted_in' THEN delta WHEN 'recounted_out' THEN -delta END), 0) AS BIGINT) AS recounted
    FROM r WHERE landing > (SELECT min(ts) FROM c) AND landing NOT IN ('2024-01-20', '2024-01-22') GROUP BY 1, 2""")
def _turnover_series(b):
    left_out = T.left_out_runs(b.methods, T.tick_positions(_charted(b)))
    return T.turnover_series(b.ticks, ["family"], _charted(b), left_out)


MARKERS = "SELECT DISTINCT ts, board, 'unscoped' AS metric, '' AS family, '' AS band, CAST(1 AS BIGINT) AS delta FROM {ticks} WHERE metric = 'stock' AND delta > 14"


@query("closures_uncounted", f"""
    WITH m AS (SELECT DISTINCT board FROM ({MARKERS.format(ticks='ticks')}) WHERE ts > '2024-01-05' AND ts <= '2024-01-20')
    SELECT company, count(*) AS boards, count(m.board) AS unseen, count(*) = count(m.board) AS uncounted FROM directory LEFT JOIN m USING (board) GROUP BY 1""")
def _uncounted(b):
    return T.closures_uncounted(b.sql(MARKERS), b.directory, "2024-01-05", "2024-01-20")


@query("new_inflow", """
    WITH o AS (SELECT family, band, ts, sum(delta) AS n FROM ticks WHERE metric = 'opened' GROUP BY ALL), t AS (SELECT DISTINCT ts FROM ticks WHERE ts >= '2024-01-09')
    SELECT family, band, t.ts, CAST(sum(n) AS BIGINT) AS level FROM t JOIN o ON o.ts <= t.ts AND CAST(o.ts AS DATE) > CAST(t.ts AS DATE) - 7 GROUP BY ALL HAVING sum(n) <> 0""")
def _inflow(b):
    return T.new_inflow(b.ticks, "2024-01-09")


@query("counting_changes", """
    SELECT * FROM (VALUES ('2024-01-09', 'family_classifier_version'), ('2024-01-20', 'family_list_fingerprint,tech_filter_version')) v(ts, fields) WHERE ts IN (SELECT ts FROM methods)""")
def _changes(b):
    return T.counting_changes(b.methods, METHOD_FIELDS).select("ts", F.array_join("fields", ",").alias("fields"))


@query("left_out_runs", "SELECT * FROM (VALUES ('2024-01-09', 'every'), ('2024-01-10', 'every'), ('2024-01-20', 'every'), ('2024-01-21', 'every')) v(ts, scope) WHERE ts IN (SELECT ts FROM methods)")
def _left_out(b):
    return T.left_out_runs(b.methods, T.tick_positions(b.ticks))


@query("board_facts", """
    WITH d AS (SELECT board, ts, sum(delta) AS d FROM ticks WHERE metric = 'stock' GROUP BY ALL), f AS (SELECT board, min(ts) AS first_counted, CAST(sum(d) AS BIGINT) AS level FROM d GROUP BY 1)
    SELECT f.board, first_counted, CAST(d.d AS BIGINT) AS backlog, level, first_counted > (SELECT min(ts) FROM ticks) AS found_later FROM f JOIN d ON f.board = d.board AND f.first_counted = d.ts""")
def _facts(b):
    return T.board_facts(b.ticks)


@query("found_steps", """
    WITH f AS (SELECT board, min(ts) AS ts FROM ticks WHERE metric = 'stock' GROUP BY 1)
    SELECT ts, family, count(DISTINCT board) AS boards, CAST(sum(delta) AS BIGINT) AS openings FROM ticks JOIN f USING (board, ts) WHERE metric = 'stock' AND ts > (SELECT min(ts) FROM ticks) GROUP BY ALL HAVING sum(delta) <> 0""")
def _found(b):
    return T.found_steps(b.ticks)


EVICTED = "SELECT ts, board, sum(delta) AS count FROM {ticks} WHERE metric = 'recounted_out' GROUP BY 1, 2"


@query("evicted_steps", f"""
    WITH {CHARTED}, e AS (SELECT company, count, (SELECT min(c.ts) FROM c WHERE c.ts >= x.ts) AS landing FROM ({EVICTED.format(ticks='ticks')}) x JOIN directory USING (board))
    SELECT landing AS ts, company, CAST(sum(count) AS BIGINT) AS count FROM e WHERE landing > (SELECT min(ts) FROM c) GROUP BY ALL HAVING sum(count) <> 0""")
def _evicted(b):
    return T.evicted_steps(b.sql(EVICTED), b.directory, _charted(b))


@query("trailing_week", """
    WITH t AS (SELECT DISTINCT ts FROM ticks), n AS (SELECT max(ts) AS newest FROM t), b AS (SELECT newest, (SELECT max(ts) FROM t WHERE CAST(ts AS DATE) < CAST(newest AS DATE) - 7) AS base FROM n)
    SELECT base, (SELECT min(ts) FROM t WHERE ts > base) AS "from", newest AS "to", greatest((SELECT min(ts) FROM ticks WHERE metric <> 'stock'), (SELECT min(ts) FROM t WHERE ts > base)) AS turnover_from FROM b""")
def _week(b):
    return T.trailing_week(b.ticks)


@query("coverage_summary", """
    WITH f AS (SELECT board, min(ts) AS f, CASE WHEN min(ts) <= '2024-01-06' THEN 'cohort' ELSE 'entrants' END AS side FROM ticks WHERE metric = 'stock' GROUP BY 1 HAVING min(ts) <= '2024-01-25'),
    l AS (SELECT side, sum(CASE WHEN ts <= '2024-01-06' THEN delta ELSE 0 END) AS start, sum(delta) AS latest, sum(CASE WHEN ts = f THEN delta ELSE 0 END) AS backlog FROM ticks JOIN f USING (board) WHERE metric = 'stock' AND ts <= '2024-01-25' GROUP BY 1),
    a AS (SELECT side, sum(CASE WHEN metric = 'opened' THEN delta ELSE 0 END) AS opened, sum(CASE WHEN metric = 'closed' THEN delta ELSE 0 END) AS closed, sum(CASE metric WHEN 'recounted_in' THEN delta WHEN 'recounted_out' THEN -delta ELSE 0 END) AS recounted
          FROM ticks JOIN f USING (board) WHERE metric <> 'stock' AND ts > greatest('2024-01-06', f) AND ts <= '2024-01-25' GROUP BY 1)
    SELECT side, (SELECT count(*) FROM f WHERE f.side = l.side) AS boards, CAST(start AS BIGINT) AS start, CAST(latest AS BIGINT) AS latest, CAST(backlog AS BIGINT) AS backlog, CAST(opened AS BIGINT) AS opened, CAST(closed AS BIGINT) AS closed, CAST(recounted AS BIGINT) AS recounted, CAST(0 AS BIGINT) AS closures_unseen
    FROM l JOIN a USING (side)""")
def _coverage(b):
    return T.coverage_summary(b.ticks, "2024-01-06", "2024-01-06", "2024-01-25")


@query("found_late", """
    WITH p AS (SELECT board, coalesce(posted_at LIKE '____-__-__%' AND date_diff('day', try_cast(substring(posted_at, 1, 10) AS DATE), CAST(substring(first_seen, 1, 10) AS DATE)) > 14, FALSE) AS late FROM postings WHERE first_seen > '2000-01-01' AND first_seen <= '2001-06-01')
    SELECT board, count(*) FILTER (WHERE NOT late) AS fresh, count(*) FILTER (WHERE late) AS found_late FROM p GROUP BY 1""")
def _late(b):
    return T.found_late(b.postings, "2000-01-01", "2001-06-01")


@query("diff_payloads", """
    WITH a AS (SELECT id, title, min_salary_annual FROM prior), b AS (SELECT id, title, min_salary_annual FROM fresh)
    SELECT *, 'before' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'after' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _payloads(b):
    cols = ["id", "title", "min_salary_annual"]
    return T.diff_payloads(b.prior.select(*cols), b.fresh.select(*cols))


@query("validate_reference", """
    SELECT board, family, band, CAST(sum(n) AS BIGINT) AS counted, CAST(sum(r) AS BIGINT) AS recorded FROM (
      SELECT board, family, band, count(*) AS n, 0 AS r FROM ticks WHERE metric = 'stock' AND ts <= '2024-01-15' GROUP BY ALL UNION ALL SELECT board, family, band, 0, sum(delta) FROM ticks WHERE metric = 'stock' AND ts <= '2024-01-15' GROUP BY ALL)
    GROUP BY ALL HAVING sum(n) <> sum(r)""")
def _validate(b):
    placements = b.ticks.filter("metric = 'stock' AND ts <= '2024-01-15'").select("board", "family", "band")
    return T.validate_reference(placements, b.ticks, "2024-01-15")


# --- readings --------------------------------------------------------------------------------

LINES = "SELECT family AS line, ts, CAST(sum(level) AS BIGINT) AS level FROM {levels} GROUP BY 1, 2"
STEPS = "SELECT family AS line, ts, 'found' AS kind, ts AS source, CAST(sum(level % 3) AS BIGINT) AS size, TRUE AS known, CAST(NULL AS DOUBLE) AS ratio FROM {levels} WHERE ts IN ('2024-01-07', '2024-01-19', '2024-01-23') GROUP BY 1, 2"


@query("net_by_shift", f"""
    WITH l AS ({LINES.format(levels='levels')}), s AS ({STEPS.format(levels='levels')})
    SELECT l.line, l.ts, l.level, CAST(l.level + coalesce((SELECT sum(size) FROM s WHERE s.line = l.line AND s.ts > l.ts), 0) AS BIGINT) AS netted FROM l""")
def _shift(b):
    return P.net_by_shift(P.land_steps(b.sql(LINES), b.sql(STEPS))).select("line", "ts", "level", "netted")


@query("net_series", f"""
    WITH l AS ({LINES.format(levels='levels')}), s AS ({STEPS.format(levels='levels')})
    SELECT l.line, l.ts, l.level, CAST(l.level + coalesce((SELECT sum(size) FROM s WHERE s.line = l.line AND s.ts > l.ts), 0) AS DOUBLE) AS netted, CAST(1 AS DOUBLE) AS scale FROM l""")
def _net(b):
    return P.net_series(P.land_steps(b.sql(LINES), b.sql(STEPS))).select("line", "ts", "level", "netted", "scale")


def _answer(b, **kw):
    return P.TrendQuestion(**kw)


@query("drop_partial_reads")
def _partial(b):
    rows = b.sql("SELECT board AS line, ts, CAST(sum(level) AS BIGINT) AS level FROM {levels} GROUP BY 1, 2")
    return P.drop_partial_reads(rows)


@query("notes", """
    WITH f AS (SELECT board, min(ts) AS ts FROM ticks WHERE metric = 'stock' GROUP BY 1),
    s AS (SELECT ts, family, CAST(sum(delta) AS BIGINT) AS size FROM ticks JOIN f USING (board, ts) WHERE metric = 'stock' AND ts > (SELECT min(ts) FROM ticks) GROUP BY ALL HAVING sum(delta) <> 0),
    e AS (SELECT x.ts, company, CAST(sum(count) AS BIGINT) AS n FROM (SELECT ts, board, sum(delta) AS count FROM ticks WHERE metric = 'recounted_out' GROUP BY 1, 2) x JOIN directory USING (board) WHERE x.ts > (SELECT min(ts) FROM ticks) GROUP BY ALL HAVING sum(count) >= 5)
    SELECT ts, kind, CAST(NULL AS STRING) AS company, CAST(NULL AS STRING) AS line, CAST(NULL AS BIGINT) AS size, fields, TRUE AS taken_out FROM (VALUES ('2024-01-09', 'counting', 'family_classifier_version'), ('2024-01-10', 'settling', 'family_classifier_version'),
      ('2024-01-20', 'counting', 'family_list_fingerprint,tech_filter_version'), ('2024-01-21', 'settling', 'family_list_fingerprint,tech_filter_version')) v(ts, kind, fields)
    UNION ALL SELECT ts, 'found', NULL, family, size, NULL, abs(sum(size) OVER (PARTITION BY ts)) >= 5 FROM s
    UNION ALL SELECT ts, 'duplicates', company, NULL, -n, NULL, TRUE FROM e""")
def _notes(b):
    out = P.notes(b.ticks, b.methods, b.ticks.select("ts").distinct(), b.directory, b.sql(EVICTED))
    return out.drop("source")


@query("trend_answer", "WITH s AS (SELECT * FROM (WITH" + _series_oracle("SELECT * FROM ticks WHERE metric = 'stock'", ["family"]) + ")) SELECT family AS line, ts, level, CAST(sum(level) OVER (PARTITION BY ts) AS BIGINT) AS total, round(level / sum(level) OVER (PARTITION BY ts), 6) AS share FROM s")
def _trend_answer(b):
    return P.trend_answer(b.ticks, P.TrendQuestion())


@query("trend_answer_bands", "WITH s AS (SELECT * FROM (WITH" + _series_oracle("SELECT * FROM ticks WHERE metric = 'stock' AND family = 'view'", ["band"]) + ")) SELECT band AS line, ts, level FROM s WHERE ts >= '2024-01-10' AND ts <= '2024-01-25'")
def _trend_bands(b):
    question = P.TrendQuestion(split_by="band", family="view", since="2024-01-10", until="2024-01-25")
    return P.trend_answer(b.ticks, question).select("line", "ts", "level")


@query("trend_answer_companies", "WITH s AS (SELECT * FROM (WITH" + _series_oracle("SELECT company, ts, delta FROM ticks JOIN directory USING (board) WHERE metric = 'stock'", ["company"]) + ")) SELECT company AS line, ts, level FROM s")
def _trend_companies(b):
    return P.trend_answer(b.ticks, P.TrendQuestion(split_by="company"), b.directory).select("line", "ts", "level")


def _netted(b):
    return P.net_series(P.land_steps(b.sql(LINES), b.sql(STEPS)))


MOVE = f"""
    l AS ({LINES.format(levels='levels')}), s AS ({STEPS.format(levels='levels')}),
    m AS (SELECT line, arg_min(level, ts) AS start, arg_max(level, ts) AS latest, min(ts) AS first_ts, max(ts) AS last_ts FROM l GROUP BY 1),
    z AS (SELECT m.*, coalesce((SELECT sum(size) FROM s WHERE s.line = m.line AND s.ts > m.first_ts), 0) AS steps FROM m),
    h AS (SELECT line, start, latest, first_ts, last_ts, CAST(latest - start - steps AS BIGINT) AS hiring, CAST(steps AS BIGINT) AS not_hiring, CAST(date_diff('day', CAST(first_ts AS DATE), CAST((SELECT max(ts) FROM l) AS DATE)) AS DOUBLE) AS span_days FROM z)"""


@query("line_move", f"""
    WITH {MOVE} SELECT line, start, latest, first_ts, last_ts, span_days, hiring, not_hiring, latest - hiring AS netted_start,
      CASE WHEN start < 20 THEN 'small start' WHEN latest - hiring < 5 THEN 'small start once steps are taken out' END AS percent_withheld,
      CASE WHEN start >= 20 AND latest - hiring >= 5 THEN round(hiring / (latest - hiring) * 100, 6) END AS percent, CAST(floor(hiring / span_days * 7 + 0.5) AS BIGINT) AS per_week FROM h""")
def _move(b):
    none = b.sql(STEPS).select("line", "kind", "size").limit(0)
    return P.line_move(_netted(b), causes=none)


@query("split_causes", f"""
    WITH {MOVE} SELECT line, 'found' AS kind, ts AS source, CAST(size AS BIGINT) AS size FROM s WHERE size <> 0 AND ts > (SELECT min(ts) FROM l)""")
def _causes(b):
    landed = P.land_steps(b.sql(LINES), b.sql(STEPS))
    return P.split_causes(P.net_series(landed), b.sql(STEPS), landed)


PARTS = "SELECT family AS line, CAST(count(*) AS BIGINT) AS start, CAST(sum(level % 7) AS BIGINT) AS latest, sum(level) / 7.0 AS hiring_exact FROM {levels} GROUP BY 1"


@query("apportion", f"""
    WITH p AS (SELECT line, CAST(hiring_exact AS DOUBLE) AS v FROM ({PARTS.format(levels='levels')})), f AS (SELECT *, CAST(floor(v) AS BIGINT) AS f, v - floor(v) AS r FROM p),
    k AS (SELECT *, 3 + sum(f) OVER () - sum(f) OVER () AS spare, row_number() OVER (ORDER BY r DESC, line) AS n, count(*) OVER () AS c FROM f)
    SELECT line, CAST(f + (3 // c) + CASE WHEN n <= 3 % c THEN 1 ELSE 0 END AS BIGINT) AS whole FROM k""")
def _apportion(b):
    rows = b.sql(PARTS).withColumn("v", F.col("hiring_exact").cast("double"))
    total = rows.agg((F.sum(F.floor("v")) + 3).alias("target"))
    return P.apportion(rows.join(F.broadcast(total), F.lit(True)), [], "v", "target", "line").select("line", F.col("whole").cast("bigint").alias("whole"))


@query("breakdown", f"""
    WITH p AS (SELECT line, start, latest, CAST(hiring_exact AS DOUBLE) AS v FROM ({PARTS.format(levels='levels')})), t AS (SELECT sum(start) AS start, sum(latest) AS latest, sum(v) + 4.25 AS v FROM p),
    c AS (SELECT CAST(floor(4.25 + 0.5) AS BIGINT) AS closing, CAST(floor(v + 0.5) AS BIGINT) AS head FROM t), f AS (SELECT *, CAST(floor(v) AS BIGINT) AS f, v - floor(v) AS r FROM p),
    k AS (SELECT f.*, head - closing - sum(f) OVER () AS spare, row_number() OVER (ORDER BY r DESC, line) AS up, row_number() OVER (ORDER BY r, line) AS dn, count(*) OVER () AS n FROM f, c),
    w AS (SELECT line, start, latest, CAST(f + CASE WHEN spare >= 0 THEN spare // n + CASE WHEN up <= spare % n THEN 1 ELSE 0 END ELSE -((-spare) // n + CASE WHEN dn <= (-spare) % n THEN 1 ELSE 0 END) END AS BIGINT) AS hiring FROM k)
    SELECT 'first row' AS line, CAST(start AS BIGINT) AS start, CAST(latest AS BIGINT) AS latest, head AS hiring, CAST(latest - start - head AS BIGINT) AS not_hiring FROM t, c
    UNION ALL SELECT line, start, latest, hiring, latest - start - hiring FROM w UNION ALL SELECT 'closing row', 0, 0, closing, -closing FROM c""")
def _breakdown(b):
    lines = b.sql(PARTS).withColumn("hiring_exact", F.col("hiring_exact").cast("double"))
    total = lines.agg(F.sum("start").alias("start"), F.sum("latest").alias("latest"), (F.sum("hiring_exact") + 4.25).alias("hiring_exact"))
    return P.breakdown(lines, total)


FOLD = "SELECT board AS line, CAST(count(*) AS BIGINT) AS start, CAST(sum(level) AS BIGINT) AS latest, CAST(sum(level % 5) AS BIGINT) AS hiring, CAST(sum(level % 2) AS BIGINT) AS not_hiring, CAST(max(level) AS BIGINT) AS opened, CASE WHEN board = 'b7' THEN NULL ELSE CAST(min(level) AS BIGINT) END AS closed FROM {levels} GROUP BY 1"


@query("other_fold", f"""
    WITH x AS ({FOLD.format(levels='levels')}), r AS (SELECT *, row_number() OVER (ORDER BY line IN ('b7', 'b12'), latest DESC, line) AS n FROM x)
    SELECT CASE WHEN n <= 8 AND line NOT IN ('b7', 'b12') THEN line ELSE 'Other' END AS line, CAST(sum(start) AS BIGINT) AS start, CAST(sum(latest) AS BIGINT) AS latest, CAST(sum(hiring) AS BIGINT) AS hiring, CAST(sum(not_hiring) AS BIGINT) AS not_hiring,
           CAST(sum(opened) AS BIGINT) AS opened, CASE WHEN bool_or(closed IS NULL) THEN NULL ELSE CAST(sum(closed) AS BIGINT) END AS closed, count(*) AS lines FROM r GROUP BY 1""")
def _fold(b):
    return P.other_fold(b.sql(FOLD), hidden=("b7", "b12"))


MARKED = "SELECT DISTINCT family AS line, ts, CASE WHEN ts = '2024-01-19' THEN 'settling' ELSE 'counting' END AS kind, ts AS source, CAST(NULL AS BIGINT) AS size, FALSE AS known, CAST(NULL AS DOUBLE) AS ratio FROM {levels} WHERE ts IN ('2024-01-07', '2024-01-19', '2024-01-23')"


@query("day_markers", "SELECT * FROM (VALUES ('2024-01-07', '2024-01-07', 'counting@2024-01-07'), ('2024-01-23', '2024-01-23', 'counting@2024-01-23')) v(day, ts, changes) WHERE ts IN (SELECT ts FROM levels)")
def _markers(b):
    landed = P.land_steps(b.sql(LINES), b.sql(MARKED))
    return P.day_markers(b.sql(MARKED).select("ts", "kind", "source"), landed)


@query("check_reading", "SELECT '' AS line, '' AS problem FROM levels WHERE FALSE")
def _check(b):
    landed = P.land_steps(b.sql(LINES), b.sql(STEPS))
    netted = P.net_series(landed)
    causes = P.split_causes(netted, b.sql(STEPS), landed)
    return P.check_reading(P.line_move(netted, causes=causes), causes=causes)


@query("hiring_turnover", """
    WITH c AS (SELECT DISTINCT ts FROM ticks), r AS (SELECT family AS line, ts, metric, delta FROM ticks WHERE metric IN ('opened', 'closed') AND ts > (SELECT min(ts) FROM c) AND ts NOT IN ('2024-01-09', '2024-01-10', '2024-01-20', '2024-01-21'))
    SELECT line, CAST(sum(delta) FILTER (WHERE metric = 'opened') AS BIGINT) AS opened, CAST(sum(delta) FILTER (WHERE metric = 'closed') AS BIGINT) AS closed FROM r GROUP BY 1""")
def _hiring(b):
    series = T.turnover_series(b.ticks.withColumn("line", F.col("family")), ["line"], b.ticks.select("ts").distinct())
    return P.hiring_turnover(series, T.left_out_runs(b.methods, T.tick_positions(b.ticks)))


@query("trends")
def _trends(b):
    return P.trends(b.ticks, b.methods, P.TrendQuestion())


@query("read_trends")
def _read_trends(b):
    """Chosen companies compared, removed duplicates taken out."""
    question = P.TrendQuestion(split_by="company", companies=("company 3", "company 7", "company 12"), since="2024-01-04")
    return P.trends(b.ticks, b.methods, question, b.directory, b.sql(EVICTED))


@query("trends_check", "SELECT '' AS line, '' AS problem FROM levels WHERE FALSE")
def _trends_check(b):
    """The arithmetic of a whole answer, which must not break."""
    return P.check_reading(P.trends(b.ticks, b.methods, P.TrendQuestion()))


@query("company_moves")
def _company_moves(b):
    return P.company_moves(b.ticks, b.methods, b.directory, "2024-01-20")


CANDIDATES = """
    SELECT 'c' || CAST(c_custkey AS STRING) AS company, CASE WHEN c_custkey % 9 = 0 THEN 'below_min_stock' WHEN c_custkey % 11 = 0 THEN 'too_new' END AS excluded, c_custkey % 200 AS stock,
           CAST(floor(c_acctbal / 10) AS BIGINT) AS net, c_custkey % 150 AS opened, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 40 END AS closed,
           CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 77 AS DOUBLE) END AS rate, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 150 - c_custkey % 40 END AS opened_less_closed FROM {customer}"""


@query("hot_ranking", f"""
    WITH c AS (SELECT * FROM ({CANDIDATES.format(customer='customer')}) WHERE excluded IS NULL),
    l AS (SELECT 'expansion' AS lens, company, CAST(net AS DOUBLE) AS figure FROM c UNION ALL SELECT 'opened_less_closed', company, opened_less_closed FROM c UNION ALL SELECT 'volume', company, opened FROM c UNION ALL SELECT 'rate', company, rate FROM c WHERE net > 0)
    SELECT lens, row_number() OVER (PARTITION BY lens ORDER BY figure DESC, company) AS place, company, figure FROM l WHERE figure > 0 QUALIFY place <= 100""")
def _hot_ranking(b):
    return P.hot_ranking(b.sql(CANDIDATES))


@query("hot_counts", f"""
    SELECT count(*) FILTER (WHERE excluded IS NULL) AS ranked, count(*) FILTER (WHERE excluded = 'too_new') AS too_new, count(*) FILTER (WHERE excluded = 'below_min_stock' AND stock > 0) AS below_min_stock,
           count(*) FILTER (WHERE excluded IS NULL AND opened > 0 AND closed IS NULL) AS closures_uncounted, count(*) FILTER (WHERE excluded IS NULL AND rate > 0 AND net <= 0) AS not_growing FROM ({CANDIDATES.format(customer='customer')})""")
def _hot_counts(b):
    return P.hot_counts(b.sql(CANDIDATES))


@query("hot")
def _hot(b):
    week = T.trailing_week(b.ticks).first()
    return P.hot_ranking(P.hot_candidates(b.ticks, b.methods, b.directory, week["base"]))


NAMED = "SELECT company, max(name) AS name, CAST(sum(n) AS BIGINT) AS openings FROM (SELECT 'k' || CAST(p_partkey AS STRING) AS company, p_name AS name, p_size AS n FROM {part}) GROUP BY 1"


@query("suggest_names", f"""
    WITH n AS ({NAMED.format(part='part')}), t AS (SELECT *, CASE WHEN name = 'red wid' THEN 0 WHEN name LIKE 'red wid%' THEN 1 WHEN len(list_filter(string_split(name, ' '), lambda w: w LIKE 'red%')) > 0 AND len(list_filter(string_split(name, ' '), lambda w: w LIKE 'wid%')) > 0 THEN 2
        WHEN replace(name, ' ', '') LIKE 'redwid%' THEN 4 END AS tier FROM n),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, openings DESC, name, company) AS k FROM t WHERE tier IS NOT NULL)
    SELECT name, company, tier, CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' WHEN 2 THEN 'words' ELSE 'joined' END AS match, openings FROM r WHERE k = 1 ORDER BY tier, openings DESC, name LIMIT 10""")
def _suggest(b):
    return P.suggest_names(b.sql(NAMED), "red wid")


@query("suggest_names_typo")
def _suggest_typo(b):
    return P.suggest_names(b.sql(NAMED), "widegt")
