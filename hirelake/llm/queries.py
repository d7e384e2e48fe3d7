"""The registered queries of this package and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import id_remainder, table
from .collocations import mine_collocations
from .decontaminate import find_contamination
from .dimension_scan import approximate_neighbours
from .line_dedup import dedup_lines
from .main_text import extract_main_text
from .manifest import build_manifest, folded, proof_digest, row_digest
from .mixing import mix_sources
from .pii import find_pii
from .quality import classify_quality
from .simhash import near_duplicate_components
from .topk import exact_top_k
from .toxicity import score_toxicity, train_toxicity
from .warc import read_warc, write_warc


def held_out(divisor: int, remainder: int):
    """Whether a row is kept from learning; a null id is not, for no label can name it."""
    return F.coalesce(id_remainder(F.col("doc_id"), divisor) == remainder, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels.where(~held_out(5, 0)))
    return score_toxicity(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = classify_quality(docs, labels.where(~held_out(3, 1)))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = dedup_lines(table(spark, sf_dir, "documents"))
    return rest.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest, "spans")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf, text = row_digest([*head, F.col("text")]), F.col("text")
    altered = row_digest([*head, F.replace(text, F.lit("\n"), F.lit(""))])
    given = F.when(id_remainder(F.col("doc_id"), 2) == 0, altered).otherwise(leaf)
    manifest = build_manifest(docs.select("doc_id", "source", leaf.alias("leaf"), given.alias("given")), ["given"])
    manifest = manifest.withColumn("folded_root", folded(F.col("given"), F.col("witness"))).withColumn("proof_sha256", proof_digest(F.col("witness")))
    return manifest.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


LLM_QUERIES = {f.__name__: f for f in (op1_toxicity, op2_main_text, op3_mixing, op4_simhash, op5_quality, op6_line_dedup, op7_decontamination, op8_warc, op9_pii,
                                       op10_topk, op11_collocations, op12_manifest, op13_dimension_scan)}

LLM_ORACLES = {
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT doc_id, pos, line, list_filter(string_split_regex(lower(line), '\s+'), lambda x: x <> '') AS ws FROM l),
d AS (SELECT ws, len(ws) AS n, min({'d': doc_id, 'pos': pos}) AS f FROM w WHERE len(ws) > 0 GROUP BY ws),
v AS (SELECT ws, f, i, ws[1:i - 1] || ws[i + 1:] AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 8)),
replaced AS (SELECT v, i, min(f) AS f FROM v GROUP BY v, i),
longer AS (SELECT v, min(f) AS f FROM v GROUP BY v),
found AS (
  SELECT ws, f FROM d
  UNION ALL SELECT v.ws, r.f FROM v JOIN replaced r ON v.v = r.v AND v.i = r.i
  UNION ALL SELECT v.ws, d.f FROM v JOIN d ON v.v = d.ws AND d.n >= 8
  UNION ALL SELECT d.ws, o.f FROM d JOIN longer o ON o.v = d.ws AND d.n >= 8),
e AS (SELECT ws, min(f) AS f FROM found GROUP BY ws),
kept AS (SELECT w.doc_id, string_agg(w.line, chr(10) ORDER BY w.pos) AS text FROM w LEFT JOIN e ON w.ws = e.ws
         WHERE len(w.ws) = 0 OR {'d': w.doc_id, 'pos': w.pos} <= e.f GROUP BY w.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(k.text, '')) END AS n_chars
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op8_warc": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
""",
    "op10_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, row_number() OVER () AS p, piece FROM (SELECT lang, unnest(ps) AS piece FROM d)),
s AS (SELECT lang, p, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
o AS (SELECT lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
q AS (SELECT lang, w AS w1, lead(w) OVER z AS w2, lead(w, 2) OVER z AS w3 FROM o WINDOW z AS (PARTITION BY p ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM q GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM q WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM q WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= 10),
h AS (SELECT lang, w1, w2, max(f) AS longer FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY lang, w1, w2),
x AS (SELECT lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS cut, l.f AS l, r.f AS r
      FROM f2 JOIN f1 l USING (lang, w1) JOIN (SELECT lang, w1 AS w2, f FROM f1) r USING (lang, w2) LEFT JOIN h USING (lang, w1, w2)
      WHERE NOT coalesce(100 * longer >= 50 * f2.f, false)
      UNION ALL SELECT lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, l.f, r.f
      FROM f3 JOIN f1 l USING (lang, w1) JOIN (SELECT lang, w1 AS w2, w2 AS w3, f FROM f2) r USING (lang, w2, w3)
      UNION ALL SELECT lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, l.f, r.f
      FROM f3 JOIN f2 l USING (lang, w1, w2) JOIN (SELECT lang, w1 AS w3, f FROM f1) r USING (lang, w3)),
y AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM x),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM y),
t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM b WHERE place = 1),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM t JOIN n USING (lang) WHERE rank <= 2000
""",
    "op12_manifest": r"""
WITH RECURSIVE s AS (SELECT doc_id, source, text, text AS original, n_chars, lang,
       list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                   lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)), xor(c, b)), 4294967295) AS crc FROM documents),
v AS (SELECT doc_id, source, crc, 'd' AS kind, text, n_chars, lang FROM s UNION ALL SELECT doc_id, source, crc, 't', replace(text, chr(10), ''), n_chars, lang FROM s),
e AS (SELECT doc_id, source, crc, kind, sha256(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id
        || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
        || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS h FROM v),
leaf AS (SELECT a.doc_id, a.source, a.h AS leaf, CASE WHEN xor(a.crc, 4294967295) % 2 = 0 THEN b.h ELSE a.h END AS given,
                row_number() OVER (PARTITION BY a.source ORDER BY a.doc_id) - 1 AS idx
         FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.kind = 'd' AND b.kind = 't'),
low AS (SELECT source, 0 AS lvl, idx, leaf AS h FROM leaf
        UNION ALL SELECT source, lvl + 1, i3, sha256(string_agg(h, '' ORDER BY idx))
                  FROM (SELECT *, idx // 3 AS i3, count(*) OVER (PARTITION BY source) AS m FROM low) WHERE m > 1 GROUP BY source, lvl, i3),
sub AS (SELECT source, max_by(h, lvl) AS subroot FROM low GROUP BY source),
top0 AS (SELECT source, subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM sub),
high AS (SELECT 0 AS lvl, idx, subroot AS h FROM top0
         UNION ALL SELECT lvl + 1, i3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, idx // 3 AS i3, count(*) OVER () AS m FROM high) WHERE m > 1 GROUP BY lvl, i3),
root AS (SELECT max_by(h, lvl) AS root FROM high),
nodes AS (SELECT source, lvl, idx, h, count(*) OVER (PARTITION BY source, lvl) AS m FROM low),
tops AS (SELECT lvl, idx, h, count(*) OVER (PARTITION BY lvl) AS m FROM high),
steps AS (
  SELECT l.doc_id, n.lvl, coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx < l.idx // CAST(3 ** n.lvl AS BIGINT)), '') AS l,
         coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx > l.idx // CAST(3 ** n.lvl AS BIGINT)), '') AS r
  FROM leaf l JOIN nodes n ON n.source IS NOT DISTINCT FROM l.source AND n.m > 1 AND n.idx // 3 = l.idx // CAST(3 ** (n.lvl + 1) AS BIGINT) GROUP BY l.doc_id, n.lvl
  UNION ALL
  SELECT l.doc_id, 1000 + n.lvl, coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx < t.idx // CAST(3 ** n.lvl AS BIGINT)), ''),
         coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx > t.idx // CAST(3 ** n.lvl AS BIGINT)), '')
  FROM leaf l JOIN top0 t ON t.source IS NOT DISTINCT FROM l.source JOIN tops n ON n.m > 1 AND n.idx // 3 = t.idx // CAST(3 ** (n.lvl + 1) AS BIGINT) GROUP BY l.doc_id, n.lvl),
w AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof_sha256, list(l || '|' || r ORDER BY lvl) AS path FROM steps GROUP BY doc_id),
f AS (SELECT l.doc_id, l.leaf, l.source, coalesce(w.proof_sha256, sha256('')) AS proof_sha256,
             list_reduce(list_prepend(l.given, coalesce(w.path, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
      FROM leaf l LEFT JOIN w ON w.doc_id = l.doc_id)
SELECT f.doc_id, f.leaf, sub.subroot, root.root, f.proof_sha256, f.folded_root, f.folded_root = root.root AS verified
FROM f JOIN sub ON sub.source IS NOT DISTINCT FROM f.source, root
""",
}
