"""Trees and witnesses against a tree built level by level."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from hirelake.llm.manifest import ManifestParams, OpenSubtrees, build_manifest, folded, proof_digest, row_digest, verify_rows


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root, and per leaf its (left, right) siblings a level."""
    paths, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for leaf, at in enumerate(places):
            run = at // 3 * 3
            paths[leaf].append(("".join(level[run:at]), "".join(level[at + 1:run + 3])))
            places[leaf] = at // 3
        level = [digest(*level[i:i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def leaf_of(row):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def plain_manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    logs = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in sources}
    trees = {s: plain_tree([leaf_of(r) for r in logs[s]]) for s in sources}
    root, tops = plain_tree([trees[s][0] for s in sources])
    return [(r[0], s, leaf_of(r), trees[s][0], root, tuple(trees[s][1][i] + tops[n])) for n, s in enumerate(sources) for i, r in enumerate(logs[s])]


def rows_of_sizes(sizes):
    out, at = [], 0
    for s, n in sizes:
        for _ in range(n):
            out.append((at, s, "en" if at % 3 else None, at % 7 or None, None if at % 11 == 5 else f"text é {at}\nnext\n" * (at % 4)))
            at += 1
    return out


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, log string, idx string, total string, block string, leaf string"


def manifest(spark, rows, height):
    docs = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA).repartition(5)
    leaves = docs.select("doc_id", "source", row_digest([F.col(c) for c in FIELDS]).alias("leaf"))
    return docs, build_manifest(leaves, params=ManifestParams(height))


SIZES = [(None, 3), ("a", 1), ("b", 2), ("é", 10), ("z", 27), ("zz", 28), ("zzz", 82), ("B", 9), ("c", 64)]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_matches_a_tree_built_by_levels(spark, height):
    rows = rows_of_sizes(SIZES)
    rows += [rows[5], rows[5], (None, "b", None, None, None), (None, "b", None, None, "t"), (10_000, "long", "en", 1, "x\n" * 300_000)]
    _, got = manifest(spark, rows, height)
    assert got.columns == ["doc_id", "source", "leaf", "subroot", "root", "witness"]
    answers = [(*r[:5], tuple((w["left"], w["right"]) for w in r["witness"])) for r in got.collect()]
    assert sorted(answers, key=str) == sorted(plain_manifest(rows), key=str)
    assert all(r["ok"] for r in got.select((folded(F.col("leaf"), F.col("witness")) == F.col("root")).alias("ok")).collect())


def test_one_row_is_its_own_root(spark):
    row = (7, "s", "en", 3, "abc")
    _, got = manifest(spark, [row], 7)
    r = got.withColumn("proof", proof_digest(F.col("witness"))).first()
    assert r["leaf"] == r["subroot"] == r["root"] == leaf_of(row) and list(r["witness"]) == [] and r["proof"] == sha256(b"").hexdigest()
    assert manifest(spark, [row], 7)[1].limit(0).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    leaves = docs.select("doc_id", "source", row_digest([F.col(c) for c in FIELDS]).alias("leaf"))
    assert build_manifest(leaves).count() == 0


def test_changed_rows_are_named(spark):
    rows = rows_of_sizes(SIZES[:5])
    docs, got = manifest(spark, rows, 2)
    altered = docs.withColumn("text", F.when(F.col("doc_id") == 9, F.lit("other")).otherwise(F.col("text"))).where("doc_id <> 11")
    assert sorted(r["doc_id"] for r in verify_rows(altered, got, FIELDS).collect()) == [9, 11]


def test_query_folds_tampered_leaves(spark, tmp_path):
    from hirelake.llm.queries import op12_manifest

    rows = rows_of_sizes(SIZES)
    spark.createDataFrame(rows, SCHEMA.split(", log")[0]).write.parquet(str(tmp_path / "documents.parquet"))
    by_id = {r[0]: r for r in rows}
    for r in op12_manifest(spark, str(tmp_path)).collect():
        text = by_id[r["doc_id"]][4]
        touched = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (text or "")
        assert r["verified"] == (not touched) and r["verified"] == (r["folded_root"] == r["root"])


def test_open_subtrees_grow_as_a_stream():
    edge, leaves = OpenSubtrees(), [digest(str(i)) for i in range(50)]
    for n, leaf in enumerate(leaves, 1):
        edge.append(bytes.fromhex(leaf))
        whole = 3 ** max(0, len(edge.open) - 1)
        assert whole <= n and all(len(level) < 3 for level in edge.open)  # only the edge is open
    root, paths = plain_tree(leaves)
    assert edge.close(None).hex() == root
    assert [[(a.hex(), b.hex()) for a, b in w] for w in edge.witnesses] == paths
