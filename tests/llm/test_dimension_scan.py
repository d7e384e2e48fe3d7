"""Inverted lists read by dimensions, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm.dimension_scan import ScanParams, approximate_neighbours, fit_centres, list_order, norms, recall_of, rotate, scan_piece

SCHEMA = "vec_id long, embedding array<{}>, label int, v string, id string, row string, entry string, dim string, list string, score string"


def product(a, b):
    """Added up in order; `sum` would compensate."""
    out = 0.0
    for x, y in zip(a, b):
        out += x * y
    return out


def plain(rows, k, every=20):
    ok = [(i, np.array(e, float)) for i, e in rows if e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    out = []
    for a, (q, v) in enumerate(ok):
        if q is None or q % every:
            continue
        scores = sorted((-product(v.tolist(), w.tolist()), c is None, c or 0) for b, (c, w) in enumerate(ok) if b != a and len(w) == len(v))
        out += [(q, n + 1, None if null else c, -s) for n, (s, null, c) in enumerate(scores[:k])]
    return sorted(out, key=str)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, 0, *["x"] * 7) for r in rows], SCHEMA.format(kind)).repartition(4)


def single(x):
    return [float(y) for y in np.array(x, np.float32)]


def odd_rows(rng):
    rows = [(i, single(rng.normal(size=12) * rng.choice([0.1, 1, 30]))) for i in range(600)]
    rows += [(i, [0.5] * 12) for i in range(700, 900)] + [(900, rows[20][1]), (40, rows[40][1]), (None, rows[60][1]), (None, [0.25] * 12)]
    rows += [(1000, None), (1020, [1.0, None] + [0.0] * 10), (1040, [float("nan")] * 12), (1060, [float("inf")] * 12), (1080, [0.0] * 12), (1100, [])]
    return rows + [(1120, [1.0, 2.0]), (1121, [2.0, 1.0]), (1140, [1.0, 2.0, 3.0]), (1160, [5.0]), (1161, [-1.0]), (1162, [2.0])]


@pytest.mark.parametrize("kind", ["double", "float"])
def test_all_lists_read_is_exact(spark, kind):
    """With every list read and a generous test nothing may be lost, ties and odd rows included."""
    rows = odd_rows(np.random.default_rng(3))
    got = approximate_neighbours(frame(spark, rows, kind), F.col("vec_id") % 20 == 0, 7, params=ScanParams(recall=1.0, list_rows=40, piece_rows=30, block_queries=9, columns=4, slack=20.0, trial_queries=5000))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 7)


def test_recall_and_exact_scores_at_production_settings(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 48))
    rows = [(i, single(centres[rng.integers(30)] + 0.7 * rng.normal(size=48))) for i in range(6000)]
    vectors = frame(spark, rows, "float").cache()
    got = approximate_neighbours(vectors, F.col("vec_id") % 20 == 0).cache()
    assert got.groupBy("query_id").count().where("count <> 20").count() == 0 and got.select("query_id").distinct().count() == 300
    assert recall_of(got, vectors, F.col("vec_id") % 20 == 0) >= 0.93
    by_id = dict(rows)
    for r in got.limit(500).collect():
        assert r["score"] == product(by_id[r["query_id"]], by_id[r["vec_id"]])


def test_empty_tables_and_tables_without_queries(spark):
    rows = [(1, [1.0, 2.0]), (2, [0.0, 1.0])]
    assert approximate_neighbours(frame(spark, rows).limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert approximate_neighbours(frame(spark, rows), F.col("vec_id") == 99).count() == 0
    assert approximate_neighbours(frame(spark, rows[:1]), F.col("vec_id") == 1).count() == 0


def test_one_direction_in_many_lengths_and_huge_numbers(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(1, 90)] + [(200, [1e150, 0.0, 1.0]), (220, [-1e150, 1e-150, 0.0])]
    got = approximate_neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0, 5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 5)


def piece_of(vectors, params):
    sizes = norms(vectors)
    turned = rotate(vectors / sizes[:, None], params.seed).astype(np.float32)
    return {"vectors": vectors, "norms": sizes, "blocks": [turned[:, at:at + params.columns] for at in range(0, turned.shape[1], params.columns)]}


def test_candidates_are_abandoned_early():
    rng, params = np.random.default_rng(5), ScanParams()
    middle = rng.normal(size=(40, 128))
    vectors, queries = (middle[rng.integers(40, size=n)] + 0.5 * rng.normal(size=(n, 128)) for n in (4000, 20))
    scores = queries @ vectors.T
    floors = np.sort(scores, axis=1)[:, -10]
    q, c, s, read = scan_piece(piece_of(vectors, params), queries, floors, 10, params)
    true = {(i, j) for i in range(20) for j in np.flatnonzero(scores[i] >= floors[i])}
    assert len(true & set(zip(q.tolist(), c.tolist()))) >= 0.97 * len(true)
    assert np.allclose(s, scores[q, c]) and read < 0.6 * 20 * 4000 * 128


def test_rotation_keeps_products_and_spreads_one_component():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(50, 33))
    turned = rotate(a, 7)
    assert turned.shape == (50, 64) and np.allclose(turned @ turned.T, a @ a.T)
    assert np.abs(rotate(np.eye(64), 7)).max() < 0.9


def test_centres_part_clusters():
    rng = np.random.default_rng(8)
    middle = np.eye(16)[:4]
    units = middle[rng.integers(4, size=800)] + 0.05 * rng.normal(size=(800, 16))
    units /= np.linalg.norm(units, axis=1)[:, None]
    centres = fit_centres(units, 12, 8, 1)
    assert (np.abs(np.linalg.norm(centres, axis=1) - 1) < 1e-9).all()
    assert (list_order(units, centres)[:, 0] == (units @ centres.T).argmax(axis=1)).all()
