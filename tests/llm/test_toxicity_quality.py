"""Held-out accuracy of the two classifiers, and their answers on odd rows."""

import random

import numpy as np
import pytest

from hirelake.llm.common import bounded_labels
from hirelake.llm.quality import FEATURES, classify_quality, fit_quadratic, statistics
from hirelake.llm.queries import op1_toxicity, op5_quality
from hirelake.llm.toxicity import SubwordParams, fit_bags, score_toxicity, settled_shift, text_bag, train_toxicity, word_features

#: Some 400 toxic documents among 4,000 labelled ones.
SF = "/root/testdata/sf0.1"
SMALL = SubwordParams(buckets=1 << 12, max_share=0.1)


def accuracy(spark, rows, label):
    from hirelake.llm.common import table

    known = {r["doc_id"]: r[label] for r in table(spark, SF, "labels").collect()}
    pairs = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    return pairs, np.mean([p == y for p, y in pairs])


def test_toxicity_on_rows_held_out(spark):
    rows = op1_toxicity(spark, SF).collect()
    pairs, right = accuracy(spark, rows, "toxic")
    assert len(rows) == 10_000 and right >= 0.94
    assert sum(p and not y for p, y in pairs) <= 0.02 * len(pairs)
    assert sum(p and y for p, y in pairs) >= 0.75 * sum(y for _, y in pairs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_the_threshold_is_settled_on_rows_unseen():
    rng = random.Random(3)
    rows = [(int(i % 5 == 0), f"{'vile' if i % 5 == 0 else 'calm'} " + " ".join(rng.choice("abcdefgh") * 3 for _ in range(20))) for i in range(200)]
    bags = [(y, *text_bag(t, SMALL)) for y, t in rows]
    assert settled_shift(list(bags), {0: 160, 1: 40}, SMALL) == 0  # told apart already: nothing to move
    assert settled_shift([b for b in bags if b[0] == 0], {0: 160, 1: 0}, SMALL) == 0
    assert settled_shift([], {}, SMALL) == 0
    mixed = [(int(rng.random() < 0.2), *text_bag("the same words", SMALL)) for _ in range(100)]
    shift = settled_shift(list(mixed), {1: 20, 0: 80}, SMALL)
    assert shift > 0  # nothing tells them apart: the measure is best where all are taken


def test_quality_on_rows_held_out(spark):
    rows = op5_quality(spark, SF).collect()
    _, right = accuracy(spark, rows, "quality")
    assert len(rows) == 10_000 and right >= 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def tiny_corpus():
    rng = random.Random(1)
    words = "river stone garden window market letter summer paper morning travel".split()
    rows = []
    for i in range(200):
        text = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            for _ in range(3):
                text[rng.randrange(30)] = rng.choice(["dreadful", "horrible"])
        rows.append((i, " ".join(text)))
    return rows


def test_a_misspelling_never_seen_shares_the_vectors_of_its_word(spark, make_docs):
    rows = tiny_corpus()
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = train_toxicity(make_docs(rows), labels, params=SMALL)
    of = model.scorer()
    clean = " ".join(["river stone garden window market letter"] * 3)
    assert of(clean) < 0.5 < of(clean + " dreadful horrible dreadful")
    assert of(clean + " dreadfull horribble dreadfull") > of(clean + " summers papers summers")


def test_odd_rows_are_scored(spark, make_docs):
    rows = tiny_corpus()
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (3, None), (5, 1), (999, 1)], "doc_id long, toxic int")
    odd = make_docs(rows + [(None, "river"), (7, None), (8, ""), (9, "  \n "), (10, "stone " * 30_000), (10, "stone " * 30_000)])
    got = score_toxicity(odd, train_toxicity(odd, labels, params=SMALL))
    assert got.columns == ["doc_id", "score", "predicted"]
    answers = got.collect()
    assert len(answers) == 206 and all(0 <= r["score"] <= 1 for r in answers)
    assert len({r["score"] for r in answers if r["doc_id"] in (8, 9)} - {r["score"] for r in answers if r["doc_id"] in (8, 9)}) == 0
    twice = [r["score"] for r in answers if r["doc_id"] == 10]
    assert twice[-1] == twice[-2]
    assert score_toxicity(odd.limit(0), train_toxicity(odd.limit(0), labels, params=SMALL)).count() == 0


def test_one_class_or_none_gives_the_share():
    p = SMALL
    bag = text_bag("some words here", p)
    assert fit_bags([(1, *bag)], {1: 3}, p).scorer()("any") > 0.99
    assert fit_bags([], {}, p).scorer()(None) < 0.01
    assert word_features("ab", p) == word_features("ab", p) and len(word_features("ab", p)) == 4


def test_the_training_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(100)], "doc_id long, toxic int")
    picked, counts = bounded_labels(labels, "toxic", 20)
    rows = picked.collect()
    assert counts == {0: 50, 1: 50} and len(rows) == 20 and sum(r["_y"] for r in rows) == 8


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (200, 3))
    sums = {y: (float(len(x)), x.sum(0), x.T @ x) for y, x in ((0, a), (1, b))}
    model = fit_quadratic(sums, shrink=0, pool=0, ridge=0)
    x = rng.normal(0.5, 1.5, (50, 3))
    logs = []
    for y, rows in ((0, a), (1, b)):
        cov, d = np.cov(rows.T, bias=True), x - rows.mean(0)
        logs.append(np.log(len(rows) / 600) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov)))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_on_odd_rows(spark, make_docs):
    rows = [(i, "plain words in a line of text\nanother line" if i % 2 else "&&& %%% ### &&& %%%") for i in range(40)]
    odd = make_docs(rows + [(None, "a"), (50, None), (51, ""), (52, "\n\n"), (53, "w " * 50_000), (1, rows[1][1])])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 0), (41, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in classify_quality(odd, labels).collect()}
    assert got[1] > 0.5 > got[2] and all(0 <= s <= 1 for s in got.values()) and len(got) == 45
    alone = classify_quality(odd, labels.where("quality = 1")).collect()
    assert {r["score"] for r in alone} == {1.0}
    assert classify_quality(odd.limit(0), labels).count() == 0
    assert classify_quality(odd, labels.limit(0)).first()["predicted"] == 0
    assert len(statistics(None)) == len(FEATURES) and statistics(None) == statistics("")


def test_bad_params_are_not_hidden():
    with pytest.raises(TypeError):
        SubwordParams(unknown=1)
