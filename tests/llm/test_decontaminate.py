"""Decontamination against brute force, and the recall of its search."""

import random

import numpy as np
import pytest

from hirelake.llm.decontaminate import CgkParams, find_contamination, remove_contaminated, walk_keys, window_distance, word_hasher

VOCABULARY = [f"word{i}" for i in range(400)]


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        at, what = rng.randrange(len(words)), rng.randrange(3)
        if what == 0:
            words[at] = rng.choice(VOCABULARY)
        elif what == 1:
            words.insert(at, rng.choice(VOCABULARY))
        elif len(words) > 1:
            del words[at]
    return words


def plain_distance(item, text):
    """The fewest edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@pytest.fixture
def corpus():
    rng = random.Random(8)
    items = [(i, [rng.choice(VOCABULARY) for _ in range(rng.choice([4, 9, 15, 30, 60]))]) for i in range(25)]
    docs = []
    for i in range(120):
        text = [rng.choice(VOCABULARY) for _ in range(rng.randrange(5, 150))]
        if i % 3 == 0:
            _, words = rng.choice(items)
            at = rng.randrange(len(text))
            text[at:at] = edited(words, rng.randrange(int(0.3 * len(words)) + 1), rng)
        docs.append((i, text))
    return items, docs


def test_rows_match_brute_force(spark, make_docs, corpus):
    items, docs = corpus
    p = CgkParams()
    bench = spark.createDataFrame([(i, " ".join(w).title() + "!") for i, w in items] + [(90, None), (91, ""), (None, "... !"), (92, " ".join(items[0][1]))], "item_id long, text string").selectExpr("*", "1 AS n", "'x' AS key")
    rows = [(i, ", ".join(t)) for i, t in docs] + [(500, None), (501, ""), (None, " ".join(items[3][1])), (502, " ".join(items[3][1])), (502, " ".join(items[3][1]))]
    want = {(i, j) for i, t in [*docs, (None, items[3][1]), (502, items[3][1])] for j, w in [*items, (92, items[0][1])] if plain_distance(w, t) <= p.edits(len(w))}
    frame = make_docs(rows)
    found = find_contamination(frame, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got <= want and len(got) == len(found)
    assert len(got) >= 0.97 * len(want)
    exact = {(i, j) for i, j in want if i is not None and i < 120 and plain_distance(dict(items)[j if j != 92 else 0], dict(docs)[i]) == 0}
    assert exact <= got and {(None, 3), (502, 3)} <= got
    for r in found:
        words = dict(items).get(r["item_id"], items[0][1])
        text = dict(docs).get(r["doc_id"], items[3][1])
        assert r["edits"] == plain_distance(words, text) == plain_distance(words, text[r["start_word"]:r["start_word"] + r["n_words"]])
    kept = remove_contaminated(frame, bench)
    assert kept.columns == frame.columns
    hit = {r["doc_id"] for r in found}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in hit)


def test_empty_sides(spark, make_docs):
    bench = spark.createDataFrame([(1, "some words of an item that nobody knows")], "item_id long, text string")
    docs = make_docs([(1, "some words")])
    assert find_contamination(docs.limit(0), bench).count() == 0
    assert find_contamination(docs, bench.limit(0)).count() == 0
    assert remove_contaminated(docs, bench.limit(0)).count() == 1


def test_recall_of_the_keys_at_the_largest_distance():
    rng, p, hashes = random.Random(9), CgkParams(), word_hasher()
    met = 0
    for _ in range(200):
        n = rng.randrange(15, 60)
        item = [rng.choice(VOCABULARY) for _ in range(n)]
        near = [rng.choice(VOCABULARY) for _ in range(5)] + edited(item, p.edits(n), rng) + [rng.choice(VOCABULARY) for _ in range(30)]
        low, _ = p.size_class(n)
        mine = walk_keys(hashes(" ".join(item)), np.zeros(1, np.int64), low, p)
        its = walk_keys(hashes(" ".join(near)), np.arange(12), low, p)
        met += bool(set(mine.ravel().tolist()) & set(its.ravel().tolist()))
    assert met >= 190


def test_distance_and_stretch():
    rng = random.Random(10)
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 7))]
        b = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        d, start, end = window_distance(np.array(a, np.uint64), np.array(b, np.uint64))
        assert d == plain_distance(a, b) and plain_distance(a, b[start:end]) == d


def test_classes_cover_all_lengths():
    p = CgkParams()
    for n in range(1, 300):
        low, high = p.size_class(n)
        assert low <= n <= high and p.size_class(low) == p.size_class(high) == (low, high)


def test_recall_of_long_items_for_each_kind_of_edit(spark, make_docs):
    rng, p, trials = random.Random(12), CgkParams(), 20
    words = [f"word{i}" for i in range(3000)]
    cells = [(n, kind) for n in (60, 100, 200, 400) for kind in ("deleted", "inserted", "replaced")]
    items, docs = [], []
    for i in range(len(cells) * trials):
        n, kind = cells[i // trials]
        item = [rng.choice(words) for _ in range(n)]
        places = set(rng.sample(range(n), p.edits(n)))
        near = [x for at, w in enumerate(item) for x in ([w] if at not in places else {"deleted": [], "inserted": [rng.choice(words), w], "replaced": [rng.choice(words)]}[kind])]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join([rng.choice(words) for _ in range(rng.randrange(1, 80))] + near + [rng.choice(words) for _ in range(40)])))
    found = find_contamination(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    met = [r["doc_id"] for r in found if r["doc_id"] == r["item_id"]]
    share = {c: sum(i // trials == at for i in met) / trials for at, c in enumerate(cells)}
    assert min(share.values()) >= 0.95, share


def test_some_piece_of_an_item_is_within_its_share_of_edits():
    p = CgkParams()
    for n in range(1, 500):
        sizes = np.diff(p.cuts(n)).tolist()
        assert sum(sizes) == n and max(sizes) <= max(p.piece, 1) and max(sizes) - min(sizes) <= 1
        assert sum(p.edits(s) + 1 for s in sizes) > p.edits(n)


def test_only_rows_that_hold_an_item_go(spark, make_docs):
    item = "a benchmark item of some ten words or even more"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = [(None, "nothing to be found in here"), (None, None), (7, "another clean text of the same id"), (8, ""), (9, "clean")]
    docs = make_docs([*clean, (None, f"so {item} it is"), (7, item), (7, item), (10, f"{item} once again")])
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in remove_contaminated(docs, bench).collect()))) == sorted(map(str, clean))
