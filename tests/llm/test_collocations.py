"""Phrases against a plain count, whatever the size of a group."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from hirelake.llm.collocations import CollocationParams, build_subtree, mine_collocations, pieces_of

DOCS = "doc_id long, text string, lang string, w1 string, w2 string, w3 string, n string, part string, phrase string, a string, score string, rank string"


def plain(rows, least, top, pct=50):
    found, words = {}, Counter()
    for lang, text in rows:
        lang, low = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for k in (1, 2, 3):
                found.setdefault(lang, Counter()).update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if len(p) == 2 and any(100 * b >= pct * a for q, b in candidates.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, left, right, words[lang], -score) for n, (score, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts():
    rng = random.Random(11)
    words = ["The", "a", "é", "É", "x1", "of", "long", "word joined", "new", "york", "ß", "n't"]
    rows = []
    for i in range(250):
        lang = rng.choice(["en", "en", "de", None, "und"])
        parts = [rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "?"]) for _ in range(rng.randrange(60))]
        rows.append((lang, "".join(parts) + ("New York city " * 3 if i % 3 == 0 else "")))
    rows += [("en", None), ("en", ""), ("fr", "   \t.,;"), ("en", "Same row here. " * 5)] + [("en", "a a a a a a a a")] * 40
    rows += [("es", "uno dos " * 30_000)]  # one very long piece
    return rows


@pytest.mark.parametrize("group,task", [(500_000, 2_000_000), (40, 100), (3, 7)])
def test_matches_a_plain_count_whatever_the_groups(spark, group, task):
    rows = texts()
    if group < 10:
        rows = [r for r in rows if len(r[1] or "") < 200][:60]
    docs = spark.createDataFrame([(i, t, lang, *["x"] * 9) for i, (lang, t) in enumerate(rows)], DOCS)
    got = mine_collocations(docs, CollocationParams(least=4, top=30, group_rows=group, task_rows=task))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 4, 30)


def test_empty_tables_and_texts_give_no_phrases(spark):
    docs = spark.createDataFrame([(1, None, "en", *["x"] * 9), (2, "", None, *["x"] * 9)], DOCS)
    assert mine_collocations(docs).count() == 0 and mine_collocations(docs.limit(0)).count() == 0


def test_counts_past_64_bits_stay_exact(spark):
    from pyspark.sql import functions as F

    a, left, right = 9_000_000_000_000_000, 9_000_000_000_000_001, 9_999_999_999_999_999
    score = "(1000000 * CAST(a AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0))) div (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))"
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(F.expr(score).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (left * right)


def test_nodes_are_totals_of_their_leaves():
    rows = [("en", "a", "b", "c", 3), ("en", "a", "b", None, 2), ("en", "a", "b", "c", 4), ("en", "a", "d", None, 1), ("de", "a", "b", "c", 9)]
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(["lang", "w1", "w2", "w3", "n"])})
    nodes = lambda whole: sorted((tuple(r.values()) for r in build_subtree(table, 2, whole).to_pylist()), key=str)
    assert nodes(True) == sorted([("en", "a", "b", "c", 7), ("de", "a", "b", "c", 9), ("en", "a", "b", None, 9), ("de", "a", "b", None, 9)], key=str)
    assert nodes(False) == sorted([("en", "a", "b", "c", 7), ("de", "a", "b", "c", 9)], key=str)


def test_pieces_fold_only_ascii_letters():
    assert list(pieces_of("ÀB c\td.É\x0bx y")) == [["Àb".encode(), b"c", b"d"], ["É".encode()], ["x y".encode()]]
