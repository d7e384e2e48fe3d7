"""SimHash classes and line dedup against brute force."""

import random
import re

import pytest
import xxhash

from hirelake.llm.line_dedup import LineParams, dedup_lines, scanned_lines, shared_variants, surroundings, variant_keys, within_one_edit
from hirelake.llm.simhash import ball_masks, components, fingerprint_of, keep_one_each, near_duplicate_components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    named = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return sorted(((i, f"{p:016x}", named[g]) for (i, _), p, g in zip(rows, prints, group)), key=str)


def near_texts(seed, n=120):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 5, 60, 120]))) for _ in range(20)]
    rows = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words).upper() if rng.random() < 0.2 else " \t".join(words)))
    return rows


def test_classes_match_brute_force_on_odd_and_near_texts(make_docs):
    rows = near_texts(2) + [(500, None), (501, ""), (502, " \n"), (None, "alpha beta"), (None, rows_text := "lonely words only here"), (None, rows_text), (7, "again"), (7, "again"), (600, "É é Ä")]
    got = near_duplicate_components(make_docs(rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_components(rows)


def test_fingerprint_of_long_and_unicode_texts():
    long = " ".join(random.Random(4).choice(WORDS) for _ in range(20_000))
    for text in (long, " x y z", "a\x0bb\x0cc\rd", "𝔘𝔫𝔦 code 🙂 words"):
        assert fingerprint_of(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_one_document_of_each_group_stays(make_docs):
    rows = near_texts(6) + [(-1, None), (-2, ""), (None, "only here and nowhere else"), (900, "twice the same"), (900, "twice the same")]
    docs = make_docs(rows)
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns
    classes = plain_components(rows)
    assert kept.count() == len({(c[2], c[2] is None and c[1]) for c in classes})
    assert {r["doc_id"] for r in kept.collect()} == {c[2] for c in classes}
    assert keep_one_each(docs.limit(0)).count() == 0 and near_duplicate_components(docs.limit(0)).count() == 0


def test_masks_of_a_ball():
    assert len(ball_masks(2)) == 65 and len(ball_masks(4)) == 1 + 64 + 64 * 63 // 2 and ball_masks(0) == [0]
    with pytest.raises(ValueError):
        ball_masks(3)


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(300)]
    random.Random(5).shuffle(chain)
    hub = [(5_000, 5_000 + i) for i in range(1, 400)] + [(9_000, 9_001), (9_001, 9_000)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[5_000 + i] for i in range(400)} == {5_000} and got[9_001] == 9_000


def plain_dedup(rows, near=8):
    places = sorted(((i is None, i or 0, at, tuple(line.lower().split())) for i, t in set(rows) for at, line in enumerate((t or "").split("\n"))), key=lambda p: p[:3])

    def close(a, b):
        return a == b or (min(len(a), len(b)) >= near and within_one_edit(list(a), list(b)))

    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        mine = (i is None, i or 0)
        keep = [line for at, line in enumerate(t.split("\n")) if not (w := tuple(line.lower().split())) or not any(p[:3] < (*mine, at) and p[3] and close(p[3], w) for p in places)]
        out.append((i, "\n".join(keep)))
    return sorted(out, key=str)


def line_rows(seed):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.choice([1, 3, 7, 8, 9, 15, 40]))] for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, what = rng.randrange(len(words)), rng.randrange(3)
                if what == 0:
                    words[at] = rng.choice(WORDS)
                elif what == 1:
                    words.insert(at, rng.choice(WORDS))
                elif len(words) > 1:
                    del words[at]
            lines.append((" " if rng.random() < 0.8 else "  ").join(words).title())
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_match_brute_force(make_docs, seed):
    rows = line_rows(seed) + [(100, None), (101, ""), (102, "\n \n\n"), (None, "alpha beta"), (103, "alpha beta\nalpha beta"), (104, "word " * 20_000), (3, "other text\nof id three"), (3, "other text\nof id three")]
    docs = make_docs(rows)
    got = dedup_lines(docs, LineParams(map_bits=1 << 6))  # far too small: every bit is set
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == plain_dedup(rows)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_variants_meet_within_one_edit():
    a, b, c = "a b c d e f g h".split(), "a b x d e f g h".split(), "a b c d e f g h i".split()
    assert variant_keys(a)[1][2] == variant_keys(b)[1][2] and variant_keys(a)[0][2] == variant_keys(b)[0][2]
    assert variant_keys(a)[2] in variant_keys(c)[0].tolist() and variant_keys(a)[2] != variant_keys(b)[2]


def test_lines_within_one_edit_are_equal_around_the_stretch_that_holds_it():
    rng, p = random.Random(7), LineParams()
    for _ in range(500):
        a = [rng.choice(WORDS) for _ in range(rng.randrange(8, 40))]
        b, at = list(a), rng.randrange(len(a))
        b[at:at + rng.randrange(2)] = [rng.choice(WORDS)]  # replaced or inserted
        longer = b if len(b) >= len(a) else a
        mine = {k: (start, stop) for k, start, stop in surroundings(a, " ".join(a), p)}
        its = {k: (start, stop) for k, start, stop in surroundings(b, " ".join(b), p)}
        shared = set(mine) & set(its)
        assert any((its if longer is b else mine)[k][0] <= at < (its if longer is b else mine)[k][1] for k in shared), (a, b, at)
    assert not surroundings(WORDS[:7], "", p)


def test_a_common_line_in_most_documents(make_docs):
    rows = [(i, f"the common first line of all texts is this one\nown {i}") for i in range(300)] + [(300 + i, f"the common first line of all {i} is this one") for i in range(300)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(make_docs(rows, extra=False)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own {i}" for i in range(1, 300)) and all(got[i] == "" for i in range(300, 600))


def test_only_lines_that_share_a_surrounding_emit_variants(make_docs):
    rng = random.Random(11)
    alone = [(i, " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(40))) for i in range(400)]
    near = [(1000 + i, " ".join([*alone[i][1].split()[:20], "other", *alone[i][1].split()[21:]])) for i in range(5)]
    emitted = shared_variants(scanned_lines(make_docs(alone)))
    assert emitted.count() == 0
    lines = scanned_lines(make_docs(alone + near))
    rows = shared_variants(lines).collect()
    assert set(shared_variants(lines, LineParams(map_bits=64)).collect()) == set(rows)
    # Ten lines, each with itself and the 22 words of its three open stretches left out in two roles.
    assert len({r["id"] for r in rows}) == 10 and len(set(rows)) == 10 * (2 * 22 + 1)
