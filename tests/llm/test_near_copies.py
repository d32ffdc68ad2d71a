"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import random
from collections import defaultdict

import numpy as np

from tessella.llm import shingles

from .data import documents, frame, words
from .test_row_ops import lower
from .test_text_ops import empty, space_words


def shingle_set(t):
    w = space_words(lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    sets, label = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if label[i] != label[j] and (5 * len(x & y) >= 4 * len(x | y)):
                a, b = sorted((label[i], label[j]))
                label = [a if k == b else k for k in label]
    return label


def near_rows():
    """Copies with one to four changed words of 30 to 300, a chain, a large group, a common passage, and texts at both sides of 0.8."""
    rng = random.Random(8)
    texts, passage = [r[1] for r in documents(2, 40)], words(rng, 40)
    for n in (30, 44, 45, 46, 60, 100, 150, 300):
        for changed in (1, 2, 3, 4):
            w = words(rng, n)
            v = list(w)
            for i in rng.sample(range(n), changed):
                v[i] = f"changed{i}"
            texts += [" ".join(w), " ".join(v).upper()]
    w = words(rng, 120)
    for i in range(12):  # each is near the next, the ends are not near
        w = list(w)
        w[i * 10 + 3] = f"step{i}"
        texts.append(" ".join(w))
    w = words(rng, 90)
    texts += [" ".join(w[:i] + [f"x{i}"] + w[i:]) for i in range(60)]
    texts += [" ".join([*passage, *words(rng, rng.randrange(5, 40))]) for _ in range(30)]
    texts += [" ".join(f"u{i}" for i in range(n)) for n in (14, 15, 16, 84, 104, 105)]
    rng.shuffle(texts)
    return [(i, t, "en", "s0", len(t or ""), None, 0) for i, t in enumerate(texts)]


def test_near_copies(spark, monkeypatch):
    rows = near_rows()
    label = brute_groups([r[1] for r in rows])
    expected = defaultdict(set)
    for r, k in zip(rows, label):
        expected[k].add(r[0])
    assert max(map(len, expected.values())) >= 60
    for common in (8, 1 << 30):  # common shingles last, and in no order but their hashes'
        monkeypatch.setattr(shingles, "COMMON", common)
        got = defaultdict(set)
        for r in shingles.near_copies(frame(spark, rows)).collect():
            got[r["root"]].add(r["doc_id"])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))
    families = shingles.families
    for n, size in ((7, 1 << 20), (2048, 900)):  # in blocks
        monkeypatch.setattr(shingles, "families", lambda shared, nodes, n=n, size=size: families(shared, nodes, n, size))
        got = defaultdict(set)
        for r in shingles.near_copies(frame(spark, rows)).collect():
            got[r["root"]].add(r["doc_id"])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))
    assert shingles.near_copies(empty(spark)).count() == 0


def test_in_common_and_connected():
    rng = random.Random(1)
    sets = [sorted(rng.sample(range(40), rng.randrange(1, 30))) for _ in range(25)]
    got = shingles.in_common([np.array(x, np.uint64) for x in sets])
    assert all(got[i, j] == len(set(x) & set(y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j)
    chain = np.zeros((9, 9), bool)
    for a, b in ((8, 3), (3, 5), (5, 6), (1, 2)):
        chain[a, b] = chain[b, a] = True
    assert shingles.connected(chain).tolist() == [0, 1, 1, 3, 4, 3, 3, 7, 3]


def test_stage_keeps_one(spark):
    import corpus_pipeline as P

    rows = near_rows()
    first = {}
    for r, k in zip(rows, brute_groups([r[1] for r in rows])):
        first[k] = min(first.get(k, r[0]), r[0])
    kept = P.near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values())
