"""The n-gram Jaccard join against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import jaccard
from tessella.llm.shingles import shingler

from .data import documents, frame, words
from .test_row_ops import lower
from .test_text_ops import empty, space_words


def gram_set(t, size=3):
    w = space_words(lower(t))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size=3, alike=(90, 100)):
    of = defaultdict(list)
    for i, t, *_ in rows:
        of[gram_set(t, size)].append(i)
    found = [s for s in of if s]
    label = list(range(len(found)))
    for i, x in enumerate(found):
        for j, y in enumerate(found[:i]):
            if label[i] != label[j] and alike[1] * min(len(x), len(y)) >= alike[0] * max(len(x), len(y)) and alike[1] * len(x & y) >= alike[0] * len(x | y):
                a, b = sorted((label[i], label[j]))
                label = [a if k == b else k for k in label]
    least = defaultdict(list)
    for s, k in zip(found, label):
        least[k] += [i for i in of[s] if i is not None]
    least = {s: min(least[k], default=None) for s, k in zip(found, label)}
    return Counter((i, len(gram_set(t, size)), least.get(gram_set(t, size), i)) for i, t, *_ in rows)


def near_rows(seed=8):
    """Copies with one to five changed words of 20 to 400, a chain, large groups of near copies, a passage in many texts, texts at both sides of the threshold."""
    rng = random.Random(seed)
    texts, passage = [r[1] for r in documents(2, 40)], words(rng, 40)
    for n in (20, 57, 58, 59, 60, 61, 100, 200, 400):
        for changed in (1, 2, 3, 5):
            w = words(rng, n)
            v = list(w)
            for i in rng.sample(range(n), changed):
                v[i] = f"changed{i}"
            texts += [" ".join(w), " ".join(v).upper()]
    w = words(rng, 150)
    for i in range(14):  # each is linked with the next, the ends are not
        w = list(w)
        w[i * 10 + 3] = f"step{i}"
        texts.append(" ".join(w))
    for _ in range(2):
        w = words(rng, 90)
        texts += [" ".join(w[:i] + [f"x{i}"] + w[i:]) for i in range(50)]
    texts += [" ".join([*passage, *words(rng, rng.randrange(1, 40))]) for _ in range(40)]
    texts += [" ".join(f"u{i}" for i in range(n)) for n in (20, 22, 23, 91, 101, 102)]
    rng.shuffle(texts)
    return [(None if i % 50 == 7 else i, t, "en", "s0", len(t or ""), None, 0) for i, t in enumerate(texts)] + [(3, texts[5], "en", "s0", 0, None, 0)] * 3


@pytest.mark.parametrize("most, block, size, alike", [(1 << 20, 512, 3, (90, 100)), (5, 7, 3, (90, 100)), (1, 20, 2, (7, 10))])
def test_join(spark, most, block, size, alike):
    rows = near_rows()
    expected = brute(rows, size, alike)
    groups = Counter(x[2] for x in expected)
    assert max(groups.values()) >= 40 and sum(n > 1 for n in groups.values()) > 10
    got = jaccard.join(frame(spark, rows), size, alike, most, block).select("doc_id", "n", "component_id")
    assert Counter(map(tuple, got.collect())) == expected


def test_frequent(spark):
    """Counts of all texts, wherever they lie; the most frequent is last."""
    rows = [(i, " ".join(f"d{i}x{j}" for j in range(50)) + " in all of them" * (i % 2 == 0) + " in half of those" * (i % 4 == 0), None, None, 0, None, 0) for i in range(200)]
    found = jaccard.frequent(frame(spark, rows).coalesce(1)).tolist()
    gram = lambda t: shingler(3)(t).tolist()[0]
    assert set(found[-2:]) == {gram("in all of"), gram("all of them")}
    assert found.index(gram("in all of")) > found.index(gram("half of those"))
    assert jaccard.frequent(frame(spark, rows), at_once=1).tolist() == []


def test_a_group_makes_no_pairs(spark, monkeypatch):
    """400 near copies give about an edge each."""
    rng = random.Random(3)
    w = words(rng, 200)
    rows = [(i, " ".join([*w[: i % 200], f"own{i}", *w[i % 200 :]]), None, None, 0, None, 0) for i in range(400)]
    made = []
    for name in ("verified", "linked_in_families"):
        monkeypatch.setattr(jaccard, name, lambda first, *a, f=getattr(jaccard, name): made.append(f(first, *a)) or made[-1])
    got = jaccard.join(frame(spark, rows))
    assert {r["component_id"] for r in got.collect()} == {0} and sum(x.count() for x in made) < 1200


def test_filters_lose_nothing():
    """Positional and suffix bounds hold for linked sets, at all common places of their prefixes."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.05], rng.integers(0, 1 << 63, int(rng.integers(0, 8))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        bins = [np.bincount((s >> np.uint64(59)).astype(int), minlength=32) for s in (x, y)]
        assert len(x) + len(y) - np.abs(bins[0] - bins[1]).sum() >= 2 * both
        for v in np.intersect1d(x, y)[:20]:
            i, j = np.searchsorted(x, v), np.searchsorted(y, v)
            assert min(i, j) + min(len(x) - i, len(y) - j) >= both


def test_nothing(spark):
    assert jaccard.join(empty(spark)).collect() == []
    rows = [(i, t, None, None, 0, None, 0) for i, t in enumerate([None, "", " \n", "alone"])]
    assert sorted((r["doc_id"], r["n"], r["component_id"]) for r in jaccard.join(frame(spark, rows)).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3)]
