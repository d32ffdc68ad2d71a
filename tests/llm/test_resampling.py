"""Importance resampling against brute force; radix selection against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import resampling
from tessella.sources.staged import stored

from .data import documents, frame
from .test_text_ops import empty


def features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, buckets, longest, least, share, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, longest)[1]) for texts in ([r[1] for r in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, text, *_ in rows:
        n, f = features(text, longest)
        weight = math.floor(sum(gain(bucket(x)) for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(able[: share[0] * len(able) // share[1]]):
        x[4] = k + 1
    return Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize("longest, share, least", [(1, (10, 100), 20), (3, (1, 2), 0), (1, (1, 1), 5), (2, (0, 1), 1)])
def test_resample(spark, longest, share, least):
    rows = documents(4)
    target = [r[1] for r in documents(9)[:12]]
    got = resampling.resample(frame(spark, rows), frame(spark, [(0, t, None, None, 0, None, 0) for t in target]), 97, longest, least, share, 7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(rows, target, 97, longest, least, share, 7)


def test_many_equal_rows(spark):
    """A third of all rows is one document, and the draw ends among them."""
    rows = [(5, "of a text that is there many times " * 5, None, None, 0, None, 0)] * 100 + documents(2)[:60]
    got = resampling.resample(frame(spark, rows), frame(spark, documents(3)[:5]), share=(1, 2)).collect()
    assert Counter(map(tuple, got)) == brute(rows, [r[1] for r in documents(3)[:5]], 10_000, 1, 20, (1, 2), 2024)
    assert 0 < sum(r["rank"] is not None for r in got if r["doc_id"] == 5) < 100


def test_nothing(spark):
    none = empty(spark)
    assert resampling.resample(none, none).collect() == []
    rows = documents(5, 10)
    assert Counter(map(tuple, resampling.resample(frame(spark, rows), none).collect())) == brute(rows, [], 10_000, 1, 20, (10, 100), 2024)


@pytest.mark.parametrize("digit", [11, 16])
def test_radix_selection(spark, digit):
    rng = random.Random(digit)
    ends = [-(1 << 63), (1 << 63) - 1, 0, -1]
    rows = list({(rng.choice([3, 4, -7, *ends]), rng.choice([rng.randrange(-50, 50), *ends]), 9) for _ in range(120)})
    df = stored(spark.createDataFrame(rows, "a long, b long, c long"), "keys")
    for k in (0, 1, 59, len(rows) - 1, len(rows) + 5):
        got = df.filter(resampling.up_to(df, ["a", "b", "c"], k, digit))
        assert sorted(map(tuple, got.collect())) == sorted(rows)[:k]


def test_rounds_are_few(spark, monkeypatch):
    """Scores that differ in 15 bits and ids in 17 take three rounds of counts, whatever bits they have in common."""
    df = stored(spark.range(100_000).select((F.lit(-(10**12)) - F.col("id") % 20_000).alias("a"), (F.col("id") + 10**15).alias("b")), "keys")
    rounds = []
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c, f=type(df).groupBy: rounds.append(1) or f(self, *c))
    found = df.filter(resampling.up_to(df, ["a", "b"], 33_333))
    monkeypatch.undo()
    assert found.count() == 33_333 and len(rounds) <= 3


def test_ranked_over_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("a")).repartition(7)
    assert sorted((r["a"], r["rank"]) for r in resampling.ranked(df, ["a"]).collect()) == [(i, i + 1) for i in range(5000)]
