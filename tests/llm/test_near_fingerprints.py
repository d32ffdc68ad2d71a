"""The near-dedup stage goes through SimHash: fingerprints of the sets of shingles, linked within its radius by the trees."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import shingles, simhash
from tessella.llm.simhash import components

from .data import documents, frame


def test_pairs_of_simhash(spark, monkeypatch):
    docs = frame(spark, documents(5))
    each = shingles.prefixes(docs).collect()
    of = shingles.shingler()
    texts = {r["v"]: r["text"] for r in docs.select("text", F.xxhash64("text").alias("v")).collect()}
    for r in each:
        h = of(texts[r["v"]])
        bits = [sum(int(x) >> k & 1 for x in h) * 2 > len(h) for k in range(64)]
        assert np.array([r["fp"]], np.int64).view(np.uint64)[0] == sum(1 << k for k in range(64) if bits[k])
    rows = sorted({(bytes(r["key"]), r["n"], r["fp"]) for r in each})
    classes = spark.createDataFrame([(i, n, fp) for i, (_, n, fp) in enumerate(rows)], "id long, n int, fp long").cache()
    radius = 12  # so that a small table has pairs of different fingerprints
    found = {r["node"]: r["root"] for r in components(shingles.near_fingerprints(classes, radius)).collect()}
    plain = [(a, b) for a, b in combinations([r for r in classes.collect() if r["n"]], 2) if bin((a["fp"] ^ b["fp"]) & (1 << 64) - 1).count("1") <= radius]
    assert plain and all(found[a["id"]] == found[b["id"]] for a, b in plain)
    expected = {r["node"]: r["root"] for r in components(spark.createDataFrame([(a["id"], b["id"]) for a, b in plain], "a long, b long")).collect()}
    assert found == expected

    # the stage asks for them, and all its groups are those of the exact check
    seen, asked = [], simhash.near_edges
    monkeypatch.setattr(shingles, "near_edges", lambda *a, **k: seen.append(a) or asked(*a, **k))
    assert shingles.near_copies(docs).count() == docs.count() and len(seen) == 1
