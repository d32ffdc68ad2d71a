"""Blocks of a track in one worker call for many of them, as laid one by one."""

import numpy as np
from pyspark.sql import functions as F

from tessella.plans import synthesis


def test_many_blocks_a_call(spark):
    """Blocks come out alike however rows lie in batches, and no Python call is made for each of them."""
    rng = np.random.default_rng(3)
    rows, tracks = [], {}
    for v in (None, "a", "b"):
        whole, at = np.zeros(0, np.int16), 0
        for i in range(60):
            x = rng.integers(-999, 999, int(rng.integers(1, 90))).astype(np.int16)
            rows += [(v, i, 0, 7, 0, at, None), (v, i, 1, len(x), 0, at + 7, x.tolist())]
            whole, at = np.concatenate([whole, np.zeros(7, np.int16), x]), at + 7 + len(x)
        tracks[v] = whole
    df = spark.createDataFrame(rows, "video string, seg_idx int, part int, length long, fade int, at long, samples array<short>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        track = synthesis.track(df, 16)
        assert "FlatMapGroups" not in track._jdf.queryExecution().executedPlan().toString()
        laid = {}
        for r in track.orderBy("block").collect():
            laid.setdefault(r["video"], []).extend(r["samples"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert laid.keys() == tracks.keys() and all((np.array(laid[v]) == tracks[v]).all() for v in tracks)
    assert track.filter(F.size("samples") > 16).count() == 0
