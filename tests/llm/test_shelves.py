"""Texts on shelves: the limit of buckets, the catalog, and that grouping by label moves no text."""

import pytest
from pyspark.sql import functions as F

from tessella.llm import shelves


@pytest.mark.parametrize("most", [100_000, 3])
def test_buckets(spark, monkeypatch, most):
    monkeypatch.setattr(shelves, "BUCKET", 1 << 10)
    monkeypatch.setattr(shelves, "GROUP", 1 << 9)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 20).alias("text"))
    before = {t.name for t in spark.catalog.listTables()}
    default = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", most)
    try:
        shelf, labels, size = shelves.shelved(docs, F.col("text"))
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", default)
    assert labels > size >> 10 and {t.name for t in spark.catalog.listTables()} == before
    assert sorted(shelf.select("doc_id", "text").collect()) == sorted(docs.collect())
    grouped = shelf.groupBy("label").agg(F.count("*").alias("n"))
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert sum(r["n"] for r in grouped.collect()) == 400
