"""Tables with a row for each segment aren't broadcast, however small their compressed files are."""

from pyspark.sql import functions as F

from tessella.operators import requests, timeline
from tessella.plans import batches
from tessella.plans.backends import Brittle
from tessella.sources.staged import few_or_sorted, stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def alike(spark):
    """Rows that compress to nearly nothing."""
    rows = spark.range(3000).select((F.col("id") % 3).alias("video"), F.floor(F.col("id") / 3).cast("int").alias("seg_idx"), F.lit(1.0).alias("start"), F.lit("view").alias("text"))
    return stored(rows, "alike")


def test_chunks_and_numbers(spark):
    s = alike(spark)
    chunks = timeline.anchored_chunks(s, 0.5)
    assert "Broadcast" not in plan(chunks) and chunks.filter("chunk_id = 0").count() == 3000
    numbered = requests.numbered(s.select(F.col("video").alias("batch"), F.col("seg_idx").alias("item")))
    assert "Broadcast" not in plan(numbered) and numbered.filter("n = item").count() == 3000


def test_replies(spark):
    rows = alike(spark).select(F.col("video").alias("batch"), F.col("seg_idx").alias("item"), F.lit("google").alias("backend"), F.lit("en").alias("src"), F.col("text").alias("locked"))
    replies = batches.asked(rows, "fr", {"google": Brittle})
    assert "Broadcast" not in plan(replies) and replies.filter("hypothesis = '[en>fr] view'").count() == 3000


def test_by_counted_rows(spark):
    few, s = alike(spark).limit(3), alike(spark)
    joined = lambda other: plan(s.join(other.select("video"), "video"))
    assert "BroadcastHashJoin" in joined(few_or_sorted(few, 8)) and "Broadcast" not in joined(few_or_sorted(s, 1 << 20))
