"""Benchmark evaluation, comparison of results, and regression against history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import MEASURES, scored
from ..functions.text import distinct_words, let, text, words

METRICS = ("wer_mean", "chrf_mean", "bleu_mean")


def diversity(c: Column | str) -> Column:
    """The share of distinct words, 1 of fewer than five."""
    return let(words(c), lambda w: F.when(F.size(w) < 5, F.lit(1.0)).otherwise(distinct_words(c) / F.size(w)))


def evaluate(df: DataFrame, translate=None) -> DataFrame:
    """Adds wer, chrf, bleu, bleu_std and repetition_score for df(source, reference, hypothesis).

    translate: a function from the source column to a hypothesis column. Rows without source, reference or hypothesis are dropped."""
    if translate is not None:
        df = df.withColumn("hypothesis", translate(F.col("source")))
    kept = df.filter((text("source") != "") & (text("reference") != "") & F.col("hypothesis").isNotNull())
    return kept.select(*df.columns, *(scored(m, "reference", "hypothesis").alias(m) for m in MEASURES), diversity("hypothesis").alias("repetition_score"))


def upper_median(c: str) -> Column:
    """Of an even number of values the upper middle one: the least with half of the values, rounded down, below it.

    percentile_disc has the lower one; from the other end it is the upper."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")


def aggregate(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("num_segments"), F.avg("wer").alias("wer_mean"), upper_median("wer").alias("wer_median"), F.avg("chrf").alias("chrf_mean"), F.avg("bleu").alias("bleu_mean"))


def unpivot(df: DataFrame, *keys: str) -> DataFrame:
    return df.unpivot(list(keys), list(METRICS), "metric", "value")


def compare(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, result1, result2, delta, delta_percent, improved; a missing metric is 0."""
    a, b = unpivot(first, *keys).withColumnRenamed("value", "_1"), unpivot(second, *keys).withColumnRenamed("value", "_2")
    out = a.join(b, [*keys, "metric"], "full")
    v1, v2 = F.coalesce("_1", F.lit(0.0)), F.coalesce("_2", F.lit(0.0))
    out = out.select(*keys, "metric", v1.alias("result1"), v2.alias("result2"), (v2 - v1).alias("delta"))
    percent = F.coalesce(F.try_divide(F.col("delta") * 100, F.col("result1")), F.lit(0.0))
    return out.withColumns({"delta_percent": percent, "improved": F.when(F.col("metric") == "wer_mean", F.col("delta") < 0).otherwise(F.col("delta") > 0)})


def regression(history: DataFrame, threshold: float = 5.0) -> DataFrame:
    """benchmark, backend, metric, previous, current, delta, delta_percent, severity of what got worse by more than threshold percent.

    history(benchmark, backend, ts, metrics...): the last entry of a pair is current; it is held against the best of those before, by chrF less
    word error rate, the first on ties. A pair with one entry has no alerts."""
    pair = ["benchmark", "backend"]
    last = history.withColumn("_k", F.row_number().over(Window.partitionBy(*pair).orderBy(F.col("ts").desc(), *(F.col(m).desc() for m in METRICS))))
    score = F.coalesce("chrf_mean", F.lit(0.0)) - F.coalesce("wer_mean", F.lit(0.0))
    best = last.filter("_k > 1").withColumn("_b", F.row_number().over(Window.partitionBy(*pair).orderBy(score.desc(), "ts", *METRICS))).filter("_b = 1")
    now, was = (unpivot(x.select(*pair, *METRICS), *pair).filter("value is not null") for x in (last.filter("_k = 1"), best))
    out = now.withColumnRenamed("value", "current").join(was.withColumnRenamed("value", "previous"), [*pair, "metric"])
    out = out.withColumn("delta", F.when(F.col("metric") == "wer_mean", F.col("current") - F.col("previous")).otherwise(F.col("previous") - F.col("current")))
    out = out.withColumn("delta_percent", F.coalesce(F.abs(F.try_divide(F.col("delta") * 100, F.col("previous"))), F.lit(0.0)))
    return out.filter((F.col("delta") > 0) & (F.col("delta_percent") > threshold)).withColumn("severity", F.when(F.col("delta_percent") > 10, "critical").otherwise("warning"))
