"""Routing and planning: small fixed dimensions, joined or looked up, and CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scripts import BACKENDS, CATEGORIES, MODEL_CODES, ROUTES, SPEECH_NAMES, TIERS
from ..functions.text import col, script_share


def lookup(c: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "src string, tgt string, backend string")


def route(df: DataFrame, default: str = "indictrans2", requested: str | None = None) -> DataFrame:
    """Adds backend for df(src, tgt): a requested valid one, the pair's, the reverse pair's, or the default. The dimension has 25 rows."""
    if requested and requested.lower() in BACKENDS:
        return df.withColumn("backend", F.lit(requested.lower()))
    r = routes(df.sparkSession)
    out = df.join(F.broadcast(r.withColumnRenamed("backend", "_f")), ["src", "tgt"], "left")
    back = r.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.col("backend").alias("_r"))
    return out.join(F.broadcast(back), ["src", "tgt"], "left").withColumn("backend", F.coalesce("_f", "_r", F.lit(default))).drop("_f", "_r")


def romanized(backend, src, tgt, c) -> Column:
    """Whether a Hindi or Marathi source is written in Latin letters, which the two model backends can't take."""
    share = script_share(c)
    return col(backend).isin("nllb", "indictrans2") & col(src).isin("hi", "mr") & (col(tgt) == "en") & (share["latin"] >= 0.55) & (share["deva"] <= 0.15)


def route_texts(df: DataFrame, default: str = "indictrans2", requested: str | None = None) -> DataFrame:
    """route(), with romanized sources sent to google and their language detected there; adds resolved_src."""
    out = route(df, default, requested).withColumn("_z", romanized("backend", "src", "tgt", "text"))
    return out.withColumns({"backend": F.when(F.col("_z"), "google").otherwise(F.col("backend")), "resolved_src": F.when(F.col("_z"), "auto").otherwise(F.col("src"))}).drop("_z")


def model_code(lang: Column | str) -> Column:
    """A language's code in the multilingual models; fails for an unknown language."""
    code = lookup(col(lang), MODEL_CODES)
    return F.when(code.isNotNull(), code).otherwise(F.raise_error(F.concat(F.lit("unknown language code "), F.coalesce(col(lang), F.lit("null")))))


def speech_name(lang: Column | str) -> Column:
    return F.coalesce(lookup(F.lower(col(lang)), SPEECH_NAMES), F.lit("auto"))


def video_category(seconds: Column | str) -> Column:
    s = col(seconds)
    return F.when(s <= 60, "short").when(s <= 300, "medium").when(s <= 600, "long").otherwise("very_long")


def tier(gb: Column | str) -> Column:
    """The memory tier of so many GB; null: no accelerator."""
    g = col(gb)
    return F.when(g.isNull(), "cpu").when(g <= 7, "low").when(g <= 14, "mid").otherwise("high")


def strategy(df: DataFrame, seconds: str = "duration", gb: str = "gb", force_cpu: bool = False) -> DataFrame:
    """Adds category, tier, chunk_seconds and use_cpu."""
    rows = [(t, c, chunks[i], {"long": long, "very_long": very}.get(c, False)) for t, (long, very, chunks, _) in TIERS.items() for i, c in enumerate(CATEGORIES)]
    policy = df.sparkSession.createDataFrame(rows, "tier string, category string, chunk_seconds double, use_cpu boolean")
    out = df.withColumns({"category": video_category(seconds), "tier": tier(gb)}).join(F.broadcast(policy), ["tier", "category"], "left")
    return out.withColumn("use_cpu", F.lit(force_cpu) | F.col("use_cpu"))


def memory_plan(df: DataFrame, gb: str = "gb", fraction: float | None = None) -> DataFrame:
    """Adds memory_fraction by size and tier, and budget, warn and critical thresholds in GB."""
    g = F.col(gb)
    usual = F.when(g <= 7, 0.80).when(g <= 14, 0.86).when(g <= 32, 0.90).otherwise(0.92) if not fraction else F.lit(fraction)
    most = F.when(g <= 7, 0.84).when(g <= 14, 0.90).otherwise(0.94)
    out = df.withColumn("memory_fraction", F.greatest(F.lit(0.5), F.least(F.lit(0.95), usual, most)))
    out = out.withColumn("budget", F.greatest(F.lit(1.0), g * F.col("memory_fraction")))
    return out.withColumns({"warn": F.greatest(F.lit(0.8), 0.82 * F.col("budget")), "critical": F.greatest(F.lit(1.0), 0.92 * F.col("budget"))})
