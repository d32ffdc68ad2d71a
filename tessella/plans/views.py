"""Views of the driver's tables in the shapes that the operators read, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..sources.spread import spread

#: White space and word characters in DuckDB's regular expressions (fixed values).
WS = r"[\x{09}-\x{0d}\x{1c}-\x{1f} \x{85}\p{Z}]"
WC = r"\p{L}\p{N}_"


def sql_words(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), '{WS}+'), lambda w: w <> '')"


def sql_strip(c: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), '^{WS}+', ''), '{WS}+$', '')"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'))"


def sql_sentences(c: str, ends: str = ".!?।॥") -> str:
    """Sentences, by a sentinel in place of the white space after one of ends."""
    return f"list_filter(list_transform(string_split(regexp_replace(coalesce({c}, ''), '([{ends}]){WS}+', '\\1␟', 'g'), '␟'), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_count(c: str, pattern: str) -> str:
    return f"(length(coalesce({c}, '')) - length(regexp_replace(coalesce({c}, ''), '{pattern}', '', 'g')))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; those of long texts dealt over all cores where they are small."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "conversations") else df


def seg_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as segments: hours since 1970, and a tenth of the value long; every 97th is inverted."""
    e = table(spark, sf_dir, "events")
    a = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / F.lit(3.6e9)
    e = e.select(F.col("user_id").alias("video"), "ts", "event_id", "value", a.alias("a"), (F.col("event_id") % 97 == 0).alias("inv"), F.col("event_type").alias("text"))
    b = F.col("a") + F.col("value") / 10
    idx = F.row_number().over(Window.partitionBy("video").orderBy("ts", "event_id")) - 1
    return e.select("video", idx.alias("seg_idx"), F.when(F.col("inv"), b).otherwise(F.col("a")).alias("start"), F.when(F.col("inv"), F.col("a")).otherwise(b).alias("end"), "text", (F.col("value") > 100).alias("is_suspicious"), (-F.col("value") / 100).alias("avg_logprob"))


SEG_EVENTS = """ev AS (SELECT *, epoch_us(ts) / 3.6e9 AS a FROM events),
seg AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_idx,
  CASE WHEN event_id % 97 = 0 THEN a + value / 10 ELSE a END AS st, CASE WHEN event_id % 97 = 0 THEN a ELSE a + value / 10 END AS en,
  event_type AS text, value > 100 AS is_suspicious, -value / 100 AS avg_logprob FROM ev)"""

#: Seconds a word takes, by role.
PACE = {"user": 0.4, "assistant": 0.4, "system": 0.1}


def seg_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as segments, one after the other, as long as their words take."""
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "video")
    pace = F.when(F.col("role") == "system", PACE["system"]).otherwise(PACE["user"])
    c = c.withColumn("d", word_count("text") * pace)
    start = F.coalesce(F.sum("d").over(Window.partitionBy("video").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return c.withColumn("start", start).select("video", F.col("turn").cast("int").alias("seg_idx"), "start", (F.col("start") + F.col("d")).alias("end"), "text", "role")


SEG_CONV = f"""cv AS (SELECT *, len({sql_words('text')}) * CASE WHEN role = 'system' THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END AS d FROM conversations),
seg AS (SELECT conv_id AS video, turn AS seg_idx, coalesce(sum(d) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st, st + d AS en, text, role FROM cv)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn as reference and source, the assistant's next one as hypothesis."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumns({"next": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return c.filter((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("source"), F.col("text").alias("reference"), F.col("next").alias("hypothesis"))


PAIRS = """pr AS (SELECT * FROM (SELECT conv_id, turn, role, text AS ref, lead(text) OVER w AS hyp, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in scores of documents, by their numbers."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("backend"), F.col("lang").alias("benchmark"), (F.col("doc_id") % 101 / 101).alias("wer"), (F.col("doc_id") * 7 % 103).cast("double").alias("chrf"), (F.col("doc_id") * 13 % 107).cast("double").alias("bleu"))


METRICS = "mt AS (SELECT doc_id, source AS backend, lang AS benchmark, doc_id % 101 / 101 AS wer, (doc_id * 7 % 103)::DOUBLE AS chrf, (doc_id * 13 % 107)::DOUBLE AS bleu FROM documents)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of each language and source in four batches, as entries of a history."""
    m = metrics(spark, sf_dir).withColumn("ts", F.col("doc_id") % 4)
    return m.groupBy("benchmark", "backend", "ts").agg(F.avg("wer").alias("wer_mean"), F.avg("chrf").alias("chrf_mean"), F.avg("bleu").alias("bleu_mean"))


HISTORY = METRICS + ", hs AS (SELECT benchmark, backend, doc_id % 4 AS ts, avg(wer) AS wer_mean, avg(chrf) AS chrf_mean, avg(bleu) AS bleu_mean FROM mt GROUP BY ALL)"
