"""Secret scanning over a ledger of content-addressed blobs.

Every text, in whatever version of whatever document, is a blob named by its SHA-256. The ledger is a table of the pairs of blob and rule
version that were scanned before, with their findings. Only one copy of each blob that has no entry for the present rules is read
again and scanned; its entry, with or without findings, goes into the ledger, and findings are joined back from there to all documents that hold the
blob. Scanning uses built-in functions: a pattern's matches and the pieces between them give each match's place in code points.

Defined cases: a null text is an empty blob; a null doc_id stays null; texts of any length are scanned whole; repeated rows all get their row, and of copies any one is
scanned; matches of several kinds at one place all count, in the order of kinds; texts without findings have empty lists; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, few, let, shared_dir, stored

RULES_VERSION = "1"
#: kind: (Java pattern, group that is measured, its least length). The first three are the base, in the order in which kinds are listed.
RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    "pem": (r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 0),
}
BASE = tuple(RULES)[:3]


def matches(text: Column, kind: str) -> Column:
    """start, k (the kind's number), kind, end of the matches that count, left to right."""
    pattern, group, least = RULES[kind]
    number = tuple(RULES).index(kind)
    none = F.array().cast("array<struct<start:int,k:int,kind:string,end:int>>")

    def placed(m: Column) -> Column:
        gaps, measured = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
        pieces = F.zip_with(F.zip_with(gaps, m, lambda g, x: F.struct(F.length(g).alias("gap"), F.length(x).alias("n"))), measured, lambda a, b: F.struct(a["gap"].alias("gap"), a["n"].alias("n"), F.length(b).alias("size")))
        first = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(a, p):
            start = a["at"] + p["gap"]
            end = start + F.coalesce(p["n"], F.lit(0))
            one = F.array(F.struct(start.alias("start"), F.lit(number).alias("k"), F.lit(kind).alias("kind"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(F.coalesce(p["size"] >= least, F.lit(False)), F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

        return F.aggregate(pieces, first, step)["out"]

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))
    return F.when(text.rlike(pattern), found).otherwise(none)


SPANS = "array<struct<start:int,k:int,kind:string,end:int>>"


def scan(blobs: DataFrame) -> DataFrame:
    """blob_id, spans (array of start, k, kind, end, sorted) for blobs(blob_id, text), one row for each blob_id."""
    found = blobs.select("blob_id", *(matches(F.col("text"), k).alias(k) for k in RULES))
    return found.select("blob_id", F.sort_array(F.concat(*RULES)).alias("spans")).groupBy("blob_id").agg(F.first("spans").alias("spans"))


def addressed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("blob_id"))


class Ledger:
    """The table of entries (blob_id, version, spans) at a path in the shared folder; it comes into being with the first entries."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self, version: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = f"blob_id string, version string, spans {SPANS}"
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.range(0).select(F.lit("").alias("blob_id"), F.lit("").alias("version"), F.array().cast(SPANS).alias("spans"))
        # a version is a folder, so no other is read; two runs at a time may both have scanned a blob
        return self.spark.read.schema(schema).parquet(self.path).filter(F.col("version") == version).dropDuplicates(["blob_id"])

    def append(self, entries: DataFrame) -> None:
        entries.select("blob_id", "version", "spans").write.mode("append").partitionBy("version").parquet(self.path)


#: The session setting that names the folder of a ledger to be kept from run to run.
LEDGER = "spark.tessella.secrets.ledger"


def ledger_of(spark: SparkSession) -> Ledger:
    """The ledger that the session names, to be read and extended, or an empty one for a single run where it names none."""
    return Ledger(spark, at.rstrip("/")) if (at := spark.conf.get(LEDGER, None)) else own_ledger(spark)


def own_ledger(spark: SparkSession) -> Ledger:
    """An empty one for a single run."""
    return Ledger(spark, f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}/secret-ledger-{uuid.uuid4().hex[:12]}")


def unseen(named: DataFrame, known: DataFrame) -> DataFrame:
    """_b, _d: of each blob of named(blob_id, doc_id) that known(blob_id) lacks, an id that it has."""
    return named.groupBy("blob_id").agg(F.min("doc_id").alias("_d")).join(known.select("blob_id"), "blob_id", "left_anti").withColumnRenamed("blob_id", "_b")


def to_scan(named: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of named(blob_id, doc_id, text) that hold fresh(_b, _d), which is stored; texts are shuffled only if these are too many to broadcast."""
    return named.join(few(fresh, 120), (F.col("blob_id") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")


def findings(docs: DataFrame, ledger: Ledger, version: str = RULES_VERSION) -> DataFrame:
    """blob_id, spans of all blobs of docs(doc_id, text) with findings, from the ledger, into which the entries of blobs go that it lacked."""
    named = addressed(docs)
    fresh = stored(unseen(named, ledger.entries(version)), "unseen-blobs")
    if fresh.head(1):
        ledger.append(scan(to_scan(named, fresh)).withColumn("version", F.lit(version)))
    found = ledger.entries(version).filter(F.size("spans") > 0).select("blob_id", "spans")
    return stored(found.join(named.select("blob_id").distinct(), "blob_id", "left_semi"), "secret-findings")


def near(found: DataFrame) -> DataFrame:
    """findings(), marked for broadcast while their bytes are within the bound: copies of a blob then need not meet in one task."""
    size = found.agg(F.sum(F.size("spans") * 48 + 120)).first()[0] or 0
    return F.broadcast(found) if size <= BROADCAST_BYTES else found


def report(docs: DataFrame, ledger: Ledger | None = None, version: str = RULES_VERSION) -> DataFrame:
    """doc_id and spans, an array that is empty where nothing was found, for every row of docs; ledger: by default the one that the session names."""
    found = findings(docs, ledger or ledger_of(docs.sparkSession), version)
    return addressed(docs).select("doc_id", "blob_id").join(near(found), "blob_id", "left").select("doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each maximal run of code points that spans cover replaced by mark."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        kept = F.when(s["start"] >= a["at"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], kept).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, first, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))).otherwise(text)
