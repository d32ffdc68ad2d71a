"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of documents. A
stage finds rows again by id and a hash of the row, so documents with the same id are judged apart; it drops or changes only what its
operator decided on, in a join whose smaller side is the few decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, packing, quality, secrets, shingles
from tessella.llm.common import few, stored
from tessella.ship import ship
from tessella.sources.spread import spread


def apart(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that docs has no column of."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def without(docs: DataFrame, rows: DataFrame, **keys: Column) -> DataFrame:
    """docs without the rows for which keys, by name expressions of docs' columns, are in rows; nulls are equal. Texts are not shuffled while the keys are few enough to broadcast."""
    on, held = F.lit(True), apart(docs, *keys)
    rows = few(stored(rows.select(*(F.col(k).alias(h) for k, h in zip(keys, held))).distinct(), "dropped"), 24 * len(keys))
    for h, value in zip(held, keys.values()):
        on &= value.eqNullSafe(F.col(h))
    return docs.join(rows, on, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base or the adaptive thresholds reject.

    Null, empty and short texts go, as the base has it; texts of any length are judged whole; a null language or source is a group of its own; repeated rows
    stay or go together; an empty table stays empty; further columns stay, whatever their names."""
    version = F.xxhash64("text", "lang", "source")
    judged = quality.judge(docs.select("doc_id", "text", "lang", "source", version.alias("version")), keep=("doc_id", "lang", "source", "version"))
    return without(docs, judged.filter(~F.col("kept")), doc_id=F.col("doc_id"), version=version)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (0.8 of five-word shingles) the document with the smallest id; of rows with that id, one.

    Null and blank texts are one group; texts of any length are compared whole; a null id is larger than any, and of equal ids the smallest hash of
    the text stays; of rows repeated as they are one stays; an empty table stays empty; further columns stay, whatever their names."""
    ship(spark)
    groups = stored(shingles.near_copies(docs), "near-duplicates")
    # only groups of several rows decide anything, so a large group's rows need not meet in one task while these groups are few
    several = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "v")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    told = groups.join(few(stored(several, "groups"), 64), "root", "left")
    told = told.withColumn("stays", F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("v").eqNullSafe(F.col("first.v"))))
    keys = {"doc_id": F.col("doc_id"), "v": F.xxhash64("text")}
    kept = without(docs, told.filter(~F.col("stays")), **keys)
    twice = stored(told.filter("stays").groupBy("doc_id", "v").count().filter("count > 1").select("doc_id", "v"), "repeated-rows")
    if twice.head(1):  # rows that are repeated as they are
        key, version = apart(docs, "key", "version")
        marked = kept.withColumns({key: F.col("doc_id"), version: F.xxhash64("text")})
        on = [F.col(key).eqNullSafe(F.col("doc_id")) & (F.col(version) == F.col("v"))]
        once = marked.select(key, version, F.struct(*docs.columns).alias("d")).join(few(twice, 16), on, "left_semi").groupBy(key, version).agg(F.min_by("d", F.xxhash64("d")).alias("d")).select("d.*")
        kept = without(kept, twice, **keys).unionByName(once)
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten words in a row, or a whole shorter item, with the benchmark.

    Null and empty texts stay; texts of any length are searched whole; repeated rows stay or go together; an empty table stays empty, and an empty benchmark drops
    nothing; further columns stay, whatever their names."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found, doc_id=F.col("doc_id"), v=F.xxhash64("text"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each run of found characters by a mark, and n_chars by the new length. Texts that the session's ledger knows are not scanned again.

    Null and empty texts stay as they are; texts of any length are scanned whole; spans that overlap make one mark; repeated rows change alike; an
    empty table stays empty; further columns stay, whatever their names."""
    blob, spans = apart(docs, "blob", "spans")
    found = secrets.near(secrets.findings(docs, secrets.ledger_of(spark))).withColumnsRenamed({"blob_id": blob, "spans": spans})
    named = docs.join(found, F.sha2(F.coalesce("text", F.lit("")), 256) == F.col(blob), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), F.col(spans)))
    length = lambda c: F.when(F.col(spans).isNull(), F.col(c)).otherwise(F.length(text)).cast(docs.schema[c].dataType)
    return named.select(*({"text": text, "n_chars": length("n_chars") if "n_chars" in docs.columns else None}.get(c, F.col(c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row for each piece of a document; a null text is its end id alone, and an empty table gives no rows."""
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", pack),
]
#: Near-duplicate groups and tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
