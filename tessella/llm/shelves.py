"""Texts dealt once to labelled groups of a bounded size, at which later answers reach them without a text moving again.

The rows are written as a table that is bucketed by label, so grouping by label, or cogrouping with answers by label, shuffles only the answers.
Every row has a number of its own, from which its label follows: rows with the same id, or none, stay apart.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, shared_dir

#: Bytes of text in a group and in a bucket of the table, on average. A longer text is alone in what exceeds them.
GROUP, BUCKET = 4 << 20, 32 << 20


def shelved(docs: DataFrame, text: Column) -> tuple[DataFrame, int, int]:
    """label, row, doc_id, text of all docs(doc_id, text), as stored; how many labels there are; the bytes of all texts."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Spark allows so many buckets; beyond them a bucket holds more labels, which a task reads and groups one after the other
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET)), most)
    labels = max(2 * buckets, size // GROUP) | 1  # odd, since numbers of rows begin at multiples of a power of two
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(F.pmod("row", F.lit(labels)).cast("int").alias("label"), "row", "doc_id", "text").repartition(buckets, "label")
    name = f"tessella_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}/{name}"
    rows.write.format("parquet").option("compression", "zstd").option("path", at).bucketBy(buckets, "label").saveAsTable(name)
    release(spark)
    shelf = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog forgets it; the files and the plan that reads them by buckets stay
    return shelf, labels, size


def in_order(table: pa.Table) -> pa.Table:
    """A group's rows in the order of their numbers, which is the same whenever they are read."""
    order = pa.array(np.argsort(table.column("row").to_numpy(), kind="stable"))
    columns = {x: table.column(x).combine_chunks() for x in table.column_names}
    wide = {pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}
    return pa.table({x: c.cast(wide.get(c.type, c.type)).take(order) for x, c in columns.items()})
