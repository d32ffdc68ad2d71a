"""Sharding by extendible hashing.

The directory is indexed by prefix bits of a hash of each document's id. A bucket's bytes are known for every prefix depth from one
aggregation of fine cells; only buckets over the byte limit split on another bit, so a document's shard is the shortest prefix that
fits. Cells are about 64 for each shard, independent of the number of documents behind them. Cells that are still too large go
through another round with more bits, until each holds one document or all bits are used.

Defined cases: a null text has no bytes; a document larger than the limit is a shard alone; documents with the same id, null
included, share all id bits and split on the bits of their text's hash, fully repeated rows on a row number; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LIMIT = 16 << 20
#: Bits of a hash, and the bits by which cells are finer than shards.
BITS, FINER = 60, 6


def bits60(text):
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def prefix(h, depth):
    """The first depth of 60 bits, as a string of 0 and 1."""
    return F.substring(F.lpad(F.bin(h), BITS, "0"), F.lit(1), depth)


def assign(docs: DataFrame, limit: int = LIMIT, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, depth (prefix bits), shard_id (those bits) for docs(doc_id, text); carry: and doc, a struct of all columns."""
    # The bits after those of the id part documents with the same id; they come into play where those are used up.
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), bits60(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), bits60(F.coalesce("text", F.lit(""))).alias("h2"), F.monotonically_increasing_id().alias("row"), *([F.struct("*").alias("doc")] if carry else []))
    rows = stored(rows, "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    parts, base, todo = [], 0, rows.withColumns({"key": F.lit("")})
    hashes = [F.col("h"), F.col("h2"), bits60(F.col("row").cast("string"))]
    deep = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + FINER)
    while True:
        which, used = divmod(base, BITS)
        deep = min(deep, BITS - used)
        cells = todo.withColumn("cell", F.concat("key", F.substring(F.lpad(F.bin(hashes[which]), BITS, "0"), used + 1, deep)))
        sums = cells.groupBy("cell").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        over = (
            sums.select("cell", "b", "n", F.explode(F.sequence(F.lit(base), F.lit(base + deep))).alias("d"))
            .groupBy("d", F.expr("substring(cell, 1, d)").alias("p"))
            .agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
            .filter((F.col("b") > limit) & (F.col("n") > 1))
        )
        over = stored(over, "shard-over")
        depth = sums.select("cell", F.explode(F.sequence(F.lit(base), F.lit(base + deep))).alias("d")).join(over.select(F.col("p").alias("q"), F.col("d").alias("e")), F.expr("d = e and substring(cell, 1, d) = q")).groupBy("cell").agg((F.max("d") + 1).alias("depth"))
        placed = cells.join(depth, "cell", "left").withColumn("depth", F.coalesce("depth", F.lit(base)))
        parts.append(placed.filter(F.col("depth") <= base + deep).select("doc_id", "n_bytes", "depth", F.expr("substring(cell, 1, depth)").alias("shard_id"), *(["doc"] if carry else [])))
        base += deep
        if base >= len(hashes) * BITS or not over.filter(F.col("d") == base).head(1):
            break
        todo = stored(placed.filter(F.col("depth") > base).select(*rows.columns, F.col("cell").alias("key")), "shard-todo")
        deep = 16
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes docs with a folder for each shard; a shard's rows pass through one task, which its byte limit bounds."""
    assign(docs, limit, carry=True).select("shard_id", "doc").repartition("shard_id").select("shard_id", "doc.*").write.partitionBy("shard_id").parquet(path)
