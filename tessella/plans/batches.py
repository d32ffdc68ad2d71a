"""Translation of whole batches: many texts in a request, and replies brought back to their texts.

A batch is locked, routed by all its text, packed into requests and sent in waves, each stored: requests of joined texts; of those whose reply doesn't come apart into as
many texts, and of all others, the texts themselves; and what failed there, by the fallback backend. What goes to one group is a request of at most a few kilobytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import validators
from ..functions.text import strip
from ..operators import chunking, glossary, requests, routing
from ..sources.staged import few_or_sorted, sorted_in, stored
from .backends import translated

#: Characters of a text that goes alone, beyond which it goes in pieces.
PIECE = 3000
LATIN, INDIC = "[A-Za-z]", r"[ऀ-ॿ]"


def route_batches(locked: DataFrame, src: str, tgt: str, requested: str | None = None) -> DataFrame:
    """batch, backend, resolved_src for locked(batch, locked_text): a batch goes where its texts, joined, would go. Letters are counted text by text."""
    shares = [F.sum(F.regexp_count("locked_text", F.lit(p))).alias(n) for n, p in (("latin", LATIN), ("deva", INDIC))]
    every = F.sum(F.length("locked_text") - F.length(F.regexp_replace("locked_text", r"[A-Za-zऀ-ॿঀ-৿઀-૿஀-௿ಀ-೿ഀ-ൿ]", ""))).alias("letters")
    each = routing.route(locked.groupBy("batch").agg(*shares, every).withColumns({"src": F.lit(src), "tgt": F.lit(tgt)}), requested=requested)
    share = lambda c: F.col(c) / F.greatest(F.col("letters"), F.lit(1))
    roman = F.col("backend").isin("nllb", "indictrans2") & F.col("src").isin("hi", "mr") & (F.col("tgt") == "en") & (share("latin") >= 0.55) & (share("deva") <= 0.15)
    return each.select("batch", F.when(roman, "google").otherwise(F.col("backend")).alias("backend"), F.when(roman, "auto").otherwise(F.col("src")).alias("src"))


def asked(rows: DataFrame, tgt: str, factories: dict) -> DataFrame:
    """rows(batch, item, backend, src, locked) with hypothesis and error: each text by itself, long ones in pieces that are joined again."""
    parts = F.when(F.length("locked") > PIECE, chunking.chunked("locked", chunking.by_sentences, limit=PIECE)).otherwise(F.array("locked"))
    each = translated(rows.select("batch", "item", "backend", "src", F.lit(tgt).alias("tgt"), F.posexplode(parts).alias("i", "text")), factories, errors="error")
    got = each.groupBy("batch", "item").agg(F.sort_array(F.collect_list(F.struct("i", "hypothesis"))).alias("l"), F.count_if(F.col("hypothesis").isNull()).alias("lost"), F.first("error", ignorenulls=True).alias("error"))
    whole = strip(F.array_join(F.transform("l", lambda x: x["hypothesis"]), " "))
    got = got.select(F.col("batch").alias("_b"), F.col("item").alias("_i"), F.when(F.col("lost") == 0, whole).alias("hypothesis"), "error")
    return rows.join(sorted_in(got), F.col("batch").eqNullSafe(F.col("_b")) & F.col("item").eqNullSafe(F.col("_i"))).drop("_b", "_i")


def translate_batches(df: DataFrame, src: str, tgt: str, terms: list, factories: dict, requested: str | None = None, fallback: str = "google", joining: tuple[str, ...] = ("google",), **budgets) -> DataFrame:
    """batch, item, text, translation, level, backend, error, passed, score, reason for every row of df(batch, item, text).

    factories: by the name of the backend that a batch is routed to, None for others. Backends in joining take several texts in a request. level: blank, joined,
    each, fallback; failed if nothing came back, with the first error. A translation is checked but not held back. Items of a batch are unique; further columns are left out."""
    rows = df.select("batch", "item", "text", requests.sendable("text").alias("clean"))
    locked = stored(glossary.lock(rows.filter("clean <> ''"), "clean", terms), "locked-batches")
    routed = stored(route_batches(locked, src, tgt, requested), "routed")
    rows_of = locked.select("batch", "item", "text", F.col("locked_text").alias("locked"), "placeholders").join(few_or_sorted(routed.withColumnRenamed("batch", "_b"), 64), F.col("batch").eqNullSafe(F.col("_b"))).drop("_b")
    groups = requests.pack_requests(locked.select("batch", "item", F.col("locked_text").alias("text")), **budgets).filter("group_id IS NOT NULL").select(F.col("batch").alias("_b"), F.col("item").alias("_i"), "group_id")
    rows_of = stored(rows_of.join(sorted_in(groups), F.col("batch").eqNullSafe(F.col("_b")) & F.col("item").eqNullSafe(F.col("_i")), "left").drop("_b", "_i"), "requests")

    # joined requests; a reply that has another number of parts, or none, leaves its texts to the next wave
    group = rows_of.filter(F.col("group_id").isNotNull() & F.col("backend").isin(*joining)).groupBy("batch", "group_id", "backend", "src").agg(F.sort_array(F.collect_list(F.struct("item", "locked"))).alias("l")).filter(F.size("l") > 1)
    payload = group.select("batch", F.col("l.item").alias("items"), "backend", "src", F.lit(tgt).alias("tgt"), F.array_join(F.transform("l", lambda x: x["locked"]), requests.DELIMITER).alias("text"))
    reply = translated(payload, factories, errors="error").withColumn("parts", F.split("hypothesis", requests.MARK))
    back = reply.filter(F.size("parts") == F.size("items")).select(F.col("batch").alias("_b"), F.inline(F.arrays_zip(F.col("items").alias("_i"), F.col("parts").alias("_p"))))
    first = sorted_in(stored(back.select("_b", "_i", strip("_p").alias("_p")), "joined-replies"))
    at = F.col("batch").eqNullSafe(F.col("_b")) & F.col("item").eqNullSafe(F.col("_i"))
    done = rows_of.join(first, at).select(*rows_of.columns, F.col("_p").alias("hypothesis"), F.lit(None).cast("string").alias("error"), F.lit("joined").alias("level"))
    each = stored(asked(rows_of.join(first, at, "left_anti"), tgt, factories), "each-reply")
    done = done.unionByName(each.filter("hypothesis IS NOT NULL").withColumn("level", F.lit("each")))
    lost = each.filter("hypothesis IS NULL")
    other = F.col("backend") != fallback
    again = stored(asked(lost.filter(other).withColumn("backend", F.lit(fallback)).withColumnRenamed("error", "_e").drop("hypothesis"), tgt, factories), "fallback-reply")
    again = again.select(*rows_of.columns, "hypothesis", F.coalesce("_e", "error").alias("error"), F.when(F.col("hypothesis").isNull(), "failed").otherwise("fallback").alias("level"))
    done = done.unionByName(again).unionByName(lost.filter(~other).withColumn("level", F.lit("failed")))
    done = done.withColumn("translation", F.when(F.col("hypothesis").isNotNull(), glossary.restore("hypothesis", "placeholders", F.lit(tgt), terms)))
    ratio = validators.copy_ratio("text", "translation", "src", F.lit(tgt))
    done = done.withColumn("_r", ratio).withColumn("_v", validators.validate_translation("text", "translation", F.col("src"), F.lit(tgt), False, F.col("_r")))
    keep = ["batch", "item", "text", "translation", "level", "backend", "error"]
    blank = rows.filter("clean = ''").select("batch", "item", "text", F.lit("").alias("translation"), F.lit("blank").alias("level"), *(F.lit(None).cast(t).alias(c) for c, t in (("backend", "string"), ("error", "string"), ("passed", "boolean"), ("score", "double"), ("reason", "string"))))
    return done.select(*keep, "_v.passed", "_v.score", "_v.reason").unionByName(blank)
