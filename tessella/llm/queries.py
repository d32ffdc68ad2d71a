"""The corpus operators as queries over whole tables: digests of what the operators return, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from ..sources.spread import spread
from . import oracles


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixes

    return suffixes.dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: host, path, verdict of the listed entries (fixed values).
LISTED = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    listed = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, LISTED))} AS listed(host, path, verdict)")
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed)


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
b AS (
  SELECT page_id, host, path, h || p AS rule, v AS verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM b WHERE k = 1
"""


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
g AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS gone FROM x),
p AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM g WHERE gone) GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r, list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM w LEFT JOIN p ON w.doc_id = p.doc_id)
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bw) AS l WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN t ON w.doc_id = t.doc_id
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.assign(documents(spark, sf_dir))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         right(repeat('0', 60) || bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60) AS bits
  FROM documents),
t AS (SELECT k, substr(bits, 1, k) AS p FROM d, range(0, 60) AS r(k) GROUP BY ALL HAVING sum(n_bytes) > 16777216 AND count(*) > 1),
x AS (SELECT doc_id, n_bytes, bits, (SELECT coalesce(max(k) + 1, 0) FROM t WHERE p = substr(bits, 1, k)) AS depth FROM d)
SELECT doc_id, n_bytes, depth::INTEGER AS depth, substr(bits, 1, depth::INTEGER) AS shard_id FROM x
"""


def op8_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram

    return ngram.learn_and_score(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    spans = secrets.report(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["k"] < len(secrets.BASE))
    return spans.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(documents(spark, sf_dir)).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spelling

    return spelling.variants(documents(spark, sf_dir))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import resampling

    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_suffixes, op3_url_filter, op4_substrings, op5_decontamination, op6_quality, op7_sharding, op8_ngram, op9_secrets, op10_simhash, op11_jaccard, op12_spelling, op13_resampling)}
ORACLE = {"op11_jaccard": oracles.OP11, "op12_spelling": oracles.OP12, "op13_resampling": oracles.OP13, "op2_suffixes": oracles.OP2, "op6_quality": oracles.OP6, "op9_secrets": oracles.OP9, "op3_url_filter": OP3_SQL, "op4_substrings": OP4_SQL, "op5_decontamination": OP5_SQL, "op7_sharding": OP7_SQL}
