"""The operators as queries over the driver's tables, with the SQL that DuckDB answers alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import validators as V
from ..functions.text import W
from ..functions.metrics import scored
from ..functions.scripts import BLOCKS, MODEL_CODES, ROUTES, SCRIPTS, SPEECH_NAMES
from ..operators import audio, chunking, evaluation, glossary, requests, routing, terms, timeline
from ..ship import ship
from ..sources import files
from ..sources.staged import shared_dir, stored
from ..streaming import streams
from . import batches, flows, recognition, runs, synthesis
from .backends import Brittle, Identity, Marked
from .views import HISTORY, METRICS, PAIRS, SEG_CONV, SEG_EVENTS, WC, WS, history, metrics, pairs, seg_conv, seg_events, sql_count, sql_sentences, sql_squeeze, sql_strip, sql_words, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# validators

_script_chars = "CASE lang " + " ".join(f"WHEN '{k}' THEN {sql_count('text', v[1])}" for k, v in SCRIPTS.items()) + " END"
_script_least = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v[2]}::DOUBLE" for k, v in SCRIPTS.items()) + " END"
_letters = sql_count("text", r"\p{L}")
SCRIPT_SQL = f"""sc AS (SELECT doc_id, lang, m, {_letters} AS letters, CASE WHEN letters > 0 THEN c / letters END AS r FROM (SELECT *, {_script_chars} AS c, {_script_least} AS m FROM documents)),
scv AS (SELECT doc_id, lang, CASE WHEN m IS NULL THEN true WHEN letters = 0 THEN false ELSE r >= m * 0.8::DOUBLE END AS valid,
  CASE WHEN m IS NULL THEN 1.0 WHEN letters = 0 THEN 0.0 WHEN r < m THEN least(1.0, r / m) ELSE 1.0 END::DOUBLE AS score,
  CASE WHEN m IS NULL THEN 'unknown_language' WHEN letters = 0 THEN 'no_letters' WHEN r < m * 0.5::DOUBLE THEN 'mismatch' WHEN r >= m * 0.8::DOUBLE THEN 'ok' ELSE 'weak' END AS code FROM sc)"""


@query(f"WITH {SCRIPT_SQL} SELECT doc_id, lang, valid, round(score, 6) AS score, code FROM scv")
def q_script_validation(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "lang", V.script("text", "lang").alias("s")).select("doc_id", "lang", "s.valid", r6("s.score").alias("score"), "s.code")


GARBAGE_SQL = f"gb AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN {sql_count('text', '[^' + WC + WS[1:-1] + BLOCKS + '.,!?;:' + chr(39) * 2 + chr(34) + '-]')} / length(text) ELSE 0 END AS ratio FROM documents)"


@query(f"WITH {GARBAGE_SQL} SELECT doc_id, round(ratio, 6) AS ratio, ratio <= 0.2::DOUBLE AS valid, round(greatest(0, 1 - ratio / 0.2::DOUBLE), 6) AS score FROM gb")
def q_garbage_ratio(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", V.garbage_ratio("text").alias("r"), V.garbage("text").alias("g"))
    return d.select("doc_id", r6("r").alias("ratio"), "g.valid", r6("g.score").alias("score"))


_parts = f"list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?।॥]+'), lambda s: {sql_strip('s')}), lambda s: s <> '')"
COHERENCE_SQL = f"""co AS (SELECT doc_id, len({sql_words('text')}) AS nw, list_transform({_parts}, lambda s: len({sql_words('s')})) AS n FROM documents),
cov AS (SELECT doc_id, len(n) AS sentences, CASE WHEN len(n) = 0 THEN 0.0 WHEN list_avg(n) < 2 THEN 0.2 WHEN list_avg(n) > 50 THEN 0.3 WHEN nw < 3 THEN 0.1 ELSE len(list_filter(n, lambda x: x BETWEEN 3 AND 30)) / len(n) END::DOUBLE AS score,
  len(n) > 0 AND list_avg(n) BETWEEN 2 AND 50 AND nw >= 3 AND score >= 0.3::DOUBLE AS valid FROM co)"""


@query(f"WITH {COHERENCE_SQL} SELECT doc_id, valid, round(score, 6) AS score FROM cov")
def q_semantic_coherence(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", V.coherence("text").alias("c")).select("doc_id", "c.valid", r6("c.score").alias("score"))


DIVERSITY_SQL = f"dv AS (SELECT doc_id, {sql_words('text')} AS w, CASE WHEN len(w) < 5 THEN 1.0 ELSE len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) END::DOUBLE AS diversity FROM documents)"


@query(f"WITH {DIVERSITY_SQL} SELECT doc_id, round(diversity, 6) AS diversity FROM dv")
def q_word_diversity(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(evaluation.diversity("text")).alias("diversity"))


@query(f"""WITH w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
p AS (SELECT doc_id, n, i, lower(array_to_string(list_slice(w, i, i + n - 1), ' ')) AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (2), (3), (4), (5)) AS v(n) WHERE len(w) >= 2 * n)),
c AS (SELECT doc_id, n, p, count(*) AS c, min(i) AS f FROM p GROUP BY ALL HAVING count(*) >= 3),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, c DESC, f) AS k FROM c)
SELECT w.doc_id, b.p AS phrase, b.c AS times FROM w LEFT JOIN b ON w.doc_id = b.doc_id AND k = 1""")
def q_phrase_loops(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", V.repeated_phrase(T.words("text")).alias("p"))
    return d.select("doc_id", F.col("p.item").alias("phrase"), F.col("p.n").cast("long").alias("times"))


_tail = f"regexp_extract(l[i], '[{WC}]+$')"

def loops_sql(rel: str, key: str) -> str:
    """Loops of the texts in rel, by key: single characters, words that follow each other, and phrases."""
    return f"""lw AS (SELECT {key}, {sql_words('text')} AS w, list_transform(w, lambda x: lower(x)) AS l, string_split(lower(coalesce(text, '')), '') AS c FROM {rel}),
lf AS (SELECT {key}, w, l, len(list_filter(range(1, len(c) - 3), lambda i: c[i] <> chr(10) AND c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] = c[i + 3] AND c[i] = c[i + 4])) > 0 AS char_loop,
  len(list_filter(range(1, len(l) - 1), lambda i: {_tail} <> '' AND l[i + 1] = {_tail} AND starts_with(l[i + 2], {_tail}))) > 0 AS word_loop FROM lw),
lp AS (SELECT DISTINCT {key}, true AS phrase FROM (SELECT {key}, p FROM (SELECT {key}, n, array_to_string(list_slice(l, i, i + n - 1), ' ') AS p FROM (SELECT {key}, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM lf, (VALUES (2), (3), (4), (5)) AS v(n) WHERE len(l) >= 2 * n)) GROUP BY ALL HAVING count(*) >= 3)),
lo AS (SELECT lf.*, CASE WHEN len(w) < 4 THEN 'short' WHEN char_loop THEN 'char_loop' WHEN word_loop THEN 'word_loop' WHEN phrase THEN 'phrase_loop' ELSE 'ok' END AS loop, loop IN ('short', 'ok') AS loop_valid,
  CASE loop WHEN 'short' THEN 1 WHEN 'phrase_loop' THEN 0.1 WHEN 'ok' THEN len(list_distinct(l)) / len(w) ELSE 0 END::DOUBLE AS loop_score FROM lf LEFT JOIN lp USING ({key}))"""


@query(f"WITH {loops_sql('documents', 'doc_id')} SELECT doc_id, char_loop, word_loop, loop_valid AS valid, round(loop_score, 6) AS score, loop AS code FROM lo")
def q_loop_detection(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", V.char_loop("text").alias("char_loop"), V.word_loop("text").alias("word_loop"), V.loops("text").alias("l"))
    return d.select("doc_id", "char_loop", "word_loop", "l.valid", r6("l.score").alias("score"), "l.code")


@query()
def q_asr_gate(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", V.gate("text", "lang", F.lit("en"), F.lit(0.7)).alias("reason"), r6(T.repetition_score("text")).alias("repetition"))


@query(f"""WITH {SCRIPT_SQL}, {GARBAGE_SQL}, {loops_sql('documents', 'doc_id')},
a AS (SELECT doc_id, length({sql_strip('text')}) < 3 AS little, doc_id % 10 / 10 AS conf, conf > 0 AND conf < 0.5::DOUBLE AS low, d.lang IS NOT NULL AND d.lang NOT IN ('', 'auto') AS asked, loop, loop_valid, loop_score, ratio, ratio <= 0.2::DOUBLE AS clean, scv.valid, scv.score, scv.code
  FROM documents d JOIN lo USING (doc_id) JOIN gb USING (doc_id) JOIN scv USING (doc_id)),
b AS (SELECT *, concat_ws('; ', CASE WHEN NOT loop_valid THEN loop END, CASE WHEN NOT clean THEN 'garbage' END, CASE WHEN low THEN 'low_confidence' END, CASE WHEN asked AND NOT valid THEN code END) AS reason,
  (loop_score + greatest(0, 1 - ratio / 0.2::DOUBLE) + CASE WHEN low THEN conf ELSE 0 END + CASE WHEN asked THEN score ELSE 0 END) / (2 + low::INT + asked::INT) AS mean FROM a)
SELECT doc_id, NOT little AND reason = '' AS passed, round(CASE WHEN little THEN 0 ELSE mean END, 6) AS score, CASE WHEN little THEN 'too_short' ELSE reason END AS reason FROM b""")
def q_asr_validation(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", V.validate_transcript("text", "lang", F.col("doc_id") % 10 / 10).alias("v"))
    return d.select("doc_id", "v.passed", r6("v.score").alias("score"), "v.reason")


@query(f"SELECT doc_id, contains(lower(coalesce(text, '')), 'protty') OR len(list_distinct({sql_words('text')})) < 0.3::DOUBLE * len({sql_words('text')}) AS warning FROM documents")
def q_repetition_warning(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", V.repetition_warning("text").alias("warning"))


_garbage = f"CASE WHEN length(text) > 0 THEN {sql_count('text', '[^' + WC + WS[1:-1] + BLOCKS + '.,!?;:' + chr(39) * 2 + chr(34) + '-]')} / length(text) ELSE 0 END"


@query(f"""WITH {SEG_CONV}, {loops_sql('seg', 'video, seg_idx')},
a AS (SELECT video, seg_idx, en - st AS n, text, w, l, loop, loop_valid, loop_score, {_garbage} AS ratio FROM seg JOIN lo USING (video, seg_idx)),
b AS (SELECT *, length({sql_strip('text')}) < 3 AS little, (n > 2 AND len(w) / n < 0.3::DOUBLE) OR contains(text, '♪') OR contains(text, '♫') OR list_has_any(string_split_regex(lower(coalesce(text, '')), '[^{WC}]+'), ['music', 'instrumental', 'bgm', 'background'])
  OR len(list_filter(range(1, len(l) - 1), lambda i: regexp_full_match(l[i + 1], '[{WC}]+') AND ends_with(l[i], l[i + 1]) AND starts_with(l[i + 2], l[i + 1]))) > 0 AS music FROM a),
c AS (SELECT *, CASE WHEN n < 0.5::DOUBLE THEN 'short' WHEN n > 15 THEN 'long' WHEN music THEN 'suspicious' WHEN little THEN 'too_short' END AS early, concat_ws('; ', CASE WHEN NOT loop_valid THEN loop END, CASE WHEN ratio > 0.2::DOUBLE THEN 'garbage' END) AS reason FROM b)
SELECT video, seg_idx::INTEGER AS seg_idx, early IS NULL AND reason = '' AS passed, round(CASE WHEN early IS NULL THEN (loop_score + greatest(0, 1 - ratio / 0.2::DOUBLE)) / 2 ELSE 0 END, 6) AS score, coalesce(early, reason) AS reason FROM c""")
def q_segment_quality(spark, sf_dir):
    s = seg_conv(spark, sf_dir)
    return s.select("video", "seg_idx", V.validate_segment("text", "start", "end", timeline.is_music("text", F.col("end") - F.col("start"))).alias("v")).select("video", "seg_idx", "v.passed", r6("v.score").alias("score"), "v.reason")


@query(f"""WITH {SCRIPT_SQL}, {GARBAGE_SQL}, {COHERENCE_SQL}, {DIVERSITY_SQL}
SELECT scv.lang, count(*) AS documents, count(*) FILTER (scv.valid) AS script_valid, count(*) FILTER (cov.valid) AS coherent, count(*) FILTER (ratio <= 0.2::DOUBLE) AS clean,
  count(*) FILTER (scv.valid AND cov.valid AND ratio <= 0.2::DOUBLE) AS passed, count(*) FILTER (scv.valid AND cov.valid AND ratio <= 0.2::DOUBLE AND quality = 1) AS passed_good, count(quality) AS labelled,
  round(avg(scv.score), 6) AS script_score, round(avg(cov.score), 6) AS coherence_score, round(avg(ratio), 6) AS garbage, round(avg(diversity), 6) AS diversity
FROM scv JOIN gb USING (doc_id) JOIN cov USING (doc_id) JOIN dv USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY scv.lang""")
def q_validation_summary(spark, sf_dir):
    """The flagship: one scan of documents checks every text; labels are joined to narrow rows, and groups are summed before the shuffle."""
    d = docs(spark, sf_dir).select("doc_id", "lang", V.script("text", "lang").alias("s"), V.coherence("text").alias("c"), V.garbage_ratio("text").alias("g"), evaluation.diversity("text").alias("d"))
    d = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    clean = F.col("g") <= 0.2
    passed = F.col("s.valid") & F.col("c.valid") & clean
    return d.groupBy("lang").agg(
        F.count("*").alias("documents"), F.count_if("s.valid").alias("script_valid"), F.count_if("c.valid").alias("coherent"), F.count_if(clean).alias("clean"), F.count_if(passed).alias("passed"),
        F.count_if(passed & (F.col("quality") == 1)).alias("passed_good"), F.count("quality").alias("labelled"),
        r6(F.avg("s.score")).alias("script_score"), r6(F.avg("c.score")).alias("coherence_score"), r6(F.avg("g")).alias("garbage"), r6(F.avg("d")).alias("diversity"),
    )


@query()
def q_near_copy(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("ratio", V.matching_ratio(V.plain("source"), V.plain("hypothesis")))
    p = p.select("conv_id", "turn", r6("ratio").alias("ratio"), V.near_copy("source", "hypothesis", F.lit("en"), F.lit("hi"), F.col("ratio")).alias("c"))
    return p.select("conv_id", "turn", "ratio", "c.valid", r6("c.score").alias("score"), "c.code")


@query()
def q_translation_validation(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("ratio", V.matching_ratio(V.plain("source"), V.plain("hypothesis")))
    p = p.select("conv_id", "turn", V.validate_translation("source", "hypothesis", F.lit("fr"), F.lit("en"), ratio=F.col("ratio")).alias("v"))
    return p.select("conv_id", "turn", "v.passed", r6("v.score").alias("score"), "v.reason")


# timeline

FIX_SQL = f"""f1 AS (SELECT *, least(st, en) AS a, greatest(st, en) AS b, len({sql_words('text')}) AS w FROM seg),
f2 AS (SELECT *, CASE WHEN b - a < 0.5::DOUBLE THEN greatest(0.5::DOUBLE, w / 8) ELSE b - a END AS d, CASE WHEN b - a < 0.5::DOUBLE THEN a + greatest(0.5::DOUBLE, w / 8) ELSE b END AS e FROM f1),
fx AS (SELECT * EXCLUDE (st, en), CASE WHEN d > 0 THEN w / d ELSE 0 END AS wps, a AS st, CASE WHEN wps > 8 THEN a + w / 4 ELSE e END AS en FROM f2)"""


@query(f"WITH {SEG_EVENTS}, {FIX_SQL} SELECT video, seg_idx::INTEGER AS seg_idx, round(st, 6) AS start, round(en, 6) AS \"end\", round(en - st, 6) AS duration, round(wps, 6) AS words_per_second FROM fx")
def q_segment_fix(spark, sf_dir):
    f = timeline.fix_timestamps(seg_events(spark, sf_dir), compat=True)
    return f.select("video", "seg_idx", *(r6(c).alias(c) for c in ("start", "end", "duration", "words_per_second")))


@query(f"WITH {SEG_CONV}, {FIX_SQL} SELECT video, seg_idx::INTEGER AS seg_idx, round(en, 6) AS \"end\", round(wps, 6) AS words_per_second FROM fx")
def q_speech_rate(spark, sf_dir):
    return timeline.fix_timestamps(seg_conv(spark, sf_dir)).select("video", "seg_idx", r6("end").alias("end"), r6("words_per_second").alias("words_per_second"))


@query(f"WITH {SEG_EVENTS}, {FIX_SQL} SELECT video, count(*) FILTER (gap > 3) AS large_gaps, round(sum(gap) FILTER (gap > 3), 4) AS seconds FROM (SELECT video, st - lag(en) OVER (PARTITION BY video ORDER BY seg_idx) AS gap FROM fx) GROUP BY video")
def q_gaps(spark, sf_dir):
    g = timeline.gaps(timeline.fix_timestamps(seg_events(spark, sf_dir), compat=True))
    return g.groupBy("video").agg(F.count_if("large_gap").alias("large_gaps"), F.round(F.sum(F.when(F.col("large_gap"), F.col("gap"))), 4).alias("seconds"))


@query(f"""WITH {SEG_EVENTS}, {FIX_SQL}, g AS (SELECT video, seg_idx, st, lag(en) OVER (PARTITION BY video ORDER BY seg_idx) AS pe FROM fx),
h AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY seg_idx) AS k FROM g WHERE st - pe BETWEEN 2.5 AND 15)
SELECT video, seg_idx::INTEGER AS seg_idx, k::INTEGER AS gap_no, round(greatest(0, pe + 0.05::DOUBLE), 6) AS clip_start, round(greatest(greatest(0, pe + 0.05::DOUBLE) + 0.10::DOUBLE, st - 0.05::DOUBLE), 6) AS clip_end FROM h WHERE k <= 6""")
def q_gap_candidates(spark, sf_dir):
    g = timeline.refinable_gaps(timeline.fix_timestamps(seg_events(spark, sf_dir), compat=True))
    return g.select("video", "seg_idx", "gap_no", r6("clip_start").alias("clip_start"), r6("clip_end").alias("clip_end"))


@query(f"""WITH {SEG_CONV}, p AS (SELECT *, {sql_strip('text')} AS t, {sql_sentences(sql_strip('text'), '.!?।')} AS s, {sql_words('text')} AS w FROM seg),
q AS (SELECT *, CASE WHEN en - st <= 15 OR t = '' THEN [text] WHEN len(s) >= 2 THEN s WHEN len(w) >= 8 THEN [array_to_string(list_slice(w, 1, len(w) // 2), ' '), array_to_string(list_slice(w, len(w) // 2 + 1, len(w)), ' ')] ELSE [t] END AS parts FROM p),
r AS (SELECT *, list_transform(parts, lambda x: greatest(1, length(x))) AS n, unnest(range(1, len(parts) + 1)) AS i FROM q)
SELECT video, seg_idx::INTEGER AS seg_idx, (i - 1)::INTEGER AS part_idx, round(st + (en - st) * coalesce(list_sum(n[1:i - 1]), 0) / list_sum(n), 4) AS start, round(st + (en - st) * list_sum(n[1:i]) / list_sum(n), 4) AS "end", parts[i] AS text FROM r""")
def q_split_long(spark, sf_dir):
    s = timeline.split_overlong(seg_conv(spark, sf_dir))
    return s.select("video", "seg_idx", "part_idx", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "text")


@query(f"""WITH {SEG_EVENTS}, {FIX_SQL} SELECT video, count(*) AS segments, count(*) FILTER (m) AS suspicious, round(avg(m::INT), 6) AS music_ratio, avg(m::INT) > 0.3::DOUBLE AS music_heavy
FROM (SELECT video, en - st > 2 AND w / (en - st) < 0.3::DOUBLE AS m FROM fx) GROUP BY video""")
def q_music_noise(spark, sf_dir):
    m = timeline.music_heavy(timeline.flag_music(timeline.fix_timestamps(seg_events(spark, sf_dir), compat=True)))
    return m.select("video", "segments", "suspicious", r6("music_ratio").alias("music_ratio"), "music_heavy")


@query(f"WITH {SEG_EVENTS} SELECT video, seg_idx::INTEGER AS seg_idx FROM (SELECT *, avg(is_suspicious::INT) OVER (PARTITION BY video) AS s FROM seg) WHERE NOT is_suspicious OR s > 0.25")
def q_suspicious_skip(spark, sf_dir):
    return timeline.skip_suspicious(seg_events(spark, sf_dir)).select("video", "seg_idx")


@query(f"WITH {SEG_EVENTS} SELECT video, seg_idx::INTEGER AS seg_idx, k::INTEGER AS candidate_no FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY seg_idx) AS k FROM seg WHERE avg_logprob < -1.1 OR is_suspicious) WHERE k <= 8")
def q_low_confidence(spark, sf_dir):
    return timeline.low_confidence(seg_events(spark, sf_dir)).select("video", "seg_idx", "candidate_no")


@query(f"WITH {SEG_EVENTS} SELECT video, count(*) AS segments, round(avg(avg_logprob), 6) AS avg_logprob, count(*) FILTER (avg_logprob < -1.1) AS low_confidence_segments FROM seg GROUP BY video")
def q_confidence_summary(spark, sf_dir):
    c = timeline.confidence_summary(seg_events(spark, sf_dir))
    return c.select("video", "segments", r6("avg_logprob").alias("avg_logprob"), "low_confidence_segments")


CHUNK_SQL = f"""RECURSIVE {SEG_EVENTS}, ch(video, seg_idx, st, en, anchor, chunk_id) AS (
  SELECT video, seg_idx, st, en, st, 0 FROM seg WHERE seg_idx = 0 UNION ALL
  SELECT s.video, s.seg_idx, s.st, s.en, CASE WHEN s.st - anchor > 24 THEN s.st ELSE anchor END, chunk_id + (s.st - anchor > 24)::INT FROM ch JOIN seg s ON s.video = ch.video AND s.seg_idx = ch.seg_idx + 1)"""


@query(f"WITH {CHUNK_SQL} SELECT video, seg_idx::INTEGER AS seg_idx, chunk_id FROM ch")
def q_anchored_chunks(spark, sf_dir):
    return timeline.anchored_chunks(seg_events(spark, sf_dir), 24.0).select("video", "seg_idx", "chunk_id")


@query(f"""WITH {CHUNK_SQL}, b AS (SELECT *, first_value(st) OVER w AS cs, last_value(en) OVER w AS ce FROM ch WINDOW w AS (PARTITION BY video, chunk_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT video, seg_idx::INTEGER AS seg_idx, chunk_id, round(greatest(0, st - cs), 6) AS start, round(greatest(greatest(0, st - cs), en - cs), 6) AS "end", round(cs, 6) AS chunk_start, round(ce, 6) AS chunk_end FROM b""")
def q_normalize_chunks(spark, sf_dir):
    n = timeline.normalize_chunks(timeline.anchored_chunks(seg_events(spark, sf_dir), 24.0))
    return n.select("video", "seg_idx", "chunk_id", *(r6(c).alias(c) for c in ("start", "end", "chunk_start", "chunk_end")))


@query(f"""WITH {CHUNK_SQL}, b AS (SELECT video, chunk_id, arg_min(st, seg_idx) AS cs, arg_max(en, seg_idx) AS ce, chunk_id % 5 <> 3 AS produced FROM ch GROUP BY video, chunk_id),
c AS (SELECT *, greatest(0, coalesce(max(ce) FILTER (produced) OVER (PARTITION BY video ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cursor FROM b)
SELECT video, chunk_id, round(CASE WHEN cs - cursor > 0.03::DOUBLE THEN cs - cursor ELSE 0 END, 6) AS silence FROM c""")
def q_chunk_silence(spark, sf_dir):
    n = timeline.anchored_chunks(seg_events(spark, sf_dir), 24.0).groupBy("video", "chunk_id").agg(F.min_by("start", "seg_idx").alias("chunk_start"), F.max_by("end", "seg_idx").alias("chunk_end"))
    s = timeline.chunk_silence(n.withColumn("produced", F.col("chunk_id") % 5 != 3))
    return s.select("video", "chunk_id", r6("silence").alias("silence"))


@query(f"WITH {SEG_CONV} SELECT video, seg_idx::INTEGER AS seg_idx, round(greatest(0, st - coalesce(lag(en) OVER (PARTITION BY video ORDER BY seg_idx), 0)), 6) AS silence FROM (SELECT video, seg_idx, st + seg_idx * 0.25::DOUBLE AS st, en + seg_idx * 0.25::DOUBLE AS en, text FROM seg) WHERE {sql_strip('text')} <> ''")
def q_segment_silence(spark, sf_dir):
    s = seg_conv(spark, sf_dir)
    s = timeline.segment_silence(s.withColumns({c: F.col(c) + F.col("seg_idx") * 0.25 for c in ("start", "end")}))
    return s.select("video", "seg_idx", r6("silence").alias("silence"))


@query(f"""WITH s AS (SELECT doc_id, {sql_sentences(sql_squeeze('text'))} AS s, list_transform(s, lambda x: greatest(1, len({sql_words('x')}))) AS w, list_sum(w) AS t, n_chars / 15.0::DOUBLE AS d FROM documents WHERE n_chars > 0),
x AS (SELECT *, list_transform(w, lambda y: greatest(0.05::DOUBLE, y / t * d)) AS ds, unnest(range(1, len(s) + 1)) AS i FROM s)
SELECT doc_id AS video, (i - 1)::INTEGER AS seg_idx, round(round(least(d, coalesce(list_sum(ds[1:i - 1]), 0)), 3), 1) AS start, round(round(CASE WHEN i = len(s) THEN d ELSE least(d, list_sum(ds[1:i])) END, 3), 1) AS "end", s[i] AS text FROM x""")
def q_estimate_timings(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("video"), "text", (F.col("n_chars") / F.lit(15.0)).alias("duration"))
    # a tenth is as fine as two engines agree on, since sums of thousandths round either way
    exact = timeline.estimate_timings(d)
    return exact.select("video", "seg_idx", F.round("start", 1).alias("start"), F.round("end", 1).alias("end"), "text")


@query(f"""WITH {SEG_CONV}, a AS (SELECT video, seg_idx, st, en, row_number() OVER (PARTITION BY video ORDER BY seg_idx) AS n FROM seg WHERE role <> 'system'),
b AS (SELECT video, text || '!' AS t, row_number() OVER (PARTITION BY video ORDER BY seg_idx) AS n FROM seg WHERE seg_idx > 0) SELECT video, a.seg_idx::INTEGER AS seg_idx, t AS text FROM a JOIN b USING (video, n)""")
def q_attach_texts(spark, sf_dir):
    s = seg_conv(spark, sf_dir)
    return timeline.attach_texts(s.filter("role <> 'system'"), s.filter("seg_idx > 0").withColumn("text", F.concat("text", F.lit("!")))).select("video", "seg_idx", "text")


@query(f"""WITH {SEG_CONV}, t AS (SELECT video, role AS speaker, st + 3 AS s, en + 3 AS e FROM seg),
o AS (SELECT a.video, a.seg_idx, speaker, round(sum(least(en, e) - greatest(st, s)), 6) AS o FROM seg a JOIN t ON a.video = t.video AND st < e AND s < en GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY video, seg_idx ORDER BY o DESC, speaker) AS k FROM o)
SELECT a.video, a.seg_idx::INTEGER AS seg_idx, coalesce(speaker, 'spk_00') AS speaker_id FROM seg a LEFT JOIN b ON a.video = b.video AND a.seg_idx = b.seg_idx AND k = 1""")
def q_assign_speakers(spark, sf_dir):
    s = seg_conv(spark, sf_dir)
    turns = s.select("video", F.col("role").alias("speaker"), (F.col("start") + 3).alias("start"), (F.col("end") + 3).alias("end"))
    return timeline.assign_speakers(s, turns).select("video", "seg_idx", "speaker_id")


@query(f"WITH {SEG_CONV} SELECT video, string_agg(t, ' ' ORDER BY seg_idx) AS text FROM (SELECT video, seg_idx, {sql_strip('text')} AS t FROM seg) WHERE t <> '' GROUP BY video")
def q_transcript(spark, sf_dir):
    return timeline.transcript(seg_conv(spark, sf_dir))


@query()
def q_squash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.squash("text").alias("text"), r6(T.repetition_score("text")).alias("repetition"))


@query(f"""WITH w AS (SELECT doc_id, {sql_words('text')} AS w, list_transform(w, lambda x: regexp_replace(lower(x), '[^{WC}ऀ-ॿ]', '', 'g')) AS n FROM documents)
SELECT doc_id, array_to_string(list_filter(w, lambda x, i: NOT (i > 2 AND n[i] <> '' AND n[i] = n[i - 1] AND n[i] = n[i - 2])), ' ') AS text FROM w""")
def q_dedupe_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.let(T.words("text"), T.dedupe_words), " ").alias("text"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace({sql_squeeze('text')}, '([.!?,;:]){{4,}}', '\\1\\1\\1', 'g'), '[<>\"''`\\\\]', '', 'g') AS text FROM documents")
def q_clean_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.clean_for_speech("text").alias("text"))


@query(f"""SELECT doc_id, round(CASE WHEN lang = 'en' THEN greatest(0.55, least(0.95, 0.7 + least(0.08, 0.03 * {sql_count('text', '!')} + 0.025 * {sql_count('text', '[?]')} + 0.004 * least(8, {sql_count('text', ',')}) + 0.003 * least(6, {sql_count('text', '[;:]')})))) ELSE 0.7 END::DOUBLE, 6) AS temperature,
  greatest(96, least(512, floor(2.5 * greatest(1, length({sql_strip('text')})))))::BIGINT AS tokens FROM documents""")
def q_speech_settings(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", r6(T.temperature("text", routing.speech_name("lang"))).alias("temperature"), T.token_budget("text").cast("long").alias("tokens"))


@query(f"WITH {SEG_CONV} SELECT video, seg_idx::INTEGER AS seg_idx, CASE WHEN st >= 3600 THEN printf('%d:%02d:%05.2f', floor(st / 3600)::INT, floor(st % 3600 / 60)::INT, s) ELSE printf('%d:%05.2f', floor(st / 60)::INT, s) END AS timecode FROM (SELECT *, round(st % 60, 1) AS s FROM (SELECT * REPLACE (round(st, 1) AS st) FROM seg))")
def q_timecodes(spark, sf_dir):
    return seg_conv(spark, sf_dir).select("video", "seg_idx", T.timecode(F.round("start", 1)).alias("timecode"))


@query(f"""WITH {SEG_CONV}, a AS (SELECT *, {sql_squeeze('text')} AS t FROM seg),
b AS (SELECT *, CASE WHEN length(t) >= 2 AND t[1] IN ('"', chr(39)) AND t[1] = t[-1] THEN {sql_strip('t[2:-2]')} ELSE t END AS u FROM a)
SELECT video, seg_idx::INTEGER AS seg_idx, CASE WHEN seg_idx % 5 = 4 THEN 'edited' WHEN u <> '' THEN u ELSE text END AS text FROM b""")
def q_review_round_trip(spark, sf_dir):
    s = seg_conv(spark, sf_dir)
    lines = s.select("video", F.col("seg_idx").alias("line_no"), F.when(F.col("seg_idx") % 5 == 4, files.review_line(c=F.lit("edited"))).otherwise(files.review_line()).alias("line"))
    return files.apply_review(s, lines).select("video", "seg_idx", "text")


@query("SELECT page_id, CASE WHEN s = '' THEN 'video' ELSE s END AS stem, concat_ws('|', page_id::VARCHAR, coalesce(url, ''), '', length(html)::VARCHAR) AS resume_key FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+', ''), '[._-]+$', '') AS s FROM pages)")
def q_stems_and_keys(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.safe_stem("url").alias("stem"), files.resume_key("page_id", "url", F.lit(None), F.length("html")).alias("resume_key"))


# sources, written and read back

def _written(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


@query("SELECT 'set ' || item_id % 4 AS name, 'en' AS src_lang, 'hi' AS tgt_lang, (row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) - 1)::INTEGER AS segment_index, text AS source, text || '!' AS reference, NULL::VARCHAR AS context FROM benchmark")
def q_benchmark_source(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("set "), (F.col("item_id") % 4).cast("string")).alias("name"), F.lit("en").alias("src_lang"), F.lit("hi").alias("tgt_lang"), F.col("item_id").alias("segment_index"), F.col("text").alias("source"), F.concat("text", F.lit("!")).alias("reference"), F.lit(None).cast("string").alias("context"))
    files.write_benchmark(b, at := _written(spark, "benchmarks"))
    return files.read_benchmarks(spark, at)


@query(f"WITH {HISTORY}, n AS (SELECT benchmark, backend, doc_id % 4 AS ts, count(*) AS n FROM mt GROUP BY ALL) SELECT benchmark, backend, make_timestamp((ts * 86400000000)::BIGINT) AS ts, round(wer_mean, 6) AS wer_mean, round(chrf_mean, 6) AS chrf_mean, round(bleu_mean, 6) AS bleu_mean, n AS num_segments FROM hs JOIN n USING (benchmark, backend, ts)")
def q_history_source(spark, sf_dir):
    h = metrics(spark, sf_dir).groupBy("benchmark", "backend", (F.col("doc_id") % 4).alias("t")).agg(*(F.avg(m).alias(f"{m}_mean") for m in ("wer", "chrf", "bleu")), F.count("*").alias("num_segments")).withColumn("ts", F.timestamp_seconds(F.col("t") * 86400))
    at = _written(spark, "history")
    for day in range(4):
        files.append_history(h.filter(F.col("t") == day).drop("t"), at)
    return files.read_history(spark, at).select("benchmark", "backend", F.col("ts").cast("timestamp_ntz").alias("ts"), *(r6(f"{m}_mean").alias(f"{m}_mean") for m in ("wer", "chrf", "bleu")), "num_segments")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0")
def q_checkpoint_source(spark, sf_dir):
    """A step saved under a run's key, and resumed under it."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    files.save_checkpoint(c.filter("c_custkey % 2 = 0"), at := _written(spark, "checkpoints"), "load", "run|1")
    return files.load_checkpoint(spark, at, "load", "run|1")


# glossary

TERMS = [glossary.Term("the", {"hi": "ही"}, "general"), glossary.Term("was", {"hi": "था"}, "verb"), glossary.Term("that", {"hi": "वह"}, "general"), glossary.Term("de", {}, "general"), glossary.Term("The", {"hi": "दी"}, "name", case_sensitive=True), glossary.Term("and", {"hi": "और"}, "general", locked=False)]
_tokens = f"list_filter(string_split_regex(coalesce(text, ''), '[^{WC}]+'), lambda w: w <> '')"
_terms = "(VALUES " + ", ".join(f"('{t.term}', {str(t.case_sensitive).lower()}, {str(t.locked).lower()}, {repr(t.translations['hi']) if t.translations else 'NULL'})" for t in TERMS) + ") AS t(term, cs, locked, hi)"
MATCH_SQL = f"""mt AS (SELECT doc_id, term, cs, locked, hi, w FROM (SELECT doc_id, unnest({_tokens}) AS w FROM documents) JOIN {_terms} ON CASE WHEN cs THEN w = term ELSE lower(w) = lower(term) END)"""


@query(f"WITH {MATCH_SQL} SELECT doc_id, term, count(*) AS times FROM mt GROUP BY ALL")
def q_glossary_match(spark, sf_dir):
    return glossary.found(docs(spark, sf_dir), "doc_id", "text", TERMS).groupBy("doc_id", "term").agg(F.count("*").alias("times"))


@query(f"""WITH {MATCH_SQL}, v AS (SELECT doc_id, w AS original, hi AS expected, contains(lower(translate(t, 'aeiou', '')), lower(w)) AS there FROM mt JOIN (SELECT doc_id, text AS t FROM documents) USING (doc_id) WHERE locked AND hi IS NOT NULL AND NOT contains(lower(translate(t, 'aeiou', '')), hi))
SELECT doc_id, CASE WHEN there THEN 'untranslated_term' ELSE 'missing_term' END AS type, original, expected, CASE WHEN there THEN 'error' ELSE 'warning' END AS severity FROM v""")
def q_glossary_verify(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("target", F.translate("text", "aeiou", ""))
    return glossary.verify(d, "doc_id", "text", "target", "hi", TERMS)


@query()
def q_glossary_lock(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    locked = glossary.lock(c, "text", TERMS)
    return locked.select("conv_id", "turn", "locked_text", F.size("placeholders").alias("placeholders"), glossary.restore("locked_text", "placeholders", "hi", TERMS).alias("restored"))


@query()
def q_glossary_builtin(spark, sf_dir):
    return glossary.found(docs(spark, sf_dir), "doc_id", "text", glossary.builtin())


@query(f"""WITH t AS (SELECT DISTINCT lower(regexp_extract(text, '^([{WC}]+ [{WC}]+)(?:[^{WC}]|$)', 1)) AS term FROM benchmark),
p AS (SELECT doc_id, regexp_extract_all(text, '[{WC}]+|[^{WC}]+') AS p FROM documents),
x AS (SELECT doc_id, lower(z[1] || ' ' || z[3]) AS w FROM (SELECT doc_id, unnest(list_zip(p, p[2:], p[3:])) AS z FROM p) WHERE z[2] = ' ')
SELECT term, count(*) AS times, count(DISTINCT doc_id) AS docs FROM t JOIN x ON w = term WHERE term <> '' AND split_part(term, ' ', 1) <> split_part(term, ' ', 2) GROUP BY term""")
def q_glossary_table(spark, sf_dir):
    """A glossary of the two words that each benchmark text begins with, found in documents."""
    first = F.lower(F.regexp_extract("text", f"^([{W}]+ [{W}]+)(?:[^{W}]|$)", 1))
    known = table(spark, sf_dir, "benchmark").groupBy(first.alias("term")).agg(F.min("item_id").cast("int").alias("ord"))
    known = known.filter((F.col("term") != "") & (F.split_part("term", F.lit(" "), F.lit(1)) != F.split_part("term", F.lit(" "), F.lit(2))))
    return terms.found(docs(spark, sf_dir), "doc_id", "text", known).groupBy("term").agg(F.count("*").alias("times"), F.count_distinct("doc_id").alias("docs"))


# routing

_routes = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in ROUTES) + ") AS {0}(src, tgt, backend)"
PROFILE = f"greatest({sql_count('text', '[A-Za-zऀ-ॿঀ-৿઀-૿஀-௿ಀ-೿ഀ-ൿ]')}, 1)"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'hi' ELSE lang END AS src, CASE WHEN doc_id % 3 = 0 THEN 'hi' ELSE 'en' END AS tgt, {sql_count('text', '[A-Za-z]')} / {PROFILE} AS latin, {sql_count('text', '[ऀ-ॿ]')} / {PROFILE} AS deva FROM documents),
e AS (SELECT d.*, coalesce(f.backend, r.backend, 'indictrans2') AS b FROM d LEFT JOIN {_routes.format('f')} ON d.src = f.src AND d.tgt = f.tgt LEFT JOIN {_routes.format('r')} ON d.src = r.tgt AND d.tgt = r.src)
SELECT doc_id, src, tgt, CASE WHEN z THEN 'google' ELSE b END AS backend, CASE WHEN z THEN 'auto' ELSE src END AS resolved_src FROM (SELECT *, b IN ('nllb', 'indictrans2') AND src IN ('hi', 'mr') AND tgt = 'en' AND latin >= 0.55::DOUBLE AND deva <= 0.15::DOUBLE AS z FROM e)""")
def q_backend_route(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, "hi").otherwise(F.col("lang")).alias("src"), F.when(F.col("doc_id") % 3 == 0, "hi").otherwise("en").alias("tgt"))
    return routing.route_texts(d).select("doc_id", "src", "tgt", "backend", "resolved_src")


@query(f"SELECT doc_id, round({sql_count('text', '[A-Za-z]')} / {PROFILE}, 6) AS latin, round({sql_count('text', '[ऀ-ॿ]')} / {PROFILE}, 6) AS deva FROM documents")
def q_script_profile(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.script_share("text").alias("s")).select("doc_id", r6("s.latin").alias("latin"), r6("s.deva").alias("deva"))


@query("SELECT lang, CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODEL_CODES.items()) + " END AS code, coalesce(CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPEECH_NAMES.items()) + " END, 'auto') AS speech, count(*) AS documents FROM documents GROUP BY lang")
def q_language_codes(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("documents")).select("lang", routing.model_code("lang").alias("code"), routing.speech_name("lang").alias("speech"), "documents")


@query("""WITH v AS (SELECT user_id AS video, sum(value) AS duration, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 6.0 WHEN 2 THEN 12.0 ELSE 24.0 END::DOUBLE AS gb FROM events GROUP BY user_id),
c AS (SELECT *, CASE WHEN duration <= 60 THEN 'short' WHEN duration <= 300 THEN 'medium' WHEN duration <= 600 THEN 'long' ELSE 'very_long' END AS category, CASE WHEN gb IS NULL THEN 'cpu' WHEN gb <= 7 THEN 'low' WHEN gb <= 14 THEN 'mid' ELSE 'high' END AS tier FROM v)
SELECT video, category, tier, CASE tier WHEN 'cpu' THEN CASE category WHEN 'short' THEN 45 WHEN 'medium' THEN 90 WHEN 'long' THEN 120 ELSE 180 END WHEN 'low' THEN CASE category WHEN 'short' THEN 45 WHEN 'medium' THEN 75 WHEN 'long' THEN 90 ELSE 120 END
  WHEN 'mid' THEN CASE category WHEN 'short' THEN 60 WHEN 'medium' THEN 120 WHEN 'long' THEN 150 ELSE 210 END ELSE CASE category WHEN 'short' THEN 60 WHEN 'medium' THEN 150 WHEN 'long' THEN 240 ELSE 360 END END::DOUBLE AS chunk_seconds,
  (category = 'long' AND tier IN ('cpu', 'low')) OR (category = 'very_long' AND tier IN ('cpu', 'low', 'mid')) AS use_cpu FROM c""")
def q_video_strategy(spark, sf_dir):
    u = F.col("user_id") % 4
    v = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video"), F.when(u == 1, 6.0).when(u == 2, 12.0).when(u == 3, 24.0).alias("gb")).agg(F.sum("value").alias("duration"))
    return routing.strategy(v).select("video", "category", "tier", "chunk_seconds", "use_cpu")


@query("""WITH m AS (SELECT c_custkey, abs(c_acctbal) / 137 AS gb FROM customer), f AS (SELECT *, greatest(0.5::DOUBLE, least(0.95::DOUBLE, CASE WHEN gb <= 7 THEN 0.8 WHEN gb <= 14 THEN 0.86 WHEN gb <= 32 THEN 0.9 ELSE 0.92 END::DOUBLE)) AS fr FROM m)
SELECT c_custkey, round(fr, 6) AS memory_fraction, round(greatest(1, gb * fr), 6) AS budget, round(greatest(0.8::DOUBLE, 0.82::DOUBLE * greatest(1, gb * fr)), 6) AS warn, round(greatest(1, 0.92::DOUBLE * greatest(1, gb * fr)), 6) AS critical FROM f""")
def q_memory_plan(spark, sf_dir):
    m = routing.memory_plan(table(spark, sf_dir, "customer").select("c_custkey", (F.abs("c_acctbal") / 137).alias("gb")))
    return m.select("c_custkey", *(r6(c).alias(c) for c in ("memory_fraction", "budget", "warn", "critical")))


# metrics

CHRF_SQL = f"""{PAIRS}, o AS (SELECT unnest(range(1, 7)) AS n),
h AS (SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, substr(hyp, i::INT, n::INT) AS g FROM (SELECT *, unnest(range(1, length(hyp) - n + 2)) AS i FROM pr, o)) GROUP BY ALL),
f AS (SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, substr(ref, i::INT, n::INT) AS g FROM (SELECT *, unnest(range(1, length(ref) - n + 2)) AS i FROM pr, o)) GROUP BY ALL),
m AS (SELECT conv_id, turn, n, sum(h.c) AS hc, sum(least(h.c, coalesce(f.c, 0))) AS mc FROM h LEFT JOIN f USING (conv_id, turn, n, g) GROUP BY ALL),
q AS (SELECT conv_id, turn, avg(mc / hc) AS p, avg(CASE WHEN length(ref) - n + 1 > 0 THEN mc / (length(ref) - n + 1) ELSE 0 END) AS r FROM m JOIN pr USING (conv_id, turn) GROUP BY conv_id, turn)"""


@query(f"WITH {CHRF_SQL} SELECT conv_id, turn, round(CASE WHEN coalesce(p, 0) + coalesce(r, 0) = 0 THEN 0 ELSE 100 * 10 * p * r / (9 * p + r) END, 6) AS chrf FROM pr LEFT JOIN q USING (conv_id, turn)")
def q_chrf(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", r6(scored("chrf", "reference", "hypothesis")).alias("chrf"))


@query(f"""WITH {PAIRS}, w AS (SELECT conv_id, turn, {sql_words('ref')} AS rw, {sql_words('hyp')} AS hw FROM pr), o AS (SELECT unnest(range(1, 5)) AS n),
h AS (SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, list_slice(hw, i, i + n - 1) AS g FROM (SELECT *, unnest(range(1, len(hw) - n + 2)) AS i FROM w, o)) GROUP BY ALL),
f AS (SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, list_slice(rw, i, i + n - 1) AS g FROM (SELECT *, unnest(range(1, len(rw) - n + 2)) AS i FROM w, o)) GROUP BY ALL),
m AS (SELECT conv_id, turn, n, sum(least(h.c, coalesce(f.c, 0))) / sum(h.c) AS p FROM h LEFT JOIN f USING (conv_id, turn, n, g) GROUP BY ALL),
q AS (SELECT conv_id, turn, exp(avg(ln(p))) AS gm FROM m WHERE p > 0 GROUP BY ALL)
SELECT conv_id, turn, round(100 * coalesce(gm, 0) * CASE WHEN len(hw) = 0 THEN 0 WHEN len(hw) > len(rw) THEN 1 WHEN len(rw) = 0 THEN 0 ELSE 1 - len(rw) / len(hw) END, 6) + 0 AS bleu FROM w LEFT JOIN q USING (conv_id, turn)""")
def q_bleu(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", (r6(scored("bleu", "reference", "hypothesis")) + 0).alias("bleu"))


@query(f"""WITH RECURSIVE {PAIRS}, w AS (SELECT conv_id, turn, list_transform({sql_words('ref')}, lambda x: lower(x)) AS r, list_transform({sql_words('hyp')}, lambda x: lower(x)) AS h FROM pr),
e(conv_id, turn, i, d) AS (SELECT conv_id, turn, 0, range(0, len(h) + 1) FROM w UNION ALL
  SELECT conv_id, turn, i + 1, list_transform(range(0, len(b)), lambda j: j + list_min(list_transform(b[1:j + 1], lambda x, k: x - k + 1)))
  FROM (SELECT e.conv_id, e.turn, i, list_prepend((i + 1)::BIGINT, list_transform(range(1, len(h) + 1), lambda j: least(d[j + 1] + 1, d[j] + (h[j] <> r[i + 1])::BIGINT))) AS b FROM e JOIN w ON w.conv_id = e.conv_id AND w.turn = e.turn WHERE i < len(r)))
SELECT w.conv_id, w.turn, round(CASE WHEN len(r) = 0 THEN 0 ELSE least(1, d[-1] / len(r)) END, 6) AS wer FROM w JOIN e ON w.conv_id = e.conv_id AND w.turn = e.turn AND i = len(r)""")
def q_wer(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", r6(scored("wer", "reference", "hypothesis")).alias("wer"))


@query()
def q_benchmark_run(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.lit("bench").alias("benchmark"), F.col("text").alias("source"), F.col("text").alias("reference"))
    e = evaluation.aggregate(evaluation.evaluate(b, lambda s: F.regexp_replace(F.lower(s), "[aeiou]", "")), "benchmark")
    return e.select("benchmark", "num_segments", *(r6(c).alias(c) for c in ("wer_mean", "wer_median", "chrf_mean", "bleu_mean")))


@query(f"WITH {METRICS} SELECT backend, count(*) AS num_segments, round(avg(wer), 6) AS wer_mean, round(list_sort(list(wer))[len(list(wer)) // 2 + 1], 6) AS wer_median, round(avg(chrf), 6) AS chrf_mean, round(avg(bleu), 6) AS bleu_mean FROM mt GROUP BY backend")
def q_benchmark_aggregate(spark, sf_dir):
    a = evaluation.aggregate(metrics(spark, sf_dir), "backend")
    return a.select("backend", "num_segments", *(r6(c).alias(c) for c in ("wer_mean", "wer_median", "chrf_mean", "bleu_mean")))


@query(f"""WITH {HISTORY}, u AS (UNPIVOT (SELECT * FROM hs) ON wer_mean, chrf_mean, bleu_mean INTO NAME metric VALUE v),
c AS (SELECT benchmark, backend, metric, coalesce(max(v) FILTER (ts = 0), 0) AS a, coalesce(max(v) FILTER (ts = 1), 0) AS b FROM u WHERE ts IN (0, 1) GROUP BY ALL)
SELECT benchmark, backend, metric, round(a, 6) AS result1, round(b, 6) AS result2, round(b - a, 6) + 0 AS delta, round(CASE WHEN a = 0 THEN 0 ELSE (b - a) * 100 / a END, 4) + 0 AS delta_percent, CASE WHEN metric = 'wer_mean' THEN b < a ELSE b > a END AS improved FROM c""")
def q_compare(spark, sf_dir):
    h = history(spark, sf_dir)
    c = evaluation.compare(h.filter("ts = 0"), h.filter("ts = 1"), "benchmark", "backend")
    return c.select("benchmark", "backend", "metric", r6("result1").alias("result1"), r6("result2").alias("result2"), (r6("delta") + 0).alias("delta"), (F.round("delta_percent", 4) + 0).alias("delta_percent"), "improved")


@query(f"""WITH {HISTORY}, k AS (SELECT *, row_number() OVER (PARTITION BY benchmark, backend ORDER BY ts DESC) AS k FROM hs),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, backend ORDER BY chrf_mean - wer_mean DESC, ts) AS b FROM k WHERE k > 1) WHERE b = 1),
n AS (UNPIVOT (SELECT benchmark, backend, wer_mean, chrf_mean, bleu_mean FROM k WHERE k = 1) ON wer_mean, chrf_mean, bleu_mean INTO NAME metric VALUE c),
o AS (UNPIVOT (SELECT benchmark, backend, wer_mean, chrf_mean, bleu_mean FROM p) ON wer_mean, chrf_mean, bleu_mean INTO NAME metric VALUE v),
x AS (SELECT *, CASE WHEN metric = 'wer_mean' THEN c - v ELSE v - c END AS d FROM n JOIN o USING (benchmark, backend, metric))
SELECT benchmark, backend, metric, round(v, 6) AS previous, round(c, 6) AS current, round(d, 6) AS delta, CASE WHEN abs(d * 100 / v) > 10 THEN 'critical' ELSE 'warning' END AS severity FROM x WHERE d > 0 AND v <> 0 AND abs(d * 100 / v) > 5""")
def q_regression(spark, sf_dir):
    a = evaluation.regression(history(spark, sf_dir))
    return a.select("benchmark", "backend", "metric", r6("previous").alias("previous"), r6("current").alias("current"), r6("delta").alias("delta"), "severity")


# chunkers and packers

def pack_sql(rel: str) -> str:
    """Relation g(batch, item, gid) of rel(batch, item, text), by a recursion over the texts of each batch."""
    return f"""RECURSIVE d AS (SELECT batch, item, {sql_strip("replace(text, '###__SEGMENT_BOUNDARY__###', ' ')")} AS t, length(t) AS c, octet_length(encode(t)) AS b FROM {rel}),
o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY item) AS k FROM d WHERE c > 0 AND c < 4000),
g(batch, k, item, gc, gb, gn, gid) AS (SELECT batch, k, item, c, b, 1, 0 FROM o WHERE k = 1 UNION ALL
  SELECT o.batch, o.k, o.item, CASE WHEN z THEN o.c ELSE gc + o.c + 28 END, CASE WHEN z THEN o.b ELSE gb + o.b + 28 END, CASE WHEN z THEN 1 ELSE gn + 1 END, gid + z::INT
  FROM (SELECT g.*, o.item AS i2, o.c, o.b, gc + o.c + 28 > 4000 OR gb + o.b + 28 > 4200 OR gn >= 24 AS z FROM g JOIN o ON o.batch = g.batch AND o.k = g.k + 1) AS x JOIN o ON o.batch = x.batch AND o.k = x.k + 1)"""


_packed = "SELECT d.batch, d.item, g.gid AS group_id, d.c >= 4000 AS alone, d.c::INTEGER AS chars, d.b::INTEGER AS bytes FROM d LEFT JOIN g ON g.batch = d.batch AND g.item = d.item"


@query(f"WITH {pack_sql('(SELECT source AS batch, doc_id AS item, text FROM documents)')} {_packed}")
def q_batch_pack(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("source").alias("batch"), F.col("doc_id").alias("item"), "text")
    return requests.pack_requests(d)


@query(f"WITH {pack_sql("(SELECT 'all' AS batch, doc_id AS item, text FROM documents)")} {_packed}")
def q_batch_pack_all(spark, sf_dir):
    """All documents as one batch, in blocks that hold a small part of them."""
    return requests.pack_requests(docs(spark, sf_dir).select(F.lit("all").alias("batch"), F.col("doc_id").alias("item"), "text"), block=256)


#: Turns as the texts of one batch a role; the stand-in fails beyond 3000 characters, so larger requests go text by text, and longer texts in pieces.
_turns = "(SELECT role AS batch, conv_id * 1000 + turn AS item, text FROM conversations)"


@query(f"""WITH {pack_sql(_turns)},
p AS (SELECT batch, gid, count(*) AS n, sum(length(t)) + 28 * (count(*) - 1) AS size, min(item) AS head FROM g JOIN d USING (batch, item) GROUP BY ALL),
l AS (SELECT d.batch, d.item, d.t, d.c, d.item = p.head AS head, p.n > 1 AND p.size <= 3000 AS joined FROM d LEFT JOIN g USING (batch, item) LEFT JOIN p ON p.batch = g.batch AND p.gid = g.gid)
SELECT batch, item, CASE WHEN c = 0 THEN 'blank' WHEN joined THEN 'joined' ELSE 'each' END AS level, CASE WHEN c = 0 THEN '' WHEN joined AND NOT head THEN t ELSE '[en>fr] ' || t END AS translation FROM l WHERE c <= 3000""")
def q_batch_translation(spark, sf_dir):
    """With a stand-in backend. Texts that go in pieces are left to the tests."""
    c = table(spark, sf_dir, "conversations").select(F.col("role").alias("batch"), (F.col("conv_id") * 1000 + F.col("turn")).alias("item"), "text")
    out = batches.translate_batches(c, "en", "fr", [], {"google": Brittle}, requested="google")
    return out.filter(F.length(requests.sendable("text")) <= 3000).select("batch", "item", "level", "translation")


def _pieces(d: DataFrame, how, **options) -> DataFrame:
    return chunking.chunk_texts(d.select("doc_id", "text"), how, **options)


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, {sql_squeeze('text')} AS t FROM documents),
s AS (SELECT doc_id, i, s[i] AS s, length(s[i]) > 1200 AS long, coalesce(length(s[i - 1]) > 1200, false) AS after FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, CASE WHEN length(t) <= 1200 THEN list_filter([t], lambda x: x <> '') ELSE {sql_sentences('t')} END AS s FROM d))),
w AS (SELECT doc_id, i, j, w[j] AS w, j = 1 OR length(w[j - 1]) > 1200 AS begins FROM (SELECT doc_id, i, string_split(s, ' ') AS w, unnest(range(1, len(string_split(s, ' ')) + 1)) AS j FROM s WHERE long)),
u AS (SELECT doc_id, i, 0 AS j, 0 AS k, s AS u, after AS begins FROM s WHERE NOT long UNION ALL SELECT doc_id, i, j, 0, w, begins FROM w WHERE length(w) <= 1200
  UNION ALL SELECT doc_id, i, j, k, substr(w, 1200 * k + 1, 1200), true FROM (SELECT *, unnest(range(0, (length(w) + 1199) // 1200)) AS k FROM w WHERE length(w) > 1200)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) AS n FROM u),
g(doc_id, n, size, chunk) AS (SELECT doc_id, n, length(u), 0 FROM o WHERE n = 1 UNION ALL
  SELECT o.doc_id, o.n, CASE WHEN begins OR size + 1 + length(u) > 1200 THEN length(u) ELSE size + 1 + length(u) END, chunk + (begins OR size + 1 + length(u) > 1200)::INT FROM g JOIN o ON o.doc_id = g.doc_id AND o.n = g.n + 1)
SELECT doc_id, chunk AS chunk_idx, string_agg(u, ' ' ORDER BY n) AS text FROM g JOIN o USING (doc_id, n) GROUP BY doc_id, chunk""")
def q_chunk_simple(spark, sf_dir):
    return _pieces(docs(spark, sf_dir), chunking.by_sentences, limit=1200)


_clean = f"regexp_replace(regexp_replace({sql_squeeze('text')}, '([.!?,;:]){{4,}}', '\\1\\1\\1', 'g'), '[<>\"''`\\\\]', '', 'g')"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, {_clean} AS t FROM documents),
s AS (SELECT doc_id, i, s[i] AS s, length(s[i]) > 80 AS long FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {sql_sentences('t', '.!?।')} AS s FROM d WHERE length(t) > 80))),
c AS (SELECT doc_id, i, j, c[j] AS c, long FROM (SELECT doc_id, i, c, long, unnest(range(1, len(c) + 1)) AS j FROM (SELECT doc_id, i, long, CASE WHEN long THEN {sql_sentences('s', ',;')} ELSE [s] END AS c FROM s))),
p AS (SELECT doc_id, sum((long AND j = 1)::INT) OVER w AS stretch, row_number() OVER w AS i, c FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i, j ROWS UNBOUNDED PRECEDING)),
u AS (SELECT doc_id, stretch, 0 AS grp, i, 0 AS j, c AS u FROM p WHERE length(c) <= 80 UNION ALL SELECT doc_id, stretch, i, i, j, w[j] FROM (SELECT *, {sql_words('c')} AS w, unnest(range(1, len({sql_words('c')}) + 1)) AS j FROM p WHERE length(c) > 80)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stretch, grp ORDER BY i, j) AS n FROM u),
g(doc_id, stretch, grp, n, size, run) AS (SELECT doc_id, stretch, grp, n, length(u), 0 FROM o WHERE n = 1 UNION ALL
  SELECT o.doc_id, o.stretch, o.grp, o.n, CASE WHEN size + 1 + length(u) > 80 THEN length(u) ELSE size + 1 + length(u) END, run + (size + 1 + length(u) > 80)::INT FROM g JOIN o ON o.doc_id = g.doc_id AND o.stretch = g.stretch AND o.grp = g.grp AND o.n = g.n + 1),
r AS (SELECT doc_id, stretch, grp, run, string_agg(u, ' ' ORDER BY n) AS text, min(i) AS i FROM g JOIN o USING (doc_id, stretch, grp, n) GROUP BY ALL),
t AS (SELECT *, CASE WHEN grp > 0 THEN i ELSE lead(i) OVER (PARTITION BY doc_id, stretch, grp ORDER BY run) END AS done FROM r),
a AS (SELECT doc_id, text, grp, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY doc_id) - 1 AS last FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY stretch, done NULLS LAST, run))
SELECT doc_id, k::INTEGER AS chunk_idx, text FROM a WHERE NOT (k = last AND grp = 0 AND length(text) < 10) UNION ALL SELECT doc_id, 0, t FROM d WHERE length(t) BETWEEN 10 AND 80""")
def q_chunk_tts(spark, sf_dir):
    return _pieces(docs(spark, sf_dir), chunking.speakable, limit=80)


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, n, s[n] AS u, CASE WHEN n <= 10 THEN 2.0::DOUBLE * (n - 1) END AS tm FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS n FROM (SELECT doc_id, CASE WHEN length(t) <= 800 THEN [t] ELSE {sql_sentences('t')} END AS s FROM d))),
g(doc_id, n, size, k, chunk, st, en) AS (SELECT doc_id, n, length(u), 1, 0, tm, tm + 1.5::DOUBLE FROM o WHERE n = 1 UNION ALL
  SELECT doc_id, n, CASE WHEN z THEN size + 1 + length(u) ELSE length(u) END, CASE WHEN z THEN k + 1 ELSE 1 END, chunk + (NOT z)::INT, CASE WHEN z THEN st ELSE coalesce(tm, st) END, coalesce(tm + 1.5::DOUBLE, en)
  FROM (SELECT o.*, size, k, chunk, st, en, size + length(u) + 1 <= 800 AND (k + 1 <= 3 OR size < 100) AS z FROM g JOIN o ON o.doc_id = g.doc_id AND o.n = g.n + 1))
SELECT doc_id AS video, chunk AS chunk_idx, string_agg(u, ' ' ORDER BY n) AS text, arg_max(st, n) AS start, arg_max(en, n) AS "end" FROM g JOIN o USING (doc_id, n) GROUP BY doc_id, chunk""")
def q_chunk_semantic(spark, sf_dir):
    d = docs(spark, sf_dir)
    return chunking.chunk_semantic(d.select(F.col("doc_id").alias("video"), "text", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((i * 2.0).alias("start"), (i * 2.0 + 1.5).alias("end"))).alias("times")))


# audio

@query("""WITH p AS (SELECT event_id, value / 10 AS produced, greatest(0.05::DOUBLE, (event_id % 40) / 4) AS target FROM events)
SELECT event_id, round(target, 6) AS target, round(greatest(0.5::DOUBLE, least(2.0::DOUBLE, greatest(0.8::DOUBLE, least(1.25::DOUBLE, produced / target)))), 6) AS speed, abs(produced - target) > 0.06::DOUBLE AS stretch,
  produced <= greatest(0.05::DOUBLE, least(0.15::DOUBLE, 0.15::DOUBLE * target)) AS too_short, target >= 0.2::DOUBLE AND event_id % 200 < 80 AS too_quiet, round(greatest(0, produced - target), 6) AS pad FROM p""")
def q_duration_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 10).alias("produced"), F.lit(0.0).alias("start"), (F.col("event_id") % 40 / 4).alias("end"), (F.col("event_id") % 200).cast("double").alias("rms"))
    p = audio.pad_plan(audio.retry(audio.duration_plan(e)).withColumns({"video_seconds": F.col("produced"), "audio_seconds": F.col("target")}))
    return p.select("event_id", r6("target").alias("target"), r6("speed").alias("speed"), "stretch", "too_short", "too_quiet", r6("pad").alias("pad"))


@query("""WITH s AS (SELECT event_id, value / 37 AS s FROM events), k AS (SELECT *, CASE WHEN s > 2 THEN ceil(log2(s)) - 1 WHEN s < 0.5 AND s > 0 THEN ceil(-log2(s)) - 1 ELSE 0 END AS k FROM s)
SELECT event_id, CASE WHEN s <= 0 OR abs(s - 1) < 0.05::DOUBLE THEN 0 ELSE k + 1 END::INTEGER AS factors, round(CASE WHEN s <= 0 OR abs(s - 1) < 0.05::DOUBLE THEN NULL ELSE s / power(CASE WHEN s > 2 THEN 2.0 ELSE 0.5 END, k) END, 6) AS last FROM k""")
def q_stretch_factors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", audio.stretch_factors(F.col("value") / 37).alias("f"))
    return e.select("event_id", F.size("f").alias("factors"), r6(F.try_element_at("f", F.lit(-1))).alias("last"))


def _samples(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("short")).alias("s"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::SMALLINT::DOUBLE) AS s FROM embeddings),
b AS (SELECT vec_id, i, s[i:i + 15] AS b FROM (SELECT vec_id, s, unnest(range(1, len(s) + 1, 16)) AS i FROM s))
SELECT vec_id, max(floor(sqrt(list_sum(list_transform(b, lambda x: x * x)) / len(b))))::DOUBLE AS peak FROM b GROUP BY vec_id""")
def q_peak_rms(spark, sf_dir):
    return _samples(spark, sf_dir).select("vec_id", audio.peak_rms("s", 16).alias("peak"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::SMALLINT::INT) AS s FROM embeddings),
x AS (SELECT vec_id, s, list_reverse(s) AS t, len(s) AS n FROM s),
y AS (SELECT vec_id, list_concat(list_concat(s[1:n - 8], list_transform(range(1, 9), lambda i: trunc(s[n - 8 + i] * (1 - (i - 1) / 7) + t[i] * ((i - 1) / 7))::INT)), t[9:n]) AS f FROM x)
SELECT vec_id, len(f)::INTEGER AS n, list_sum(f)::BIGINT AS total FROM y""")
def q_crossfade(spark, sf_dir):
    s = _samples(spark, sf_dir).select("vec_id", audio.crossfade("s", F.reverse("s"), 8).alias("f"))
    return s.select("vec_id", F.size("f").alias("n"), F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::SMALLINT::INT) AS s FROM embeddings) SELECT vec_id, (vec_id % 100 + 1)::INTEGER AS n, list_sum(s[1:vec_id % 100 + 1])::BIGINT AS total FROM s")
def q_exact_fit(spark, sf_dir):
    n = (F.col("vec_id") % 100 + 1).cast("int")
    s = _samples(spark, sf_dir).select("vec_id", audio.fit("s", n).alias("f"))
    return s.select("vec_id", F.size("f").alias("n"), F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# logs, reports and flows

def _lines(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    step = F.concat(F.lit("["), (F.col("event_id") % 5 + 1).cast("string"), F.lit("/5] work"))
    line = F.when(F.col("event_type") == "view", step).when(F.col("event_type") == "purchase", "Pipeline complete").when(F.col("event_type") == "error", "ERROR: failed").when(F.col("event_type") == "click", "Warning: slow").otherwise("plain")
    return e.select(F.col("user_id").alias("run_id"), "ts", "event_id", line.alias("line"))


@query("""WITH l AS (SELECT user_id, ts, CASE event_type WHEN 'view' THEN [14, 34, 54, 82, 96][event_id % 5 + 1] WHEN 'purchase' THEN 100 END::DOUBLE AS p, event_type AS t FROM events)
SELECT user_id AS run_id, arg_max(p, ts) FILTER (p IS NOT NULL) AS progress, count(*) FILTER (t = 'error') AS errors, count(*) FILTER (t = 'click') AS warnings, count(*) AS lines FROM l GROUP BY user_id""")
def q_log_progress(spark, sf_dir):
    return streams.run_progress(_lines(spark, sf_dir))


@query("""WITH s AS (SELECT user_id AS run_id, event_type AS stage, sum(value) AS sec, count(*) FILTER (value > 400) AS f FROM events GROUP BY ALL)
SELECT run_id, CASE WHEN sum(f) > 0 THEN 'failed' ELSE 'ok' END AS status, round(sum(sec), 4) AS total_seconds, arg_max(stage, sec) AS slowest FROM s GROUP BY run_id""")
def q_run_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage")).agg(F.sum("value").alias("seconds"), F.when(F.count_if(F.col("value") > 400) > 0, "failed").otherwise("ok").alias("status"))
    return flows.run_report(e).select("run_id", "status", F.round("total_seconds", 4).alias("total_seconds"), "slowest")


@query()
def q_transcript_flow(spark, sf_dir):
    s = seg_conv(spark, sf_dir).withColumns({"language": F.lit("en"), "expected": F.lit("en"), "language_probability": F.lit(0.9)})
    return flows.postprocess_transcript(s)[1].select("video", "segments", r6("music_ratio").alias("music_ratio"), "gate", "passed")


@query()
def q_translation_flow(spark, sf_dir):
    """With stand-in backends, of which the first returns its input: no translation model is meant."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text", F.lit("en").alias("src"), F.lit("hi").alias("tgt"))
    return flows.translate(c, TERMS, [Identity, Marked]).select("id", "passed", r6("score").alias("score"), "reason", "backend", "wave")


@query()
def q_chunk_translation_flow(spark, sf_dir):
    """With a stand-in backend."""
    t = flows.translate_chunks(seg_conv(spark, sf_dir), "en", "fr", Marked)
    return t.select("video", "chunk_idx", r6("start").alias("start"), r6("end").alias("end"), "text", r6("quality_score").alias("quality_score"))


@query()
def q_synthesis_plan(spark, sf_dir):
    p = flows.synthesis_plan(seg_conv(spark, sf_dir))
    return p.select("video", "chunk_id", "seg_idx", r6("start").alias("start"), r6("silence").alias("silence"), F.size("pieces").alias("pieces"))


_fix_again = FIX_SQL.replace("FROM seg", "FROM mg").replace("f1", "h1").replace("f2", "h2").replace("fx", "hx")


@query(f"""WITH {SEG_EVENTS}, {FIX_SQL},
lo AS (SELECT video, seg_idx, floor((en + 0.25::DOUBLE - greatest(0, st - 0.25::DOUBLE)) * 10)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY seg_idx) AS k FROM fx WHERE avg_logprob < -1.1::DOUBLE OR is_suspicious) WHERE k <= 8),
rf AS (SELECT fx.video, fx.seg_idx, st, en, coalesce(n % 7 <> 0 AND n % 3 <> 0, false) AS refined, CASE WHEN refined THEN 'echo ' || n || ' um' ELSE text END AS text FROM fx LEFT JOIN lo USING (video, seg_idx)),
g AS (SELECT video, seg_idx, st, lag(en) OVER (PARTITION BY video ORDER BY seg_idx) AS pe FROM rf),
cl AS (SELECT video, greatest(0, pe + 0.05::DOUBLE) AS a, greatest(a + 0.10::DOUBLE, st - 0.05::DOUBLE) AS b, row_number() OVER (PARTITION BY video ORDER BY seg_idx) AS k FROM g WHERE st - pe BETWEEN 2.5 AND 15),
rc AS (SELECT video, a + 0.0::DOUBLE AS st, a + CASE WHEN n % 3 = 0 THEN b - a ELSE 1.0::DOUBLE END AS en, CASE WHEN n % 3 = 0 THEN 'no' ELSE 'echo ' || n END AS text FROM (SELECT *, floor((b - a) * 10)::BIGINT AS n FROM cl WHERE k <= 6) WHERE n % 7 <> 0),
mg AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY st, en, seg_idx NULLS LAST) - 1 AS seg_idx, st, en, text, refined, gap_refined
  FROM (SELECT *, false AS gap_refined FROM rf WHERE video IN (SELECT video FROM rc) UNION ALL BY NAME SELECT *, false AS refined, true AS gap_refined FROM rc)),
{_fix_again}
SELECT video, seg_idx::INTEGER AS seg_idx, round(st, 6) AS start, round(en, 6) AS "end", text, refined, gap_refined FROM (SELECT video, seg_idx, st, en, text, refined, gap_refined FROM hx UNION ALL SELECT video, seg_idx, st, en, text, refined, false FROM rf WHERE video NOT IN (SELECT video FROM rc))""")
def q_refinement_waves(spark, sf_dir):
    """With a stand-in recognizer."""
    s = recognition.refined(timeline.fix_timestamps(seg_events(spark, sf_dir)), recognition.Echo)
    return s.select("video", "seg_idx", r6("start").alias("start"), r6("end").alias("end"), "text", "refined", "gap_refined")


#: Samples by what the stand-in says of a text's length, at 100 a second; then each video's parts one after the other, by a recursion whose state is the time, all samples and those left by fades of 3.
TIMED_SQL = f"""RECURSIVE {SEG_EVENTS}, s0 AS (SELECT video, seg_idx, st - min(st) OVER (PARTITION BY video) AS st, en - min(st) OVER (PARTITION BY video) AS en, length(text || ' ' || seg_idx) AS l FROM seg),
s1 AS (SELECT *, greatest(0.05::DOUBLE, en - st) AS target, CASE WHEN l % 11 = 0 THEN 0 WHEN l % 7 <> 0 AND l % 5 = 0 THEN 4 ELSE l * 6 END AS n1, l % 11 <> 0 AND l % 7 = 0 AS quiet FROM s0),
s2 AS (SELECT *, n1 / 100.0::DOUBLE <= greatest(0.05::DOUBLE, least(0.15::DOUBLE, 0.15::DOUBLE * target)) OR (target >= 0.2::DOUBLE AND (quiet OR n1 = 0)) AS again FROM s1),
s3 AS (SELECT *, CASE WHEN NOT again THEN n1 WHEN l % 11 = 0 THEN 0 ELSE l * 6 END AS raw FROM s2),
s4 AS (SELECT *, CASE WHEN locked AND raw > 0 THEN floor(target * 100 + 0.5::DOUBLE)::BIGINT ELSE raw END AS n FROM s3, (VALUES (true), (false)) AS b(locked)),
tl(video, locked, seg_idx, n, q, place, cursor, total, track) AS (SELECT DISTINCT video, locked, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::DOUBLE, 0::BIGINT, 0::BIGINT FROM s4 UNION ALL
  SELECT video, locked, seg_idx, n, q, joined - fade, CASE WHEN n > 0 THEN CASE WHEN locked THEN en ELSE st + n / 100.0::DOUBLE END ELSE greatest(cursor, st) END, sum1 + n, joined - fade + n FROM
  (SELECT *, CASE WHEN sum1 > 3 AND n > 3 THEN 3 ELSE 0 END AS fade FROM
  (SELECT *, total + q AS sum1, track + q - CASE WHEN total > 3 AND q > 3 THEN 3 ELSE 0 END AS joined FROM
  (SELECT s.video, s.locked, s.seg_idx, s.n, s.st, s.en, cursor, total, track, floor(greatest(0, s.st - cursor) * 100 + 0.5::DOUBLE)::BIGINT AS q FROM tl JOIN s4 AS s ON s.video = tl.video AND s.locked = tl.locked AND s.seg_idx = tl.seg_idx + 1))))"""


def _timed(spark, sf_dir) -> list[DataFrame]:
    """Events as segments from 0 on, with their number in the text, spoken once and timed with slots (True) and without: plans and tracks."""
    s = seg_events(spark, sf_dir)
    zero = F.min("start").over(Window.partitionBy("video"))
    s = s.select("video", "seg_idx", (F.col("start") - zero).alias("start"), (F.col("end") - zero).alias("end"), F.concat_ws(" ", "text", "seg_idx").alias("text"))
    pieces = synthesis.voices(s, synthesis.Tone, synthesis.CarefulTone, rate=100)
    both = [(locked, synthesis.timed(pieces, 100, locked, block=4096)) for locked in (True, False)]
    return [a.unionByName(b) for a, b in zip(*([df.withColumn("locked", F.lit(locked)) for df in dfs] for locked, dfs in both))]


@query(f"""WITH {TIMED_SQL} SELECT video, locked, seg_idx::INTEGER AS seg_idx, 1 + again::INTEGER AS attempts, round(raw / 100.0::DOUBLE, 6) AS produced, tl.n::INTEGER AS n, q AS silence, CASE WHEN tl.n > 0 THEN place END AS "at"
FROM tl JOIN s4 USING (video, locked, seg_idx)""")
def q_timed_synthesis(spark, sf_dir):
    """With a stand-in voice."""
    return _timed(spark, sf_dir)[0].select("video", "locked", "seg_idx", "attempts", r6("produced").alias("produced"), "n", "silence", "at")


@query(f"WITH {TIMED_SQL} SELECT video, locked, max(track) AS samples, max(track + 4095) // 4096 AS blocks FROM tl GROUP BY video, locked HAVING max(track) > 0")
def q_timed_track(spark, sf_dir):
    """With a stand-in voice."""
    return _timed(spark, sf_dir)[1].groupBy("video", "locked").agg(F.sum(F.size("samples")).alias("samples"), F.count("*").alias("blocks"))


DUB_SQL = f"""RECURSIVE {SEG_EVENTS}, {FIX_SQL}, mu AS (SELECT *, en - st > 2 AND w / (en - st) < 0.3::DOUBLE AS music FROM fx),
kept AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY seg_idx) AS k FROM (SELECT *, avg(music::INT) OVER (PARTITION BY video) AS share FROM mu) WHERE NOT music OR share > 0.25::DOUBLE),
ch(video, k, en, anchor, chunk_id) AS (SELECT video, k, en, st, 0 FROM kept WHERE k = 1 UNION ALL
  SELECT s.video, s.k, s.en, CASE WHEN s.st - anchor > 24 THEN s.st ELSE anchor END, chunk_id + (s.st - anchor > 24)::INT FROM ch JOIN kept s ON s.video = ch.video AND s.k = ch.k + 1),
vd AS (SELECT video, max(greatest(st, en)) AS secs FROM seg GROUP BY video)"""


def _dubbed(spark, sf_dir) -> tuple[runs.Run, dict]:
    """Events as segments, dubbed into one language and then, by a second run that finds the transcript there, into another."""
    segments = stored(seg_events(spark, sf_dir).select("video", "seg_idx", "start", "end", "text"), "segments")
    root, source = f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}/runs-{uuid.uuid4().hex[:12]}", runs.files_fingerprint(spark, f"{sf_dir}/events.parquet")
    dub = lambda tgt: (run := runs.Run(spark, root, runs.key_of("events", "en")), runs.dub(run, segments, source, "en", tgt, [], {"google": Brittle}, "google", chunk_seconds=24.0))
    dub("es")
    return dub("fr")


@query(f"""WITH {DUB_SQL} SELECT video, CASE WHEN secs <= 60 THEN 'short' WHEN secs <= 300 THEN 'medium' WHEN secs <= 600 THEN 'long' ELSE 'very_long' END AS category, round(secs, 6) AS video_seconds,
  round(coalesce(a, 0), 6) AS audio_seconds, round(greatest(0, secs - coalesce(a, 0)), 6) AS pad, coalesce(n, 0) AS spoken_segments, coalesce(c, 0) AS chunks
FROM vd LEFT JOIN (SELECT video, max(en) AS a, count(*) AS n, count(DISTINCT chunk_id) AS c FROM ch GROUP BY video) USING (video)""")
def q_full_pipeline(spark, sf_dir):
    """With a stand-in backend."""
    m = _dubbed(spark, sf_dir)[1]["merged"].table
    return m.select("video", "category", *(r6(c).alias(c) for c in ("video_seconds", "audio_seconds", "pad")), "spoken_segments", "chunks")


@query(f"""WITH {DUB_SQL} SELECT 'videos' AS step, 'resumed' AS status, count(*) AS rows FROM vd UNION ALL SELECT 'transcript', 'resumed', count(*) FROM seg
UNION ALL SELECT 'translated', 'ok', count(*) FROM kept UNION ALL SELECT 'speech', 'ok', count(*) FROM kept UNION ALL SELECT 'merged', 'ok', count(*) FROM vd""")
def q_full_pipeline_steps(spark, sf_dir):
    """What the second run's report says of each step."""
    run, _ = _dubbed(spark, sf_dir)
    return run.report().filter(F.col("run_id") == run.id).select("step", "status", "rows")


def shipped(f):
    """f, after the package's code has gone to the executors."""
    return lambda spark, sf_dir: f(ship(spark), sf_dir)


QUERIES.update({k: shipped(f) for k, f in QUERIES.items()})
