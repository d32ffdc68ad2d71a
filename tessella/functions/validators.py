"""Text quality checks as struct columns; reasons are stable codes beside numbers."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructType

from .scripts import BLOCKS, GATE_BLOCKS, SCRIPTS
from .text import A, S, W, WORD, col, let, repetition_score, shorter, squash, text, words


def outcome(valid, score, code) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(valid).alias("valid"), lit(score).cast("double").alias("score"), lit(code).alias("code"))


def by_language(lang: Column, value, other: Column) -> Column:
    """value(language) for each known language."""
    out = None
    for k in SCRIPTS:
        out = (F if out is None else out).when(lang == k, value(k))
    return out.otherwise(other)


def script(c: Column | str, lang: Column | str) -> Column:
    """Whether enough letters are of the script that lang is written in. Marks count as script but not as letters, so the ratio can exceed 1."""
    c, lang = text(c), col(lang)
    least = by_language(lang, lambda k: F.lit(SCRIPTS[k][2]), F.lit(None).cast("double"))

    def measured(bare: Column) -> Column:
        without = lambda one: F.length(F.regexp_replace(bare, f"{one}++", ""))
        count = lambda one: (F.length(c) if one.startswith("[a-zA-Z") else F.length(bare)) - without(one)
        ratio = by_language(lang, lambda k: F.try_divide(count(SCRIPTS[k][1]), F.length(c) - without(r"\p{L}")), F.lit(None).cast("double"))
        return F.struct(ratio.alias("r"), least.alias("m"))

    def judged(x: Column) -> Column:
        r, m = x["r"], x["m"]
        score = F.when(r < m, F.least(F.lit(1.0), r / m)).otherwise(1.0)
        return (
            F.when(m.isNull(), outcome(True, 1.0, "unknown_language"))
            .when(r.isNull(), outcome(False, 0.0, "no_letters"))
            .when(r < m * 0.5, outcome(False, score, "mismatch"))
            .otherwise(outcome(r >= m * 0.8, score, F.when(r >= m * 0.8, "ok").otherwise("weak")))
        )

    return let(let(F.regexp_replace(c, "[a-zA-Z]++", ""), measured), judged)  # runs of what most letters are go first, and what is left is short


def char_loop(c: Column | str) -> Column:
    return text(c).rlike(r"(?iud)(.)\1{4,}")


def word_loop(c: Column | str) -> Column:
    return text(c).rlike(rf"({WORD})(?:{S}++(?iu:\1)){{2}}")


#: Words up to which pairs are counted before any array is made; few such texts repeat one.
FEW = 512


def most_frequent(words: list[str], least: int) -> tuple[int, str] | None:
    """(n, phrase): the first most frequent of the longest phrases of five to two of words that occur least times. A phrase occurs no more often than what it begins with, so few places are left for longer ones."""
    if len(words) < FEW and max(Counter(zip(words, words[1:])).values(), default=0) < least:
        return None
    numbers: dict[str, int] = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int64)
    at, code, found = np.arange(len(w)), w, None
    for k in (2, 3, 4, 5):
        if len(w) < 2 * k:
            break
        inside = at <= len(w) - k
        at, code = at[inside], code[inside] * len(numbers) + w[at[inside] + k - 1]
        _, first, code, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        often = n >= least
        if not often.any():
            break
        best = np.flatnonzero(n == n.max())
        best = best[first[best].argmin()]
        found = int(n[best]), " ".join(words[at[first[best]] : at[first[best]] + k])
        keep = often[code]
        at, code = at[keep], code[keep]
    return found


def repeated_phrase(w: Column, least: int = 3) -> Column:
    """struct(n, item): the first most frequent phrase of five, four, three or two words that occurs least times or more, in lower case; else null. No part of a lambda, as workers find it."""

    @F.pandas_udf("struct<n:int,item:string>")
    def find(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([most_frequent((x or "").split("\n"), least) or (None, None) for x in t], columns=["n", "item"]).astype({"n": "Int32", "item": object})

    found = find(F.lower(F.array_join(w, "\n")))
    return F.when(found["n"].isNotNull(), found)


def repeats(words: list[str], n: Counter) -> bool:
    """Whether a phrase occurs three times, as then do the pair of words that it begins with and both its words; n counts each word."""
    if len(words) >= FEW:
        return most_frequent(words, 3) is not None
    often = {x for x, k in n.items() if k >= 3}
    return max(Counter((x, y) for x, y in zip(words, words[1:]) if x in often and y in often).values(), default=0) >= 3


@F.pandas_udf(StructType().add("words", IntegerType()).add("distinct", IntegerType()).add("again", BooleanType()))
def word_facts(t: pd.Series) -> pd.DataFrame:
    """Of lower-case texts how many words and distinct words they have, and whether a phrase repeats; str.split() cuts at S."""
    facts = [(len(w), len(n := Counter(w)), repeats(w, n)) for w in map(str.split, t)]
    return pd.DataFrame(facts, columns=["words", "distinct", "again"])


def loops(c: Column | str) -> Column:
    """Repetition of characters, words or phrases; without any the score is the share of distinct words. Words are cut and counted once, by workers."""
    facts = word_facts(F.lower(text(c)))
    return (
        F.when(facts["words"] < 4, outcome(True, 1.0, "short"))
        .when(char_loop(c), outcome(False, 0.0, "char_loop"))
        .when(word_loop(c), outcome(False, 0.0, "word_loop"))
        .when(facts["again"], outcome(False, 0.1, "phrase_loop"))
        .otherwise(outcome(True, facts["distinct"] / facts["words"], "ok"))
    )


def coherence(c: Column | str) -> Column:
    """Sentence lengths: their mean must be 2 to 50 words, and a share of 0.3 of them 3 to 30 words long."""
    other = f"[^{S[1:-1]}]"
    marked = F.regexp_replace(text(c), rf"[[{A}][^{S[1:-1]}.!?।॥]]++{S}*+", "w")  # a letter for each word and the white space after it, so a sentence is a run of w
    runs = lambda m, run: F.regexp_count(m, F.lit(run))
    sizes = let(marked, lambda m: F.struct(runs(m, "w++").alias("count"), F.length(F.regexp_replace(m, "[^w]++", "")).alias("total"), runs(m, "(?<!w)w{3,30}+(?!w)").alias("good")))

    def judged(x: Column) -> Column:
        count = x["count"]
        mean, good = F.try_divide(x["total"], count), F.try_divide(x["good"], count)
        return (
            F.when(count == 0, outcome(False, 0.0, F.when(text(c) == "", "empty").otherwise("no_sentences")))
            .when(mean < 2, outcome(False, 0.2, "short_sentences"))
            .when(mean > 50, outcome(False, 0.3, "long_sentences"))
            .when(~text(c).rlike(rf"{other}{S}++{other}++{S}++{other}"), outcome(False, 0.1, "few_words"))
            .otherwise(outcome(good >= 0.3, good, F.when(good >= 0.3, "ok").otherwise("few_good_sentences")))
        )

    return let(sizes, judged)


def garbage_ratio(c: Column | str, blocks: str = BLOCKS, marks: str = r""".,!?;:'"\-""") -> Column:
    rest = F.regexp_replace(text(c), rf"[{A} \n{marks}]++", "")  # of most texts little, which alone is gone through by class
    return F.coalesce(F.try_divide(F.regexp_count(rest, F.lit(f"[^{W}{S[1:-1]}{blocks}{marks}]")), F.length(text(c))), F.lit(0.0))


def garbage(c: Column | str, most: float = 0.2) -> Column:
    return let(garbage_ratio(c), lambda r: outcome(r <= most, F.greatest(F.lit(0.0), 1 - r / most), F.when(r <= most, "ok").otherwise("garbage")))


def plain(c: Column | str) -> Column:
    """c in lower case without anything but word characters."""
    return F.regexp_replace(F.lower(text(c)), f"[^{W}]++", "")


def is_plain_empty(c: Column | str) -> Column:
    """plain(c) == '', seen at the first word character."""
    return ~F.lower(text(c)).rlike(f"[{W}]")


def places(b: str, wanted: set[str], most: int) -> dict[str, list[int]]:
    """Where b has those of the wanted characters that it has most times at most. Few are looked for one by one, more in one pass over b."""
    out: dict[str, list[int]] = {}
    if len(wanted) > 256:
        few = {x for x, k in Counter(b).items() if k <= most and x in wanted}
        for j, x in enumerate(b):
            if x in few:
                out.setdefault(x, []).append(j)
        return out
    for x in wanted:
        at, j = [], b.find(x)
        while j >= 0 and len(at) <= most:
            at.append(j)
            j = b.find(x, j + 1)
        if 0 < len(at) <= most:
            out[x] = at
    return out


def longest(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest block of two ranges: the first such in a, there the first in b, and its size."""
    i0, j0, size = alo, blo, 0
    for i in range(alo, ahi):
        while i + size < ahi and (j := b.find(a[i : i + size + 1], blo, bhi)) >= 0:
            i0, j0, size = i, j, size + 1
    return i0, j0, size


def matched(a: str, b: str) -> int:
    """How many characters difflib's matching blocks of a and b have: the first longest block, then those before and after it. In a b of 200 or more, no block begins at a character that is more than about 1 % of b.

    Only places of a at which a block can begin are gone through, of which long texts have few."""
    n = len(b)
    if a == b or n < 200 and (a in b or b in a):
        return min(len(a), n)
    where = places(b, set(a), n // 100 + 1) if n >= 200 else {}
    at = [i for i, x in enumerate(a) if x in where]
    total, left = 0, [(0, len(a), 0, n)]
    while left:
        alo, ahi, blo, bhi = left.pop()
        i0, j0, size = longest(a, b, alo, ahi, blo, bhi) if n < 200 else (alo, blo, 0)
        ends, last = {}, -2
        for i in at[bisect_left(at, alo) : bisect_left(at, ahi)]:
            before, ends, last = ends if i == last + 1 else {}, {}, i
            for j in where[a[i]]:
                if j >= bhi:
                    break
                if j >= blo:
                    k = ends[j] = before.get(j - 1, 0) + 1
                    if k > size:
                        i0, j0, size = i - k + 1, j - k + 1, k
        while i0 > alo and j0 > blo and a[i0 - 1] == b[j0 - 1]:
            i0, j0, size = i0 - 1, j0 - 1, size + 1
        while i0 + size < ahi and j0 + size < bhi and a[i0 + size] == b[j0 + size]:
            size += 1
        if size:
            total += size
            left += [x for x in ((alo, i0, blo, j0), (i0 + size, ahi, j0 + size, bhi)) if x[0] < x[1] and x[2] < x[3]]
    return total


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two strings, null if one is; no SQL function has its junk rule for long strings."""
    return pd.Series([None if x is None or y is None else 2.0 * matched(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(a, b)], dtype="float64")


def copy_ratio(source: Column | str, target: Column | str, src_lang: Column | str, tgt_lang: Column | str) -> Column:
    """matching_ratio of the plain texts where it decides: null, without a comparison, for one language or an empty text."""
    asked = (col(src_lang) != col(tgt_lang)) & ~is_plain_empty(source) & ~is_plain_empty(target)
    return matching_ratio(F.when(asked, plain(source)), F.when(asked, plain(target)))


def script_name(lang: Column | str) -> Column:
    return by_language(col(lang), lambda k: F.lit(SCRIPTS[k][0]), F.lit("Unknown"))


def near_copy(source: Column | str, target: Column | str, src_lang: Column | str, tgt_lang: Column | str, ratio: Column | None = None) -> Column:
    """Whether a translation is too like its source. ratio: a column already computed by copy_ratio()."""
    ratio = copy_ratio(source, target, src_lang, tgt_lang) if ratio is None else ratio
    limit = F.when(script_name(src_lang) == script_name(tgt_lang), 0.5).otherwise(0.3)
    score = F.greatest(F.lit(0.0), 1 - ratio)
    return F.when(col(src_lang) == col(tgt_lang), outcome(True, 1.0, "same_language")).when(is_plain_empty(source) | is_plain_empty(target), outcome(True, 1.0, "empty")).otherwise(outcome(ratio <= limit, score, F.when(ratio <= limit, "ok").otherwise("near_copy")))


def fused(checks: list[Column], extra_scores: list[Column] = (), extra_codes: list[Column] = (), strict: Column | bool = True) -> Column:
    """struct(passed, score, reason): mean score, and the failed checks' codes joined by '; ' where strict."""
    strict = strict if isinstance(strict, Column) else F.lit(strict)
    more, codes = (F.array(*x) if len(x) else F.array().cast(t) for x, t in ((extra_scores, "array<double>"), (extra_codes, "array<string>")))

    def joined(c: Column) -> Column:
        mean = let(F.array_compact(F.concat(F.transform(c, lambda x: x["score"]), more)), lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s))
        failed = F.array_join(F.concat(F.transform(c, lambda x: F.when(strict & ~x["valid"], x["code"])), codes), "; ")
        return F.struct((failed == "").alias("passed"), mean.alias("score"), failed.alias("reason"))

    return let(F.array(*checks), joined)  # each check is computed once


def too_short() -> Column:
    return F.struct(F.lit(False).alias("passed"), F.lit(0.0).alias("score"), F.lit("too_short").alias("reason"))


def validate_translation(source, target, src_lang, tgt_lang, strict: Column | bool = True, ratio: Column | None = None) -> Column:
    """All five checks of a translation; one of fewer than five characters fails without them."""
    checks = [script(target, tgt_lang), loops(target), near_copy(source, target, src_lang, tgt_lang, ratio), coherence(target), garbage(target)]
    return F.when(shorter(target, 5), too_short()).otherwise(fused(checks, strict=strict))


def validate_transcript(c, lang=None, confidence=None) -> Column:
    """Loops, garbage, confidence if given and low, and script if a language is expected."""
    confidence = F.lit(0.0) if confidence is None else F.coalesce(col(confidence), F.lit(0.0))
    lang = F.lit(None).cast("string") if lang is None else col(lang)
    low = (confidence > 0) & (confidence < 0.5)
    expected = lang.isNotNull() & (lang != "") & (lang != "auto")
    checks = lambda x: fused([x["loops"], x["garbage"]], [F.when(low, confidence), F.when(expected, x["script"]["score"])], [F.when(low, F.lit("low_confidence")), F.when(expected & ~x["script"]["valid"], x["script"]["code"])])
    judged = F.struct(script(c, lang).alias("script"), loops(c).alias("loops"), garbage(c).alias("garbage"))
    return F.when(shorter(c, 3), too_short()).otherwise(let(judged, checks))


def gate(c, detected, expected, language_prob, avg_logprob=None, confidence=None) -> Column:
    """The reason why a transcript fails, the first of an order of tests, or `ok`."""
    number = lambda x: F.lit(0.0) if x is None else F.coalesce(col(x), F.lit(0.0))
    e, conf = col(expected), number(confidence)
    return (
        F.when(repetition_score(c) > 0.25, "repetition")
        .when(e.isNotNull() & (e != "") & (e != "auto") & ~e.eqNullSafe(col(detected)) & (col(language_prob) < 0.75), "language")
        .when(number(avg_logprob) < -1.1, "avg_logprob")
        .when((conf > 0) & (conf < 0.6), "confidence")
        .when(F.length(squash(c)) < 10, "short")
        .when(garbage_ratio(c, GATE_BLOCKS, "") > 0.25, "garbage")
        .otherwise("ok")
    )


def validate_segment(c, start, end, suspicious, lang=None) -> Column:
    """struct(passed, score, reason) of a timed segment: its length, its flag, then its text."""
    fail = lambda code: F.struct(F.lit(False).alias("passed"), F.lit(0.0).alias("score"), F.lit(code).alias("reason"))
    length = F.coalesce(col(end), F.lit(0.0)) - F.coalesce(col(start), F.lit(0.0))
    return F.when(length < 0.5, fail("short")).when(length > 15, fail("long")).when(F.coalesce(col(suspicious), F.lit(False)), fail("suspicious")).otherwise(validate_transcript(c, lang))


def repetition_warning(c) -> Column:
    """A sign of a transcript that repeats itself: a telling word, or few distinct words, case counting."""
    return F.contains(F.lower(text(c)), F.lit("protty")) | let(words(c), lambda w: F.size(F.array_distinct(w)) < 0.3 * F.size(w))
