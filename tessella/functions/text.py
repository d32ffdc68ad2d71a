"""Text expressions on Unicode code points, equal to what Python's re and str do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters, white space and word borders (fixed values: the Java spelling of Python's classes).
W = r"\p{L}\p{N}_"
S = r"[\t-\r\x1c-\x1f \x85\p{Z}]"
B = rf"(?:(?<![{W}])(?=[{W}])|(?<=[{W}])(?![{W}]))"
#: ASCII word characters, which a class looks up at once; a word character by these first (the same set as W); a whole word and the white space after one, which give up no part of what they match.
A = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
C = rf"[[{A}][{W}]]"
WORD, NEXT = rf"(?<!{C}){C}++", rf"{S}++{C}++"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(text(c), rf"^{S}+|{S}+\z", "")


def shorter(c: Column | str, n: int) -> Column:
    """Whether strip(c) has fewer than n characters, n being two or more; seen at the first that make it n."""
    return ~text(c).rlike(rf"(?s)[^{S[1:-1]}].{{{n - 2}}}.*?[^{S[1:-1]}]")


def squeeze(c: Column | str) -> Column:
    """c with each run of white space as one space, and none at the ends."""
    return F.btrim(F.regexp_replace(text(c), f"{S}+", " "))


def words(c: Column | str) -> Column:
    """The words between white space; none of a null or blank text."""
    return F.filter(F.split(text(c), f"{S}+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def sentences(c: Column | str, ends: str = ".!?।॥") -> Column:
    """Stripped, non-empty pieces of c, cut at white space that follows one of ends."""
    return F.filter(F.transform(F.split(text(c), f"(?<=[{ends}]){S}+"), strip), lambda x: x != "")


def normalized(w: Column, keep: str = "") -> Column:
    """w in lower case, without what is neither a word character nor in the class keep."""
    return F.regexp_replace(F.lower(w), f"[^{W}{keep}]", "")


def distinct_words(c: Column | str) -> Column:
    return F.size(F.array_distinct(F.transform(words(c), F.lower)))


#: Noise that squash() deletes (fixed values); each begins with one of a few letters, so most places are passed by at once.
NOISE = [
    rf"(?=[ptd])(?<![{W}])(?:protty|prottty|prr+|t+{S}*t+|d+{S}*d+)(?![{W}])",
    rf"(?=[mhao])(?<![{W}])(?:m+m+|h+h+|a+a+|o+o+)(?![{W}])",
    r"\p{Nd}{4,}",
    rf"(?=[mib])(?<![{W}])(?:music|instrumental|bgm)(?![{W}])",
]


def spaced(t: Column, keep: str = "") -> Column:
    """The words of a squeezed text, each normalized, still one space apart."""
    return normalized(t, f"{keep} ")


def dedupe_words(w: Column) -> Column:
    """w without words beyond the second of a run that are equal when normalized."""
    keys = F.transform(w, lambda x: normalized(x, r"ऀ-ॿ"))
    return let(keys, lambda n: F.filter(w, lambda x, k: ~((k >= 2) & (F.get(n, k) != "") & (F.get(n, k) == F.get(n, F.greatest(k - 1, F.lit(0)))) & (F.get(n, k) == F.get(n, F.greatest(k - 2, F.lit(0)))))))


def squash(c: Column | str) -> Column:
    """c with runs of words and phrases collapsed, noise deleted and white space squeezed. Few texts have any such run, and only these are taken apart."""
    tripled = lambda t: spaced(t, r"ऀ-ॿ").rlike(r"(?<![^ ])([^ ]++) \1 \1(?![^ ])")
    out = let(squeeze(c), lambda t: F.when(tripled(t), F.array_join(dedupe_words(F.split(t, " ")), " ")).otherwise(t))

    def collapsed(t: Column) -> Column:
        for n in (4, 3, 2):
            t = F.regexp_replace(t, rf"({WORD}(?:{NEXT}){{{n - 1}}})(?:{S}++(?iu:\1))++", "$1")
        return t

    out = let(out, lambda t: F.when(t.rlike(rf"({WORD}(?:{NEXT}){{1,3}}?){S}++(?iu:\1)"), collapsed(t)).otherwise(t))
    for noise in NOISE:
        out = F.regexp_replace(out, f"(?iu){noise}", "")
    return squeeze(out)


def repetition_score(c: Column | str) -> Column:
    """The share of words in runs of words that are like the run's first: equal to it, or one within the other."""
    start = F.struct(F.lit("").alias("anchor"), F.lit(0).alias("run"), F.lit(0).alias("total"))
    flushed = lambda a: a["total"] + F.when(a["run"] >= 2, a["run"]).otherwise(0)

    def step(a: Column, x: Column) -> Column:
        alike = (a["run"] > 0) & (a["anchor"] != "") & (x != "") & (F.contains(a["anchor"], x) | F.contains(x, a["anchor"]))
        return F.when(alike, F.struct(a["anchor"].alias("anchor"), (a["run"] + 1).alias("run"), a["total"].alias("total"))).otherwise(F.struct(x.alias("anchor"), F.lit(1).alias("run"), flushed(a).alias("total")))

    score = lambda w: F.when((F.length(text(c)) < 20) | (F.size(w) < 5), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.aggregate(w, start, step, flushed) / F.size(w)))
    return let(F.split(spaced(squeeze(c)), " "), score)


def clean_for_speech(c: Column | str) -> Column:
    """c squeezed, runs of four or more marks as three of the last, and without quotes, angle brackets and backslashes."""
    out = F.regexp_replace(squeeze(c), r"([.!?,;:]){4,}", "$1$1$1")
    return F.regexp_replace(out, r"""[<>"'`\\]""", "")


def script_share(c: Column | str) -> Column:
    """struct(latin, deva): shares of the letters of a fixed class."""
    letters = r"[A-Za-zऀ-ॿঀ-৿઀-૿஀-௿ಀ-೿ഀ-ൿ]"
    total = F.greatest(F.regexp_count(text(c), F.lit(letters)), F.lit(1))
    return F.struct((F.regexp_count(text(c), F.lit("[A-Za-z]")) / total).alias("latin"), (F.regexp_count(text(c), F.lit(r"[ऀ-ॿ]")) / total).alias("deva"))


def timecode(seconds: Column | str) -> Column:
    """h:mm:ss.ss, or m:ss.ss under an hour; negative times are 0."""
    s = F.greatest(F.lit(0.0), col(seconds).cast("double"))
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600.0)) / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%05.2f", h, m, F.pmod(s, F.lit(60.0)))).otherwise(F.format_string("%d:%05.2f", m, F.pmod(s, F.lit(60.0))))


def safe_stem(c: Column | str) -> Column:
    """A file stem of safe characters, `video` if none is left."""
    out = F.regexp_replace(F.regexp_replace(text(c), "[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+\z", "")
    return F.when(out == "", "video").otherwise(out)


def temperature(c: Column | str, language: Column | str, base: float = 0.7, cap: float = 0.08) -> Column:
    """A sampling temperature that English punctuation raises a little."""
    count = lambda marks: F.regexp_count(text(c), F.lit(f"[{marks}]"))
    cue = 0.03 * count("!") + 0.025 * count("?") + 0.004 * F.least(F.lit(8), count(",")) + 0.003 * F.least(F.lit(6), count(";:"))
    raised = F.greatest(F.lit(0.55), F.least(F.lit(0.95), F.lit(base) + F.least(F.lit(cap), cue)))
    return F.when(F.lower(F.trim(text(language))) == "english", raised).otherwise(F.lit(base))


def token_budget(c: Column | str) -> Column:
    return F.greatest(F.lit(96), F.least(F.lit(512), F.floor(2.5 * F.greatest(F.lit(1), F.length(strip(c))))))
