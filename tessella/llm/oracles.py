"""SQL of the corpus queries whose results DuckDB can reach too."""

from __future__ import annotations

from .quality import BOUNDS, ENOUGH, SPREAD, UNTOLD
from .secrets import BASE, RULES

SPACE_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

#: Bytes as pairs of hexadecimal digits; windows by their MD5, since 64-bit hashes collide on larger tables.
OP2 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT r, i, substr(x, 2 * i - 1, 2) AS y, CASE WHEN i + 199 <= length(x) // 2 THEN md5(substr(x, 2 * i - 1, 400)) END AS h FROM (SELECT r, x, unnest(range(1, length(x) // 2 + 1)) AS i FROM d)),
f AS (SELECT r, i, y, CASE WHEN h IS NOT NULL THEN count(*) OVER (PARTITION BY h) > 1 ELSE false END AS twice FROM b),
c AS (SELECT r, i, y, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS first FROM c),
a AS (SELECT r, count(*) FILTER (gone) AS n, count(*) FILTER (first) AS spans, string_agg(y, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY r)
SELECT doc_id, length(x)::BIGINT // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (r)
"""

_ratio = "least(1000, {0} * 1000 // greatest({1}, 1))"
_levels = {"g": "lang, source", "l": "lang", "a": ""}


def _quartiles(name: str, by: str, values: str, lowest: str) -> str:
    """The fence of each ratio by the values of a relation, 0 where lowest doesn't hold."""
    keys, over = (f"{by}, " if by else ""), f"PARTITION BY {by + ', ' if by else ''}ratio"
    return f"""{name} AS (SELECT {keys}ratio, CASE WHEN any_value(size) >= {ENOUGH} THEN CASE WHEN {lowest} THEN min(value) FILTER (upto * 4 >= size * 2) + {SPREAD} * (min(value) FILTER (upto * 4 >= size * 3) - min(value) FILTER (upto * 4 >= size)) ELSE 0 END END AS fence
  FROM (SELECT {keys}ratio, value, count(*) OVER ({over} ORDER BY value RANGE UNBOUNDED PRECEDING) AS upto, count(*) OVER ({over}) AS size FROM {values}) GROUP BY {keys}ratio)"""


def _by_ratio(values: dict) -> str:
    return f"CASE v.ratio {' '.join(f"WHEN '{k}' THEN {x}" for k, x in values.items())} END"


_found = "coalesce(g.fence, l.fence, a.fence)"
_usual = "coalesce(ag.fence, al.fence, aa.fence, 0)"
_rare = f"CASE WHEN {_found} IS NULL THEN {_by_ratio(UNTOLD)} ELSE least(greatest({_found}, {_by_ratio({k: x[0] for k, x in BOUNDS.items()})}), {_by_ratio({k: x[1] for k, x in BOUNDS.items()})}) END"

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, {SPACE_WORDS.format('text')} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
x AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) > 1 AS twice FROM (SELECT r, i, list_slice(w, i, i + 7) AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))),
p AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM x WHERE twice) GROUP BY r),
c AS (SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, CASE WHEN contains(t, chr(10)) THEN len(l) ELSE 1 END AS n_lines FROM d LEFT JOIN p ON d.r = p.r),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_ratio.format('n_symbols', 'word_chars')} AS symbols, {_ratio.format('n_dup_lines', 'n_lines')} AS dup_lines, {_ratio.format('n_repeat_words', 'n_words')} AS repeats FROM c),
v AS (SELECT r, lang, source, unnest(['symbols', 'dup_lines', 'repeats']) AS ratio, unnest([symbols, dup_lines, repeats]) AS value FROM m WHERE NOT base_failed),
u AS (SELECT * FROM v WHERE value > 0 AND value <= {_by_ratio({k: x[1] for k, x in BOUNDS.items()})}),
{', '.join(_quartiles(k, by, 'u', 'true') for k, by in _levels.items())},
{', '.join(_quartiles('a' + k, by, 'v', 'min(value) FILTER (upto * 4 >= size * 2) > 0') for k, by in _levels.items())},
o AS (SELECT v.r, bool_or(v.value > greatest({_rare}, {_usual})) AS out
  FROM v {' '.join(f"LEFT JOIN {p}g ON v.ratio = {p}g.ratio AND v.lang IS NOT DISTINCT FROM {p}g.lang AND v.source IS NOT DISTINCT FROM {p}g.source LEFT JOIN {p}l ON v.ratio = {p}l.ratio AND v.lang IS NOT DISTINCT FROM {p}l.lang LEFT JOIN {p}a ON v.ratio = {p}a.ratio" for p in ('', 'a'))} GROUP BY v.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(out, false) AS kept FROM m LEFT JOIN o ON m.r = o.r
"""


def _spans(k: int, kind: str) -> str:
    pattern, group, least = RULES[kind]
    p = pattern.replace("'", "''")
    measured = f"regexp_extract_all(t, '{p}', {group})" if group else "m"
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    return f"""SELECT r, {k} AS k, '{kind}' AS kind, st, st + length(m[i]) AS en FROM (SELECT r, m, z, i, {total('g[1:i]')} + {total('m[1:i - 1]')} AS st
  FROM (SELECT r, m, {measured} AS z, string_split_regex(t, '{p}') AS g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, t, regexp_extract_all(t, '{p}') AS m FROM d))) WHERE length(z[i]) >= {least}"""


OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_spans(k, kind) for k, kind in enumerate(RULES))}),
a AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(concat_ws(':', kind, st::BIGINT, en::BIGINT), ',' ORDER BY st, k) FILTER (k < {len(BASE)}) AS base, string_agg(concat_ws(':', kind, st::BIGINT, en::BIGINT), ',' ORDER BY st, k) AS spans FROM s GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON d.r = a.r
"""

def crc32(text: str) -> str:
    """The unsigned CRC32 of the UTF-8 of an SQL string, by the table crc of the clause CRC."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), lambda i: {byte})), lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295)"


#: The table of CRC32's remainders of all bytes.
CRC = "crc AS (SELECT list(list_reduce(list_prepend(c, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY c) AS crc FROM range(256) AS r(c))"

_features = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH {CRC},
d AS (SELECT row_number() OVER () AS r, doc_id, {_features} AS w FROM documents),
f AS (SELECT r, unnest(w) AS w FROM d),
g AS (SELECT unnest({_features}) AS w FROM benchmark),
b AS (SELECT w, {crc32('w')} % 10000 AS b FROM (SELECT w FROM f UNION SELECT w FROM g), crc),
s AS (SELECT b, count(*) AS n FROM f JOIN b USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM g JOIN b USING (w) GROUP BY b),
n AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
k AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (s_all + 10000) / ((s.n::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t ON s.b = t.b, n),
m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (w) JOIN k ON b.b = k.b GROUP BY r),
z AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m ON d.r = m.r),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM z),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k, count(*) OVER () AS n FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM c LEFT JOIN o ON c.r = o.r
"""

#: Near words share the word or what is left without one letter: two of one length if they differ there, at the same place; else the longer without a letter is the shorter.
OP12 = rf"""
WITH RECURSIVE {CRC},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+') AS w FROM documents),
o AS (SELECT w, doc_id, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM o, crc),
p AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM p WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON x.rest = v.word),
g AS (SELECT word, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, encode(near))) AS best, any_value(n) AS n FROM e GROUP BY word),
f AS (SELECT word, n_near, CASE WHEN most >= 10 * n THEN best END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n FROM g),
c AS (SELECT word, form AS root, 1 AS k FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL),
r AS (SELECT word, arg_max(root, k) AS root FROM c GROUP BY word)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0) AS n_near, form_n FROM v LEFT JOIN f ON v.word = f.word LEFT JOIN r ON v.word = r.word
"""

#: Pairs of different sets only; sets are told apart by the MD5 of what they hold.
OP11 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {SPACE_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [md5(array_to_string(w, ' '))] ELSE list_transform(range(1, len(w) - 1), lambda i: md5(array_to_string(w[i:i + 2], ' '))) END)) AS s FROM d),
c AS (SELECT md5(array_to_string(s, '')) AS c, min(doc_id) AS least, any_value(len(s)) AS n, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY 1),
x AS (SELECT c, n, unnest(s) AS x FROM c),
m AS (SELECT x FROM x GROUP BY x HAVING count(*) > 1),
y AS (SELECT x.* FROM x SEMI JOIN m USING (x)),
p AS (SELECT a.c AS a, b.c AS b FROM y a JOIN y b ON a.x = b.x AND a.c < b.c AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
t AS (SELECT c AS a, c AS b FROM c UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
k AS (SELECT t.a, min(least) AS component_id FROM t JOIN c ON t.b = c.c GROUP BY t.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE component_id END AS component_id FROM s LEFT JOIN k ON md5(array_to_string(s, '')) = k.a
"""
