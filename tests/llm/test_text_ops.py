"""Packing, suffixes, substrings and decontamination against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import decontaminate, packing, substrings, suffixes

from .data import SCHEMA, documents, frame

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def space_words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def test_best_fill():
    assert sorted(packing.best_fill({3: 2, 5: 1}, 11)) == [(3, 2), (5, 1)]
    assert packing.best_fill({7: 1}, 5) == [] and packing.best_fill({4: 9}, 13) == [(4, 3)]
    rng = np.random.default_rng(0)
    for _ in range(200):
        items = rng.integers(1, 12, rng.integers(1, 7)).tolist()
        cap = int(rng.integers(1, 30))
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        got = packing.best_fill(Counter(items), cap)
        assert sum(a * b for a, b in got) == max(s for s in sums if s <= cap)
        assert all(b <= items.count(a) for a, b in got)


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packing(spark, rows, docs, capacity):
    t = Tokenizer.from_file(VOCABULARY)
    expected = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        expected[r[0], len(ids), zlib.crc32(np.array(ids, np.uint32).tobytes())] += 1
    got = packing.pack(docs, VOCABULARY, RANKS, capacity=capacity).collect()
    assert sum(r["length"] for r in got) == sum(n * c for (_, n, _), c in expected.items())
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append(r)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= s[0]["padded_length"] <= capacity and {r["padded_length"] for r in s} == {s[0]["padded_length"]}
        assert s[0]["padded_length"] & (s[0]["padded_length"] - 1) == 0
    assert sum(sum(r["length"] for r in s) < capacity for s in by_sequence.values()) <= 3  # only each partition's last is short
    # pieces of texts whose id and length are theirs alone cover them and have their ids
    whole = {(r[0], len(i)): i for r in rows for i in [t.encode(r[1] or "", add_special_tokens=False).ids + [0]]}
    alone = {k for k in whole if sum(c for (d, n, _), c in expected.items() if (d, n) == k) == 1}
    parts = defaultdict(list)
    for r in got:
        if (k := (r["doc_id"], r["doc_tokens"])) in alone:
            ids = np.array(whole[k][r["start"] : r["start"] + r["length"]], np.uint32)
            assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
            parts[k].append((r["start"], r["length"]))
    assert parts.keys() == alone
    for k, p in parts.items():
        assert sum(n for _, n in p) == k[1] and sorted(p)[0][0] == 0
    assert packing.pack(empty(spark), VOCABULARY, RANKS).count() == 0


def test_fast_ids_are_the_files():
    added = packing.added_tokens(VOCABULARY)
    slow, fast = packing.encoder(VOCABULARY, None, added), packing.encoder(VOCABULARY, RANKS, added)
    t = Tokenizer.from_file(VOCABULARY)
    special = [f"a{x}b{x}{x} {x}" for x in added] + ["<|endoftext|> plain", "<|endoftext", "<|ENDOFTEXT|>"]
    for text in [r[1] or "" for r in documents(5)] + special:
        assert slow(text).tolist() == fast(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert added and len(fast(added[0])) == 1
    plain = "".join(chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028)])
    for i in range(0, len(plain), 3):
        t = f"a{plain[i : i + 3]} {plain[i : i + 7]}  b's 12{plain[i]}\n\n{plain[i]}x"
        assert not packing.PLAIN.search(t) and slow(t).tolist() == fast(t).tolist()


def test_order_of_suffixes():
    rng = np.random.default_rng(0)
    for n, a in ((1, 2), (2, 2), (3, 2), (4, 1), (5, 3), (50, 2), (400, 2), (900, 4), (2000, 1), (1500, 200)):
        x = rng.integers(0, a, n)
        b = bytes((x + 1).astype(np.uint8))
        assert suffixes.order_of(x + 1, 10**9).tolist() == sorted(range(n), key=lambda i: b[i:])
        for need in (4, 20):
            order = suffixes.order_of(x + 1, need)
            got = [b[i : i + need] for i in order]
            assert sorted(order.tolist()) == list(range(n)) and got == sorted(got)


def removed_bytes(texts, length):
    count = Counter(b[j : j + length] for b in texts for j in range(len(b) - length + 1))
    for b in texts:
        m = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                m[j : j + length] = b"\1" * length
        yield bytes(x for x, y in zip(b, m) if not y), sum(m), len(re.findall(b"\1+", bytes(m)))


@pytest.mark.parametrize(("length", "gram", "hot"), [(200, 48, 256), (200, 48, 1), (30, 8, 256), (30, 8, 2)])
def test_suffixes(spark, rows, docs, length, gram, hot):
    texts = [(r[1] or "").encode() for r in rows]
    expected = Counter((r[0], len(b), n, spans, kept) for r, b, (kept, n, spans) in zip(rows, texts, removed_bytes(texts, length)))
    got = suffixes.dedup(docs, length, gram, hot).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == expected


def test_long_text_in_pieces(monkeypatch):
    """A text beyond the size of a piece has the same segments' windows, whole."""
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "BYTES", 1000)
    text = bytes(np.random.default_rng(1).integers(97, 105, 5000).astype(np.uint8))
    seen = np.zeros(5000, int)
    for _, data, offsets, base in suffixes.pieces(pa.array([text.decode(), "short"]), 200):
        _, start, n, *_ = suffixes.segments(data, offsets)
        for s, m in zip(start, n):
            seen[base + s : base + s + m] += 1
    assert (seen[: 5000 - 199] == 1).all() and (seen[5000 - 199 :] == 0).all()


def test_suffixes_of_any_ids_and_copies(spark):
    """The largest id, none, a passage in every document with other words around it, and one document very many times."""
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage, copy = word(60), word(90)
    texts = [(2**63 - 1, word(50) + passage), (None, passage + word(50)), (-(2**63), copy), (None, None)] + [(i, copy) for i in range(40)] + [(100 + i, f"{word(30)} {passage} {word(30)}") for i in range(300)]
    df = spark.createDataFrame([(i, t, *([None] * 5)) for i, t in texts], SCHEMA).repartition(3)
    expected = Counter((i, len((t or "").encode()), n, spans, kept) for (i, t), (kept, n, spans) in zip(texts, removed_bytes([(t or "").encode() for _, t in texts], 200)))
    for hot in (256, 8):
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup(df, hot=hot).collect()) == expected


def test_suffixes_of_nothing(spark):
    assert suffixes.dedup(empty(spark)).count() == 0


def kept(rows, size):
    first = {}
    words = [space_words(r[1]) for r in rows]
    ids = [2**63 if r[0] is None else r[0] for r in rows]
    for k, w in zip(ids, words):
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            first[x] = min(first.get(x, k), k)
    for k, w in zip(ids, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < k:
                gone |= set(range(i, i + size))
        yield len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


def removed(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize(("size", "cells"), [(13, 4), (13, 0.01), (3, 4)])
def test_substrings(spark, rows, docs, size, cells):
    """With a hundredth of a cell for each window nearly all pass the sketch, and the exact pass decides."""
    expected = Counter((r[0], *x) for r, x in zip(rows, kept(rows, size)))
    assert removed(substrings.dedup(docs, size, cells)) == expected


def test_substrings_of_nothing(spark):
    assert substrings.dedup(empty(spark)).count() == 0


def test_substrings_of_any_ids_and_words(spark):
    """The largest id, the smallest, none; a window in every document; long words; words that collide under sums of powers."""
    a, b = "ab", "ba"
    for _ in range(9):
        a, b = a + b, b + a  # Thue-Morse words of 1024 letters
    common = " ".join(f"c{i}" for i in range(13))
    twelve = " ".join(f"t{i}" for i in range(12))
    texts = [(2**63 - 1, f"{common} {twelve} {a}"), (None, f"{twelve} {b} {common}"), (-(2**63), f"{common} x"), (0, twelve + " " + a[:-1] + "c"), (5, "y" * 300 + " " + common + " " + "y" * 299 + "z"), (2**63 - 1, f"{twelve} {a}")]
    texts += [(100 + i, f"own{i} {common} words{i}") for i in range(40)]
    df = spark.createDataFrame([(i, t, *([None] * 5)) for i, t in texts], SCHEMA).repartition(3)
    assert removed(substrings.dedup(df)) == Counter((i, *x) for (i, _), x in zip(texts, kept(texts, 13)))


def test_word_hashes():
    """Hashes of words of all lengths are apart, in both halves, however the words end."""
    from tessella.llm import words

    own = sorted({w for n in range(1, 600) for w in (b"a" * n, b"a" * (n - 1) + b"b", b"b" + b"a" * (n - 1), b"\0" * n)})
    data = np.frombuffer(b" ".join(own), np.uint8)
    for h in words.space_words(data, np.array([0, len(data)]))[:2]:
        assert len(np.unique(h)) == len(own)


def test_one_entry_for_each_group(spark):
    """Copies of one window don't meet in a slice: each group of texts sends it once."""
    from tessella.llm.blobs import unpacked

    df = spark.range(3000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 13), x -> concat('w', x))) as text")
    own, labels, _ = substrings.shelved(df, F.col("text"))
    seen = substrings.estimated(own, 13, 4, 1 << 12).collect()
    assert len(seen) <= labels and all((r["n0"], r["n1"]) == (1, 1) for r in seen)
    told = substrings.exactly(own, spark.createDataFrame(seen, "slice int, label int, n0 int, b0 binary, n1 int, b1 binary"), 13, 4, 1 << 12).filter("slice >= 0").collect()
    assert len(told) <= labels and {r["n"] for r in told} == {1} and len(unpacked(bytes(told[0]["bits"]), np.uint8)) == 1


def test_words_beyond_a_part():
    """Hashes do not depend on what else is in the part."""
    from tessella.llm import words

    one = "alpha beta\tgamma  delta".encode()
    data = np.frombuffer(one + b"beta" + one, np.uint8)
    h, _, per = words.space_words(data, np.array([0, len(one), len(one) + 4, len(data)]))
    assert per.tolist() == [4, 1, 4] and h[0] == h[5] and h[1] == h[4] == h[6] and len(set(h.tolist())) == 4
    big = np.frombuffer(b"ab cd " * 400_000, np.uint8)
    h, _, per = words.space_words(big, np.array([0, len(big)]))
    assert per.tolist() == [800_000] and len(set(h.tolist())) == 2


def item_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_decontaminate(spark, rows, docs, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
    some = [r[1] for r in sorted(rows, key=str) if r[1] and len(item_words(r[1])) > 40][:4]
    items = [(1, " ".join(some[0].split()[3:25]).upper()), (2, some[1]), (3, None), (4, "..."), (5, "Two words"), (6, "never seen before " * 5), (7, some[0] + " and more"), (7, "three short words"), (10, some[2])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    windows = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else []:
            windows[tuple(w[k : k + n])].add(str(i))
    expected = Counter()
    for r in rows:
        w, hit, ids = item_words(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[x]
        expected[r[0], len(w), len(hit), tuple(sorted(ids))] += 1
    got = decontaminate.find(docs, bench).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == expected
    assert all(sum(s["to"] - s["at"] for s in r["spans"]) == r["n_hit"] for r in got)
    assert decontaminate.find(docs, bench.limit(0)).filter("n_hit > 0").count() == 0 and decontaminate.find(empty(spark), bench).count() == 0


def test_digest_queries(spark, tmp_path):
    """The queries carry what their contracts ask for."""
    from tessella.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    names = {f.name for f in QUERIES["op2_suffixes"](spark, d).schema}
    assert names == {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}
    r = QUERIES["op4_substrings"](spark, d).filter("n_words = n_removed").first()
    assert r is None or r["kept_sha256"] == hashlib.sha256(b"").hexdigest()
