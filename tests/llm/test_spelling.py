"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from tessella.llm import spelling
from tessella.sources.staged import stored

from .data import documents, frame
from .test_text_ops import empty


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, perturbed=31, shortest=7, least=2, times=10):
    n = Counter()
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % perturbed == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}
    links = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: best for w, x in links.items() if x and n[best := min(x, key=lambda y: (-n[y], y))] >= times * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return Counter((w, form.get(w), root(w), n[w], len(links[w]), n.get(form.get(w))) for w in n)


def variant_rows(seed=0):
    """Words of few letters, so that many are near, with frequencies that make chains of forms; equal bigrams within a word; letters beyond ASCII; all edits at all places."""
    rng = random.Random(seed)
    texts, word = [], "abcdéfghij"
    edits = {word[:i] + word[i + 1 :] for i in range(10)} | {word[:i] + "x" + word[i:] for i in range(11)} | {word[:i] + "ÿ" + word[i + 1 :] for i in range(10)}
    texts += [" ".join(sorted(edits) * 2), f"{word} " * 300, "aaaaaaa AAAAAAAA aaaaaaaaa aaaabaaaa aaaabaaaaa aaaaaaab baaaaaaa " * 2]
    texts += ["chainedword " * 2, "chainedwords " * 25, "chainedwordsa " * 260, "xchainedwordsa " * 2700]  # each is the form of that before
    texts += ["tiedtiea " * 2, "tiedtiec tiedtieb tiedtied " * 20]
    texts += [" ".join("".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(300)) for _ in range(3)]
    texts += ["ab×cd÷efg ab×cd÷efg Ābcdefgh Ābcdefgh ŠŠabcdefg̀hijklmnop", "नमस्तेabcdefgनमस्ते\x00abcdefg"]
    return [(None if i == 3 else i, t, "en", "s", 0, None, 0) for i, t in enumerate(texts)] + documents(seed)[:40]


@pytest.mark.parametrize("perturbed", [31, 2])
def test_variants(spark, perturbed):
    rows = variant_rows()
    expected = brute(rows, perturbed)
    assert sum(1 for w in expected if w[1]) > 15 and (perturbed == 2 or any(w[1] != w[2] for w in expected if w[1]))
    assert max(w[4] for w in expected) >= 15
    assert Counter(map(tuple, spelling.variants(frame(spark, rows), perturbed=perturbed).collect())) == expected


def test_pairs_come_once(spark):
    v = stored(spark.createDataFrame([(w, 2) for w in {r[0] for r in brute(variant_rows(3), least=1)}], "word string, n long"), "v")
    got = [(r["a"], r["b"]) for r in spelling.pairs(v).collect()]
    assert len(got) == len({frozenset(x) for x in got}) and all(near(*x) for x in got)


def test_few_words_are_held(spark, monkeypatch):
    rows = variant_rows(1)
    monkeypatch.setattr(spelling, "HELD", 10)
    assert Counter(map(tuple, spelling.words(frame(spark, rows)).collect())) == Counter((w[0], w[3]) for w in brute(rows))


def test_nothing(spark):
    assert spelling.variants(empty(spark)).collect() == []
    assert spelling.variants(frame(spark, [(1, t, None, None, 0, None, 0) for t in (None, "", "short words only", "१२३४५६७८")])).collect() == []
