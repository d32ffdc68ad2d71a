"""Documents with everything that has to be handled: nulls, blanks, long texts, ties, copies, near copies, passages, odd characters."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, v string, k int"


def words(rng, n, size=400):
    return [rng.choice(["lorem", "ipsum", "dolor", "amet", "été", "Straße", "naïve", "x1"]) if rng.random() < 0.2 else f"w{rng.randrange(size)}" for _ in range(n)]


def documents(seed=0, n=60):
    """Rows in SCHEMA; v and k are further columns whose names operators use inside."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    base = [" ".join(words(rng, rng.randrange(5, 250))) for _ in range(n)]
    texts = list(base)
    for t in base[:15]:  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base[3]] * 4 + [base[0] + "\n\n" + base[1]] + [t + " " + passage + " " + t2 for t, t2 in zip(base[:12], base[20:32])]
    texts += [None, "", "  \n\t ", "one", "Two words", "three short words", "tab\tand\x0bvertical\u00a0nbsp\u2003em", "é" * 300, "ab" * 600, "a " * 500, "x" * 5000, " ".join(words(rng, 6000)), "line one here\nline one here\n\nline two\nline one here"]
    texts += ["###$$$ %%% &&& |||" * 20, "<|endoftext|> plain", "नमस्ते दुनिया। यह ठीक है " * 10, "emoji 😀 text 😀"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None]), len(t or ""), f"x{i}", i) for i, t in enumerate(texts)]
    rows += [(3, "same id, other text " + passage, "en", "s0", 0, None, 1), (None, base[5], "en", None, 0, None, None), (None, "a text of a nameless document " * 8, None, None, 0, None, None)]
    rows += [rows[7], rows[7]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)
