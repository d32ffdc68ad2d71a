"""Translation metrics: word error rate, character n-gram F-score and BLEU."""

from __future__ import annotations

import math
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text


def edits(a: list, b: list) -> int:
    """The edit distance of two sequences; one vectorised pass for each item of a."""
    ids: dict = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in s], np.int64) for s in (a, b))
    row, index = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, w in enumerate(x):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        # insertions: what is left of them is a running minimum once positions are taken off
        row = np.minimum.accumulate(np.concatenate([[i + 1], best]) - index) + index
    return int(row[-1])


def wer(reference: str, hypothesis: str) -> float:
    r, h = reference.lower().split(), hypothesis.lower().split()
    return min(1.0, edits(r, h) / len(r)) if r else 0.0


def grams(items, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def shared(a: Counter, b: Counter) -> int:
    return (a & b).total()


def chrf(reference: str, hypothesis: str, orders: int = 6, beta: float = 3.0) -> float:
    """Precision and recall are means over the orders that the hypothesis has; white space counts."""
    p, r = [], []
    for n in range(1, orders + 1):
        ref, hyp = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (reference, hypothesis))
        if hyp:
            m = shared(hyp, ref)
            p.append(m / hyp.total())
            r.append(m / ref.total() if ref else 0.0)
    if not p or not sum(p) + sum(r):
        return 0.0
    p, r = sum(p) / len(p), sum(r) / len(r)
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r)


def bleu(reference: str, hypothesis: str, orders: int = 4, standard: bool = False) -> float:
    """Geometric mean over the orders with any match. The brevity factor of a hypothesis that isn't longer is 1 - ref / hyp; exp() of it if standard."""
    r, h = reference.split(), hypothesis.split()
    if not h:
        return 0.0
    lack = 1 - len(r) / len(h)
    factor = 1.0 if len(h) > len(r) else (0.0 if not r else math.exp(lack) if standard else lack)
    found = []
    for n in range(1, orders + 1):
        hyp = grams(h, n)
        if hyp and (m := shared(hyp, grams(r, n))):
            found.append(m / hyp.total())
    return 100 * factor * math.prod(found) ** (1 / len(found)) if found else 0.0


#: name: the measure of a reference and a hypothesis.
MEASURES = {"wer": wer, "chrf": chrf, "bleu": bleu, "bleu_std": partial(bleu, standard=True)}


def scored(name: str, reference: Column | str, hypothesis: Column | str) -> Column:
    """One of MEASURES. Each is a function of its own, so a query pays for those that it asks for.

    A pair's n-grams stay in its row: exploded they would be many times the text in a shuffle."""
    measure = MEASURES[name]
    return F.pandas_udf(lambda r, h: pd.Series([measure(x, y) for x, y in zip(r, h)], dtype="float64"), "double")(text(reference), text(hypothesis))
