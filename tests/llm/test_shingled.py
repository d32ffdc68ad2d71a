"""N-grams of many texts at once against those of one text at a time."""

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import jaccard
from tessella.llm.shingles import shingler

ODD = [None, "", " \t", "a", "A b", "a b c d a b c d", "x" * 40 + " y z w", "é" * 20 + " ü ß Q\x0bA\x1cB", "w" * 31 + " " + "v" * 32 + " " + "u" * 33 + " " + "t" * 300 + " Z"]
ODD += [" ".join("q" * k + chr(65 + k % 26) * k for k in range(1, n)) for n in range(30)]


@pytest.mark.parametrize("size", [1, 3, 5])
def test_same_as_one_at_a_time(size):
    texts = pa.array(ODD)
    for column in (texts, texts.slice(4, 9), texts[:0], pa.array(ODD * 2000)[:3000]):
        one = shingler(size)
        got = list(jaccard.shingled(column, size))
        assert len(got) == len(column) and all(np.array_equal(h, one(t.as_py())) for h, t in zip(got, column))


@pytest.mark.parametrize("share", [0, 0.1, 0.9, 1])
def test_first_in_order_without_sorting_all(share):
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 1 << 63, 500, np.uint64))
    late = np.unique(np.concatenate([rng.choice(h, int(share * len(h)), replace=False), rng.integers(0, 1 << 63, int(share * 90), np.uint64)]))
    rank = rng.permutation(len(late)) + 1
    places = {int(x): int(r) for x, r in zip(late, rank)}
    want = sorted(h.tolist(), key=lambda x: (places.get(x, 0), x))
    for first in (1, 51, len(h)):
        assert jaccard.in_order(h, first, late, rank).tolist() == want[:first]
