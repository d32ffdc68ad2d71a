"""An interpolated modified Kneser-Ney n-gram model, counted in Spark, and scoring with it.

The model is of order two: at this order the counts of a corpus of mostly new words stay below twice the input's size (README).
Tasks count the word pairs they read, merged locally, and send them in blobs to slices of the pairs' hash range; a slice
adds them up and writes its sorted array of hashes with counts to the shared folder, as one slice of the model. What slices know of each word,
as a context and as a continuation, goes on in blobs to slices of the words' hash range, which write the sorted arrays of words. No
frequent word gathers in one task: its pairs are spread by the pair's hash, and only sums of it meet. A file is written under
another name and then moved, so a task that runs twice does no harm. Workers memory-map the arrays and look up sorted queries.

The shared folder must be mounted on all machines, since files are mapped from it.

Defined cases: a null text is empty and has its end token only; a null doc_id counts as empty text, which is held out; without any training
text every token has probability one under both models; repeated rows all count and all get their row; other columns are ignored. Texts of
any length are read whole, about a megabyte at a time or alone. Words are told apart by 56 bits of hash: among a billion distinct words
some seven pairs share one, and counts then hold for both.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import packed, unpacked
from .common import shared_dir
from .words import FIRST, SECOND, U, mix, parts, space_words

#: Pairs that a task holds before it sends them. Keys of the marks around a text, which no word has.
HELD = 1 << 20
BEGIN, END = U(0), U(1)
SLICE_PAIRS, SLICE_WORDS = 4 << 20, 4 << 20


def marked(hashes: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word keys (56 bits) with BEGIN before and END after each text; where each text begins."""
    first = np.cumsum(per_text + 2) - (per_text + 2)
    out = np.empty(len(hashes) + 2 * len(per_text), U)
    word = np.ones(len(out), bool)
    word[first] = word[first + per_text + 1] = False
    out[word] = np.maximum(hashes >> U(8), U(2))
    out[first], out[first + per_text + 1] = BEGIN, END
    return out, first


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * FIRST + w * SECOND + U(1))


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal values begin, and how many there are of each."""
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(sorted_)))


def save(folder: str, name: str, **arrays: np.ndarray) -> None:
    for k, a in arrays.items():
        part = f"{folder}/.{name}-{k}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, a)
        os.replace(part, f"{folder}/{name}-{k}.npy")


def discounts(n: list[int]) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and 3 or more, from how many things were counted once to four times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.clip(np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]), 0, [0, 1, 2, 3])


def folder_of(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"the model's arrays are memory-mapped, so {path} must be a mounted folder")
    return path.removeprefix("file://").removeprefix("file:")


def train(docs: DataFrame, path: str, slices: int | None = None) -> dict:
    """Counts docs(text) and writes the model's arrays into path; what else belongs to the model is returned, and written as model.json."""
    spark, folder = docs.sparkSession, folder_of(path)
    os.makedirs(folder, exist_ok=True)
    size = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    slices = slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SLICE_PAIRS)
    width = -(-(1 << 64) // slices)
    word_width = -(-(1 << 56) // slices)
    names = ("v", "per", "w", "c")
    kinds = pa.schema([("slice", pa.int32()), *((x, pa.binary()) for x in names)])

    def send(v, w, c):
        h = pair(v, w)
        to = (h // U(width)).astype(np.int32)
        order = np.lexsort((v, to))
        cut, out = np.searchsorted(to[order], np.arange(slices + 1)), []
        for s in range(slices):
            if len(x := order[cut[s] : cut[s + 1]]):
                first, per = runs(v[x])
                out.append((s, packed(v[x][first]), packed(per.astype(np.uint32)), packed(w[x]), packed(c[x].astype(np.uint32))))
        return pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out), kinds)], schema=kinds)

    def count(batches):
        held, n = [], 0

        def merged():
            v, w = map(np.concatenate, zip(*held))
            order = np.argsort(h := pair(v, w))
            first, c = runs(h[order])
            return send(v[order[first]], w[order[first]], c)

        for batch in batches:
            for _, _, data, offsets in parts(batch.column(0)):
                keys, first = marked(*space_words(data, offsets, lower=True)[::2])
                inside = np.ones(len(keys) - 1, bool)
                inside[first[1:] - 1] = False
                held.append((keys[:-1][inside], keys[1:][inside]))
                n += len(keys)
                if n >= HELD:
                    yield merged()
                    held, n = [], 0
        if held:
            yield merged()

    about = pa.schema([("slice", pa.int32()), *((x, pa.binary()) for x in ("h", "raw", "cont", "n1", "n2", "n3"))])

    def pairs(table: pa.Table) -> pa.Table:
        get = lambda name, kind: np.concatenate([unpacked(b.as_py(), kind) for b in table.column(name)])
        v, w, c = np.repeat(get("v", U), get("per", np.uint32)), get("w", U), get("c", np.uint32).astype(np.int64)
        order = np.argsort(h := pair(v, w))
        first, _ = runs(h[order])
        c, at = np.add.reduceat(c[order], first), order[first]
        h, v, w = h[at], v[at], w[at]
        s = table.column("slice")[0].as_py()
        save(folder, f"pairs-{s:06d}", h=h, c=np.minimum(c, (1 << 32) - 1).astype(np.uint32), n=np.array([*((c == k).sum() for k in (1, 2, 3, 4)), len(h)]))
        # a word as a continuation, and as a context
        x, one, zero = np.concatenate([w, v]), np.ones(len(w), np.int64), np.zeros(len(w), np.int64)
        sums = (np.concatenate([c, np.where(v == BEGIN, c, 0)]), np.concatenate([one, zero]), *(np.concatenate([zero, k]) for k in (c == 1, c == 2, c > 2)))
        order = np.argsort(x)
        first, _ = runs(x[order])
        x, sums = x[order[first]], [np.add.reduceat(y[order], first) for y in sums]
        cut, out = np.searchsorted(x // U(word_width), np.arange(slices + 1)), []
        for t in range(slices):
            if (a := cut[t]) < (b := cut[t + 1]):
                out.append((t, packed(x[a:b]), *(packed(y[a:b]) for y in sums)))
        return pa.Table.from_arrays([pa.array(y, k.type) for y, k in zip(zip(*out), about)], schema=about)

    def words(table: pa.Table) -> pa.Table:
        get = lambda name, kind: np.concatenate([unpacked(b.as_py(), kind) for b in table.column(name)])
        h, sums = get("h", U), [get(x, np.int64) for x in ("raw", "cont", "n1", "n2", "n3")]
        order = np.argsort(h)
        first, _ = runs(h[order])
        h, (raw, cont, n1, n2, n3) = h[order[first]], [np.add.reduceat(y[order], first) for y in sums]
        s, real = table.column("slice")[0].as_py(), cont > 0
        save(folder, f"words-{s:06d}", h=h, raw=raw, cont=cont.astype(np.uint32), n1=n1.astype(np.uint32), n2=n2.astype(np.uint32), n3=n3.astype(np.uint32))
        facts = [int(raw[real].sum()), int(real.sum()), int(cont.sum()), *(int((cont == k).sum()) for k in (1, 2, 3, 4)), int((cont > 2).sum())]
        return pa.table({"slice": pa.array([s], pa.int32()), "facts": pa.array([facts], pa.list_(pa.int64()))})

    binary = lambda names: ", ".join(["slice int", *(f"{x} binary" for x in names)])
    found = docs.select("text").mapInArrow(count, binary(names)).groupBy("slice").applyInArrow(pairs, binary(about.names[1:])).groupBy("slice").applyInArrow(words, "slice int, facts array<long>").collect()
    total = np.sum([r["facts"] for r in found] or [[0] * 8], axis=0).tolist()
    here = {k: sorted({int(x.split("-")[1]) for x in os.listdir(folder) if x.startswith(f"{k}-") and x.endswith(".npy")}) for k in ("pairs", "words")}
    *n, kept = np.sum([np.load(f"{folder}/pairs-{s:06d}-n.npy") for s in here["pairs"]] or [[0] * 5], axis=0).tolist()
    # every distinct pair is a continuation once, so the files of pairs that are visible must hold as many as the words were told of
    if kept != total[2] or here["words"] != sorted(r["slice"] for r in found):
        raise FileNotFoundError(f"{folder} lacks slices of the model: it has to be one folder on all machines")
    save(folder, "manifest", **{k: np.packbits(np.isin(np.arange(slices), x)) for k, x in here.items()})
    model = {"slices": slices, "tokens": total[0], "types": total[1], "pairs": total[2], "d_pair": discounts(n).tolist(), "d_word": discounts(total[3:7]).tolist(), "few": [*total[3:5], total[7]]}
    with open(f"{folder}/model.json", "w") as f:
        json.dump(model, f)
    return model


class Model:
    """The arrays in a folder, memory-mapped when first needed."""

    def __init__(self, folder: str):
        self.folder, self.maps = folder, {}
        self.there = {k: np.load(f"{folder}/manifest-{k}.npy", mmap_mode="r") for k in ("pairs", "words")}
        with open(f"{folder}/model.json") as f:
            self.m = json.load(f)
        d, few, pairs, types = np.array(self.m["d_word"]), self.m["few"], self.m["pairs"], self.m["types"]
        self.left = float(d[1] * few[0] + d[2] * few[1] + d[3] * few[2]) / pairs if pairs else 1.0
        self.uniform = 1.0 / (types + 1)

    def slice(self, kind: str, s: int, names: tuple[str, ...]):
        """The arrays of a slice, None of one that has no keys. A slice that was written and can't be read raises."""
        if (kind, s) not in self.maps:
            written = self.there[kind][s >> 3] >> (7 - (s & 7)) & 1
            at = f"{self.folder}/{kind}-{s:06d}"
            self.maps[kind, s] = [np.load(f"{at}-{x}.npy", mmap_mode="r") for x in names] if written else None
        return self.maps[kind, s]

    def look_up(self, kind: str, keys: np.ndarray, width: int, names: tuple[str, ...]) -> list[np.ndarray]:
        """For each of the sorted distinct keys the values under names, 0 where a key is absent."""
        out = [np.zeros(len(keys), np.int64) for _ in names]
        cut = np.searchsorted(keys // U(width), np.arange(self.m["slices"] + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[s], cut[s + 1]
            if (held := self.slice(kind, s, ("h", *names))) is None:
                continue
            at = np.minimum(np.searchsorted(held[0], keys[a:b]), len(held[0]) - 1)
            there = held[0][at] == keys[a:b]
            for o, x in zip(out, held[1:]):
                o[a:b][there] = x[at[there]]
        return out

    def score(self, keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score, score of each text of marked keys."""
        m, slices = self.m, self.m["slices"]
        word, which = np.unique(keys, return_inverse=True)
        raw, cont, n1, n2, n3 = self.look_up("words", word, -(-(1 << 56) // slices), ("raw", "cont", "n1", "n2", "n3"))
        d1, d2 = np.array(m["d_word"]), np.array(m["d_pair"])
        known = cont > 0
        base = np.log10((np.where(known, raw, 0) + 0.1) / (m["tokens"] + 0.1 * (m["types"] + 1)))
        lower = np.maximum(cont - d1[np.minimum(cont, 3)], 0) / max(1, m["pairs"]) + self.left * self.uniform
        spare = np.where(raw > 0, (d2[1] * n1 + d2[2] * n2 + d2[3] * n3) / np.maximum(raw, 1), 1.0)

        token = np.ones(len(keys), bool)
        token[first] = False
        at = np.flatnonzero(token)
        v, w = which[at - 1], which[at]
        h = pair(word[v], word[w])
        order = np.argsort(h)
        one, per = runs(h[order])
        (c,) = self.look_up("pairs", h[order[one]], -(-(1 << 64) // slices), ("c",))
        count = np.empty(len(h), np.int64)
        count[order] = np.repeat(c, per)
        p = np.maximum(count - d2[np.minimum(count, 3)], 0) / np.maximum(raw[v], 1) + spare[v] * lower[w]
        begin = first - np.arange(len(first))
        sums = lambda x: np.add.reduceat(x, begin)
        return np.diff(np.append(begin, len(at))), sums(known[w].astype(np.int64)), sums(base[w]), sums(np.log10(p))


def score(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, base_score (of the unigram base), score (log10 probability) for every row of docs(key, text)."""
    folder, kind = folder_of(path), docs.schema[key].dataType.simpleString()

    def run(batches):
        model = Model(folder)
        for batch in batches:
            for a, b, data, offsets in parts(batch.column(1)):
                got = model.score(*marked(*space_words(data, offsets, lower=True)[::2]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *map(pa.array, got)], names=[key, "n_tokens", "n_known", "base_score", "score"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(docs: DataFrame):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def learn_and_score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: all docs under the model of those not held out."""
    path = path or f"{shared_dir(docs.sparkSession)}/tessella/{docs.sparkSession.sparkContext.applicationId}/ngram-{uuid.uuid4().hex[:12]}"
    model = train(docs.filter(~held_out(docs)), path)
    return score(docs, path).select("doc_id", held_out(docs).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
