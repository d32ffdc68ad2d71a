"""Packing of documents into training sequences by minimum bin slack.

Each partition packs what it reads, so nothing is shuffled and a lost task is simply run again. A document's ids are cut at
multiples of the capacity; whole pieces are sequences of their own. What remains of each document waits in a pool of bounded
size. For each window the longest remainder is fixed, and a bitset subset-sum over the multiset of remaining lengths finds the
filling closest to the capacity; walking back through the stored bitsets yields how many pieces of each length to take. Where
even the best filling leaves slack, a waiting piece is cut to close it. Only the last sequence of a partition can be short, and
it is padded to a power of two.

Defined cases: a null text is an empty one and yields the end id alone; a null doc_id stays null; texts of any length are packed whole, in as many pieces as they
need; added tokens within a text, such as <|endoftext|>, are one id, as the tokenizers file has it; of pieces of one length the last that came goes first; repeated
rows are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 1024
#: Remainders that wait in a task at most, and how many stay for a good choice while more input comes.
POOL, KEEP = 4096, 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
#: Characters whose classes are beyond doubt in both tokenizer libraries.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧]")


def best_fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, count) pairs of a sub-multiset of counts whose sum is the largest that is at most capacity."""
    reach, limit, layers = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        left, some = min(counts[length], capacity // length), 1
        while left:
            some = min(some, left)
            layers.append((length, some, reach))
            reach |= (reach << (length * some)) & limit
            left -= some
            some *= 2
        if reach >> capacity & 1:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for length, some, before in reversed(layers):
        if not before >> at & 1:
            taken[length] += some
            at -= length * some
    return list(taken.items())


class Packer:
    """Packs pieces; rows come out through out, a list of tuples in the order of SCHEMA."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: dict[int, list] = defaultdict(list)
        self.waiting = 0
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        filled = sum(len(p[2]) for p in pieces)
        padded = self.capacity if filled == self.capacity else min(self.capacity, 1 << (filled - 1).bit_length())
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, at, padded))
            at += len(ids)
        self.sequence += 1

    def wait(self, piece: tuple) -> None:
        self.pool[len(piece[2])].append(piece)
        self.waiting += 1

    def take(self, length: int) -> tuple:
        piece = (own := self.pool[length]).pop()
        if not own:
            del self.pool[length]
        self.waiting -= 1
        return piece

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for s in range(0, whole, self.capacity):
            self.emit([(doc, s, ids[s : s + self.capacity], len(ids))])
        if whole < len(ids):
            self.wait((doc, whole, ids[whole:].copy(), len(ids)))
        if self.waiting > POOL:
            self.flush(KEEP)

    def flush(self, keep: int = 0) -> None:
        while self.waiting > keep:
            pieces = [self.take(max(self.pool))]
            slack = self.capacity - len(pieces[0][2])
            for length, n in best_fill({k: len(v) for k, v in self.pool.items()}, slack):
                for _ in range(n):
                    pieces.append(self.take(length))
                    slack -= length
            if slack and self.pool:  # every waiting piece is longer than the slack
                doc, start, ids, total = self.take(max(self.pool))
                pieces.append((doc, start, ids[:slack], total))
                self.wait((doc, start + slack, ids[slack:], total))
            self.emit(pieces)


def added_tokens(vocabulary: str) -> list[str]:
    """The strings that the tokenizers file maps to one id wherever they stand."""
    with open(vocabulary, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens") or []]


def encoder(vocabulary: str, ranks: str | None, added: list[str]):
    """A function from a text to its ids under the tokenizers file, without ids around the text.

    ranks: the same vocabulary as byte-pair ranks. Texts of plain characters, where both libraries split alike, and without added tokens
    take this faster way to the same ids; all others go through the tokenizers file."""
    loaded = []

    def by_file(t: str) -> np.ndarray:
        if not loaded:
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(vocabulary))
        return np.array(loaded[0].encode(t, add_special_tokens=False).ids, np.uint32)

    if not ranks:
        return by_file
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda t: by_file(t) if PLAIN.search(t) or any(x in t for x in added) else np.array(fast.encode_ordinary(t), np.uint32)


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of the documents (doc_id, text) in sequences of at most capacity ids, with the columns of SCHEMA."""

    added = added_tokens(vocabulary)

    def run(batches):
        encode, end = encoder(vocabulary, ranks, added), np.array([end_id], np.uint32)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        kinds = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

        def rows():
            out, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(kinds))], schema=kinds)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, np.concatenate([encode(text.as_py() or ""), end]))
            yield rows()
        packer.flush()
        yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
