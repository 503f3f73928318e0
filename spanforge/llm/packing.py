"""Filling containers of fixed capacity with neighbouring texts.

Documents become hashed vectors: each word's hash gives it a sign in every one
of ``DIMS`` dimensions, and the sums over a document, divided by the root of
its length, are a random projection of its bag of words. Each coordinate,
which is near to normally distributed, is put on a grid of 2^``BITS`` cells by
the normal distribution function, and the cell's place on the Hilbert curve is
the document's key. The stored keys and sizes are range-sorted by key, so each
task holds a stretch of the curve, and packs it: windows of neighbouring items
are placed best-fit by decreasing size; containers with room left stay open for
the next window. A task holds one window and the open containers, whatever the
number of rows.

A text larger than a container is cut by token number into full pieces, each a
container of its own, and a rest that is packed like any text.

Defined results: a null text has no container; an empty text is an item of
size 0; a size that is not given is counted; copies and ties are kept apart by
id; an empty table gives no containers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.splitting import token_count
from spanforge.llm.words import Codes, words
from spanforge.session import stored

CAPACITY = 2048
DIMS, BITS = 4, 8
WINDOW = 2048
OPEN = 256


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of grid cells on the Hilbert curve (Skilling's transposed form, a batch at a time)."""
    x = cells.astype(np.uint64).copy()
    n = x.shape[1]
    one = np.uint64(1)
    for q in (one << np.uint64(b) for b in range(bits - 1, 0, -1)):
        p = q - one
        for i in range(n):
            hit = (x[:, i] & q) != 0
            x[hit, 0] ^= p
            t = np.where(hit, np.uint64(0), (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= t
            x[:, i] ^= t
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.uint64)
    for q in (one << np.uint64(b) for b in range(bits - 1, 0, -1)):
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - one), t)
    x ^= t[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def coordinates(codes: np.ndarray) -> np.ndarray:
    """Random projection of a bag of word hashes to ``DIMS`` numbers near to standard normal."""
    if not len(codes):
        return np.zeros(DIMS)
    signs = (codes[:, None] >> np.arange(DIMS, dtype=np.uint64)) & np.uint64(1)
    return (2.0 * signs.sum(axis=0) - len(codes)) / math.sqrt(len(codes))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = Codes()
    for b in batches:
        z = []
        for lo in range(0, b.num_rows, 256):
            # each different word counts once, or a few frequent ones would place every text
            z += [coordinates(memory.array(list(set(words(t or ""))))) for t in b.column(1).slice(lo, 256).to_pylist()]
        z = np.array(z).reshape(-1, DIMS)
        share = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))
        cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(hilbert(cells, BITS), pa.int64())], names=["id", "size", "key"])


def curve(docs: DataFrame, ident: str, text: str, size: str | None) -> DataFrame:
    """(id, size, key) of each text."""
    t = F.col(text)
    n = F.coalesce(F.col(size).cast("long"), token_count(t)) if size else token_count(t)
    return docs.where(t.isNotNull()).select(F.col(ident).cast("long").alias("id"), t.alias("text"), n.alias("size")).mapInArrow(_keys, "id long, size long, key long")


class Packer:
    """Best fit by decreasing size in windows, with open containers carried on."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.next, self.room = 0, {}
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0  # bit r is set if a container with room r is open

    def _put(self, c: int, room: int) -> None:
        self.by_room[room].append(c)
        self.used |= 1 << room

    def place(self, sizes: np.ndarray) -> np.ndarray:
        out = np.empty(len(sizes), np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            s = int(sizes[i])
            fit = self.used >> s
            if fit:
                room = s + (fit & -fit).bit_length() - 1
                c = self.by_room[room].pop()
                if not self.by_room[room]:
                    self.used &= ~(1 << room)
            else:
                c, room = self.next, self.capacity
                self.next += 1
            out[i] = c
            self._put(c, room - s)
        self._close()
        return out

    def _close(self) -> None:
        """Only the containers with most room stay open."""
        left = self.most_open
        for room in range(self.capacity, -1, -1):
            if left <= 0 and self.by_room[room]:
                self.by_room[room] = []
                self.used &= ~(1 << room)
            elif len(self.by_room[room]) > left:
                self.by_room[room] = self.by_room[room][:left]
            left -= len(self.by_room[room])


def _pack(capacity: int, window: int, most_open: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        high = TaskContext.get().partitionId() << 40
        packer, waiting, n = Packer(capacity, most_open), [], 0

        def flush() -> pd.DataFrame:
            rows = pd.concat(waiting, ignore_index=True)
            rows["container"] = packer.place(rows["n_tokens"].to_numpy(np.int64)) + high
            return rows[["id", "piece", "start", "n_tokens", "container"]]

        for b in batches:
            waiting.append(b)
            n += len(b)
            if n >= window:
                yield flush()
                waiting, n = [], 0
        if n:
            yield flush()

    return run


def pack(docs: DataFrame, ident: str, text: str, size: str | None = None, capacity: int = CAPACITY, window: int = WINDOW, most_open: int = OPEN) -> DataFrame:
    """(id, piece, start, n_tokens, container): every text, or piece of a text above the capacity, in its container."""
    keyed = stored(curve(docs, ident, text, size), "curve")
    full = F.call_function("div", F.greatest(F.col("size") - 1, F.lit(0)), F.lit(capacity)).cast("int")
    pieces = keyed.select("id", "key", F.explode(F.transform(F.sequence(F.lit(0), full), lambda k: F.struct(
        k.alias("piece"), (k.cast("long") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("size") - k.cast("long") * capacity).alias("n_tokens")))).alias("p")).select("id", "key", "p.*")
    ordered = pieces.repartitionByRange("key", "id", "piece").sortWithinPartitions("key", "id", "piece")
    return ordered.mapInPandas(_pack(capacity, window, most_open), "id long, piece int, start long, n_tokens long, container long")
