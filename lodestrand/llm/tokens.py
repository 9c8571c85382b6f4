"""Byte-level BPE over a whole corpus with a public vocabulary.

The distinct pieces of a batch are encoded together: they are sorted into length buckets, each a padded matrix of ids; a
round finds every row's smallest pair rank by hashed lookup, merges the leftmost pair of that rank (and its further
occurrences that do not overlap it, which the rank order would merge next anyway), closes the gaps, and drops the rows
that are done. Texts are then put together from their pieces' ids.

Empty and null texts have the empty list; names of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the driver finds the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("LODESTRAND_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into pieces, with white space by its Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = np.int32(2**31 - 1)
#: Matrix cells handled at once, and pieces remembered by a worker.
CELLS, REMEMBERED = 1 << 20, 300_000
BUCKETS = [4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 1024, 2048, 4096, 8192]


class PairTable:
    """An open-addressing hash table from a pair of ids to the id of their join."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.bits = max(4, int(2 * max(len(pairs), 1)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        left = np.fromiter(pairs.keys(), np.int64, len(pairs))
        vals = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(left)
        while len(left):
            free = self.keys[at] == -1
            slot, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[slot], self.vals[slot] = left[chosen], vals[chosen]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, vals, at = left[rest], vals[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the pairs (``a``, ``b``); ``NONE`` where they do not join or an id is below 0."""
        key = a.astype(np.int64) << 20 | b.astype(np.int64)
        key[(a < 0) | (b < 0)] = -2
        at = self._slot(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.vals[at], NONE)
        open_ = np.flatnonzero((seen != key) & (seen != -1) & (key >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.vals[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


class Bpe:
    """A vocabulary of ranks, whose ids are the ranks."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.table = PairTable(self.ranks)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.cut = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge(self, rows: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(rows)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            size = int(sizes[order[at]])
            cap = next((b for b in BUCKETS if b >= size), size)
            end = at + int(np.searchsorted(sizes[order[at:]], cap, "right"))
            width = int(sizes[order[end - 1]])
            end = min(end, at + max(1, CELLS // max(width, 1)))
            width = int(sizes[order[end - 1]])
            self._matrix(rows, order[at:end], sizes, width, out)
            at = end
        return out

    def _matrix(self, rows: list[bytes], which: np.ndarray, sizes: np.ndarray, width: int, out: list[np.ndarray]) -> None:
        n = sizes[which]
        ids = np.full((len(which), max(width, 1)), -1, np.int32)
        ids[np.arange(ids.shape[1]) < n[:, None]] = self.byte[np.frombuffer(b"".join(rows[i] for i in which), np.uint8)]
        rank = np.full(ids.shape, NONE, np.int32)
        rank[:, :-1] = self.table(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(which), -1)
        while True:
            low = rank.min(1)
            done = low == NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[which[r]] = ids[r, : n[r]].copy()
                if done.all():
                    return
                keep = ~done
                ids, rank, n, which, low = ids[keep], rank[keep], n[keep], which[keep], low[keep]
            same = rank == low[:, None]
            if (same[:, 1:] & same[:, :-1]).any():  # of a run of overlapping pairs every other one
                place = np.arange(same.shape[1])
                begins = same.copy()
                begins[:, 1:] &= ~same[:, :-1]
                same &= (place - np.maximum.accumulate(np.where(begins, place, 0), axis=1)) % 2 == 0
            ids = np.where(same, low[:, None], ids)
            stay = np.arange(ids.shape[1]) < n[:, None]
            stay[:, 1:] &= ~same[:, :-1]
            row, col = np.nonzero(stay)
            n = stay.sum(1)
            to = (np.cumsum(stay, axis=1) - 1)[row, col]
            ids2 = np.full((len(n), int(n.max())), -1, np.int32)
            rank2 = np.full(ids2.shape, NONE, np.int32)
            changed = np.zeros(ids2.shape, bool)
            ids2[row, to], rank2[row, to], changed[row, to] = ids[row, col], rank[row, col], same[row, col]
            changed[:, :-1] |= changed[:, 1:]
            r, c = np.nonzero(changed)
            right = np.where(c + 1 < ids2.shape[1], ids2[r, np.minimum(c + 1, ids2.shape[1] - 1)], -1)
            rank2[r, c] = self.table(ids2[r, c], right)
            ids, rank = ids2, rank2

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids begin (one more than texts)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        known, new, words, counts = self.known, [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                pieces = self.cut(t)
                counts[i] = len(pieces)
                for p in pieces:
                    k = known.get(p)
                    if k is None:
                        k = known[p] = len(known)
                        new.append(p)
                    words.append(k)
        if new:
            parts = self.merge([p.encode() for p in new])
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.concatenate([[0], np.cumsum(sizes)[:-1]])])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, *parts])
        w = np.fromiter(words, np.int64, len(words))
        size = self.sizes[w]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) - np.repeat(ends - size, size) + np.repeat(self.starts[w], size)
        before = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.concatenate([[0], ends])[before]
        return self.flat[at], bounds


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The vocabulary of a file, once a worker."""
    return Bpe(path)


def encode(df: DataFrame, key: str, column: str, path: str | None = None, batch_chars: int = 1 << 21) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row; rows with equal keys give a row each."""
    file = path or os.path.join(TOKENIZERS, VOCABULARY)
    df.sparkSession.sparkContext.addFile(file)  # the workers get it from the driver
    name = os.path.basename(file)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(SparkFiles.get(name))
        for b in batches:
            texts = b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= batch_chars):
                    chars += len(texts[end] or "")
                    end += 1
                flat, bounds = bpe.encode(texts[at:end])
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), ids], names=[key, "ids"])
                at = end

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(column)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
