"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece is encoded by halves; two encodings are joined by re-encoding a window of tokens around the
boundary, which grows until the tokens outside provably stay. The proof: a token sequence is the
encoding of its bytes exactly if each adjacent pair of tokens is the encoding of that pair's bytes,
for merges cross a boundary only where they would do so in the two tokens alone. So a window is wide
enough as soon as its first and last tokens go with their neighbours outside. Decoding concatenates
the tokens' bytes, which is the same reduction with plain concatenation as its operation.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import byte_texts, in_rows, texts, worker_cache

#: Pieces, halves and pairs held by a worker; beyond this a cache starts anew.
MOST = 300_000
#: Longer pieces are not held.
LONGEST = 48


class TreeEncoder:
    """Encodes and decodes with a rank file (base64 token, rank), each match of `pattern` separately."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def direct(self, data: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost of equals: for windows."""
        ranks = self.ranks
        if len(data) <= 48:
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 1:
                low, at = None, 0
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (low is None or r < low):
                        low, at = r, i
                if low is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return tuple(map(ranks.__getitem__, parts))
        n = len(data)
        end, start = list(range(1, n + 1)), list(range(n + 1))  # of the part that begins, or ends, there
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        start[1:] = range(n)
        while heap:
            _, i, k = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != k:
                continue
            alive[end[i]] = False
            end[i] = k
            start[k] = i
            if k < n and (r := ranks.get(data[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
            if i and (r := ranks.get(data[start[i] : k])) is not None:
                heapq.heappush(heap, (r, start[i], k))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def goes(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the encoding of their bytes."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * MOST:
                self.pairs.clear()
            known = self.pairs[key] = self.direct(self.bytes[a] + self.bytes[b]) == (a, b)
        return known

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of both."""
        if not a or not b or self.goes(a[-1], b[0]):
            return a + b
        k = 1
        while True:
            left, right = a[-k:], b[:k]
            window = self.direct(self.decode(left + right))
            if (k >= len(a) or self.goes(a[-k - 1], window[0])) and (k >= len(b) or self.goes(window[-1], b[k])):
                return a[:-k] + window + b[k:]
            k *= 2

    def reduce(self, data: bytes) -> tuple[int, ...]:
        """Halves, encoded and joined. Short halves come again and again and are held."""
        known = self.halves.get(data)
        if known is None:
            if len(data) == 1:
                known = (self.ranks[data],)
            else:
                m = len(data) >> 1
                known = self.join(self.reduce(data[:m]), self.reduce(data[m:]))
            if len(data) <= 12:
                if len(self.halves) > MOST:
                    self.halves.clear()
                self.halves[data] = known
        return known

    def piece(self, text: str) -> tuple[int, ...]:
        """A match of the pattern; one that is a token as a whole is that token."""
        data = text.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.reduce(data)

    def encode(self, text: str) -> list[int]:
        found = self.pattern.findall(text)
        cache = self.pieces
        out = list(map(cache.get, found))
        if None in out:
            if len(cache) > MOST:
                cache.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    p = found[i]
                    ids = out[i] = cache.get(p) or self.piece(p)
                    if len(p) <= LONGEST:
                        cache[p] = ids
        return list(chain.from_iterable(out))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def encoder(path: str, pattern: str) -> TreeEncoder:
    held = worker_cache("bpe")
    if (path, pattern) not in held:
        held[path, pattern] = TreeEncoder(path, pattern)
    return held[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """Per row of docs: doc_id, ids (array of int) and, if asked for, decoded (the bytes of those ids).

    path: a rank file that every executor has. A null text counts as empty and has no ids. Special strings
    are ordinary text. Repeated rows and null ids are treated like any other; no rows give no rows. Only
    doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in in_rows(batches, 128):
            found = [np.array(e.encode(t.decode()), np.int32) for t in byte_texts(b)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
            columns = [b.column("doc_id"), ids]
            if decoded:
                columns.append(pa.array([e.decode(x.tolist()) for x in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded (binary) from doc_id and ids; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in in_rows(batches, 128):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([e.decode(x or ()) for x in b.column("ids").to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
