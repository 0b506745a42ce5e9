"""Cost-balanced packing of documents into fixed-length training sequences.

A piece of n tokens costs n + n * n / SCALE: attention over the sequence is linear in its length for
the dense layers and quadratic within each document. Pieces, longest first, go to the sequence of
lowest cost that has room. Each task packs the documents it reads in blocks of a few million tokens,
so nothing is shuffled, a worker holds one block, and a lost task repeats its own block alone.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE, byte_texts, in_rows, texts
from .wordcache import packed_ids

CAPACITY = 2048
#: A piece of this many tokens costs twice its linear part.
SCALE = 512
#: Tokens of a block.
BLOCK = 4_000_000


def cost(n: int) -> float:
    return n + n * n / SCALE


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; documents are numbered as given.

    As many sequences are opened as the tokens need. Whole multiples of the capacity fill sequences of
    their own; then each rest, longest first, goes to the sequence of lowest cost with room for it. A
    rest that no sequence has room for is cut over those with the most room, so only the last of the
    block's sequences can stay short, by less than one capacity altogether.
    """
    out: list[tuple[int, int, int, int, int]] = []
    rest, number = [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((d, start, capacity, number, 0))
            number += 1
        if n % capacity:
            rest.append((n % capacity, d))
    rest.sort(key=lambda x: (-x[0], x[1]))
    bins = -(-sum(n for n, _ in rest) // capacity)
    used, paid = [0] * bins, [0.0] * bins
    ready = [(0.0, b) for b in range(bins)]  # a heap of (cost, sequence) with room for the piece at hand
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room, of those with too little
    size = capacity

    def put(b: int, d: int, start: int, n: int) -> None:
        out.append((d, start, n, number + b, used[b]))
        used[b] += n
        paid[b] += cost(n)

    late = []
    for n, d in rest:
        while size > n:
            size -= 1
            for b in waiting[size]:
                heapq.heappush(ready, (paid[b], b))
            waiting[size] = []
        if not ready:
            late.append((n, d))
            continue
        b = heapq.heappop(ready)[1]
        put(b, d, lengths[d] - n, n)
        room = capacity - used[b]
        if room >= size:
            heapq.heappush(ready, (paid[b], b))
        elif room:
            waiting[room].append(b)
    if late:
        room = [(used[b] - capacity, b) for b in range(bins) if used[b] < capacity]
        heapq.heapify(room)
        for n, d in late:
            while n:
                free, b = heapq.heappop(room)
                take = min(n, -free)
                put(b, d, lengths[d] - n, take)
                n -= take
                if take < -free:
                    heapq.heappush(room, (free + take, b))
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, block: int = BLOCK, with_ids: bool = True, words: int = 3 * CACHE) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids (binary,
    little-endian unsigned 32-bit).

    A document's ids are the tokenizer's, without special tokens added, then end_id; so an empty or null
    text has one id. Each row of docs is packed by itself, repeated rows and null ids too. Offsets of a
    sequence have no gaps; sequence_id is unique (the task's number and the sequence's number in it). No
    rows give no rows. Only doc_id and text are read. tokenizer: path of a tokenizers JSON file that
    every executor has. words: bytes of words and their ids that a Python worker holds, about; fewer cost time.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, tokens = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            lengths = [len(x) // 4 for _, x in held]
            pieces = assign(lengths, capacity)
            for s in range(0, len(pieces), 20_000):
                part = pieces[s : s + 20_000]
                d, start, length, sequence, offset = map(list, zip(*part, strict=True))
                ids = [memoryview(held[x][1])[4 * a : 4 * (a + n)] for x, a, n in zip(d, start, length, strict=True)]
                columns = [
                    pa.array([held[x][0] for x in d], pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([lengths[x] for x in d], pa.int64()),
                    pa.array([base + x for x in sequence], pa.int64()),
                    pa.array(offset, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(map(bytes, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids)
            base += max((p[3] for p in pieces), default=-1) + 1

        for batch in in_rows(batches, 256):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), packed_ids(byte_texts(batch), tokenizer, words), strict=True):
                held.append((doc, ids + end))
                tokens += len(ids) // 4 + 1
            if tokens >= block:
                yield from flush()
                held, tokens = [], 0
        if held:
            yield from flush()

    return texts(docs).mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """Per sequence: sequence_id, length, n_pieces, cost and ids (binary) of pack_documents()' pieces in order."""
    each = F.struct("offset", "length", "ids")
    by = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n_pieces"), F.sum(F.col("length") + F.col("length") * F.col("length") / SCALE).alias("cost"), F.array_sort(F.collect_list(each)).alias("__p"))
    return by.select("sequence_id", "length", "n_pieces", "cost", F.unhex(F.array_join(F.transform("__p", lambda p: F.hex(p["ids"])), "")).alias("ids"))
