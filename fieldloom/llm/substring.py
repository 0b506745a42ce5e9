"""Substring dedup by level-wise doubling over word windows.

Level by level, windows of a length that occur in one document alone are given up, and only what
repeats is looked at at twice the length: 13, 25, then 50 words by default (halves are rounded up).
A window is named by combining the names of its two halves. The lower levels look at one window in
each place where a full-length window could be (its minimiser, so equal full-length windows look at
equal places); what repeats there is kept as a bitmap of fixed size, whose false positives only
leave more work to the next level. At the last level every surviving window is compared by a 128-bit
name, made of two independent hashes of its words, and the smallest doc_id that holds it is found.

A window that many documents share is settled where it is read: a task sends on the rows of the smallest
id alone, and what it knows to go travels by its document, not by its window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, bucketed, by_bucket, byte_texts, give_back, ids, in_rows, in_worker, materialise, pack, shuffle_partitions, texts, unpack, worker_cache

WORDS = 50
#: Bits of a level's bitmap: 16 MB, whatever the input.
FILTER_BITS = 27
#: A task hands on what it has found after so many windows, in batches of about so many bytes.
HELD, BATCH = 250_000, 4 << 20
#: Whose caches a Python worker holds.
OWNER = "substring"

_A, _B, _C = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0x9E3779B97F4A7C15, 0xC4CEB9FE1A85EC53))


def levels(words: int = WORDS, least: int = 13) -> list[int]:
    """Window lengths, shortest first; each is at most twice the one before."""
    out = [words]
    while out[0] > least:
        out.insert(0, -(-out[0] // 2))
    return out


def word_names(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word. Hashing costs less than a cache of names would, and holds nothing."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def second_names(words: list[bytes]) -> np.ndarray:
    """Another hash of each word, independent of the first."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _join(left: np.ndarray, right: np.ndarray, salt: np.uint64) -> np.ndarray:
    z = (left ^ (left >> np.uint64(31))) * _A + (right ^ (right >> np.uint64(29))) * salt
    return z ^ (z >> np.uint64(32))


def window_names(names: np.ndarray, length: int, salt: np.uint64 = _B) -> np.ndarray:
    """Names of all windows of a length, from names of windows of half that length."""
    if length == 1:
        return names * salt ^ (names >> np.uint64(27))
    if len(names) < length:
        return np.empty(0, np.uint64)
    half = -(-length // 2)
    h = window_names(names, half, salt)
    n = len(names) - length + 1
    return _join(h[:n], h[length - half : length - half + n], salt)


def _lowest(a: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value (the first of equals) among each `width` consecutive ones."""
    n = len(a) - width + 1
    at, span = np.arange(len(a)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(a[right] < a[left], right, left)
        span += step
    return at[:n]


def _spread(hashes: np.ndarray) -> np.ndarray:
    """The names of minimisers are small numbers; this spreads them over all buckets and slots."""
    return (hashes ^ (hashes >> np.uint64(33))) * _C


def _set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    hashes = _spread(hashes)
    slot = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def survivors(names: np.ndarray, words: int, found: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Starts of the full-length windows that every level so far has kept."""
    starts = np.arange(max(0, len(names) - words + 1))
    for length, bitmap in found:
        if not len(starts):
            break
        h = window_names(names, length)
        at = _lowest(h, words - length + 1)[starts]
        ok = np.zeros(len(h), bool)
        u = np.unique(at)
        ok[u] = _set(bitmap, h[u])
        starts = starts[ok[at]]
    return starts


def _blobs(parts: list[tuple[np.ndarray, ...]], buckets: int, by: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Held arrays as one row for each bucket, in small batches; by: the hashes that choose it, or else the first array."""
    arrays = [np.concatenate(x) for x in zip(*parts, strict=True)]
    if not len(arrays[0]):
        return
    order, b = bucketed(arrays[0] if by is None else by, buckets)
    b = b[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    keys, rows, size = [], [], 0
    for s, e in zip(cuts, [*cuts[1:], len(b)], strict=True):
        keys.append(int(b[s]))
        rows.append(pack(*(a[order[s:e]] for a in arrays)))
        size += len(rows[-1])
        if size >= BATCH or e == len(b):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "payload"])
            keys, rows, size = [], [], 0


def _ends(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of (name, id): each name's smallest and greatest id."""
    h, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.r_[True, h[1:] != h[:-1]]
    keep = new | np.r_[new[1:], True]
    return h[keep], doc[keep]


def _level(docs: DataFrame, words: int, length: int, found, buckets: int) -> DataFrame:
    """(bucket, slice): the bitmap of the level's windows that occur in more than one document."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, before = [], 0, [(k, m.value) for k, m in found]
        before = [(k, np.frombuffer(m, np.uint8)) for k, m in before]
        for batch in in_rows(batches):
            for doc, text in zip(ids(batch), byte_texts(batch), strict=True):
                names = word_names(text.split())
                starts = survivors(names, words, before)
                if len(starts):
                    h = window_names(names, length)
                    h = _spread(np.unique(h[_lowest(h, words - length + 1)[starts]]))
                    parts.append((h, np.full(len(h), doc)))
                    held += len(h)
            if held >= HELD:
                yield from _blobs([_ends(parts)], buckets)
                parts, held = [], 0
        if held:
            yield from _blobs([_ends(parts)], buckets)

    width = (1 << FILTER_BITS) // buckets

    def repeated(_, bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, doc = (np.concatenate(x) for x in zip(*map(unpack, payloads), strict=True))
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        more = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        slot = (h[first[more]] >> np.uint64(64 - FILTER_BITS)).astype(np.int64) - bucket * width
        if not len(slot):
            return
        bits = np.zeros(width, np.uint8)
        bits[slot] = 1
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bucket", "slice"])

    return by_bucket(docs.mapInArrow(in_worker(OWNER, look), "bucket int, payload binary"), buckets, repeated, "bucket int, slice binary", owner=OWNER)


def _last(docs: DataFrame, words: int, found, buckets: int) -> DataFrame:
    """(doc_id, starts): windows that also start in a document with a smaller id; starts are packed int32."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, before = [], 0, [(k, m.value) for k, m in found]
        before = [(k, np.frombuffer(m, np.uint8)) for k, m in before]

        def hand_on() -> Iterator[pa.RecordBatch]:
            # Of equal windows held here, those of the smallest id go on; the others are known to go.
            h, g, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.lexsort((doc, g, h))
            first = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
            low = np.empty(len(h), np.int64)
            low[order] = np.repeat(doc[order][first], np.diff(np.r_[first, len(h)]))
            known = doc > low
            gone, rest = (doc[known], at[known]), tuple(x[~known] for x in (h, g, doc, at))
            del h, g, doc, at, order, first, low, known
            yield from _homes(*gone, True)
            yield from _blobs([rest], buckets)

        for batch in in_rows(batches):
            for doc, text in zip(ids(batch), byte_texts(batch), strict=True):
                names = word_names(text.split())
                starts = survivors(names, words, before)
                if len(starts):
                    parts.append((window_names(names, words)[starts], window_names(second_names(text.split()), words, _C)[starts], np.full(len(starts), doc), starts))
                    held += len(starts)
            if held >= HELD:
                yield from hand_on()
                held = 0
        if held:
            yield from hand_on()

    def _homes(doc: np.ndarray, at: np.ndarray, decided: bool) -> Iterator[pa.RecordBatch]:
        """Windows that go, by their document; decided ones pass the judge in buckets below zero."""
        order = np.lexsort((at, doc))
        for batch in _blobs([(doc[order], at[order])], homes, doc[order].view(np.uint64) * _A):
            bucket = pa.array(-1 - batch.column("bucket").to_numpy(), pa.int32()) if decided else batch.column("bucket")
            yield pa.RecordBatch.from_arrays([bucket, batch.column("payload")], names=["bucket", "payload"])

    def judge(state: list, bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        if bucket < 0:
            yield pa.RecordBatch.from_arrays([pa.array([-1 - bucket] * len(payloads), pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])
            return
        h, g, doc, at = (np.concatenate(x) for x in zip(*map(unpack, payloads), strict=True))
        order = np.lexsort((g, h))
        first = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
        low = np.empty(len(h), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.r_[first, len(h)]))
        gone = doc > low
        state.append((doc[gone], at[gone]))
        if sum(len(x[0]) for x in state) >= HELD:
            yield from pass_on(state)

    def pass_on(state: list) -> Iterator[pa.RecordBatch]:
        if state:
            doc, at = (np.concatenate(x) for x in zip(*state, strict=True))
            state.clear()
            yield from _homes(doc, at, False)

    def gather(_, __, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc, at = (np.concatenate(x) for x in zip(*map(unpack, payloads), strict=True))
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order].astype(np.int32)
        cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rows = [at[s:e].tobytes() for s, e in zip(cut, [*cut[1:], len(doc)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(rows, pa.binary())], names=["doc_id", "starts"])

    homes = max(1, buckets // 4)
    judged = by_bucket(docs.mapInArrow(in_worker(OWNER, look), "bucket int, payload binary"), buckets, judge, "bucket int, payload binary", pass_on, OWNER)
    return by_bucket(judged, homes, gather, "doc_id long, starts binary", owner=OWNER)


def repeated_starts(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, starts): for each document with such windows, the packed int32 starts of its windows of `words`
    words whose word sequence also starts in a document with a smaller doc_id."""
    spark = docs.sparkSession
    docs = texts(docs)
    buckets = 1 << max(4, (4 * shuffle_partitions(spark) - 1).bit_length())
    found: list = []
    for length in levels(words)[:-1]:
        bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        width = len(bitmap) // buckets
        for row in _level(docs, words, length, found, buckets).collect():
            bitmap[row["bucket"] * width : (row["bucket"] + 1) * width] |= np.frombuffer(row["slice"], np.uint8)
        found.append((length, spark.sparkContext.broadcast(bitmap.tobytes())))
    starts = materialise(_last(docs, words, found, buckets), "starts")
    for _, shared in found:
        shared.destroy()
    give_back()
    return starts


def cut(text: bytes, starts: bytes, words: int) -> tuple[bytes, int, int]:
    """Kept words joined by one space, the number of words, and of removed ones."""
    w = text.split()
    if not starts:
        return b" ".join(w), len(w), 0
    at = np.frombuffer(starts, np.int32)
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + words, -1)
    gone = np.cumsum(cover)[: len(w)] > 0
    return b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g]), len(w), int(gone.sum())


def remove_repeats(docs: DataFrame, words: int = WORDS, prefix: str = "") -> DataFrame:
    """docs with the columns kept_text, n_words and n_removed added (names may be given a prefix).

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, a null text has none. A word goes if a window of
    `words` consecutive words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the input. Rows with equal ids never remove each other's words. A null id counts as
    larger than every other. Texts of fewer words are kept. kept_text has the kept words joined by one
    space. No rows give no rows; other columns pass through, but one with the name of an added column is replaced.
    """
    runs = repeated_starts(docs, words)
    kind = T.StructType([T.StructField("t", T.StringType()), T.StructField("n", T.LongType()), T.StructField("r", T.LongType())])

    @F.arrow_udf(kind)
    def trimmed(text: pa.Array, starts: pa.Array) -> pa.Array:
        worker_cache(OWNER)
        wide = pa.types.is_large_string(text.type)
        out = [cut(t or b"", s or b"", words) for t, s in zip(text.cast(pa.large_binary() if wide else pa.binary()).to_pylist(), starts.to_pylist(), strict=True)]
        kept = pa.array([x[0] for x in out], pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([kept, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["t", "n", "r"])

    key, blob, made = "__substring_id", "__substring_starts", "__substring_out"
    right = runs.select(F.col("doc_id").alias(key), F.col("starts").alias(blob)).hint("shuffle_hash")
    all_ = docs.join(right, F.coalesce(docs["doc_id"].cast("long"), F.lit(int(NULL_ID))) == right[key], "left")
    return all_.withColumn(made, trimmed(docs["text"], F.col(blob))).select(
        *(docs[c] for c in docs.columns if c not in {f"{prefix}{x}" for x in ("kept_text", "n_words", "n_removed")}), F.col(f"{made}.t").alias(f"{prefix}kept_text"), F.col(f"{made}.n").alias(f"{prefix}n_words"), F.col(f"{made}.r").alias(f"{prefix}n_removed")
    )


def removals(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed of every row: remove_repeats() without the other columns."""
    return remove_repeats(docs.select("doc_id", "text"), words).select("doc_id", "kept_text", "n_words", "n_removed")
