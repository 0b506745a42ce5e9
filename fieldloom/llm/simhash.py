"""SimHash near-duplicates through an inverted index over byte positions.

A fingerprint has eight positional bytes. Two fingerprints with at most two differing bits share
at least six of them, so a pair's tally of shared positional bytes must reach six. A posting list
is therefore keyed by six positions and their bytes (28 lists a fingerprint): every pair that can
reach the minimum meets in a list, and a list holds at most 65,536 distinct fingerprints whatever the
input. Each pair that meets is tallied over all eight positions and then verified by its bits. As the
lists are keyed by the minimum itself, the tally only rejects pairs whose keys clash by chance: lists
over single positions, where it would do more, would each hold a 256th of all rows and so make a
quadratic number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, materialise, shuffle_partitions, texts, worker_cache
from .components import connected

BITS, SHARED = 2, 6
LISTS = tuple(combinations(range(8), SHARED))
#: Lists up to this long are compared pair by pair; longer ones by looking up each fingerprint's near values.
PAIRWISE = 256


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; zero for a text without words."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) > words else [b" ".join(w)]
    xx = xxhash.xxh64_intdigest
    h = np.fromiter((xx(s, seed) for s in shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 32768):
        counts += np.unpackbits(h[i : i + 32768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for b in batches:
            fp = np.fromiter(map(fingerprint, byte_texts(b)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def postings(fps: DataFrame) -> DataFrame:
    """(key, fp): the 28 posting lists of each fingerprint."""
    masks = [np.uint64(sum(0xFF << (8 * p) for p in places)) for places in LISTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            keys = []
            for number, mask in enumerate(masks):
                x = (fp & mask) ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                keys.append(x)  # a bijection of the six bytes for each list; lists meet by chance at most
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp, len(masks)).view(np.int64))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def near(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Count filter, then verification: six shared positional bytes, then at most `bits` differing bits."""
    diff = a ^ b
    tally = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = tally >= SHARED
    ok[ok] = np.bitwise_count(diff[ok]) <= bits
    return ok


def _links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one list, found in time linear in a long list's length."""
    fp = np.unique(fp)
    if len(fp) <= PAIRWISE:
        i, j = np.triu_indices(len(fp), 1)
        ok = near(fp[i], fp[j])
        return fp[j[ok]], fp[i[ok]]
    left, right = [], []
    free = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [1 << k for k in range(64) if free >> k & 1]
    for m in [*bits, *(x | y for x, y in combinations(bits, 2))]:
        other = fp ^ np.uint64(m)
        at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
        ok = (fp[at] == other) & (other < fp)
        ok[ok] = near(fp[ok], other[ok])
        left.append(fp[ok])
        right.append(other[ok])
    return np.concatenate(left), np.concatenate(right)


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many links as join the same fingerprints; each to the smallest it reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame) -> DataFrame:
    """(u, v) between distinct fingerprints: links that join whatever the 2-bit links join.

    No pair of a list is emitted as such: within what a task holds, links are thinned to a spanning set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def pairs(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            size = np.diff(np.r_[first, len(key)])
            us, vs = [], []
            for n in np.unique(size[(size > 1) & (size <= 8)]):
                start = first[size == n]
                for i, j in combinations(range(int(n)), 2):
                    a, b = fp[start + i], fp[start + j]
                    ok = near(a, b)
                    us.append(a[ok])
                    vs.append(b[ok])
            for s, n in zip(first[size > 8], size[size > 8], strict=True):
                u, v = _links(fp[s : s + n])
                us.append(u)
                vs.append(v)
            if us and sum(map(len, us)):
                u, v = _spanning(np.concatenate(us), np.concatenate(vs))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            key = np.concatenate([key, b.column("key").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last list may go on in the next batch
            if cut >= 200_000:
                yield from pairs(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        yield from pairs(key, fp)

    lists = postings(fps).repartition(shuffle_partitions(fps.sparkSession), "key").sortWithinPartitions("key")
    return lists.mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links between fingerprints that differ in at
    most two bits; rows with equal fingerprints are linked. A null text counts as empty; texts without
    words have fingerprint zero and are linked like any other. A null id is never a component_id
    unless its component has no other. No rows give no rows. Only doc_id and text are read.
    """
    rows = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = materialise(connected(links(distinct)), "roots")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = materialise(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    of = materialise(named.join(lowest, "root").select("fp", "component_id"), "components")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the smallest doc_id; every column stays. Rows with null ids stay."""
    gone = near_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)
