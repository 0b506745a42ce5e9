"""N-gram language model in an Elias-Fano trie.

Level 1 is the vocabulary. An entry of level n is a context, namely the place of an entry of level
n - 1, and a word that followed it. As contexts are places, the pairs (context, word) of a level
increase from each context's successors to the next one's: one monotone sequence, which Elias-Fano
coding stores in about two bits and the low bits an entry. A query walks down: the place of (context,
word) is found among the context's successors and is the context one level further. Beside its
sequence a level keeps one byte for each entry's discounted probability and one for each context's
weight of the shorter history, both rounded down, so that no distribution sums to over one.

P(w | h) = max(c(h, w) - D, 0) / c(h) + D T(h) / c(h) P(w | shorter h), T: distinct successors; D is
n1 / (n1 + 2 n2) of the level's counts of counts. Single words have (c + 1) / (N + V + 1), which also
covers any unknown word. Levels are cut into files by ranges of (context, word) that are about equally
full, a frequent context over several ones, and workers map the files from the shared folder.
"""

from __future__ import annotations

import mmap
import os
import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, by_bucket, byte_texts, in_rows, scratch_dir, shuffle_partitions, texts, worker_cache

ORDER = 3
#: Tokens looked at together.
BATCH = 1_000_000
#: Keys looked up together: what is worked out for them stays in a processor's cache.
CHUNK = 1 << 14
#: Ends each text; no word holds a space.
END = b" "


def tokens(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, then one end."""
    return [*text.lower().split(), END]


def distinct(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each token, in order, the place of its word among the distinct ones; the distinct words' hashes."""
    flat = pa.array(list(chain.from_iterable(docs)), pa.large_binary()).dictionary_encode()
    n = len(flat.dictionary)
    _, ends, data = flat.dictionary.buffers()
    body = data.to_pybytes() if data else b""
    ends = np.frombuffer(ends, np.int64, n + 1).tolist() if n else [0]
    h = np.fromiter((xxhash.xxh3_64_intdigest(body[a:b]) for a, b in pairwise(ends)), np.uint64, n)
    return flat.indices.to_numpy(zero_copy_only=False), h


# ---- Elias-Fano ----------------------------------------------------------------------------------------------------


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays that can be mapped; it appears whole or not at all."""
    arrays = {k: np.ascontiguousarray(v) for k, v in arrays.items()}
    at, where = 0, {}
    for k, v in arrays.items():
        where[k] = (at, v.dtype.str, len(v))
        at += -(-v.nbytes // 8) * 8
    head = pickle.dumps(where)
    with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head + b"\0" * (-len(head) % 8))
        for v in arrays.values():
            f.write(v.tobytes() + b"\0" * (-v.nbytes % 8))
    os.replace(f.name, path)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(m[:8], "little")
    base = 8 + n + -n % 8
    return {k: np.frombuffer(m, np.dtype(kind), count, base + at) for k, (at, kind, count) in pickle.loads(m[8 : 8 + n]).items()}


def encode(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Elias-Fano code of an increasing sequence of int64: low bits packed, high bits in unary, and the number of
    zeros before each word of the unary part."""
    base = int(keys[0]) if len(keys) else 0
    x = (keys - base).astype(np.uint64)
    n, top = len(x), int(x[-1]) if len(x) else 0
    bits = max(0, (top // max(n, 1)).bit_length() - 1)
    low = np.zeros(-(-n * bits // 64) + 1, np.uint64)
    if bits:
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        value, word, shift = x & np.uint64((1 << bits) - 1), (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(low, word, value << shift)
        over = shift + np.uint64(bits) > 64
        np.bitwise_or.at(low, word[over] + 1, value[over] >> (np.uint64(64) - shift[over]))
    high = (x >> np.uint64(bits)).astype(np.int64)
    ones = high + np.arange(n)
    size = (int(high[-1]) if n else 0) + n + 1
    unary = np.zeros(-(-size // 64) * 64, np.uint8)
    unary[ones] = 1
    words = np.packbits(unary, bitorder="little").view(np.uint64)
    zeros = np.r_[0, np.cumsum(64 - np.bitwise_count(words).astype(np.int64))].astype(np.uint32 if size < 1 << 32 else np.uint64)
    return {"low": low, "high": words, "zeros": zeros, "shape": np.array([base, n, bits, top], np.int64)}


_U = np.uint64
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the r-th set bit (from 0) of a byte, at 8 * byte + r.
_SELECT = np.array([([k for k in range(8) if byte >> k & 1] + [0] * 8)[r] for byte in range(256) for r in range(8)], np.int64)


def _zero(code: dict, k: np.ndarray) -> np.ndarray:
    """Position of the k-th zero (from 0) of the unary part."""
    word = np.searchsorted(code["zeros"], k.astype(code["zeros"].dtype), side="right") - 1
    w = ~code["high"][word]
    rest = (k - code["zeros"][word].astype(np.int64)).astype(_U)
    # Bits set in each byte, then up to each byte; the bytes that end before the wanted bit; the bit in the next one.
    c = w - ((w >> _U(1)) & _U(0x5555555555555555))
    c = (c & _U(0x3333333333333333)) + ((c >> _U(2)) & _U(0x3333333333333333))
    c = ((c + (c >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES
    byte = np.bitwise_count(((rest * _ONES | _TOPS) - c) & _TOPS).astype(_U) << _U(3)
    rest -= (c << _U(8)) >> byte & _U(0xFF)
    return word * 64 + byte.astype(np.int64) + _SELECT[((w >> byte & _U(0xFF)) << _U(3) | rest).astype(np.int64)]


def _ones_from(code: dict, at: np.ndarray) -> np.ndarray:
    """Number of ones from a position of the unary part to the next zero; 64 may stand for more."""
    word, shift = at >> 6, (at & 63).astype(_U)
    w = code["high"][word] >> shift
    more = np.flatnonzero((shift > 0) & (word + 1 < len(code["high"])))
    w[more] |= code["high"][word[more] + 1] << (_U(64) - shift[more])
    full = w == _U(0xFFFFFFFFFFFFFFFF)
    w[full] = 0
    n = np.bitwise_count(w ^ (w + _U(1))).astype(np.int64) - 1
    n[full] = 64
    return n


def _low(code: dict, bits: int, i: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), np.uint64)
    at = i * bits
    word, shift = at >> 6, (at & 63).astype(_U)
    # A value may go on in the next word, of which there is always one; shifted twice, as 64 is no shift.
    v = code["low"][word] >> shift | code["low"][word + 1] << _U(1) << (_U(63) - shift)
    return v & _U((1 << bits) - 1)


def find(code: dict, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sequence, or -1."""
    base, n, bits, top = map(int, code["shape"])
    out = np.full(len(keys), -1, np.int64)
    inside = np.flatnonzero((keys >= base) & (keys <= base + top)) if n else np.empty(0, np.int64)
    if not len(inside):
        return out
    x = (keys[inside] - base).astype(np.uint64)
    high, want = (x >> np.uint64(bits)).astype(np.int64), x & np.uint64((1 << bits) - 1)
    begin = np.zeros(len(high), np.int64)
    later = np.flatnonzero(high > 0)
    begin[later] = _zero(code, high[later] - 1) + 1
    start, run = begin - high, _ones_from(code, begin)
    long = np.flatnonzero(run >= 64)
    run[long] = _zero(code, high[long]) - begin[long]
    a = start.copy()  # the last of [start, start + run) whose low bits are not over the key's
    on = np.flatnonzero(run > 1)
    lo, hi, w = start[on], start[on] + run[on], want[on]
    while len(on):
        m = (lo + hi) >> 1
        over = _low(code, bits, m) > w
        lo, hi = np.where(over, lo, m), np.where(over, m, hi)
        live = hi - lo > 1
        if 2 * np.count_nonzero(live) <= len(on):
            a[on] = lo
            on, lo, hi, w = on[live], lo[live], hi[live], w[live]
    ok = np.flatnonzero(run > 0)
    ok = ok[_low(code, bits, a[ok]) == want[ok]]
    out[inside[ok]] = a[ok]
    return out


def squeeze(x: np.ndarray) -> bytes:
    """int64 as bytes: the first bytes of all values, then the second ones, and so on, in zstd."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unsqueeze(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def quantise(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte a value, rounded down on a logarithmic scale over the values' own range; code, (least bits, step)."""
    x = -np.log2(np.clip(p, 1e-300, 1.0))
    low, wide = (float(x.min()), float(x.max() - x.min())) if len(x) else (0.0, 0.0)
    step = wide / 255 or 1.0
    return np.ceil((x - low) / step - 1e-9).clip(0, 255).astype(np.uint8), np.array([low, step])


def dequantise(code: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.exp2(-(scale[0] + scale[1] * np.arange(256)))[code]


# ---- model ---------------------------------------------------------------------------------------------------------


class Model:
    """A trie in a folder: `meta` has the levels built so far. Made on each worker from the folder's path."""

    def __init__(self, folder: str, meta: dict):
        self.folder, self.meta = folder, meta
        v = meta["vocabulary"]
        self.hashes = np.memmap(f"{folder}/words", np.uint64, "r", shape=(max(v["size"], 1),))[: v["size"]]
        self.counts = np.memmap(f"{folder}/counts", np.int64, "r", shape=(max(v["size"], 1),))[: v["size"]]
        self.files: dict[tuple[int, int], dict] = {}

    def ids(self, docs: list[list[bytes]]) -> np.ndarray:
        """Word ids of all tokens, in order; unknown words have the vocabulary's size."""
        place, h = distinct(docs)
        size = len(self.hashes)
        order = np.argsort(h)
        at = np.empty(len(h), np.int64)
        at[order] = np.searchsorted(self.hashes, h[order])
        if size:
            at[self.hashes[np.minimum(at, size - 1)] != h] = size
        return at[place]

    def file(self, level: int, part: int) -> dict:
        if (level, part) not in self.files:
            self.files[level, part] = map_arrays(f"{self.folder}/level{level}-{part}")
        return self.files[level, part]

    def look(self, level: int, keys: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted keys of a level: place (-1: none), discounted probability, weight of the shorter history; with
        places, only the first."""
        meta = self.meta["levels"][level]
        place, p, weight = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.ones(len(keys))
        part = np.searchsorted(meta["bounds"], keys, side="right")
        if not len(keys):
            return place, p, weight
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for s, e in zip(cut, [*cut[1:], len(keys)], strict=True):
            b = int(part[s])
            if b not in meta["base"]:
                continue
            f = self.file(level, b)
            at = np.concatenate([find(f, keys[i : min(i + CHUNK, e)]) for i in range(s, e, CHUNK)])
            hit = np.flatnonzero(at >= 0)
            place[s + hit] = at[hit] + meta["base"][b]
            if places:
                continue
            p[s + hit] = dequantise(f["p"][at[hit]], f["p_scale"])
            c = (keys[s:e] >> self.meta["bits"]) - int(f["first"][0])
            some = np.flatnonzero((c >= 0) & (c < len(f["weight"])))
            got = f["weight"][c[some]]
            w = dequantise(np.maximum(got, 1) - 1, f["weight_scale"])
            weight[s + some] = np.where(got == 0, 1.0, w)
        return place, p, weight

    def keys(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        return contexts << self.meta["bits"] | words

    def contexts(self, ids: np.ndarray, starts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions from which the `level` - 1 tokens before are in the same text, and the place of those tokens in
        level - 1; the level's size stands for a history that was not seen."""
        where = np.arange(len(ids)) - starts
        at = ids
        for n in range(2, level):
            size = self.meta["levels"][n]["size"]
            ok = np.flatnonzero(where >= n - 1)
            found = np.full(len(ids), size, np.int64)
            k, back = np.unique(self.keys(at[ok - 1], ids[ok]), return_inverse=True)
            place = self.look(n, k, places=True)[0]
            found[ok] = np.where(place < 0, size, place)[back]
            at = found
        ok = np.flatnonzero(where >= level - 1)
        return ok, at[ok - 1]

    def score(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each token after those before it in its text."""
        v = self.meta["vocabulary"]
        c = np.where(ids < v["size"], self.counts[np.minimum(ids, max(v["size"] - 1, 0))] if v["size"] else 0, 0)
        p = (c + 1) / (v["total"] + v["size"] + 1)
        where, at = np.arange(len(ids)) - starts, ids
        for n in sorted(self.meta["levels"]):
            size = self.meta["levels"][n]["size"]
            ok = np.flatnonzero(where >= n - 1)
            k, back = np.unique(self.keys(at[ok - 1], ids[ok]), return_inverse=True)
            place, d, weight = self.look(n, k)
            p = p.copy()
            p[ok] = d[back] + weight[back] * p[ok]
            found = np.full(len(ids), size, np.int64)
            found[ok] = np.where(place < 0, size, place)[back]
            at = found
        return np.log10(p)


def model_of(folder: str, meta: dict) -> Model:
    held = worker_cache("n-grams")
    key = (folder, len(meta["levels"]))
    if key not in held:
        held.clear()
        held[key] = Model(folder, meta)
    return held[key]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]], np.ndarray]]:
    """doc_ids, tokens and, for each token, the place of its text's first one, about BATCH tokens at a time."""
    doc, found, n = [], [], 0

    def out():
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return doc, found, np.repeat(np.cumsum(sizes) - sizes, sizes)

    for b in in_rows(batches, 128):
        for d, t in zip(b.column("doc_id").to_pylist(), byte_texts(b), strict=True):
            doc.append(d)
            found.append(tokens(t))
            n += len(found[-1])
        if n >= BATCH:
            yield out()
            doc, found, n = [], [], 0
    if doc:
        yield out()


def _folder(spark) -> str:
    base = urlparse(scratch_dir(spark))
    if base.scheme not in ("", "file"):
        raise ValueError(f"the model's levels are mapped from files: spark.checkpoint.dir must be a mounted folder, not {base.scheme}")
    path = f"{unquote(base.path)}/{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _vocabulary(docs: DataFrame, folder: str, parts: int) -> dict:
    """Counts of all words; files `words` (hashes in order: a word's id is its place) and `counts`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()

        def blobs() -> Iterator[pa.RecordBatch]:
            words = np.array(list(got), object)
            n = np.fromiter(got.values(), np.int64, len(got))
            order, b = bucketed(np.fromiter(map(xxhash.xxh3_64_intdigest, got), np.uint64, len(got)), parts)
            b = b[order]
            cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            rows = [zlib.compress(pickle.dumps((b"\n".join(words[order[s:e]]), n[order[s:e]])), 1) for s, e in zip(cut, [*cut[1:], len(b)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(b[cut].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "payload"])

        for b in in_rows(batches, 128):
            for t in byte_texts(b):
                got.update(tokens(t))
            if len(got) > 400_000:
                yield from blobs()
                got.clear()
        if got:
            yield from blobs()

    def merge(_, bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for x in payloads:
            words, n = pickle.loads(zlib.decompress(x))
            for w, c in zip(words.split(b"\n"), n.tolist(), strict=True):
                total[w] += c
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, total), np.uint64, len(total))
        order = np.argsort(h)
        write_arrays(f"{folder}/vocabulary-{bucket}", {"h": h[order], "c": np.fromiter(total.values(), np.int64, len(total))[order]})
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(total)], pa.int64()), pa.array([sum(total.values())], pa.int64())], names=["bucket", "size", "total"])

    made = by_bucket(docs.mapInArrow(count, "bucket int, payload binary"), parts, merge, "bucket int, size long, total long").collect()
    made.sort()
    size, at, jobs = sum(r["size"] for r in made), 0, []
    for r in made:
        jobs.append((r["bucket"], at))
        at += r["size"]
    for name in ("words", "counts"):
        with open(f"{folder}/{name}", "wb") as f:
            f.truncate(max(size, 1) * 8)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, at in zip(b.column("part").to_pylist(), b.column("at").to_pylist(), strict=True):
                got = map_arrays(f"{folder}/vocabulary-{part}")
                for name, k in (("words", "h"), ("counts", "c")):
                    with open(f"{folder}/{name}", "r+b") as f:
                        f.seek(at * 8)
                        f.write(got[k].tobytes())
            yield b

    if jobs:
        spark = docs.sparkSession
        spark.createDataFrame(jobs, "part int, at long").repartition(min(len(jobs), shuffle_partitions(spark))).mapInArrow(place, "part int, at long").count()
        for part, _ in jobs:
            os.remove(f"{folder}/vocabulary-{part}")
    return {"size": size, "total": sum(r["total"] for r in made)}


def _level(docs: DataFrame, folder: str, meta: dict, level: int, parts: int) -> dict:
    """Count the level's entries, write its files, and return what Model needs to know of it."""
    spark, bits = docs.sparkSession, meta["bits"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        m = model_of(folder, meta)
        for _, found, starts in _batches(batches):
            ids = m.ids(found)
            ok, before = m.contexts(ids, starts, level)
            yield np.unique(m.keys(before, ids[ok]), return_counts=True)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _ in counted(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys[:: max(1, len(keys) // 2000)])], names=["key"])

    # Where to cut the level into files; a sample will do, as this changes no result.
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(32)) == 0).mapInArrow(sampled, "key long")
    cuts = some.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    bounds = np.unique(np.array(cuts or [], np.int64))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in counted(batches):
            part = np.searchsorted(bounds, keys, side="right")
            if not len(keys):
                continue
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            rows = [squeeze(np.diff(keys[s:e], prepend=np.int64(0))) for s, e in zip(cut, [*cut[1:], len(keys)], strict=True)]
            more = [squeeze(n[s:e].astype(np.int64)) for s, e in zip(cut, [*cut[1:], len(keys)], strict=True)]
            if rows:
                blob = [len(a).to_bytes(8, "little") + a + b for a, b in zip(rows, more, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(blob, pa.binary())], names=["bucket", "payload"])

    def merge(_, bucket: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, n = [], []
        for x in payloads:
            size = int.from_bytes(x[:8], "little")
            keys.append(np.cumsum(unsqueeze(x[8 : 8 + size])))
            n.append(unsqueeze(x[8 + size :]))
        keys, n = np.concatenate(keys), np.concatenate(n)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, n = keys[first], np.add.reduceat(n, first)
        context = keys >> bits
        write_arrays(f"{folder}/raw{level}-{bucket}", {"keys": keys, "n": n.astype(np.uint32 if n.max() < 1 << 32 else np.int64)})
        edge = np.unique(context[[0, -1]])
        sums = [(int(c), int((context == c).sum()), int(n[context == c].sum())) for c in edge]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (bucket, len(keys), int((n == 1).sum()), int((n == 2).sum()))] + [pa.array([pickle.dumps(sums)], pa.binary())], names=["bucket", "size", "n1", "n2", "edges"])

    sent = docs.mapInArrow(send, "bucket int, payload binary")
    made = by_bucket(sent, parts, merge, "bucket long, size long, n1 long, n2 long, edges binary").collect()
    made.sort()
    n1, n2 = sum(r["n1"] for r in made), sum(r["n2"] for r in made)
    discount = min(0.99, n1 / (n1 + 2 * n2)) if n1 else 0.5
    # A context at a file's edge may go on in the next one: its successors and its count are summed here.
    kinds, total = Counter(), Counter()
    for r in made:
        for c, t, n in pickle.loads(r["edges"]):
            kinds[c] += t
            total[c] += n
    base, at = {}, 0
    for r in made:
        base[r["bucket"]] = at
        at += r["size"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column("part").to_pylist():
                if not os.path.exists(f"{folder}/raw{level}-{part}") and os.path.exists(f"{folder}/level{level}-{part}"):
                    continue  # an earlier attempt of this task got so far
                raw = map_arrays(f"{folder}/raw{level}-{part}")
                keys, n = raw["keys"], raw["n"].astype(np.float64)
                context = keys >> bits
                first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
                own = context[first]
                t, c = np.diff(np.r_[first, len(keys)]).astype(np.float64), np.add.reduceat(n, first)
                for k in {0, len(own) - 1}:
                    t[k], c[k] = kinds[int(own[k])], total[int(own[k])]
                p, p_scale = quantise((n - discount).clip(1e-12) / np.repeat(c, np.diff(np.r_[first, len(keys)])))
                x = -np.log2(discount * t / c)
                low, step = float(x.min()), float(x.max() - x.min()) / 254 or 1.0
                weight = np.zeros(int(own[-1] - own[0]) + 1, np.uint8)  # 0: a context that was not seen
                weight[own - own[0]] = 1 + np.ceil((x - low) / step - 1e-9).clip(0, 254).astype(np.uint8)
                write_arrays(f"{folder}/level{level}-{part}", encode(keys) | {"p": p, "p_scale": p_scale, "weight": weight, "weight_scale": np.array([low, step]), "first": own[:1]})
                os.remove(f"{folder}/raw{level}-{part}")
            yield b

    if made:
        spark.createDataFrame([(r["bucket"],) for r in made], "part long").repartition(min(len(made), shuffle_partitions(spark))).mapInArrow(finish, "part long").count()
    return {"bounds": bounds, "base": base, "size": at}


def train(docs: DataFrame, order: int = ORDER) -> tuple[str, dict]:
    """Fit on every row of docs (null text: empty): the model's folder, in the shared folder, and what is in it.

    All counts cover all texts, and nothing is cut off. Words are known by 64-bit hashes. (context, word)
    must fit 63 bits. No rows give a model for which every word is unknown."""
    spark, docs = docs.sparkSession, texts(docs)
    folder = _folder(spark)
    parts = 1 << max(2, (shuffle_partitions(spark) - 1).bit_length())
    meta: dict = {"vocabulary": _vocabulary(docs, folder, parts), "levels": {}}
    meta["bits"] = max(1, (meta["vocabulary"]["size"] + 1).bit_length())
    for level in range(2, order + 1):
        meta = meta | {"levels": meta["levels"] | {level: _level(docs, folder, meta, level, parts)}}
        if meta["levels"][level]["size"].bit_length() + meta["bits"] > 62:
            raise ValueError("the corpus is too large for 63-bit pairs of a context and a word")
    return folder, meta


def score(docs: DataFrame, model: tuple[str, dict]) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    n_tokens counts a text's words and one end, n_known those with a count in training; base_score is the
    sum of log10((c + 1) / (N + 1 * (V + 1))) over them, score the model's log10 probability. A null text
    counts as empty: one end. Repeated rows and null ids are scored like any other; no rows give no rows.
    Only doc_id and text are read."""
    folder, meta = model
    shared = docs.sparkSession.sparkContext.broadcast(meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(folder, shared.value)
        v = shared.value["vocabulary"]
        for doc, found, starts in _batches(batches):
            ids = m.ids(found)
            at = np.flatnonzero(np.arange(len(ids)) == starts)
            known = ids < v["size"]
            c = np.where(known, m.counts[np.minimum(ids, max(v["size"] - 1, 0))] if v["size"] else 0, 0)
            base = np.log10((c + 1) / (v["total"] + 1 * (v["size"] + 1)))
            sums = [np.add.reduceat(x, at) for x in (np.ones(len(ids), np.int64), known.astype(np.int64), base, m.score(ids, starts))]
            columns = [pa.array(doc, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array(np.full(len(doc), v["total"], np.int64)), pa.array(sums[2]), pa.array(sums[3])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
