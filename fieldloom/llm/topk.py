"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size. For a block every candidate is scored, the scores are
counted in one histogram for each query, and the bin with the k-th highest score is split into finer
bins until a bin is one score wide. That score is the query's threshold: what lies above it, and as
many of the rows at it as are missing, smallest id first, is the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, materialise, scratch_dir, shuffle_partitions

BINS = 256
#: Queries in a block, about.
BLOCK = 2048
#: Candidate rows scored at once.
ROWS = 512


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and q, the array of floor(scale * x); rows with a null id or vector, or with a null or non-finite component, go."""
    x = F.col("embedding")
    bad = lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, bad))
    return kept.select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale)))).alias("q"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled with zeros, which leaves inner products as they are."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scores(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate ids and their scores (candidates x queries); a query's own row gets no score (the least integer)."""
    width, exact = queries.shape[1], queries.astype(np.int64)
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            ids = part.column("vec_id").to_numpy(zero_copy_only=False)
            c = _matrix(part.column("q"), width)
            if np.abs(c).max(initial=0) * np.abs(queries).max(initial=0) * max(width, 1) < 2**53:
                s = (c @ queries.T).astype(np.int64)
            else:  # beyond what doubles hold exactly
                s = c.astype(np.int64) @ exact.T
            at = np.minimum(np.searchsorted(query_ids, ids), len(query_ids) - 1)
            own = query_ids[at] == ids
            s[np.flatnonzero(own), at[own]] = np.iinfo(np.int64).min
            yield ids, s


def _rank_in(q: np.ndarray) -> np.ndarray:
    """Place of each entry among those of its (sorted) query."""
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    return np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))


def _block(candidates: DataFrame, query_ids: np.ndarray, queries: np.ndarray, bound: int, k: int, path: str) -> None:
    """Write the result of a block of queries."""
    spark = candidates.sparkSession
    shared, n = spark.sparkContext.broadcast((query_ids, queries)), len(query_ids)
    low, high = np.full(n, -bound, np.int64), np.full(n, bound + 1, np.int64)  # the k-th score is in [low, high)
    above = np.zeros(n, np.int64)  # candidates at high or over
    while True:
        lows, highs, widths = low, high, -((low - high) // BINS)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, row = np.zeros(n * BINS, np.int64), np.arange(n) * BINS
            for _, s in _scores(batches, *shared.value):
                c, q = np.nonzero((s >= lows) & (s < highs))
                total += np.bincount((s[c, q] - lows[q]) // widths[q] + row[q], minlength=n * BINS)
            total = total.reshape(n, BINS)
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([total[x].tobytes() for x in some], pa.binary())], names=["query", "counts"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for q, h in zip(b.column("query").to_pylist(), b.column("counts").to_pylist(), strict=True):
                    h = np.frombuffer(h, np.int64)
                    sums[q] = sums[q] + h if q in sums else h
            over = [np.cumsum(h[::-1])[::-1] for h in sums.values()]  # candidates in this bin or higher ones
            need = [k - int(above[q]) for q in sums]
            at = [int(np.flatnonzero(o >= m)[-1]) if o[0] >= m else -1 for o, m in zip(over, need, strict=True)]
            more = [int(o[x + 1]) if 0 <= x < BINS - 1 else 0 for o, x in zip(over, at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(at, pa.int32()), pa.array(more, pa.int64())], names=["query", "bin", "more"])

        counted = candidates.mapInArrow(count, "query int, counts binary").repartition(shuffle_partitions(spark), "query").mapInArrow(add, "query int, bin int, more long")
        low, high, above = np.full(n, -bound, np.int64), np.full(n, 1 - bound, np.int64), above.copy()
        for r in counted.collect():  # at most a row for each query of the block
            q = r["query"]
            if r["bin"] >= 0:  # else there are fewer candidates than k: all of them
                low[q] = lows[q] + r["bin"] * widths[q]
                high[q] = min(low[q] + widths[q], highs[q])
                above[q] += r["more"]
        if (high - low == 1).all():
            break

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def thin(q, v, s):
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            ok = _rank_in(q) < k
            return [q[ok], v[ok], s[ok]]

        for ids, s in _scores(batches, *shared.value):
            c, q = np.nonzero(s >= low)
            held = [np.concatenate(x) for x in zip(held, (q, ids[c], s[c, q]), strict=True)]
            if len(held[0]) > 500_000:
                held = thin(*held)
        q, v, s = thin(*held)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value[0][q]), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    found = candidates.mapInArrow(keep, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.parquet(path)
    shared.destroy()


def top_k(vectors: DataFrame, is_query: F.Column | None = None, k: int = 20, scale: int = 64, block: int = BLOCK) -> DataFrame:
    """Per query its k highest scores: query_id, rank (from 1), vec_id, score; all, if there are fewer.

    A vector's components x become floor(scale * x); the score is the inner product (which must fit a
    long), ties go to the smaller vec_id. Queries are the rows for which is_query holds (default: vec_id
    divisible by 20), candidates are all rows with another vec_id; repeated rows are candidates each, and
    of several vectors of one query id the smallest asks. Vectors that are null or hold a null or
    non-finite component take no part, nor do rows with a null vec_id; shorter vectors count as filled
    with zeros. No queries give no rows. Only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    candidates = materialise(quantised(vectors, scale), "candidates")
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    queries = materialise(candidates.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q")), "queries")
    size = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, wide, norm = queries.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(size)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wide_c, norm_c = candidates.agg(F.max(F.size("q")), F.max(size)).first()
    bound = int(np.sqrt(norm) * np.sqrt(norm_c) * (1 + 1e-9)) + 1
    blocks = -(-n // block)
    base = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    dealt.repartition("block").write.partitionBy("block").parquet(f"{base}/queries")
    dealt = spark.read.schema(dealt.schema).parquet(f"{base}/queries")
    for b in range(blocks):  # each block's queries come to the driver, about `block` of them; its result is written
        rows = dealt.where(F.col("block") == b).orderBy("vec_id").collect()
        if rows:
            q = np.zeros((len(rows), max(wide, wide_c)))
            for i, r in enumerate(rows):
                q[i, : len(r["q"])] = r["q"]
            _block(candidates, np.array([r["vec_id"] for r in rows], np.int64), q, bound, k, f"{base}/found/block={b}")
    drop_tables(spark, candidates, queries)
    return spark.read.schema("query_id long, rank int, vec_id long, score long, block int").parquet(f"{base}/found").drop("block")
