"""Shared pieces of the training-data operators: scratch tables, text columns, packed shuffles."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where ids are compared: after every other id.
NULL_ID = np.iinfo(np.int64).max


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir. Where that is unset: a folder of the warehouse, which
    driver and executors share; with a local master, a temporary one, set for the rest of the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            base = f"file://{tempfile.mkdtemp(prefix='fieldloom-')}"
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_fieldloom"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables written by materialise() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent().getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes, about, of what a cache of words may hold in a Python worker.
CACHE = 48 << 20


class Words(dict):
    """A cache by words that starts anew when it holds CACHE bytes, about."""

    def __init__(self, most: int = CACHE):
        super().__init__()
        self.most, self.held = most, 0

    def add(self, new: dict[bytes, object]) -> None:
        """Take over entries. An entry costs its word, its value and what Python needs around both."""
        size = sum(map(len, new)) + sum(len(v) if isinstance(v, bytes) else 0 for v in new.values()) + 150 * len(new)
        if self.held + size > self.most:
            self.clear()
            self.held = 0
        self.update(new)
        self.held += size


_caches: dict[str, dict] = {}


def give_back() -> None:
    """Return free memory to the system, as far as the libraries can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task. Workers outlive stages, so the caches of
    other operators are let go as soon as one asks for its own; every operator asks, even if it keeps nothing."""
    if owner not in _caches:
        if _caches:
            _caches.clear()
            give_back()
        _caches[owner] = {}
    return _caches[owner]


def in_worker(owner: str, run: Callable) -> Callable:
    """run, a step of mapInArrow, as a task of an operator: caches of others go before it, and the memory that it no
    longer needs goes back after it, for idle workers keep what they have."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(owner)
        yield from run(batches)
        give_back()

    return task


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows in an Arrow batch of the session: texts are long, and a batch is held on both sides. Spark
    reads this setting when a plan runs, so it stays lowered; it is the one setting that operators change."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (null as empty); every other column goes."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column's values in UTF-8, not decoded."""
    col = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """An id column as int64, null as NULL_ID."""
    return batch.column(name).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def in_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small batches, so that what a worker holds at once stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def held_out(doc_id: F.Column, mod: int, rest: int = 2) -> F.Column:
    """crc32 of the id as text, mod `mod`, is `rest`; false for a null id."""
    return F.coalesce((F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % mod) == rest, F.lit(False))


# ---- shuffles of packed arrays -------------------------------------------------------------------------------------
# Rows of a few bytes cost several times their size in a row shuffle. These helpers send, per
# bucket of the hash range, one row whose payload holds whole arrays.


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes; all but the first are stored as differences and squeezed."""
    n = len(arrays[0])
    out = [np.array([n, len(arrays)], np.int64).tobytes()]
    for k, a in enumerate(arrays):
        if a.dtype == np.uint64:
            body, tag = a.tobytes(), 0
        else:
            body, tag = zlib.compress(np.diff(a.astype(np.int64), prepend=np.int64(0)).tobytes(), 1), 1
        out.append(np.array([tag, len(body)], np.int64).tobytes() + body)
    return b"".join(out)


def unpack(payload: bytes) -> list[np.ndarray]:
    _, k = np.frombuffer(payload, np.int64, 2)
    at, out = 16, []
    for _ in range(int(k)):
        tag, size = map(int, np.frombuffer(payload, np.int64, 2, at))
        body = payload[at + 16 : at + 16 + size]
        out.append(np.frombuffer(body, np.uint64) if tag == 0 else np.cumsum(np.frombuffer(zlib.decompress(body), np.int64)))
        at += 16 + size
    return out


def bucketed(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket (stable) and each entry's bucket; a bucket is a range of the hash's top 32 bits."""
    b = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return np.argsort(b, kind="stable"), b


def by_bucket(df: DataFrame, buckets: int, step: Callable, schema: str, end: Callable | None = None, owner: str | None = None) -> DataFrame:
    """Bring the rows (bucket, payload) of a bucket together and give step(state, bucket, payloads) -> batches.

    A partition is sorted by bucket and streamed, so a worker holds one bucket at a time. state is a list
    that lasts as long as the task; end(state) -> batches is called after the last bucket. With an owner,
    the tasks run by in_worker()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, state = None, [], []
        for batch in batches:
            for b, p in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if b != now:
                    if held:
                        yield from step(state, now, held)
                    now, held = b, []
                held.append(p)
        if held:
            yield from step(state, now, held)
        if end:
            yield from end(state)

    n = max(1, min(buckets, shuffle_partitions(df.sparkSession)))
    return df.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(in_worker(owner, run) if owner else run, schema)
