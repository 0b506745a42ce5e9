"""Exact ranked lexical search over a tiered inverted index.

Scores are sums over an item's terms of integer contributions that fall with a term's frequency and with a document's
length. The index holds every posting (term, document, contribution) in one of three tiers: of each term the highest
contributions come first, about FIRST of them, then about SECOND, then the rest, and each tier has for each term the
bound of what is left below it. A search reads the first tier of all terms. A document's score is then between what was
read and that plus the bounds of its terms not read; a document not met at all is under the sum of all bounds. The best
documents so far are summed in full: an item whose k-th score is over that has its proof, and the few documents that may
still be among its first k are summed in full, too. The others fall through: the second tier is read for them, and in the end the third, but not of those terms with
the most postings whose bounds are together too small to matter. Common terms weigh little, so their long lists are
hardly ever read.

Documents with the same counts of all indexed terms and the same length have the same score for every item, so of each
group of them only the k smallest doc_ids are in the index (all are counted in its statistics); this is what keeps large
groups of copies from filling lists.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, byte_texts, drop_tables, in_rows, materialise, scratch_dir, small_batches, worker_cache
from .wordcache import mapped

#: Terms are the maximal runs of ASCII letters and digits and of all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: About how many postings of a term the first two tiers hold.
FIRST, SECOND = 512, 32_768
#: Share of an item's k-th score that the bounds of terms not read further may have together.
SPARED = 0.1
#: A contribution before its weight is below 1,000,000; its level is a 256th of that.
LEVEL = 1_000_000 // 256 + 1
#: Bits of the filter of asked terms, at most (8 MB).
BITS = 1 << 26

_plain = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_plain).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, one row for each different term of an item. Rows with a null item_id go, of several rows of one
    id the smallest text counts (null: empty)."""
    one = items.where("item_id is not null").groupBy("item_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return one.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))).alias("term"))


def term_filter(terms: DataFrame) -> np.ndarray:
    """Bits by hash of the terms, a bitmap as large as their number asks for but of BITS at most, so it may go to every
    task: it holds all of the terms, and lets through some others, more of them the fuller it is."""
    n = terms.agg(F.approx_count_distinct("term")).first()[0]
    bits = min(BITS, 1 << max(12, int(16 * n).bit_length()))
    place = F.pmod(F.xxhash64("term"), F.lit(bits))
    parts = terms.select(place.alias("p")).groupBy(F.expr(f"p div {1 << 15}").alias("k")).agg(F.collect_set((F.col("p") % (1 << 15)).cast("short")).alias("low"))
    out = np.zeros(bits, bool)
    for r in parts.toLocalIterator():  # a block of places at a time, `bits` places in all at most
        out[(r["k"] << 15) + np.array(r["low"], np.int64)] = True
    return np.packbits(out)


def forward(docs: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """Per row of docs with at least one term: row (its number in the table made of this, once written), doc_id, n (its
    terms with repeats), terms and tfs (the different ones, sorted, and their counts; only those that pass the filter, if
    one is given), profile (128 bits of n, terms and tfs)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(asked) if asked is not None else None

    def passed(words: list[bytes]) -> list[bytes]:
        import xxhash

        h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
        at = (h % np.uint64(8 * len(shared.value))).astype(np.int64)
        return [w if x else b"" for w, x in zip(words, (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache("lexical").setdefault(None if asked is None else hashlib.md5(shared.value.tobytes()).hexdigest(), Words())
        for b in in_rows(batches):
            rows = []
            found = [t.translate(_plain) for t in byte_texts(b)]
            kept = mapped(found, held, passed) if shared else [t.split() for t in found]
            for i, (t, some) in enumerate(zip(found, kept, strict=True)):
                if some:
                    c = Counter(some)
                    c.pop(b"", None)
                    terms = sorted(c)
                    tfs = [c[w] for w in terms]
                    n = len(some)
                    rows.append((i, n, [w.decode() for w in terms], tfs, hashlib.blake2b(repr((n, terms, tfs)).encode(), digest_size=16).digest()))
            if rows:
                i, n, terms, tfs, profile = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(i)), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32())), pa.array(profile, pa.binary())], names=["doc_id", "n", "terms", "tfs", "profile"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = read.mapInArrow(run, "doc_id long, n long, terms array<string>, tfs array<int>, profile binary")
    return made.select(F.monotonically_increasing_id().alias("row"), "*")


@dataclass
class Index:
    """Tables of an index in the shared folder. documents: row, doc_id, n, terms, tfs. terms: term, id, df, w (its weight),
    and for each tier how many postings lie below it (left1, left2) and the most that one of them adds (rest1, rest2).
    postings: id, row, c, in a folder for each tier."""

    spark: SparkSession
    documents: DataFrame
    terms: DataFrame
    path: str
    n_documents: int
    n_terms: int
    k: int

    def postings(self, tier: int) -> DataFrame:
        """Those of the first `tier` tiers; only their folders are read."""
        return self.spark.read.schema("id long, row long, c long, tier int").parquet(self.path).where(F.col("tier") <= tier)

    def drop(self) -> None:
        """Delete the index's tables."""
        drop_tables(self.spark, self.documents, self.terms)
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder.getParent(), True)


def contribution(documents: int, terms: int) -> Column:
    return F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 20L * (50L + ((50L * n * {documents}L) div {max(1, terms)}L))))")


def weight(documents: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * documents + 2.0)) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long")


def build(docs: DataFrame, terms: DataFrame | None = None, k: int = 50, first: int = FIRST, second: int = SECOND) -> Index:
    """Index every row of docs, for searches of up to k results. terms (column term), if given: the terms that will be
    asked for; postings of others are not made, though they count for a document's length.

    A null text has no terms. Repeated rows and rows of one doc_id are documents each; a null doc_id comes after all
    others. A document without terms is in no result. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    asked = None
    if terms is not None:
        terms = terms.select("term").where("term is not null").distinct()
        asked = term_filter(terms)
    everything = materialise(forward(docs, asked), "documents")
    documents, total = everything.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = everything.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counted = counted.join(terms, "term", "left_semi") if terms is not None else counted
    known = materialise(counted.select(F.monotonically_increasing_id().alias("id"), "term", "df", weight(documents).alias("w")).where("w > 0"), "known")
    # Of documents alike in all that counts, the k smallest. Only large groups are looked at; Catalyst sends their
    # profiles to every task if they are few.
    large = materialise(everything.groupBy("profile").count().where(F.col("count") > k).select("profile"), "large")
    place = Window.partitionBy("profile").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    extra = everything.select("row", "doc_id", "profile").join(large, "profile", "left_semi").withColumn("place", F.row_number().over(place))
    few = extra.where(F.col("place") <= k).select("row")
    small = everything.join(large, "profile", "left_anti")
    copies = not large.isEmpty()
    kept = everything.drop("profile")
    if copies:
        kept = materialise(small.unionByName(everything.join(large, "profile", "left_semi").join(few, "row", "left_semi")).drop("profile"), "kept")
    tf = kept.select("row", "n", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("x")).select("row", "n", "x.term", "x.tf")
    posted = tf.join(known.select("term", "id", "w"), "term").select("id", "row", "w", contribution(documents, total).alias("c"))
    level = F.expr(f"(c div w) div {LEVEL}L")
    levels = posted.groupBy("id", level.alias("level")).agg(F.count(F.lit(1)).alias("held"), F.max("c").alias("most"), F.first("w").alias("w"))
    down = Window.partitionBy("id").orderBy(F.desc("level"))
    levels = levels.withColumn("sum", F.sum("held").over(down))
    cuts = levels.groupBy("id").agg(
        *(F.coalesce(F.min(F.when(F.col("sum") <= size, F.col("level"))), F.lit(1 << 20)).alias(f"cut{t}") for t, size in ((1, first), (2, second))),
        *(F.coalesce(F.max(F.when(F.col("sum") > size, F.col("most"))), F.lit(0)).alias(f"rest{t}") for t, size in ((1, first), (2, second))),
        *(F.coalesce(F.sum(F.when(F.col("sum") > size, F.col("held"))), F.lit(0)).alias(f"left{t}") for t, size in ((1, first), (2, second))),
    )
    table = materialise(known.join(cuts, "id"), "terms")
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}/postings"
    tiered = tf.join(table.select("term", "id", "w", "cut1", "cut2"), "term").withColumn("c", contribution(documents, total))
    tier = F.when(level >= F.col("cut1"), 1).when(level >= F.col("cut2"), 2).otherwise(3)
    tiered.select("id", "row", "c", tier.alias("tier")).write.option("compression", "zstd").partitionBy("tier").parquet(path)
    drop_tables(spark, known, large, *([everything] if copies else []))
    return Index(spark, kept, table, path, documents, total, k)


def _scored(index: Index, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact scores of pairs (item_id, row), from the documents' own terms: item_id, row, doc_id, score."""
    read = index.documents.join(pairs, "row").select("item_id", "row", "doc_id", "n", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("x"))
    full = read.select("item_id", "row", "doc_id", "n", "x.term", "x.tf").join(asked.select("item_id", "term", "w"), ["item_id", "term"])
    return full.groupBy("item_id", "row", "doc_id").agg(F.sum(contribution(index.n_documents, index.n_terms)).alias("score"))


def _bounds(asked: DataFrame, reading: DataFrame, index: Index, tier: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Read up to `tier` tiers by reading (item_id, id, depth: tiers to read of this term, rest: bound of what lies below).
    Returns the documents met, with low and taken (sums of what was read, and of the bounds of these terms), and per item
    kth (the k-th score among the 2k documents of highest low, in full; 0 if fewer than k were met), which the item's
    k-th score is not below, and bound, which the score of no document that was not met is over."""
    met = reading.join(index.postings(tier), "id").where(F.col("tier") <= F.col("depth"))
    met = materialise(met.groupBy("item_id", "row").agg(F.sum("c").alias("low"), F.sum("rest").alias("taken")), "met")
    best, order = (Window.partitionBy("item_id").orderBy(F.desc(c)) for c in ("low", "score"))
    first = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 2 * k).select("item_id", "row")
    kth = _scored(index, asked, first).withColumn("place", F.row_number().over(order)).where(F.col("place") == k).select("item_id", F.col("score").alias("kth"))
    items = reading.groupBy("item_id").agg(F.sum("rest").alias("bound")).join(kth, "item_id", "left").fillna(0, ["kth"])
    return met, materialise(items, "items")


def _deeper(asked: DataFrame, tier: int) -> DataFrame:
    """What to read of items that have no proof after `tier` tiers, by their k-th score: the next tier of their terms, but
    for those with most postings left, as long as the bounds of all of these stay together under the k-th score: under the
    share SPARED of it, as wider bounds leave more contenders. After the last tier the proof is certain."""
    rest = F.col(f"rest{tier}")
    by = Window.partitionBy("item_id").orderBy(F.desc(f"left{tier}"), "id")
    spared = F.sum(rest).over(by) < F.col("kth") * F.lit(SPARED)
    below = F.col("rest2") if tier == 1 else F.lit(0)
    return asked.select("item_id", "id", F.when(spared, tier).otherwise(tier + 1).alias("depth"), F.when(spared, rest).otherwise(below).cast("long").alias("rest"))


def _proven(items: DataFrame) -> DataFrame:
    """Items of which no document that was not met can be among the first k."""
    return items.where((F.col("bound") < F.col("kth")) | (F.col("bound") == 0))


def search(index: Index, items: DataFrame, k: int | None = None) -> DataFrame:
    """Each item's k documents of highest score above 0 (all, if fewer): item_id, rank (from 1), doc_id, score.

    Equal scores go by ascending doc_id, null last. An item's term counts once. Items without a term of the index have no
    rows; rows with a null item_id take no part, and of several rows of one item_id the smallest text asks. k is the
    index's unless less. Only item_id and text are read.
    """
    k = index.k if k is None else k
    if k > index.k:
        raise ValueError(f"the index was built for {index.k} results")
    asked = materialise(item_terms(items).join(index.terms, "term"), "asked")
    contenders, done = [], []
    reading = asked.select("item_id", "id", F.lit(1).alias("depth"), F.col("rest1").alias("rest"))
    for tier in (1, 2, 3):
        met, state = _bounds(asked, reading, index, tier, k)
        done += [met, state]
        sure = _proven(state)
        contenders.append(met.join(sure, "item_id").where(F.col("low") + F.col("bound") - F.col("taken") >= F.col("kth")).select("item_id", "row"))
        left = state.join(sure, "item_id", "left_anti").select("item_id", "kth")
        if tier == 3 or left.isEmpty():
            break
        reading = materialise(_deeper(asked.join(left, "item_id"), tier), "reading")
        done.append(reading)
    last = contenders[0]
    for c in contenders[1:]:
        last = last.unionByName(c)
    full = _scored(index, asked, last).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    found = full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
    found = materialise(found, "found")
    drop_tables(index.spark, asked, *done)
    return found


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """build() over the terms of the items, search(), and the index dropped."""
    index = build(docs, item_terms(items), k)
    found = search(index, items)
    index.drop()
    return found
