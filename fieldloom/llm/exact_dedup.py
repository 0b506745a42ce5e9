"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is normalised, cut into chunks at places its own characters choose, and written as a
recipe: the ordered list of its chunks' identifiers, about a fiftieth of its length. Whole texts
never move: each distinct chunk moves once, to verify that its identifier stands for one content,
and documents are then compared by their recipes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, texts

#: A chunk has at least and at most so many characters, except the last one of a text.
LEAST, MOST = 512, 8191


def _class(rest: int) -> str:
    """A character class of the Latin-1 characters whose code is `rest` modulo 8."""
    return "[" + "".join(f"\\x{{{c:x}}}" for c in range(33, 256) if c % 8 == rest) + "]"


#: A chunk ends after three characters of these classes, or at the greatest length, or with the text.
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?(?:(?<={_class(3)}{_class(5)}{_class(4)})|\z)|.{{1,{MOST}}}"

#: Ways to name a chunk, each verified before use; the last one is the content itself.
IDENTIFIERS = (
    lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b")),
    lambda c: F.struct(F.sha2(c, 256).alias("a")),
    lambda c: F.struct(c.alias("a")),
)


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space (single spaces are not touched)."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def verified(norm: DataFrame, name) -> bool:
    """Whether each identifier stands for one chunk content. Chunks are deduplicated before they move."""
    distinct = norm.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(name(F.col("chunk")).alias("id"), "chunk").distinct()
    return distinct.groupBy("id").count().where("count > 1").isEmpty()


def _groups(docs: DataFrame, identifiers) -> DataFrame:
    """exact_groups() and raw, a hash of each row's text as it is."""
    norm = texts(docs).select("doc_id", normalised(F.col("text")).alias("norm"), F.xxhash64("text").alias("raw"))
    name = next(f for f in identifiers if f is identifiers[-1] or verified(norm, f))
    recipes = materialise(
        norm.select("doc_id", "raw", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), name).alias("recipe")).withColumn("key", F.xxhash64("recipe")),
        "recipes",
    )
    groups = materialise(recipes.groupBy("key", "recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return recipes.join(groups, ["key", "recipe"]).select("doc_id", "raw", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, identifiers=IDENTIFIERS) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal after each run of [\\x20\\x09-\\x0D] becomes one space; a null text
    counts as empty. keep_id is the smallest doc_id of the group and kept says whether a row has it,
    so repeated rows of that id are all kept. Null ids are never keep_id unless a group has no other;
    then they are kept. No rows give no rows. Columns other than doc_id and text are not read. The rows
    of a large group meet their group in a join that adaptive execution splits.
    """
    return _groups(docs, identifiers).drop("raw")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text an earlier doc_id has; every column stays. A row goes by its own text, not by
    its doc_id alone. Rows with null ids stay."""
    gone = _groups(docs, IDENTIFIERS).where(~F.col("kept")).select("doc_id", F.col("raw").alias("__raw")).distinct()
    rows = docs.withColumn("__raw", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.join(gone.hint("shuffle_hash"), ["doc_id", "__raw"], "left_anti").select(docs.columns)
