"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, lexical, licenses, ngram_lm, packing, quality, simhash, substring, token_counts, topk, toxicity
from .common import held_out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.removals(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = ngram_lm.train(docs.where(~held_out(F.col("doc_id"), 7)))
    held = held_out(F.col("doc_id"), 7).alias("held_out")
    return ngram_lm.score(docs, model).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_sentences"), F.array_join("licenses", ",").alias("licenses"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_packing, op2_toxicity, op3_topk, op4_substring_dedup, op5_exact_dedup, op6_lm_scoring, op7_simhash_dedup, op8_bpe, op9_token_counts, op10_licenses, op11_quality, op12_lexical_search, pipeline]
    return {f.__name__: f for f in found}


_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _licence_sql() -> str:
    """Known sentences of several parts are looked for as several parts in a row; line feeds end a part here."""
    sentences, rules = licenses.catalogue()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    plain = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()
    parts = {n: [p for p in map(plain, re.split(r"(?<=[.!?;:])\s+", s)) if p] for n, s in sentences.items()}
    known = ", ".join(f"({quote('. '.join(p))}, {n}, {len(p)})" for n, p in parts.items())
    most = max(map(len, parts.values()))
    row, named = "ids", []
    for ids, name in sorted((("".join(f",{n}," for n in r), name) for name in rules for r in rules[name]), key=lambda x: (-x[0].count(",,"), x)):
        named.append((row, ids, name))
        row = f"replace({row}, '{ids}', ',-,')" if ids.count(",,") else row
    names = ", ".join(f"CASE WHEN contains({r}, '{i}') THEN {quote(n)} END" for r, i, n in named)
    runs = ", ".join(f"({n}, array_to_string(list_slice(parts, place, place + {n - 1}), '. '))" for n in range(1, most + 1))
    return rf"""
WITH known(sentence, id, n) AS (VALUES {known}),
cut AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[\x20\x09-\x0D]+', E'\\1\n', 'g'), chr(10)), lambda p: lower(trim(regexp_replace(p, '[^A-Za-z0-9]+', ' ', 'g')))), lambda p: p <> '') AS parts
  FROM documents
),
places AS (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS place FROM cut),
runs AS (SELECT doc_id, place, r.n AS n, r.s AS s FROM places, LATERAL (VALUES {runs}) r(n, s)),
hits AS (SELECT doc_id, place, arg_max(id, known.n) AS id FROM runs JOIN known ON s = known.sentence AND runs.n = known.n GROUP BY doc_id, place),
rows_ AS (SELECT doc_id, count(*) AS n, string_agg(',' || id::VARCHAR || ',', '' ORDER BY place) AS ids FROM hits GROUP BY doc_id),
named AS (SELECT doc_id, n, array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ',') AS licenses FROM rows_)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_sentences, coalesce(n.licenses, '') AS licenses
FROM documents d LEFT JOIN named n USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 20""",
        "op4_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place, len(words) AS n, words FROM w),
g AS (SELECT doc_id, place, word, CASE WHEN place + 49 <= n THEN array_to_string(list_slice(words, place, place + 49), ' ') END AS win FROM p),
f AS (SELECT win, min(doc_id) AS first_id FROM g WHERE win IS NOT NULL GROUP BY win),
m AS (SELECT g.doc_id, g.place, g.word, coalesce(f.first_id < g.doc_id, false)::INTEGER AS bad FROM g LEFT JOIN f ON g.win = f.win),
k AS (SELECT doc_id, place, word, max(bad) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
o AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE gone = 0) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n_words, 0)::BIGINT AS n_words, coalesce(o.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN o USING (doc_id)""",
        "op5_exact_dedup": rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)""",
        "op10_licenses": _licence_sql(),
        "op12_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}') AS words FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(words))::BIGINT AS total FROM d WHERE len(words) > 0),
t AS (SELECT r, doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * s.docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, s.docs),
i AS (SELECT item_id, min(coalesce(text, '')) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}'))) AS term FROM i),
c AS (SELECT q.item_id, p.r, p.doc_id, sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + ((50 * p.n * s.docs) // s.total)))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM c WHERE score > 0)
SELECT * FROM o WHERE rank <= 50""",
    }
