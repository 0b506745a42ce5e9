"""The tiered index against brute force and SQL, with every tier forced, and on odd inputs."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import ODD, none, odd  # noqa: F401

from fieldloom.llm import lexical

TERM = re.compile(lexical.TERM)


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    """Scores of all documents by the definition; null doc_ids come last."""
    read = [(d, Counter(terms(t))) for d, t in docs]
    read = [(d, c, sum(c.values())) for d, c in read if c]
    n_docs, total = len(read), sum(n for *_, n in read)
    df = Counter(w for _, c, _ in read for w in c)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        asked = set(terms(min(t or "" for i, t in items if i == item)))
        scores = []
        for d, c, n in read:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in asked if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def crowd(spark):
    """Documents over a small vocabulary with common words, a third of them copies of one text, and items."""
    rng = random.Random(8)
    names = ["the", "of", *(f"w{i}" for i in range(60))]
    weights = [400, 300, *(60 / (i + 1) for i in range(60))]
    docs = [(i, " ".join(rng.choices(names, weights, k=rng.randint(3, 60)))) for i in range(400)]
    copy = " ".join(rng.choices(names, weights, k=30))
    docs += [(1000 - i, copy + ("." if i % 2 else "")) for i in range(200)]
    items = [(i, " ".join(rng.choices(names, weights, k=rng.randint(1, 25)))) for i in range(20)] + [(77, copy.upper()), (78, "the of"), (79, "unknown words"), (80, None)]
    return docs, items


@pytest.mark.parametrize(("k", "first", "second"), [(5, 8, 40), (5, 1, 2), (20, 512, 16_384), (7, 0, 0), (3, 20, 20)])
def test_all_tiers(spark, crowd, k, first, second, monkeypatch):
    docs, items = crowd
    seen = []
    real = lexical._bounds
    monkeypatch.setattr(lexical, "_bounds", lambda a, r, i, t, n: seen.append(t) or real(a, r, i, t, n))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build(d, lexical.item_terms(i), k, first, second)
    assert got(lexical.search(index, i)) == by_hand(docs, items, k)
    assert seen == list(range(1, max(seen) + 1)) and (first > 40 or max(seen) == 3)
    below = index.postings(3).join(index.terms, "id")  # bounds hold, and are met
    for t in (1, 2):
        most = {r["id"]: r["most"] for r in below.where(F.col("tier") > t).groupBy("id").agg(F.max("c").alias("most")).collect()}
        assert all(r[f"rest{t}"] == most.get(r["id"], 0) for r in index.terms.collect())
    assert below.where("tier = 1").groupBy("id").count().agg(F.max("count")).first()[0] in (None, *range(first + 1))
    index.drop()


def test_index_of_all_terms_serves_other_items(spark, crowd):
    docs, items = crowd
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"), None, 10, 8, 60)
    for some in (items[:3], items[5:9]):
        assert got(lexical.search(index, spark.createDataFrame(some, "item_id long, text string"), 4)) == by_hand(docs, some, 4)
    with pytest.raises(ValueError):
        lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 11)


def test_filter_holds_all_terms_and_few_others(spark):
    some = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("term"))
    docs = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(5000))), (2, " ".join(f"u{i}" for i in range(5000)))], "doc_id long, text string")
    rows = {r.doc_id: r for r in lexical.forward(docs, lexical.term_filter(some)).collect()}
    assert len(rows[1].terms) == 5000 and len(rows[2].terms) < 1000 and rows[2].n == 5000


def test_odd_inputs(spark, odd, none):  # noqa: F811
    items = [(1, "a idiot"), (2, ODD[8]), (2, "zz " + ODD[8]), (3, "É é" + "é" * 300), (4, "x" * 20_000), (5, ""), (6, None), (None, "a"), (7, "a\x0ba A ½ 3½"), (7, "a\x0ba A ½ 3½")]
    asked = spark.createDataFrame([(i, t, "s", "r", "t", "x", 1) for i, t in items], "item_id long, text string, score string, rank string, term string, id string, n long")
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got(lexical.ranked(odd, asked, 5)) == by_hand(rows, items, 5)
    assert lexical.ranked(none, asked, 5).count() == 0
    assert lexical.ranked(odd, asked.limit(0), 5).count() == 0
    clash = odd.select("doc_id", "text", *(F.lit("?").alias(c) for c in ("row", "n", "terms", "tfs", "profile", "c", "w")))
    assert got(lexical.ranked(clash, asked, 2)) == by_hand(rows, items, 2)
