"""The quality classifier against held-out labels, its own definition, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import none, odd  # noqa: F401

from fieldloom.llm import quality, queries
from fieldloom.llm.common import held_out

GOOD = "The nation of the thing is here, and the other one was with it. By then they had seen it."
BAD = ["### $$$ *** " * 40, "BUY NOW!! " * 80, "one | two | three | four | five | six | " * 30, "the the the the the the " * 60]


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return quality.fit(docs, labels), docs, labels


def test_held_out_labels(spark, judged):
    model, docs, labels = judged
    held = docs.join(labels.where(held_out(F.col("doc_id"), 5, 0)), "doc_id")
    got = quality.score(held, model).join(labels, "doc_id").collect()
    good, bad = ([r.score >= 0.3 for r in got if r.quality == y] for y in (1, 0))
    assert len(bad) > 50 and np.mean(good) >= 0.98 and np.mean(bad) <= 0.05
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_apart_from_the_table(judged):
    model = judged[0]
    x = np.array([quality.figures(t.encode()) for t in [GOOD, *BAD]])
    assert model.score(x)[0] >= 0.3 and (model.score(x)[1:] < 0.3).all()


def test_score_is_the_sum_of_tables(judged):
    model = judged[0]
    x = np.array([quality.figures(t.encode()) for t in [GOOD, *BAD, "", "x", "é" * 99]])
    assert len(quality.FIGURES) == x.shape[1] and np.isfinite(x).all()
    for row, margin in zip(x, model.margins(x), strict=True):
        at = [int((e <= v).sum()) for e, v in zip(model.edges, row, strict=True)]
        want = model.bias + sum(t[b] for t, b in zip(model.tables, at, strict=True)) + sum(t[model.coarse[i][at[i]], model.coarse[j][at[j]]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(want - margin) < 1e-9
    assert np.allclose(model.bias + sum(model.terms(x).values()), model.margins(x))
    assert model.pairs


def test_cuts_by_brute_force():
    """The best single cut, and the best cut of two figures, are those of trying all."""
    rng = np.random.default_rng(1)
    g, h = rng.normal(size=12), rng.uniform(0.5, 1, 12)
    gain = [g[:i].sum() ** 2 / (h[:i].sum() + 1) + g[i:].sum() ** 2 / (h[i:].sum() + 1) for i in range(1, 12)]
    i = 1 + int(np.argmax(gain))
    assert np.allclose(quality._tree(g, h, 1.0, 0.1, 2), np.r_[[-g[:i].sum() / (h[:i].sum() + 1)] * i, [-g[i:].sum() / (h[i:].sum() + 1)] * (12 - i)])
    g, h = rng.normal(size=(5, 4)), rng.uniform(0.5, 1, (5, 4))

    def parts(a, b):
        return [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, 4)), (slice(a, 5), slice(0, b)), (slice(a, 5), slice(b, 4))]

    all_cuts = {(a, b): sum(g[p].sum() ** 2 / (h[p].sum() + 1) for p in parts(a, b)) for a in range(1, 5) for b in range(1, 4)}
    best = max(all_cuts, key=all_cuts.get)
    got, step = quality._cross(g, h, 1.0, 0.1)
    assert abs(got - (all_cuts[best] - g.sum() ** 2 / (h.sum() + 1))) < 1e-9
    for p in parts(*best):
        assert np.allclose(step[p], -g[p].sum() / (h[p].sum() + 1))


def test_pairs_learn_what_single_figures_cannot():
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y, pairs=2)
    fresh = rng.uniform(size=(1000, 4))
    assert (0, 1) in model.pairs
    assert ((model.score(fresh) >= 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5))).mean() > 0.95
    assert np.array_equal(quality.train(x, y, pairs=2).score(fresh), model.score(fresh))


def test_odd_inputs(spark, judged, odd, none):  # noqa: F811
    model, docs, labels = judged
    got = quality.score(odd, model)
    assert got.columns == ["doc_id", "score"] and got.count() == odd.count()
    rows = got.collect()
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2, 3)}) >= 1 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(none, model).count() == 0
    share = labels.where(~held_out(F.col("doc_id"), 5, 0)).agg(F.avg("quality")).first()[0]
    for few in (labels.where("quality = 1"), labels.limit(0), labels.withColumn("quality", F.lit(None).cast("int"))):
        few_model = quality.fit(docs, few)
        assert len({r.score for r in quality.score(odd, few_model).collect()}) == 1
    assert quality.fit(none, labels).score(np.zeros((1, len(quality.FIGURES))))[0] == 0.5 and 0 < share < 1
    clash = docs.limit(50).withColumns({c: F.lit("x") for c in ("quality", "good", "figures", "score", "held_out")})
    twice = labels.unionByName(labels).withColumn("text", F.lit("y"))
    assert quality.fit(clash, twice, rows=40).score(np.zeros((1, len(quality.FIGURES)))).shape == (1,)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op11_quality(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.predicted == (r.score >= 0.3) for r in rows) and {r.held_out for r in rows} == {True, False}
