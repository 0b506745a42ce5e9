"""Dust, tiers, blended frames, splines and periodic neighbours against brute force, and on odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import frames as FR
from fieldloom.operators import images as IM
from fieldloom.operators import particles as P
from fieldloom.operators import projection as PR
from fieldloom.plans import zoom as Z


@pytest.mark.parametrize("depth", [0.3, 5.0, 1e9])
def test_dust_composes_by_slabs(spark, depth):
    """The same light however rays are cut into slabs."""
    rng = np.random.default_rng(1)
    rows = [(p, 0, float(t), 0.5, float(rng.uniform()), float(rng.uniform(0, 2))) for p in range(5) for t in np.arange(0, 10, 0.5)]
    rows += [(9, 0, 1.0, 2.0, None, 3.0), (9, 0, 3.0, 2.0, 5.0, None), (10, 0, -4.5, 1.0, 1.0, 1.0), (10, 0, -3.5, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "py int, px int, t double, ds double, j double, k double").repartition(4)
    got = {r.py: (r.light, r.depth) for r in PR.dusty(df, F.col("j"), F.col("k"), depth=depth).collect()}
    for p in {r[0] for r in rows}:
        light = tau = 0.0
        for _, _, _, ds, j, k in sorted((r for r in rows if r[0] == p), key=lambda r: r[2]):
            light += (j or 0) * ds * math.exp(-tau)
            tau += (k or 0) * ds
        assert np.allclose(got[p], (light, tau))
    assert PR.dusty(df.limit(0), F.col("j"), F.col("k")).count() == 0


def test_tier_covers_both_ways(spark):
    tiers = spark.createDataFrame([("wide", 800.0), ("middle", 200.0), ("near", 50.0)], "tier string, side double")
    views = spark.createDataFrame([(0, 10.0), (1, 40.0), (2, 100.0), (3, 120.0), (4, 700.0), (5, 5000.0)], "frame int, width double")
    pick = lambda **k: [r.tier for r in FR.pick_tier(views, tiers, "width", **k).orderBy("frame").collect()]
    assert pick() == ["near", "near", "middle", "middle", "wide", "wide"]
    assert pick(aspect=16 / 9) == ["near", "middle", "middle", "wide", "wide", "wide"]
    assert pick(aspect=0.5) == pick() and pick(aspect=16 / 9, tolerance=0.1) == ["near", "middle", "middle", "middle", "wide", "wide"]


def test_zoom_film_reads_only_tiers_in_use(spark):
    df = Z.zoom(spark, "/root/testdata/sf0.001")
    assert {r.tier for r in df.select("tier").distinct().collect()} == {"middle", "near"}
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    assert rows
    scans, seen = [plan], []
    while scans:
        node = scans.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec" and "tier" in node.toString():
            seen.append(node.metrics().apply("numPartitions").value())
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        if inner is not None:
            scans.append(inner)
        children = node.children()
        scans += [children.apply(i) for i in range(children.size())]
    assert seen and max(seen) == 2  # of three


def test_blend(spark):
    shots = spark.createDataFrame([(f, s, 0, p, float(s), float(f), 1.0) for f in range(12) for s in range(3) for p in range(2) if (f, s, p) != (5, 1, 1)], "frame int, scene int, py int, px int, r double, g double, b double")
    before, after, alpha = FR.crossfade(12, 3, 2)
    plan = FR.frames(spark, 12).select("frame", before.alias("before"), after.alias("after"), alpha.alias("alpha"))
    got = {(r.frame, r.px): (r.r, r.g, r.b) for r in IM.blend(shots, plan).collect()}
    for k in range(12):
        own, nxt, a = min(k // 4, 2), None, 0.0
        for s in (1, 2):
            if s * 4 - 1 <= k < s * 4 + 1:
                own, nxt, a = s - 1, s, (k - (s * 4 - 1) + 0.5) / 2
        for p in range(2):
            want = np.zeros(3)
            for s, w in ((own, 1 - a), (nxt, a)):
                if s is not None and (k, s, p) != (5, 1, 1):
                    want += w * np.array([s, k, 1.0])
            assert np.allclose(got.get((k, p), (0, 0, 0)), want)
    assert IM.blend(shots.limit(0), plan).count() == 0 and IM.blend(shots, plan.limit(0)).count() == 0


def test_spline_goes_through_keys_at_even_speed(spark):
    keys = spark.createDataFrame([(float(i), math.cos(i), math.sin(i), i / 3) for i in range(7)] + [(None, 1.0, 1.0, 1.0)], "key double, x double, y double, z double")
    got = np.array([(r.x, r.y, r.z) for r in FR.spline(keys, 200, 128).orderBy("frame").collect()])
    assert len(got) == 200 and np.allclose(got[0], (1, 0, 0)) and np.allclose(got[-1], (math.cos(6), math.sin(6), 2))
    step = np.linalg.norm(np.diff(got, axis=0), axis=1)
    assert step.max() / step.min() < 1.02
    assert all(np.linalg.norm(got - np.array([math.cos(i), math.sin(i), i / 3]), axis=1).min() < step.max() for i in range(7))
    for few, places in (([(0.0, 1.0, 2.0, 3.0)], {(1.0, 2.0, 3.0)}), ([(0.0, 1.0, 2.0, 3.0), (1.0, 1.0, 2.0, 3.0)], {(1.0, 2.0, 3.0)}), ([], set())):
        found = FR.spline(spark.createDataFrame(few, "key double, x double, y double, z double"), 5).collect()
        assert {(r.x, r.y, r.z) for r in found} == places and len(found) == (5 if few else 0)
    line = FR.spline(spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (5.0, 8.0, 0.0, 0.0)], "key double, x double, y double, z double"), 5, 16).orderBy("frame").collect()
    assert np.allclose([r.x for r in line], [0, 2, 4, 6, 8]) and [r.frame for r in line] == list(range(5))


@pytest.mark.parametrize("k", [1, 4])
def test_periodic_neighbours(spark, k):
    rng = np.random.default_rng(9)
    places = np.r_[rng.uniform(0, 10, (60, 3)), rng.normal(0, 0.4, (40, 3)) % 10, [[0, 0, 0], [9.999, 0, 5], [5, 5, 5], [5, 5, 5]]]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "pid int, x double, y double, z double")
    off = np.abs(places[:, None] - places[None])
    apart = np.sqrt((np.minimum(off, 10 - off) ** 2).sum(-1))
    np.fill_diagonal(apart, np.inf)
    want = np.sort(apart, axis=1)[:, k - 1]
    got = {r.pid: r.h for r in P.neighbour_h(df, k, box=10.0).collect()}
    assert np.allclose([got[i] for i in range(len(places))], want)
    # Few particles, all far apart: the nearest image may be on the other side of every face.
    few = df.limit(k + 1)
    got = {r.pid: r.h for r in P.neighbour_h(few, k, box=10.0).collect()}
    assert np.allclose([got[i] for i in range(k + 1)], np.sort(apart[: k + 1, : k + 1], axis=1)[:, k - 1])
