"""Colour appearance against published values, ramps against numpy, and odd anchors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import colours as C
from fieldloom.plans import colours as PC
from fieldloom.plans import queries as Q

ANCHORS = [("sunset", c) for c in ("03000a", "2d1a6b", "b83b82", "f07035", "fff4c2")] + [("ice", c) for c in ("ffffff", "02030f", "4d8ec8")]


def colours(spark, rows):
    return spark.createDataFrame([(n, *(int(c[i : i + 2], 16) / 255 for i in (0, 2, 4))) for n, c in rows], "name string, r double, g double, b double")


@pytest.mark.parametrize(
    ("xyz", "light", "want"),
    [((19.01, 20.0, 21.78), 318.31, (41.73, 0.1088, 219.0)), ((57.06, 43.06, 31.96), 31.83, (65.96, 41.67, 19.6))],
)
def test_published_appearance(spark, xyz, light, want):
    """Worked examples of the CIECAM02 standard."""
    view = C.Viewing(white=(95.05, 100.0, 108.88), light=light)
    row = C.appearance(spark.createDataFrame([xyz], "x double, y double, z double"), view=view).first()
    assert np.allclose((row.lightness, row.colourfulness, row.hue), want, atol=(0.006, 0.006, 0.06))


def test_there_and_back(spark):
    grid = [(0, "ff"), (1, "80"), (2, "01"), (3, "00"), (4, "c3")]
    rows = [(f"{i}{j}{k}", a + b + c) for i, a in grid for j, b in grid for k, c in grid]
    df = C.to_ucs(colours(spark, rows)).withColumnsRenamed({"r": "r0", "g": "g0", "b": "b0"})
    got = C.from_ucs(df).select("r", "g", "b", "r0", "g0", "b0", "light", "red_green", "blue_yellow", "name").collect()
    assert len(got) == 125
    for r in got:
        assert np.allclose((r.r, r.g, r.b), (r.r0, r.g0, r.b0), atol=1e-7)
    ends = {r.name: r for r in got}
    assert abs(ends["000"].light - 100) < 0.01 and abs(ends["333"].light) < 1e-6  # white and black
    assert max(abs(ends["000"].red_green), abs(ends["000"].blue_yellow)) < 2.5


@pytest.mark.parametrize("even", [True, False])
def test_ramps_follow_their_anchors(spark, even):
    df = colours(spark, ANCHORS).withColumn("light", F.lit("a clashing column"))
    got = C.perceptual_ramps(df, ["name"], 64, even=even, alpha=(0.1, 0.9, 2.0)).orderBy("name", "step").collect()
    seen = C.to_ucs(colours(spark, ANCHORS)).collect()
    for name in ("sunset", "ice"):
        j, a, b = np.array(sorted((r.light, r.red_green, r.blue_yellow) for r in seen if r.name == name)).T
        t = np.linspace(0, 1, 64)
        light = j[0] + t * (j[-1] - j[0]) if even else np.interp(t, np.linspace(0, 1, len(j)), j)
        want = spark.createDataFrame([(i, float(x), float(np.interp(x, j, a)), float(np.interp(x, j, b))) for i, x in enumerate(light)], "step int, light double, red_green double, blue_yellow double")
        rows = [r for r in got if r.name == name]
        assert [r.step for r in rows] == list(range(64))
        for r, w in zip(rows, C.from_ucs(want).orderBy("step").collect(), strict=True):
            assert np.allclose((r.r, r.g, r.b), np.clip((w.r, w.g, w.b), 0, 1), atol=1e-7) and abs(r.light - w.light) < 1e-9
            assert r.inside == (min(w.r, w.g, w.b) >= -C.NOISE and max(w.r, w.g, w.b) <= 1 + C.NOISE)
            assert abs(r.a - (0.1 + 0.8 * (r.step / 63) ** 2)) < 1e-12


def test_odd_anchors(spark):
    rows = [("one", "336699"), ("same", "336699"), ("same", "336699"), ("tie", "000000"), ("tie", "ffffff"), ("tie", "ffffff"), (None, "000000"), (None, "ffffff")]
    df = colours(spark, rows).unionByName(spark.createDataFrame([("one", None, 0.1, 0.2)], "name string, r double, g double, b double"))
    got = C.perceptual_ramps(df, ["name"], 5).orderBy("name", "step").collect()
    by = {n: [r for r in got if r.name == n] for n in ("one", "same", "tie", None)}
    assert all([r.step for r in x] == [0, 1, 2, 3, 4] for x in by.values())
    assert all(np.allclose((r.r, r.g, r.b), (0.2, 0.4, 0.6), atol=1e-7) for r in by["one"] + by["same"])
    assert np.allclose([(r.r, r.g, r.b) for r in by["tie"]], [(r.r, r.g, r.b) for r in by[None]], atol=1e-7)
    assert C.perceptual_ramps(df.limit(0), ["name"], 5).count() == 0
    with pytest.raises(ValueError):
        C.perceptual_ramps(df, ["name"], 1)


@pytest.mark.parametrize("name", ["perceptual_ramps", "ramp_gamut"])
def test_queries(same, name):
    same(Q.queries()[name], Q.oracle_sql()[name])


def test_one_shuffle(spark):
    plan = C.perceptual_ramps(PC.anchors(spark, "/root/testdata/sf0.001"), ["ramp"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
