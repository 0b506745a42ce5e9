"""Methods of generated code stay under 8,000 bytes, beyond which the JVM interprets them for good."""

import re

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import films as FI
from fieldloom.operators import particles as P
from fieldloom.operators import projection as PR
from fieldloom.plans import films as PF
from fieldloom.plans import queries as Q
from fieldloom.plans.config import Region
from fieldloom.sources import layout as LA
from fieldloom.sources import tables as T

SF = "/root/testdata/sf0.001"

COMPILED = 8000


@pytest.fixture
def largest(spark):
    """Bytes of the largest method of a query's code."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen"))))
    spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("samples", [1, 2])
def test_hits_and_emission(spark, largest, samples):
    seen = P.cull(T.gas(spark, SF), Q.BALL, Q.BOX, 2 * F.col("h"))
    assert largest(seen) < COMPILED
    found = PR.hits(seen, Q.SLAB, samples=samples)
    e, a = PR.KAPPA["heavy_elements"]
    assert largest(PR.emission(found, PR.volume_weights()["heavy_elements"], e, a, T.GAS_KEY, samples)) < COMPILED


def test_hits_of_camera_rows(spark, largest):
    seen = P.cull(T.gas(spark, SF), Q.BALL, Q.BOX, 2 * F.col("h"))
    found = FI.film_hits(seen, PF.nation_cameras(spark, SF), PF.LOW, PF.SIDE, "perspective")
    assert largest(found) < 2 * COMPILED  # joins and rows of cameras come on top: 27,448 when filters named rays again


def test_morton_key(spark, largest):
    assert largest(T.gas(spark, SF).withColumn("morton", LA.morton([F.col(a) for a in "xyz"], Q.BOX))) < COMPILED


def test_loose_test_loses_nothing(spark):
    """Places on and beyond the faces of the box, reaches that are negative, null, infinite or not a number."""
    rows = [(x, y, h) for x in (-1600.0, -1.0, 0.0, 89.999999, 90.0, 160.0, 410.0, 410.000001, 750.0, 999.0, 1250.0, 2300.0, float("nan"), float("inf"), None) for y in (500.0, 430.0) for h in (0.0, 30.0, -400.0, float("nan"), float("inf"), None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, x double, y double, h double").withColumn("z", F.lit(500.0))
    d = {a: f"CASE WHEN {a} - {c} > 500 THEN {a} - {c} - 1000 WHEN {a} - {c} < -500 THEN {a} - {c} + 1000 ELSE {a} - {c} END" for a, c in (("x", 250.0), ("y", 500.0), ("z", 500.0))}
    for region, test in (
        (Region((250.0, 500.0, 500.0), (0.0, 0.0, 0.0), radius=100.0), f"pow({d['x']}, 2) + pow({d['y']}, 2) + pow({d['z']}, 2) <= pow(100 + 2 * h, 2)"),
        (Region((250.0, 500.0, 500.0), (320.0, 200.0, 100.0)), f"abs({d['x']}) <= 160 + 2 * h AND abs({d['y']}) <= 100 + 2 * h AND abs({d['z']}) <= 50 + 2 * h"),
    ):
        got = sorted(r.id for r in P.cull(df, region, 1000.0, 2 * F.col("h")).collect())
        assert got == sorted(r.id for r in df.where(test.replace("2 * h", "2.0D * h")).collect()) and got
