"""Films of camera tables against single cameras, and regions of laid-out snapshots against the cull."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import scalars as S
from fieldloom.operators import films as FI
from fieldloom.operators import particles as P
from fieldloom.operators import projection as PR
from fieldloom.plans import films as PF
from fieldloom.plans.config import Camera, Grid, Region
from fieldloom.sources import cubes as CU
from fieldloom.sources import layout as LA

CAMERAS = {
    "orthographic": [Camera((50, 40, -20), (50, 50, 50), (0, 1, 0), width=14, height=10, ortho_width=70.0, slab=60.0, cam_id=1), Camera((10, 40, 120), (60, 50, 50), (0, 1, 0), width=5, height=9, ortho_width=30.0, cam_id=2), Camera((-900, 0, 0), (-950, 0, 1), (0, 1, 0), width=3, height=3, ortho_width=10.0, cam_id=3)],
    "perspective": [Camera((50, 50, 50), (80, 60, 55), (0, 0, 1), "perspective", 14, 10, fov=80.0, cam_id=1), Camera((50, 50, -60), (50, 50, 50), (0, 1, 0), "perspective", 6, 6, fov=40.0, slab=30.0, cam_id=2), Camera((50, 50, 110), (50, 60, 300), (0, 1, 0), "perspective", 6, 6, fov=30.0, cam_id=4)],
}


@pytest.fixture(scope="module")
def crowd(spark):
    """Particles with reaches from a thousandth of the box to more than all of it."""
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.uniform(0, 100, 3)), float(np.exp(rng.uniform(-3, 2.5))), float(rng.uniform(1, 2))) for i in range(300)]
    rows += [(1000, 50.0, 50.0, 50.0, 80.0, 1.0), (1001, 50.0, 50.0, 50.0, 0.0, 1.0), (1002, None, 50.0, 50.0, 1.0, 1.0), (1003, 500.0, 50.0, 50.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double, h double, mass double")


@pytest.mark.parametrize("kind", sorted(CAMERAS))
@pytest.mark.parametrize("cells", [1, 5, 16])
def test_film_is_its_cameras(spark, crowd, kind, cells):
    table = FI.camera_rows(spark, CAMERAS[kind])
    found = FI.film_hits(crowd, table, (0.0, 0.0, 0.0), 100.0, kind, cells)
    got = {(r.cam_id, r.pid, r.py, r.px): (round(r.t, 9), round(r.b2, 9)) for r in found.collect()}
    inside = crowd.where("x between 0 and 100")
    want = {(c.cam_id, r.pid, r.py, r.px): (round(r.t, 9), round(r.b2, 9)) for c in CAMERAS[kind] for r in PR.hits(inside, c).collect()}
    assert got == want and {k[0] for k in got} >= {1, 2}


def test_film_rays_and_emission(spark, crowd):
    for kind, cameras in CAMERAS.items():
        table = FI.camera_rows(spark, cameras)
        near = lambda r: tuple(round(v, 9) for v in r)
        got = {(r[0], r[1], r[2]): near(r[3:]) for r in FI.film_rays(table, kind).collect()}
        assert got == {(c.cam_id, r[0], r[1]): near(r[2:]) for c in cameras for r in PR.rays(spark, c).collect()}
    found = FI.film_hits(crowd.where("h < 20"), table, (0.0, 0.0, 0.0), 100.0, "perspective")
    film = {(r.cam_id, r.py, r.px): (r.emission, r.transmittance) for r in FI.film_emission(found, S.lit(1), 2.0, 3.0, ["pid"]).collect()}
    for c in CAMERAS["perspective"]:
        one = PR.emission(PR.hits(crowd.where("h < 20 and x < 100"), c), S.lit(1), 2.0, 3.0, ["pid"]).collect()
        assert all(np.allclose(film[c.cam_id, r.py, r.px], (r.emission, r.transmittance)) for r in one)
    parts = PR.segments(FI.film_rays(table, "perspective"), Grid((50, 50, 50), (60, 60, 60), (4, 4, 4)))
    assert {r.cam_id for r in parts.select("cam_id").distinct().collect()} == {1, 2}


def test_cameras_that_see_nothing(spark, crowd):
    bad = [Camera((1, 1, 1), (1, 1, 1), cam_id=1), Camera((1, 1, 1), (1, 1, 5), (0, 0, 1), cam_id=2), Camera((1, 1, 1), (5, 1, 1), width=0, cam_id=3)]
    table = FI.camera_rows(spark, bad).unionByName(FI.camera_rows(spark, [Camera((0, 50, 50), (50, 50, 50), cam_id=4)]).withColumn("fov", F.lit(None).cast("double")))
    assert FI.film_hits(crowd, table, (0.0, 0.0, 0.0), 100.0).count() == 0
    assert FI.film_hits(crowd, table.limit(0), (0.0, 0.0, 0.0), 100.0).count() == 0
    assert FI.film_hits(crowd.limit(0), FI.camera_rows(spark, CAMERAS["orthographic"]), (0.0, 0.0, 0.0), 100.0).count() == 0


def test_one_scan_and_no_pairs(spark):
    df = PF.Q.queries()["film_columns_ortho"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning(cam_id") == 1


def test_films_are_written_by_camera(spark, crowd, tmp_path):
    table = FI.camera_rows(spark, CAMERAS["orthographic"])
    film = FI.film_columns(FI.film_hits(crowd, table, (0.0, 0.0, 0.0), 100.0), {"m": S.lit(1)})
    CU.write_maps(film, str(tmp_path / "maps"))
    FI.film_header(table, "orthographic", ["m"]).write.parquet(str(tmp_path / "header"))
    assert CU.read_maps(spark, str(tmp_path / "maps"), [2]).count() == film.where("cam_id = 2").count() > 0
    assert [c.ortho_width for c in CU.read_cameras(spark, str(tmp_path))] == [70.0, 30.0, 10.0]


def test_morton_keys(spark):
    rng = np.random.default_rng(2)
    places = [tuple(map(float, p)) for p in rng.uniform(0, 100, (200, 3))] + [(0.0, 0.0, 0.0), (100.0, 100.0, 100.0), (-5.0, 120.0, 3.0)]
    df = spark.createDataFrame(places, "x double, y double, z double").select("*", LA.morton([F.col(a) for a in "xyz"], 100.0).alias("k"))
    for r in df.collect():
        assert r.k == LA._code(tuple(min(max(int(v / 100 * 65536 // 1), 0), 65535) for v in (r.x, r.y, r.z)), 16)
    for _ in range(50):
        lo, hi = np.sort(rng.uniform(0, 100, (2, 3)), axis=0)
        ranges = LA.key_ranges(tuple(lo), tuple(hi), 100.0)
        assert len(ranges) <= LA.RANGES
        inside = [r.k for r in df.collect() if all(a <= v <= b for a, v, b in zip(lo, (r.x, r.y, r.z), hi, strict=True))]
        assert all(any(a <= k <= b for a, b in ranges) for k in inside)


def test_regions_skip_row_groups(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.uniform(0, 100, 3)), float(rng.uniform(0.1, 0.5))) for i in range(40_000)] + [(-1, 0.0, 100.0, 50.0, 0.5), (-2, None, 1.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, h double")
    LA.write_layout(df, str(tmp_path), 100.0, files=64)
    for region in (Region((50, 50, 50), (10, 10, 10)), Region((1, 99, 50), (8, 6, 10), margin=0.5), Region((99, 20, 1), (0, 0, 0), radius=4.0), Region((50, 50, 50), (200, 200, 200))):
        for support in (None, 2 * F.col("h")):
            found = LA.read_region(spark, str(tmp_path), region, support)
            assert sorted(map(tuple, found.select(*df.columns).collect())) == sorted(map(tuple, P.cull(df, region, 100.0, support).collect()))
    small = LA.read_region(spark, str(tmp_path), Region((50, 50, 50), (10, 10, 10)))
    assert small.count() > 0
    plan = small._jdf.queryExecution().executedPlan()
    small._jdf.collectToPython()
    text = plan.toString()
    assert "PushedFilters" in text and "GreaterThanOrEqual(morton" in text
    leaf = plan.collectLeaves().apply(0)
    leaf = leaf.executedPlan().collectLeaves().apply(0) if "Adaptive" in leaf.getClass().getName() else leaf
    assert leaf.metrics().apply("numOutputRows").value() < 40_000 / 5


@pytest.mark.parametrize("cells", [1, 6, 16])
def test_grid_table_is_its_grids(spark, crowd, cells):
    grids = [Grid((50, 50, 50), (60, 40, 60), (7, 5, 6), "a"), Grid((2, 97, 50), (20, 30, 10), (3, 4, 2), "b"), Grid((50, 50, 50), (100, 100, 100), (2, 2, 2), "c")]
    inside = crowd.where("x is null or x between 0 and 100")
    sums = {"m": F.col("mass"), "hm": F.col("mass") * F.col("h")}
    got = {(r.grid, r.ix, r.iy, r.iz): (r.m, r.hm) for r in P.deposit_grids(inside, P.grid_rows(spark, grids), 100.0, sums, cells=cells).collect()}
    want = {(g.name, r.ix, r.iy, r.iz): (r.m, r.hm) for g in grids for r in P.deposit(inside, g, 100.0, sums).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    bad = P.grid_rows(spark, [Grid((1, 1, 1), (1, 1, 1), (0, 1, 1)), Grid((1, 1, 1), (0, 1, 1), (1, 1, 1))])
    assert P.deposit_grids(inside, bad, 100.0, sums).count() == 0
    plan = P.deposit_grids(inside, P.grid_rows(spark, grids), 100.0, sums)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(grid") == 1 and "NestedLoop" not in plan
