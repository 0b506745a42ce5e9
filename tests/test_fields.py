import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import scalars as S
from fieldloom.operators import frames as FR
from fieldloom.operators import particles as P
from fieldloom.operators import projection as PR
from fieldloom.plans import queries as Q
from fieldloom.plans.config import Camera, Document, Grid, camera_list


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(name, same):
    same(Q.QUERIES[name], Q.SQL[name])


def test_line_integral_table():
    u = np.linspace(0, 2, 20_000)
    exact = S.line_integral(u, 512)
    table = np.interp(u, np.linspace(0, 2, 1024), S.integral_table())
    assert np.sqrt(((table - exact) ** 2).mean()) < 1e-4 and np.abs(table - exact).max() < 1e-3
    assert abs(np.trapezoid(exact * 2 * math.pi * u, u) - 1) < 1e-4
    assert abs(exact[0] - 3 / (2 * math.pi)) < 1e-6 and exact[-1] == 0


def test_mass_closure(spark):
    """Column maps hold the particles' mass once the image is wide enough."""
    df = spark.createDataFrame([(10.0 + i, 20.0 - i, 30.0 + i / 2, 3.0, 2.0 + i / 3) for i in range(6)], "x double, y double, z double, mass double, h double")
    camera = Camera((12.0, 18.0, -50.0), (12.0, 18.0, 30.0), (0.0, 1.0, 0.0), width=96, height=96, ortho_width=48.0)
    total = PR.columns(PR.hits(df, camera), {"m": S.lit(1)}).agg(F.sum("m")).first()[0] * (48 / 96) ** 2
    assert abs(total - 18) < 0.05


def test_scatter_meets_brute_force(spark):
    """The same hits as a join of all rays with all particles, for an eye among the particles, too."""
    rng = np.random.default_rng(42)
    rows = [(i, *map(float, rng.uniform(0, 100, 3)), float(rng.uniform(0.5, 6))) for i in range(400)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, h double")
    for camera in (Camera((50, 50, 50), (80, 60, 55), (0, 0, 1), kind="perspective", width=14, height=10, fov=80.0), Camera((50, 40, -20), (50, 50, 50), (0, 1, 0), width=14, height=10, ortho_width=70.0, slab=60.0)):
        found = {(r.pid, r.py, r.px) for r in PR.hits(df, camera).select("pid", "py", "px").collect()}
        want = set()
        for r in PR.rays(spark, camera).collect():
            o, d = np.array([r.ox, r.oy, r.oz]), np.array([r.dx, r.dy, r.dz])
            for i, x, y, z, h in rows:
                t = (np.array([x, y, z]) - o) @ d
                off = np.array([x, y, z]) - (o + d * t)
                if r.t0 <= t <= r.t1 and off @ off < 4 * h * h:
                    want.add((i, r.py, r.px))
        assert found == want and want


def test_segments_fill_the_box(spark):
    camera, grid = Camera((-40, 30, 20), (50, 50, 50), (0, 0, 1), kind="perspective", width=8, height=8, fov=40.0), Grid((50, 50, 50), (60, 60, 60), (7, 5, 6))
    got = PR.segments(PR.rays(spark, camera), grid).groupBy("py", "px").agg(F.sum("ds").alias("ds")).collect()
    rays = {(r.py, r.px): r for r in PR.rays(spark, camera).collect()}
    for g in got:
        r = rays[g.py, g.px]
        o, d = np.array([r.ox, r.oy, r.oz]), np.array([r.dx, r.dy, r.dz])
        a, b = (20 - o) / d, (80 - o) / d
        assert abs(g.ds - (min(np.maximum(a, b)) - max(0, max(np.minimum(a, b))))) < 1e-9
    assert got


def test_partition_count_changes_nothing(spark):
    df = spark.range(500).selectExpr("double(id * 37 % 100) AS x", "double(id * 53 % 100) AS y", "double(id * 71 % 100) AS z", "1.0D AS mass", "3.0D AS h")
    grid = Grid((50, 50, 50), (80, 80, 80), (8, 8, 8))
    one, many = (sorted((r.ix, r.iy, r.iz, round(r.m, 9)) for r in P.deposit(df.repartition(n), grid, 1000.0, {"m": F.col("mass")}).collect()) for n in (1, 7))
    assert one == many


def test_smoothing_needs_enough_frames(spark):
    with pytest.raises(ValueError):
        FR.gaussian(FR.frames(spark, 6).withColumn("y", F.lit(1.0)), "y", 6, 1.5)


def test_documents():
    d = Document.parse("camera:\n  type: perspective\n  position: [1, 2, 3]\n  look_at: [1, 2, 9]\n  up: [0, 1, 0]\n  image_width: 64\n  image_height: 32\n  los_slab: 5\nprojections:\n  - field: gas_density\n    mode: column\n  - field: temperature\n    mode: mass_weighted\n")
    assert d.camera().kind == "perspective" and d.camera().slab == 5 and d.camera().width == 64
    assert [p.mode for p in d.projections()] == ["column", "mass_weighted"]
    r = Document.parse("center: [1, 2, 3]\nradius: 4\nmargin: 1\n").region()
    assert r.size == (8, 8, 8) and r.margin == 1
    assert Document.parse("center: [0, 0, 0]\nside: 10\nresolution: 5\n").grid().cell == (2, 2, 2)
    assert camera_list("# a\n\na.yaml out\nb.yaml\n") == [["a.yaml", "out"], ["b.yaml"]]


def test_stream_of_subfiles(spark, tmp_path):
    from fieldloom.streaming.cubes import deposit_stream

    df = spark.range(60).selectExpr("double(id) AS x", "double(id * 7 % 60) AS y", "double(id * 11 % 60) AS z", "1.0D AS mass", "2.0D AS h")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    grid = Grid((30, 30, 30), (60, 60, 60), (6, 6, 6))
    q = deposit_stream(spark, str(tmp_path / "in"), df.schema, grid, 1000.0, {"m": F.col("mass")}, 1).writeStream.outputMode("complete").format("memory").queryName("cube").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.ix, r.iy, r.iz, round(r.m, 9))
    assert sorted(map(key, spark.table("cube").collect())) == sorted(map(key, P.deposit(df, grid, 1000.0, {"m": F.col("mass")}).collect()))


def test_cube_round_trip(spark, tmp_path):
    from fieldloom.sources import cubes

    path = str(tmp_path / "cube")
    df = spark.createDataFrame([(0, 1, 2, 0.5, 3.0)], "ix int, iy int, iz int, gas_density double, temperature double")
    cubes.write_cube(df, Q.SECOND, path, redshift=2.0, snapshot=7)
    back = cubes.read_header(spark, path)
    assert (back.center, back.size, back.shape) == (Q.SECOND.center, Q.SECOND.size, Q.SECOND.shape)
    assert spark.read.parquet(f"{path}/header").first()["snapshot"] == 7
    assert cubes.read_cube(spark, path).first()[:] == (0, 1, 2, 0.5, 3.0)
    with pytest.warns(UserWarning):
        assert cubes.read_cube(spark, path, ["temperature", "none"]).columns == ["ix", "iy", "iz", "temperature"]
    maps = spark.range(12).selectExpr("int(id % 3) AS cam_id", "0 AS py", "int(id) AS px", "double(id) AS v")
    cubes.write_maps(maps, str(tmp_path / "maps"))
    assert cubes.read_maps(spark, str(tmp_path / "maps"), [1]).count() == 4


def test_png_round_trip(spark, tmp_path):
    from fieldloom.sources import png

    rows = [(c, y, x, x / 4, y / 3, c / 2) for c in (0, 1) for y in range(3) for x in range(5) if (x, y) != (4, 2)]
    made = png.images(spark.createDataFrame(rows, "cam_id int, py int, px int, r double, g double, b double"), 5, 3).collect()
    assert sorted(r.cam_id for r in made) == [0, 1]
    (tmp_path / "png").mkdir()
    for r in made:
        (tmp_path / "png" / f"frame_{r.cam_id:04d}.png").write_bytes(r.png)
    got = {(r.path[-5], r.py, r.px): (r.r, r.g, r.b) for r in png.pixels(spark, str(tmp_path / "png")).collect()}
    assert len(got) == 30 and got["1", 2, 4] == (0, 0, 0)
    for c, y, x, *rgb in rows:
        assert got[str(c), y, x] == tuple(math.floor(v * 255) / 255 for v in rgb)
    with pytest.raises(ValueError):
        png.decode(b"no image")


def test_png_filters():
    """Rows filtered each way are undone: written out here from the format's definition."""
    import struct
    import zlib

    from fieldloom.sources import png

    want = np.random.default_rng(1).integers(0, 256, (5, 4, 3), np.uint8).astype(int)
    body = b""
    for y in range(5):
        line = bytearray([y])
        for i in range(12):
            at = lambda r, k: int(want[r].ravel()[k]) if r >= 0 and k >= 0 else 0
            a, b, c = at(y, i - 3), at(y - 1, i), at(y - 1, i - 3)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((at(y, i) - (0, a, b, (a + b) // 2, paeth)[y]) & 255)
        body += bytes(line)
    part = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    data = png.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")
    assert (png.decode(data) == want).all()


def test_age_table_meets_closed_form(spark):
    from fieldloom.operators import stellar as ST

    got = ST.age_table(spark).where("a > 0.02").withColumn("exact", S.cosmic_age(F.col("a"))).agg(F.max(F.abs(F.col("age") / F.col("exact") - 1))).first()[0]
    assert got < 2e-5


def _brute_h(rows, k):
    at = np.array([r[1:4] for r in rows])
    return [math.sqrt(np.sort(((at - p) ** 2).sum(axis=1))[k]) if len(rows) > k else P.LONELY for p in at]


def test_neighbours_meet_brute_force(spark):
    """Dense and sparse places, lonely particles far away, equal positions, one flat axis; nobody is left out."""
    rng = np.random.default_rng(3)
    dense = rng.normal(50, 0.01, (150, 3))
    wide = rng.uniform(0, 1000, (120, 3))
    same = np.repeat([[700.0, 1.0, 2.0]], 12, axis=0)
    far = np.array([[1e5, 0, 0], [-1e5, 4, 4]])
    for places in (np.concatenate([dense, wide, same, far]), wide * [1, 1, 0], same, wide[:3], wide[:1]):
        rows = [(i, *map(float, p)) for i, p in enumerate(places)]
        df = spark.createDataFrame(rows, "pid long, x double, y double, z double")
        got = dict(map(tuple, P.neighbour_h(df, 7).collect()))
        assert len(got) == len(rows)
        np.testing.assert_allclose([got[i] for i in range(len(rows))], _brute_h(rows, 7), rtol=1e-9)
    assert P.neighbour_h(df.limit(0), 7).count() == 0
    capped = P.neighbour_h(df, 7, h_max=5.0).first()["h"]
    assert capped == 5.0


def test_neighbours_in_one_dense_place(spark):
    """Thirty thousand particles within a millionth of the box, and a few others."""
    n = 30_000
    place = lambda m: f"500 + double((id * {m}) % 99991) / 99991e3"
    df = spark.range(n).selectExpr("id AS pid", *(f"{place(m)} AS {a}" for a, m in zip("xyz", (7919, 104729, 1299709), strict=True)))
    few = spark.createDataFrame([(n + i, 100.0 * i, 7.0 * i, 3.0 * i) for i in range(10)], df.schema)
    got = P.neighbour_h(df.unionByName(few), 8).agg(F.count("*"), F.max("h"), F.expr("percentile(h, 0.5)")).first()
    assert got[0] == n + 10 and got[1] < 1000 and 0 < got[2] < 1e-3


def test_slabs_change_nothing(spark):
    """Emission by slabs is that of one sequence front to back, for clear and for opaque rays."""
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.uniform(0, 40, 3)), 1.0, 1.0 + i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, mass double, h double")
    found = PR.hits(df, Camera((20, 20, -30), (20, 20, 20), (0, 1, 0), width=6, height=6, ortho_width=20.0))
    for strength in (0.1, 3.0):
        one, many = (sorted((r.py, r.px, round(r.emission, 9), round(r.transmittance, 9)) for r in PR.emission(found, S.lit(1), 2.0, strength, ["pid"], depth=d).collect()) for d in (1e6, 3.0))
        assert one == many and one


def test_quantiles_meet_numpy(spark):
    from fieldloom.operators import images as IM

    rng = np.random.default_rng(9)
    rows = [(int(g), float(v)) for g in range(3) for v in [*rng.lognormal(0, 4, 200), *np.repeat(2.5, 50), *-rng.lognormal(0, 2, 30), 0.0, 0.0, -0.0]]
    df = spark.createDataFrame([*rows, (None, 4.0), (None, 8.0), (1, None)], "g int, v double")
    shares = [0.0, 0.02, 0.5, 0.7777, 0.995, 1.0]
    for r in IM.quantiles(df, "v", shares, ["g"]).collect():
        want = [4.0, 8.0] if r.g is None else [v for g, v in rows if g == r.g]
        np.testing.assert_allclose(r[1:], np.quantile(want, shares), rtol=1e-12)
    assert IM.quantiles(df.limit(0), "v", [0.5]).first()["p0"] is None
    assert IM.quantiles(df, "v", [0.5], ["g"]).count() == 4


def test_snapshot_round_trip(spark, tmp_path):
    from fieldloom.sources import snapshots as SN

    path = str(tmp_path / "snap_007")
    head = "100.0D AS BoxSize, 0.5D AS Redshift, 0.66D AS Time, 0.7D AS HubbleParam, 0.3D AS Omega0, 0.7D AS OmegaLambda, 3 AS NumFilesPerSnapshot, array(4, 2, 0, 0, 1, 0) AS NumPart_Total"
    gas = "1.0F AS Masses, 2.0F AS Density, 3.0F AS InternalEnergy, array(1.0F, 2.0F, 3.0F) AS Velocities"
    tables = {
        (0, 0): f"array(2147483648L, 0L, 4294967295L) AS IntCoordinates, {gas}, 0.25F AS HII_Fraction",
        (1, 0): f"array(1.5F, 2.5F, 3.5F) AS Coordinates, {gas}",
        (1, 1): "array(5.0F, 6.0F, 7.0F) AS Coordinates",
        (2, 4): "array(8.0F, 9.0F, 10.0F) AS Coordinates, 0.4F AS GFM_StellarFormationTime",
    }
    for i, held in enumerate(("array(2, 0, 0, 0, 0, 0)", "array(2, 2, 0, 0, 0, 0)", "array(0, 0, 0, 0, 1, 0)")):
        spark.sql(f"SELECT {head}, {held} AS NumPart_ThisFile").write.parquet(f"{path}.{i}.parquet/Header")
    for (i, kind), columns in tables.items():
        spark.sql(f"SELECT id AS ParticleIDs, {columns} FROM range({1 if kind == 4 else 2})").write.parquet(f"{path}.{i}.parquet/PartType{kind}")
    h = SN.read_header(spark, path)
    assert (h.boxsize, h.num_files, h.num_part_total[:2]) == (100.0, 3, (4, 2))
    assert SN.subfiles(path, h)[2].endswith("snap_007.2.parquet") and SN.subfiles("a.parquet", h) == ["a.parquet"]
    got = SN.gas(SN.raw(spark, path, 0), h.boxsize).orderBy("subfile", "ParticleIDs").collect()
    assert len(got) == 4 and (got[0].x, got[0].y, got[0].hii, got[0].metallicity) == (50.0, 0.0, 0.25, 0.0)
    assert (got[3].x, got[3].z, got[3].hii, got[3].vy) == (1.5, 3.5, 0.0, 2.0)
    assert abs(got[0].h - (3 * 0.5 / (4 * math.pi)) ** (1 / 3)) < 1e-12
    assert [(r.x, r.mass) for r in SN.dark_matter(SN.raw(spark, path, 1), h.boxsize).collect()] == [(5.0, 1.0)] * 2
    star = SN.stars(SN.raw(spark, path, 4), h.boxsize).first()
    assert (star.mass, round(star.a_form, 6), star.m_init) == (0.0, 0.4, None)
    assert SN.raw(spark, path, 5) is None


def test_requests(spark):
    from fieldloom.plans import requests as RQ
    from fieldloom.plans.config import Projection

    df = spark.createDataFrame([(5.0, 5.0, 5.0, 1.0, 2.0, 3.0)], "x double, y double, z double, mass double, h double, density double")
    camera = Camera((5, 5, -9), (5, 5, 5), (0, 1, 0), width=4, height=4, ortho_width=8.0)
    with pytest.warns(UserWarning):
        got = RQ.particle_maps(PR.hits(df, camera), camera, ["gas_density", "nothing", "gas_density"])
    assert got.columns == ["py", "px", "gas_column_density"] and got.count()
    assert RQ.grid_fields([[Projection("temperature", "mass_weighted")], [Projection(), Projection("vx", "los_velocity")]]) == ["temperature", "gas_density", "vx", "vy", "vz"]


def test_lattice_table(spark):
    from fieldloom.operators import stellar as ST

    rows = [(a, z, 10 * a + z) for z in (0.5, 0.1) for a in (2.0, 1.0, 3.0)]
    got = ST.lattice(spark.createDataFrame(rows, "log_age double, log_z double, L_u double"))
    assert got == {"log_age": [1.0, 2.0, 3.0], "log_z": [0.1, 0.5], "L_u": [[10.1, 10.5], [20.1, 20.5], [30.1, 30.5]]}
    with pytest.raises(ValueError):
        ST.lattice(spark.createDataFrame(rows[1:], "log_age double, log_z double, L_u double"))


def test_camera_documents_round_trip(spark, tmp_path):
    from fieldloom.plans import films
    from fieldloom.plans.config import Projection
    from fieldloom.sources import documents as D

    rows = films._cameras(spark, "/root/testdata/sf0.001")
    D.write_documents(rows, str(tmp_path / "cameras"))
    key = lambda r: (r["name"], r["text"])
    assert sorted(map(key, D.read_documents(spark, str(tmp_path / "cameras")).collect())) == sorted(map(key, rows.collect()))
    got = D.read_cameras(spark, str(tmp_path / "cameras"))
    assert list(got) == [f"frame_{i:04d}" for i in range(Q.FRAMES)]
    first = got["frame_0000"]
    assert first == Camera((580.0, 400.0, 300.0), (500.0, 400.0, 300.0), (0.0, 0.0, 1.0), width=320, height=180, ortho_width=900.0, slab=75.5)
    assert [p.mode for p in Document.parse(rows.first()["text"]).projections()] == ["column", "mass_weighted"]
    D.write_list(rows, str(tmp_path / "list"), folder="cameras")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "list")).collect()]
    assert camera_list("\n".join(lines)) == [[f"cameras/{n}"] for n in got]
    # large and small numbers stay numbers; a null leaves no document; an empty film leaves no file
    odd = spark.createDataFrame([("a", 1e10, 1e-7), ("b", None, 1.0)], "name string, x double, w double")
    odd = odd.select("name", D.camera_text(first, [Projection()], position=[F.col("x"), S.lit(0), S.lit(0)], ortho_width=F.col("w")).alias("text"))
    D.write_documents(odd, str(tmp_path / "odd"))
    back = D.read_cameras(spark, str(tmp_path / "odd"))
    assert list(back) == ["a"] and back["a"].position == (1e10, 0.0, 0.0) and back["a"].ortho_width == 1e-7
    D.write_documents(odd.where("false"), str(tmp_path / "none"))
    assert D.read_cameras(spark, str(tmp_path / "none")) == {}


def test_region_document(spark):
    from fieldloom.sources import documents as D

    row = spark.range(1).select(D.region_text(F.lit("orbit"), [S.lit(1), S.lit(2.5), S.lit(3)], S.lit(4)).alias("text")).first()
    r = Document.parse(row["text"]).region()
    assert (r.name, r.center, r.size, r.radius) == ("orbit", (1.0, 2.5, 3.0), (8.0, 8.0, 8.0), 4.0)


def test_projection_round_trip(spark, tmp_path):
    from fieldloom.sources import cubes

    path = str(tmp_path / "projection")
    cameras = [Camera((1, 2, 3), (4, 5, 6), (0, 1, 0), "perspective", 4, 2, fov=30.0, cam_id=i) for i in (0, 1)]
    maps = spark.range(16).selectExpr("int(id div 8) AS cam_id", "int(id div 4 % 2) AS py", "int(id % 4) AS px", "double(id) AS gas", "-double(id) / 3 AS metal")
    cubes.write_projection(maps, cameras, path, Q.BRICK, pipeline="particles", snapshot_path="s/7", redshift=0.5)
    assert cubes.read_cameras(spark, path) == cameras
    head = spark.read.parquet(f"{path}/header").where("cam_id = 1").first()
    assert (head["channels"], head["region_name"], head["region_size"]) == (["gas", "metal"], "region", list(Q.BRICK.size))
    assert (head["pipeline"], head["snapshot_path"], head["redshift"], head["image_width"]) == ("particles", "s/7", 0.5, 4)
    back = cubes.read_maps(spark, f"{path}/maps", [1])
    assert dict(back.dtypes)["metal"] == "float" and back.agg(F.sum("gas")).first()[0] == sum(range(8, 16))
    # no region, no provenance, no cameras, no maps
    cubes.write_projection(maps.where("false"), [], str(tmp_path / "empty"))
    assert cubes.read_cameras(spark, str(tmp_path / "empty")) == []
