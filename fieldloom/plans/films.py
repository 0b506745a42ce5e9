"""Queries over a film's documents: cameras, regions and their names for each frame of a path, scale bars."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import films as FI
from ..operators import frames as FR
from ..operators import particles as P
from ..operators import projection as PR
from ..sources import documents as D
from ..sources import layout as LA
from ..sources import tables as T
from . import queries as Q
from .config import Camera, Projection, Region

_CENTER = (500.0, 400.0, 300.0)
_FILM = Camera((0.0, 0.0, 0.0), _CENTER, (0.0, 0.0, 1.0), width=320, height=180, ortho_width=900.0, slab=75.5)
_ASKED = [Projection(), Projection("temperature", "mass_weighted")]


def _cameras(s: SparkSession, d: str) -> DataFrame:
    path = FR.orbit(s, Q.FRAMES, _CENTER, 80.0, Q._days(s, d)).withColumn("width", FR.geometric(Q.FRAMES, 900.0, 30.0))
    text = D.camera_text(_FILM, _ASKED, 6, position=[F.col(a) for a in "xyz"], ortho_width=F.col("width"))
    return path.select(D.frame_name(F.col("frame")).alias("name"), text.alias("text"))


_TURN = f"{2 * math.pi!r}::DOUBLE * i / {Q.FRAMES}"
_CAMERA_SQL = f"""
WITH path AS (
  SELECT i, 500 + 80 * cos({_TURN}) AS x, 400 + 80 * sin({_TURN}) AS y, 900 * pow({30 / 900!r}::DOUBLE, i / {Q.FRAMES - 1}.0::DOUBLE) AS width
  FROM {Q._DAYS_SQL}
)
SELECT 'frame_' || lpad(i::VARCHAR, 4, '0') AS name, concat(
  'camera:', chr(10), '  type: orthographic', chr(10),
  printf('  position: [%.6f, %.6f, 300.000000]', x, y), chr(10), '  look_at: [500.000000, 400.000000, 300.000000]', chr(10),
  '  up: [0.000000, 0.000000, 1.000000]', chr(10), '  fov: 60.000000', chr(10), printf('  ortho_width: %.6f', width), chr(10),
  '  los_slab: 75.500000', chr(10), '  image_width: 320', chr(10), '  image_height: 180', chr(10),
  'projections:', chr(10), '  - field: gas_density', chr(10), '    mode: column', chr(10),
  '  - field: temperature', chr(10), '    mode: mass_weighted', chr(10)) AS text
FROM path"""
Q.register("camera_documents", _cameras, _CAMERA_SQL)


def _regions(s: SparkSession, d: str) -> DataFrame:
    """A region for each nation, as a document."""
    rows = T.read(s, d, "nation").select(F.col("n_name"), F.col("n_nationkey").cast("double").alias("k"))
    text = D.region_text(F.col("n_name"), [F.col("k") * S.lit(2.5), S.lit(7), F.col("k")], F.col("k") + S.lit(0.125), ("gas", "stars"), 4)
    return rows.select(F.col("n_name").alias("name"), text.alias("text"))


Q.register(
    "region_documents",
    _regions,
    "SELECT n_name AS name, concat('name: ', n_name, chr(10), printf('center: [%.4f, 7.0000, %.4f]', n_nationkey * 2.5::DOUBLE, n_nationkey::DOUBLE), chr(10), printf('radius: %.4f', n_nationkey + 0.125::DOUBLE), chr(10), 'particle_types: [gas, stars]', chr(10)) AS text FROM nation",
)


# ---- films of a table of cameras: one on an orbit for each nation, around the ball of the other queries ---------------

_STEP = 2 * math.pi / 25
LOW, SIDE = (120.0, 370.0, 370.0), 260.0


def nation_cameras(spark: SparkSession, d: str, width: int = 9, height: int = 6, slab: float = 0.0) -> DataFrame:
    """A camera for each nation: around the ball by its key, nearer and nearer."""
    k = F.col("n_nationkey").cast("double")
    place = {"position_x": S.lit(250) + S.lit(150) * F.cos(k * S.lit(_STEP)), "position_y": S.lit(500) + S.lit(150) * F.sin(k * S.lit(_STEP)), "position_z": S.lit(460) + k * S.lit(4)}
    aim = {"look_at_x": S.lit(250), "look_at_y": S.lit(500), "look_at_z": S.lit(500), "up_x": S.lit(0), "up_y": S.lit(0), "up_z": S.lit(1)}
    view = {"width": F.lit(width), "height": F.lit(height), "ortho_width": S.lit(120) - k * S.lit(4), "fov": S.lit(60) - k, "slab": S.lit(slab)}
    return T.read(spark, d, "nation").select(F.col("n_nationkey").alias("cam_id"), *(v.alias(n) for n, v in (place | aim | view).items()))


def _film_sql(kind: str, width: int = 9, height: int = 6, slab: float = 0.0) -> str:
    """`seen` and `hits`: all particles held against all rays of all cameras."""
    half = "(120 - k * 4) / 2" if kind == "orthographic" else "tan(radians(60 - k) / 2)"
    if kind == "orthographic":
        rays = "ex + rx * ax + ux * ay AS ox, ey + ry * ax + uy * ay AS oy, ez + rz * ax + uz * ay AS oz, fx AS vx_, fy AS vy_, fz AS vz_, 1::DOUBLE AS len"
    else:
        rays = "ex AS ox, ey AS oy, ez AS oz, rx * ax + ux * ay + fx AS vx_, ry * ax + uy * ay + fy AS vy_, rz * ax + uz * ay + fz AS vz_, sqrt(vx_ * vx_ + vy_ * vy_ + vz_ * vz_) AS len"
    ends = "0::DOUBLE AS t0, 1e308::DOUBLE AS t1"
    if slab:
        a, b = "((250 - ox) * fx + (500 - oy) * fy + (500 - oz) * fz)", "(dx * fx + dy * fy + dz * fz)"
        ends = f"greatest(least(({a} - {slab / 2}) / {b}, ({a} + {slab / 2}) / {b}), 0) AS t0, greatest(({a} - {slab / 2}) / {b}, ({a} + {slab / 2}) / {b}) AS t1"
    return f"""{Q.GAS_SQL}, seen AS ({Q._cull_sql(Q.BALL, 'gas', '2 * h')}),
c0 AS (SELECT n_nationkey AS cam_id, n_nationkey::DOUBLE AS k, 250 + 150 * cos(k * {_STEP!r}::DOUBLE) AS ex, 500 + 150 * sin(k * {_STEP!r}::DOUBLE) AS ey, 460 + k * 4 AS ez FROM nation),
c1 AS (SELECT *, (250 - ex) AS wx, (500 - ey) AS wy, (500 - ez) AS wz, sqrt(wx * wx + wy * wy + wz * wz) AS w, wx / w AS fx, wy / w AS fy, wz / w AS fz, sqrt(fx * fx + fy * fy) AS g, fy / g AS rx, -fx / g AS ry, 0::DOUBLE AS rz, {half} AS hy, hy * {width} / {height} AS hx FROM c0),
c2 AS (SELECT *, ry * fz - rz * fy AS ux, rz * fx - rx * fz AS uy, rx * fy - ry * fx AS uz FROM c1),
pix AS (SELECT (i // {width})::INTEGER AS py, (i % {width})::INTEGER AS px FROM range({width * height}) t(i)),
aim AS (SELECT *, (2 * (px + 0.5::DOUBLE) / {width} - 1) * hx AS ax, (1 - 2 * (py + 0.5::DOUBLE) / {height}) * hy AS ay FROM c2, pix),
rays0 AS (SELECT cam_id, py, px, 0 AS sx, 0 AS sy, fx, fy, fz, {rays} FROM aim),
rays1 AS (SELECT *, vx_ / len AS dx, vy_ / len AS dy, vz_ / len AS dz FROM rays0),
rays AS (SELECT cam_id, py, px, sx, sy, ox, oy, oz, dx, dy, dz, {ends} FROM rays1), {Q.HITS_SQL}"""


def _seen(s: SparkSession, d: str) -> DataFrame:
    return P.cull(T.gas(s, d), Q.BALL, Q.BOX, 2 * F.col("h"))


def _film_columns(kind: str, slab: float):
    def query(s: SparkSession, d: str) -> DataFrame:
        found = FI.film_hits(_seen(s, d), nation_cameras(s, d, slab=slab), LOW, SIDE, kind)
        return Q.rounded(FI.film_columns(found, PR.column_weights()))

    sums = ", ".join(f"sum(k * {e}) AS {n}" for n, e in Q.SUMS.items())
    return query, f"WITH {_film_sql(kind, slab=slab)}, {Q._table_sql(True)}, {Q.COLUMN_SQL}, o AS (SELECT cam_id, py, px, {sums} FROM k GROUP BY cam_id, py, px) SELECT cam_id, py, px, {Q.sql_round(' '.join(Q.SUMS))} FROM o"


def _film_means(s: SparkSession, d: str) -> DataFrame:
    found = FI.film_hits(_seen(s, d), nation_cameras(s, d, slab=80.0), LOW, SIDE, "perspective", cells=8)
    return Q.rounded(FI.film_means(found, {n: (F.col(n), w) for n, w in (("temperature", F.col("density")), ("metallicity", S.lit(1)))}), 5)


def _film_rays(s: SparkSession, d: str) -> DataFrame:
    return Q.rounded(FI.film_rays(nation_cameras(s, d, slab=80.0), "perspective"), 7)


Q.register("film_columns_ortho", *_film_columns("orthographic", 0.0))
Q.register("film_columns_perspective_slab", *_film_columns("perspective", 80.0))
Q.register(
    "film_means",
    _film_means,
    f"WITH {_film_sql('perspective', slab=80.0)}, {Q._table_sql(True)}, {Q.COLUMN_SQL}, o AS (SELECT cam_id, py, px, coalesce(sum(k * density * temperature) / nullif(sum(k * density), 0), 0) AS temperature, coalesce(sum(k * metallicity) / nullif(sum(k), 0), 0) AS metallicity FROM k GROUP BY cam_id, py, px) SELECT cam_id, py, px, {Q.sql_round('temperature metallicity', 5)} FROM o",
)
Q.register("film_rays", _film_rays, f"WITH {_film_sql('perspective', slab=80.0)} SELECT cam_id, py, px, {Q.sql_round('ox oy oz dx dy dz t0 t1', 7)} FROM rays")


# ---- regions of a laid-out snapshot ----------------------------------------------------------------------------------

CORNER = Region((15.0, 985.0, 500.0), (90.0, 110.0, 130.0), margin=2.0, name="corner")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; only a local session may lack it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='fieldloom-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _region_query(region: Region):
    def query(s: SparkSession, d: str) -> DataFrame:
        path = shared_folder(s, "layout")
        LA.write_layout(T.gas(s, d), path, Q.BOX, files=16, row_group=1 << 20)
        found = LA.read_region(s, path, region, 2 * F.col("h"))
        return Q.rounded(found.select(*T.GAS_KEY, "x", "y", "z", "h"))

    return query, f"WITH {Q.GAS_SQL}, seen AS ({Q._cull_sql(region, 'gas', '2 * h')}) SELECT {', '.join(T.GAS_KEY)}, {Q.sql_round('x y z h')} FROM seen"


Q.register("layout_region_corner", *_region_query(CORNER))
Q.register("layout_region_ball", *_region_query(Q.BALL))


# ---- cubes on a table of grids: one for each nation, some across the faces of the box ---------------------------------


def _nation_cubes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("double")
    parts = {"center_x": k * S.lit(40), "center_y": S.lit(1000) - k * S.lit(30), "center_z": S.lit(500), "size_x": S.lit(60) + k, "size_y": S.lit(90), "size_z": S.lit(80), "n_x": F.lit(4), "n_y": F.lit(6) - F.col("n_nationkey") % 3, "n_z": F.lit(3)}
    grids = T.read(s, d, "nation").select(F.col("n_name").alias("grid"), *(v.alias(n) for n, v in parts.items()))
    return Q.rounded(P.deposit_grids(T.gas(s, d), grids, Q.BOX, {"gas_density": F.col("mass"), "temperature": F.col("mass") * F.col("temperature")}))


_GRIDS_SQL = f"""WITH {Q.GAS_SQL},
g AS (SELECT n_name AS grid, n_nationkey * 40::DOUBLE AS gx, 1000 - n_nationkey * 30::DOUBLE AS gy, 500::DOUBLE AS gz, 60 + n_nationkey::DOUBLE AS wx, 90::DOUBLE AS wy, 80::DOUBLE AS wz, 4 AS nx, 6 - n_nationkey % 3 AS ny, 3 AS nz FROM nation),
near AS (SELECT g.*, mass, temperature, greatest(h, least(wx / nx, wy / ny, wz / nz) / 2) AS hh, {', '.join(f"g{a} + (CASE WHEN {a} - g{a} > 500 THEN {a} - g{a} - 1000 WHEN {a} - g{a} < -500 THEN {a} - g{a} + 1000 ELSE {a} - g{a} END) AS {a}" for a in 'xyz')} FROM gas, g),
reached AS (SELECT * FROM near WHERE {' AND '.join(f"abs({a} - g{a}) <= w{a} / 2 + 2 * hh" for a in 'xyz')}),
hit AS (SELECT *, sqrt({' + '.join(f"({a} - (g{a} - w{a} / 2 + (i{a} + 0.5::DOUBLE) * w{a} / n{a})) ** 2" for a in 'xyz')}) AS r FROM reached, range(4) a(ix), range(6) b(iy), range(3) c(iz) WHERE iy < ny),
cube AS (SELECT grid, ix::INTEGER AS ix, iy::INTEGER AS iy, iz::INTEGER AS iz, sum(mass * {Q.W_SQL}) AS gas_density, sum(mass * temperature * {Q.W_SQL}) AS temperature FROM hit WHERE r < 2 * hh GROUP BY ALL)
SELECT grid, ix, iy, iz, {Q.sql_round('gas_density temperature')} FROM cube"""
Q.register("deposit_grid_table", _nation_cubes, _GRIDS_SQL)
