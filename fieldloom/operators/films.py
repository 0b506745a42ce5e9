"""Films: maps of many cameras, the rows of a table, in one pass over the particles.

Particles and cameras meet in cells, never pair by pair. A particle lies in one cell, of a size that its reach does not
exceed: cells double from level to level, and a particle with a wide reach is found on a higher level. A camera lists the
cells of each level that its view can touch. An equi-join on (level, cell) gives each particle the cameras that may see
it; from there on a row is scattered to pixels and tested exactly, as for a single camera, and sums are made before the
one shuffle on (cam_id, pixel). A camera that sees far more than others so has as many keys as pixels, and a dense
cell is split by adaptive execution where the join shuffles.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.config import Camera
from .projection import AXES, FAR, columns, emission, hits, means, ray, segments, settle, slab

#: Columns of a camera table, besides cam_id: eye, point looked at and up, then the settings of Camera.
SETTINGS = [f"{n}_{a}" for n in ("position", "look_at", "up") for a in AXES] + ["width", "height", "ortho_width", "fov", "slab"]


def camera_rows(spark: SparkSession, cameras: list[Camera]) -> DataFrame:
    """A camera table of settings held in code."""
    rows = [(c.cam_id, *map(float, (*c.position, *c.look_at, *c.up)), c.width, c.height, float(c.ortho_width), float(c.fov), float(c.slab)) for c in cameras]
    return spark.createDataFrame(rows, "cam_id int, " + ", ".join(f"{n} {'int' if n in ('width', 'height') else 'double'}" for n in SETTINGS))


class Row:
    """The camera of a row: what projection asks of a Camera, as columns of prepared()."""

    columns = (*SETTINGS, "half_x", "half_y", *(f"{n}_{a}" for n in ("forward", "right", "top") for a in AXES))

    def __init__(self, kind: str):
        self.kind = kind
        self.position, self.look_at = (tuple(F.col(f"{n}_{a}") for a in AXES) for n in ("position", "look_at"))
        self.width, self.height, self.slab = F.col("width"), F.col("height"), F.col("slab")
        self.half = F.col("half_x"), F.col("half_y")

    def basis(self) -> tuple[tuple[Column, ...], ...]:
        return tuple(tuple(F.col(f"{n}_{a}") for a in AXES) for n in ("right", "top", "forward"))


def prepared(cameras: DataFrame, kind: str) -> DataFrame:
    """cam_id, the settings and the camera's axes and half extents. Cameras that look at their own place, or along their
    up, have no axes: they see nothing and go, as do those without pixels or with a null setting."""
    unit = lambda v: [x / F.sqrt(sum((y * y for y in v[1:]), v[0] * v[0])) for x in v]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    eye, at, up = ([F.col(f"{n}_{a}").cast("double") for a in AXES] for n in ("position", "look_at", "up"))
    way = [b - a for a, b in zip(eye, at, strict=True)]
    long = lambda v: sum((x * x for x in v[1:]), v[0] * v[0]) > 0
    kept = cameras.select("cam_id", *SETTINGS).dropna().where((F.col("width") > 0) & (F.col("height") > 0) & long(way) & long(cross(way, up)))
    for name, v in (("forward", unit(way)), ("right", unit(cross([F.col(f"forward_{a}") for a in AXES], up))), ("top", unit(cross([F.col(f"right_{a}") for a in AXES], [F.col(f"forward_{a}") for a in AXES])))):
        kept = kept.withColumns({f"{name}_{a}": x for a, x in zip(AXES, v, strict=True)})
    high = F.col("ortho_width") / S.lit(2) if kind == "orthographic" else F.tan(F.radians("fov") / S.lit(2))
    return settle(kept.withColumns({"half_x": high * F.col("width") / F.col("height"), "half_y": high}))


def levels(cells: int) -> int:
    """The highest level: that of one cell."""
    return max(0, math.ceil(math.log2(cells)))


def visible(cameras: DataFrame, kind: str, low: tuple[float, ...], side: float, cells: int) -> DataFrame:
    """(cam_id, level, c0, c1, c2): cells whose particles a camera may see. A cell with the reach of its particles lies in
    a sphere, which is held against the sides of the view and the slab; on the highest level all cameras see the cell."""
    c, top = Row(kind), levels(cells)
    df = prepared(cameras, kind).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    df = df.withColumn("__s", S.lit(side / cells) * F.pow(S.lit(2), F.col("level")))
    last = F.floor(F.lit(cells - 1) / F.pow(S.lit(2), F.col("level"))).cast("int")
    for i in range(3):
        df = df.withColumn(f"c{i}", F.explode(F.sequence(F.lit(0), last)))
    middle = [S.lit(lo) + (F.col(f"c{i}") + S.lit(0.5)) * F.col("__s") for i, lo in enumerate(low)]
    r = F.col("__s") * S.lit(math.sqrt(3) / 2 + 1 + 1e-9)
    dot = lambda p, v: sum(((x - q) * w for x, q, w in list(zip(middle, p, v, strict=True))[1:]), (middle[0] - p[0]) * v[0])
    right, up, forward = c.basis()
    x, y, z = (dot(c.position, v) for v in (right, up, forward))
    if kind == "orthographic":
        sides = [F.abs(v) <= half + r for v, half in ((x, c.half[0]), (y, c.half[1]))]
    else:
        sides = [half * z - F.abs(v) >= -r * F.sqrt(S.lit(1) + half * half) for v, half in ((x, c.half[0]), (y, c.half[1]))]
    deep = (c.slab <= 0) | (F.abs(dot(c.look_at, forward)) <= c.slab / 2 + r)
    seen = reduce(lambda p, q: p & q, sides, (z >= -r) & deep)
    return df.where((F.col("level") == top) | seen).select("cam_id", "level", "c0", "c1", "c2")


def film_hits(df: DataFrame, cameras: DataFrame, low: tuple[float, ...], side: float, kind: str = "orthographic", cells: int = 16, h: str = "h", samples: int = 1) -> DataFrame:
    """hits() of every camera of a table (cam_id and SETTINGS; all of one kind): adds cam_id, py, px, sx, sy, t and b2.

    Particles outside the cube of `side` at `low`, without h or with a null coordinate, are not seen. Rows of one
    cam_id are cameras of their own that add up, so ids should be unique; a null id or setting makes no camera. The
    particles are read once, whatever the number of cameras."""
    top, size = levels(cells), side / cells
    names = [c for c in df.columns if c not in AXES]
    inside = reduce(lambda p, q: p & q, [(F.col(a) >= S.lit(lo)) & (F.col(a) < S.lit(lo + side)) for a, lo in zip(AXES, low, strict=True)])
    level = F.least(F.greatest(F.ceil(F.log2(2 * F.col(h) / S.lit(size))), F.lit(0)), F.lit(top)).cast("int")
    placed = df.where(inside & (F.col(h) > 0)).withColumn("level", level)
    cell = lambda a, lo: F.least(F.floor((F.col(a) - S.lit(lo)) / (S.lit(size) * F.pow(S.lit(2), F.col("level")))), F.floor(F.lit(cells - 1) / F.pow(S.lit(2), F.col("level")))).cast("int")
    placed = placed.withColumns({f"c{i}": cell(a, lo) for i, (a, lo) in enumerate(zip(AXES, low, strict=True))})
    met = placed.join(visible(cameras, kind, low, side, cells), ["level", "c0", "c1", "c2"]).drop("level", "c0", "c1", "c2")
    aims = prepared(cameras, kind).drop("up_x", "up_y", "up_z", "ortho_width", "fov")  # told by the axes and half extents
    found = hits(met.join(aims, "cam_id"), Row(kind), h, samples)
    return found.select("cam_id", *AXES, *names, "py", "px", "sx", "sy", "t", "b2")


def film_columns(found: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(cam_id, py, px, measures): columns() of each camera."""
    return columns(found, measures, ("cam_id",))


def film_means(found: DataFrame, measures: dict[str, tuple[Column, Column]]) -> DataFrame:
    return means(found, measures, ("cam_id",))


def film_emission(found: DataFrame, weight: Column, kappa_e: float, kappa_a: float, key: list[str], samples: int = 1) -> DataFrame:
    return emission(found, weight, kappa_e, kappa_a, key, samples, by=("cam_id",))


def film_rays(cameras: DataFrame, kind: str = "orthographic") -> DataFrame:
    """(cam_id, py, px, ox, oy, oz, dx, dy, dz, t0, t1): rays() of every camera, for segments() through a grid."""
    df = prepared(cameras, kind).withColumn("py", F.explode(F.expr("sequence(0, height - 1)"))).withColumn("px", F.explode(F.expr("sequence(0, width - 1)")))
    o, d = ray(Row(kind), F.col("px"), F.col("py"), S.lit(0.5), S.lit(0.5))
    df = settle(df.withColumns({f"o{a}": v for a, v in zip(AXES, o, strict=True)} | {f"d{a}": v for a, v in zip(AXES, d, strict=True)}))
    t0, t1 = slab(Row(kind), [F.col(f"o{a}") for a in AXES], [F.col(f"d{a}") for a in AXES])
    return df.select("cam_id", "py", "px", *(f"o{a}" for a in AXES), *(f"d{a}" for a in AXES), F.least(t0, S.lit(FAR)).alias("t0"), t1.alias("t1"))


def film_header(cameras: DataFrame, kind: str, channels: list[str]) -> DataFrame:
    """A row for each camera of the table, as written beside a film's maps."""
    triple = lambda n: F.array(*(F.col(f"{n}_{a}").cast("double") for a in AXES)).alias(f"camera_{n}")
    return cameras.select("cam_id", F.lit(kind).alias("camera_type"), triple("position"), triple("look_at"), triple("up"), "ortho_width", "fov", F.col("slab").alias("los_slab"), F.col("width").alias("image_width"), F.col("height").alias("image_height"), F.array(*map(F.lit, channels)).cast("array<string>").alias("channels"))


# ---- films through the grids of a table of tiers ---------------------------------------------------------------------


class GridRow:
    """The grid of a row, as columns center_x.., size_x.., n_x..: what projection asks of a Grid."""

    def __init__(self) -> None:
        self.size, self.shape = (tuple(F.col(f"{n}_{a}") for a in AXES) for n in ("size", "n"))
        self.low = tuple(F.col(f"center_{a}") - F.col(f"size_{a}") / 2 for a in AXES)
        self.cell = tuple(F.col(f"size_{a}") / F.col(f"n_{a}") for a in AXES)


def tier_segments(cameras: DataFrame, tiers: DataFrame, kind: str = "orthographic") -> DataFrame:
    """Segments of every camera's rays through the grid of its tier: cam_id, tier, py, px, ix, iy, iz, t, ds. cameras: a
    camera table with the column tier; tiers: tier and the columns of grid_rows (a few rows)."""
    grids = tiers.select("tier", *(f"{n}_{a}" for n in ("center", "size", "n") for a in AXES))
    found = film_rays(cameras, kind).join(cameras.select("cam_id", "tier"), "cam_id").join(grids, "tier")
    return segments(found, GridRow()).select("cam_id", "tier", "py", "px", "dx", "dy", "dz", "ix", "iy", "iz", "t", "ds")


def zoom_film(cameras: DataFrame, tiers: DataFrame, cells: DataFrame, kind: str = "orthographic") -> DataFrame:
    """tier_segments() with the cells (tier, ix, iy, iz, fields) they cross, for sums by (cam_id, py, px). All runs of frames
    with one tier are one plan. cells, read from a table partitioned by tier, are read for the tiers that frames chose and
    no others: which these are is found out while the query runs."""
    used = cameras.agg(F.collect_set("tier")).scalar()  # as many names as there are tiers
    read = cells.where(F.array_contains(used, F.col("tier")))  # a filter of partitions that is known when the scan begins
    return tier_segments(cameras, tiers, kind).join(read, ["tier", "ix", "iy", "iz"])
