"""Cubes and maps as Parquet folders with a header row, and camera lists for many frames."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.config import Camera, Grid, Region

INDEX = ["ix", "iy", "iz"]


def header(spark: SparkSession, grid: Grid, **provenance) -> DataFrame:
    """One row: name, center, size, side, shape, resolution, cell_size, then provenance (redshift, snapshot, ...).

    side and resolution are those of the x axis, for readers of cubes with equal sides."""
    triple = lambda v: F.array(*(S.lit(x) for x in v))
    own = {"name": F.lit(grid.name), "center": triple(grid.center), "size": triple(grid.size), "side": S.lit(grid.size[0]), "shape": F.array(*map(F.lit, grid.shape)), "resolution": F.lit(grid.shape[0]), "cell_size": triple(grid.cell)}
    return spark.range(1).select(*(c.alias(k) for k, c in own.items()), *(F.lit(v).alias(k) for k, v in provenance.items()))


def write_cube(cube: DataFrame, grid: Grid, path: str, **provenance) -> None:
    """Cells (fields as float) and header. Cells that are missing hold zero."""
    fields = [F.col(c).cast("float").alias(c) for c in cube.columns if c not in INDEX]
    cube.select(*INDEX, *fields).write.mode("overwrite").parquet(f"{path}/cells")
    header(cube.sparkSession, grid, **provenance).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def read_header(spark: SparkSession, path: str) -> Grid:
    """The grid of a cube; one with only side and resolution has equal sides."""
    r = spark.read.parquet(f"{path}/header").first().asDict()
    size = r.get("size") or [r["side"]] * 3
    return Grid(tuple(r["center"]), tuple(size), tuple(r.get("shape") or [r["resolution"]] * 3), r.get("name", "grid"))


def read_cube(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Cells with the fields asked for, all if none are; a field that is missing is left out with a warning."""
    cells = spark.read.parquet(f"{path}/cells")
    wanted = [c for c in cells.columns if c not in INDEX] if not fields else fields
    for c in (c for c in wanted if c not in cells.columns):
        warnings.warn(f"{path} has no field {c}", stacklevel=2)
    return cells.select(*INDEX, *(c for c in wanted if c in cells.columns))


def write_maps(maps: DataFrame, path: str) -> None:
    """Maps (cam_id, py, px, channels) as one folder a camera, so that reading one frame reads no other."""
    maps.repartition("cam_id").write.mode("overwrite").partitionBy("cam_id").parquet(path)


def read_maps(spark: SparkSession, path: str, cameras: list[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if cameras is None else df.where(F.col("cam_id").isin(cameras))


def map_header(spark: SparkSession, cameras: list[Camera], channels: list[str], region: Region | None = None, **provenance) -> DataFrame:
    """A row for each camera: what it saw and how, the names of its channels, the region, then provenance
    (pipeline, grid_file or snapshot_path, redshift, n_stars_total, ...). Cameras are settings of a film: few."""
    seen = [(c.cam_id, c.kind, *([float(x) for x in v] for v in (c.position, c.look_at, c.up)), float(c.ortho_width), float(c.fov), float(c.slab), c.width, c.height) for c in cameras]
    kinds = "cam_id int, camera_type string, camera_position array<double>, camera_look_at array<double>, camera_up array<double>, ortho_width double, fov double, los_slab double, image_width int, image_height int"
    triple = lambda v: F.array(*(S.lit(x) for x in v))
    more = {"channels": F.array(*map(F.lit, channels)).cast("array<string>")}
    if region:
        more |= {"region_name": F.lit(region.name), "region_center": triple(region.center), "region_size": triple(region.size)}
    return spark.createDataFrame(seen, kinds).select("*", *(v.alias(k) for k, v in more.items()), *(F.lit(v).alias(k) for k, v in provenance.items()))


def write_projection(maps: DataFrame, cameras: list[Camera], path: str, region: Region | None = None, **provenance) -> None:
    """Maps (cam_id, py, px, channels as float) and their header; each channel keeps its name as a column."""
    place = ["cam_id", "py", "px"]
    channels = [c for c in maps.columns if c not in place]
    write_maps(maps.select(*place, *(F.col(c).cast("float").alias(c) for c in channels)), f"{path}/maps")
    map_header(maps.sparkSession, cameras, channels, region, **provenance).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def read_cameras(spark: SparkSession, path: str) -> list[Camera]:
    """The cameras of written projections, by cam_id."""
    rows = spark.read.parquet(f"{path}/header").orderBy("cam_id").collect()
    return [Camera(tuple(r["camera_position"]), tuple(r["camera_look_at"]), tuple(r["camera_up"]), r["camera_type"], r["image_width"], r["image_height"], r["ortho_width"], r["fov"], r["los_slab"], r["cam_id"]) for r in rows]


def field_list(names):
    """Distinct non-empty names of a comma-separated list, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x != ""))
