"""Renders a film: a map of each measure for every camera of a table, and images toned alike over the film.

Frames that are there already, for the same settings of their camera, are not rendered again, so a film that was stopped
goes on where it was, and new cameras are added to it. All missing frames are rendered in one pass over the particles. The
tone of a frame goes from one percentile of its map to another; both are smoothed over the frames, so that a film does
not flicker, and follow from all maps.

    python -m jobs.film --config jobs/film.json --particles /data/snapshot --cameras /data/cameras --out /data/film

Under --out, by cam_id: maps (py, px, measures; pixels that nothing touches are left out), frames (one row: what the camera
was), images (py, px and each measure as 0 to 1); by measure: percentiles (frame, p0, p1) and ranges (frame, low, high).
Particles that change need another --out.
"""

from __future__ import annotations

import argparse
import json
import logging
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import scalars as S
from fieldloom.operators import films, frames, images
from fieldloom.operators.particles import cull
from fieldloom.plans.config import Region

log = logging.getLogger("jobs.film")
FRAME = ["cam_id", "settings"]


def put(df: DataFrame, path: str, by: str = "cam_id") -> None:
    """Write partitions by `by`; those that df has are replaced, others stay."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What an earlier run wrote; nothing if there was none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def render(particles: DataFrame, cameras: DataFrame, config: dict) -> DataFrame:
    """(cam_id, py, px, measures) of all cameras, in one pass."""
    r, view = config["region"], config["view"]
    region = Region(tuple(map(float, r["center"])), tuple(map(float, r.get("size", (0, 0, 0)))), float(r.get("radius", 0)), float(r.get("margin", 0)))
    seen = cull(particles, region, config["box"], 2 * F.col("h"))
    found = films.film_hits(seen, cameras, tuple(map(float, view["low"])), float(view["side"]), view.get("kind", "orthographic"), view.get("cells", 16))
    return films.film_columns(found, {n: F.expr(e) for n, e in config["measures"].items()})


def percentiles(maps: DataFrame, measures: list[str], shares: list[float]) -> DataFrame:
    """(measure, frame, p0, p1): percentiles of the positive values of each measure's map of each frame."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures))).alias("x")
    return images.percentiles(maps.select(F.col("cam_id").alias("frame"), values).select("frame", "x.*"), "v", shares, ["measure", "frame"])


def tone(found: DataFrame, measure: str, n: int) -> DataFrame:
    """(measure, frame, low, high): a measure's percentiles, gaps filled, smoothed over n frames."""
    series = frames.frames(found.sparkSession, n).join(found.where(F.col("measure") == measure), "frame", "left")
    low, high = (frames.rolling_mean(frames.fill(series.select("frame", p), p), p, n).withColumnRenamed(p, name) for p, name in (("p0", "low"), ("p1", "high")))
    return low.join(high, "frame").withColumn("measure", F.lit(measure))


def run(spark: SparkSession, particles_path: str, cameras_path: str, out: str, config: dict) -> DataFrame:
    """One run. Returns the film's images: py, px, measures (0 to 1), cam_id. cam_ids number the frames from 0; several rows
    of one cam_id, and rows with a null setting, are no camera."""
    cameras = spark.read.parquet(cameras_path).selectExpr(*(f"{e} AS {c}" for c, e in config["cameras"].items())).dropna()
    one = cameras.groupBy("cam_id").count().where("count = 1").select("cam_id")
    cameras = cameras.join(one, "cam_id", "left_semi").withColumn("cam_id", F.col("cam_id").cast("int"))
    settings = F.sha2(F.to_json(F.struct(*films.SETTINGS)), 256).alias("settings")
    wanted = cameras.select("cam_id", settings)
    done = there(spark, f"{out}/frames", "settings string, cam_id int").select(*FRAME)
    missing = wanted.join(done, FRAME, "left_anti")
    n_missing, n_wanted, last = missing.count(), *wanted.agg(F.count(F.lit(1)), F.max("cam_id")).first()
    log.info("%d of %d frames of %s are missing", n_missing, n_wanted, cameras_path)
    if n_missing:
        seen = Observation()
        particles = spark.read.parquet(particles_path).selectExpr(*(f"{e} AS {c}" for c, e in config["particles"].items())).observe(seen, F.count(F.lit(1)).alias("rows"))
        put(render(particles, cameras.join(missing.select("cam_id"), "cam_id", "left_semi"), config), f"{out}/maps")
        put(missing, f"{out}/frames")  # last: a frame counts as there once its map is
        log.info("read %d particles of %s, rendered %d frames to %s/maps", seen.get["rows"], particles_path, n_missing, out)
    measures = list(config["measures"])
    maps = there(spark, f"{out}/maps", "py int, px int, " + ", ".join(f"{m} double" for m in measures) + ", cam_id int").join(wanted.select("cam_id"), "cam_id", "left_semi")
    put(percentiles(maps, measures, config["range"]), f"{out}/percentiles", "measure")
    found = spark.read.schema("frame int, p0 double, p1 double, measure string").parquet(f"{out}/percentiles")
    put(reduce(DataFrame.unionByName, [tone(found, m, (last or 0) + 1) for m in measures]), f"{out}/ranges", "measure")
    ranges, shown = spark.read.schema("frame int, low double, high double, measure string").parquet(f"{out}/ranges"), maps
    for m in measures:
        ends = ranges.where(F.col("measure") == m).select(F.col("frame").alias("cam_id"), F.log10("low").alias("__lo"), F.log10("high").alias("__hi"))
        share = F.try_divide(F.log10(m) - F.col("__lo"), F.col("__hi") - F.col("__lo"))
        shown = shown.join(ends, "cam_id").withColumn(m, F.when(F.col(m) > 0, images.clamp(F.coalesce(share, S.lit(0)))).otherwise(S.lit(0))).drop("__lo", "__hi")
    put(shown.select("cam_id", "py", "px", *measures), f"{out}/images")
    film = spark.read.schema(f"py int, px int, {', '.join(f'{m} double' for m in measures)}, cam_id int").parquet(f"{out}/images")
    log.info("wrote %d pixels of %d frames to %s/images", film.count(), n_wanted, out)
    return film


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("config", "particles", "cameras", "out"):
        args.add_argument(f"--{name}", required=True)
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("film").getOrCreate()
    try:
        config = json.loads("\n".join(r["value"] for r in spark.read.text(given.config, wholetext=True).collect()))
        run(spark, given.particles, given.cameras, given.out.rstrip("/"), config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
