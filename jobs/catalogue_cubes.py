"""Keeps density cubes of growing catalogues: each run takes only the files that are new.

A catalogue is a folder (or one file) of Parquet files: particles of a simulation that is still being written, or any
table whose rows are given a place by expressions of the config, such as the sizes of texts. Every species of the config is
a file stream with a checkpoint. A batch is spread over the grids with the smoothing kernel and written as the cube of its
batch, so a batch that runs again after a failure writes over itself. Cubes are the sums of these parts.

    python -m jobs.catalogue_cubes --config jobs/catalogue_cubes.json --input gas=/data/gas --input texts=/data/texts --out /data/cubes

Under --out: parts/<species>/batch=<n> (cells of a batch), cubes/species=../grid=.. (ix, iy, iz, sums), checkpoints/<species>.
The checkpoints belong to the parts: move or delete them together.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.particles import deposit_grids, grid_rows
from fieldloom.plans.config import Grid

log = logging.getLogger("jobs.catalogue_cubes")
INDEX = ["ix", "iy", "iz"]


def grid(setting: dict) -> Grid:
    three = lambda v, kind: tuple(map(kind, v)) if isinstance(v, list) else (kind(v),) * 3
    return Grid(three(setting["center"], float), three(setting.get("size", setting.get("side")), float), three(setting["resolution"], int), setting["name"])


def cells(rows: DataFrame, spec: dict, box: float) -> DataFrame:
    """(grid, ix, iy, iz, sums): placed rows spread over each grid of a species; rows without a place or h are left out."""
    sums = {name: F.expr(e) for name, e in spec["sums"].items()}
    table = grid_rows(rows.sparkSession, [grid(g) for g in spec["grids"]])
    return deposit_grids(rows, table, box, sums)


def take(spark: SparkSession, path: str, spec: dict, box: float, out: str, name: str, files: int) -> int:
    """Deposit what has come since the last run; returns how many rows that were."""

    def batch(rows: DataFrame, number: int) -> None:
        cells(rows, spec, box).write.mode("overwrite").parquet(f"{out}/parts/{name}/batch={number}")

    schema = spark.read.parquet(path).schema
    source = f"{path[:-1]}[{path[-1]}]"  # a pattern that only this path meets: a stream takes a folder as it is, but one file only so
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    rows = rows.selectExpr(*(f"{e} AS {c}" for c, e in spec["columns"].items()))
    stream = rows.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoints/{name}").start()
    stream.awaitTermination()
    done = [p for p in stream.recentProgress if p["numInputRows"]]
    log.info("%s: read %d new rows of %s in %d batches", name, sum(p["numInputRows"] for p in done), path, len(done))
    return sum(p["numInputRows"] for p in done)


def cubes(spark: SparkSession, out: str, config: dict) -> DataFrame:
    """The cubes as they stand; a sum that only other species have is null."""
    sums = dict.fromkeys(s for spec in config["species"].values() for s in spec["sums"])
    return spark.read.schema(f"ix int, iy int, iz int, {', '.join(f'{s} double' for s in sums)}, species string, grid string").parquet(f"{out}/cubes")


def run(spark: SparkSession, inputs: dict[str, str], out: str, config: dict) -> DataFrame:
    """One run over the species that have an input: new files in, cubes out. Returns the cubes: species, grid, ix, iy, iz
    and the sums. Only the species taken are written anew, by overwriting their own partitions; a run with nothing new
    writes the same cubes again, which mends a run that ended before it had written them."""
    for name, path in ((n, p.rstrip("/")) for n, p in inputs.items()):
        spec = config["species"][name]
        take(spark, path, spec, config["box"], out, name, config.get("files_per_batch", 1000))
        fields = ", ".join(f"{s} double" for s in spec["sums"])
        parts = spark.read.schema(f"grid string, ix int, iy int, iz int, {fields}, batch int").parquet(f"{out}/parts/{name}")
        whole = parts.groupBy("grid", *INDEX).agg(*(F.sum(s).alias(s) for s in spec["sums"])).withColumn("species", F.lit(name))
        target = whole.repartition("grid").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        target.partitionBy("species", "grid").parquet(f"{out}/cubes")
        for r in cubes(spark, out, config).where(F.col("species") == name).groupBy("grid").count().orderBy("grid").collect():  # a row a grid
            log.info("%s: wrote %d cells of %s to %s/cubes", name, r["count"], r["grid"], out)
    return cubes(spark, out, config)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    args.add_argument("--config", required=True)
    args.add_argument("--input", action="append", required=True, metavar="SPECIES=PATH")
    args.add_argument("--out", required=True)
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("catalogue_cubes").getOrCreate()
    try:
        config = json.loads("\n".join(r["value"] for r in spark.read.text(given.config, wholetext=True).collect()))
        run(spark, dict(x.split("=", 1) for x in given.input), given.out.rstrip("/"), config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
