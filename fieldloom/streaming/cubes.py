"""Cubes from arriving subfiles: deposits are sums, so a stream of particles keeps adding to the cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.particles import deposit
from ..plans.config import Grid


def deposit_stream(spark: SparkSession, folder: str, schema, grid: Grid, box: float, sums: dict[str, Column], per_batch: int = 16) -> DataFrame:
    """A streaming cube of the Parquet files that arrive in a folder; write it in complete or update mode."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return deposit(source, grid, box, sums)
