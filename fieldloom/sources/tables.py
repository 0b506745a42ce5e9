"""Particle tables: Parquet snapshots, and adapters that read particles out of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

BOX = 1000.0


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _place(number: str) -> str:
    return f"CAST(({number}) % 10007 AS DOUBLE) / 10007.0D * 1000.0D"


#: Columns of `gas` as SQL over lineitem; integer hashes make positions that any engine gives alike.
GAS = {
    "x": _place("l_orderkey * 7919 + l_linenumber * 104729"),
    "y": _place("l_partkey * 15485863 + l_linenumber * 31"),
    "z": _place("l_suppkey * 32452843 + l_orderkey * 13"),
    "mass": "CAST(l_quantity AS DOUBLE)",
    "density": "CAST(l_quantity AS DOUBLE) / (8.0D * (1.0D + l_linenumber))",
    "internal_energy": "CAST(l_extendedprice AS DOUBLE) / 50.0D",
    "metallicity": "CAST(l_discount AS DOUBLE) / 5.0D",
    "hii": "CAST(l_tax AS DOUBLE) * 12.0D",
    "vx": "(CAST(l_quantity AS DOUBLE) - 25.0D) * 10.0D",
    "vy": "(CAST(l_discount AS DOUBLE) - 0.05D) * 4000.0D",
    "vz": "(CAST(l_tax AS DOUBLE) - 0.04D) * 5000.0D",
}
GAS_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
DM = {
    "pid": "CAST(o_orderkey AS BIGINT)",
    "x": _place("o_orderkey * 7919 + 17"),
    "y": _place("o_custkey * 15485863 + o_orderkey * 31"),
    "z": _place("o_orderkey * 32452843 + o_custkey * 13"),
    "mass": "1.0D",
    "h": "CAST(o_totalprice AS DOUBLE) / 100000.0D + 1.0D",
}
STARS = {
    "pid": "CAST(p_partkey AS BIGINT)",
    "x": _place("p_partkey * 7919 + 17"),
    "y": _place("p_partkey * 15485863 + 31"),
    "z": _place("p_partkey * 32452843 + 13"),
    "a_form": "CASE WHEN p_partkey % 50 = 0 THEN -0.1D ELSE 0.05D + 0.15D * ((p_partkey * 7919) % 1000) / 1000.0D END",
    "metallicity": "CAST(p_size AS DOUBLE) / 2500.0D",
    "m_init": "CAST(p_retailprice AS DOUBLE) / 1000000.0D",
}


def gas(spark: SparkSession, folder: str) -> DataFrame:
    """Gas particles with smoothing length h and temperature; key columns make rows distinct."""
    df = read(spark, folder, "lineitem").selectExpr(*GAS_KEY, *(f"{e} AS {n}" for n, e in GAS.items()))
    return df.withColumns({"h": S.smoothing_length(F.col("mass"), F.col("density")), "temperature": S.temperature(F.col("internal_energy"), F.col("hii"))})


def dm(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").selectExpr(*(f"{e} AS {n}" for n, e in DM.items()))


def stars(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").selectExpr(*(f"{e} AS {n}" for n, e in STARS.items()))


def snapshot(spark: SparkSession, path: str, defaults: dict[str, float] | None = None) -> DataFrame:
    """A particle table from Parquet subfiles; columns that are missing get their default."""
    df = spark.read.parquet(path)
    return df.withColumns({c: S.lit(v) for c, v in (defaults or {}).items() if c not in df.columns})
