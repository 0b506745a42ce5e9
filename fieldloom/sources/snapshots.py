"""Snapshots: a header and particles of several kinds in numbered subfiles, kept as Parquet folders.

A path that ends in .parquet is the only subfile; any other one is the front of path.0.parquet, path.1.parquet and so
on, as many as the first one's header says. A subfile holds the tables Header (one row) and PartType0 (gas), PartType1
(dark matter) and PartType4 (stars), where it has particles of that kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

AXES = "xyz"


@dataclass(frozen=True)
class Header:
    boxsize: float
    redshift: float
    time: float
    hubble_param: float
    omega0: float
    omega_lambda: float
    num_files: int
    num_part_total: tuple[int, ...]


def subfile(path: str, i: int) -> str:
    return path if path.endswith(".parquet") else f"{path}.{i}.parquet"


def read_header(spark: SparkSession, path: str) -> Header:
    """The header of a snapshot, from its first subfile."""
    r = spark.read.parquet(f"{subfile(path, 0)}/Header").first()
    numbers = (r[n] for n in ("BoxSize", "Redshift", "Time", "HubbleParam", "Omega0", "OmegaLambda"))
    return Header(*map(float, numbers), int(r["NumFilesPerSnapshot"]), tuple(map(int, r["NumPart_Total"])))


def subfiles(path: str, header: Header) -> list[str]:
    count = 1 if path.endswith(".parquet") else header.num_files
    return [subfile(path, i) for i in range(count)]


def raw(spark: SparkSession, path: str, kind: int) -> DataFrame | None:
    """All particles of a kind with the number of their subfile, as stored; None if no subfile has any. Subfiles may
    differ in which columns they hold. Their headers (a row each) say which have particles."""
    found = []
    every = subfiles(path, read_header(spark, path))
    for i, folder in enumerate(every):
        held = spark.read.parquet(f"{folder}/Header").first()["NumPart_ThisFile"][kind]
        if held:
            found.append(spark.read.parquet(f"{folder}/PartType{kind}").withColumn("subfile", F.lit(i)))
    if not found:
        return None
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def _position(df: DataFrame, box: float) -> dict[str, Column]:
    """x, y, z from 32-bit fixed-point coordinates where a row has them, otherwise from floating ones."""
    out = {}
    for i, a in enumerate(AXES):
        kinds = []
        if "IntCoordinates" in df.columns:
            kinds.append(S.decode_fixed(F.get("IntCoordinates", F.lit(i)), box))
        if "Coordinates" in df.columns:
            kinds.append(F.get("Coordinates", F.lit(i)).cast("double"))
        if not kinds:
            raise ValueError("particles have neither IntCoordinates nor Coordinates")
        out[a] = F.coalesce(*kinds)
    return out


def _optional(df: DataFrame, name: str, default: float) -> Column:
    """A stored column; its default where a table or a subfile lacks it."""
    return F.coalesce(F.col(name).cast("double"), S.lit(default)) if name in df.columns else S.lit(default)


def _kept(df: DataFrame) -> list[str]:
    """What rows are told apart by stays."""
    return [c for c in ("ParticleIDs", "subfile") if c in df.columns]


def gas(df: DataFrame, box: float) -> DataFrame:
    """Stored gas as particles: position, mass, density, h, internal_energy, temperature, metallicity, hii, velocity.
    Metallicity and ionised fraction are 0 where they are not stored; h follows from the volume."""
    own = {"mass": F.col("Masses").cast("double"), "density": F.col("Density").cast("double"), "internal_energy": F.col("InternalEnergy").cast("double")}
    own |= {"metallicity": _optional(df, "GFM_Metallicity", 0), "hii": _optional(df, "HII_Fraction", 0)}
    own |= {f"v{a}": F.get("Velocities", F.lit(i)).cast("double") for i, a in enumerate(AXES)}
    out = df.select(*_kept(df), *(c.alias(n) for n, c in (_position(df, box) | own).items()))
    made = {"h": S.smoothing_length(F.col("mass"), F.col("density")), "temperature": S.temperature(F.col("internal_energy"), F.col("hii"))}
    return out.withColumns(made)


def dark_matter(df: DataFrame, box: float) -> DataFrame:
    """Stored dark matter as particles: position and mass, 1 where it is not stored."""
    return df.select(*_kept(df), *(c.alias(n) for n, c in _position(df, box).items()), _optional(df, "Masses", 1).alias("mass"))


def stars(df: DataFrame, box: float) -> DataFrame:
    """Stored stars as particles: position, mass (0 where it is not stored), and for star light the scale factor at
    formation, metallicity and initial mass, null where they are not stored."""
    light = {"a_form": "GFM_StellarFormationTime", "metallicity": "GFM_Metallicity", "m_init": "GFM_InitialMass"}
    extra = [(F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")).alias(n) for n, c in light.items()]
    return df.select(*_kept(df), *(c.alias(n) for n, c in _position(df, box).items()), _optional(df, "Masses", 0).alias("mass"), *extra)
