"""Maps by the names that users ask for: each name says how it is summed, what it weighs and how it ends."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import projection as PR
from .config import Camera, Grid, Projection


def column_requests() -> dict[str, tuple[str, Column]]:
    """Request -> (map, weight): sums of mass x weight along the ray."""
    w = PR.column_weights()
    out = {
        "gas_density": ("gas_column_density", w["gas_density"]),
        "metal_column": ("metal_column_density", w["metal"]),
        "velocity_column": ("gas_speed_column", w["speed"]),
        "hii_column": ("hii_column_density", w["hii"]),
    }
    return out | {f"{p}_col": (f"gas_{p}_column", w[p]) for p in ("cold", "warm", "hot")}


def mean_requests(camera: Camera) -> dict[str, dict[str, tuple[Column, Column]]]:
    """Request -> its maps as (value, extra weight): means over mass x extra weight. Speed along the line of sight is
    taken along the camera's axis, for every pixel."""
    one, density = S.lit(1), F.col("density")
    weights = {"": one, "_dw": density, "_vw": F.when(density > 0, 1 / density).otherwise(S.lit(0))}
    out = {}
    for name in ("temperature", "metallicity"):
        for tail, w in weights.items():
            out[name + tail] = {f"gas_{name}{tail or '_mw'}": (F.col(name), w)}
    forward = camera.basis()[2]
    along = reduce(lambda p, q: p + q, [F.col(f"v{a}") * S.lit(x) for a, x in zip("xyz", forward, strict=True)])
    out["los_velocity"] = {"gas_vlos_mw": (along, one)}
    out["gas_velocity"] = {f"gas_v{a}_mw": (F.col(f"v{a}"), one) for a in "xyz"}
    return out


def particle_maps(found: DataFrame, camera: Camera, names: list[str]) -> DataFrame:
    """(py, px, a column for each map asked for) from the hits of a camera's rays, all in one aggregation. Names that
    are nothing but volume requests are for volume_maps(); unknown ones are left out with a warning."""
    columns, means = column_requests(), mean_requests(camera)
    weight = F.col("mass") * S.column_kernel(F.col("b2"), F.col("h"))
    found = found.withColumn("__k", weight)
    sums, ends = [], []
    for name in dict.fromkeys(names):
        if name in columns:
            out, w = columns[name]
            sums.append(F.sum(F.col("__k") * w).alias(out))
            ends.append(F.col(out))
        for out, (value, extra) in means.get(name, {}).items():
            sums += [F.sum(F.col("__k") * extra * value).alias(f"{out}_n"), F.sum(F.col("__k") * extra).alias(f"{out}_d")]
            ends.append(F.coalesce(F.try_divide(F.col(f"{out}_n"), F.col(f"{out}_d")), S.lit(0)).alias(out))
        if name not in columns and name not in means and name not in PR.KAPPA:
            warnings.warn(f"unknown request {name} is left out", stacklevel=2)
    return found.groupBy("py", "px").agg(*sums, F.count(F.lit(1)).alias("__hits")).select("py", "px", *ends)


def volume_maps(found: DataFrame, names: list[str], key: list[str], samples: int = 1) -> dict[str, DataFrame]:
    """Request -> (py, px, emission, transmittance) of those requests that are volumes."""
    weights = PR.volume_weights()
    return {n: PR.emission(found, weights[n], *PR.KAPPA[n], key, samples) for n in dict.fromkeys(names) if n in PR.KAPPA}


def grid_fields(jobs: list[list[Projection]]) -> list[str]:
    """Fields of a cube that the projections of all jobs need, each once, in order of need."""
    extra = {"mass_weighted": ["gas_density"], "los_velocity": ["gas_density", "vx", "vy", "vz"]}
    return list(dict.fromkeys(f for job in jobs for p in job for f in [p.field, *extra.get(p.mode, [])]))


def grid_maps(spark: SparkSession, cube: DataFrame, grid: Grid, camera: Camera, projections: list[Projection]) -> DataFrame:
    """(py, px, field_mode, ...) of a cube by a camera, every projection in one aggregation; an unknown mode is left out
    with a warning. Speed along the line of sight is taken along each pixel's ray."""
    rho, ds = F.col("gas_density"), F.col("ds")
    along = reduce(lambda p, q: p + q, [F.col(f"v{a}") * F.col(f"d{a}") for a in "xyz"])
    out = []
    for p in projections:
        value = {"column": None, "mass_weighted": F.col(p.field), "los_velocity": along}
        if p.mode not in value:
            warnings.warn(f"unsupported projection mode {p.mode} is left out", stacklevel=2)
        elif p.mode == "column":
            out.append(F.sum(F.col(p.field) * ds).alias(f"{p.field}_column"))
        else:
            mean = F.try_divide(F.sum(rho * value[p.mode] * ds), F.sum(rho * ds))
            out.append(F.coalesce(mean, S.lit(0)).alias(f"{p.field}_{p.mode}"))
    parts = PR.segments(PR.rays(spark, camera), grid)
    found = PR.through_grid(parts, cube.select("ix", "iy", "iz", *grid_fields([[p for p in projections if p.mode in ("column", "mass_weighted", "los_velocity")]])))
    return found.groupBy("py", "px").agg(*out, F.count(F.lit(1)).alias("__cells")).drop("__cells")
