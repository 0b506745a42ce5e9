"""Star light: selection, ages, population luminosities, and splats on an image."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.config import Camera


def valid(stars: DataFrame, a_now: float) -> DataFrame:
    """Stars that formed until now with mass and metals; wind particles (a_form <= 0) go."""
    return stars.where((F.col("a_form") > 0) & (F.col("a_form") < S.lit(a_now + 1e-6)) & (F.col("metallicity") > 0) & (F.col("m_init") > 0))


def clip(stars: DataFrame, center: tuple[float, ...], radius: float, dim: float | None = None) -> DataFrame:
    """Stars within a radius; with dim, the others stay at that share of their light (column clip_gain)."""
    inside = sum((F.pow(F.col(a) - S.lit(c), 2) for a, c in zip("yz", center[1:], strict=True)), F.pow(F.col("x") - S.lit(center[0]), 2)) <= S.lit(radius * radius)
    return stars.where(inside) if dim is None else stars.withColumn("clip_gain", F.when(inside, S.lit(1)).otherwise(S.lit(dim)))


def age_table(spark: SparkSession, samples: int = 20_000) -> DataFrame:
    """(i, a, age): age in Gyr at scale factors in equal ratios from 1e-5 to 1, by trapezoids.

    The running sum has one task; the table's size is a setting, not the data's."""
    t = spark.range(samples).select(F.col("id").alias("i"), F.pow(S.lit(10), S.lit(-5) + S.lit(5) * F.col("id") / S.lit(samples - 1)).alias("a"))
    f = 1 / (F.col("a") * F.sqrt(S.lit(S.OMEGA_M) / F.pow("a", S.lit(3)) + S.lit(S.OMEGA_L)))
    w = Window.orderBy("i")
    strip = F.coalesce((F.col("f") + F.lag("f").over(w)) / 2 * (F.col("a") - F.lag("a").over(w)), S.lit(0))
    strips = t.withColumn("f", f).withColumn("s", strip)
    return strips.select("i", "a", (F.sum("s").over(w) * S.lit(S.GYR_FACTOR / S.HUBBLE)).alias("age"))


def age_at(stars: DataFrame, table: DataFrame, a: str, samples: int = 20_000) -> DataFrame:
    """Adds age: the table's line at a, held within it. A scale factor's place follows from its logarithm, so this is an equi-join."""
    nxt = Window.orderBy("i")
    spans = table.select("i", F.col("a").alias("__a0"), F.col("age").alias("__t0"), F.lead("a").over(nxt).alias("__a1"), F.lead("age").over(nxt).alias("__t1")).where("__a1 is not null")
    at = F.least(F.greatest(F.col(a), S.lit(1e-5)), S.lit(1))
    place = F.least(F.greatest(F.floor((F.log10(at) + 5) / 5 * (samples - 1)), F.lit(0)), F.lit(samples - 2))
    df = stars.withColumns({"__x": at, "i": place}).join(F.broadcast(spans), "i")  # as many rows as `samples`
    return df.withColumn("age", F.col("__t0") + (F.col("__t1") - F.col("__t0")) * (F.col("__x") - F.col("__a0")) / (F.col("__a1") - F.col("__a0"))).drop("__x", "i", "__a0", "__a1", "__t0", "__t1")


def population(stars: DataFrame, lattice: dict[str, list], a_now: float) -> DataFrame:
    """Adds age, log_age, log_z and the luminosity of each band: bilinear in the lattice's log_age and log_z, clamped to
    it. lattice: log_age and log_z (increasing) and bands L_*, a row for each log_age. It is small and put into the plan."""
    ages, metals = lattice["log_age"], lattice["log_z"]
    df = stars.withColumn("age", S.stellar_age(F.col("a_form"), a_now))
    df = df.withColumns({"log_age": F.log10("age"), "log_z": F.log10(F.col("metallicity") / S.lit(S.SOLAR_METALLICITY))})

    def place(x: str, axis: list[float]) -> tuple[Column, Column]:
        v = F.least(F.greatest(F.col(x), S.lit(axis[0])), S.lit(axis[-1]))
        i = sum((F.when(v > S.lit(a), 1).otherwise(0) for a in axis[1:-1]), F.lit(0))  # cells whose end lies below v
        at = F.array(*map(S.lit, axis))
        return i, (v - F.get(at, i)) / (F.get(at, i + 1) - F.get(at, i))

    (ia, fa), (iz, fz) = place("log_age", ages), place("log_z", metals)
    df = df.withColumns({"__ia": ia, "__iz": iz, "__fa": fa, "__fz": fz})
    n, a, z = len(metals), F.col("__fa"), F.col("__fz")
    for band in (b for b in lattice if b.startswith("L_")):
        flat = F.array(*(S.lit(x) for row in lattice[band] for x in row))
        v = lambda i, j, flat=flat: F.get(flat, (F.col("__ia") + i) * n + F.col("__iz") + j)
        share = (1 - a) * (1 - z) * v(0, 0) + (1 - a) * z * v(0, 1) + a * (1 - z) * v(1, 0) + a * z * v(1, 1)
        df = df.withColumn(band, share * F.col("m_init") * S.lit(S.MASS_UNIT / S.LITTLE_H))
    return df.drop("__ia", "__iz", "__fa", "__fz")


def brightness_gain(stars: DataFrame, camera: tuple[float, ...], d_ref: float, floor: float, power: float) -> Column:
    d2 = sum((F.pow(F.col(a) - S.lit(c), 2) for a, c in zip("yz", camera[1:], strict=True)), F.pow(F.col("x") - S.lit(camera[0]), 2))
    return F.pow(S.lit(d_ref * d_ref) / F.greatest(d2, S.lit(floor * floor)), S.lit(power / 2))


def project(stars: DataFrame, camera: Camera) -> DataFrame:
    """Adds pixel indices of stars before the eye and near the frame. Here the field of view is the horizontal one."""
    r, u, f = camera.basis()
    delta = [F.col(a) - S.lit(p) for a, p in zip("xyz", camera.position, strict=True)]
    dot = lambda v: sum((d * S.lit(x) for d, x in zip(delta[1:], v[1:], strict=True)), delta[0] * S.lit(v[0]))
    tx = math.tan(math.radians(camera.fov) / 2)
    df = stars.withColumns({"__x": dot(r), "__y": dot(u), "__z": dot(f)}).where(F.col("__z") > 1)
    df = df.withColumns({"__px": (F.col("__x") / (F.col("__z") * S.lit(tx)) * 0.5 + 0.5) * camera.width, "__py": (-F.col("__y") / (F.col("__z") * S.lit(tx * camera.height / camera.width)) * 0.5 + 0.5) * camera.height})
    df = df.where((F.col("__px") >= -5) & (F.col("__px") < camera.width + 5) & (F.col("__py") >= -5) & (F.col("__py") < camera.height + 5))
    return df.withColumns({"px": F.bround("__px").cast("int"), "py": F.bround("__py").cast("int")}).drop("__x", "__y", "__z", "__px", "__py")


def stamp(sigma: float, reach: float) -> list[tuple[int, int, float]]:
    """(dy, dx, share) of a Gaussian that sums to 1."""
    rad = math.ceil(reach * sigma)
    raw = [(y, x, math.exp(-(x * x + y * y) / (2 * sigma * sigma))) for y in range(-rad, rad + 1) for x in range(-rad, rad + 1)]
    total = sum(w for *_, w in raw)
    return [(y, x, w / total) for y, x, w in raw]


def splat(stars: DataFrame, camera: Camera, bands: list[str], sigma: float = 0.7, reach: float = 3.0) -> DataFrame:
    """(py, px, bands): each star's light spread over a stamp. A pixel's stars are summed before they are spread."""
    lit = stars.groupBy("py", "px").agg(*(F.sum(b).alias(b) for b in bands))
    cells = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(w).alias("w")) for y, x, w in stamp(sigma, reach)))
    df = lit.withColumn("__s", F.explode(cells)).select((F.col("py") + F.col("__s.y")).alias("py"), (F.col("px") + F.col("__s.x")).alias("px"), *((F.col(b) * F.col("__s.w")).alias(b) for b in bands))
    return df.where((F.col("py") >= 0) & (F.col("py") < camera.height) & (F.col("px") >= 0) & (F.col("px") < camera.width)).groupBy("py", "px").agg(*(F.sum(b).alias(b) for b in bands))


def totals(stars: DataFrame, bands: list[str]) -> DataFrame:
    """One row: number of stars and the luminosity of each band, over all of them."""
    return stars.agg(F.count(F.lit(1)).alias("n"), *(F.sum(b).alias(b) for b in bands))


def in_frame(stars: DataFrame, projected: DataFrame, camera: Camera) -> DataFrame:
    """One row, for a star map's header: how many stars there are and how many fall on the image."""
    on = (F.col("px") >= 0) & (F.col("px") < camera.width) & (F.col("py") >= 0) & (F.col("py") < camera.height)
    return stars.agg(F.count(F.lit(1)).alias("n_stars_total")).crossJoin(F.broadcast(projected.agg(F.count_if(on).alias("n_stars_in_frame"))))  # one row each


def lattice(table: DataFrame) -> dict[str, list]:
    """The lattice that population() takes, from a table (log_age, log_z, any bands L_*) with a row for each pair of a
    lattice's ages and metallicities, in any order. Its size is a model's, not the data's; a pair that is missing or
    comes twice is an error."""
    rows = table.orderBy("log_age", "log_z").collect()
    bands = [c for c in table.columns if c.startswith("L_")]
    ages, metals = sorted({r["log_age"] for r in rows}), sorted({r["log_z"] for r in rows})
    if [(r["log_age"], r["log_z"]) for r in rows] != [(a, z) for a in ages for z in metals]:
        raise ValueError("the lattice does not hold each pair of an age and a metallicity once")
    n = len(metals)
    return {"log_age": ages, "log_z": metals} | {b: [[r[b] for r in rows[i * n : (i + 1) * n]] for i in range(len(ages))] for b in bands}
