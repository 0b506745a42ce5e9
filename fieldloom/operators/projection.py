"""Maps by rays: particles scattered to the pixels they may touch, and grids cut by rays into segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.config import Camera, Grid

AXES = "xyz"
FAR = 1e308


def settle(df: DataFrame) -> DataFrame:
    """df with its columns worked out at this point: the optimizer copies an expression into each place that uses it,
    which for rays makes expressions too large to compile, but it copies nothing through a generator."""
    row = "__row"
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias(row)).select(f"{row}.*")


def _dot(a: list, b: list) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def ray(camera: Camera, px: Column, py: Column, dx: Column, dy: Column) -> tuple[list[Column], list[Column]]:
    """Origin and unit direction of a pixel's ray; (dx, dy) is the place in the pixel."""
    r, u, f = ([S.lit(x) for x in v] for v in camera.basis())
    hx, hy = camera.half
    ox = (S.lit(2) * (px + dx) / S.lit(camera.width) - S.lit(1)) * S.lit(hx)
    oy = (S.lit(1) - S.lit(2) * (py + dy) / S.lit(camera.height)) * S.lit(hy)
    p = [S.lit(x) for x in camera.position]
    if camera.kind == "orthographic":
        return [p[i] + r[i] * ox + u[i] * oy for i in range(3)], f
    d = [r[i] * ox + u[i] * oy + f[i] for i in range(3)]
    n = F.sqrt(_dot(d, d))
    return p, [x / n for x in d]


def slab(camera: Camera, origin: list[Column], direction: list[Column]) -> tuple[Column, Column]:
    """Range of t in the camera's slab around look_at, from the eye on; empty if the first is over the second."""
    if not isinstance(camera.slab, Column) and camera.slab <= 0:
        return S.lit(0), S.lit(FAR)
    f = [S.lit(x) for x in camera.basis()[2]]
    a = _dot([S.lit(x) - o for x, o in zip(camera.look_at, origin, strict=True)], f)
    b, half = _dot(direction, f), S.lit(camera.slab / 2)
    flat = F.abs(b) < S.lit(1e-15)
    safe = F.when(flat, S.lit(1)).otherwise(b)
    t = [(a - half) / safe, (a + half) / safe]
    inside = F.abs(a) <= half
    t0 = F.when(flat, F.when(inside, S.lit(-FAR)).otherwise(S.lit(1))).otherwise(F.least(*t))
    t1 = F.when(flat, F.when(inside, S.lit(FAR)).otherwise(S.lit(0))).otherwise(F.greatest(*t))
    t0 = F.greatest(t0, S.lit(0))
    if isinstance(camera.slab, Column):  # a camera of a table: no slab is 0
        none = camera.slab <= 0
        return F.when(none, S.lit(0)).otherwise(t0), F.when(none, S.lit(FAR)).otherwise(t1)
    return t0, t1


def pixels(spark: SparkSession, camera: Camera) -> DataFrame:
    """(py, px) of every pixel."""
    return spark.range(camera.width * camera.height).select(F.floor(F.col("id") / camera.width).cast("int").alias("py"), (F.col("id") % camera.width).cast("int").alias("px"))


def rays(spark: SparkSession, camera: Camera) -> DataFrame:
    """(py, px, ox, oy, oz, dx, dy, dz, t0, t1) through the pixels' centres."""
    o, d = ray(camera, F.col("px"), F.col("py"), S.lit(0.5), S.lit(0.5))
    t0, t1 = slab(camera, o, d)
    return pixels(spark, camera).select("py", "px", *(v.alias(f"o{a}") for a, v in zip(AXES, o, strict=True)), *(v.alias(f"d{a}") for a, v in zip(AXES, d, strict=True)), t0.alias("t0"), t1.alias("t1"))


def _edges(camera: Camera, c: Column, depth: Column, reach: Column) -> tuple[Column, Column, Column]:
    """Ends of a sphere seen along an axis, as places or as angles for a perspective, and whether the eye is inside."""
    if camera.kind == "orthographic":
        return c - reach, c + reach, F.lit(False)
    d = F.sqrt(c * c + depth * depth)
    angle, wide = F.atan2(c, depth), F.asin(F.least(reach / F.greatest(d, S.lit(1e-300)), S.lit(1)))
    return angle - wide, angle + wide, d <= reach


def _bounds(camera: Camera, lo: Column, hi: Column, free: Column, axis: int) -> tuple[Column, Column]:
    """Extent of a sphere on the image plane along an axis, in half extents, from its edges: exact for either camera."""
    half = S.lit(camera.half[axis])
    if camera.kind == "orthographic":
        return lo / half, hi / half
    edge = S.lit(math.pi / 2)
    return (
        F.when(free | (lo <= -edge), S.lit(-2)).otherwise(F.when(lo >= edge, S.lit(2)).otherwise(F.tan(F.least(F.greatest(lo, -edge + S.lit(1e-9)), edge - S.lit(1e-9))) / half)),
        F.when(free | (hi >= edge), S.lit(2)).otherwise(F.when(hi <= -edge, S.lit(-2)).otherwise(F.tan(F.least(F.greatest(hi, -edge + S.lit(1e-9)), edge - S.lit(1e-9))) / half)),
    )


def hits(df: DataFrame, camera: Camera, h: str = "h", samples: int = 1) -> DataFrame:
    """Particles joined with the rays that pass within 2 h of them, by scattering: a particle is copied to the pixels its
    sphere can touch, and each copy is tested against the exact ray. Adds py, px, sx, sy (the sample), t and b2.

    A particle belongs to a ray's slab if its closest approach does. Rows of an image come first, then the pixels of a
    row, so a particle before the whole image is spread row by row."""
    r, u, f = ([S.lit(x) for x in v] for v in camera.basis())
    delta = [F.col(a) - S.lit(p) for a, p in zip(AXES, camera.position, strict=True)]
    reach = 2 * F.col(h)
    df = settle(settle(df.where(F.col(h) > 0)).withColumns({"__cx": _dot(delta, r), "__cy": _dot(delta, u), "__cz": _dot(delta, f)}))
    if camera.kind != "orthographic":
        df = df.where(F.col("__cz") > -reach)
    ends = {f"__{n}{a}": v for a in "xy" for n, v in zip("efg", _edges(camera, F.col(f"__c{a}"), F.col("__cz"), reach), strict=True)}
    df = settle(df.withColumns(ends).drop("__cx", "__cy", "__cz"))
    (lx, hx), (ly, hy) = (_bounds(camera, *(F.col(f"__{n}{a}") for n in "efg"), i) for i, a in enumerate("xy"))
    clip = lambda v, n: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("int")
    w, n = camera.width, camera.height
    df = settle(df.withColumns({"__lx": lx, "__hx": hx, "__ly": ly, "__hy": hy}).drop(*ends))
    lx, hx, ly, hy = (F.col(c) for c in ("__lx", "__hx", "__ly", "__hy"))
    near = (lx <= 1) & (hx >= -1) & (ly <= 1) & (hy >= -1)
    span = lambda lo, hi, size: ((lo + 1) / 2 * size - 1, (hi + 1) / 2 * size + 1)
    x0, x1 = span(lx, hx, w)
    y0, y1 = span(-hy, -ly, n)
    df = df.where(near).withColumns({"__x0": clip(x0, w), "__x1": clip(x1, w), "__y0": clip(y0, n), "__y1": clip(y1, n)})
    df = settle(df.drop("__lx", "__hx", "__ly", "__hy"))
    df = df.withColumn("py", F.explode(F.sequence("__y0", "__y1"))).withColumn("px", F.explode(F.sequence("__x0", "__x1"))).drop("__x0", "__x1", "__y0", "__y1")
    dx = dy = S.lit(0.5)
    if samples > 1:
        both = F.sequence(F.lit(0), F.lit(samples - 1))
        df = df.withColumn("sy", F.explode(both)).withColumn("sx", F.explode(both))
        dx, dy = jitter(samples)
        df = settle(df.withColumns({"__jx": dx, "__jy": dy}))
        dx, dy = F.col("__jx"), F.col("__jy")
    else:
        df = df.withColumns({"sx": F.lit(0), "sy": F.lit(0)})
    o, d = ray(camera, F.col("px"), F.col("py"), dx, dy)
    df = settle(df.withColumns({f"__o{a}": v for a, v in zip(AXES, o, strict=True)} | {f"__d{a}": v for a, v in zip(AXES, d, strict=True)}))
    origin, way = [F.col(f"__o{a}") for a in AXES], [F.col(f"__d{a}") for a in AXES]
    t0, t1 = slab(camera, origin, way)
    df = df.withColumns({"t": _dot([F.col(a) - o for a, o in zip(AXES, origin, strict=True)], way), "__t0": t0, "__t1": t1})
    df = settle(df.drop("__jx", "__jy", *getattr(camera, "columns", ())))  # code of over 8,000 bytes is never compiled: rows are kept narrow
    off = {f"__b{a}": F.col(a) - (o + d * F.col("t")) for a, o, d in zip(AXES, origin, way, strict=True)}
    df = settle(df.where((F.col("t") >= F.col("__t0")) & (F.col("t") <= F.col("__t1"))).withColumns(off).drop("__t0", "__t1", *(f"__{v}{a}" for v in "od" for a in AXES)))
    df = df.withColumn("b2", _dot(*[[F.col(b) for b in off]] * 2)).where(F.col("b2") < reach * reach)
    return df.drop(*(c for c in df.columns if c.startswith("__")))


def jitter(samples: int) -> tuple[Column, Column]:
    """Place of sample (sx, sy) in its pixel: one in each of samples x samples cells, shifted by a hash."""
    part = lambda k, axis: (F.col(k) + S.pixel_hash(F.col("px"), F.col("py"), F.col("sx"), F.col("sy"), F.lit(axis))) / S.lit(samples)
    return part("sx", 0), part("sy", 1)


#: Measures of one pass: a weight for a column, or a value and an extra weight for a mean.
def columns(found: DataFrame, measures: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Per pixel the sum of mass x weight x kernel line integral of each measure, all in one aggregation. by: columns that
    tell images apart, such as a film's cam_id."""
    k = F.col("mass") * S.column_kernel(F.col("b2"), F.col("h"))
    found = found.withColumn("__k", k)
    return found.groupBy(*by, "py", "px").agg(*(F.sum(F.col("__k") * w).alias(n) for n, w in measures.items()))


def means(found: DataFrame, measures: dict[str, tuple[Column, Column]], by: tuple[str, ...] = ()) -> DataFrame:
    """Per pixel the mean of each measure's value, weighted by mass x its extra weight x kernel; 0 without weight."""
    found = found.withColumn("__k", F.col("mass") * S.column_kernel(F.col("b2"), F.col("h")))
    sums = [e for n, (v, w) in measures.items() for e in (F.sum(F.col("__k") * w * v).alias(f"{n}_n"), F.sum(F.col("__k") * w).alias(f"{n}_d"))]
    return found.groupBy(*by, "py", "px").agg(*sums).select(*by, "py", "px", *(F.coalesce(F.try_divide(F.col(f"{n}_n"), F.col(f"{n}_d")), S.lit(0)).alias(n) for n in measures))


#: Emission and absorption factors of each volume measure.
KAPPA = {
    "neutral_H": (5e4, 1e4),
    "ionized_H": (5e4, 1e4),
    "heated_gas": (1.0, 1e2),
    "heavy_elements": (2e6, 2e5),
    "gas_density": (5e4, 1e4),
    "gas_temperature": (1.0, 1e2),
    "gas_metallicity": (5e6, 5e5),
    "gas_cold": (5e4, 1e4),
    "gas_warm": (5e4, 1e4),
    "gas_hot": (5e4, 1e4),
}


def phase(low: float, high: float) -> Column:
    return F.when((F.col("temperature") >= S.lit(low)) & (F.col("temperature") < S.lit(high)), S.lit(1)).otherwise(S.lit(0))


def phases() -> dict[str, Column]:
    return {"cold": phase(0, 1e4), "warm": phase(1e4, 1e5), "hot": phase(1e5, 1e12)}


def volume_weights() -> dict[str, Column]:
    """What emits and absorbs in each volume measure."""
    rho, t, z, x, zero = F.col("density"), F.col("temperature"), F.col("metallicity"), F.col("hii"), S.lit(0)
    return {
        "neutral_H": rho * S.lit(S.HYDROGEN) * F.greatest(zero, 1 - x),
        "ionized_H": rho * S.lit(S.HYDROGEN) * F.greatest(zero, x),
        "heated_gas": rho * F.greatest(zero, t - S.lit(1e4)),
        "heavy_elements": rho * rho * z,
        "gas_density": rho,
        "gas_temperature": rho * t,
        "gas_metallicity": rho * z,
    } | {f"gas_{k}": rho * v for k, v in phases().items()}


def column_weights() -> dict[str, Column]:
    return {"gas_density": S.lit(1), "metal": F.col("metallicity"), "speed": F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2), "hii": S.lit(S.HYDROGEN) * F.greatest(S.lit(0), F.col("hii"))} | phases()


def emission(found: DataFrame, weight: Column, kappa_e: float, kappa_a: float, key: list[str], samples: int = 1, least: float = 1e-3, depth: float = 16.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Per pixel emission and transmittance, front to back over all hits of a ray, ties by `key`: light is dimmed by what
    lies before it and what follows once the ray is opaque (at most `least` passes) is left out. Several samples of a
    pixel are averaged; samples without hits pass all light. by: columns that tell images apart.

    Dimming is a product, so a ray is cut into slabs of length `depth` along t: hits are sorted within a slab only, each
    slab's transmittance is one number, and a running product over the few slabs says how much light reaches each. A
    pixel before a dense halo is so spread over as many tasks as it has slabs; rays shuffle by (ray, slab) once."""
    mk = F.col("mass") * S.emission_kernel(F.col("b2"), F.col("h"))
    ray, part = [*by, "py", "px", "sy", "sx"], [*by, "py", "px", "sy", "sx", "__slab"]
    passed = Window.partitionBy(*part).orderBy("t", *key).rowsBetween(Window.unboundedPreceding, -1)
    found = found.select(*ray, "t", *key, F.floor(F.col("t") / S.lit(depth)).alias("__slab"), (S.lit(kappa_e) * weight * mk).alias("__e"), F.least(S.lit(kappa_a) * weight * mk, S.lit(1)).alias("__a"))
    found = found.withColumn("__within", F.coalesce(F.product(1 - F.col("__a")).over(passed), S.lit(1))).select(*part, "__e", "__a", "__within")
    ahead = Window.partitionBy(*ray).orderBy("__slab").rowsBetween(Window.unboundedPreceding, -1)
    slabs = found.groupBy(*part).agg(F.min(F.col("__within") * (1 - F.col("__a"))).alias("__clear"))
    slabs = slabs.withColumn("__ahead", F.coalesce(F.product("__clear").over(ahead), S.lit(1))).where(F.col("__ahead") > S.lit(least)).drop("__clear")
    lit = found.join(slabs, part).withColumn("__before", F.col("__ahead") * F.col("__within")).where(F.col("__before") > S.lit(least))
    each = lit.groupBy(*ray).agg(F.sum(F.col("__before") * F.col("__e")).alias("e"), F.min(F.col("__before") * (1 - F.col("__a"))).alias("t"))
    n = S.lit(samples * samples)
    return each.groupBy(*by, "py", "px").agg((F.sum("e") / n).alias("emission"), ((F.sum("t") + n - F.count(F.lit(1))) / n).alias("transmittance"))


def segments(found: DataFrame, grid: Grid) -> DataFrame:
    """(py, px, ix, iy, iz, t, ds): each ray of rays() cut at the planes between cells. The planes it crosses come from a
    sequence for each axis, so nothing is stepped."""
    found = settle(found)
    low, high = grid.low, [lo + s for lo, s in zip(grid.low, grid.size, strict=True)]
    enter, leave, inside = F.col("t0"), F.col("t1"), F.lit(True)
    for a, lo, hi in zip(AXES, low, high, strict=True):
        o, d = F.col(f"o{a}"), F.col(f"d{a}")
        flat = F.abs(d) < S.lit(1e-15)
        safe = F.when(flat, S.lit(1)).otherwise(d)
        ta, tb = (S.lit(lo) - o) / safe, (S.lit(hi) - o) / safe
        enter = F.greatest(enter, F.when(flat, S.lit(-FAR)).otherwise(F.least(ta, tb)))
        leave = F.least(leave, F.when(flat, S.lit(FAR)).otherwise(F.greatest(ta, tb)))
        inside = inside & (~flat | ((o >= S.lit(lo)) & (o <= S.lit(hi))))
    df = settle(found.withColumns({"__in": enter, "__out": leave}).where(inside)).where("__in < __out")
    cuts = F.array("__in", "__out")
    for a, lo, s in zip(AXES, low, grid.cell, strict=True):
        o, d = F.col(f"o{a}"), F.col(f"d{a}")
        ends = [(o + d * F.col(t) - S.lit(lo)) / S.lit(s) for t in ("__in", "__out")]
        first, last = F.ceil(F.least(*ends)), F.floor(F.greatest(*ends))
        planes = F.when((F.abs(d) < S.lit(1e-15)) | (first > last), F.array().cast("array<bigint>")).otherwise(F.sequence(first, last))
        safe = F.when(F.abs(d) < S.lit(1e-15), S.lit(1)).otherwise(d)
        cuts = F.concat(cuts, F.transform(planes, _at(o, safe, lo, s)))
    cuts = F.array_sort(F.filter(cuts, lambda t: (t >= F.col("__in")) & (t <= F.col("__out"))))
    df = settle(df.withColumn("__cuts", cuts))
    parts = F.zip_with(F.slice("__cuts", 1, F.size("__cuts") - 1), F.slice("__cuts", 2, F.size("__cuts") - 1), lambda a, b: F.struct(a.alias("t"), (b - a).alias("ds")))
    df = df.withColumn("__s", F.explode(parts)).withColumns({"t": F.col("__s.t"), "ds": F.col("__s.ds")}).where(F.col("ds") > S.lit(1e-12))
    for a, lo, s, n in zip(AXES, low, grid.cell, grid.shape, strict=True):
        middle = F.col(f"o{a}") + F.col(f"d{a}") * (F.col("t") + F.col("ds") / 2)
        df = df.withColumn(f"i{a}", F.least(F.greatest(F.floor((middle - S.lit(lo)) / S.lit(s)), F.lit(0)), F.lit(n - 1)).cast("int"))
    return df.drop(*(c for c in df.columns if c.startswith("__")))


def _at(o: Column, d: Column, low: float, size: float):
    """t at which a ray meets the k-th plane of an axis."""
    return lambda k: (S.lit(low) + k * S.lit(size) - o) / d


def through_grid(parts: DataFrame, cube: DataFrame) -> DataFrame:
    """Segments with the cube's fields; cells that hold nothing are left out."""
    return parts.join(cube, [f"i{a}" for a in AXES])


def dusty(found: DataFrame, light: Column, dust: Column, by: tuple[str, ...] = (), depth: float = 64.0) -> DataFrame:
    """Per pixel the light that arrives through dust, and the optical depth: over a ray's segments (of through_grid), front
    to back, light is light x ds x exp(-tau), where tau is the sum of dust x ds before the segment. Null counts as none.

    A stretch of a ray is a pair, its own light and its own depth, and pairs compose: the light of what lies behind is
    dimmed by the depth of what lies before. So rays are cut into slabs of length `depth` along t; a slab's pair is made
    where its segments meet, in one sort, and only pairs, a few for each ray, are ordered along the ray."""
    ray = [*by, "py", "px"]
    k = F.coalesce(dust, S.lit(0)) * F.col("ds")
    cut = found.select(*ray, "t", F.floor(F.col("t") / S.lit(depth)).alias("__slab"), (F.coalesce(light, S.lit(0)) * F.col("ds")).alias("__j"), k.alias("__k"))
    before = Window.partitionBy(*ray, "__slab").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("__tau", F.coalesce(F.sum("__k").over(before), S.lit(0)))
    pairs = cut.groupBy(*ray, "__slab").agg(F.sum(F.col("__j") * F.exp(-F.col("__tau"))).alias("__light"), F.sum("__k").alias("__deep"))
    ahead = Window.partitionBy(*ray).orderBy("__slab").rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("__ahead", F.coalesce(F.sum("__deep").over(ahead), S.lit(0)))
    return pairs.groupBy(*ray).agg(F.sum(F.col("__light") * F.exp(-F.col("__ahead"))).alias("light"), F.sum("__deep").alias("depth"))


def dense(spark: SparkSession, camera: Camera, image: DataFrame, empty: dict[str, float] | None = None) -> DataFrame:
    """Every pixel; those the image lacks get 0, or what `empty` says."""
    values = [c for c in image.columns if c not in ("py", "px")]
    return pixels(spark, camera).join(image, ["py", "px"], "left").select("py", "px", *(F.coalesce(c, S.lit((empty or {}).get(c, 0))).alias(c) for c in values))
