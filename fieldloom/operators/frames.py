"""Camera paths and series over the frames of a film."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def frames(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("frame"))


def _given(spark: SparkSession, n: int, at: DataFrame | None) -> DataFrame:
    return frames(spark, n) if at is None else at.select("frame")


def geometric(n: int, first: float, last: float, reach: int | None = None) -> Column:
    """first * (last / first) ** (frame / reach); reach is the last frame unless given, and the way goes on past it."""
    return S.lit(first) * F.pow(S.lit(last / first), F.col("frame") / S.lit(max(1, reach if reach is not None else n - 1)))


def orbit(spark: SparkSession, n: int, center: tuple[float, ...], radius: float, at: DataFrame | None = None) -> DataFrame:
    """One turn in the xy plane. at: the frames (column frame) to give, as those of a table; all n if there are none."""
    angle = S.lit(2 * math.pi) * F.col("frame") / S.lit(n)
    return _given(spark, n, at).select("frame", (S.lit(center[0]) + S.lit(radius) * F.cos(angle)).alias("x"), (S.lit(center[1]) + S.lit(radius) * F.sin(angle)).alias("y"), S.lit(center[2]).alias("z"))


def spiral(spark: SparkSession, n: int, center: tuple[float, ...], outer: float, inner: float, turns: float, start: float = 0.0, plane: str = "xy", reach: int | None = None, at: DataFrame | None = None) -> DataFrame:
    """Radius from outer to inner in equal ratios, angle in equal steps; past `reach` both go on."""
    last = max(1, reach if reach is not None else n - 1)
    r, angle = geometric(n, outer, inner, last), S.lit(start) + S.lit(2 * math.pi * turns) * F.col("frame") / S.lit(last)
    way = dict(zip(plane, (F.cos(angle), F.sin(angle)), strict=True))
    return _given(spark, n, at).select("frame", r.alias("r"), *((S.lit(c) + (way[a] * r if a in way else S.lit(0))).alias(a) for a, c in zip("xyz", center, strict=True)))


def fly_in(spark: SparkSession, n: int, center: tuple[float, ...], outer: float, inner: float, axis: str, reach: int | None = None, at: DataFrame | None = None) -> DataFrame:
    """Towards the centre along an axis, in equal ratios; the way goes on past `reach`, which is held within the film."""
    last = min(max(reach if reach is not None else n - 1, 1), max(1, n - 1))
    r = geometric(n, outer, inner, last)
    return _given(spark, n, at).select("frame", r.alias("r"), *((S.lit(c) + (r if a == axis.lower() else S.lit(0))).alias(a) for a, c in zip("xyz", center, strict=True)))


def clip_radii(n: int, constant: float = 0.0, start: float | None = None, end: float | None = None, reach: int | None = None) -> Column:
    """Radius of each frame's clip: from start to end in equal ratios, else constant, else none (null)."""
    if start is not None and end is not None:
        return geometric(n, start, end, min(max(reach if reach is not None else n - 1, 1), max(1, n - 1)))
    return S.lit(constant) if constant > 0 else F.lit(None).cast("double")


def first_covered(views: DataFrame, width: str, side: float, aspect: float) -> DataFrame:
    """The first frame whose view fits a side (0 if none does): frames before it are trimmed."""
    return views.where(F.col(width) * S.lit(aspect) <= S.lit(side)).agg(F.coalesce(F.min("frame"), F.lit(0)).alias("frame"))


def depth(mode: str, fixed: float, width: Column) -> Column:
    return width if mode == "same-as-y" else S.lit(fixed)


def pick_tier(views: DataFrame, tiers: DataFrame, width: str, tolerance: float = 0.0, aspect: float = 1.0) -> DataFrame:
    """Each view with the smallest tier that covers it whichever way it is longer, so of a side of max(width, width x
    aspect); the widest one if none does. tiers: tier, side (a few rows)."""
    covers = F.col("side") * S.lit(1 + tolerance) >= F.greatest(F.col(width), F.col(width) * S.lit(aspect))
    widest = tiers.agg(F.max_by("tier", "side").alias("__widest"))
    best = views.join(F.broadcast(tiers), covers).groupBy(*views.columns).agg(F.min_by("tier", "side").alias("tier"))
    return views.join(best, views.columns, "left").crossJoin(F.broadcast(widest)).select(*views.columns, F.coalesce("tier", "__widest").alias("tier"))


def runs(series: DataFrame, value: str) -> DataFrame:
    """(run, value, first, last): stretches of frames with equal values."""
    w = Window.orderBy("frame")
    starts = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return series.withColumn("__new", starts).withColumn("run", F.sum("__new").over(w)).groupBy("run", value).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


def fill(series: DataFrame, value: str) -> DataFrame:
    """Nulls and NaNs between known frames on the line between them, outside as the nearest known one."""
    v = F.when(F.isnan(value), None).otherwise(F.col(value))
    known, at = v, F.when(v.isNotNull(), F.col("frame"))
    back = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.orderBy("frame").rowsBetween(0, Window.unboundedFollowing)
    df = series.withColumns({"__v0": F.last(known, True).over(back), "__f0": F.last(at, True).over(back), "__v1": F.first(known, True).over(on), "__f1": F.first(at, True).over(on)})
    between = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.try_divide((F.col("frame") - F.col("__f0")).cast("double"), (F.col("__f1") - F.col("__f0")).cast("double"))
    return df.withColumn(value, F.coalesce(v, between, "__v0", "__v1")).drop("__v0", "__f0", "__v1", "__f1")


def convolve(series: DataFrame, value: str, weights: list[tuple[int, float]], n: int, edge: str) -> DataFrame:
    """(frame, value): weighted sums over frames at the given offsets; beyond the ends, frames repeat the last one (edge)
    or are mirrored at it (reflect; needs more frames than the largest offset)."""
    kernel = F.array(*(F.struct(F.lit(o).alias("o"), S.lit(w).alias("w")) for o, w in weights))
    # Each frame adds to the frames that look at it: itself at -offset, and those near an end through their mirror images.
    df = series.sparkSession.range(n).select(F.col("id").cast("int").alias("frame")).withColumn("__k", F.explode(kernel))
    i = F.col("frame") + F.col("__k.o")
    last = n - 1
    at = F.greatest(F.lit(0), F.least(F.lit(last), i)) if edge == "edge" else F.when(i < 0, -i).when(i > last, 2 * last - i).otherwise(i)
    df = df.select("frame", at.alias("__at"), F.col("__k.w").alias("__w"))
    other = series.select(F.col("frame").alias("__at"), F.col(value).alias("__v"))
    return df.join(other, "__at").groupBy("frame").agg(F.sum(F.col("__w") * F.col("__v")).alias(value))


def rolling_mean(series: DataFrame, value: str, n: int) -> DataFrame:
    """Mean over a twentieth of the frames, 5 at least, an odd number."""
    width = max(5, n // 20)
    width += width % 2 == 0
    return convolve(series, value, [(o, 1 / width) for o in range(-(width // 2), width // 2 + 1)], n, "edge")


def gaussian(series: DataFrame, value: str, n: int, sigma: float) -> DataFrame:
    radius = max(1, math.ceil(4 * sigma))
    if n <= radius:
        raise ValueError(f"smoothing over {radius} frames either way needs more than {n} frames")
    raw = [(o, math.exp(-0.5 * (o / sigma) ** 2)) for o in range(-radius, radius + 1)]
    total = sum(w for _, w in raw)
    return convolve(series, value, [(o, w / total) for o, w in raw], n, "reflect")


def crossfade(n: int, scenes: int, fade: int) -> tuple[Column, Column, Column]:
    """(before, after, alpha) of each frame: scenes of equal length, faded over `fade` frames around their borders."""
    size = n // scenes
    f = F.col("frame")
    border = F.floor((f + fade // 2) / S.lit(size)).cast("int")
    start = border * size - fade // 2
    inside = (border >= 1) & (border < scenes) & (f >= start) & (f < border * size + fade // 2)
    scene = F.least(F.floor(f / S.lit(size)).cast("int"), F.lit(scenes - 1))
    alpha = (f - start + S.lit(0.5)) / S.lit(fade)
    return F.when(inside, border - 1).otherwise(scene), F.when(inside, border).otherwise(scene), F.when(inside, F.least(F.greatest(alpha, S.lit(0)), S.lit(1))).otherwise(S.lit(0))


def missing(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """Frames without a map."""
    return wanted.join(there.select("frame").distinct(), "frame", "left_anti")


def spline(keys: DataFrame, n: int, steps: int = 64) -> DataFrame:
    """(frame, x, y, z): n frames at even distances along the Catmull-Rom curve through key frames (key, x, y, z), in order
    of key; before the first and after the last one the curve takes these twice. Equal neighbours add no way; with fewer
    than two different places all frames stand at the first. No keys give no frames.

    Neighbouring rows make a segment, a segment `steps` chords, and running sums of their lengths say which frames lie on
    which chord: no frame looks for its place. Windows run over the chords of one film, which are few."""
    order = Window.orderBy("key")
    ends = {}
    for a in "xyz":
        after = F.coalesce(F.lead(a, 1).over(order), F.col(a))
        ends |= {f"{a}0": F.coalesce(F.lag(a, 1).over(order), F.col(a)), f"{a}1": F.col(a), f"{a}2": after, f"{a}3": F.coalesce(F.lead(a, 2).over(order), after)}
    parts = keys.where(F.col("key").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).select("key", "x", "y", "z")
    parts = parts.select("key", *(v.alias(k) for k, v in ends.items()), F.lead("key").over(order).isNotNull().alias("more"))
    parts = parts.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) == 1)

    def at(a: str, u: Column) -> Column:
        p = [F.col(f"{a}{i}") for i in range(4)]
        return S.lit(0.5) * (2 * p[1] + (p[2] - p[0]) * u + (2 * p[0] - 5 * p[1] + 4 * p[2] - p[3]) * u * u + (3 * p[1] - p[0] - 3 * p[2] + p[3]) * u * u * u)

    chord = parts.where("more or alone").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    u0, u1 = F.col("i") / S.lit(steps), (F.col("i") + 1) / S.lit(steps)
    chord = chord.select("key", "i", *(at(a, u0).alias(f"{a}0") for a in "xyz"), *(at(a, u1).alias(f"{a}1") for a in "xyz"))
    long = F.sqrt(sum((F.pow(F.col(f"{a}1") - F.col(f"{a}0"), 2) for a in "yz"), F.pow(F.col("x1") - F.col("x0"), 2)))
    run = Window.orderBy("key", "i")
    chord = chord.withColumn("d", long).withColumns({"to": F.sum("d").over(run), "all": F.sum("d").over(Window.partitionBy(F.lit(0))), "first": F.row_number().over(run) == 1})
    chord = chord.withColumn("from", F.lag("to", 1, 0.0).over(run))
    # Frame f lies at all x f / (n - 1); each chord has those after its start, up to its end.
    last = S.lit(max(1, n - 1))
    low = F.when(F.col("first"), F.lit(0)).otherwise(F.floor(F.try_divide(F.col("from"), F.col("all")) * last) + 1)
    high = F.when(F.col("all") <= 0, F.when(F.col("first"), F.lit(n - 1)).otherwise(F.lit(-1))).when(F.col("to") >= F.col("all"), F.lit(n - 1)).otherwise(F.floor(F.try_divide(F.col("to"), F.col("all")) * last))
    found = chord.withColumns({"__low": low.cast("int"), "__high": F.least(high, F.lit(n - 1)).cast("int")}).where("__low <= __high")
    found = found.withColumn("frame", F.explode(F.sequence("__low", "__high")))
    share = F.coalesce(F.try_divide(F.col("all") * F.col("frame") / last - F.col("from"), F.col("d")), S.lit(0))
    share = F.least(F.greatest(share, S.lit(0)), S.lit(1))
    return found.groupBy("frame").agg(*(F.min_by(F.col(f"{a}0") + share * (F.col(f"{a}1") - F.col(f"{a}0")), F.struct("key", "i")).alias(a) for a in "xyz"))
