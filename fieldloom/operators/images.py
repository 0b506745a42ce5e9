"""Image algebra over (py, px, value) maps: ranges, tone curves, colour ramps, composites, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# Colour ramps as (place, colour).
RAMPS = {
    "cosmic_layers": [(0.00, "000008"), (0.02, "130733"), (0.05, "241460"), (0.08, "2c2690"), (0.11, "2352b5"), (0.14, "1cb8ae"), (0.18, "3ecc56"), (0.25, "b8dc33"), (0.38, "f0cb1f"), (0.55, "f08a20"), (0.75, "f55850"), (1.00, "ff9480")],
    "aurora": [(0.000, "03000a"), (0.12, "1a1055"), (0.24, "1d3a92"), (0.36, "1e7ea6"), (0.48, "1fb596"), (0.62, "72dc5a"), (0.78, "e5e860"), (0.90, "fbf5d5"), (1.000, "ffffff")],
    "temp_brm": [(0.00, "0820a0"), (0.20, "3050d8"), (0.45, "7030c0"), (0.70, "c03060"), (0.90, "e84020"), (1.00, "b01010")],
    "matter_r_fade": [(0.00, "2d0f3a"), (0.12, "5a1552"), (0.28, "932a5f"), (0.45, "c94761"), (0.62, "e67b56"), (0.78, "f0b07a"), (0.90, "f8dcb0"), (1.00, "fef4df")],
    "blue_orange": [(0.00, "02041e"), (0.18, "0a1a6a"), (0.36, "2a56c8"), (0.50, "e8eaec"), (0.66, "f4c07a"), (0.85, "ec8a30"), (1.00, "c25410")],
    "ocean_glow": [(0.00, "02061c"), (0.15, "07224d"), (0.32, "0d4e7a"), (0.50, "1a8aa6"), (0.68, "3cc9c4"), (0.85, "b6f1e6"), (1.00, "f4fffb")],
    "ice": [(0.00, "02030f"), (0.18, "0b1e4a"), (0.38, "1f4f8f"), (0.58, "4d8ec8"), (0.78, "a9d6ef"), (0.92, "e2f3fb"), (1.00, "ffffff")],
    "metal_gold": [(0.00, "0a1d2a"), (0.18, "1f3a4a"), (0.38, "7a3a1e"), (0.58, "c57a1f"), (0.78, "e8c25a"), (1.00, "fff2c8")],
    "metal_cu": [(0.00, "05070a"), (0.22, "3c1410"), (0.45, "8f2d14"), (0.65, "d0691e"), (0.82, "f0b065"), (1.00, "fff6e0")],
    "metal_diverge_custom": [(0.00, "000000"), (0.12, "050b1c"), (0.28, "0a1630"), (0.40, "1f5560"), (0.48, "f2ead2"), (0.50, "fff4cf"), (0.72, "d19040"), (1.00, "5a1808")],
    "metal_dark_diverge": [(0.00, "000000"), (0.12, "0a1028"), (0.28, "18365c"), (0.42, "2e6b72"), (0.50, "c8c0ac"), (0.62, "e6a23a"), (0.80, "c14c12"), (1.00, "5a1808")],
    "ill_density": [(0.00, "c4d88f"), (0.30, "6ea85a"), (0.60, "2a5da8"), (0.85, "7ab7ff"), (1.00, "ffffff")],
    "ill_density_dark": [(0.00, "000010"), (0.25, "0a1a4a"), (0.55, "1e5fb0"), (0.80, "7ac0ff"), (1.00, "ffffff")],
    "ill_metals": [(0.00, "e6d9a2"), (0.40, "b6c77a"), (0.65, "5e8a4c"), (0.85, "6b3a1a"), (1.00, "2b1205")],
    "ill_metals_dark": [(0.00, "050208"), (0.25, "2a1030"), (0.50, "8a2a20"), (0.75, "e08a2a"), (0.90, "ffd66a"), (1.00, "ffffff")],
    "ill_velocity": [(0.00, "1a0500"), (0.25, "5a1a04"), (0.50, "c14a1a"), (0.80, "ffb04a"), (1.00, "ffffd8")],
    "neutral_H": [(0, "000020"), (1 / 3, "1a3a8a"), (2 / 3, "5f7fd0"), (1, "c0e0ff")],
    "ionized_H": [(0, "0a0000"), (1 / 3, "802010"), (2 / 3, "d05020"), (1, "ffd090")],
    "heated_gas": [(0, "050005"), (1 / 3, "2a1040"), (2 / 3, "c05020"), (1, "fff0b0")],
    "heavy_elements": [(0, "000a08"), (1 / 3, "106050"), (2 / 3, "70d0b0"), (1, "e0ffe8")],
}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, S.lit(low)), S.lit(high))


def quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles (p0, p1, ...) with linear interpolation, null values left out; a row without `by` even if
    there are no values.

    A histogram over bins of a 64th of an octave says in which bins the ranks lie; only the values of those are looked
    at again, counted by value. Both counts are made before the shuffle, and no group's values come into one place."""
    by = by or []
    v = F.col("__v")
    wide = F.floor(F.least(F.greatest(F.log2(F.abs(v)) * 64, S.lit(-1e5)), S.lit(1e5))).cast("long") + F.lit(1 << 20)
    place = F.when(F.isnan(v), F.lit(1 << 21).cast("long")).when(v > 0, wide).when(v < 0, -wide).otherwise(F.lit(0).cast("long"))
    binned = rows.select(*by, F.col(value).cast("double").alias("__v")).where(v.isNotNull()).withColumn("__bin", place)
    binned = binned.select(F.struct(*by, "__bin").alias("__k"), "__v")  # parts of a struct may be null and still meet
    whole = Window.partitionBy(*(f"__k.{b}" for b in by)) if by else Window.partitionBy(F.lit(0))
    hist = binned.groupBy("__k").agg(F.count(F.lit(1)).alias("n"))
    hist = hist.withColumns({"__to": F.sum("n").over(whole.orderBy("__k.__bin")), "__all": F.sum("n").over(whole)})
    asks = []
    for i, s in enumerate(shares):
        at = S.lit(s) * (F.col("__all") - 1)
        lower, higher = F.floor(at), F.ceil(at)
        asks.append(F.struct(F.lit(i).alias("i"), lower.alias("rank"), F.when(lower == higher, S.lit(1)).otherwise(higher - at).alias("w")))
        asks.append(F.struct(F.lit(i).alias("i"), higher.alias("rank"), (at - lower).alias("w")))
    asked = hist.select("__k", (F.col("__to") - F.col("n")).alias("__from"), "__to", F.explode(F.array(*asks)).alias("__a"))
    asked = asked.where("__a.rank >= __from and __a.rank < __to and __a.w > 0").select("__k", "__a.i", "__a.w", (F.col("__a.rank") - F.col("__from")).alias("__rank"))
    found = binned.join(asked.select("__k").distinct(), "__k", "left_semi").groupBy("__k", "__v").agg(F.count(F.lit(1)).alias("n"))
    found = found.withColumn("__to", F.sum("n").over(Window.partitionBy("__k").orderBy("__v")))
    got = found.join(asked, "__k").where("__rank < __to and __rank >= __to - n")
    return got.groupBy(*(F.col(f"__k.{b}").alias(b) for b in by)).agg(*(F.sum(F.when(F.col("i") == i, F.col("w") * v)).alias(f"p{i}") for i in range(len(shares))))


def percentiles(image: DataFrame, value: str, shares: list[float], by: list[str] | None = None, absolute: bool = False) -> DataFrame:
    """Exact percentiles (p0, p1, ...) with linear interpolation of positive values, or of absolute ones."""
    if absolute:
        return quantiles(image.withColumn(value, F.abs(value)), value, shares, by)
    return quantiles(image.where(F.col(value) > 0), value, shares, by)


def pooled(image: DataFrame, value: str, frames: list[int], share: float) -> DataFrame:
    """A percentile of the positive values of some frames together."""
    return percentiles(image.where(F.col("frame").isin(frames)), value, [share])


def percentile_of_percentiles(image: DataFrame, value: str, inner: float, outer: float, stride: int = 1) -> DataFrame:
    each = percentiles(image.where(F.col("frame") % stride == 0), value, [inner], ["frame"])
    return quantiles(each, "p0", [outer])


def stats(image: DataFrame, value: str) -> DataFrame:
    """Over all pixels: least, most, mean, number and share of pixels that are not zero."""
    v = F.col(value)
    return image.agg(F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.count_if(v != 0).alias("nonzero"), F.avg((v != 0).cast("double")).alias("share"))


def log_unit(image: DataFrame, value: str, out: str, low: float, high: float, floor: float = 1e-4, of: DataFrame | None = None) -> DataFrame:
    """Adds out: log of value over the range between two percentiles of the positive ones, as 0 to 1; 0 for the others.
    of: the image whose range counts, if not this one; for several channels it keeps their plans apart."""
    ends = percentiles(image if of is None else of, value, [low, high]).select(F.greatest("p0", F.col("p1") * S.lit(floor)).alias("__lo"), F.col("p1").alias("__hi"))
    df = image.crossJoin(F.broadcast(ends))  # one row
    x = F.log10(F.greatest(F.least(F.col(value), F.col("__hi")), F.col("__lo")))
    t = F.try_divide(x - F.log10("__lo"), F.log10("__hi") - F.log10("__lo"))
    return df.withColumn(out, F.when(F.col(value) > 0, clamp(F.coalesce(t, S.lit(0)))).otherwise(S.lit(0))).drop("__lo", "__hi")


def ramp(x: Column, stops: list[tuple[float, str]], steps: int) -> list[Column]:
    """Red, green, blue (0 to 1) of a ramp with that many colours: x falls on one of them, as on a table."""
    place = F.least(F.floor(clamp(x) * steps), F.lit(steps - 1)).cast("double") / S.lit(steps - 1)
    out = []
    for c in range(3):
        v = [int(h[2 * c : 2 * c + 2], 16) / 255 for _, h in stops]
        value = S.lit(v[-1])
        for (a, b), (p, q) in reversed(list(zip(zip([s for s, _ in stops], [s for s, _ in stops[1:]], strict=False), zip(v, v[1:], strict=False), strict=True))):
            value = F.when(place <= S.lit(b), S.lit(p) + S.lit(q - p) * (place - S.lit(a)) / S.lit(b - a)).otherwise(value)
        out.append(value)
    return out


# Which ramp a field has by default; the first row whose pattern is in its lower-case name counts, ^ stands for the name's start.
DEFAULT_RAMPS = [
    ("temperature", "cmo.thermal"),
    ("metal", "viridis"),
    ("vlos", "RdBu_r"),
    ("los_velocity", "RdBu_r"),
    ("velocity", "cividis"),
    ("^gas_v", "cividis"),
    ("vmag", "cividis"),
    ("", "inferno"),
]


def default_ramp(field: Column) -> Column:
    """The ramp of DEFAULT_RAMPS for a field's name."""
    return F.coalesce(*(F.when(F.lower(field).rlike(pattern), F.lit(name)) for pattern, name in DEFAULT_RAMPS))


def lupton(r: Column, g: Column, b: Column, q: float = 8.0) -> list[Column]:
    """Asinh stretch that keeps hues, for channels scaled to about 1."""
    i = (r + g + b) / 3 + S.lit(1e-30)
    f = F.asinh(S.lit(q) * i) / (S.lit(q) * i)
    return [clamp(c * f) for c in (r, g, b)]


def to_byte(x: Column) -> Column:
    return F.floor(x * 255).cast("int")


def add_colours(parts: list[tuple[Column, float, tuple[float, float, float]]]) -> list[Column]:
    """Sum of tones x gain x colour, clipped."""
    return [clamp(reduce(lambda a, b: a + b, [t * S.lit(g) * S.lit(c[i]) for t, g, c in parts])) for i in range(3)]


def hue_bright(rgb: list[Column], bright: Column, white: float = 0.0, power: float = 4.0) -> list[Column]:
    w = S.lit(white) * F.pow(bright, S.lit(power))
    return [clamp(c * bright + w * (1 - c * bright)) for c in rgb]


def over_background(rgb: list[Column], opacity: Column, ground: tuple[float, float, float]) -> list[Column]:
    return [clamp(c * opacity + S.lit(g) * (1 - opacity)) for c, g in zip(rgb, ground, strict=True)]


def fade_alpha(x: Column, data: Column, floor: float, gamma: float) -> Column:
    return F.when(data <= 0, S.lit(0)).otherwise(S.lit(floor) + S.lit(1 - floor) * F.pow(x, S.lit(gamma)))


def stretch(natural: DataFrame, boosted: DataFrame, channels: list[str], share: float, weight: float) -> DataFrame:
    """One row (natural, boosted, stretch): percentiles of all channels together, and their blend natural * (boosted / natural) ** weight."""

    def end(image: DataFrame, name: str) -> DataFrame:
        v = image.select(F.explode(F.array(*channels)).alias("v"))
        return quantiles(v, "v", [share]).select((F.col("p0") + S.lit(1e-30)).alias(name))

    both = end(natural, "natural").crossJoin(F.broadcast(end(boosted, "boosted")))  # one row each
    w = min(max(weight, 0.0), 1.0)
    return both.withColumn("stretch", F.col("natural") * F.pow(F.col("boosted") / F.col("natural"), S.lit(w)))


def opacity(image: DataFrame, transmittance: str, out: str, gamma: float = 1.0, norm: bool = True) -> DataFrame:
    """Adds out: 1 - transmittance, as a share of its 99th percentile (if that is positive), to a power."""
    v = clamp(1 - F.col(transmittance))
    if not norm:
        return image.withColumn(out, F.pow(v, S.lit(gamma)))
    top = quantiles(image.select(v.alias("v")), "v", [0.99]).withColumnRenamed("p0", "__p99")
    df = image.crossJoin(F.broadcast(top))  # one row
    return df.withColumn(out, F.pow(F.when(F.col("__p99") > 0, clamp(v / F.col("__p99"))).otherwise(v), S.lit(gamma))).drop("__p99")


def shade(image: DataFrame, emission: str, transmittance: str, colour: tuple[float, float, float], low: float = 0.5, high: float = 0.995, gain: float = 1.0, gamma: float = 1.0, norm: bool = True) -> DataFrame:
    """Adds r, g, b, opacity: a volume's light as log tone x gain x opacity x colour."""
    df = opacity(log_unit(image, emission, "__t", low, high), transmittance, "opacity", gamma, norm)
    return df.withColumns({n: F.col("__t") * S.lit(gain) * F.col("opacity") * S.lit(c) for n, c in zip("rgb", colour, strict=True)}).drop("__t")


def two_slopes(x: Column, low: float, pivot: float, high: float) -> Column:
    """0 to 1 with the pivot at a half; a pivot outside the range is put in its middle."""
    mid = pivot if low < pivot < high else 0.5 * (low + high)
    return clamp(F.when(x < S.lit(mid), S.lit(0.5) * (x - S.lit(low)) / S.lit(mid - low)).otherwise(S.lit(0.5) + S.lit(0.5) * (x - S.lit(mid)) / S.lit(high - mid)))


def symmetric(image: DataFrame, value: str, out: str, share: float = 0.99) -> DataFrame:
    """Adds out: a signed value as 0 to 1 between minus and plus a percentile of absolute values; zero is a half."""
    df = image.crossJoin(F.broadcast(percentiles(image, value, [share], absolute=True)))  # one row
    return df.withColumn(out, clamp(S.lit(0.5) + S.lit(0.5) * F.coalesce(F.try_divide(F.col(value), F.col("p0")), S.lit(0)))).drop("p0")


def stack_layers(layers: DataFrame) -> DataFrame:
    """(py, px, r, g, b) on black from layers (py, px, layer, r, g, b, a); the layer of the lowest number is in front.

    A layer's light is its colour times its opacity, times what all layers before it let through: one running product
    and three sums, nothing is divided."""
    before = Window.partitionBy("py", "px").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    through = F.coalesce(F.product(1 - F.col("a")).over(before), S.lit(1))
    shown = layers.withColumn("__share", F.col("a") * through)
    return shown.groupBy("py", "px").agg(*(F.sum(F.col(c) * F.col("__share")).alias(c) for c in "rgb"))


def layer_alpha(unit: Column, transmittance: Column, gain: float = 1.0) -> Column:
    """Opacity of a volume's layer: its normalised emission, held low where it is faint, and some of what it blocks."""
    return clamp(S.lit(gain) * F.pow(unit, S.lit(1.8)) + S.lit(0.3) * (1 - transmittance))


def blend(images: DataFrame, schedule: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(frame, py, px, channels): frames that fade from one series of images (scene, frame, py, px, channels) into the next.
    schedule: frame, before, after, alpha, as of crossfade. A frame asks for one or two scenes with a weight each, so the
    images are met once, by (frame, scene); what an image lacks is black."""
    two = F.array(F.struct(F.col("before").alias("scene"), (1 - F.col("alpha")).alias("w")), F.struct(F.col("after").alias("scene"), F.when(F.col("before") == F.col("after"), S.lit(0)).otherwise(F.col("alpha")).alias("w")))
    own = F.when(F.col("before") == F.col("after"), S.lit(1)).otherwise(F.col("__x.w"))
    asked = schedule.select("frame", "before", "after", F.posexplode(two).alias("__i", "__x")).where("__i = 0 or before <> after")
    asked = asked.select("frame", F.col("__x.scene").alias("scene"), own.alias("__w")).where("__w > 0")
    return images.join(asked, ["frame", "scene"]).groupBy("frame", "py", "px").agg(*(F.sum(F.col(c) * F.col("__w")).alias(c) for c in channels))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Statistics of two maps (py, px, v), over the pixels where both are positive: ratio and relative difference."""
    both = a.select("py", "px", F.col("v").alias("p")).join(b.select("py", "px", F.col("v").alias("q")), ["py", "px"])
    ok = (F.col("p") > 0) & (F.col("q") > 0)
    ratio, diff = F.when(ok, F.col("p") / F.col("q")), F.when(ok, (F.col("p") - F.col("q")) / F.greatest(F.abs("q"), S.lit(1e-30)))
    out = [(F.sum("p") / F.greatest(F.sum("q"), S.lit(1e-30))).alias("sum_ratio")]
    for name, v in (("ratio", ratio), ("diff", diff)):
        out += [F.avg(v).alias(f"{name}_mean"), F.stddev_pop(v).alias(f"{name}_std"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max")]
    # Medians of both at once, as groups, and by histograms: no task holds a map's values.
    pair = F.explode(F.array(*(F.struct(F.lit(n).alias("__of"), v.alias("__x")) for n, v in (("ratio", ratio), ("diff", diff)))))
    medians = quantiles(both.select(pair.alias("__s")).select("__s.*"), "__x", [0.5], ["__of"])
    medians = medians.agg(*(F.max(F.when(F.col("__of") == n, F.col("p0"))).alias(f"{n}_median") for n in ("ratio", "diff")))
    return both.agg(*out).crossJoin(F.broadcast(medians))  # one row each
