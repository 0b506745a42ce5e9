"""Colours as they are seen: CIECAM02 with the uniform space CAM02-UCS, and colour ramps of even lightness.

Everything is column arithmetic in steps, each a projection of its own, so no expression is copied into the next ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# The published matrices of sRGB (to XYZ), of the CAT02 adaptation and of the Hunt-Pointer-Estevez cones.
SRGB = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
CAT02 = ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6975, 0.0061), (0.0030, 0.0136, 0.9834))
HPE = ((0.38971, 0.68898, -0.07868), (-0.22981, 1.18340, 0.04641), (0.0, 0.0, 1.0))
# Lightness and colourfulness factors of CAM02-UCS, exponent and offset of the cones' response.
LIGHT, COLOURFUL, RESPONSE, HALF = 0.007, 0.0228, 0.42, 27.13
#: Channels so far outside of 0 to 1 still count as inside.
NOISE = 1e-6


@dataclass(frozen=True)
class Viewing:
    """White, adapting light (cd/m2), background's luminance, and the surround's impact, induction and adaptation.
    The default is that of sRGB screens: D65, 64 lux, an average surround."""

    white: tuple[float, float, float] = (95.047, 100.0, 108.883)
    light: float = 64 / math.pi / 5
    background: float = 20.0
    impact: float = 0.69
    induction: float = 1.0
    adaptation: float = 1.0

    @cached_property
    def level(self) -> float:
        k = 1 / (5 * self.light + 1)
        return 0.2 * k**4 * 5 * self.light + 0.1 * (1 - k**4) ** 2 * (5 * self.light) ** (1 / 3)

    @cached_property
    def share(self) -> float:
        return self.background / self.white[1]

    @cached_property
    def brightness(self) -> float:
        return 0.725 * (1 / self.share) ** 0.2

    @cached_property
    def exponent(self) -> float:
        return self.impact * (1.48 + math.sqrt(self.share))

    @cached_property
    def chroma(self) -> float:
        return (1.64 - 0.29**self.share) ** 0.73

    @cached_property
    def scale(self) -> float:
        return 50000 / 13 * self.induction * self.brightness

    @cached_property
    def cones(self) -> np.ndarray:
        """Matrix from XYZ (0 to 100) to adapted cone responses."""
        cat = np.array(CAT02)
        d = min(max(self.adaptation * (1 - math.exp((-self.light - 42) / 92) / 3.6), 0.0), 1.0)
        gain = d * self.white[1] / (cat @ np.array(self.white)) + 1 - d
        return np.array(HPE) @ np.linalg.inv(cat) @ np.diag(gain) @ cat

    @cached_property
    def whiteness(self) -> float:
        x = (self.level / 100 * (self.cones @ np.array(self.white))) ** RESPONSE
        r, g, b = 400 * x / (x + HALF) + 0.1
        return float((2 * r + g + b / 20 - 0.305) * self.brightness)


SCREEN = Viewing()


def _times(matrix: np.ndarray, v: list[Column]) -> list[Column]:
    return [reduce(lambda a, b: a + b, [S.lit(m) * x for m, x in zip(row, v, strict=True)]) for row in matrix]


def _columns(df: DataFrame, name: str, values: list[Column]) -> tuple[DataFrame, list[Column]]:
    return df.withColumns({f"__{name}{i}": v for i, v in enumerate(values)}), [F.col(f"__{name}{i}") for i in range(len(values))]


def _bare(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith("__")))


def _correlates(df: DataFrame, light: list[Column], matrix: np.ndarray, view: Viewing) -> tuple[DataFrame, list[Column]]:
    """Lightness, colourfulness and hue (radians)."""
    df, cone = _columns(df, "cone", _times(matrix, light))
    df, power = _columns(df, "power", [F.pow(S.lit(view.level / 100) * F.abs(c), S.lit(RESPONSE)) for c in cone])
    df, (r, g, b) = _columns(df, "seen", [F.signum(c) * 400 * p / (p + S.lit(HALF)) + S.lit(0.1) for c, p in zip(cone, power, strict=True)])
    df, (x, y, whole, bright) = _columns(df, "opponent", [r - 12 * g / 11 + b / 11, (r + g - 2 * b) / 9, r + g + S.lit(1.05) * b, F.greatest((2 * r + g + b / 20 - S.lit(0.305)) * S.lit(view.brightness), S.lit(0))])
    df, (j, h) = _columns(df, "light", [100 * F.pow(bright / S.lit(view.whiteness), S.lit(view.exponent)), F.atan2(y, x)])
    t = S.lit(view.scale / 4) * (F.cos(h + 2) + S.lit(3.8)) * F.sqrt(x * x + y * y) / whole
    df, (m,) = _columns(df, "strong", [F.pow(t, S.lit(0.9)) * F.sqrt(j / 100) * S.lit(view.chroma * view.level**0.25)])
    return df, [j, m, h]


def appearance(df: DataFrame, xyz: tuple[str, str, str] = ("x", "y", "z"), view: Viewing = SCREEN) -> DataFrame:
    """Adds lightness, colourfulness and hue (degrees) of CIECAM02 to colours in XYZ, white about 100."""
    own = df.columns
    df, (j, m, h) = _correlates(df, [F.col(c) for c in xyz], view.cones, view)
    return df.select(*own, j.alias("lightness"), m.alias("colourfulness"), F.pmod(F.degrees(h), S.lit(360)).alias("hue"))


def to_ucs(df: DataFrame, rgb: tuple[str, str, str] = ("r", "g", "b"), view: Viewing = SCREEN) -> DataFrame:
    """Adds light, red_green, blue_yellow: sRGB colours (0 to 1) in CAM02-UCS. Null channels give nulls."""
    own = df.columns
    linear = [F.when(c <= S.lit(0.04045), c / S.lit(12.92)).otherwise(F.pow((c + S.lit(0.055)) / S.lit(1.055), S.lit(2.4))) for c in map(F.col, rgb)]
    df, linear = _columns(df, "linear", linear)
    df, (j, m, h) = _correlates(df, linear, 100 * view.cones @ np.array(SRGB), view)
    df, (strong,) = _columns(df, "ucs", [F.log1p(S.lit(COLOURFUL) * m) / S.lit(COLOURFUL)])
    return df.select(*own, (S.lit(1 + 100 * LIGHT) * j / (1 + S.lit(LIGHT) * j)).alias("light"), (strong * F.cos(h)).alias("red_green"), (strong * F.sin(h)).alias("blue_yellow"))


def from_ucs(df: DataFrame, jab: tuple[str, str, str] = ("light", "red_green", "blue_yellow"), view: Viewing = SCREEN) -> DataFrame:
    """Adds r, g, b: colours of CAM02-UCS in sRGB, which may lie outside of 0 to 1. The hue's direction is put into the
    sum that makes the lightness, so one formula serves all hues."""
    own = df.columns
    light, a, b = map(F.col, jab)
    df, (j, strong, h) = _columns(df, "polar", [light / (S.lit(1 + 100 * LIGHT) - S.lit(LIGHT) * light) / 100, F.sqrt(a * a + b * b), F.atan2(b, a)])
    c = F.expm1(S.lit(COLOURFUL) * strong) / S.lit(COLOURFUL * view.level**0.25 * view.chroma)
    df, (t, bright, cos, sin, e) = _columns(df, "parts", [F.pow(F.coalesce(F.try_divide(c, F.sqrt(j)), S.lit(0)), S.lit(1 / 0.9)), S.lit(view.whiteness / view.brightness) * F.pow(j, S.lit(1 / view.exponent)) + S.lit(0.305), F.cos(h), F.sin(h), (F.cos(h + 2) + S.lit(3.8)) / 4])
    df, (reach,) = _columns(df, "reach", [t * bright / (S.lit(view.scale) * e + t * (671 * cos + 6588 * sin) / 1403)])
    x, y = reach * cos, reach * sin
    df, seen = _columns(df, "seen", [(460 * bright + k * x + n * y) / 1403 - S.lit(0.1) for k, n in ((451, 288), (-891, -261), (-220, -6300))])
    df, cone = _columns(df, "cone", [F.signum(q) * S.lit(100 / view.level) * F.pow(S.lit(HALF) * F.abs(q) / (400 - F.abs(q)), S.lit(1 / RESPONSE)) for q in seen])
    df, linear = _columns(df, "linear", _times(np.linalg.inv(100 * view.cones @ np.array(SRGB)), cone))
    encoded = [F.when(v <= S.lit(0.0031308), v * S.lit(12.92)).otherwise(S.lit(1.055) * F.pow(v, S.lit(1 / 2.4)) - S.lit(0.055)) for v in linear]
    return df.select(*own, *(v.alias(n) for n, v in zip("rgb", encoded, strict=True)))


def perceptual_ramps(anchors: DataFrame, by: list[str], steps: int = 256, even: bool = True, alpha: tuple[float, float, float] = (1.0, 1.0, 1.0), view: Viewing = SCREEN) -> DataFrame:
    """(by, step, r, g, b, a, light, inside): a ramp of `steps` colours through each group's anchors (by, r, g, b in sRGB).

    Anchors are sorted by lightness, which then rises evenly over the steps, from the darkest to the lightest (even), or
    evenly from anchor to anchor; the other two coordinates follow it from anchor to anchor. Colours outside of sRGB are
    clipped and marked by inside. alpha: opacity at both ends and the power of its way between.

    A stretch between two anchors makes its own steps: the one shuffle is by group, and nothing is joined. Anchors
    with a null channel do not count; where all are alike in lightness, each step is the last anchor (by light, then by
    the other two). Groups may be null; other columns are left out; no anchors give no rows."""
    if steps < 2:
        raise ValueError("a ramp has two steps at least")
    jab = ["light", "red_green", "blue_yellow"]
    # The group travels as one column, so that its columns may have any name.
    rows = to_ucs(anchors.select(F.struct(*by).alias("group"), "r", "g", "b").where("r is not null and g is not null and b is not null"), view=view).select("group", *jab)
    of = Window.partitionBy("group")
    order = of.orderBy(*jab)
    ends = {f"next_{c}": F.lead(c).over(order) for c in jab} | {"least": F.min("light").over(of), "most": F.max("light").over(of), "k": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(of)}
    rows = rows.withColumns(ends).withColumn("span", F.col("most") - F.col("least"))
    last, flat = F.col("next_light").isNull(), F.col("span") <= 0
    place = lambda c, k: (F.try_divide(c - F.col("least"), F.col("span")) if even else F.try_divide(k.cast("double"), F.col("n") - 1)) * (steps - 1)
    rows = rows.withColumns({"from": place(F.col("light"), F.col("k")), "to": place(F.col("next_light"), F.col("k") + 1)})
    begin = F.when(last, F.lit(0)).otherwise(F.ceil("from")).cast("int")
    # The group's last stretch holds its last step; a step on an anchor belongs to the stretch that begins there.
    end = F.when(last, F.lit(steps - 1)).when(F.col("k") == F.col("n") - 2, F.lit(steps - 1)).otherwise(F.ceil("to") - 1).cast("int")
    rows = rows.where(last == flat).withColumns({"begin": begin, "end": end}).where("begin <= end")
    rows = rows.withColumn("step", F.explode(F.sequence("begin", "end")))
    share = F.when(last, S.lit(0)).otherwise(F.coalesce(F.try_divide(F.col("step") - F.col("from"), F.col("to") - F.col("from")), S.lit(1)))
    rows = rows.withColumn("share", share).select("group", "step", *(F.when(last, F.col(c)).otherwise(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * F.col("share")).alias(c) for c in jab))
    inside = reduce(lambda a, b: a & b, [F.col(c).between(S.lit(-NOISE), S.lit(1 + NOISE)) for c in "rgb"])
    low, high, gamma = alpha
    a = S.lit(low) + S.lit(high - low) * F.pow(F.col("step") / S.lit(steps - 1), S.lit(gamma))
    clipped = [F.least(F.greatest(F.col(c), S.lit(0)), S.lit(1)).alias(c) for c in "rgb"]
    return from_ucs(rows, view=view).select(*(F.col(f"group.{c}").alias(c) for c in by), "step", *clipped, a.alias("a"), "light", inside.alias("inside"))
