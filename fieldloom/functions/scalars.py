"""Scalar functions over columns: particle physics, geometry, the smoothing kernel and its line integral."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants and unit factors.
GAMMA, PROTON_MASS, BOLTZMANN, HYDROGEN = 5.0 / 3.0, 1.6726e-24, 1.3807e-16, 0.76
VELOCITY_CGS = 1e10
FIXED_POINT = 2.0**-32
HUBBLE, OMEGA_M, OMEGA_L, GYR_FACTOR = 67.74, 0.3089, 0.6911, 977.79
SOLAR_METALLICITY, MASS_UNIT, LITTLE_H = 0.0127, 1e10, 0.6774


def lit(x: float | Column) -> Column:
    """A number as a double; a column stays as it is."""
    return x if isinstance(x, Column) else F.lit(float(x))


def decode_fixed(coordinate: Column, box: float) -> Column:
    """32-bit fixed-point coordinate to a length."""
    return coordinate.cast("double") * lit(FIXED_POINT) * lit(box)


def smoothing_length(mass: Column, density: Column) -> Column:
    return F.cbrt(lit(3) * (mass / density) / lit(4 * math.pi))


def temperature(internal_energy: Column, ionised: Column) -> Column:
    """Kelvin from internal energy per mass and the ionised fraction."""
    weight = lit(4) / (lit(1 + 3 * HYDROGEN) + lit(4 * HYDROGEN) * ionised)
    return lit(GAMMA - 1) * internal_energy * lit(VELOCITY_CGS) * weight * lit(PROTON_MASS) / lit(BOLTZMANN)


def min_image(delta: Column, box: float) -> Column:
    """A difference wrapped once into half a box either way."""
    return F.when(delta > lit(box / 2), delta - lit(box)).when(delta < lit(-box / 2), delta + lit(box)).otherwise(delta)


def kernel(r: Column, h: Column) -> Column:
    """Cubic spline of support 2 h."""
    q, norm = r / h, lit(1 / math.pi) / (h * h * h)
    inner = norm * (lit(1) - lit(1.5) * q * q + lit(0.75) * q * q * q)
    outer = norm * lit(0.25) * (lit(2) - q) * (lit(2) - q) * (lit(2) - q)
    return F.when(q <= 1, inner).when(q < 2, outer).otherwise(lit(0))


def line_integral(u: np.ndarray, steps: int = 4096) -> np.ndarray:
    """The unit kernel integrated along lines at distance u, by Simpson's rule."""

    def w(q):
        return np.where(q <= 1, 1 - 1.5 * q**2 + 0.75 * q**3, np.where(q < 2, 0.25 * (2 - q) ** 3, 0)) / math.pi

    u = np.asarray(u, float)
    reach = np.sqrt(np.maximum(4 - u * u, 0))
    total = w(u)
    for k in range(1, steps):
        total = total + (2 if k % 2 == 0 else 4) * w(np.sqrt(u * u + (k * reach / steps) ** 2))
    return 2 * reach / steps / 3 * total


@cache
def integral_table(samples: int = 1024, squared: bool = False) -> tuple[float, ...]:
    """line_integral at evenly spaced u in [0, 2], or at evenly spaced u squared in [0, 4]."""
    x = np.linspace(0, 4 if squared else 2, samples)
    return tuple(line_integral(np.sqrt(x) if squared else x).tolist())


def lookup(x: Column, table: tuple[float, ...], top: float) -> Column:
    """Linear interpolation in an evenly spaced table over [0, top]; 0 from its last cell's end on."""
    cells = len(table) - 1
    values = F.from_json(F.lit(str(list(table))), "array<double>")  # one constant, not thousands of expressions

    def between(at: Column) -> Column:
        i = F.floor(at).cast("int")
        return F.when(i >= cells, lit(0)).otherwise(F.get(values, i) * (lit(1) - (at - i)) + F.get(values, i + 1) * (at - i))

    return once(F.least(F.abs(x) * lit(cells / top), lit(cells)), between)


def column_kernel(distance2: Column, h: Column) -> Column:
    """Kernel integrated along a ray at squared distance distance2, by the table over u squared."""
    return lookup(distance2 / (h * h), integral_table(4096, True), 4.0) / (h * h)


def emission_kernel(distance2: Column, h: Column) -> Column:
    """The same by the table over u."""
    return lookup(F.sqrt(distance2) / h, integral_table(), 2.0) / (h * h)


def cosmic_age(a: Column) -> Column:
    """Age in Gyr at scale factor a, flat universe, closed form."""
    return lit(2 / 3 * GYR_FACTOR / HUBBLE / math.sqrt(OMEGA_L)) * F.asinh(lit(math.sqrt(OMEGA_L / OMEGA_M)) * F.pow(a, lit(1.5)))


def stellar_age(a_form: Column, a_now: float) -> Column:
    return F.greatest(cosmic_age(lit(a_now)) - cosmic_age(a_form), lit(1e-5))


def magnitude_luminosity(magnitude: Column, solar: float) -> Column:
    return F.pow(lit(10), (lit(solar) - magnitude) / lit(2.5))


def _mul32(x: Column, c: int) -> Column:
    """x * c modulo 2 ** 32 without leaving a long."""
    low = (x.bitwiseAND(65535)) * F.lit(c)
    high = F.shiftleft((F.shiftright(x, 16) * F.lit(c)).bitwiseAND(65535), 16)
    return (high + low).bitwiseAND(0xFFFFFFFF)


#: Multipliers of the pixel hash, for column, row, sample column, sample row and axis, then of its mixing.
HASH = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
MIX = ((16, 0x7FEB352D), (15, 0x846CA68B))


def pixel_hash(*parts: Column) -> Column:
    """A fraction in [0, 1) with 24 bits from a pixel's column and row, its sample's column and row, and an axis."""
    h = F.lit(0).cast("long")
    for x, m in zip(parts, HASH, strict=True):
        h = h.bitwiseXOR(_mul32(x.cast("long"), m))
    for shift, m in MIX:
        h = once(h, lambda v, shift=shift: v.bitwiseXOR(F.shiftright(v, shift)))
        h = once(h, lambda v, m=m: _mul32(v, m))
    h = once(h, lambda v: v.bitwiseXOR(F.shiftright(v, 16)))
    return h.bitwiseAND(0xFFFFFF).cast("double") / lit(2**24)


def once(x: Column, then) -> Column:
    """then(x) with x worked out once however often it is used."""
    return F.get(F.transform(F.array(x), lambda v: then(v)), F.lit(0))


def snapshot_number(path: Column) -> Column:
    """Number after the first underscore of a path's last part; 0 if there is none."""
    return F.coalesce(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^[^_]*_(\d+)", 1).try_cast("int"), F.lit(0))


def nice_length(x: Column) -> Column:
    """The largest 1, 2 or 5 times a power of ten that is not over x; 1 for x <= 0."""
    base = F.pow(lit(10), F.floor(F.log10(x)))
    return F.when(x <= 0, lit(1)).when(x >= 5 * base, 5 * base).when(x >= 2 * base, 2 * base).otherwise(base)


def cell_index(ix: Column, iy: Column, iz: Column, shape: tuple[int, int, int]) -> Column:
    """Place of a cell in a cube laid out with x running fastest, then y."""
    return (iz.cast("long") * F.lit(shape[1]) + iy) * F.lit(shape[0]) + ix


def scale_bar(width: Column, height: Column, vertical: Column, share: float = 0.25) -> Column:
    """Length of a bar over a share of an image's width, from the image's vertical extent, as a nice length."""
    return nice_length(vertical * width / height * lit(share))
