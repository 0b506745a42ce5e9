"""Queries over perceptual colour ramps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import colours as C
from ..sources import tables as T
from . import queries as Q

_STEPS, _ANCHORS = 33, 5


def anchors(s: SparkSession, d: str) -> DataFrame:
    """A ramp for each five customers: their keys' digits as colours."""
    key = F.col("c_custkey")
    channel = lambda k, n: ((key * k + n) % 256 / S.lit(255)).cast("double")
    return T.read(s, d, "customer").select(F.floor(key / _ANCHORS).cast("long").alias("ramp"), channel(37, 0).alias("r"), channel(91, 5).alias("g"), channel(53, 17).alias("b"))


def _num(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def _row(m: np.ndarray, names: list[str]) -> list[str]:
    return [" + ".join(f"{_num(v)} * {n}" for v, n in zip(row, names, strict=True)) for row in m]


def _ramp_sql() -> str:
    v, n = C.SCREEN, _STEPS - 1
    whole = 100 * v.cones @ np.array(C.SRGB)
    cones = ", ".join(f"{e} AS p{i}" for i, e in enumerate(_row(whole, ["lr", "lg", "lb"])))
    level, k = _num(v.level / 100), _num(v.chroma * v.level**0.25)
    back = ", ".join(f"{e} AS l{c}" for c, e in zip("rgb", _row(np.linalg.inv(whole), ["c0", "c1", "c2"]), strict=True))
    return f"""WITH anchor AS (SELECT c_custkey // {_ANCHORS} AS ramp, c_custkey * 37 % 256 / 255.0::DOUBLE AS r, (c_custkey * 91 + 5) % 256 / 255.0::DOUBLE AS g, (c_custkey * 53 + 17) % 256 / 255.0::DOUBLE AS b FROM customer),
linear AS (SELECT ramp, {', '.join(f'CASE WHEN {c} <= 0.04045 THEN {c} / 12.92::DOUBLE ELSE pow(({c} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS l{c}' for c in 'rgb')} FROM anchor),
cone AS (SELECT ramp, {cones} FROM linear),
seen AS (SELECT ramp, {', '.join(f'sign(p{i}) * 400 * pow({level} * abs(p{i}), 0.42::DOUBLE) / (pow({level} * abs(p{i}), 0.42::DOUBLE) + 27.13::DOUBLE) + 0.1::DOUBLE AS s{i}' for i in range(3))} FROM cone),
opp AS (SELECT ramp, s0 - 12 * s1 / 11 + s2 / 11 AS x, (s0 + s1 - 2 * s2) / 9 AS y, s0 + s1 + 1.05::DOUBLE * s2 AS u, greatest((2 * s0 + s1 + s2 / 20 - 0.305::DOUBLE) * {_num(v.brightness)}, 0) AS l FROM seen),
jh AS (SELECT *, 100 * pow(l / {_num(v.whiteness)}, {_num(v.exponent)}) AS j, atan2(y, x) AS h FROM opp),
jmh AS (SELECT *, pow({_num(v.scale / 4)} * (cos(h + 2) + 3.8::DOUBLE) * sqrt(x * x + y * y) / u, 0.9::DOUBLE) * sqrt(j / 100) * {k} AS m FROM jh),
ucs AS (SELECT ramp, 1.7::DOUBLE * j / (1 + 0.007::DOUBLE * j) AS jj, ln(1 + 0.0228::DOUBLE * m) / 0.0228::DOUBLE * cos(h) AS aa, ln(1 + 0.0228::DOUBLE * m) / 0.0228::DOUBLE * sin(h) AS bb FROM jmh),
pair AS (SELECT *, lead(jj) OVER w AS j2, lead(aa) OVER w AS a2, lead(bb) OVER w AS b2, min(jj) OVER (PARTITION BY ramp) AS lo, max(jj) OVER (PARTITION BY ramp) AS hi FROM ucs WINDOW w AS (PARTITION BY ramp ORDER BY jj, aa, bb)),
level AS (SELECT DISTINCT ramp, step, lo + (hi - lo) * step / {n} AS light FROM pair, range({_STEPS}) t(step)),
hit AS (SELECT l.ramp, l.step, light, jj, aa, bb, j2, a2, b2, row_number() OVER (PARTITION BY l.ramp, l.step ORDER BY jj DESC) AS best FROM level l JOIN pair p ON l.ramp = p.ramp AND (jj <= light + 1e-12 AND j2 IS NOT NULL OR hi = lo AND j2 IS NULL)),
mixed AS (SELECT ramp, step, light, CASE WHEN j2 IS NULL THEN aa ELSE aa + (a2 - aa) * (light - jj) / (j2 - jj) END AS a, CASE WHEN j2 IS NULL THEN bb ELSE bb + (b2 - bb) * (light - jj) / (j2 - jj) END AS b FROM hit WHERE best = 1),
polar AS (SELECT ramp, step, light, light / (1.7::DOUBLE - 0.007::DOUBLE * light) / 100 AS j, atan2(b, a) AS h, (exp(0.0228::DOUBLE * sqrt(a * a + b * b)) - 1) / 0.0228::DOUBLE / {k} AS c FROM mixed),
part_ AS (SELECT *, CASE WHEN j > 0 THEN pow(c / sqrt(j), {_num(1 / 0.9)}) ELSE 0 END AS t, {_num(v.whiteness)} * pow(j, {_num(1 / v.exponent)}) / {_num(v.brightness)} + 0.305::DOUBLE AS p FROM polar),
reach AS (SELECT *, t * p / ({_num(v.scale / 4)} * (cos(h + 2) + 3.8::DOUBLE) + t * (671 * cos(h) + 6588 * sin(h)) / 1403) AS q FROM part_),
resp AS (SELECT ramp, step, light, {', '.join(f'(460 * p + {m} * q * cos(h) + {k2} * q * sin(h)) / 1403 - 0.1::DOUBLE AS s{i}' for i, (m, k2) in enumerate(((451, 288), (-891, -261), (-220, -6300))))} FROM reach),
wide AS (SELECT ramp, step, light, {', '.join(f'sign(s{i}) * {_num(100 / v.level)} * pow(27.13::DOUBLE * abs(s{i}) / (400 - abs(s{i})), {_num(1 / 0.42)}) AS c{i}' for i in range(3))} FROM resp),
lin2 AS (SELECT ramp, step, light, {back} FROM wide),
enc AS (SELECT ramp, step, light, {', '.join(f'CASE WHEN l{c} <= 0.0031308 THEN l{c} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(l{c}, {_num(1 / 2.4)}) - 0.055::DOUBLE END AS {c}' for c in 'rgb')} FROM lin2),
ramps AS (SELECT ramp, step::INTEGER AS step, {', '.join(f'least(greatest({c}, 0), 1) AS {c}' for c in 'rgb')}, 0.2::DOUBLE + 0.8::DOUBLE * pow(step / {n}.0::DOUBLE, 1.5::DOUBLE) AS a, light, {' AND '.join(f'{c} BETWEEN -1e-6 AND 1.000001' for c in 'rgb')} AS inside FROM enc)"""


def ramps(s: SparkSession, d: str) -> DataFrame:
    return C.perceptual_ramps(anchors(s, d), ["ramp"], _STEPS, alpha=(0.2, 1.0, 1.5))


Q.register("perceptual_ramps", lambda s, d: Q.rounded(ramps(s, d)), f"{_ramp_sql()} SELECT ramp, step, {Q.sql_round('r g b a light')}, inside FROM ramps")
Q.register("ramp_gamut", lambda s, d: ramps(s, d).groupBy("ramp").agg(F.count(F.lit(1)).alias("colours"), F.count_if(~F.col("inside")).alias("outside")), f"{_ramp_sql()} SELECT ramp, count(*) AS colours, count(*) FILTER (WHERE NOT inside) AS outside FROM ramps GROUP BY ramp")
