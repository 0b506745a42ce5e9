"""Queries over the test tables, one for each operator or small group of them, and DuckDB SQL with the same rows."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import frames as FR
from ..operators import images as IM
from ..operators import particles as P
from ..operators import projection as PR
from ..operators import stellar as ST
from ..sources import cubes as CU
from ..sources import tables as T
from .config import Camera, Grid, Region

BOX = T.BOX
GRID = Grid((250.0, 500.0, 500.0), (200.0, 200.0, 200.0), (16, 16, 16))
SECOND = Grid((900.0, 100.0, 950.0), (240.0, 120.0, 240.0), (12, 6, 12))
BALL = Region((250.0, 500.0, 500.0), (0.0, 0.0, 0.0), radius=100.0)
BRICK = Region((20.0, 980.0, 500.0), (120.0, 160.0, 200.0), margin=3.0)
ORTHO = Camera((250.0, 500.0, 350.0), (250.0, 500.0, 500.0), (0.0, 1.0, 0.0), width=24, height=16, ortho_width=120.0)
SLAB = Camera((250.0, 500.0, 350.0), (255.0, 495.0, 500.0), (0.0, 1.0, 0.0), kind="perspective", width=20, height=20, fov=50.0, slab=120.0)
A_NOW = 0.2
LATTICE = {"log_age": [-5.0, -2.0, -1.0, -0.5, 0.0, 0.5], "log_z": [-2.0, -1.0, -0.3, 0.2, 0.6], "L_g": [[10 * math.exp(-i) + j for j in range(5)] for i in range(6)], "L_r": [[8 * math.exp(-i / 2) + j * j for j in range(5)] for i in range(6)]}
FRAMES = 30
_FIELDS = ("Gas_Temperature_mw", "metal_column", "gas_vlos_mw", "gas_velocity", "gas_vx_mw", "star_density", "vmag")
TIERS = [("wide", 800.0), ("middle", 200.0), ("near", 50.0)]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, minus zero as zero."""
    return df.select(*((F.round(c, digits) + S.lit(0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def sql_round(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0 AS {c}" for c in columns.split())


def duck(expression: str) -> str:
    return re.sub(r"(\d+\.\d+)D\b", r"\1::DOUBLE", expression)


GAS_SQL = f"""gas0 AS (SELECT {', '.join(T.GAS_KEY)}, {', '.join(f'{duck(e)} AS {n}' for n, e in T.GAS.items())} FROM lineitem),
gas AS (SELECT *, cbrt(3 * (mass / density) / (4 * pi())) AS h,
  ({S.GAMMA!r}::DOUBLE - 1) * internal_energy * 1e10::DOUBLE * (4::DOUBLE / ({1 + 3 * S.HYDROGEN!r}::DOUBLE + {4 * S.HYDROGEN!r}::DOUBLE * hii)) * {S.PROTON_MASS!r}::DOUBLE / {S.BOLTZMANN!r}::DOUBLE AS temperature FROM gas0)"""
DM_SQL = f"dm AS (SELECT {', '.join(f'{duck(e)} AS {n}' for n, e in T.DM.items())} FROM orders)"
STARS_SQL = f"stars AS (SELECT {', '.join(f'{duck(e)} AS {n}' for n, e in T.STARS.items())} FROM part)"


def _wrap(a: str, c: float) -> str:
    d = f"({a} - {c!r}::DOUBLE)"
    return f"(CASE WHEN {d} > 500 THEN {d} - 1000 WHEN {d} < -500 THEN {d} + 1000 ELSE {d} END)"


def _near(region_center, source: str) -> str:
    moved = ", ".join(f"{c!r}::DOUBLE + {_wrap(a, c)} AS {a}" for a, c in zip("xyz", region_center, strict=True))
    return f"SELECT * REPLACE ({moved}) FROM {source}"


def _cull_sql(region: Region, source: str, reach: str) -> str:
    d = [_wrap(a, c) for a, c in zip("xyz", region.center, strict=True)]
    reach = f"({region.margin!r}::DOUBLE + {reach})"
    if region.radius > 0:
        keep = f"{' + '.join(f'{x} * {x}' for x in d)} <= ({region.radius!r}::DOUBLE + {reach}) * ({region.radius!r}::DOUBLE + {reach})"
    else:
        keep = " AND ".join(f"abs({x}) <= {s / 2!r}::DOUBLE + {reach}" for x, s in zip(d, region.size, strict=True))
    return _near(region.center, f"(SELECT * FROM {source} WHERE {keep})")


W_SQL = "(1 / (pi() * hh * hh * hh)) * (CASE WHEN r / hh <= 1 THEN 1 - 1.5::DOUBLE * (r / hh) * (r / hh) + 0.75::DOUBLE * (r / hh) * (r / hh) * (r / hh) WHEN r / hh < 2 THEN 0.25::DOUBLE * (2 - r / hh) * (2 - r / hh) * (2 - r / hh) ELSE 0 END)"


def _deposit_sql(grid: Grid, source: str, sums: dict[str, str]) -> str:
    """Cells met with every particle by ranges, without the operator's index arithmetic: brute force along each axis."""
    cell, low = grid.cell, grid.low
    axes = ", ".join(f"c{a} AS (SELECT i::INTEGER AS i{a}, {lo!r}::DOUBLE + (i + 0.5::DOUBLE) * {s!r}::DOUBLE AS m{a} FROM range({n}) t(i))" for a, lo, s, n in zip("xyz", low, cell, grid.shape, strict=True))
    return f"""near AS ({_near(grid.center, source)}), big AS (SELECT *, greatest(h, {min(cell) / 2!r}::DOUBLE) AS hh FROM near WHERE h > 0), {axes},
hit AS (SELECT *, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS r FROM big JOIN cx ON abs(x - mx) < 2 * hh JOIN cy ON abs(y - my) < 2 * hh JOIN cz ON abs(z - mz) < 2 * hh),
cube AS (SELECT ix, iy, iz, {', '.join(f'sum(({v}) * {W_SQL}) AS {k}' for k, v in sums.items())} FROM hit WHERE r < 2 * hh GROUP BY ix, iy, iz)"""


GAS_SUMS = {"gas_density": "mass", "mass_weight": "mass", "temperature": "mass * temperature", "metallicity": "mass * metallicity", "hii_density": "mass * hii", "vx": "mass * vx", "vy": "mass * vy", "vz": "mass * vz"}


def _camera_sql(c: Camera, samples: str = "0.5::DOUBLE AS jx, 0.5::DOUBLE AS jy, 0 AS sx, 0 AS sy") -> str:
    """`rays`: every pixel's ray with its slab."""
    r, u, f = c.basis()
    hx, hy = c.half
    v = lambda x: f"({x!r}::DOUBLE)"
    if c.kind == "orthographic":
        o = [f"{v(c.position[i])} + {v(r[i])} * ax + {v(u[i])} * ay" for i in range(3)]
        d, n = [v(x) for x in f], "1"
    else:
        o = [v(x) for x in c.position]
        d = [f"({v(r[i])} * ax + {v(u[i])} * ay + {v(f[i])})" for i in range(3)]
        n = f"sqrt({' + '.join(f'{x} * {x}' for x in d)})"
    made = ", ".join([f"{x} AS o{a}" for a, x in zip("xyz", o, strict=True)] + [f"{x} / {n} AS d{a}" for a, x in zip("xyz", d, strict=True)])
    if c.slab > 0:
        a = " + ".join(f"({v(x)} - o{k}) * {v(y)}" for k, x, y in zip("xyz", c.look_at, f, strict=True))
        b = " + ".join(f"d{k} * {v(y)}" for k, y in zip("xyz", f, strict=True))
        t = f"greatest(least((a - {c.slab / 2}) / b, (a + {c.slab / 2}) / b), 0) AS t0, greatest((a - {c.slab / 2}) / b, (a + {c.slab / 2}) / b) AS t1"
        tail = f"rays AS (SELECT * EXCLUDE (a, b), {t} FROM (SELECT *, {a} AS a, {b} AS b FROM rays0))"
    else:
        tail = "rays AS (SELECT *, 0::DOUBLE AS t0, 1e308::DOUBLE AS t1 FROM rays0)"
    return f"""pix AS (SELECT (i // {c.width})::INTEGER AS py, (i % {c.width})::INTEGER AS px FROM range({c.width * c.height}) t(i)), sam AS (SELECT *, {samples} FROM pix),
aim AS (SELECT *, (2 * (px + jx) / {c.width} - 1) * {v(hx)} AS ax, (1 - 2 * (py + jy) / {c.height}) * {v(hy)} AS ay FROM sam), rays0 AS (SELECT py, px, sx, sy, {made} FROM aim), {tail}"""


HITS_SQL = """h1 AS (SELECT *, (x - ox) * dx + (y - oy) * dy + (z - oz) * dz AS t FROM seen, rays),
h2 AS (SELECT *, (x - (ox + dx * t)) ** 2 + (y - (oy + dy * t)) ** 2 + (z - (oz + dz * t)) ** 2 AS b2 FROM h1 WHERE t >= t0 AND t <= t1), hits AS (SELECT * FROM h2 WHERE b2 < 4 * h * h)"""


def _table_sql(squared: bool) -> str:
    return f"lut AS (SELECT [{', '.join(map(repr, S.integral_table(4096, True) if squared else S.integral_table()))}]::DOUBLE[] AS v)"


def _lookup_sql(x: str, n: int, top: float) -> str:
    """Interpolation in lut.v at x, as a column k2 of a subquery."""
    at = f"({x}) * {(n - 1) / top!r}::DOUBLE"
    return f"CASE WHEN {x} >= {top} OR floor({at}) >= {n - 1} THEN 0 ELSE lut.v[floor({at})::INTEGER + 1] * (1 - ({at} - floor({at}))) + lut.v[floor({at})::INTEGER + 2] * ({at} - floor({at})) END"


COLUMN_SQL = f"k AS (SELECT hits.*, mass * ({_lookup_sql('b2 / (h * h)', 4096, 4.0)}) / (h * h) AS k FROM hits, lut)"
EMIT_SQL = f"k AS (SELECT hits.*, mass * ({_lookup_sql('sqrt(b2) / h', 1024, 2.0)}) / (h * h) AS k FROM hits, lut)"
SUMS = {"gas_density": "1", "metal": "metallicity", "speed": "sqrt(vx * vx + vy * vy + vz * vz)", "hii": "0.76::DOUBLE * greatest(0, hii)", "cold": "(temperature >= 0 AND temperature < 1e4)::INTEGER", "warm": "(temperature >= 1e4 AND temperature < 1e5)::INTEGER", "hot": "(temperature >= 1e5 AND temperature < 1e12)::INTEGER"}


def _fused(camera: Camera):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = PR.hits(P.cull(T.gas(spark, d), BALL, BOX, 2 * F.col("h")), camera)
        return rounded(PR.columns(found, PR.column_weights()))

    sql = f"WITH {GAS_SQL}, seen AS ({_cull_sql(BALL, 'gas', '2 * h')}), {_camera_sql(camera)}, {HITS_SQL}, {_table_sql(True)}, {COLUMN_SQL}, o AS (SELECT py, px, {', '.join(f'sum(k * {e}) AS {n}' for n, e in SUMS.items())} FROM k GROUP BY py, px) SELECT py, px, {sql_round(' '.join(SUMS))} FROM o"
    return query, sql


def _mean_query(camera: Camera):
    fwd, values, weights = camera.basis()[2], ("temperature", "metallicity"), {"mw": "1", "dw": "density", "vw": "1 / density"}

    def query(spark: SparkSession, d: str) -> DataFrame:
        los = F.col("vx") * S.lit(fwd[0]) + F.col("vy") * S.lit(fwd[1]) + F.col("vz") * S.lit(fwd[2])
        extra = {"mw": S.lit(1), "dw": F.col("density"), "vw": F.when(F.col("density") > 0, 1 / F.col("density")).otherwise(S.lit(0))}
        measures = {f"{n}_{w}": (F.col(n), x) for n in values for w, x in extra.items()} | {"vlos": (los, S.lit(1))} | {v: (F.col(v), S.lit(1)) for v in ("vx", "vy", "vz")}
        found = PR.hits(P.cull(T.gas(spark, d), BALL, BOX, 2 * F.col("h")), camera)
        return rounded(PR.means(found, measures), 5)

    sqls = {f"{n}_{w}": (n, x) for n in values for w, x in weights.items()} | {"vlos": (f"(vx * ({fwd[0]!r}::DOUBLE) + vy * ({fwd[1]!r}::DOUBLE) + vz * ({fwd[2]!r}::DOUBLE))", "1")} | {v: (v, "1") for v in ("vx", "vy", "vz")}
    body = ", ".join(f"coalesce(sum(k * {w} * {v}) / nullif(sum(k * {w}), 0), 0) AS {n}" for n, (v, w) in sqls.items())
    return query, f"WITH {GAS_SQL}, seen AS ({_cull_sql(BALL, 'gas', '2 * h')}), {_camera_sql(camera)}, {HITS_SQL}, {_table_sql(True)}, {COLUMN_SQL}, o AS (SELECT py, px, {body} FROM k GROUP BY py, px) SELECT py, px, {sql_round(' '.join(sqls), 5)} FROM o"


VOLUME = {"neutral_H": "density * 0.76::DOUBLE * greatest(0, 1 - hii)", "ionized_H": "density * 0.76::DOUBLE * greatest(0, hii)", "heated_gas": "density * greatest(0, temperature - 1e4)", "heavy_elements": "density * density * metallicity", "gas_density": "density", "gas_temperature": "density * temperature", "gas_metallicity": "density * metallicity", "gas_cold": f"density * {SUMS['cold']}", "gas_warm": f"density * {SUMS['warm']}", "gas_hot": f"density * {SUMS['hot']}"}


def _mul(a: str, m: int) -> str:
    return f"((({a}) * {m}::UBIGINT) & 4294967295::UBIGINT)"


def _jitter_sql(n: int) -> str:
    def part(axis: int) -> str:
        terms = [_mul(f"{v}::UBIGINT", m) for v, m in zip(("px", "py", "sx", "sy", str(axis)), S.HASH, strict=True)]
        h = terms[0]
        for t in terms[1:]:
            h = f"xor({h}, {t})"
        for s, m in S.MIX:
            h = _mul(f"xor({h}, ({h}) >> {s})", m)
        return f"((xor({h}, ({h}) >> 16) & 16777215::UBIGINT)::DOUBLE / 16777216.0::DOUBLE)"

    return part(0), part(1)


def _emission(name: str, samples: int = 1):
    scale = {"heated_gas": 1e-8, "gas_temperature": 1e-8}.get(name, 1e-4)
    e, a = PR.KAPPA[name]

    def query(spark: SparkSession, d: str) -> DataFrame:
        found = PR.hits(P.cull(T.gas(spark, d), BALL, BOX, 2 * F.col("h")), SLAB, samples=samples)
        return rounded(PR.emission(found, PR.volume_weights()[name] * S.lit(scale), e, a, T.GAS_KEY, samples))

    if samples == 1:
        camera = _camera_sql(SLAB)
    else:
        jx, jy = _jitter_sql(samples)
        camera = _camera_sql(SLAB).replace("sam AS (SELECT *, 0.5::DOUBLE AS jx, 0.5::DOUBLE AS jy, 0 AS sx, 0 AS sy FROM pix)", f"sam AS (SELECT py, px, (sx + {jx}) / {samples} AS jx, (sy + {jy}) / {samples} AS jy, sx, sy FROM pix, range({samples}) u(sx), range({samples}) v(sy))")
    sql = f"""WITH {GAS_SQL}, seen AS ({_cull_sql(BALL, 'gas', '2 * h')}), {camera}, {HITS_SQL}, {_table_sql(False)}, {EMIT_SQL},
w AS (SELECT *, {e}::DOUBLE * (({VOLUME[name]}) * {scale!r}::DOUBLE) * k AS em, least({a}::DOUBLE * (({VOLUME[name]}) * {scale!r}::DOUBLE) * k, 1) AS al FROM k),
b AS (SELECT *, coalesce(product(1 - al) OVER (PARTITION BY py, px, sy, sx ORDER BY t, {', '.join(T.GAS_KEY)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM w),
s AS (SELECT py, px, sy, sx, sum(before * em) AS e, min(before * (1 - al)) AS t FROM b WHERE before > 1e-3 GROUP BY ALL)
SELECT py, px, round(sum(e) / {samples**2}, 6) + 0 AS emission, round((sum(t) + {samples**2} - count(*)) / {samples**2}, 6) + 0 AS transmittance FROM s GROUP BY py, px"""
    return query, sql


def _image(spark: SparkSession, d: str) -> DataFrame:
    """A test image for each day: pixels from events."""
    return T.read(spark, d, "events").select(F.datediff("ts", F.lit("2024-01-01")).alias("frame"), F.col("value").cast("double").alias("v"))


IMAGE_SQL = "img AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS frame, value::DOUBLE AS v FROM events)"
MAP_SQL = "m AS (SELECT ((l_orderkey * 31 + l_linenumber) % 24)::INTEGER AS px, ((l_partkey * 17) % 16)::INTEGER AS py, sum(l_quantity)::DOUBLE AS a, sum(l_extendedprice)::DOUBLE AS b, sum(l_discount * 100)::DOUBLE AS c FROM lineitem GROUP BY 1, 2)"


def _map(spark: SparkSession, d: str) -> DataFrame:
    """A test map with three channels."""
    li = T.read(spark, d, "lineitem")
    return li.groupBy(((F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 24).cast("int").alias("px"), ((F.col("l_partkey") * 17) % 16).cast("int").alias("py")).agg(F.sum("l_quantity").cast("double").alias("a"), F.sum("l_extendedprice").cast("double").alias("b"), F.sum(F.col("l_discount") * 100).cast("double").alias("c"))


def _unit_sql(v: str, lo: float, hi: float, name: str) -> tuple[str, str]:
    """CTE with the range of a channel, and the channel's tone."""
    cte = f"r{name} AS (SELECT greatest(quantile_cont({v}, {lo}), quantile_cont({v}, {hi}) * 1e-4) AS lo, quantile_cont({v}, {hi}) AS hi FROM m WHERE {v} > 0)"
    return cte, f"(CASE WHEN {v} > 0 THEN least(greatest((log10(greatest(least({v}, r{name}.hi), r{name}.lo)) - log10(r{name}.lo)) / (log10(r{name}.hi) - log10(r{name}.lo)), 0), 1) ELSE 0 END)"


def _ramp_sql(x: str, stops, steps: int, c: int) -> str:
    place = f"(least(floor(least(greatest({x}, 0), 1) * {steps}), {steps - 1}) / {steps - 1}.0::DOUBLE)"
    v = [int(h[2 * c : 2 * c + 2], 16) / 255 for _, h in stops]
    whens = " ".join(f"WHEN {place} <= {b!r}::DOUBLE THEN {p!r}::DOUBLE + ({q - p!r}::DOUBLE) * ({place} - {a!r}::DOUBLE) / {b - a!r}::DOUBLE" for (a, _), (b, _), p, q in zip(stops, stops[1:], v, v[1:], strict=False))
    return f"CASE {whens} ELSE {v[-1]!r}::DOUBLE END"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


register("deposit_gas_density", lambda s, d: rounded(P.deposit(T.gas(s, d), GRID, BOX, {"gas_density": F.col("mass")}), 9), f"WITH {GAS_SQL}, {_deposit_sql(GRID, 'gas', {'gas_density': 'mass'})} SELECT ix, iy, iz, {sql_round('gas_density', 9)} FROM cube")
register("deposit_all_fields", lambda s, d: rounded(P.deposit(T.gas(s, d), GRID, BOX, P.gas_fields())), f"WITH {GAS_SQL}, {_deposit_sql(GRID, 'gas', GAS_SUMS)} SELECT ix, iy, iz, {sql_round(' '.join(GAS_SUMS))} FROM cube")
_MEANS = ("temperature", "metallicity", "vx", "vy", "vz")
register("normalize_intensive", lambda s, d: rounded(P.intensive(P.deposit(T.gas(s, d), SECOND, BOX, P.gas_fields())), 5), f"WITH {GAS_SQL}, {_deposit_sql(SECOND, 'gas', GAS_SUMS)}, o AS (SELECT * REPLACE ({', '.join(f'CASE WHEN mass_weight > 0 THEN {f} / mass_weight ELSE {f} END AS {f}' for f in _MEANS)}) FROM cube) SELECT ix, iy, iz, {sql_round(' '.join(GAS_SUMS), 5)} FROM o")
register("deposit_dm", lambda s, d: rounded(P.deposit(T.dm(s, d), GRID, BOX, {"dm_density": F.col("mass")}), 9), f"WITH {DM_SQL}, {_deposit_sql(GRID, 'dm', {'dm_density': 'mass'})} SELECT ix, iy, iz, {sql_round('dm_density', 9)} FROM cube")
register("cube_stats", lambda s, d: rounded(IM.stats(P.deposit(T.gas(s, d), GRID, BOX, {"gas_density": F.col("mass")}), "gas_density"), 8), f"WITH {GAS_SQL}, {_deposit_sql(GRID, 'gas', {'gas_density': 'mass'})} SELECT {sql_round('least most mean share', 8).replace('round(least', 'round(\"least\"')}, nonzero FROM (SELECT min(gas_density) AS \"least\", max(gas_density) AS most, avg(gas_density) AS mean, count(*) FILTER (gas_density <> 0) AS nonzero, avg((gas_density <> 0)::INTEGER::DOUBLE) AS share FROM cube)")
register("gas_particles", lambda s, d: rounded(T.gas(s, d)), f"WITH {GAS_SQL} SELECT {', '.join(T.GAS_KEY)}, {sql_round(' '.join(T.GAS) + ' h temperature')} FROM gas")
register("decode_fixed_point", lambda s, d: rounded(T.read(s, d, "orders").select("o_orderkey", S.decode_fixed((F.col("o_orderkey") * 2654435761) % 4294967296, BOX).alias("x"))), "SELECT o_orderkey, round(((o_orderkey * 2654435761) % 4294967296)::DOUBLE * 2.3283064365386963e-10::DOUBLE * 1000, 6) + 0 AS x FROM orders")
for _name, _region, _source, _reach in (("region_box_cull", BRICK, "gas", "2 * h"), ("region_sphere_cull", BALL, "gas", "2 * h"), ("dm_center_cull", BRICK, "dm", None)):
    _keys = T.GAS_KEY if _source == "gas" else ["pid"]
    register(
        _name,
        lambda s, d, r=_region, t=_source, k=_keys, h=_reach: rounded(P.cull(T.gas(s, d) if t == "gas" else T.dm(s, d), r, BOX, 2 * F.col("h") if h else None).select(*k, "x", "y", "z")),
        f"WITH {GAS_SQL if _source == 'gas' else DM_SQL} SELECT {', '.join(_keys)}, {sql_round('x y z')} FROM ({_cull_sql(_region, _source, _reach or '0::DOUBLE')})",
    )
register("kernel_values", lambda s, d: rounded(T.read(s, d, "part").select((F.col("p_partkey") % 300).cast("long").alias("id"), "p_partkey").select("p_partkey", "id", S.kernel(F.col("id") / S.lit(100), S.lit(1.2)).alias("w"))), f"SELECT p_partkey, id, {sql_round('w')} FROM (SELECT p_partkey, id, {W_SQL} AS w FROM (SELECT p_partkey, (p_partkey % 300)::BIGINT AS id, (p_partkey % 300) / 100.0::DOUBLE AS r, 1.2::DOUBLE AS hh FROM part))")
register("kernel_line_integral", lambda s, d: rounded(T.read(s, d, "part").select("p_partkey", (F.col("p_partkey") % 230).cast("long").alias("id")).select("p_partkey", "id", S.lookup(F.col("id") / S.lit(100), S.integral_table(), 2.0).alias("f"))), f"WITH {_table_sql(False)} SELECT p_partkey, id, {sql_round('f')} FROM (SELECT p_partkey, i AS id, {_lookup_sql('i / 100.0::DOUBLE', 1024, 2.0)} AS f FROM (SELECT p_partkey, (p_partkey % 230)::BIGINT AS i FROM part), lut)")
for _name, _camera in (("camera_rays_ortho", ORTHO), ("camera_rays_perspective", SLAB)):
    register(_name, lambda s, d, c=_camera: rounded(PR.rays(s, c).withColumn("t1", F.least("t1", S.lit(1e6))), 8), f"WITH {_camera_sql(_camera)} SELECT py, px, {sql_round('ox oy oz dx dy dz t0 t1', 8).replace('round(t1', 'round(least(t1, 1e6)')} FROM rays")


def _axis_sql(grid: Grid) -> str:
    """Segments by brute force: every plane of every axis is tried."""
    low, high = grid.low, [lo + s for lo, s in zip(grid.low, grid.size, strict=True)]
    enter = ", ".join(f"CASE WHEN abs(d{a}) < 1e-15 THEN -1e308 ELSE least(({lo!r}::DOUBLE - o{a}) / d{a}, ({hi!r}::DOUBLE - o{a}) / d{a}) END" for a, lo, hi in zip("xyz", low, high, strict=True))
    leave = ", ".join(f"CASE WHEN abs(d{a}) < 1e-15 THEN 1e308 ELSE greatest(({lo!r}::DOUBLE - o{a}) / d{a}, ({hi!r}::DOUBLE - o{a}) / d{a}) END" for a, lo, hi in zip("xyz", low, high, strict=True))
    inside = " AND ".join(f"(abs(d{a}) >= 1e-15 OR (o{a} >= {lo!r} AND o{a} <= {hi!r}))" for a, lo, hi in zip("xyz", low, high, strict=True))
    cuts = " UNION ALL ".join(f"SELECT py, px, ({lo!r}::DOUBLE + i * {s!r}::DOUBLE - o{a}) / d{a} AS t FROM box, range({n + 1}) t(i) WHERE abs(d{a}) >= 1e-15" for a, lo, s, n in zip("xyz", low, grid.cell, grid.shape, strict=True))
    index = ", ".join(f"least(greatest(floor((o{a} + d{a} * (t + ds / 2) - {lo!r}::DOUBLE) / {s!r}::DOUBLE), 0), {n - 1})::INTEGER AS i{a}" for a, lo, s, n in zip("xyz", low, grid.cell, grid.shape, strict=True))
    return f"""box AS (SELECT *, greatest(t0, {enter}) AS tin, least(t1, {leave}) AS tout FROM rays WHERE {inside}),
cuts AS ({cuts} UNION ALL SELECT py, px, tin FROM box UNION ALL SELECT py, px, tout FROM box),
ok AS (SELECT b.*, c.t FROM cuts c JOIN box b USING (py, px) WHERE tin < tout AND c.t >= tin AND c.t <= tout),
led AS (SELECT *, lead(t) OVER (PARTITION BY py, px ORDER BY t) - t AS ds FROM ok), seg AS (SELECT *, {index} FROM led WHERE ds > 1e-12)"""


def _grid_maps(s: SparkSession, d: str, camera: Camera) -> DataFrame:
    cube = P.intensive(P.deposit(T.gas(s, d), GRID, BOX, P.gas_fields()))
    found = PR.through_grid(PR.segments(PR.rays(s, camera), GRID), cube)
    rho, ds = F.col("gas_density"), F.col("ds")
    los = F.col("vx") * F.col("dx") + F.col("vy") * F.col("dy") + F.col("vz") * F.col("dz")
    den = F.sum(rho * ds)
    return found.groupBy("py", "px").agg(den.alias("col"), F.try_divide(F.sum(rho * F.col("temperature") * ds), den).alias("temperature"), F.try_divide(F.sum(rho * los * ds), den).alias("vlos"))


register("dda_segments", lambda s, d: rounded(PR.segments(PR.rays(s, SLAB), GRID).groupBy("py", "px", "ix", "iy", "iz").agg(F.sum("ds").alias("ds"))), f"WITH {_camera_sql(SLAB)}, {_axis_sql(GRID)} SELECT py, px, ix, iy, iz, round(sum(ds), 6) + 0 AS ds FROM seg GROUP BY ALL")
for _name, _camera in (("grid_maps_ortho", ORTHO), ("grid_maps_perspective", SLAB)):
    register(
        _name,
        lambda s, d, c=_camera: rounded(_grid_maps(s, d, c), 5),
        f"WITH {GAS_SQL}, {_deposit_sql(GRID, 'gas', GAS_SUMS)}, cube2 AS (SELECT * REPLACE ({', '.join(f'{f} / mass_weight AS {f}' for f in _MEANS)}) FROM cube), {_camera_sql(_camera)}, {_axis_sql(GRID)}, j AS (SELECT * FROM seg JOIN cube2 USING (ix, iy, iz)) SELECT py, px, round(sum(gas_density * ds), 5) + 0 AS col, round(sum(gas_density * temperature * ds) / nullif(sum(gas_density * ds), 0), 5) + 0 AS temperature, round(sum(gas_density * (vx * dx + vy * dy + vz * dz) * ds) / nullif(sum(gas_density * ds), 0), 5) + 0 AS vlos FROM j GROUP BY py, px",
    )
register("sph_columns_ortho", *_fused(ORTHO))
register("sph_columns_perspective_slab", *_fused(SLAB))
register("sph_means_ortho", *_mean_query(ORTHO))
register("sph_means_perspective_slab", *_mean_query(SLAB))
for _name in VOLUME:
    register(f"emission_{_name}", *_emission(_name))
register("emission_supersampled", *_emission("gas_density", 2))
_DM_BALL = Region((250.0, 500.0, 500.0), (0.0, 0.0, 0.0), radius=150.0)
_AGE = f"({2 / 3 * S.GYR_FACTOR / S.HUBBLE / math.sqrt(S.OMEGA_L)!r}::DOUBLE * asinh({math.sqrt(S.OMEGA_L / S.OMEGA_M)!r}::DOUBLE * pow({{}}, 1.5::DOUBLE)))"
_VALID = f"{STARS_SQL}, good AS (SELECT * FROM stars WHERE a_form > 0 AND a_form < {A_NOW + 1e-6!r}::DOUBLE AND metallicity > 0 AND m_init > 0), aged AS (SELECT *, greatest({_AGE.format(f'{A_NOW}::DOUBLE')} - {_AGE.format('a_form')}, 1e-5::DOUBLE) AS age FROM good)"


def _lattice_sql() -> str:
    ages, metals = LATTICE["log_age"], LATTICE["log_z"]
    rows = ", ".join(f"({ages[i]!r}::DOUBLE, {ages[i + 1]!r}::DOUBLE, {metals[j]!r}::DOUBLE, {metals[j + 1]!r}::DOUBLE, {i}, {j}, " + ", ".join(f"{LATTICE[b][i + x][j + y]!r}::DOUBLE" for b in ("L_g", "L_r") for x in (0, 1) for y in (0, 1)) + ")" for i in range(len(ages) - 1) for j in range(len(metals) - 1))
    share = lambda b: f"((1 - fa) * (1 - fz) * {b}00 + (1 - fa) * fz * {b}01 + fa * (1 - fz) * {b}10 + fa * fz * {b}11) * m_init * {S.MASS_UNIT / S.LITTLE_H!r}::DOUBLE AS L_{b}"
    return f"""lat(a0, a1, z0, z1, i, j, g00, g01, g10, g11, r00, r01, r10, r11) AS (VALUES {rows}),
lg AS (SELECT *, log10(age) AS log_age, log10(metallicity / 0.0127::DOUBLE) AS log_z FROM aged), cl AS (SELECT *, least(greatest(log_age, {ages[0]}), {ages[-1]}) AS la, least(greatest(log_z, {metals[0]}), {metals[-1]}) AS lz FROM lg),
lt AS (SELECT *, (la - a0) / (a1 - a0) AS fa, (lz - z0) / (z1 - z0) AS fz FROM cl JOIN lat ON (la > a0 OR i = 0) AND la <= a1 AND (lz > z0 OR j = 0) AND lz <= z1),
shining AS (SELECT *, {share('g')}, {share('r')} FROM lt)"""


register("star_ages", lambda s, d: rounded(ST.valid(T.stars(s, d), A_NOW).select("pid", S.stellar_age(F.col("a_form"), A_NOW).alias("age"))), f"WITH {_VALID} SELECT pid, {sql_round('age')} FROM aged")
register("star_luminosity", lambda s, d: rounded(ST.population(ST.valid(T.stars(s, d), A_NOW), LATTICE, A_NOW).select("pid", "log_age", "log_z", "L_g", "L_r"), 1), f"WITH {_VALID}, {_lattice_sql()} SELECT pid, {sql_round('log_age log_z L_g L_r', 1)} FROM shining")
STAR_CAMERA = Camera((250.0, 500.0, 100.0), (250.0, 500.0, 500.0), (0.0, 1.0, 0.0), kind="perspective", width=32, height=24, fov=70.0)


def _splat(s: SparkSession, d: str) -> DataFrame:
    lit = ST.population(ST.valid(T.stars(s, d), A_NOW), LATTICE, A_NOW)
    return rounded(ST.splat(ST.project(lit, STAR_CAMERA), STAR_CAMERA, ["L_g", "L_r"]), 1)


def _splat_sql() -> str:
    c, (r, u, f), tx = STAR_CAMERA, STAR_CAMERA.basis(), math.tan(math.radians(STAR_CAMERA.fov) / 2)
    dot = lambda v: " + ".join(f"({a} - ({p!r}::DOUBLE)) * ({x!r}::DOUBLE)" for a, p, x in zip("xyz", c.position, v, strict=True))
    cells = ", ".join(f"({y}, {x}, {w!r}::DOUBLE)" for y, x, w in ST.stamp(0.7, 3.0))
    return f"""WITH {_VALID}, {_lattice_sql()}, cam AS (SELECT L_g, L_r, {dot(r)} AS xc, {dot(u)} AS yc, {dot(f)} AS zc FROM shining),
pp AS (SELECT *, (xc / (zc * {tx!r}::DOUBLE) * 0.5 + 0.5) * {c.width} AS fx, (-yc / (zc * {tx * c.height / c.width!r}::DOUBLE) * 0.5 + 0.5) * {c.height} AS fy FROM cam WHERE zc > 1),
st(sy, sx, w) AS (VALUES {cells}),
o AS (SELECT (round_even(fy, 0)::INTEGER + sy)::INTEGER AS py, (round_even(fx, 0)::INTEGER + sx)::INTEGER AS px, L_g * w AS L_g, L_r * w AS L_r FROM pp, st WHERE fx >= -5 AND fx < {c.width + 5} AND fy >= -5 AND fy < {c.height + 5})
SELECT py, px, round(sum(L_g), 1) + 0 AS L_g, round(sum(L_r), 1) + 0 AS L_r FROM o WHERE py >= 0 AND py < {c.height} AND px >= 0 AND px < {c.width} GROUP BY py, px"""


register("star_splat", _splat, _splat_sql())
register("star_clip_gain", lambda s, d: rounded(ST.clip(T.stars(s, d), (250.0, 500.0, 500.0), 300.0, 0.2).select("pid", "clip_gain", ST.brightness_gain(T.stars(s, d), (250.0, 500.0, 100.0), 500.0, 50.0, 1.5).alias("gain"))), f"WITH {STARS_SQL} SELECT pid, (CASE WHEN (x - 250) ** 2 + (y - 500) ** 2 + (z - 500) ** 2 <= 90000 THEN 1 ELSE 0.2 END)::DOUBLE AS clip_gain, round(pow(250000::DOUBLE / greatest((x - 250) ** 2 + (y - 500) ** 2 + (z - 100) ** 2, 2500), 0.75::DOUBLE), 6) + 0 AS gain FROM stars")
def _days(s: SparkSession, d: str) -> DataFrame:
    """Frames of a film of days: those that the events have."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return T.read(s, d, "events").select(day.alias("frame")).distinct().where(F.col("frame").between(0, FRAMES - 1))


_DAYS_SQL = f"(SELECT * FROM (SELECT DISTINCT date_diff('day', DATE '2024-01-01', ts::DATE) AS i FROM events) WHERE i BETWEEN 0 AND {FRAMES - 1}) t"
register("zoom_widths", lambda s, d: rounded(_days(s, d).select("frame", FR.geometric(FRAMES, 900.0, 30.0).alias("width"), FR.geometric(FRAMES, 900.0, 30.0, 20).alias("past"))), f"SELECT i::INTEGER AS frame, round(900 * pow({30 / 900!r}::DOUBLE, i / {FRAMES - 1}.0::DOUBLE), 6) + 0 AS width, round(900 * pow({30 / 900!r}::DOUBLE, i / 20.0::DOUBLE), 6) + 0 AS past FROM {_DAYS_SQL}")
register("orbit_path", lambda s, d: rounded(FR.orbit(s, FRAMES, (500.0, 400.0, 300.0), 80.0, _days(s, d))), f"SELECT i::INTEGER AS frame, round(500 + 80 * cos({2 * math.pi!r}::DOUBLE * i / {FRAMES}), 6) + 0 AS x, round(400 + 80 * sin({2 * math.pi!r}::DOUBLE * i / {FRAMES}), 6) + 0 AS y, 300::DOUBLE AS z FROM {_DAYS_SQL}")
register("spiral_path", lambda s, d: rounded(FR.spiral(s, FRAMES, (500.0, 400.0, 300.0), 200.0, 20.0, 1.5, 0.3, "xz", 24, _days(s, d))), f"SELECT frame, round(r, 6) + 0 AS r, round(500 + r * cos(a), 6) + 0 AS x, 400::DOUBLE AS y, round(300 + r * sin(a), 6) + 0 AS z FROM (SELECT i::INTEGER AS frame, 200 * pow(0.1::DOUBLE, i / 24.0::DOUBLE) AS r, 0.3::DOUBLE + {3 * math.pi!r}::DOUBLE * i / 24 AS a FROM {_DAYS_SQL})")


def _tiers(s: SparkSession, d: str) -> DataFrame:
    """A 16:9 view for each nation, narrower with its key."""
    views = T.read(s, d, "nation").select(F.col("n_nationkey").alias("frame")).withColumn("width", F.round(FR.geometric(25, 900.0, 20.0), 6))
    return FR.pick_tier(views, s.createDataFrame(TIERS, "tier string, side double"), "width", 0.05, 16 / 9)


_TIER_SQL = f"tiers(tier, side) AS (VALUES {', '.join(f'({t!r}, {v}::DOUBLE)' for t, v in TIERS)}), views AS (SELECT n_nationkey AS frame, round(900 * pow({20 / 900!r}::DOUBLE, n_nationkey / 24.0::DOUBLE), 6) AS width FROM nation), chosen AS (SELECT frame, width, coalesce((SELECT arg_min(tier, side) FROM tiers WHERE side * 1.05::DOUBLE >= greatest(width, width * 16 / 9)), 'wide') AS tier FROM views)"
register("tier_pick", _tiers, f"WITH {_TIER_SQL} SELECT * FROM chosen")
register("tier_runs", lambda s, d: FR.runs(_tiers(s, d), "tier"), f"WITH {_TIER_SQL} SELECT run, tier, min(frame) AS first, max(frame) AS last FROM (SELECT *, sum(new) OVER (ORDER BY frame)::BIGINT AS run FROM (SELECT *, (coalesce(lag(tier) OVER (ORDER BY frame), '') <> tier)::INTEGER AS new FROM chosen)) GROUP BY run, tier")
_SERIES = f"p AS (SELECT frame, quantile_cont(v, 0.9) AS p0 FROM img WHERE v > 0 GROUP BY frame), ser AS (SELECT i::INTEGER AS frame, CASE WHEN i % 7 IN (2, 3) OR i < 1 THEN NULL ELSE log10(p0) END AS y FROM range({FRAMES}) t(i) LEFT JOIN p ON p.frame = i)"


def _series(s: SparkSession, d: str) -> DataFrame:
    each = IM.percentiles(_image(s, d), "v", [0.9], ["frame"])
    return FR.frames(s, FRAMES).join(each, "frame", "left").select("frame", F.when((F.col("frame") % 7).isin(2, 3) | (F.col("frame") < 1), None).otherwise(F.log10("p0")).alias("y"))


_FILLED = f"{IMAGE_SQL}, {_SERIES}, fil AS (SELECT frame, coalesce(y, v0 + (v1 - v0) * (frame - f0) / nullif(f1 - f0, 0)::DOUBLE, v0, v1) AS y FROM (SELECT frame, y, (SELECT arg_max(y, frame) FROM ser b WHERE b.frame <= a.frame AND y IS NOT NULL) AS v0, (SELECT max(frame) FROM ser b WHERE b.frame <= a.frame AND y IS NOT NULL) AS f0, (SELECT arg_min(y, frame) FROM ser b WHERE b.frame >= a.frame AND y IS NOT NULL) AS v1, (SELECT min(frame) FROM ser b WHERE b.frame >= a.frame AND y IS NOT NULL) AS f1 FROM ser a))"
register("gap_fill", lambda s, d: rounded(FR.fill(_series(s, d), "y")), f"WITH {_FILLED} SELECT frame, round(y, 6) + 0 AS y FROM fil")
register("rolling_mean_edge", lambda s, d: rounded(FR.rolling_mean(FR.fill(_series(s, d), "y"), "y", FRAMES)), f"WITH {_FILLED} SELECT a.i::INTEGER AS frame, round(avg(fil.y), 6) + 0 AS y FROM range({FRAMES}) a(i), range(-2, 3) o(k), fil WHERE fil.frame = greatest(0, least({FRAMES - 1}, a.i + o.k)) GROUP BY a.i")
register("gaussian_smooth_reflect", lambda s, d: rounded(FR.gaussian(FR.fill(_series(s, d), "y"), "y", FRAMES, 2.0)), f"WITH {_FILLED} SELECT a.i::INTEGER AS frame, round(sum(exp(-0.5::DOUBLE * (o.k / 2.0::DOUBLE) ** 2) * fil.y) / sum(exp(-0.5::DOUBLE * (o.k / 2.0::DOUBLE) ** 2)), 6) + 0 AS y FROM range({FRAMES}) a(i), range(-8, 9) o(k), fil WHERE fil.frame = (CASE WHEN a.i + o.k < 0 THEN -(a.i + o.k) WHEN a.i + o.k > {FRAMES - 1} THEN {2 * (FRAMES - 1)} - (a.i + o.k) ELSE a.i + o.k END) GROUP BY a.i")


def _fade(s: SparkSession, d: str) -> DataFrame:
    a, b, alpha = FR.crossfade(960, 5, 30)
    at = T.read(s, d, "events").select((F.col("event_id") % 960).cast("int").alias("frame")).distinct()
    return rounded(at.select("frame", a.alias("before"), b.alias("after"), alpha.alias("alpha")))


register("crossfade_schedule", _fade, "SELECT f.i::INTEGER AS frame, coalesce(b.s - 1, least(f.i // 192, 4))::INTEGER AS before, coalesce(b.s, least(f.i // 192, 4))::INTEGER AS after, round(coalesce((f.i - (b.s * 192 - 15) + 0.5::DOUBLE) / 30, 0), 6) + 0 AS alpha FROM (SELECT DISTINCT event_id % 960 AS i FROM events) f LEFT JOIN range(1, 5) b(s) ON f.i >= b.s * 192 - 15 AND f.i < b.s * 192 + 15")
register("missing_frames", lambda s, d: FR.missing(FR.frames(s, 40), _image(s, d).where("v > 0 and frame % 3 <> 1")), f"WITH {IMAGE_SQL} SELECT i::INTEGER AS frame FROM range(40) t(i) WHERE i NOT IN (SELECT frame FROM img WHERE v > 0 AND frame % 3 <> 1)")
register("frame_percentiles", lambda s, d: rounded(IM.percentiles(_image(s, d), "v", [0.02, 0.5, 0.995], ["frame"])), f"WITH {IMAGE_SQL} SELECT frame, round(quantile_cont(v, 0.02), 6) + 0 AS p0, round(quantile_cont(v, 0.5), 6) + 0 AS p1, round(quantile_cont(v, 0.995), 6) + 0 AS p2 FROM img WHERE v > 0 GROUP BY frame")
register("pooled_percentile", lambda s, d: rounded(IM.pooled(_image(s, d), "v", [0, 7, 15, 22], 0.99)), f"WITH {IMAGE_SQL} SELECT round(quantile_cont(v, 0.99), 6) + 0 AS p0 FROM img WHERE v > 0 AND frame IN (0, 7, 15, 22)")
register("percentile_of_percentiles", lambda s, d: rounded(IM.percentile_of_percentiles(_image(s, d), "v", 0.9, 0.75, 4)), f"WITH {IMAGE_SQL} SELECT round(quantile_cont(p, 0.75), 6) + 0 AS p0 FROM (SELECT quantile_cont(v, 0.9) AS p FROM img WHERE v > 0 AND frame % 4 = 0 GROUP BY frame)")
register("absolute_percentile", lambda s, d: rounded(IM.percentiles(_image(s, d).withColumn("v", F.col("v") - 20), "v", [0.99], absolute=True)), f"WITH {IMAGE_SQL} SELECT round(quantile_cont(abs(v - 20), 0.99), 6) + 0 AS p0 FROM img")
_TONES = [_unit_sql(c, 0.3, 0.997, c) for c in "abc"]
_TONE_CTES, _TONE_FROM = ", ".join(x[0] for x in _TONES), "m, ra, rb, rc"


def _tones(s: SparkSession, d: str) -> DataFrame:
    df = base = _map(s, d)
    for c in "abc":
        df = IM.log_unit(df, c, f"t{c}", 0.3, 0.997, of=base)
    return df


register("log_normalize", lambda s, d: rounded(_tones(s, d).select("py", "px", "ta", "tb", "tc")), f"WITH {MAP_SQL}, {_TONE_CTES} SELECT py, px, {', '.join(f'round({t}, 6) + 0 AS t{c}' for c, (_, t) in zip('abc', _TONES, strict=True))} FROM {_TONE_FROM}")
_PHASE = [((0.2, 0.4, 1.0), 1.0), ((0.3, 1.0, 0.4), 0.8), ((1.0, 0.3, 0.2), 1.2)]


def _tri(s: SparkSession, d: str) -> DataFrame:
    rgb = IM.add_colours([(F.col(f"t{c}"), g, colour) for c, (colour, g) in zip("abc", _PHASE, strict=True)])
    return rounded(_tones(s, d).select("py", "px", *(v.alias(n) for n, v in zip("rgb", rgb, strict=True))))


def _bases() -> str:
    return f"WITH {MAP_SQL}, {_TONE_CTES}, tone AS (SELECT py, px, a, b, c, {', '.join(f'{t} AS t{c}' for c, (_, t) in zip('abc', _TONES, strict=True))} FROM {_TONE_FROM})"


register("tri_phase", _tri, f"{_bases()} SELECT py, px, " + ", ".join(f"round(least(greatest({' + '.join(f't{c} * {g} * {colour[i]}::DOUBLE' for c, (colour, g) in zip('abc', _PHASE, strict=True))}, 0), 1), 6) + 0 AS {n}" for i, n in enumerate("rgb")) + " FROM tone")


def _colours(s: SparkSession, d: str) -> DataFrame:
    df = _tones(s, d)
    out = []
    for name, steps in (("aurora", 512), ("cosmic_layers", 512), ("temp_brm", 256)):
        out += [v.alias(f"{name}_{n}") for n, v in zip("rgb", IM.ramp(F.round("ta", 9), IM.RAMPS[name], steps), strict=True)]
    return rounded(df.select("py", "px", *out))


register("colormap_lookup", _colours, f"{_bases()} SELECT py, px, " + ", ".join(f"round({_ramp_sql('round(ta, 9)', IM.RAMPS[name], steps, i)}, 6) + 0 AS {name}_{n}" for name, steps in (("aurora", 512), ("cosmic_layers", 512), ("temp_brm", 256)) for i, n in enumerate("rgb")) + " FROM tone")


def _hue(s: SparkSession, d: str) -> DataFrame:
    rgb = IM.hue_bright(IM.ramp(F.round("tb", 9), IM.RAMPS["temp_brm"], 256), F.pow("ta", S.lit(0.8)), 0.4, 3.0)
    return rounded(_tones(s, d).select("py", "px", *(v.alias(n) for n, v in zip("rgb", rgb, strict=True))))


register("hue_brightness", _hue, f"{_bases()}, hb AS (SELECT py, px, pow(ta, 0.8::DOUBLE) AS br, {', '.join(_ramp_sql('round(tb, 9)', IM.RAMPS['temp_brm'], 256, i) + f' AS {n}0' for i, n in enumerate('rgb'))} FROM tone) SELECT py, px, " + ", ".join(f"round(least(greatest({n}0 * br + 0.4::DOUBLE * pow(br, 3) * (1 - {n}0 * br), 0), 1), 6) + 0 AS {n}" for n in "rgb") + " FROM hb")


def _lupton(s: SparkSession, d: str) -> DataFrame:
    rgb = IM.lupton(F.col("tc") * 1.5, F.col("tb") * 1.2, F.col("ta"))
    return rounded(_tones(s, d).select("py", "px", *(v.alias(n) for n, v in zip("rgb", rgb, strict=True))))


register("lupton_rgb", _lupton, f"{_bases()}, ch AS (SELECT py, px, tc * 1.5::DOUBLE AS r0, tb * 1.2::DOUBLE AS g0, ta AS b0 FROM tone), f AS (SELECT *, asinh(8 * ((r0 + g0 + b0) / 3 + 1e-30)) / (8 * ((r0 + g0 + b0) / 3 + 1e-30)) AS f FROM ch) SELECT py, px, " + ", ".join(f"round(least(greatest({n}0 * f, 0), 1), 6) + 0 AS {n}" for n in "rgb") + " FROM f")
register("alpha_fade_over", lambda s, d: rounded(_tones(s, d).select("py", "px", *(v.alias(n) for n, v in zip("rgb", IM.over_background([F.col("ta"), F.col("tb"), F.col("tc")], IM.fade_alpha(F.col("ta"), F.col("a"), 0.1, 1.4), (0.1, 0.2, 0.3)), strict=True)))), f"{_bases()}, al AS (SELECT *, CASE WHEN a <= 0 THEN 0 ELSE 0.1::DOUBLE + 0.9::DOUBLE * pow(ta, 1.4::DOUBLE) END AS alpha FROM tone) SELECT py, px, " + ", ".join(f"round(least(greatest(t{c} * alpha + {g}::DOUBLE * (1 - alpha), 0), 1), 6) + 0 AS {n}" for n, c, g in zip("rgb", "abc", (0.1, 0.2, 0.3), strict=True)) + " FROM al")


def _layers(s: SparkSession, d: str) -> DataFrame:
    t = _tones(s, d)
    parts = [t.select("py", "px", F.lit(i).alias("layer"), *((F.col(f"t{c}") * S.lit(k)).alias(n) for n, k in zip("rgb", w, strict=True)), (F.col(f"t{c}") * 0.6).alias("a")) for i, (c, w) in enumerate(zip("abc", ((1.0, 0.5, 0.2), (0.2, 1.0, 0.4), (0.3, 0.3, 1.0)), strict=True))]
    return rounded(IM.stack_layers(parts[0].unionByName(parts[1]).unionByName(parts[2])))


def _layers_sql() -> str:
    w = ((1.0, 0.5, 0.2), (0.2, 1.0, 0.4), (0.3, 0.3, 1.0))
    a = [f"t{c} * 0.6::DOUBLE" for c in "abc"]
    # Light of a layer times what the layers before it let through; on black no division is left.
    out = ", ".join(f"round({' + '.join(f't{c} * {w[i][k]}::DOUBLE * {a[i]}' + ''.join(f' * (1 - {a[j]})' for j in range(i)) for i, c in enumerate('abc'))}, 6) + 0 AS {n}" for k, n in enumerate("rgb"))
    return f"{_bases()} SELECT py, px, {out} FROM tone"


register("layer_over", _layers, _layers_sql())
register("vector_magnitude", lambda s, d: rounded(_map(s, d).select("py", "px", F.log10(F.greatest(F.sqrt(F.col("a") ** 2 + F.col("b") ** 2 + F.col("c") ** 2), S.lit(1e-6))).alias("v"), (F.col("a") * 2 + F.col("b") * 0.5).alias("both"))), f"WITH {MAP_SQL} SELECT py, px, round(log10(greatest(sqrt(a * a + b * b + c * c), 1e-6)), 6) + 0 AS v, round(a * 2 + b * 0.5, 6) + 0 AS both FROM m")
register("compare_maps", lambda s, d: rounded(IM.compare(_map(s, d).select("py", "px", F.col("a").alias("v")), _map(s, d).where("px > 1").select("py", "px", (F.col("c") + 50).alias("v")))), f"WITH {MAP_SQL}, o AS (SELECT a AS p, c + 50 AS q, a / (c + 50) AS r, (a - (c + 50)) / (c + 50) AS f FROM m WHERE px > 1) SELECT round(sum(p) / greatest(sum(q), 1e-30), 6) + 0 AS sum_ratio, " + ", ".join(f"round(avg({v}), 6) + 0 AS {n}_mean, round(quantile_cont({v}, 0.5), 6) + 0 AS {n}_median, round(stddev_pop({v}), 6) + 0 AS {n}_std, round(min({v}), 6) + 0 AS {n}_min, round(max({v}), 6) + 0 AS {n}_max" for n, v in (("ratio", "r"), ("diff", "f"))) + " FROM o")
register("nice_lengths", lambda s, d: rounded(T.read(s, d, "part").select(F.col("p_partkey").cast("long").alias("id")).where("id > 0").select("id", S.nice_length(F.col("id") * 0.37).alias("n"))), "SELECT i AS id, round((CASE WHEN x >= 5 * p THEN 5 * p WHEN x >= 2 * p THEN 2 * p ELSE p END), 6) + 0 AS n FROM (SELECT i, i * 0.37::DOUBLE AS x, pow(10::DOUBLE, floor(log10(i * 0.37::DOUBLE))) AS p FROM (SELECT p_partkey::BIGINT AS i FROM part WHERE p_partkey > 0))")
register("snapshot_numbers", lambda s, d: T.read(s, d, "part").select("p_partkey", S.snapshot_number(F.concat(F.lit("/run/snap_"), F.lpad((F.col("p_partkey") % 300).cast("string"), 3, "0"), F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(".3"))).alias("n")), "SELECT p_partkey, (p_partkey % 300)::INTEGER AS n FROM part")

# ---- cubes of several grids, headers, particles of other kinds -------------------------------------------------------
def _several(s: SparkSession, d: str) -> DataFrame:
    gas = T.gas(s, d)
    parts = [P.deposit(gas, g, BOX, {"gas_density": F.col("mass")}).withColumn("grid", F.lit(n)) for n, g in (("first", GRID), ("second", SECOND))]
    return rounded(parts[0].unionByName(parts[1]), 9)


register("deposit_multi_grid", _several, " UNION ALL ".join(f"SELECT ix, iy, iz, {sql_round('gas_density', 9)}, '{n}' AS grid FROM (WITH {GAS_SQL}, {_deposit_sql(g, 'gas', {'gas_density': 'mass'})} SELECT * FROM cube)" for n, g in (("first", GRID), ("second", SECOND))))
register("grid_header", lambda s, d: CU.header(s, SECOND, redshift=0.5, snapshot=158), f"SELECT 'grid' AS name, {list(SECOND.center)}::DOUBLE[] AS center, {list(SECOND.size)}::DOUBLE[] AS size, {SECOND.size[0]}::DOUBLE AS side, {list(SECOND.shape)}::INTEGER[] AS shape, {SECOND.shape[0]}::INTEGER AS resolution, {list(SECOND.cell)}::DOUBLE[] AS cell_size, 0.5::DOUBLE AS redshift, 158::INTEGER AS snapshot")


def _masses(source: str, column: str):
    """A column map of dark matter or stars, with a smoothing length that the table has or a fixed one."""

    def query(s: SparkSession, d: str) -> DataFrame:
        df = T.dm(s, d) if source == "dm" else T.stars(s, d).withColumns({"mass": F.col("m_init") * S.lit(1e6), "h": S.lit(4)})
        return rounded(PR.columns(PR.hits(P.cull(df, BALL, BOX), ORTHO), {column: S.lit(1)}))

    lead = f"{DM_SQL}, src AS (SELECT * FROM dm)" if source == "dm" else f"{STARS_SQL}, src AS (SELECT *, m_init * 1e6::DOUBLE AS mass, 4::DOUBLE AS h FROM stars)"
    return query, f"WITH {lead}, seen AS ({_cull_sql(BALL, 'src', '0::DOUBLE')}), {_camera_sql(ORTHO)}, {HITS_SQL}, {_table_sql(True)}, {COLUMN_SQL} SELECT py, px, round(sum(k), 6) + 0 AS {column} FROM k GROUP BY py, px"


register("dm_column", *_masses("dm", "dm_column_density"))
register("star_column", *_masses("stars", "star_column_density"))
register("star_subsample", lambda s, d: rounded(P.subsample(T.stars(s, d), 150).select("pid", "x", "y", "z")), f"WITH {STARS_SQL} SELECT pid, {sql_round('x y z')} FROM stars ORDER BY md5(pid::VARCHAR), pid LIMIT 150")
register("magnitude_luminosity", lambda s, d: rounded(T.read(s, d, "part").select("p_partkey", S.magnitude_luminosity(F.col("p_size") / S.lit(5), 4.65).alias("l"))), "SELECT p_partkey, round(pow(10::DOUBLE, (4.65::DOUBLE - p_size / 5.0::DOUBLE) / 2.5::DOUBLE), 6) + 0 AS l FROM part")
_TABLE = f"tab AS (SELECT i, pow(10::DOUBLE, -5 + 5 * i / 1999.0::DOUBLE) AS a FROM range(2000) t(i)), fs AS (SELECT i, a, 1 / (a * sqrt({S.OMEGA_M}::DOUBLE / pow(a, 3) + {S.OMEGA_L}::DOUBLE)) AS f FROM tab), ages AS (SELECT i, a, sum(strip) OVER (ORDER BY i) * {S.GYR_FACTOR / S.HUBBLE!r}::DOUBLE AS age FROM (SELECT i, a, coalesce((f + lag(f) OVER (ORDER BY i)) / 2 * (a - lag(a) OVER (ORDER BY i)), 0) AS strip FROM fs))"
register("age_table", lambda s, d: rounded(ST.age_table(s, 2000), 9), f"WITH {_TABLE} SELECT i, {sql_round('a age', 9)} FROM ages")
register("age_interpolated", lambda s, d: rounded(ST.age_at(T.stars(s, d).where("a_form > 0"), ST.age_table(s, 2000), "a_form", 2000).select("pid", "age")), f"WITH {STARS_SQL}, {_TABLE}, spans AS (SELECT a AS a0, age AS t0, lead(a) OVER (ORDER BY i) AS a1, lead(age) OVER (ORDER BY i) AS t1 FROM ages) SELECT pid, round(t0 + (t1 - t0) * (a_form - a0) / (a1 - a0), 6) + 0 AS age FROM stars JOIN spans ON a_form >= a0 AND a_form < a1 WHERE a_form > 0")
_JX, _JY = _jitter_sql(3)
register("jitter_hash", lambda s, d: T.read(s, d, "events").select((F.col("event_id") % 16).cast("int").alias("py"), (F.col("user_id") % 24).cast("int").alias("px")).distinct().select("py", "px", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sx")).withColumn("sy", F.lit(1)).select("py", "px", "sx", *(F.round(x, 9).alias(n) for n, x in zip(("jx", "jy"), PR.jitter(3), strict=True))), f"SELECT py, px, sx, round((sx + {_JX}) / 3, 9) AS jx, round((sy + {_JY}) / 3, 9) AS jy FROM (SELECT py, px, u.sx::INTEGER AS sx, 1 AS sy FROM (SELECT DISTINCT (event_id % 16)::INTEGER AS py, (user_id % 24)::INTEGER AS px FROM events), range(3) u(sx))")

# ---- paths ------------------------------------------------------------------------------------------------------------
register("flyin_path", lambda s, d: rounded(FR.fly_in(s, FRAMES, (500.0, 400.0, 300.0), 200.0, 20.0, "Z", 24, _days(s, d))), f"SELECT frame, {sql_round('r')}, 500::DOUBLE AS x, 400::DOUBLE AS y, round(300 + r, 6) + 0 AS z FROM (SELECT i::INTEGER AS frame, 200 * pow(0.1::DOUBLE, i / 24.0::DOUBLE) AS r FROM {_DAYS_SQL})")
register("clip_schedule", lambda s, d: rounded(_days(s, d).select("frame", FR.clip_radii(FRAMES, start=400.0, end=25.0, reach=20).alias("radius"), FR.clip_radii(FRAMES, 60.0).alias("fixed"), FR.depth("same-as-y", 50.0, FR.geometric(FRAMES, 900.0, 30.0)).alias("depth"))), f"SELECT i::INTEGER AS frame, round(400 * pow(0.0625::DOUBLE, i / 20.0::DOUBLE), 6) + 0 AS radius, 60::DOUBLE AS fixed, round(900 * pow({30 / 900!r}::DOUBLE, i / {FRAMES - 1}.0::DOUBLE), 6) + 0 AS depth FROM {_DAYS_SQL}")
register("trim_frame", lambda s, d: FR.first_covered(_days(s, d).withColumn("width", F.round(FR.geometric(FRAMES, 900.0, 30.0), 6)), "width", 800.0, 16 / 9), f"SELECT coalesce(min(i), 0)::INTEGER AS frame FROM {_DAYS_SQL} WHERE round(900 * pow({30 / 900!r}::DOUBLE, i / {FRAMES - 1}.0::DOUBLE), 6) * {16 / 9!r}::DOUBLE <= 800")
register("tier_counts", lambda s, d: _tiers(s, d).groupBy("tier").agg(F.count("*").alias("n")), f"WITH {_TIER_SQL} SELECT tier, count(*) AS n FROM chosen GROUP BY tier")

# ---- images -----------------------------------------------------------------------------------------------------------
register("global_stretch", lambda s, d: rounded(IM.stretch(_map(s, d), _map(s, d).select(*(F.col(c) * S.lit(k) for c, k in zip("abc", (3.0, 1.5, 2.0), strict=True)), F.lit(0)).toDF("a", "b", "c", "z"), ["a", "b", "c"], 0.995, 0.4)), f"WITH {MAP_SQL}, e AS (SELECT quantile_cont(v, 0.995) + 1e-30 AS natural_, quantile_cont(w, 0.995) + 1e-30 AS boosted FROM (SELECT unnest([a, b, c]) AS v, unnest([a * 3.0::DOUBLE, b * 1.5::DOUBLE, c * 2.0::DOUBLE]) AS w FROM m)) SELECT round(natural_, 6) + 0 AS \"natural\", round(boosted, 6) + 0 AS boosted, round(natural_ * pow(boosted / natural_, 0.4::DOUBLE), 6) + 0 AS stretch FROM e")


def _volume(s: SparkSession, d: str) -> DataFrame:
    return _map(s, d).withColumn("t", 1 / (1 + F.col("c") / S.lit(400)))


_CLEAR = "(1 - 1 / (1 + c / 400.0::DOUBLE))"
_VOLUME = f"{_bases()}, op0 AS (SELECT *, {_CLEAR} AS o FROM tone), op AS (SELECT *, pow(least(o / (SELECT quantile_cont(o, 0.99) FROM op0), 1), 0.7::DOUBLE) AS op FROM op0)"
register("volume_shade", lambda s, d: rounded(IM.shade(_volume(s, d), "b", "t", (0.9, 0.5, 0.2), 0.3, 0.997, 1.1, 0.7).select("py", "px", "r", "g", "b", "opacity")), f"{_VOLUME} SELECT py, px, {', '.join(f'round(tb * 1.1::DOUBLE * op * {c}::DOUBLE, 6) + 0 AS {n}' for n, c in zip('rgb', (0.9, 0.5, 0.2), strict=True))}, round(op, 6) + 0 AS opacity FROM op")


def _over(s: SparkSession, d: str) -> DataFrame:
    df = IM.opacity(IM.log_unit(_volume(s, d), "a", "ta", 0.3, 0.997), "t", "o", 0.7)
    rgb = IM.over_background(IM.ramp(F.round("ta", 9), IM.RAMPS["aurora"], 256), F.col("o"), (0.1, 0.2, 0.3))
    return rounded(df.select("py", "px", *(v.alias(n) for n, v in zip("rgb", rgb, strict=True))))


register("volume_over_background", _over, f"{_VOLUME} SELECT py, px, " + ", ".join(f"round(least(greatest({_ramp_sql('round(ta, 9)', IM.RAMPS['aurora'], 256, i)} * op + {g}::DOUBLE * (1 - op), 0), 1), 6) + 0 AS {n}" for i, (n, g) in enumerate(zip("rgb", (0.1, 0.2, 0.3), strict=True))) + " FROM op")
register("symmetric_norm", lambda s, d: rounded(IM.symmetric(_map(s, d).withColumn("v", F.col("a") - 400), "v", "u").select("py", "px", "u", IM.two_slopes(F.log10("b"), 4.0, 5.5, 6.5).alias("w"))), f"WITH {MAP_SQL}, e AS (SELECT quantile_cont(abs(a - 400), 0.99) AS p FROM m) SELECT py, px, round(least(greatest(0.5 + 0.5 * ((a - 400) / p), 0), 1), 6) + 0 AS u, round(least(greatest(CASE WHEN log10(b) < 5.5 THEN 0.5 * (log10(b) - 4) / 1.5::DOUBLE ELSE 0.5 + 0.5 * (log10(b) - 5.5) / 1.0::DOUBLE END, 0), 1), 6) + 0 AS w FROM m, e")
register("default_colormap", lambda s, d: T.read(s, d, "part").select("p_partkey", IM.default_ramp(F.element_at(F.array(*map(F.lit, _FIELDS)), (F.col("p_partkey") % len(_FIELDS)).cast("int") + 1)).alias("ramp")), f"SELECT p_partkey, CASE WHEN f LIKE '%temperature%' THEN 'cmo.thermal' WHEN f LIKE '%metal%' THEN 'viridis' WHEN f LIKE '%vlos%' OR f LIKE '%los_velocity%' THEN 'RdBu_r' WHEN f LIKE '%velocity%' OR f LIKE 'gas\\_v%' ESCAPE '\\' OR f LIKE '%vmag%' THEN 'cividis' ELSE 'inferno' END AS ramp FROM (SELECT p_partkey, lower(({list(_FIELDS)})[p_partkey % {len(_FIELDS)} + 1]) AS f FROM part)")
register("field_list", lambda s, d: T.read(s, d, "part").select("p_partkey", F.array_join(CU.field_list(F.concat(F.lit("gas_density, ,"), F.col("p_size").cast("string"), F.lit(",dm_density ,gas_density,"))), "|").alias("fields")), "SELECT p_partkey, 'gas_density|' || p_size || '|dm_density' AS fields FROM part")
register("mean_density", lambda s, d: rounded(PR.columns(PR.hits(P.cull(T.gas(s, d), BALL, BOX, 2 * F.col("h")), SLAB), {"v": S.lit(1)}).select("py", "px", (F.col("v") / S.lit(SLAB.slab)).alias("mean_density")), 8), f"WITH {GAS_SQL}, seen AS ({_cull_sql(BALL, 'gas', '2 * h')}), {_camera_sql(SLAB)}, {HITS_SQL}, {_table_sql(True)}, {COLUMN_SQL} SELECT py, px, round(sum(k) / {SLAB.slab}::DOUBLE, 8) + 0 AS mean_density FROM k GROUP BY py, px")


def _ramps(names: tuple[str, ...], steps: int):
    def query(s: SparkSession, d: str) -> DataFrame:
        out = [v.alias(f"{name}_{n}") for name in names for n, v in zip("rgb", IM.ramp(F.col("x"), IM.RAMPS[name], steps), strict=True)]
        return rounded(PR.settle(IM.log_unit(_map(s, d), "a", "ta", 0.3, 0.997).select("py", "px", F.round("ta", 9).alias("x"))).select("py", "px", *out))

    return query, f"{_bases()}, place AS (SELECT py, px, round(ta, 9) AS x FROM tone) SELECT py, px, " + ", ".join(f"round({_ramp_sql('x', IM.RAMPS[name], steps, i)}, 6) + 0 AS {name}_{n}" for name in names for i, n in enumerate("rgb")) + " FROM place"


register("colormap_matter", *_ramps(("matter_r_fade", "blue_orange", "ocean_glow", "ice"), 512))
register("colormap_metal", *_ramps(("metal_gold", "metal_cu", "metal_diverge_custom", "metal_dark_diverge"), 512))
register("colormap_sky", *_ramps(("ill_density", "ill_density_dark", "ill_metals", "ill_metals_dark", "ill_velocity"), 256))
register("colormap_volume", *_ramps(("neutral_H", "ionized_H", "heated_gas", "heavy_elements"), 256))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from . import colours, films, loading, zoom  # noqa: E402, F401  (they add their queries to the registry above)
