"""Queries over loading: stored snapshots, particle counts and extents, neighbours' lengths in maps, requests, whole images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import particles as P
from ..operators import projection as PR
from ..operators import stellar as ST
from ..sources import snapshots as SN
from ..sources import tables as T
from . import queries as Q
from . import requests as RQ
from .config import Projection

# ---- particles as stored: fixed-point coordinates for some rows, floating ones for the others, columns that are missing
_INT = "CAST(({}) % 4294967296 AS BIGINT)"
_FIXED = [_INT.format(f"l_orderkey * 2654435761 + l_linenumber * {k}") for k in (7919, 104729, 1299709)]
_FLOAT = [T.GAS[a] for a in "xyz"]


def _stored_gas(s: SparkSession, d: str) -> DataFrame:
    fixed = F.expr("l_orderkey % 2 = 0")
    columns = {
        "IntCoordinates": F.when(fixed, F.array(*map(F.expr, _FIXED))),
        "Coordinates": F.when(~fixed, F.array(*map(F.expr, _FLOAT))),
        "Masses": F.expr(T.GAS["mass"]),
        "Density": F.expr(T.GAS["density"]),
        "InternalEnergy": F.expr(T.GAS["internal_energy"]),
        "HII_Fraction": F.when(F.expr("l_linenumber < 4"), F.expr(T.GAS["hii"])),
        "Velocities": F.array(*(F.expr(T.GAS[f"v{a}"]) for a in "xyz")),
    }
    df = T.read(s, d, "lineitem")
    return df.select(F.struct(*T.GAS_KEY).alias("ParticleIDs"), *(c.alias(n) for n, c in columns.items()))


def _snapshot_gas(s: SparkSession, d: str) -> DataFrame:
    df = SN.gas(_stored_gas(s, d), T.BOX)
    return Q.rounded(df.select("ParticleIDs.*", "x", "y", "z", "mass", "metallicity", "hii", "h", "temperature", "vx", "vy", "vz"))


def _snapshot_gas_sql() -> str:
    place = []
    for a, fixed, free in zip("xyz", _FIXED, _FLOAT, strict=True):
        place.append(f"CASE WHEN l_orderkey % 2 = 0 THEN {fixed}::DOUBLE / 4294967296 * 1000 ELSE {Q.duck(free)} END AS {a}")
    g = {n: Q.duck(e) for n, e in T.GAS.items()}
    mu = f"(4::DOUBLE / ({1 + 3 * S.HYDROGEN!r}::DOUBLE + {4 * S.HYDROGEN!r}::DOUBLE * hii))"
    heat = f"({S.GAMMA!r}::DOUBLE - 1) * u * 1e10::DOUBLE * {mu} * {S.PROTON_MASS!r}::DOUBLE / {S.BOLTZMANN!r}::DOUBLE"
    return f"""WITH stored AS (SELECT {', '.join(T.GAS_KEY)}, {', '.join(place)}, {g['mass']} AS mass, {g['density']} AS density,
  {g['internal_energy']} AS u, 0::DOUBLE AS metallicity, CASE WHEN l_linenumber < 4 THEN {g['hii']} ELSE 0 END AS hii,
  {g['vx']} AS vx, {g['vy']} AS vy, {g['vz']} AS vz FROM lineitem),
made AS (SELECT *, cbrt(3 * (mass / density) / (4 * pi())) AS h, {heat} AS temperature FROM stored)
SELECT {', '.join(T.GAS_KEY)}, {Q.sql_round('x y z mass metallicity hii h temperature vx vy vz')} FROM made"""


Q.register("snapshot_gas", _snapshot_gas, _snapshot_gas_sql())


# ---- counts and extents ------------------------------------------------------------------------------------------------
def _extent(s: SparkSession, d: str) -> DataFrame:
    return Q.rounded(P.extent(P.scale_h(P.cull(T.gas(s, d), Q.BALL, T.BOX, 2 * F.col("h")), 1.5)))


_ENDS = ", ".join(f"round(min({a}), 6) + 0 AS {a}_min, round(max({a}), 6) + 0 AS {a}_max" for a in "xyz")
Q.register(
    "particle_extent",
    _extent,
    f"WITH {Q.GAS_SQL}, near AS ({Q._cull_sql(Q.BALL, 'gas', '2 * h')}) SELECT count(*) AS n, {_ENDS}, round(max(h) * 1.5::DOUBLE, 6) + 0 AS h_max FROM near",
)
Q.register(
    "particle_counts",
    lambda s, d: P.loaded(T.gas(s, d), Q.BRICK, T.BOX, 2 * F.col("h")),
    f"WITH {Q.GAS_SQL} SELECT (SELECT count(*) FROM gas) AS total, count(*) AS inside FROM ({Q._cull_sql(Q.BRICK, 'gas', '2 * h')})",
)


def _light(s: SparkSession, d: str) -> DataFrame:
    return ST.population(ST.valid(T.stars(s, d), Q.A_NOW), Q.LATTICE, Q.A_NOW)


def _star_totals(s: SparkSession, d: str) -> DataFrame:
    return ST.totals(_light(s, d), ["L_g", "L_r"]).select("n", *((F.col(b) / S.lit(1e6)).alias(b) for b in ("L_g", "L_r")))


Q.register(
    "total_luminosity",
    lambda s, d: Q.rounded(_star_totals(s, d), 2),
    f"WITH {Q._VALID}, {Q._lattice_sql()} SELECT count(*) AS n, round(sum(L_g) / 1e6, 2) + 0 AS L_g, round(sum(L_r) / 1e6, 2) + 0 AS L_r FROM shining",
)
_CUBE = (7, 11, 13)
Q.register(
    "cell_index",
    lambda s, d: T.read(s, d, "part").select("p_partkey", S.cell_index(F.col("p_partkey") % 7, F.col("p_partkey") % 11, F.col("p_partkey") % 13, _CUBE).alias("i")),
    "SELECT p_partkey, ((p_partkey % 13) * 11 + p_partkey % 11) * 7 + p_partkey % 7 AS i FROM part",
)
Q.register(
    "scale_bars",
    lambda s, d: Q.rounded(T.read(s, d, "part").select(F.col("p_partkey").cast("long").alias("id")).where("id > 0").select("id", S.scale_bar(F.lit(1920), F.lit(1080), F.col("id") * S.lit(3.7)).alias("bar"))),
    "SELECT i AS id, round(CASE WHEN x >= 5 * p THEN 5 * p WHEN x >= 2 * p THEN 2 * p ELSE p END, 6) + 0 AS bar FROM (SELECT i, x, pow(10::DOUBLE, floor(log10(x))) AS p FROM (SELECT i, i * 3.7::DOUBLE * 1920 / 1080 * 0.25::DOUBLE AS x FROM (SELECT p_partkey::BIGINT AS i FROM part WHERE p_partkey > 0)))",
)


# ---- smoothing lengths from neighbours, and maps with them -------------------------------------------------------------
def _knn_sql(k: int, source: str, h_max: float | None = None, h_min: float = 0.0, agree: str = "") -> str:
    """`near`: the rows of source with h by brute force, every pair tried."""
    r2 = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2"
    h = f"coalesce(sqrt(r2), {P.LONELY!r}::DOUBLE)"
    h = h if h_max is None else f"least({h}, {h_max!r}::DOUBLE)"
    return f"""pairs AS (SELECT a.pid, {r2} AS r2, row_number() OVER (PARTITION BY a.pid ORDER BY {r2}) AS k
  FROM {source} a JOIN {source} b ON a.pid <> b.pid {agree}),
near AS (SELECT p.*, greatest({h}, {h_min!r}::DOUBLE) AS h FROM {source} p LEFT JOIN pairs ON p.pid = pairs.pid AND pairs.k = {k})"""


def _dark(s: SparkSession, d: str) -> DataFrame:
    return P.cull(T.dm(s, d).drop("h"), Q._DM_BALL, T.BOX)


def _stars(s: SparkSession, d: str) -> DataFrame:
    wide = T.stars(s, d).withColumn("mass", F.col("m_init") * S.lit(1e6))
    return P.cull(wide, _STAR_BALL, T.BOX)


_STAR_BALL = type(Q.BALL)((250.0, 500.0, 500.0), (0.0, 0.0, 0.0), radius=300.0)
_DARK_SQL = f"{Q.DM_SQL}, p AS (SELECT * EXCLUDE (h) FROM ({Q._cull_sql(Q._DM_BALL, 'dm', '0::DOUBLE')}))"
_STARRY_SQL = f"{Q.STARS_SQL}, heavy AS (SELECT *, m_init * 1e6::DOUBLE AS mass FROM stars), p AS ({Q._cull_sql(_STAR_BALL, 'heavy', '0::DOUBLE')})"


def _near_column(read, k: int, name: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        df = read(s, d)
        df = df.join(P.neighbour_h(df, k), "pid")
        return Q.rounded(PR.columns(PR.hits(df, Q.ORTHO), {name: S.lit(1)}))

    return query


def _near_column_sql(lead: str, k: int, name: str) -> str:
    seen = "seen AS (SELECT * FROM near)"
    return f"""WITH {lead}, {_knn_sql(k, 'p')}, {seen}, {Q._camera_sql(Q.ORTHO)}, {Q.HITS_SQL}, {Q._table_sql(True)}, {Q.COLUMN_SQL}
SELECT py, px, round(sum(k), 6) + 0 AS {name} FROM k GROUP BY py, px"""


Q.register("dm_column_knn", _near_column(_dark, 8, "dm_column_density"), _near_column_sql(_DARK_SQL, 8, "dm_column_density"))
Q.register("star_column_knn", _near_column(_stars, 4, "star_column_density"), _near_column_sql(_STARRY_SQL, 4, "star_column_density"))
Q.register("knn_hsml", lambda s, d: Q.rounded(P.neighbour_h(_dark(s, d), 8, h_max=60.0, h_min=1.0)), f"WITH {_DARK_SQL}, {_knn_sql(8, 'p', 60.0, 1.0)} SELECT pid, {Q.sql_round('h')} FROM near")
Q.register(
    "knn_hsml_by_subfile",
    lambda s, d: Q.rounded(P.neighbour_h(_dark(s, d).withColumn("subfile", F.col("pid") % 2), 4, within="subfile")),
    f"WITH {_DARK_SQL}, {_knn_sql(4, 'p', agree='AND a.pid % 2 = b.pid % 2')} SELECT pid, {Q.sql_round('h')} FROM near",
)
Q.register(
    "knn_statistics",
    lambda s, d: Q.rounded(P.h_statistics(P.neighbour_h(_dark(s, d), 8))),
    f"WITH {_DARK_SQL}, {_knn_sql(8, 'p')} SELECT round(min(h), 6) + 0 AS h_min, round(max(h), 6) + 0 AS h_max, round(avg(h), 6) + 0 AS h_mean FROM near",
)

# ---- whole images and maps by request ----------------------------------------------------------------------------------
_SEEN = f"{Q.GAS_SQL}, seen AS ({Q._cull_sql(Q.BALL, 'gas', '2 * h')})"


def _found(s: SparkSession, d: str, camera) -> DataFrame:
    return PR.hits(P.cull(T.gas(s, d), Q.BALL, T.BOX, 2 * F.col("h")), camera)


def _dense_emission(s: SparkSession, d: str) -> DataFrame:
    e, a = PR.KAPPA["gas_density"]
    lit = PR.emission(_found(s, d, Q.SLAB), F.col("density") * S.lit(1e-4), e, a, T.GAS_KEY)
    return Q.rounded(PR.dense(s, Q.SLAB, lit, {"transmittance": 1.0}))


Q.register(
    "dense_columns",
    lambda s, d: Q.rounded(PR.dense(s, Q.ORTHO, PR.columns(_found(s, d, Q.ORTHO), {"gas_density": S.lit(1)}))),
    f"WITH {_SEEN}, {Q._camera_sql(Q.ORTHO)}, {Q.HITS_SQL}, {Q._table_sql(True)}, {Q.COLUMN_SQL}, o AS (SELECT py, px, sum(k) AS v FROM k GROUP BY py, px) SELECT py, px, round(coalesce(v, 0), 6) + 0 AS gas_density FROM pix LEFT JOIN o USING (py, px)",
)
_LIT = Q.SQL["emission_gas_density"]
Q.register(
    "dense_emission",
    _dense_emission,
    f"WITH shown AS ({_LIT}) SELECT (i // {Q.SLAB.width})::INTEGER AS py, (i % {Q.SLAB.width})::INTEGER AS px, coalesce(emission, 0) AS emission, coalesce(transmittance, 1) AS transmittance FROM range({Q.SLAB.width * Q.SLAB.height}) t(i) LEFT JOIN shown ON shown.py = i // {Q.SLAB.width} AND shown.px = i % {Q.SLAB.width}",
)
_ASKED = ["gas_density", "metal_column", "velocity_column", "hii_column", "warm_col", "temperature", "metallicity_dw", "los_velocity", "gas_velocity"]


def _asked_sql() -> str:
    f = [f"({x!r}::DOUBLE)" for x in Q.SLAB.basis()[2]]
    sums = {"gas_column_density": "1", "metal_column_density": "metallicity", "gas_speed_column": Q.SUMS["speed"], "hii_column_density": Q.SUMS["hii"], "gas_warm_column": Q.SUMS["warm"]}
    means = {"gas_temperature_mw": ("temperature", "1"), "gas_metallicity_dw": ("metallicity", "density"), "gas_vlos_mw": (f"(vx * {f[0]} + vy * {f[1]} + vz * {f[2]})", "1")}
    means |= {f"gas_v{a}_mw": (f"v{a}", "1") for a in "xyz"}
    body = [f"sum(k * {e}) AS {n}" for n, e in sums.items()] + [f"coalesce(sum(k * {w} * {v}) / nullif(sum(k * {w}), 0), 0) AS {n}" for n, (v, w) in means.items()]
    return f"WITH {_SEEN}, {Q._camera_sql(Q.SLAB)}, {Q.HITS_SQL}, {Q._table_sql(True)}, {Q.COLUMN_SQL}, o AS (SELECT py, px, {', '.join(body)} FROM k GROUP BY py, px) SELECT py, px, {Q.sql_round(' '.join([*sums, *means]), 5)} FROM o"


Q.register("requested_maps", lambda s, d: Q.rounded(RQ.particle_maps(_found(s, d, Q.SLAB), Q.SLAB, _ASKED), 5), _asked_sql())


def _requested_grid(s: SparkSession, d: str) -> DataFrame:
    cube = P.intensive(P.deposit(T.gas(s, d), Q.GRID, T.BOX, P.gas_fields()))
    asked = [Projection("gas_density", "column"), Projection("temperature", "mass_weighted"), Projection("vx", "los_velocity")]
    got = RQ.grid_maps(s, cube, Q.GRID, Q.SLAB, asked)
    return Q.rounded(got.select("py", "px", F.col("gas_density_column").alias("col"), F.col("temperature_mass_weighted").alias("temperature"), F.col("vx_los_velocity").alias("vlos")), 5)


Q.register("requested_grid_maps", _requested_grid, f"SELECT py, px, col, coalesce(temperature, 0) AS temperature, coalesce(vlos, 0) AS vlos FROM ({Q.SQL['grid_maps_perspective']})")
