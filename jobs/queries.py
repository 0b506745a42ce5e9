"""The jobs as queries: each runs twice into one new shared folder, and what stands there after the second run is returned."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from fieldloom.plans import queries as Q
from fieldloom.plans.films import shared_folder

from . import catalogue_cubes, film

HERE = Path(__file__).parent


def config(name: str) -> dict:
    """The config file that comes with a job."""
    return json.loads((HERE / f"{name}.json").read_text())


def job1_catalogue_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings, out = config("catalogue_cubes"), shared_folder(spark, "job1")
    inputs = {name: f"{sf_dir}/{spec['table']}.parquet" for name, spec in settings["species"].items()}
    for _ in range(2):
        found = catalogue_cubes.run(spark, inputs, out, settings)
    return Q.rounded(found)


def job2_film(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "job2")
    for _ in range(2):
        found = film.run(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/nation.parquet", out, config("film"))
    return Q.rounded(found)


def _cubes_sql() -> str:
    settings, out = config("catalogue_cubes"), []
    for name, spec in settings["species"].items():
        rows = f"rows_ AS (SELECT {', '.join(f'{Q.duck(e)} AS {c}' for c, e in spec['columns'].items())} FROM {spec['table']})"
        for g in map(catalogue_cubes.grid, spec["grids"]):
            out.append(f"SELECT '{name}' AS species, '{g.name}' AS grid, ix, iy, iz, {Q.sql_round(' '.join(spec['sums']))} FROM (WITH {rows}, {Q._deposit_sql(g, 'rows_', spec['sums'])} SELECT * FROM cube)")
    return " UNION ALL ".join(out)


def _film_sql() -> str:
    c = config("film")
    low, high = c["range"]
    columns = lambda part: ", ".join(f"{Q.duck(e)} AS {n}" for n, e in c[part].items())
    region = film.Region(tuple(map(float, c["region"]["center"])), (0.0, 0.0, 0.0), float(c["region"]["radius"]))
    measures, n = c["measures"], "(SELECT max(cam_id) + 1 FROM c0)"
    tones, shown = [], []
    for m in measures:
        tones.append(f"""p_{m} AS (SELECT cam_id, quantile_cont({m}, {low}) AS lo, quantile_cont({m}, {high}) AS hi FROM maps WHERE {m} > 0 GROUP BY cam_id),
f_{m} AS (SELECT i AS frame, lo, hi FROM range({n}) t(i) LEFT JOIN p_{m} ON cam_id = i),
g_{m} AS (SELECT frame, {', '.join(f"coalesce({v}, {v}0 + ({v}1 - {v}0) * (frame - a0) / nullif(a1 - a0, 0)::DOUBLE, {v}0, {v}1) AS {v}" for v in ('lo', 'hi'))} FROM (SELECT *,
  last_value(lo IGNORE NULLS) OVER b AS lo0, last_value(hi IGNORE NULLS) OVER b AS hi0, last_value(CASE WHEN lo IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS a0,
  first_value(lo IGNORE NULLS) OVER a AS lo1, first_value(hi IGNORE NULLS) OVER a AS hi1, first_value(CASE WHEN lo IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS a1
  FROM f_{m} WINDOW b AS (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),
r_{m} AS (SELECT t.i AS cam_id, log10(avg(lo)) AS lo, log10(avg(hi)) AS hi FROM range({n}) t(i), range(-2, 3) o(k), g_{m} WHERE frame = greatest(0, least({n} - 1, t.i + k)) GROUP BY t.i)""")
        shown.append(f"round(CASE WHEN {m} > 0 THEN greatest(0, least(1, coalesce((log10({m}) - r_{m}.lo) / nullif(r_{m}.hi - r_{m}.lo, 0), 0))) ELSE 0 END, 6) + 0 AS {m}")
    joins = " ".join(f"JOIN r_{m} USING (cam_id)" for m in measures)
    return f"""WITH gas AS (SELECT {columns('particles')} FROM lineitem), seen AS ({Q._cull_sql(region, 'gas', '2 * h')}),
c0 AS (SELECT {columns('cameras')} FROM nation),
c1 AS (SELECT *, look_at_x - position_x AS wx, look_at_y - position_y AS wy, look_at_z - position_z AS wz, sqrt(wx * wx + wy * wy + wz * wz) AS w, wx / w AS fx, wy / w AS fy, wz / w AS fz,
  sqrt(fx * fx + fy * fy) AS g, fy / g AS rx, -fx / g AS ry, 0::DOUBLE AS rz, tan(radians(fov / 2)) AS hy, hy * width / height AS hx FROM c0),
c2 AS (SELECT *, ry * fz - rz * fy AS ux, rz * fx - rx * fz AS uy, rx * fy - ry * fx AS uz FROM c1),
aim AS (SELECT c2.*, py::INTEGER AS py, px::INTEGER AS px, (2 * (px + 0.5::DOUBLE) / width - 1) * hx AS ax, (1 - 2 * (py + 0.5::DOUBLE) / height) * hy AS ay FROM c2, range(8) a(py), range(12) b(px)),
rays0 AS (SELECT cam_id, py, px, position_x AS ox, position_y AS oy, position_z AS oz, rx * ax + ux * ay + fx AS vx_, ry * ax + uy * ay + fy AS vy_, rz * ax + uz * ay + fz AS vz_, sqrt(vx_ * vx_ + vy_ * vy_ + vz_ * vz_) AS len FROM aim),
rays AS (SELECT *, vx_ / len AS dx, vy_ / len AS dy, vz_ / len AS dz, 0::DOUBLE AS t0, 1e308::DOUBLE AS t1 FROM rays0), {Q.HITS_SQL}, {Q._table_sql(True)}, {Q.COLUMN_SQL},
maps AS (SELECT cam_id, py, px, {', '.join(f'sum(k * {Q.duck(e)}) AS {m}' for m, e in measures.items())} FROM k GROUP BY cam_id, py, px),
{', '.join(tones)}
SELECT cam_id, py, px, {', '.join(shown)} FROM maps {joins}"""


def queries() -> dict:
    return {f.__name__: f for f in (job1_catalogue_cubes, job2_film)}


def oracle_sql() -> dict[str, str]:
    return {"job1_catalogue_cubes": _cubes_sql(), "job2_film": _film_sql()}
