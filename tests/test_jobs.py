"""The jobs by runs over growing input, on copies, and from the command line."""

import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import catalogue_cubes, film
from jobs import queries as J

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(J.queries()))
def test_query_equals_sql(name, same):
    same(J.queries()[name], J.oracle_sql()[name])


def rows(df, digits=6):
    names = sorted(df.columns)
    return sorted((tuple(round(r[n], digits) if isinstance(r[n], float) else r[n] for n in names) for r in df.collect()), key=repr)


def settings(spark):
    return {name: spark.conf.get(name, None) for name in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions", "spark.sql.streaming.schemaInference")}


def test_cubes_of_growing_catalogues(spark, tmp_path, caplog):
    config, before = J.config("catalogue_cubes"), settings(spark)
    inputs = {"gas": str(tmp_path / "in/lineitem"), "texts": str(tmp_path / "in/documents")}
    tables = {name: spark.read.parquet(f"{SF}/{config['species'][name]['table']}.parquet").withColumn("__n", F.monotonically_increasing_id()) for name in inputs}
    caplog.set_level(logging.INFO)
    for part in range(3):
        for name, path in inputs.items():
            tables[name].where(f"__n % 3 = {part}").drop("__n").coalesce(1).write.mode("append").parquet(path)
        caplog.clear()
        got = catalogue_cubes.run(spark, inputs, str(tmp_path / "out"), config)
        for name, table in tables.items():  # only what is new was read
            assert f"{name}: read {table.where(f'__n % 3 = {part}').count()} new rows" in caplog.text
            want = catalogue_cubes.cells(table.where(f"__n % 3 <= {part}").selectExpr(*(f"{e} AS {c}" for c, e in config["species"][name]["columns"].items())), config["species"][name], config["box"])
            assert rows(got.where(F.col("species") == name).drop("species")) == rows(want)
    kept = rows(got)
    caplog.clear()
    assert rows(catalogue_cubes.run(spark, inputs, str(tmp_path / "out"), config)) == kept  # nothing new
    assert "read 0 new rows" in caplog.text and settings(spark) == before
    # A run that ended before it had written the cubes is mended by the next one; a species by itself leaves the others.
    one = {"gas": inputs["gas"]}
    spark.createDataFrame([("wide", 0, 0, 0, 1.0, 1.0, "gas")], "grid string, ix int, iy int, iz int, density double, weighted double, species string").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("species", "grid").parquet(str(tmp_path / "out/cubes"))
    assert rows(catalogue_cubes.run(spark, one, str(tmp_path / "out"), config)) == kept
    assert {p.name for p in (tmp_path / "out/parts/gas").iterdir()} == {"batch=0", "batch=1", "batch=2"}


def test_batch_that_runs_again_writes_over_itself(spark, tmp_path):
    """A checkpoint without its last commit, as a lost driver leaves it: the batch is taken again."""
    config = J.config("catalogue_cubes")
    source, out = tmp_path / "in", tmp_path / "out"
    spark.read.parquet(f"{SF}/lineitem.parquet").repartition(4).write.parquet(str(source))
    kept = rows(catalogue_cubes.run(spark, {"gas": str(source)}, str(out), {**config, "files_per_batch": 2}))
    commits = out / "checkpoints/gas/commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    assert last == 1
    for p in (commits / str(last), commits / f".{last}.crc"):
        p.unlink(missing_ok=True)
    assert rows(catalogue_cubes.run(spark, {"gas": str(source)}, str(out), {**config, "files_per_batch": 2})) == kept


def test_odd_rows_of_a_catalogue(spark, tmp_path):
    config = J.config("catalogue_cubes")
    odd = [(None, "x"), ("", "x"), ("a b\nc", None), ("y " * 50_000, "x"), ("a b\nc", "x"), ("word " * 20, "x"), ("word " * 20, "x")]
    spark.createDataFrame(odd, "text string, species string").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = catalogue_cubes.run(spark, {"texts": str(tmp_path / "in")}, str(tmp_path / "out"), config)
    assert got.count() > 0 and got.where("density is null").count() == 0
    empty = spark.createDataFrame([], "text string")
    empty.write.parquet(str(tmp_path / "none"))
    assert catalogue_cubes.run(spark, {"texts": str(tmp_path / "none")}, str(tmp_path / "out2"), config).count() == 0


def test_film_goes_on_where_it_was(spark, tmp_path, caplog):
    config, before = J.config("film"), settings(spark)
    particles, out = f"{SF}/lineitem.parquet", str(tmp_path / "film")
    nations = spark.read.parquet(f"{SF}/nation.parquet")
    caplog.set_level(logging.INFO)
    nations.where("n_nationkey < 10").coalesce(1).write.parquet(str(tmp_path / "nation"))
    film.run(spark, particles, str(tmp_path / "nation"), out, config)
    assert "10 of 10 frames" in caplog.text
    times = {p: p.stat().st_mtime_ns for p in Path(out, "maps").rglob("*.parquet")}
    nations.where("n_nationkey >= 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "nation"))
    caplog.clear()
    got = rows(film.run(spark, particles, str(tmp_path / "nation"), out, config))
    assert "15 of 25 frames" in caplog.text and "rendered 15 frames" in caplog.text
    assert all(p.stat().st_mtime_ns == t for p, t in times.items())  # frames that were there stayed
    caplog.clear()
    assert rows(film.run(spark, particles, str(tmp_path / "nation"), out, config)) == got
    assert "0 of 25 frames" in caplog.text
    assert rows(film.run(spark, particles, f"{SF}/nation.parquet", str(tmp_path / "at once"), config)) == got
    # A camera with other settings is rendered anew, the others are not.
    moved = {**config, "cameras": {**config["cameras"], "fov": "IF(n_nationkey = 3, 20.0D, CAST(60 - n_nationkey AS DOUBLE))"}}
    caplog.clear()
    again = film.run(spark, particles, str(tmp_path / "nation"), out, moved)
    assert "1 of 25 frames" in caplog.text and rows(again) != got and settings(spark) == before


def test_film_without_cameras(spark, tmp_path):
    spark.read.parquet(f"{SF}/nation.parquet").limit(0).write.parquet(str(tmp_path / "nation"))
    assert film.run(spark, f"{SF}/lineitem.parquet", str(tmp_path / "nation"), str(tmp_path / "out"), J.config("film")).count() == 0


def test_command_lines(spark, tmp_path):
    here = Path(__file__).resolve().parents[1]
    env = {**os.environ, "PYTHONPATH": str(here), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    small = J.config("catalogue_cubes")
    (tmp_path / "c.json").write_text(json.dumps(small))
    calls = [["jobs.catalogue_cubes", "--config", str(tmp_path / "c.json"), "--input", f"texts={SF}/documents.parquet", "--out", str(tmp_path / "cubes")], ["jobs.film", "--config", str(here / "jobs/film.json"), "--particles", f"{SF}/lineitem.parquet", "--cameras", f"{SF}/nation.parquet", "--out", str(tmp_path / "film")]]
    for call in calls:
        done = subprocess.run([sys.executable, "-m", *call], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-3000:]
        assert "read" in done.stderr and "wrote" in done.stderr
    assert spark.read.parquet(str(tmp_path / "cubes/cubes")).count() > 0 and spark.read.parquet(str(tmp_path / "film/images")).select("cam_id").distinct().count() == 25
