import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query against its SQL on the smallest tables."""

    def check(query, sql):
        df = query(spark, SF)
        names = sorted(df.columns)
        cur = duck.execute(sql)
        at = [[d[0] for d in cur.description].index(n) for n in names]
        want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
        got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
        assert got == want

    return check
