"""Embedded databases on several executors, each of which is a process of its own."""

from __future__ import annotations

import os
import subprocess
import sys

from tidemark.sources import stores

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys, pyspark
from pyspark.sql import SparkSession
import __spark_entry__ as E
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "512m")
    .config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.driver.host", "127.0.0.1").getOrCreate())
sf = "/root/testdata/sf0.001"
want = spark.read.parquet(sf + "/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
got = E.queries()["jdbc_round_trip"](spark, sf)
assert got.schema.simpleString() == want.schema.simpleString(), got.schema
assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 25
print("same")
"""


def test_round_trip_on_two_executors(tmp_path):
    home = tmp_path / "home"  # the executors' logs go to work in Spark's home
    (home / "work").mkdir(parents=True)
    import pyspark

    for name in os.listdir(pyspark.__path__[0]):
        if name != "work":
            (home / name).symlink_to(f"{pyspark.__path__[0]}/{name}")
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")} | {"PYTHONPATH": ROOT, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "same" in done.stdout, done.stderr[-3000:]


def test_all_rows_in_ranges_nulls_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "BATCH", 7)
    rows = spark.sql("SELECT CASE WHEN id % 10 > 0 THEN id - 20 END AS k, CASE WHEN id % 3 > 0 THEN concat('é', id) END AS s, id / 8D AS x, date_add(date '1969-12-25', cast(id AS int)) AS d FROM range(0, 100, 1, 5)")
    a, b = (f"jdbc:derby:{tmp_path}/{x};create=true" for x in "ab")
    stores.write_table(rows, a, "t", createTableColumnTypes="s VARCHAR(64)")
    stores.copy_table(spark, a, b, "t", key='"k"', parts=4, low=0, high=30)
    stores.write_table(rows.where("k < 0"), b, "t")
    got = stores.read_table(spark, b, "t")
    for url in (a, b):
        stores.closed(spark, url)
    key = lambda r: tuple(map(str, r))
    assert sorted(got.collect(), key=key) == sorted(rows.union(rows.where("k < 0")).collect(), key=key)


def test_bounds_that_hold_no_rows(spark):
    assert stores._ranges(None, 3, 0, 9) == stores._ranges("k", 1, 0, 9) == ["1 = 1"]
    assert stores._ranges("k", 3, 5, 5) == ["k < 5 OR k IS NULL", "k >= 5"]
