"""Arithmetic whose last digit decides an order, against the same in SQL."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from memlake.functions import libm
from memlake.operators import timeline as tl

NOW = dt.datetime(2024, 1, 1)


def test_places_at_a_rounding_border(spark):
    rows = [("B", "E", 0.5347265625, NOW), ("A", "E", 0.534726562, NOW)]
    entries = spark.createDataFrame(rows, "role_id string, event_id string, forgetting_factor double, last_accessed_time timestamp_ntz")
    out = tl.capacity_silence(entries, F.lit(NOW).cast("timestamp_ntz"), F.lit(1.0)).collect()
    assert {r.role_id: r.place for r in out} == {"A": 1, "B": 2}


def test_numbers_equal_those_of_sql(spark):
    rows = [(i / 997,) for i in range(20_000)]
    x = F.col("x")
    df = spark.createDataFrame(rows, "x double").select(
        "x", libm.exp(-x).alias("e"), libm.power(x, F.lit(2.0)).alias("p"), libm.rounded(libm.exp(-x), 9).alias("r"))
    got = df.orderBy("x").collect()
    want = duckdb.sql("select x, exp(-x), pow(x, 2.0::double), round(exp(-x), 9) from (select i/997 as x from range(20000) t(i)) order by x").fetchall()
    assert [tuple(r) for r in got] == want
