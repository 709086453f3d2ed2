"""Rounding against Python's round(), which rounds the exact binary value, halves to even."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions.numbers import half_even, half_even_sql


@pytest.mark.parametrize("places", [0, 1, 3, 4])
def test_half_even(spark, places):
    rng = random.Random(places)
    values = [0.5075, 0.0005, 2.5, 0.125, 1.0005, -0.5, 0.0, 1e15, -2.675, *[k / 2000 for k in range(-3001, 6001, 2)], *[rng.uniform(-9, 9) for _ in range(3000)], *[rng.randrange(10**6) / 16 for _ in range(500)]]
    got = [r.y for r in spark.createDataFrame([(v,) for v in values], "x double").select(half_even(F.col("x"), places).alias("y")).collect()]
    assert got == [round(v, places) for v in values]
    assert [duckdb.execute(f"SELECT {half_even_sql('x', places)} FROM (SELECT ?::DOUBLE AS x)", [v]).fetchone()[0] for v in values[:1500]] == got[:1500]


def test_half_even_odd_values(spark):
    rows = spark.createDataFrame([(None,), (float("inf"),), (1e300,)], "x double").select(half_even(F.col("x"), 2).alias("y")).collect()
    assert [r.y for r in rows] == [None, float("inf"), 1e300]
