"""Rounding of numbers halfway against SQL's."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import functions as F

from panelforge.functions.expressions import rounded_halves


def test_halves_are_rounded_as_sql_does(spark):
    values = [s * math.nextafter((k + 0.5) / 1e6, side) for k in range(2_034_000_000, 2_034_001_000) for s in (1.0, -1.0) for side in (0.0, 1e9)]
    sql = [r[0] for r in duckdb.sql(f"SELECT ROUND(unnest({values!r}::DOUBLE[]), 6)").fetchall()]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    rows = df.select(rounded_halves(F.col("v"), 6), F.round("v", 6)).collect()
    assert [r[0] for r in rows] == sql
    assert [r[1] for r in rows] != sql
