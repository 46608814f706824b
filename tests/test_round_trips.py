"""Reading back what was written: pushed filters, pruned columns."""

from __future__ import annotations

from panelforge.plans import round_trips
from panelforge.sources import ingest


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = round_trips.src_round_trip(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(revenue,1000000.0)" in plan and "ReadSchema: struct<entity_id:bigint,sector:string,revenue:double,is_benchmark:boolean,caveat:string>" in plan


def test_first_reported_tag(spark):
    values = spark.createDataFrame([(1, "b", 2.0), (1, "a", None), (1, "c", 3.0), (2, "c", 5.0), (3, "d", 1.0)], "k int, tag string, value double")
    got = {r["k"]: r["v"] for r in ingest.first_reported(values, "k", ["a", "b", "c"], "v").collect()}
    assert got == {1: 2.0, 2: 5.0, 3: None}


def test_comment_rows_are_left_out(spark, sf_dir):
    out = round_trips.src_comment_rows(spark, sf_dir)
    assert out.where("c_custkey is null or c_mktsegment is null").count() == 0 and out.count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
