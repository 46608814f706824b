"""Sums of doubles that lie halfway at the last digit come out as the SQL's, however a join deals the rows."""

from __future__ import annotations

import duckdb

from panelforge.sources.panels import PANEL_SQL, entity_panel


def test_halves_do_not_depend_on_shuffles(spark):
    """Of 15,000 customers some 170 mean discounts lie halfway at the sixth digit; joins are by shuffles, which deal lines out of their order."""
    folder, columns = "/root/testdata/sf0.1", "entity_id, mean_discount, unit_price, return_rate, quantity"
    db = duckdb.connect()
    db.execute("SET threads = 1")
    for name in ("customer", "nation", "region", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        db.register("got", entity_panel(spark, folder).select(*columns.split(", ")).toArrow())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert db.execute(f"WITH {PANEL_SQL} SELECT count(*) FROM (SELECT {columns} FROM panel EXCEPT ALL SELECT {columns} FROM got)").fetchall() == [(0,)]
