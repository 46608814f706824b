"""The entity panel, price history and other frames that operators work on, from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.expressions import ratio, rounded_halves

#: Indicators of the panel; momentum, unit_price, balance_ratio and late_share have nulls.
INDICATORS = ["acctbal", "n_orders", "revenue", "mean_order", "quantity", "mean_discount", "return_rate", "urgent_share", "unit_price", "balance_ratio", "momentum"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where a row stands in its table: sums of doubles depend on their order, and those that lie halfway at the last digit on their last bit.
PLACE = ("_file", "_row")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table with the PLACE of its rows; that of a single file needs no name."""
    rows = table(spark, sf_dir, name)
    file = F.col("_metadata.file_name") if len(rows.inputFiles()) > 1 else F.lit(0)
    return rows.select("*", file.alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def sums_in_order(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, values, n): sums of values and the number of rows of each group, added up row by row in the order of PLACE, whatever shuffle brought the rows.

    Rows of a group lie in one task, sorted, and are added up there as they come, so a group of any size is streamed."""
    rows = df.select(*keys, *PLACE, *[v.alias(k) for k, v in values.items()])
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *PLACE)
    return ordered.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in values], F.count(F.lit(1)).alias("n"))


def entity_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer: entity_id, sector, country and INDICATORS, rounded to 6 digits."""
    orders, lines = table(spark, sf_dir, "orders"), placed(spark, sf_dir, "lineitem")
    customers, nations, regions = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    last = orders.agg(F.max("o_orderdate").alias("last"))
    age = F.datediff("last", "o_orderdate")
    per_order = orders.crossJoin(F.broadcast(last)).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("o_totalprice").alias("revenue"),
        F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent_share"),
        F.sum(F.when(age < 365, F.col("o_totalprice"))).alias("recent"),
        F.sum(F.when((age >= 365) & (age < 730), F.col("o_totalprice"))).alias("before"),
    )
    sold = lines.join(orders.select("o_orderkey", "o_custkey"), lines["l_orderkey"] == orders["o_orderkey"])
    summed = {"quantity": F.col("l_quantity"), "discounts": F.col("l_discount"), "discounted": F.col("l_discount").isNotNull().cast("int"), "returned": F.coalesce((F.col("l_returnflag") == "R").cast("int"), F.lit(0)), "value": F.col("l_extendedprice")}
    sold = sums_in_order(sold, ["o_custkey"], summed).select("o_custkey", "quantity", ratio(F.col("discounts"), F.col("discounted")).alias("mean_discount"), (F.col("returned") / F.col("n")).alias("return_rate"), "value")
    places = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select("n_nationkey", F.col("r_name").alias("country"))
    joined = customers.join(places, customers["c_nationkey"] == places["n_nationkey"], "left").join(per_order, customers["c_custkey"] == per_order["o_custkey"], "left").drop("o_custkey")
    joined = joined.join(sold, customers["c_custkey"] == sold["o_custkey"], "left")
    positive = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    values = {
        "acctbal": F.col("c_acctbal"), "n_orders": F.coalesce("n_orders", F.lit(0)).cast("double"), "revenue": F.col("revenue"), "mean_order": ratio(F.col("revenue"), F.col("n_orders")), "quantity": F.col("quantity"),
        "mean_discount": F.col("mean_discount"), "return_rate": F.col("return_rate"), "urgent_share": F.col("urgent_share"), "unit_price": ratio(F.col("value"), F.col("quantity")),
        "balance_ratio": F.col("revenue") / positive, "momentum": ratio(F.col("recent"), F.col("before")) - 1,
    }
    return joined.select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("sector"), "country", *[rounded_halves(v, 6).alias(k) for k, v in values.items()])


#: The same frame for an ANSI engine.
PANEL_SQL = """
panel AS (
  SELECT c_custkey AS entity_id, c_mktsegment AS sector, r_name AS country, ROUND(c_acctbal, 6) AS acctbal, coalesce(n_orders, 0)::DOUBLE AS n_orders, ROUND(revenue, 6) AS revenue,
    ROUND(revenue / nullif(n_orders, 0), 6) AS mean_order, ROUND(quantity, 6) AS quantity, ROUND(mean_discount, 6) AS mean_discount, ROUND(return_rate, 6) AS return_rate, ROUND(urgent_share, 6) AS urgent_share,
    ROUND(value / nullif(quantity, 0), 6) AS unit_price, ROUND(revenue / CASE WHEN c_acctbal > 0 THEN c_acctbal END, 6) AS balance_ratio, ROUND(recent / nullif(before, 0) - 1, 6) AS momentum
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (
    SELECT o_custkey AS ok, count(*) AS n_orders, sum(o_totalprice) AS revenue, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent_share,
      sum(CASE WHEN date_diff('day', o_orderdate::DATE, last::DATE) < 365 THEN o_totalprice END) AS recent,
      sum(CASE WHEN date_diff('day', o_orderdate::DATE, last::DATE) >= 365 AND date_diff('day', o_orderdate::DATE, last::DATE) < 730 THEN o_totalprice END) AS before
    FROM orders, (SELECT max(o_orderdate) AS last FROM orders) GROUP BY o_custkey) ON ok = c_custkey
  LEFT JOIN (
    SELECT o_custkey AS lk, sum(l_quantity) AS quantity, avg(l_discount) AS mean_discount, avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS return_rate, sum(l_extendedprice) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) ON lk = c_custkey
)"""


def long_sql(columns: list[str], frame: str = "panel", keep: str = "entity_id, sector, country") -> str:
    """A CTE body that turns columns of a frame into rows (keep, indicator, value), nulls left in."""
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS indicator, {c} AS value FROM {frame}" for c in columns)


def long_panel(panel: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(entity_id, sector, country, indicator, value), nulls left in."""
    return panel.unpivot(["entity_id", "sector", "country"], columns or INDICATORS, "indicator", "value")


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, day, close, volume): a part brand's mean unit price and quantity on each day."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    daily = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy(F.col("p_brand").alias("entity"), F.to_date("l_shipdate").alias("day"))
    out = daily.agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("volume"))
    return out.select("entity", "day", rounded_halves(F.col("v") / F.col("volume"), 6).alias("close"), rounded_halves(F.col("volume"), 6).alias("volume"))


PRICES_SQL = """
prices AS (
  SELECT p_brand AS entity, l_shipdate::DATE AS day, ROUND(sum(l_extendedprice) / sum(l_quantity), 6) AS close, ROUND(sum(l_quantity), 6) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
)"""
