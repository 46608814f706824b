"""Registered queries: tables written to the shared folder and read back, comment rows in CSV, fallbacks among tags."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelforge.functions.tables import shared_folder
from panelforge.plans.clean import rounded
from panelforge.plans.series_and_weights import SRC_FACTS, src_facts
from panelforge.sources import ingest as N
from panelforge.sources.panels import PANEL_SQL, entity_panel, table

CAVEAT = "made for tests"
#: Priority of order tags; ``T9`` is reported by nobody.
TAGS = ["T9", "T3", "T1", "T5"]


def _new(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def src_round_trip(spark, sf_dir):
    """The panel with a membership flag (some null) as a table with a caveat, read back from the first path that exists: no benchmark members, one range."""
    path = _new(spark, "panel")
    flag = F.when(F.col("entity_id") % 4 == 0, True).when(F.col("entity_id") % 4 != 1, False)
    N.write_table(entity_panel(spark, sf_dir).withColumn("is_benchmark", flag), path, CAVEAT)
    back = N.without_flagged(N.first_existing(spark, [f"{path}-absent", path]), "is_benchmark").where("revenue > 1000000")
    return rounded(back.select("entity_id", "sector", "revenue", "caveat"), 3)


SRC_ROUND_TRIP = f"WITH {PANEL_SQL} SELECT entity_id, sector, round(revenue, 3) AS revenue, '{CAVEAT}' AS caveat FROM panel WHERE entity_id % 4 <> 0 AND revenue > 1000000"


def src_comment_rows(spark, sf_dir):
    """Customers as lines of CSV, every tenth after a comment line; the scan leaves the comments out."""
    path = f"{_new(spark, 'lines')}.csv"
    c = table(spark, sf_dir, "customer")
    line = F.concat_ws(",", "c_custkey", "c_mktsegment", F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    lines = F.when(F.col("c_custkey") % 10 == 0, F.array(F.concat(F.lit("# before "), F.col("c_custkey").cast("string")), line)).otherwise(F.array(line))
    c.select(F.explode(lines).alias("value")).write.text(path)
    return rounded(N.first_existing(spark, [path], header=False, schema="c_custkey bigint, c_mktsegment string, c_acctbal double"), 2)


SRC_COMMENT_ROWS = "SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer"


def src_fallback_tags(spark, sf_dir):
    """The first reported of several tags, from each customer's latest values."""
    return N.first_reported(src_facts(spark, sf_dir), "o_custkey", TAGS, "value")


SRC_FALLBACK_TAGS = f"""SELECT o_custkey, coalesce({", ".join(f"max(value) FILTER (tag = '{t}')" for t in TAGS)}) AS value FROM ({SRC_FACTS}) GROUP BY o_custkey"""

QUERIES = {
    "src_round_trip": (src_round_trip, SRC_ROUND_TRIP),
    "src_comment_rows": (src_comment_rows, SRC_COMMENT_ROWS),
    "src_fallback_tags": (src_fallback_tags, SRC_FALLBACK_TAGS),
}
