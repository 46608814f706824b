"""Connected components of an edge table by hooking and shortcutting, with lineage cut every round.

Labels are the smallest node of what has been joined so far. In each round an edge carries the grandparent of
one end to the other end and to its parent, and every node takes the smallest it is offered; the rounds needed
grow with the logarithm of a component's width. Nothing is collected but one count a round.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import settled

#: Edges (both ways) up to which labels are broadcast and tables are single files, so that a round costs few tasks.
SMALL = 200_000


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node that links reach. Null ends and loops are left out.

    With ``rounds`` only so many are done: nodes with one label are connected, but a wide component can have several labels."""
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = settled(edges.union(edges.select("b", "a")).distinct(), "edges")
    small = both.count() <= SMALL
    carried = F.broadcast if small else lambda df: df
    kept = lambda df, name: settled(df.coalesce(1) if small else df, name)
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for done in itertools.count(1):
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        ranked = kept(labels.join(carried(above), "label").select("node", "label", "top"), "ranked")
        left = ranked.select(F.col("node").alias("a"), F.col("label").alias("parent"))
        right = ranked.select(F.col("node").alias("b"), "top")
        offers = both.join(carried(right), "b").join(carried(left), "a")
        offered = (
            offers.select(F.explode(F.array("a", "parent")).alias("node"), F.col("top").alias("label"))
            .union(ranked.select("node", F.col("top").alias("label")))
            .groupBy("node").agg(F.min("label").alias("label"))
        )
        new = kept(offered, "labels")
        if done == rounds:
            return new.withColumnRenamed("label", "component")
        if rounds is not None:
            labels = new
            continue
        changed = new.join(carried(labels.withColumnRenamed("label", "old")), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels.withColumnRenamed("label", "component")
