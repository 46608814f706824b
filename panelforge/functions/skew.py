"""Joins whose left keys may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows counts as frequent; there are fewer such keys than this.
FREQUENT = 10_000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """left joined with right, which has one row for each key with the number ``size`` of left rows that have it (``total`` in all).

    Frequent keys are broadcast, fewer than FREQUENT rows as their sizes add up to the total; the others are shuffled, no key then having more than 1 in FREQUENT rows."""
    frequent = F.col(size) * FREQUENT > total
    heavy = F.broadcast(right.where(frequent))
    light = left.join(heavy.select(*on), on, "left_anti").join(right.where(~frequent), on)
    return left.join(heavy, on).unionByName(light)
