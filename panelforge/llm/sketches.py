"""A sketch of how frequent hashed things are, of fixed size: every task counts into ``SKETCH`` counters, which add up.

The levels it gives order things from rare to frequent, the same for every task. Any order does for operators that pick the first few of a set
by it, so counters that several things share do no harm.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH = 1 << 16
_U = np.uint64


def place(h: np.ndarray) -> np.ndarray:
    """Counter of each 64-bit hash."""
    return ((h * _U(0xD6E8FEB86659FD93)) >> _U(48)).astype(np.int64) % SKETCH


def levels(counts: np.ndarray) -> np.ndarray:
    """Level of each counter: 0 up to five deviations above the median, then the logarithm of what is above."""
    usual = max(1.0, float(np.median(counts)))
    above = (counts - usual) / (5 * usual**0.5)
    return np.where(above <= 1, 0, 1 + np.log2(np.maximum(above, 1))).astype(np.uint8)


def as_row(counts: np.ndarray) -> np.ndarray:
    """A task's counters for a column of type array<int>."""
    return np.minimum(counts, 2**31 - 1).astype(np.int32)


def summed_levels(sketches: DataFrame) -> np.ndarray:
    """Levels from the sum of all tasks' counters, rows (sketch)."""
    summed = sketches.select(F.posexplode("sketch").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # SKETCH rows at most
    counts = np.zeros(SKETCH, np.int64)
    counts[summed.column("place").to_numpy()] = summed.column("n").to_numpy()
    return levels(counts)
