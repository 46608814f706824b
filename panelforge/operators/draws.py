"""Bootstrap replicates as vectors: a row carries its number of draws in all replicates, so rows are ordered once and not once a replicate.

The draws of the rows of each distinct value are added up, dealt by ranges of values and counted up within a range; the ranges' totals, one vector each, give
the offsets. So the weighted ranks of all replicates take one range shuffle of rows, whatever the number of replicates, and no task sees a whole replicate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.skew import join_counted
from panelforge.functions.tables import settled
from panelforge.functions.uniforms import uniforms

#: Cells (values x replicates) of a range, about, and of what a task holds before it passes it on.
RANGE_CELLS = 4_000_000
HELD_CELLS = 4_000_000


#: Cells (rows x replicates) that are drawn at once.
DRAWN_CELLS = 1_000_000


def drawn(seed: int, replicates: range, ids: list[str], most: int = 8) -> np.ndarray:
    """Keys x replicates: how often each is drawn, as ``resampling.poisson_weight`` counts it."""
    limits, total, p = [], 0.0, 2.718281828459045**-1
    for k in range(most):
        total += p
        limits.append(total)
        p /= k + 1
    return np.searchsorted(limits, uniforms(seed, replicates, ids), side="right")


def with_draws(rows: DataFrame, replicates: tuple[int, int], seed: int, key: str = "entity_id") -> DataFrame:
    """rows with ``draws``: how often each is drawn in every replicate from first to last (Poisson bootstrap)."""
    numbers = range(replicates[0], replicates[1] + 1)
    names = [*rows.columns, "draws"]

    def of(batches):
        step = max(1, DRAWN_CELLS // len(numbers))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                b = batch.slice(lo, step)
                d = drawn(seed, numbers, b.column("_id").to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists(d.astype(np.int32))], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("_id", F.coalesce(F.col(key).cast("string"), F.lit(""))).mapInArrow(of, f"{fields}, draws array<int>")


def vectors(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _by_value(part: np.ndarray, v: np.ndarray, d: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of the same part and value added up, in order."""
    order = np.lexsort((v, part))
    part, v = part[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (part[1:] != part[:-1])]))
    return part[first], v[first], np.add.reduceat(d[order], first, axis=0), np.add.reduceat(n[order], first)


def _summed(batches):
    """Rows (part, value, draws, n) in; one for each part and value of some batches out."""
    parts, values, draws, counts, cells = [], [], [], [], 0

    def out():
        part, v, d, n = _by_value(*map(np.concatenate, (parts, values, draws, counts)))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(v), lists(d), pa.array(n)], ["part", "value", "draws", "n"])

    for b in batches:
        if b.num_rows:
            parts.append(b.column("part").to_numpy(zero_copy_only=False))
            values.append(b.column("value").to_numpy(zero_copy_only=False))
            draws.append(vectors(b.column("draws"), np.int64))
            counts.append(b.column("n").to_numpy(zero_copy_only=False))
            cells += draws[-1].size
        if cells > HELD_CELLS:
            yield from out()
            parts, values, draws, counts, cells = [], [], [], [], 0
    if cells:
        yield from out()


def _totals(batches):
    """The sum of the draws of each range in a task, as rows (_range, replicate, total)."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        own, d = b.column("_range").to_numpy(), vectors(b.column("draws"), np.int64)
        for r in np.unique(own).tolist():
            sums[r] = sums.get(r, 0) + d[own == r].sum(0)
    for r, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), r, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], ["_range", "replicate", "total"])


def _counted(values: pa.Table, offsets: pa.Table) -> pa.Table:
    """For the parts and values of a range, the draws of smaller ones and their own, and how many rows have them."""
    columns = [values.column(c).to_numpy() for c in ("part", "value")]
    # Parts of a value that several tasks have summed meet here.
    part, v, d, n = _by_value(*columns, vectors(values.column("draws"), np.int64), values.column("n").to_numpy())
    below = np.cumsum(d, axis=0) - d + vectors(offsets.column("offset"), np.int64)
    return pa.table({"part": pa.array(part), "value": pa.array(v), "below": lists(below), "own": lists(d), "n": pa.array(n)})


def value_counts(drawn: DataFrame, value: str, part: str | None = None) -> DataFrame:
    """(part, value, below, own, n), settled: for each distinct non-null value the draws of all smaller ones and of itself in every replicate, and its rows.

    With ``part``, an int column, values are ordered by (part, value), so what smaller parts hold counts as below; without it, part is 0."""
    by = F.lit(0) if part is None else F.col(part)
    rows = drawn.where(F.col(value).isNotNull()).select(
        by.cast("int").alias("part"), F.col(value).cast("double").alias("value"), F.col("draws").cast("array<bigint>").alias("draws"), F.lit(1).cast("bigint").alias("n")
    )
    sums = settled(rows.mapInArrow(_summed, "part int, value double, draws array<bigint>, n bigint"), "sums")
    cells = sums.agg(F.sum(F.size("draws"))).head()[0] or 0
    ranges = max(int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells // RANGE_CELLS))
    ranged = settled(sums.repartitionByRange(ranges, "part", "value").withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.select("_range", "draws").mapInArrow(_totals, "_range int, replicate int, total bigint").groupBy("_range", "replicate").agg(F.sum("total").alias("total"))
    before = F.sum("total").over(Window.partitionBy("replicate").orderBy("_range")) - F.col("total")
    offsets = totals.select("_range", F.struct("replicate", before.alias("offset")).alias("o")).groupBy("_range").agg(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["offset"]).alias("offset"))
    both = ranged.groupBy("_range").cogroup(offsets.groupBy("_range"))
    return settled(both.applyInArrow(_counted, "part int, value double, below array<bigint>, own array<bigint>, n bigint"), "counts")


def average_ranks() -> Column:
    """Average ranks from the columns of ``value_counts``."""
    return F.zip_with("below", "own", lambda b, o: b + (o + 1) / 2)


def with_ranks(drawn: DataFrame, value: str, out: str) -> DataFrame:
    """drawn with ``out``, the average ranks of its value in every replicate; rows without a value are left out. A value that many rows share is broadcast."""
    ranks = value_counts(drawn, value).select(F.col("value").alias("_value"), average_ranks().alias(out), F.col("n").alias("_n"))
    total = ranks.agg(F.sum("_n")).head()[0] or 0
    return join_counted(drawn.withColumn("_value", F.col(value).cast("double")), ranks, ["_value"], "_n", total).drop("_value", "_n")


def _moments(batches):
    """Rows (draws, rx, ry) in; sums over the task's rows as rows (replicate, n, sx, sy, sxx, syy, sxy)."""
    sums = None
    for b in batches:
        if b.num_rows:
            m, x, y = (vectors(b.column(c), float) for c in ("draws", "rx", "ry"))
            own = np.stack([m.sum(0), (m * x).sum(0), (m * y).sum(0), (m * x * x).sum(0), (m * y * y).sum(0), (m * x * y).sum(0)])
            sums = own if sums is None else sums + own
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.shape[1], dtype=np.int32)), *map(pa.array, sums)], ["replicate", "n", "sx", "sy", "sxx", "syy", "sxy"])


def rank_correlations(rows: DataFrame, replicates: tuple[int, int], seed: int, key: str = "entity_id") -> DataFrame:
    """(replicate, rho, n): rank correlation of x and y in every bootstrap replicate of rows (key, x, y), rows with both only."""
    drawn = settled(with_draws(rows.where("x is not null and y is not null"), replicates, seed, key), "drawn")
    ranked = with_ranks(with_ranks(drawn, "x", "rx"), "y", "ry")
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    s = ranked.select("draws", "rx", "ry").mapInArrow(_moments, f"replicate int, {', '.join(f'{c} double' for c in names)}").groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names])
    n, c = F.col("n"), F.col
    top = n * c("sxy") - c("sx") * c("sy")
    spread = (n * c("sxx") - c("sx") * c("sx")) * (n * c("syy") - c("sy") * c("sy"))
    return s.select((c("replicate") + replicates[0]).alias("replicate"), F.when(spread > 0, top / F.sqrt(spread)).alias("rho"), n.cast("bigint").alias("n"))
