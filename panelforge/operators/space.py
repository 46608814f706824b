"""Exact search among vectors of few dimensions: cells of near points, and only those cells that can hold something better.

Cells are the leaves of median splits, which are planned on a bounded sample (it decides sizes of cells, never what is found); every vector lies in one cell and each cell has the box that its
vectors span. A vector is searched in its own cell first; what it finds there bounds the distance of its peers, and it is sent only to cells whose boxes are as near.
The work grows with rows * rows of a cell * cells visited, instead of the square of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.tables import settled

#: Dimensions up to which boxes part vectors well; rows of a cell on average; cells at most; rows of the sample that plans them, about.
NARROW, CELL, CELLS, SAMPLE = 6, 4096, 4096, 1 << 16
#: Vectors whose distances to all boxes are held at once.
STEP = 512
METRICS = ("cosine", "euclidean")


def embedded(v: np.ndarray, metric: str) -> np.ndarray:
    """Points whose distances order similarities: for cosines vectors of length 1, and one place away from all for vectors of length 0."""
    if metric == "euclidean" or not len(v):
        return v
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.hstack([np.divide(v, length, out=np.zeros_like(v), where=length > 0), (length == 0).astype(float)])


def reach(least: np.ndarray, metric: str) -> np.ndarray:
    """Squares of the distances within which similarities of ``least`` or more lie, rounding included."""
    s = least - 1e-9
    if metric == "cosine":
        return np.where(np.isfinite(s), 2 - 2 * s + 1e-9, np.inf)
    return np.where(s > 0, (np.divide(1, s, out=np.full(len(s), np.inf), where=s > 0) - 1) ** 2 * (1 + 1e-9), np.inf)


class Splits:
    """Median splits of a sample into about ``leaves`` cells; a tree in arrays."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.at, self.child, self.cells = [], [], [], 0
        self.root = self._split(sample, leaves)
        self.dim, self.at, self.child = np.array(self.dim, int), np.array(self.at, float), np.array(self.child, int).reshape(-1, 2)

    def _split(self, x: np.ndarray, leaves: int) -> int:
        """The number of a node, or -1 - the number of a cell."""
        for d in np.argsort(-x.var(0), kind="stable") if leaves > 1 and len(x) > 1 else ():
            values = x[:, d]
            at = np.partition(values, (len(x) - 1) // 2)[(len(x) - 1) // 2]
            low = values <= at
            if low.all():
                at = values[values < at].max(initial=-np.inf)
                low = values <= at
            if low.any():
                own = len(self.dim)
                self.dim.append(d), self.at.append(at), self.child.append([0, 0])
                first = min(leaves - 1, max(1, round(leaves * low.sum() / len(x))))
                self.child[own] = [self._split(x[low], first), self._split(x[~low], leaves - first)]
                return own
        self.cells += 1
        return -self.cells

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of every point."""
        node = np.full(len(x), self.root)
        while len(at := np.flatnonzero(node >= 0)):
            n = node[at]
            node[at] = self.child[n, (x[at, self.dim[n]] > self.at[n]).astype(int)]
        return -1 - node


def matrix(b: pa.RecordBatch | pa.Table, weights: list[float] | None) -> np.ndarray:
    column = b.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 0))
    return v * np.array(weights) if weights is not None and len(v) else v


class Space:
    """Distinct vectors (node, first, v) in cells with their boxes."""

    def __init__(self, nodes: DataFrame, rows: int, metric: str, weights: list[float] | None):
        self.metric, self.weights = metric, weights
        every = max(1, rows // SAMPLE)
        sample = nodes.where(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(every)) == 0).select("v").toArrow()  # about SAMPLE rows
        splits = Splits(embedded(matrix(sample, weights), metric), min(CELLS, -(-rows // CELL)))

        def place(batches):
            for b in batches:
                cell = splits.of(embedded(matrix(b, weights), metric)) if b.num_rows else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "first", "v")), pa.array(cell.astype(np.int32), pa.int32())], ["node", "first", "v", "cell"])

        kind = nodes.schema["v"].dataType.simpleString()
        self.schema = f"node bigint, first bigint, v {kind}, cell int"
        self.placed = settled(nodes.select("node", "first", "v").mapInArrow(place, self.schema), "cells")

        def box(t: pa.Table) -> pa.Table:
            v = matrix(t, weights)
            x = embedded(v, metric)
            far = int(((x - x.mean(0)) ** 2).sum(1).argmax()) if metric == "cosine" else int((x * x).sum(1).argmax())
            return pa.table({"cell": t.column("cell")[:1], "rows": [len(x)], "low": [x.min(0)], "high": [x.max(0)], "far": [t.column("v")[far].as_py()], "zero": [bool((v == 0).all(1).any())], "other": [bool((v != 0).any())]})

        found = self.placed.groupBy("cell").applyInArrow(box, "cell int, rows bigint, low array<double>, high array<double>, far array<double>, zero boolean, other boolean").collect()  # a row for each cell
        self.cells = np.array([r["cell"] for r in found], np.int32)
        self.low, self.high = (np.array([r[c] for r in found], float) for c in ("low", "high"))
        self.most = max((r["rows"] for r in found), default=0)
        self.far, self.zero, self.other = np.array([r["far"] for r in found], float), any(r["zero"] for r in found), any(r["other"] for r in found)

    def nearest_square(self, x: np.ndarray) -> np.ndarray:
        """Squares of the least distances of points to all boxes."""
        out = np.zeros((len(x), len(self.cells)))
        for d in range(x.shape[1]):
            out += np.maximum(np.maximum(self.low[:, d] - x[:, d, None], x[:, d, None] - self.high[:, d]), 0) ** 2
        return out

    def farthest_square(self, x: np.ndarray) -> np.ndarray:
        """Squares of the largest distances of points to all boxes."""
        out = np.zeros((len(x), len(self.cells)))
        for d in range(x.shape[1]):
            out += np.maximum(np.abs(x[:, d, None] - self.low[:, d]), np.abs(x[:, d, None] - self.high[:, d])) ** 2
        return out

    def least_similarity(self, v: np.ndarray) -> np.ndarray:
        """What similarities of vectors with those in a box can't be below: of the cosine by the distance from the opposite place."""
        if self.metric == "euclidean":
            return 1 / (1 + np.sqrt(self.farthest_square(v))) * (1 - 1e-9)
        x = embedded(v, "cosine")
        x[:, :-1] *= -1
        return self.nearest_square(x) / 2 - 1 - 1e-9

    def met(self, probes: DataFrame, most: int) -> DataFrame:
        """(node, first, v, least, query, cell, tile): probes (node, first, v, least, cell) and the points of the cells that they visit; cells with more than ``most`` probes in tiles."""
        probes = settled(probes, "probes")
        counts = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("tiles"))  # at most CELLS rows
        counts = settled(counts, "visits")
        asked = probes.join(F.broadcast(counts), "cell").select("node", "first", "v", "least", F.lit(True).alias("query"), "cell", F.pmod(F.xxhash64("node", F.lit(3)), "tiles").cast("int").alias("tile"))
        tiles = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        points = self.placed.join(F.broadcast(counts), "cell").select("node", "first", "v", F.lit(None).cast("double").alias("least"), F.lit(False).alias("query"), "cell", tiles.alias("tile"))
        return asked.unionByName(points)

    def sent(self, rows: DataFrame, chosen) -> DataFrame:
        """Probes (node, first, v, least, cell): a row for each cell that ``chosen`` (vectors, own cells, least similarities -> matrix of true and false) names for rows (node, first, v, cell, least)."""
        cells, weights = self.cells, self.weights

        def route(batches):
            for b in (whole.slice(lo, STEP) for whole in batches for lo in range(0, whole.num_rows, STEP)):
                i, j = np.nonzero(chosen(matrix(b, weights), b.column("cell").to_numpy(), b.column("least").to_numpy(zero_copy_only=False)))
                i = pa.array(i)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(i) for c in ("node", "first", "v", "least")), pa.array(cells[j])], ["node", "first", "v", "least", "cell"])

        kind = self.placed.schema["v"].dataType.simpleString()
        return rows.select("node", "first", "v", "cell", "least").mapInArrow(route, f"node bigint, first bigint, v {kind}, least double, cell int")

    def __getstate__(self):
        """What tasks need: cells and boxes, no frames."""
        return {k: v for k, v in self.__dict__.items() if k != "placed"}

    def beyond(self, v: np.ndarray, own: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Cells other than a vector's own that can hold a similarity of ``least``."""
        return (self.nearest_square(embedded(v, self.metric)) <= reach(least, self.metric)[:, None] + 1e-15) & (own[:, None] != self.cells)
