"""Vector similarity: pairs in blocks, nearest peers, top matches of a target."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.tables import settled
from panelforge.operators import space

#: Rows of a block while pairs of blocks are fewer than tasks, and of the similarities of a strip that are held at once.
BLOCK = 16384
#: Rows and numbers (64 MB of doubles) of a block at most, where there are tasks enough: larger blocks are sent less often. A task holds two.
MOST_ROWS, NUMBERS = 1 << 17, 1 << 23


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has length 0."""
    pair = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    z = F.lit(0.0)
    s = F.aggregate(pair, F.struct(z.alias("xy"), z.alias("xx"), z.alias("yy")), lambda s, p: F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy")))
    return F.when((s["xx"] > 0) & (s["yy"] > 0), s["xy"] / F.sqrt(s["xx"] * s["yy"])).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x))


def jaccard(a: Column, b: Column) -> Column:
    """Share of dimensions above 0 in both among those above 0 in one; 0 without any."""
    both = F.zip_with(a, b, lambda x, y: ((x > 0) & (y > 0)).cast("int"))
    one = F.zip_with(a, b, lambda x, y: ((x > 0) | (y > 0)).cast("int"))
    total = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + x)
    return F.when(total(one) > 0, total(both) / total(one)).otherwise(0.0)


def to_target(df: DataFrame, key: str, vector: str, target, n: int) -> DataFrame:
    """(key, similarity, position): the n rows most like the target's, itself left out."""
    one = df.where(F.col(key) == target).select(F.col(vector).alias("_t")).limit(1)
    near = df.where(F.col(key) != target).crossJoin(F.broadcast(one)).select(key, F.round(cosine(F.col(vector), F.col("_t")), 9).alias("similarity"))
    from panelforge.operators.ranking import top

    return top(near, "similarity", key, n)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    unit = lambda v: np.divide(v, n := np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=n > 0)
    return unit(a) @ unit(b).T


def _closeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 / (1 + distance); distances by one product, of vectors taken from their mean so that little is lost in the difference."""
    middle = b.mean(0) if len(b) else 0.0
    a, b = a - middle, b - middle
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    # Where the difference has lost its digits (near copies) the distance is taken by itself.
    lost = square < 1e-6 * ((a * a).sum(1)[:, None] + (b * b).sum(1)[None])
    i, j = np.nonzero(lost)
    for lo in range(0, len(i), 1 << 14):
        x, y = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
        square[x, y] = ((a[x] - b[y]) ** 2).sum(1)
    return 1 / (1 + np.sqrt(np.maximum(square, 0)))


def _jaccards(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of dimensions above 0 in both among those above 0 in one."""
    a, b = (a > 0).astype(float), (b > 0).astype(float)
    both = a @ b.T
    either = a.sum(1)[:, None] + b.sum(1)[None] - both
    return np.divide(both, either, out=np.zeros_like(both), where=either > 0)


METRICS = {"cosine": _cosines, "euclidean": _closeness, "jaccard": _jaccards}


#: Queries whose similarities with a tile are held at once, and points of a tile.
STRIP, TILE = 256, 4096


def _vectors(df: DataFrame, vector: str, metric: str) -> Column:
    """What a metric looks at, in as few bytes as hold it: numbers as given, or 1 where they are above 0."""
    if metric == "jaccard":
        return F.transform(vector, lambda x: (x > 0).cast("float"))
    return F.col(vector).cast("array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>")


def _blocked(points: DataFrame, asked: DataFrame, block: int) -> DataFrame:
    """(node, first, v, query, i, j): queries of block i and points of block j of every pair of blocks."""
    wide = points.select(F.size("v")).head()
    width = max(1, wide[0]) if wide else 1
    # As many rows as 8 MB of doubles hold.
    block = min(block, max(STRIP, (1 << 20) // width))
    most = max(block, min(MOST_ROWS, NUMBERS // width))
    side = math.isqrt(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    blocks = lambda rows: max(1, min(-(-rows // block), side), -(-rows // most))
    n, m = blocks(points.count()), blocks(asked.count())
    place = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keep = ["node", "first", "v"]
    own = asked.select(*keep, F.lit(True).alias("query"), place(m).alias("i"), every(n).alias("j"))
    return own.unionByName(points.select(*keep, F.lit(False).alias("query"), every(m).alias("i"), place(n).alias("j")))


def _parted(t: pa.Table, weights: list[float] | None) -> tuple[pa.Table, np.ndarray, pa.Table, np.ndarray]:
    """Queries and points of a group with their vectors, points in the order of their first rows."""
    own = t.column("query").combine_chunks()
    out = []
    for part in (t.filter(own), t.filter(pc.invert(own)).sort_by("first")):
        values = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        v = values.reshape(part.num_rows, -1) if part.num_rows else np.zeros((0, 0))
        out += [part, v * np.array(weights) if weights is not None and len(v) else v]
    return tuple(out)


def _strips(a: np.ndarray, b: np.ndarray, metric: str):
    """Strips of queries a, each as (its first row, its similarities with BLOCK points b at once as pairs of the first of them and a matrix)."""
    for lo in range(0, len(a) if len(b) else 0, STRIP):
        yield lo, ((at, METRICS[metric](a[lo : lo + STRIP], b[at : at + BLOCK])) for at in range(0, len(b), BLOCK))


def _prepared(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Queries and points as the metric compares them: of length 1, taken from the points' mean, or 1 where they are above 0."""
    if metric == "cosine":
        return tuple(np.divide(v, n := np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=n > 0) for v in (a, b))
    if metric == "euclidean":
        middle = b.mean(0) if len(b) else 0.0
        return a - middle, b - middle
    return (a > 0).astype(float), (b > 0).astype(float)


def _of_pairs(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Similarities of prepared rows one by one."""
    if metric == "euclidean":
        return 1 / (1 + np.sqrt(((a - b) ** 2).sum(1)))
    both = np.einsum("ij,ij->i", a, b)
    if metric == "cosine":
        return both
    either = a.sum(1) + b.sum(1) - both
    return np.divide(both, either, out=np.zeros_like(both), where=either > 0)


class _Rough:
    """Scores of prepared queries and points in single precision, and per query the score below which no similarity of a given size lies, errors included."""

    def __init__(self, a: np.ndarray, b: np.ndarray, metric: str):
        self.metric = metric
        # Scaled, so that squares stay within the range of single numbers.
        self.scale = max(float(np.abs(x).max(initial=0.0)) for x in (a, b)) or 1.0
        if metric == "euclidean":
            a, b = a / self.scale, b / self.scale
            self.own = (a * a).sum(1)
            square = (b * b).sum(1)
            self.slack = 2.0**-23 * (a.shape[1] + 10) * (np.sqrt(self.own * square.max(initial=0.0)) + square.max(initial=0.0))
            a, b = np.hstack([a, np.ones((len(a), 1))]), np.hstack([b, -square[:, None] / 2])
        else:
            self.slack = np.full(len(a), 2.0**-23 * (a.shape[1] + 10) if metric == "cosine" else 1e-6)
        self.a, self.b = a.astype(np.float32), b.astype(np.float32)
        self.ones = [x.sum(1) for x in (self.a, self.b)]

    def scores(self, q: slice, p: slice) -> np.ndarray:
        both = self.a[q] @ self.b[p].T
        if self.metric != "jaccard":
            return both
        either = self.ones[0][q, None] + self.ones[1][p] - both
        return np.divide(both, either, out=np.zeros_like(both), where=either > 0)

    def floor(self, q: slice, least: np.ndarray) -> np.ndarray:
        """Below this score a similarity, rounded, is less than ``least``."""
        s = least - 1e-9
        if self.metric == "euclidean":
            far = np.where(s > 0, 1 / np.where(s > 0, s, 1.0) - 1, np.inf) / self.scale
            s = (self.own[q] - far * far * (1 + 1e-9)) / 2
        return (s - self.slack[q]).astype(np.float32)


def _best(a: np.ndarray, b: np.ndarray, metric: str, n: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, similarity) of the n points most like each query, earlier points first among equals; with ``least`` only those as similar.

    Scores in single precision leave few pairs, whose similarities are taken one by one; the worst of what a query holds is its bar for the next tile."""
    a, b = _prepared(a, b, metric)
    rough, out = _Rough(a, b, metric), []
    for lo in range(0, len(a) if len(b) else 0, STRIP):
        q = slice(lo, min(lo + STRIP, len(a)))
        bar = np.full(q.stop - lo, -np.inf) if least is None else least[q].astype(float)
        i, j, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        at, width = 0, max(32, 2 * n)
        while at < len(b):
            p = slice(at, min(at + width, len(b)))
            score = rough.scores(q, p)
            mark = rough.floor(q, bar)
            x, y = np.divmod(np.flatnonzero(score >= mark[:, None]), score.shape[1])
            if len(x):
                y += at
                new = np.round(_of_pairs(a[x + lo], b[y], metric), 9)
                good = new >= bar[x]
                i, j, s = np.concatenate([i, x[good]]), np.concatenate([j, y[good]]), np.concatenate([s, new[good]])
                order = np.lexsort((j, -s, i))
                i, j, s = i[order], j[order], s[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                last = place == n - 1
                bar[i[last]] = np.maximum(bar[i[last]], s[last])
                i, j, s = (z[place < n] for z in (i, j, s))
            at, width = p.stop, min(4 * width, TILE)
        out.append((i + lo, j, s))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _space(nodes: DataFrame, metric: str, weights: list[float] | None) -> space.Space | None:
    """Cells of many vectors of few dimensions; None where pairs of blocks are as good, or where vectors lie so that no cells part them."""
    one = nodes.select(F.size("v")).head()
    if metric not in space.METRICS or one is None or not 0 < one[0] <= space.NARROW:
        return None
    rows = nodes.count()
    if rows <= 4 * space.CELL:
        return None
    parts = space.Space(nodes, rows, metric, weights)
    return parts if parts.most <= MOST_ROWS else None


def _in_space(parts: space.Space, n: int) -> DataFrame:
    """(node, other, first, similarity): of every vector the n best of its own cell, and what is as good in the cells that can hold it."""
    metric, weights = parts.metric, parts.weights

    def own(t: pa.Table) -> pa.Table:
        t = t.sort_by("first").combine_chunks()
        v = space.matrix(t, weights)
        i, j, s = _best(v, v, metric, n)
        order = np.argsort(i, kind="stable")
        i, j, s = i[order], j[order], s[order]
        ends = np.searchsorted(i, np.arange(len(v) + 1)).astype(np.int32)
        size = np.diff(ends)
        least = np.full(len(v), -np.inf)
        least[size == n] = s[ends[1:][size == n] - 1]
        lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (t.column("node").combine_chunks().take(pa.array(j)), t.column("first").combine_chunks().take(pa.array(j)), pa.array(s))]
        return pa.table([*(t.column(c) for c in ("node", "first", "v", "cell")), pa.array(least), *lists], ["node", "first", "v", "cell", "least", "others", "firsts", "similarities"])

    def visited(t: pa.Table) -> pa.Table:
        asked, a, points, b = _parted(t, weights)
        i, j, s = _best(a, b, metric, n, asked.column("least").to_numpy())
        node, other = asked.column("node").take(pa.array(i)), points.select(["node", "first"]).take(pa.array(j))
        return pa.table({"node": node, "other": other.column("node"), "first": other.column("first"), "similarity": s})

    columns = "others array<bigint>, firsts array<bigint>, similarities array<double>"
    first = settled(parts.placed.groupBy("cell").applyInArrow(own, f"{parts.schema}, least double, {columns}"), "own_cells")
    near = first.select("node", F.explode(F.arrays_zip("others", "firsts", "similarities")).alias("p")).select("node", F.col("p.others").alias("other"), F.col("p.firsts").alias("first"), F.col("p.similarities").alias("similarity"))
    beyond = parts.met(parts.sent(first, parts.beyond), MOST_ROWS).groupBy("cell", "tile").applyInArrow(visited, "node bigint, other bigint, first bigint, similarity double")
    return near.unionByName(beyond)


def _ends_in_space(parts: space.Space) -> DataFrame:
    """(low, high) of all pairs: a vector is most like itself, and the least like pair lies in cells that the least similarity found so far does not rule out."""
    metric, weights, spark = parts.metric, parts.weights, parts.placed.sparkSession

    def least(t: pa.Table) -> pa.Table:
        _, a, _, b = _parted(t, weights)
        a, b = _prepared(a, b, metric)
        rough, low = _Rough(a, b, metric), np.inf
        for lo in range(0, len(a) if len(b) else 0, STRIP):
            for at in range(0, len(b), TILE):
                q, p = slice(lo, min(lo + STRIP, len(a))), slice(at, min(at + TILE, len(b)))
                score = rough.scores(q, p)
                # Of each query's pairs the least, errors included; their similarities one by one.
                x, y = np.divmod(np.flatnonzero(score <= (score.min(1) + 2 * rough.slack[q] + 1e-9)[:, None]), score.shape[1])
                low = min(low, float(_of_pairs(a[x + lo], b[y + at], metric).min(initial=np.inf)))
        return pa.table({"low": np.round([low], 9) if np.isfinite(low) else np.zeros(0)})

    def lowest(probes: DataFrame) -> float | None:
        return parts.met(probes, MOST_ROWS).groupBy("cell", "tile").applyInArrow(least, "low double").agg(F.min("low")).head()[0]

    # The farthest of every cell with the cell that is farthest from it: a bound for all others.
    bounds = parts.least_similarity(parts.far * np.array(weights) if weights is not None else parts.far)
    kind = parts.placed.schema["v"].dataType.simpleString()
    some = spark.createDataFrame([(k, k, v.tolist(), 0.0, int(parts.cells[c])) for k, (v, c) in enumerate(zip(parts.far, bounds.argmin(1), strict=True))], f"node bigint, first bigint, v {kind}, least double, cell int")
    low = lowest(some)
    worth = lambda v, own, bar: parts.least_similarity(v) <= bar[:, None] + 1e-9
    found = lowest(parts.sent(parts.placed.withColumn("least", F.lit(low)), worth))
    ends = [low, *([found] if found is not None else []), *([0.0] if parts.zero and metric == "cosine" else [])]
    high = 1.0 if metric == "euclidean" or parts.other else 0.0
    return spark.createDataFrame([(min(ends), high)], "low double, high double")


def nearest(
    df: DataFrame, key: str, vector: str, k: int, block: int = BLOCK, metric: str = "cosine", weights: list[float] | None = None,
    queries: DataFrame | None = None, approximate: bool = False,
) -> DataFrame:
    """(key, peer, similarity): the k rows most like each row (or those of ``queries``, a frame of keys) by ``metric``; with ``weights`` for the dimensions.

    Rows that a metric can't tell apart are one node with its smallest keys. The exact search deals nodes into blocks; every pair
    of blocks is one group, in which matrix products give the best of each node, and the best of all its groups are kept. Groups grow in
    number with the square of the different vectors, which an exact search of many dimensions can't avoid. Blocks grow up to MOST_ROWS and NUMBERS
    once there are as many groups as tasks, and what is shuffled is 2 * n * n / rows of a block vectors. Many vectors of few dimensions are searched
    in cells instead (see ``space``; cosine and euclidean), with the same result. ``approximate`` looks into bucket tables instead (cosine of all rows, see ``neighbours``). Null vectors are left out.
    """
    from panelforge.operators import neighbours

    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if approximate:
        if metric != "cosine" or queries is not None:
            raise ValueError("the bucket tables are for the cosine of all rows")
        if weights is not None:
            scaled = F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, weights)), lambda x, w: x * w)
            df = df.select(key, scaled.alias(vector))
        return neighbours.approximate(df, key, vector, k)

    def best(t: pa.Table) -> pa.Table:
        asked, a, points, b = _parted(t, weights)
        i, j, s = _best(a, b, metric, k + 1)
        own, other = asked.column("node").take(pa.array(i)), points.select(["node", "first"]).take(pa.array(j))
        return pa.table({"node": own, "other": other.column("node"), "first": other.column("first"), "similarity": s})

    rows_of = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), _vectors(df, vector, metric).alias("v"))
    nodes, seed = neighbours.distinct_vectors(rows_of, "v", "id")
    rows = rows_of.select("id", F.xxhash64(F.lit(seed), "v").alias("node"))
    asked, own = nodes, rows
    if queries is not None:
        own = settled(rows.join(queries.select(F.col(key).cast("bigint").alias("id")), "id", "left_semi"), "queries")
        asked = nodes.join(own.select("node").distinct(), "node", "left_semi")
    parts = _space(nodes, metric, weights) if queries is None else None
    if parts is None:
        found = _blocked(nodes, asked, block).groupBy("i", "j").applyInArrow(best, "node bigint, other bigint, first bigint, similarity double")
    else:
        found = _in_space(parts, k + 1)
    ranked = Window.partitionBy("node").orderBy(F.desc("similarity"), "first")
    near = found.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= k + 1).select("node", "other", "similarity")
    kept, _ = neighbours.of_rows(near, nodes, rows, own, k)
    return neighbours.listed(kept, key)


def mean_filled(df: DataFrame, key: str, columns: list[str], out: str = "vector") -> DataFrame:
    """(key, vector) of columns, nulls replaced by the column's mean (0 for a column without values). Columns that df lacks are left out; without any it is an error."""
    there = [c for c in columns if c in df.columns]
    if not there:
        raise ValueError("no feature columns available")
    means = df.agg(*[F.avg(c).alias(f"_m{k}") for k, c in enumerate(there)])  # one row
    filled = [F.coalesce(F.col(c).cast("double"), F.col(f"_m{k}"), F.lit(0.0)) for k, c in enumerate(there)]
    return df.select(key, *there).crossJoin(F.broadcast(means)).select(key, F.array(*filled).alias(out))


def extremes(df: DataFrame, key: str, vector: str, block: int = BLOCK, metric: str = "cosine", weights: list[float] | None = None) -> DataFrame:
    """(low, high): the least and the largest similarity of any two rows, a row with itself included; two numbers from each pair of blocks of different vectors."""
    from panelforge.operators import neighbours

    def ends(t: pa.Table) -> pa.Table:
        _, a, _, b = _parted(t, weights)
        found = [(s.min(), s.max()) for _, tiles in _strips(a, b, metric) for _, s in tiles]
        low, high = (np.round([f(x)], 9) if found else np.zeros(0) for f, x in zip((min, max), zip(*found, strict=True) if found else ((), ()), strict=True))
        return pa.table({"low": low, "high": high})

    nodes, _ = neighbours.distinct_vectors(df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), _vectors(df, vector, metric).alias("v")), "v", "id")
    parts = _space(nodes, metric, weights)
    if parts is not None:
        return _ends_in_space(parts)
    found = _blocked(nodes, nodes, block).groupBy("i", "j").applyInArrow(ends, "low double, high double")
    return found.agg(F.min("low").alias("low"), F.max("high").alias("high"))


def rescaled(near: DataFrame, ends: DataFrame, low: float, high: float, value: str = "similarity") -> DataFrame:
    """near with its similarities brought from the range of all pairs (``ends``) to [low, high]; unchanged for 0 to 1, or where all are alike."""
    if (low, high) == (0.0, 1.0):
        return near
    to = (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * (high - low) + low
    both = near.crossJoin(F.broadcast(ends.select(F.col("low").alias("_low"), F.col("high").alias("_high"))))  # one row
    return both.withColumn(value, F.when(F.col("_high") > F.col("_low"), to).otherwise(F.col(value))).drop("_low", "_high")


def peer_excess(df: DataFrame, key: str, vector: str, value: str, k: int, approximate: bool = False) -> DataFrame:
    """(key, excess): a value less the mean of the k nearest peers', brought to 0..1 over all rows; 0.5 if all are alike."""
    peers = nearest(df, key, vector, k, approximate=approximate).join(df.select(F.col(key).alias("peer"), F.col(value).alias("_p")), "peer").groupBy(key).agg(F.avg("_p").alias("_m"))
    raw = df.select(key, value).join(peers, key).select(key, (F.col(value) - F.col("_m")).alias("_x"))
    s = raw.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    return raw.crossJoin(F.broadcast(s)).select(key, F.when(F.col("_hi") > F.col("_lo"), (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5).alias("excess"))
