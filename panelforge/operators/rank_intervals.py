"""Intervals of every entity's rank, over bootstrap draws of the entities and over random (Dirichlet) weights of their scores.

Entities are dealt into chunks in the order of their scores. Bootstrap draws keep that order, so totals of chunks, a vector each, give the ranks; random weights
do not, so a chunk sends its distinct weighted scores, by replicates and ranges of values, and gets their ranks back. Both are drawn again where they are needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import uniform
from panelforge.functions.tables import settled
from panelforge.functions.uniforms import rounded_numbers, uniforms
from panelforge.operators.draws import drawn, lists, vectors
from panelforge.operators.ranking import medians, numbered

#: Entities that are drawn in fewer replicates have no interval.
LEAST = 10
STEADY, RELAXED, STRICT, MODERATE = 5.0, 0.15, 0.20, 0.35
#: Entities of a chunk, entities of a range of weighted scores, and weighted scores of a group that are ranked at once, about.
CHUNK, RANGE, CELLS = 4096, 1_000_000, 2_000_000


def _dealt(chunks: DataFrame) -> DataFrame:
    """chunks, settled in as many files as the usual number of tasks, dealt evenly: a chunk is small but takes long to draw."""
    return settled(chunks.repartitionByRange(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk"), "chunks")


def _chunks(scores: DataFrame, key: str) -> DataFrame:
    """(chunk, keys, ids, scores), settled: entities in the order of their scores."""
    placed = numbered(scores, [], ["score", key], "_place").withColumn("chunk", F.floor(F.col("_place") / CHUNK).cast("int"))
    rows = placed.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("_place", F.col(key).alias("key"), "score"))).alias("e"))
    ids = F.transform("e.key", lambda k: k.cast("string"))
    return _dealt(rows.select("chunk", F.col("e.key").alias("keys"), ids.alias("ids"), F.col("e.score").alias("scores")))


def _draws(ids: list[str], replicates: int, seed: int) -> np.ndarray:
    """Draws of a chunk's entities in every replicate, and a last column of ones for the given scores."""
    return np.concatenate([drawn(seed, range(replicates), ids), np.ones((len(ids), 1), np.int64)], axis=1)


def _borders(chunks: DataFrame, draws) -> DataFrame:
    """(chunk, before, whole, head_before, head_whole, tail_whole): vectors over the replicates (``draws(ids)``: entities x replicates) of what smaller chunks and all hold,
    and what holds the chunk's first and last value, which may go on in other chunks."""

    def totals(batches):
        for b in batches:
            for chunk, ids, scores in zip(b.column("chunk").to_pylist(), b.column("ids").to_pylist(), b.column("scores"), strict=True):
                d, v = draws(ids), scores.values.to_numpy(zero_copy_only=False)
                head, tail = d[v == v[0]].sum(0), d[v == v[-1]].sum(0)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "total": lists(d.sum(0)[None]), "first": v[:1], "last": v[-1:], "head": lists(head[None]), "tail": lists(tail[None])})

    t = settled(chunks.mapInArrow(totals, "chunk int, total array<bigint>, first double, last double, head array<bigint>, tail array<bigint>"), "chunk_totals")
    upto = lambda w: w.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("r", c))), lambda x: x[c])
    own = Window.partitionBy("r")
    sums = t.select("chunk", F.posexplode("total").alias("r", "s")).select("chunk", "r", (F.sum("s").over(upto(own)) - F.col("s")).alias("before"), F.sum("s").over(own).alias("whole"))
    sums = sums.groupBy("chunk").agg(listed("before").alias("before"), listed("whole").alias("whole"))
    ends = t.select("chunk", F.lit(True).alias("is_head"), F.col("first").alias("value"), F.posexplode("head").alias("r", "s"))
    ends = ends.unionByName(t.where("last > first").select("chunk", F.lit(False).alias("is_head"), F.col("last").alias("value"), F.posexplode("tail").alias("r", "s")))
    same = Window.partitionBy("value", "r")
    ends = ends.select("chunk", "is_head", "r", (F.sum("s").over(upto(same)) - F.col("s")).alias("before"), F.sum("s").over(same).alias("whole"))
    ends = ends.groupBy("chunk", "is_head").agg(listed("before").alias("_before"), listed("whole").alias("_whole"))
    head = ends.where("is_head").select("chunk", F.col("_before").alias("head_before"), F.col("_whole").alias("head_whole"))
    return sums.join(head, "chunk").join(ends.where("not is_head").select("chunk", F.col("_whole").alias("tail_whole")), "chunk", "left")


def _drawn_ranks(v: np.ndarray, d: np.ndarray, before, whole, head_before, head_whole, tail_whole) -> np.ndarray:
    """Descending average ranks of a chunk's ascending values v with draws d."""
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    own = np.add.reduceat(d, first, axis=0)
    below = np.cumsum(own, axis=0) - own + before
    below[0] -= head_before
    own[0] = head_whole
    if len(first) > 1:
        own[-1] = tail_whole
    up = below + (own + 1) / 2
    return (whole + 1 - up)[np.cumsum(np.bincount(first, minlength=len(v))) - 1]


def successive(scores: DataFrame, draws, near: int, key: str) -> DataFrame:
    """(replicate, drawn, both, within, low, high) of scores (key, score) without nulls: entities in each draw of ``draws(ids)`` (entities x replicates, 0 or 1), those
    in the one before as well, how many of these are within ``near`` ranks of it, and their least and largest score. A row for each chunk and replicate is sent."""
    chunks = _chunks(scores, key)
    names = ("before", "whole", "head_before", "head_whole", "tail_whole")

    def steps(batches):
        for b in batches:
            for i in range(b.num_rows):
                v, d = b.column("scores")[i].values.to_numpy(zero_copy_only=False), draws(b.column("ids")[i].as_py())
                ranks = _drawn_ranks(v, d, *[np.array(b.column(c)[i].as_py()) for c in names])
                both = np.zeros(d.shape, bool)
                both[:, 1:] = (d[:, 1:] > 0) & (d[:, :-1] > 0)
                near_by = both[:, 1:] & (np.abs(np.diff(ranks, axis=1)) <= near)
                none = ~both.any(0)
                ends = [pa.array(v[at], mask=none) for at in (both.argmax(0), len(v) - 1 - both[::-1].argmax(0))]
                counts = [d.sum(0), both.sum(0), np.concatenate([[0], near_by.sum(0)])]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d.shape[1], dtype=np.int32)), *map(pa.array, counts), *ends], ["replicate", "drawn", "both", "within", "low", "high"])

    rows = chunks.join(_borders(chunks, draws), "chunk").select("ids", "scores", *names).mapInArrow(steps, "replicate int, drawn bigint, both bigint, within bigint, low double, high double")
    total = [F.sum(c).alias(c) for c in ("drawn", "both", "within")]
    return settled(rows.groupBy("replicate").agg(*total, F.min("low").alias("low"), F.max("high").alias("high")), "steps")


def _exponential(scores: np.ndarray, ids: list[str], replicates: range, seed: int) -> np.ndarray:
    """Replicates x entities: scores by random weights (exponential numbers: Dirichlet weights but for their sum, which moves no rank)."""
    return rounded_numbers(scores[:, None] * -np.log(np.maximum(uniforms(seed, replicates, ids), 1e-12)), 8).T


def _weighted(z: np.ndarray, edges: list[float]):
    """Of weighted scores z (replicates x entities) of a chunk: the distinct ones by replicate in order with their counts, replicates and ranges, and for each
    cell which one it is."""
    order = np.argsort(z, axis=1)
    ordered = np.take_along_axis(z, order, axis=1)
    new = np.ones(z.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    at = np.flatnonzero(new)
    values = ordered.ravel()[at]
    cell = np.empty(z.shape, np.int64)
    np.put_along_axis(cell, order, np.cumsum(new).reshape(z.shape) - 1, axis=1)
    return values, np.diff(np.append(at, z.size)), at // z.shape[1], np.searchsorted(edges, values, side="right"), cell


def _blocks(replicates: int, n: int) -> list[range]:
    """Ranges of replicates, so that a group has about CELLS weighted scores."""
    size = max(1, CELLS // max(1, min(n, RANGE)))
    return [range(a, min(a + size, replicates)) for a in range(0, replicates, size)]


def _ranked(t: pa.Table) -> pa.Table:
    """Twice the average ranks within a group, all chunks' values of some replicates and one range."""
    sizes = vectors(t.column("sizes"), np.int64)
    replicate = np.repeat(np.tile(np.arange(sizes.shape[1]), len(sizes)), sizes.ravel())
    values, n = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("values", "n"))
    n = n.astype(np.int64)
    # Replicates by counting, then the values of each.
    order = np.argsort(replicate.astype(np.int16 if sizes.shape[1] < 1 << 15 else np.int64), kind="stable")
    ends = np.cumsum(np.bincount(replicate, minlength=sizes.shape[1]))
    for lo, hi in zip(ends - np.diff(ends, prepend=0), ends, strict=True):
        own = order[lo:hi]
        order[lo:hi] = own[np.argsort(values[own])]
    v, r, n = values[order], replicate[order], n[order]
    ranks = np.empty(len(v), np.int32)
    if len(v):
        first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])]))
        own = np.add.reduceat(n, first)
        below = np.cumsum(own) - own
        start = np.searchsorted(r[first], r[first])
        ranks[order] = np.repeat(2 * (below - below[start]) + own + 1, np.diff(np.append(first, len(v))))
    held = np.bincount(r, weights=n, minlength=sizes.shape[1]).astype(np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes.sum(1))]).astype(np.int32))
    out = pa.ListArray.from_arrays(offsets, pa.array(ranks))
    return pa.table({"chunk": t.column("chunk"), "block": t.column("block"), "range": t.column("range"), "held": lists(np.repeat(held[None], len(sizes), 0)), "ranks": out})


def _weighted_ranks(chunks: DataFrame, n: int, replicates: int, scored, edges: list[float]) -> DataFrame:
    """(chunk, block, range, held, ranks): twice the ascending ranks, within their range, of a chunk's distinct weighted scores, and what the range holds in each replicate.

    ``scored(table, row)`` gives the function from a range of replicates to the weighted scores (replicates x entities) of that row of chunks."""
    blocks = _blocks(replicates, n)

    def cells(batches):
        for b in batches:
            for i, chunk in enumerate(b.column("chunk").to_pylist()):
                z = scored(b, i)
                for k, block in enumerate(blocks):
                    values, count, r, q, _ = _weighted(z(block), edges)
                    for e in range(len(edges) + 1):
                        own = q == e
                        row = {"values": values[own], "n": count[own].astype(np.int32), "sizes": np.bincount(r[own], minlength=len(block)).astype(np.int32)}
                        place = {c: pa.array([x], pa.int32()) for c, x in (("chunk", chunk), ("block", k), ("range", e))}
                        yield pa.RecordBatch.from_pydict(place | {c: lists(x[None]) for c, x in row.items()})

    sent = chunks.mapInArrow(cells, "chunk int, block int, range int, values array<double>, n array<int>, sizes array<int>")
    # As many tasks as groups, or the usual number.
    tasks = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(blocks) * (len(edges) + 1) // 8)
    return sent.repartition(tasks, "block", "range").groupBy("block", "range").applyInArrow(_ranked, "chunk int, block int, range int, held array<bigint>, ranks array<int>")


def _ascending(weighted: pa.Table, z, blocks: list[range], edges: list[float]) -> np.ndarray:
    """Entities x replicates: average ranks of a chunk's weighted scores ``z`` among all, from its rows of ``_weighted_ranks``."""
    rows = {(r["block"], r["range"]): i for i, r in enumerate(weighted.select(["block", "range"]).to_pylist())}
    out = []
    for k, block in enumerate(blocks):
        values, _, r, q, cell = _weighted(z(block), edges)
        ranks, below = np.empty(len(values)), np.zeros(len(block))
        for e in range(len(edges) + 1):
            i, at = rows[k, e], q == e
            ranks[at] = weighted.column("ranks")[i].values.to_numpy(zero_copy_only=False) / 2 + below[r[at]]
            below += weighted.column("held")[i].values.to_numpy(zero_copy_only=False)
        out.append(ranks[cell].T)
    return np.concatenate(out, axis=1)


def weighted_sums(x: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    """Replicates x entities: sums of columns x by the weights w (replicates x columns), to 8 digits; missing numbers count as 0."""
    return rounded_numbers(sum((w[:, k, None] * np.nan_to_num(c) for k, c in enumerate(x)), 0.0), 8)


def ranks_by_weights(wide: DataFrame, columns: list[str], w: np.ndarray, key: str) -> DataFrame:
    """(key, mean, std, lo, hi) of wide (key, columns): mean, deviation, least and largest of an entity's descending average ranks by each row of the weights w
    (replicates x columns). Values go by replicates and ranges and ranks come back, so no row is copied for the replicates."""
    rows = settled(wide.select(F.col(key).alias("key"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x")), "wide")
    n, many = rows.count(), len(columns)
    chunk = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // CHUNK)))).cast("int").alias("chunk")
    chunks = _dealt(rows.groupBy(chunk).agg(F.collect_list(F.struct("key", "x")).alias("e")).select("chunk", F.col("e.key").alias("keys"), F.flatten("e.x").alias("x")))
    edges: list[float] = []
    if n > RANGE:
        middle, k = w.mean(0), -(-n // RANGE)
        score = sum((float(m) * F.get("x", F.lit(i)) for i, m in enumerate(middle)), F.lit(0.0)).alias("z")
        edges = sorted(set(rows.select(score).approxQuantile("z", [i / k for i in range(1, k)], 0.001)))
    blocks = _blocks(len(w), n)

    def scored(t, i: int):
        x = list(t.column("x")[i].values.to_numpy(zero_copy_only=False).reshape(-1, many).T)
        return lambda block: weighted_sums(x, w[block.start : block.stop])

    def summaries(own: pa.Table, weighted: pa.Table) -> pa.Table:
        ranks = n + 1 - _ascending(weighted, scored(own, 0), blocks, edges)
        numbers = {"mean": ranks.mean(1), "std": ranks.std(1), "lo": ranks.min(1), "hi": ranks.max(1)}
        return pa.table({key: own.column("keys").combine_chunks().flatten()} | numbers)

    ranked = _weighted_ranks(chunks, n, len(w), scored, edges)
    schema = f"`{key}` {wide.schema[key].dataType.simpleString()}, mean double, std double, lo double, hi double"
    return chunks.groupBy("chunk").cogroup(ranked.groupBy("chunk")).applyInArrow(summaries, schema)


def _quantiles(ordered: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Of the first n numbers of every ordered row, linear between them."""
    place = np.maximum(n - 1, 0) * p
    low = np.floor(place).astype(int)
    a, b = (np.take_along_axis(ordered, i[:, None], 1)[:, 0] for i in (low, np.ceil(place).astype(int)))
    return a + (b - a) * (place - low)


STATISTICS = ("bootstrap_rank", "bootstrap_std", "bayesian_rank", "bayesian_std", "consensus_rank", "rank_std", "bootstrap_lower", "bootstrap_upper", "ci_lower", "ci_upper")


def intervals(scores: DataFrame, replicates: int, seed: int, key: str = "entity_id") -> DataFrame:
    """Rank intervals of scores (key, score), missing ones filled with the median; entities that fewer than LEAST replicates draw are left out.

    (key, original_rank, bootstrap and bayesian mean and deviation, their 2.5 and 97.5 pct quantiles for the bootstrap, consensus over both with deviation,
    interval and its width, flags of stability)."""
    middle = medians(scores, [], "score", "_median")  # one row
    filled = settled(scores.crossJoin(F.broadcast(middle)).select(key, F.coalesce("score", "_median").cast("double").alias("score")), "scores")
    n = filled.count()
    chunks = _chunks(filled, key)
    edges: list[float] = []
    if n > RANGE:
        one = filled.select((F.col("score") * -F.log(F.greatest(uniform(F.lit(seed + 17), F.lit(0), F.col(key)), F.lit(1e-12)))).alias("z"))
        k = -(-n // RANGE)
        edges = sorted(set(one.approxQuantile("z", [i / k for i in range(1, k)], 0.001)))
    blocks = _blocks(replicates, n)

    def scored(t, i: int):
        v, ids = t.column("scores")[i].values.to_numpy(zero_copy_only=False), t.column("ids")[i].as_py()
        return lambda block: _exponential(v, ids, block, seed + 17)

    ranked = _weighted_ranks(chunks, n, replicates, scored, edges)

    def summaries(own: pa.Table, weighted: pa.Table) -> pa.Table:
        ids, v = own.column("ids")[0].as_py(), own.column("scores").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        d = _draws(ids, replicates, seed)
        names = ("before", "whole", "head_before", "head_whole", "tail_whole")
        a = _drawn_ranks(v, d, *[np.array(own.column(c)[0].as_py()) for c in names])
        original, a, m = a[:, -1], a[:, :-1], (d[:, :-1] > 0)
        b = n + 1 - _ascending(weighted, scored(own, 0), blocks, edges)
        size = m.sum(1)
        shown = np.sort(np.where(m, a, np.inf), axis=1)
        both = np.sort(np.concatenate([shown, b], axis=1), axis=1)

        def moments(x: np.ndarray, count: np.ndarray):
            inside = np.arange(x.shape[1]) < count[:, None]
            mean = np.where(inside, x, 0.0).sum(1) / np.maximum(count, 1)
            return mean, np.sqrt((np.where(inside, x - mean[:, None], 0.0) ** 2).sum(1) / np.maximum(count, 1))

        whole = size + replicates
        numbers = [*moments(shown, size), *moments(b, np.full(len(b), replicates)), *moments(both, whole)]
        numbers += [_quantiles(x, c, p) for x, c in ((shown, size), (both, whole)) for p in (0.025, 0.975)]
        out = pa.table({key: own.column("keys").combine_chunks().flatten(), "original_rank": original, "n_drawn": size.astype(np.int32)} | dict(zip(STATISTICS, numbers, strict=True)))
        return out.filter(pa.array(size >= LEAST))

    schema = f"{key} {filled.schema[key].dataType.simpleString()}, original_rank double, n_drawn int, {', '.join(f'{c} double' for c in STATISTICS)}"
    out = settled(chunks.join(_borders(chunks, lambda ids: _draws(ids, replicates, seed)), "chunk").groupBy("chunk").cogroup(ranked.groupBy("chunk")).applyInArrow(summaries, schema), "ranks")
    width = F.col("ci_upper") - F.col("ci_lower")
    return out.select(
        "*", width.alias("ci_width"), (F.col("bootstrap_std") < STEADY).alias("stable"), (F.col("bootstrap_std") < RELAXED * n).alias("stable_relaxed"),
        (width < STRICT * n).alias("stable_strict"), (width < MODERATE * n).alias("stable_moderate"),
    )
