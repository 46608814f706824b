"""N-gram Jaccard self-join with a count-vector R-tree, and the classes that its links make.

A text's set is that of its distinct 5-word shingles as 64-bit hashes (words part at white space, A-Z lower-cased;
a text of fewer words is one shingle). Two texts link when their sets' Jaccard similarity is ``PERCENT``/100 or more.

1. Texts with equal sets meet by a 128-bit key of the set and go on as one node. The same pass counts the shingles of
   all texts in a sketch of fixed size, which puts every shingle into a level: 0, or higher the more frequent it is.
2. A pair that links shares one of the first ``n - ceil(0.8 n) + 1`` shingles of its sets (the prefix) in any fixed
   order; this one is by (level, hash), so passages that many texts share come last. Prefix shingles of one node only
   are dropped. Shingles of level 0 are few each, so they meet in one task; the others are spread by node.
3. Nodes around a prefix shingle are a group (groups of the same nodes count once). Shingles are hashed into dimensions,
   about as many as the set has shingles, and a node's counts are a point. An R-tree over a group's points bounds the
   overlap with a query by the summed minima of its counts and a box's largest counts. A group gives all pairs whose
   bound fits, or, where these are more than ``DENSE`` times its nodes, the likeliest partner of every node. Groups of
   more than ``LARGE`` nodes also give likeliest partners only, each node in its largest group, and are cut into tiles of
   ``TILE`` nodes, so no task takes a whole hot group.
4. Every node's likeliest partner is verified on the texts, and the links make first classes; in dense and large groups every node
   then gives its likeliest partner of another class, which is verified too, so that classes grow together. Last, all other pairs
   between classes are verified: those that step 3 gave, and those of a full search of dense and large groups,
   in which nodes outside the group's largest class are compared with all.
5. Components over all links give the classes. As every pair across classes that can link is verified in the end,
   no link between different texts is lost.

Null and empty texts, and those without words, have an empty set and link with nothing. Repeated rows (and rows with
repeated or null doc_ids) are in the class of their set; component_id is the smallest doc_id of the class, null where all
are null. Very long texts are cut into shingles in bounded segments. An empty table gives no rows. Other columns, whatever
their names, are carried along unread. The search within a group of unlike texts takes time quadratic in its size.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import sketches
from panelforge.llm.common import batch_rows, bounded_batches, packed, settled, text_key
from panelforge.llm.components import components
from panelforge.llm.text_kernels import Words, chunks, combine, mix

SHINGLE = 5
PERCENT = 80
#: Least and most dimensions of a point.
DIMENSIONS = (64, 4096)
#: Largest count that a point keeps in a dimension (4 bits).
MOST = 15
TILE = 2048
FANOUT = 16
DENSE = 4
LARGE = 256
#: Rounds of joining labels between searches; the last components are complete.
CLASS_ROUNDS = 3
#: Rows of a search block, and bytes of texts (by 7 for a shingle) of a verification block.
BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
#: Pairs of one node that meet in a verification block at most; more are spread over several.
HUB = 256
#: Rows of nodes and buckets that a broadcast carries at most (some 40 MB); more are joined by a shuffle.
CARRIED_NODES = 1_000_000
_U = np.uint64


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """The sorted distinct hashes of each text's shingles of ``size`` words."""
    for _, data, offsets in chunks(texts):
        w = Words(data, offsets)
        h = w.hashes()
        n = len(h) - size + 1
        grams = combine([h[k : k + n] for k in range(size)], size) if n > 0 else np.zeros(0, np.uint64)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield combine([h[k : k + 1] for k in range(a, b)], int(100 + b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128-bit key of a set, whatever its order."""
    return tuple(int(mix(s + _U(c)).sum(dtype=np.uint64).view(np.int64)) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def prefix(s: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a sorted set of which every linked set shares one, and the level of each."""
    own = level[sketches.place(s)]
    size = len(s) - -(-PERCENT * len(s) // 100) + 1
    order = np.argsort(own, kind="stable")[:size]
    return s[order], own[order]


def point(s: np.ndarray) -> bytes:
    """Counts of a set's shingles by dimension, two to a byte: dimension d in the lower half of byte d, d + half in the upper."""
    size = DIMENSIONS[0]
    while size < min(len(s), DIMENSIONS[1]):
        size *= 2
    counts = np.minimum(np.bincount((s & _U(size - 1)).astype(np.int64), minlength=size), MOST).astype(np.uint8)
    return (counts[: size // 2] | counts[size // 2 :] << 4).tobytes()


class Points:
    """Unpacked points of one number of dimensions, from rows that have as many or twice as many; ``rest``: shingles that the counts leave out."""

    def __init__(self, packed_points: list[bytes], rows: np.ndarray, sizes: np.ndarray, dimensions: int):
        self.rows = rows
        self.place = np.full(len(packed_points), -1, np.int64)
        self.place[rows] = np.arange(len(rows))
        self.counts = np.empty((len(rows), dimensions), np.uint8)
        wide = np.array([2 * len(packed_points[r]) for r in rows]) > dimensions
        for at, folded in ((np.flatnonzero(~wide), False), (np.flatnonzero(wide), True)):
            if len(at):
                raw = np.frombuffer(b"".join(packed_points[r] for r in rows[at]), np.uint8).reshape(len(at), -1)
                self.counts[at] = (raw & 15) + (raw >> 4) if folded else np.concatenate([raw & 15, raw >> 4], 1)
        self.sizes = sizes[rows]
        self.rest = self.sizes - self.counts.sum(1, dtype=np.int64)


def overlap_bounds(a: np.ndarray, rest_a: np.ndarray, b: np.ndarray, rest_b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of rows of points, and what the counts that they leave out may add."""
    return np.minimum(a, b).sum(1, dtype=np.int64) + np.minimum(rest_a, rest_b)


def coarse(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points in the least number of dimensions, and what their counts leave out."""
    few = np.minimum(points.reshape(len(points), -1, DIMENSIONS[0]).sum(1, dtype=np.int32), 255).astype(np.uint8)
    return few, sizes - few.sum(1, dtype=np.int64)


def _reaches(bound: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (100 + PERCENT) * bound >= PERCENT * (n + m)


class CountTree:
    """R-tree over count vectors in order of set size; inner nodes keep the largest counts and the range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rest: np.ndarray | None = None):
        rest = sizes - points.sum(1, dtype=np.int64) if rest is None else rest
        self.order = np.lexsort((points.argmax(1), sizes))
        level = (points[self.order], rest[self.order], *coarse(points[self.order], sizes[self.order]), sizes[self.order], sizes[self.order])
        self.levels = [level]
        while len(level[0]) > FANOUT:
            cut = np.arange(0, len(level[0]), FANOUT)
            level = tuple(f.reduceat(x, cut) for f, x in zip((*[np.maximum] * 4, np.minimum, np.maximum), level, strict=True))
            self.levels.append(level)

    def search(self, queries: np.ndarray, sizes: np.ndarray, rest: np.ndarray | None = None, batch: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, bound) of pairs whose bound reaches the overlap that a link needs."""
        rest = sizes - queries.sum(1, dtype=np.int64) if rest is None else rest
        found = []
        for lo in range(0, len(queries), batch):
            q_points, q_rest, q_sizes = queries[lo : lo + batch], rest[lo : lo + batch], sizes[lo : lo + batch]
            q_coarse, q_coarse_rest = coarse(q_points, q_sizes)
            q = np.repeat(np.arange(len(q_points)), len(self.levels[-1][0]))
            node = np.tile(np.arange(len(self.levels[-1][0])), len(q_points))
            for level in range(len(self.levels) - 1, -1, -1):
                high, high_rest, high_coarse, high_coarse_rest, least, most = self.levels[level]
                n = q_sizes[q]
                near = (100 * most[node] >= PERCENT * n) & (PERCENT * least[node] <= 100 * n)
                q, node = q[near], node[near]
                # Few dimensions first, all of them for what these leave.
                for ours, our_rest, theirs, their_rest in ((q_coarse, q_coarse_rest, high_coarse, high_coarse_rest), (q_points, q_rest, high, high_rest)):
                    bound = np.zeros(len(q), np.int64)
                    step = max(1, (1 << 21) // ours.shape[1])
                    for at in range(0, len(q), step):
                        x, y = q[at : at + step], node[at : at + step]
                        bound[at : at + step] = overlap_bounds(ours[x], our_rest[x], theirs[y], their_rest[y])
                    keep = _reaches(bound, q_sizes[q], np.maximum(least[node], -(-PERCENT * q_sizes[q] // 100)))
                    q, node, bound = q[keep], node[keep], bound[keep]
                if level:
                    below = len(self.levels[level - 1][0])
                    q, node = np.repeat(q, FANOUT), (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    q, node = q[node < below], node[node < below]
            found.append((q + lo, self.order[node], bound))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


_NODE = [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("k1", "k2", "h1", "h2", "n")], ("point", pa.binary()), ("sketch", pa.list_(pa.int32()))]


def _node_rows(batches):
    """doc_id, k1, k2, text in; each text's own key, its set's key, size and point out, and a last row (n -1) with the task's sketch."""
    schema = pa.schema(_NODE)
    sketch = np.zeros(sketches.SKETCH, np.int64)
    for b in batches:
        keys, sizes, points, places = [], [], [], [np.zeros(0, np.int64)]
        for s in shingle_sets(b.column("text")):
            keys.append(set_key(s))
            sizes.append(len(s))
            points.append(point(s))
            places.append(sketches.place(s))
        sketch += np.bincount(np.concatenate(places), minlength=sketches.SKETCH)
        h = np.array(keys, np.int64).reshape(-1, 2)
        columns = [pa.array(x, pa.int64()) for x in (h[:, 0], h[:, 1], sizes)]
        own = [b.column(c).cast(pa.int64()) for c in ("doc_id", "k1", "k2")]
        yield pa.RecordBatch.from_arrays([*own, *columns, pa.array(points, pa.binary()), pa.nulls(len(sizes), schema.field("sketch").type)], schema=schema)
    if sketch.any():
        row = {"n": -1, "sketch": sketches.as_row(sketch)}
        yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in schema], schema=schema)


def _gathered(batches, rows: int = 1 << 15):
    """Fewer, larger batches."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _prefixes(batches, level: np.ndarray):
    """(sig, h1, hot) for each prefix shingle of each text; copies in a task count once."""
    seen = set()
    for b in batches:
        for s in shingle_sets(b.column("text")):
            if len(s) and (key := set_key(s)) not in seen:
                seen.add(key)
                sig, own = prefix(s, level)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.full(len(sig), key[0])), pa.array(own > 0)], ["sig", "h1", "hot"])


def _shared(batches):
    """Rows (sig, h1, hot), sorted, in; distinct (sig, h1) out, without those that are alone with a sig that is not hot."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    for b in itertools.chain(_gathered(batches), [None]):
        if b is not None:
            own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "h1", "hot"))
            held = tuple(np.concatenate(x) for x in zip(held, own, strict=True))
        sig, h1, hot = held
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (h1[1:] != h1[:-1])
        sig, h1, hot = sig[new], h1[new], hot[new]
        # The last sig can go on in the next batch: its rows are held back, of a hot one the last row only.
        cut = len(sig)
        if b is not None and cut:
            cut = cut - 1 if hot[-1] else int(np.searchsorted(sig, sig[-1]))
        held = (sig[cut:], h1[cut:], hot[cut:])
        sig, h1, keep = sig[:cut], h1[:cut], hot[:cut].copy()
        same = sig[1:] == sig[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(h1[keep])], ["sig", "h1"])


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64()), ("dense", pa.int64())])


def _dimensions(packed_points: list[bytes]) -> np.ndarray:
    return np.array([2 * len(p) for p in packed_points], np.int64)


def _tables(packed_points: list[bytes], sizes: np.ndarray, dims: np.ndarray) -> dict[int, Points]:
    """For every number of dimensions, the points that have as many or twice as many."""
    return {int(d): Points(packed_points, np.flatnonzero((dims == d) | (dims == 2 * d)), sizes, int(d)) for d in np.unique(dims)}


def _pairs_within(rows: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of the same small group; a group is ``count`` rows from ``first`` on."""
    left, right = [], []
    for k in range(1, int(count.max()) if len(count) else 0):
        # Row i of a group meets row i + k.
        many = np.maximum(count - k, 0)
        at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        left.append(rows[at])
        right.append(rows[at + k])
    return (np.concatenate(left), np.concatenate(right)) if left else (rows[:0], rows[:0])


def _bounded(a: np.ndarray, b: np.ndarray, dims: np.ndarray, n: np.ndarray, tables: dict[int, Points]) -> np.ndarray:
    """The bound on the overlap of each pair of rows, -1 where the sizes alone part them."""
    bound = np.full(len(a), -1, np.int64)
    near = (100 * n[a] >= PERCENT * n[b]) & (100 * n[b] >= PERCENT * n[a])
    least = np.minimum(dims[a], dims[b])
    for d, t in tables.items():
        at = np.flatnonzero(near & (least == d))
        for lo in range(0, len(at), step := max(1, (1 << 21) // d)):
            some = at[lo : lo + step]
            x, y = t.place[a[some]], t.place[b[some]]
            bound[some] = overlap_bounds(t.counts[x], t.rest[x], t.counts[y], t.rest[y])
    return bound


def _tree_pairs(inner: np.ndarray, outer: np.ndarray, dims: np.ndarray, n: np.ndarray, tables: dict[int, Points]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inner row, outer row, bound) of the pairs that trees over the inner rows find."""
    found = []
    for gi in np.unique(dims[inner]):
        for go in np.unique(dims[outer]):
            x, y = inner[dims[inner] == gi], outer[dims[outer] == go]
            if max(gi, go) > 2 * min(gi, go) or 100 * n[x].max() < PERCENT * n[y].min() or 100 * n[y].max() < PERCENT * n[x].min():
                continue
            t = tables[int(min(gi, go))]
            px, py = t.place[x], t.place[y]
            q, p, bound = CountTree(t.counts[px], n[x], t.rest[px]).search(t.counts[py], n[y], t.rest[py])
            found.append((x[p], y[q], bound))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (inner[:0], inner[:0], inner[:0])


def _search(block: pa.Table, most: float, large: int) -> pa.Table:
    """Candidate pairs (a < b) in the groups (sig, tile) of a block; for a dense group, of more than ``most`` pairs a row, every row's likeliest partner, and a row
    that names it; the likeliest partners alone for groups of more than ``large`` nodes (column size)."""
    sig, tile, h1, n, nodes = (block.column(c).to_numpy() for c in ("sig", "tile", "h1", "n", "size"))
    raw = block.column("point").to_pylist()
    dims = _dimensions(raw)
    tables = _tables(raw, n, dims)
    by = np.lexsort((h1, tile, sig))
    new = np.ones(len(by), bool)
    new[1:] = (sig[by][1:] != sig[by][:-1]) | (tile[by][1:] != tile[by][:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(by)))
    small = count <= FANOUT
    a, b = _pairs_within(by, first[small], count[small])
    bound = _bounded(a, b, dims, n, tables)
    fits = (bound >= 0) & _reaches(bound, n[a], n[b])
    found, dense = [(a[fits], b[fits], bound[fits])], []
    for lo, size in zip(first[~small], count[~small], strict=True):
        own = by[lo : lo + size]
        a, b, bound = _tree_pairs(own, own, dims, n, tables)
        once = h1[a] < h1[b]
        x, y, near = a[once], b[once], bound[once]
        wide = nodes[own[0]] > large
        if wide or len(x) > most * size:
            if not wide:
                dense.append(sig[own[0]])
            other = a != b
            x, y, near = _likeliest(a[other], b[other], bound[other], n, h1)
        found.append((x, y, near))
    return _as_pairs(found, dense, n, h1)


def _likeliest(a: np.ndarray, b: np.ndarray, bound: np.ndarray, n: np.ndarray, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every b the pair with the largest bound on the similarity."""
    order = np.lexsort((h1[a], -bound / (n[a] + n[b] - bound), b))
    a, b, bound = a[order], b[order], bound[order]
    best = np.ones(len(b), bool)
    best[1:] = b[1:] != b[:-1]
    return a[best], b[best], bound[best]


def _as_pairs(found: list[tuple], dense: list[int], n: np.ndarray, h1: np.ndarray) -> pa.Table:
    """Distinct pairs of rows (a, b, bound) with their score, and the names of dense groups."""
    none = np.zeros(0, np.int64)
    a, b, bound = (np.concatenate(x) for x in zip((none, none, none), *found, strict=True))
    one, two, score = np.minimum(h1[a], h1[b]), np.maximum(h1[a], h1[b]), bound / np.maximum(n[a] + n[b] - bound, 1)
    _, once = np.unique(np.column_stack([one, two]), axis=0, return_index=True)
    rows = pa.table([one[once], two[once], score[once], pa.nulls(len(once), pa.int64())], schema=_PAIRS)
    marks = pa.table([pa.nulls(len(dense), pa.int64())] * 2 + [pa.nulls(len(dense), pa.float64()), pa.array(dense, pa.int64())], schema=_PAIRS)
    return pa.concat_tables([rows, marks])


def _search_across(block: pa.Table, most: float) -> pa.Table:
    """Candidate pairs (a < b) of different classes, one of them an inner row, in the groups (sig, i, j) of a block; for a dense group, of more
    than ``most`` pairs a row, every row's likeliest partner, and a row that names it."""
    sig, i, j, h1, comp, n, inner = (block.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "i", "j", "h1", "comp", "n", "inner"))
    raw = block.column("point").to_pylist()
    dims = _dimensions(raw)
    tables = _tables(raw, n, dims)
    by = np.lexsort((h1, j, i, sig))
    new = np.ones(len(by), bool)
    new[1:] = (sig[by][1:] != sig[by][:-1]) | (i[by][1:] != i[by][:-1]) | (j[by][1:] != j[by][:-1])
    first = np.flatnonzero(new)
    found, dense = [], []
    for lo, hi in zip(first, np.append(first[1:], len(by)), strict=True):
        own = by[lo:hi]
        a, b, bound = _tree_pairs(own[inner[own]], own[~inner[own]], dims, n, tables)
        apart = comp[a] != comp[b]
        a, b, bound = a[apart], b[apart], bound[apart]
        if len(a) > most * len(own):
            dense.append(sig[own[0]])
            found.append(_likeliest(a, b, bound, n, h1))
            a, b, bound = _likeliest(b, a, bound, n, h1)
        found.append((a, b, bound))
    return _as_pairs(found, dense, n, h1)


def once(batches):
    """Rows (block, h1, h2, text) without those that the task has already given."""
    seen = set()
    for b in batches:
        keep = []
        for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in ("block", "h1", "h2")), strict=True)):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        yield b.take(pa.array(keep, pa.int64()))


_LINK = pa.schema([(c, pa.int64()) for c in ("a1", "a2", "b1", "b2")])


def _linked(pairs: pa.Table, texts: pa.Table, size: int) -> pa.Table:
    """Those of the pairs whose sets link."""
    at: dict[tuple, int] = {}
    for k, key in enumerate(zip(texts.column("h1").to_pylist(), texts.column("h2").to_pylist(), strict=True)):
        at.setdefault(key, k)
    rows = pa.array(list(at.values()), pa.int64())
    sets = dict(zip(at, shingle_sets(texts.column("text").take(rows), size), strict=True))
    ends = [pairs.column(c).to_pylist() for c in ("a", "a2", "b", "b2")]
    kept = []
    for k, (a, a2, b, b2) in enumerate(zip(*ends, strict=True)):
        x, y = sets[a, a2], sets[b, b2]
        both = len(np.intersect1d(x, y, assume_unique=True))
        if len(x) and 100 * both >= PERCENT * (len(x) + len(y) - both):
            kept.append(k)
    return pa.table([pairs.column(c).take(pa.array(kept, pa.int64())) for c in ("a", "a2", "b", "b2")], schema=_LINK)


def sent_texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(block, h1, h2, text) of the rows (k1, k2, block, h1, h2) of a settled table, a task giving each once."""
    wanted = F.broadcast(wanted) if wanted.count() <= CARRIED_NODES else wanted
    sent = documents.select("text", *text_key(F.col("text"))).join(wanted, ["k1", "k2"]).select("block", "h1", "h2", "text")
    return sent.mapInArrow(once, "block bigint, h1 bigint, h2 bigint, text string")


def verified(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Those of the distinct pairs (a, b: h1 of nodes) that link, as (a1, a2, b1, b2); nodes that share h1 are all tried.

    Pairs are dealt into buckets by the end with more pairs, and the text of a node goes once to each bucket that needs it. Shingles have ``size`` words.
    """
    side = lambda s: nodes.select(F.col("h1").alias(s), F.col("h2").alias(f"{s}2"), F.col("n").alias(f"{s}n"), F.col("key").alias(f"{s}k"))
    near = (100 * F.col("an") >= PERCENT * F.col("bn")) & (100 * F.col("bn") >= PERCENT * F.col("an"))
    many = pairs.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("pairs"))
    count = lambda s: many.select(F.col("end").alias(s), F.col("pairs").alias(f"{s}p"))
    sized = settled(pairs.join(count("a"), "a").join(count("b"), "b").join(side("a"), "a").join(side("b"), "b").where(near), "sized")
    shingles = sized.agg(F.sum(F.col("an") + F.col("bn"))).head()[0] or 0
    buckets = max(1, -(-7 * shingles // BLOCK_BYTES))
    first = F.col("ap") >= F.col("bp")
    hub, leaf, most = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a")), F.greatest("ap", "bp")
    bucket = F.pmod(F.xxhash64(hub, F.pmod(F.xxhash64(leaf, F.lit(11)), F.ceil(most / HUB))), F.lit(buckets)).alias("bucket")
    dealt = sized.select(bucket, "a", "a2", "b", "b2", "ak", "bk")
    end = lambda s: F.struct("bucket", F.col(s).alias("h1"), F.col(f"{s}2").alias("h2"), F.col(f"{s}k").alias("key"))
    wanted = dealt.select(F.explode(F.array(end("a"), end("b"))).alias("x")).select("x.*").distinct()
    texts = sent_texts(documents, settled(wanted.select("key.k1", "key.k2", F.col("bucket").alias("block"), "h1", "h2"), "wanted"))
    return dealt.select("bucket", "a", "a2", "b", "b2").groupBy("bucket").cogroup(texts.groupBy("block")).applyInArrow(lambda some, of: _linked(some, of, size), "a1 bigint, a2 bigint, b1 bigint, b2 bigint")


def _nodes(documents: DataFrame) -> DataFrame:
    """doc_id and node of every document (n at least 0), and rows that hold the sketch (n -1), settled."""
    schema = "doc_id bigint, k1 bigint, k2 bigint, h1 bigint, h2 bigint, n bigint, point binary, sketch array<int>"
    return settled(documents.select("doc_id", *text_key(F.col("text")), "text").mapInArrow(_node_rows, schema), "rows")


def _groups(documents: DataFrame, level: np.ndarray) -> DataFrame:
    """Distinct (sig, h1) of prefix shingles that several nodes share, settled."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(level)
    texts = documents.select("text").where("text is not null")
    placed = texts.mapInArrow(lambda it: _gathered(_prefixes(it, shared.value)), "sig bigint, h1 bigint, hot boolean")
    dealt = placed.repartition(F.when(F.col("hot"), F.xxhash64("sig", "h1")).otherwise(F.col("sig"))).sortWithinPartitions("sig", "h1")
    with batch_rows(spark, 1 << 15):
        return settled(dealt.mapInArrow(_shared, "sig bigint, h1 bigint"), "shared")


def _struct(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("h1"), F.col(b).alias("h2"))


def _joined_by(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of links (a1, a2, b1, b2)."""
    return components(links.select(_struct("a1", "a2").alias("a"), _struct("b1", "b2").alias("b")), rounds)


def _largest_only(members: DataFrame, large: int) -> DataFrame:
    """members (sig, h1, size) in which a node stands in one of its groups of more than ``large`` nodes only, the largest."""
    wide = members.where(F.col("size") > large)
    own = wide.groupBy("h1").agg(F.max(F.struct("size", "sig")).alias("own")).select("h1", F.col("own.sig").alias("sig"))
    return members.where(F.col("size") <= large).unionByName(wide.join(own, ["h1", "sig"]))


def _candidates(shared: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, score, dense) of the first search, settled, and (sig, size) of the groups, one of those with the same nodes."""
    marks = [F.bit_xor(F.xxhash64("h1", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    groups = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), *marks).where("size > 1")
    groups = settled(groups.groupBy("size", "x1", "x2").agg(F.min("sig").alias("sig")).select("sig", "size"), "groups")
    rows = groups.agg(F.sum("size")).head()[0] or 0
    blocks = max(1, -(-rows // BLOCK_ROWS))
    most, large = DENSE, LARGE
    inside = _largest_only(settled(shared.join(groups, "sig"), "inside"), large).join(points, "h1")
    tile = F.pmod(F.xxhash64("h1", F.lit(5)), F.ceil(F.col("size") / TILE)).alias("tile")
    dealt = inside.select("sig", "size", "h1", "n", "point", tile).withColumn("block", F.pmod(F.xxhash64("sig", "tile"), F.lit(blocks)))
    found = dealt.groupBy("block").applyInArrow(lambda block: _search(block, most, large), "a bigint, b bigint, score double, dense bigint")
    return settled(found, "candidates"), groups


def _across(shared: DataFrame, points: DataFrame, of: DataFrame, again: DataFrame, likeliest: bool) -> DataFrame:
    """(a, b) of pairs of different classes in some groups (sig, size), settled: all whose bound fits, or every node's likeliest in its largest group."""
    most = -1.0 if likeliest else float("inf")
    inside = shared.join(again, "sig")
    inside = _largest_only(settled(inside, "inside"), 0) if likeliest else inside
    member = settled(inside.join(of, "h1", "left").select("sig", "h1", "size", F.coalesce("component", "h1").alias("comp")), "members")
    by_class = member.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("many"), F.first("size").alias("size"))
    largest = by_class.groupBy("sig").agg(F.max(F.struct("many", "comp")).alias("top"), F.first("size").alias("size"))
    mixed = largest.select("sig", F.col("top.comp").alias("main"), (F.col("size") - F.col("top.many")).alias("others"), F.col("size").alias("all")).where("others > 0")
    inner, outer = F.ceil(F.col("others") / TILE), F.ceil(F.col("all") / TILE)
    rows = mixed.agg(F.sum(F.col("all") * inner + F.col("others") * outer)).head()[0] or 0
    blocks = max(1, -(-rows // BLOCK_ROWS))
    inside = member.join(mixed, "sig").join(points, "h1")
    numbers = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    i, j = F.pmod(F.xxhash64("h1", F.lit(9)), inner), F.pmod(F.xxhash64("h1", F.lit(5)), outer)
    cell = lambda i, j, inside: F.struct(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), F.lit(inside).alias("inner"))
    as_outer = F.transform(numbers(inner), lambda x: cell(x, j, False))
    as_inner = F.when(F.col("comp") != F.col("main"), F.transform(numbers(outer), lambda x: cell(i, x, True)))
    cells = F.explode(F.concat(as_outer, F.coalesce(as_inner, F.array().cast("array<struct<i:bigint,j:bigint,inner:boolean>>"))))
    dealt = inside.select("sig", "h1", "comp", "n", "point", cells.alias("cell")).select("sig", "h1", "comp", "n", "point", "cell.*")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("sig", "i", "j"), F.lit(blocks)))
    found = dealt.groupBy("block").applyInArrow(lambda block: _search_across(block, most), "a bigint, b bigint, score double, dense bigint")
    return settled(found.where("a is not null").select("a", "b"), "across")


def first_classes(links: DataFrame) -> DataFrame:
    """(h1, component) of the nodes that links join; parts of a class that are far apart can still have different labels."""
    return settled(_joined_by(links, CLASS_ROUNDS).select(F.col("node.h1").alias("h1"), F.col("component.h1").alias("component")).dropDuplicates(["h1"]), "first")


def classes(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(h1, h2, c1, c2, component_id) for every non-empty set of the documents, whose nodes are ``rows``: the smallest set and doc_id of its class."""
    own = rows.where("n > 0")
    nodes = settled(own.groupBy("h1", "h2").agg(F.min("doc_id").alias("label"), F.max("n").alias("n"), F.min(F.struct("k1", "k2")).alias("key")), "nodes")
    shared = _groups(documents, sketches.summed_levels(rows.where("n < 0")))
    # Keys that differ in their second half only are too rare to search by: their groups go on whole.
    twins = settled(nodes.groupBy("h1").count().where("count > 1").select("h1"), "twins")
    points = own.select("h1", "n", "point").dropDuplicates(["h1"]).join(F.broadcast(twins), "h1", "left_anti")
    found, groups = _candidates(shared, points)
    pairs = found.where("a is not null")
    likeliest = lambda x, y: pairs.select(F.col(x).alias("node"), F.struct("score", F.col(y).alias("other")).alias("to"))
    best = likeliest("a", "b").union(likeliest("b", "a")).groupBy("node").agg(F.max("to").alias("to"))
    ends = best.select(F.least("node", "to.other").alias("a"), F.greatest("node", "to.other").alias("b"))
    tested = settled(ends.distinct(), "tested")
    links = settled(verified(tested, nodes, documents), "links")
    of = first_classes(links)
    marked = found.where("dense is not null").select(F.col("dense").alias("sig"), F.lit(True).alias("marked")).distinct()
    again = settled(groups.join(marked, "sig", "left").where(F.col("marked") | (F.col("size") > min(LARGE, TILE))).select("sig", "size"), "again")
    there = not again.isEmpty()
    if there:
        likely = settled(_across(shared, points, of, again, True).distinct().join(tested, ["a", "b"], "left_anti"), "likely")
        links, tested = settled(links.union(verified(likely, nodes, documents)), "links"), tested.union(likely)
        of = first_classes(links)
    class_of = lambda s: of.select(F.col("h1").alias(s), F.col("component").alias(f"{s}c"))
    apart = F.coalesce("ac", "a") != F.coalesce("bc", "b")
    more = pairs.select("a", "b").join(class_of("a"), "a", "left").join(class_of("b"), "b", "left").where(apart).select("a", "b")
    mates = shared.join(shared.join(F.broadcast(twins), "h1").select("sig", F.col("h1").alias("twin")), "sig").where("h1 <> twin")
    more = more.union(mates.select(F.least("h1", "twin").alias("a"), F.greatest("h1", "twin").alias("b")))
    if there:
        more = more.union(_across(shared, points, of, again, False))
    more = settled(more.distinct().join(tested, ["a", "b"], "left_anti"), "more")
    links = settled(links.union(verified(more, nodes, documents)), "links")
    return named(nodes, links)


def named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(h1, h2, c1, c2, component_id) of all nodes (h1, h2, label): the smallest node and the smallest label of what links (a1, a2, b1, b2) join."""
    of = settled(_joined_by(links).select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), "component"), "components")
    own = nodes.select("h1", "h2", "label").join(of, ["h1", "h2"], "left")
    least = settled(own.where("component is not null").groupBy("component").agg(F.min("label").alias("least")), "least")
    first = [F.coalesce(f"component.h{k}", f"h{k}").alias(f"c{k}") for k in (1, 2)]
    return settled(own.join(least, "component", "left").select("h1", "h2", *first, F.coalesce("least", "label").alias("component_id")), "classes")


def joined(documents: DataFrame) -> DataFrame:
    """(row, k1, k2, c1, c2, n, component_id): every document as a struct, keys of its text and of the smallest set of its class (null for an empty set), the
    size of its set and the smallest doc_id of its class (its own for an empty set)."""
    rows = _nodes(documents)
    keys = rows.where("n >= 0").groupBy("k1", "k2").agg(F.max("h1").alias("h1"), F.max("h2").alias("h2"), F.max("n").alias("n"))
    found = settled(keys.join(classes(documents, rows), ["h1", "h2"], "left").select("k1", "k2", "c1", "c2", "n", "component_id"), "found")
    both = documents.select(packed(documents).alias("row"), *text_key(F.col("text"))).join(found, ["k1", "k2"], "left")
    return both.select("row", "k1", "k2", "c1", "c2", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("row.doc_id")).alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and class of every document."""
    bounded_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = _nodes(documents)
    found = rows.where("n >= 0").select("doc_id", "h1", "h2", "n").join(classes(documents, rows), ["h1", "h2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
