"""Near duplicates by MinHash: banded candidates, sequential Bayesian tests on signatures, exact verification, classes.

A text's set is that of its distinct 4-word shingles (words part at white space, A-Z lower-cased; a text of fewer words is one shingle). Two texts link
when their sets' Jaccard similarity is 80/100 or more.

1. Texts with equal sets meet by a 128-bit key of the set and go on as one node, with ``BANDS`` * ``ROWS`` minima of hash functions.
2. Nodes that agree in all minima of a band share a bucket (buckets of the same nodes count once). A pair at the threshold shares none with a probability of
   (1 - 0.8**6)**56, about 4e-8.
3. A candidate pair is compared in batches of ``BATCH`` minima. After n of them with m equal, the posterior probability that the similarity reaches the
   threshold (flat prior) is that of at most m successes in n + 1 draws; a pair for which it is below ``MISS`` is dropped. So a pair at the
   threshold is lost with a probability of at most MISS a batch, and most others go after the first.
4. What is left is verified on the full sets, from the texts.

Pairs within a class are not all needed. Every bucket first gives a star: all its nodes against one of them, then, while the pairs of different classes that
buckets hold are more than ``SEARCHED`` for each of their nodes, stars around others; last, all pairs of different classes in a bucket, in tiles that hold texts of nodes whose first minima meet another class, each pair in the first bucket that it
shares. A tile verifies what the batches leave and joins classes as it goes, so it gives a link for each joining and no pairs. So all candidates whose
ends end up in different classes are tested, and a bucket of near copies of any size costs a few pairs a node. Nodes of a bucket that link with nothing are
compared with all of it, in time quadratic in their number.

Null and empty texts, and those without words, have an empty set and link with nothing. Repeated rows (and rows with repeated or null doc_ids) are in
the class of their set; component_id is the smallest doc_id of the class, null where all are null (then all of them are kept). Ties between centres of
stars are settled by a hash. Very long texts are cut into shingles in bounded segments. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import ngram_join
from panelforge.llm.common import batch_rows, bounded_batches, settled, text_key
from panelforge.llm.text_kernels import combine

SHINGLE = 4
BANDS, ROWS = 56, 6
BATCH = 48
MISS = 1e-7
#: Minima by which tiles first tell the nodes that meet another class; only the texts of these are sent.
FIRST = 3 * BATCH
#: Stars at most before the pairs that are left are compared in tiles, and pairs for each node of a bucket that are compared so without a further star.
STARS = 4
SEARCHED = 1000
#: A bucket or node with more than this part of all rows (there are fewer such than this) is broadcast or spread over places of HUB rows.
CARRIED = 10_000
HUB = 4096
#: Shingles that are hashed together.
TOGETHER = 1 << 16
_U = np.uint32
_draws = np.random.default_rng(1997).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
_FACTORS, _TERMS = _draws[0] | _U(1), _draws[1]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each hash function over each set (not empty)."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), len(_FACTORS)), np.uint32)
    for k, (a, b) in enumerate(zip(_FACTORS, _TERMS, strict=True)):
        out[:, k] = np.minimum.reduceat(x * a + b, first)
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """64-bit key of every band of every row of minima."""
    rows = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    number = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    return combine([number.ravel(), *(rows[:, :, k].ravel() for k in range(ROWS))], SHINGLE).reshape(len(least), BANDS)


def signature(least: np.ndarray) -> np.ndarray:
    """A byte of each minimum: minima that differ agree in it once in 256 times, which can only keep a pair longer."""
    return ((least ^ least >> 15) * _U(0x2C1B3C6D) >> 24).astype(np.uint8)


def least_equal(threshold: float = ngram_join.PERCENT / 100, miss: float = MISS) -> np.ndarray:
    """After each number of compared minima, how many must be equal so that the threshold is reached with a posterior probability of ``miss``."""
    out = []
    for n in range(BANDS * ROWS + 1):
        p, m = (1 - threshold) ** (n + 1), 0
        while p < miss:
            m += 1
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


_LEAST = least_equal()


def survivors(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, equal: np.ndarray | None = None, done: int = 0) -> np.ndarray:
    """Which pairs (rows left of a, rows right of b) no batch drops; equal: minima that agree among the ``done`` first."""
    at = np.arange(len(left))
    equal = np.zeros(len(left), np.int64) if equal is None else equal
    for lo in range(done, a.shape[1], BATCH):
        hi = min(lo + BATCH, a.shape[1])
        step = max(1, (1 << 24) // BATCH)
        for k in range(0, len(at), step):
            some = at[k : k + step]
            equal[some] += (a[left[some], lo:hi] == b[right[some], lo:hi]).sum(1)
        at = at[equal[at] >= _LEAST[hi]]
    return at


def _near(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (100 * n >= ngram_join.PERCENT * m) & (100 * m >= ngram_join.PERCENT * n)


def _measured(sets: list[np.ndarray], which: list[int]):
    """(numbers, signatures, band keys) of the named sets (not empty), about TOGETHER shingles at a time."""
    while len(which):
        size = np.cumsum([len(sets[k]) for k in which])
        some, which = np.split(np.array(which), [max(1, int(np.searchsorted(size, TOGETHER)))])
        least = minima([sets[k] for k in some])
        yield some, signature(least), bands(least).view(np.int64)


_NODE = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "k1", "k2", "h1", "h2", "n")], ("point", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _node_rows(batches):
    """doc_id, k1, k2, text in; each text's own key, its set's key and size out, with signature and bands where the task has not seen the set before."""
    seen: set[tuple] = set()
    for b in batches:
        sets = list(ngram_join.shingle_sets(b.column("text"), SHINGLE))
        keys = [ngram_join.set_key(s) for s in sets]
        new = []
        for k, (s, key) in enumerate(zip(sets, keys, strict=True)):
            if len(s) and key not in seen:
                seen.add(key)
                new.append(k)
        points, places = [None] * len(sets), [None] * len(sets)
        for some, own, key in _measured(sets, new):
            for k, x, y in zip(some, own, key, strict=True):
                points[k], places[k] = x.tobytes(), y
        h = np.array(keys, np.int64).reshape(-1, 2)
        columns = [pa.array(x, pa.int64()) for x in (h[:, 0], h[:, 1], [len(s) for s in sets])]
        own = [b.column(c).cast(pa.int64()) for c in ("doc_id", "k1", "k2")]
        yield pa.RecordBatch.from_arrays([*own, *columns, pa.array(points, pa.binary()), pa.array(places, pa.list_(pa.int64()))], schema=_NODE)


def _points(raw: pa.ChunkedArray, width: int = BANDS * ROWS) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, width)


def _sifted(batches):
    """Rows (a, b, an, bn, a_point, b_point) in, the pairs that sizes and batches of minima leave out."""
    for batch in batches:
        near = np.flatnonzero(_near(batch.column("an").to_numpy(), batch.column("bn").to_numpy()))
        if len(near):
            kept = near[survivors(_points(batch.column("a_point")), _points(batch.column("b_point")), near, near)]
            yield batch.select(["a", "b"]).take(pa.array(kept))


def _shared_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest band key that each pair of rows shares: the bucket in which the pair is compared."""
    return np.where(a == b, a, np.iinfo(np.int64).max).min(1)


def _overlaps(x: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many members each set shares with the sorted set x."""
    every = np.concatenate(sets)
    at = np.minimum(np.searchsorted(x, every), len(x) - 1)
    return np.add.reduceat((x[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]))


def _tiles(sig: np.ndarray, i: np.ndarray, j: np.ndarray, h1: np.ndarray):
    """Row numbers of each tile (sig, i, j) of a block."""
    by = np.lexsort((h1, j, i, sig))
    new = np.ones(len(by), bool)
    new[1:] = (sig[by][1:] != sig[by][:-1]) | (i[by][1:] != i[by][:-1]) | (j[by][1:] != j[by][:-1])
    first = np.flatnonzero(new)
    for lo, hi in zip(first, np.append(first[1:], len(by)), strict=True):
        yield by[lo:hi]


def _met(point: np.ndarray, theirs: np.ndarray, apart: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """Which of a tile's outer rows are of another class, near in size and not left out by minima."""
    at = np.flatnonzero(apart & _near(sizes, size))
    return at[survivors(point[None], theirs, np.zeros(len(at), np.int64), at)]


def _meeting(cells: pa.Table) -> pa.Table:
    """Those rows of the tiles of a block that meet a row of another class by their FIRST minima."""
    sig, i, j, h1, comp, n, inner = (cells.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "i", "j", "h1", "comp", "n", "inner"))
    points = _points(cells.column("point"), FIRST)
    kept = np.zeros(len(sig), bool)
    for own in _tiles(sig, i, j, h1):
        others, theirs = own[~inner[own]], points[own[~inner[own]]]
        for x in own[inner[own]]:
            at = others[_met(points[x], theirs, comp[others] != comp[x], n[others], n[x])]
            kept[at] = True
            kept[x] |= len(at) > 0
    return cells.select(["sig", "h1", "comp", "i", "j", "inner"]).filter(pa.array(kept))


_LINK = pa.schema([(c, pa.int64()) for c in ("a1", "a2", "b1", "b2")])


def _linked_across(cells: pa.Table, texts: pa.Table) -> pa.Table:
    """Links between classes in the tiles (sig, i, j) of a block: inner with outer rows that the batches of minima leave, verified on the sets; pairs of
    classes that the block has already joined are left out."""
    sig, i, j, h1, h2, comp, n, inner = (cells.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "i", "j", "h1", "h2", "comp", "n", "inner"))
    rows = {key: k for k, key in reversed(list(enumerate(zip(texts.column("h1").to_pylist(), texts.column("h2").to_pylist(), strict=True))))}
    sets = list(ngram_join.shingle_sets(texts.column("text").take(pa.array(list(rows.values()), pa.int64())), SHINGLE))
    measured = list(_measured(sets, list(range(len(sets)))))
    points, keys = (np.concatenate([m[k] for m in measured]) if measured else np.zeros((0, width), kind) for k, width, kind in ((1, BANDS * ROWS, np.uint8), (2, BANDS, np.int64)))
    number = {key: k for k, key in enumerate(rows)}
    at_set = np.array([number[key] for key in zip(h1.tolist(), h2.tolist(), strict=True)], np.int64)
    joined: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := joined.get(c, c)) != c:
            joined[c] = joined.get(up, up)
            c = up
        return c

    found = []
    for own in _tiles(sig, i, j, h1):
        others = own[~inner[own]]
        theirs = points[at_set[others]]
        for x in own[inner[own]]:
            at = others[_met(points[at_set[x]], theirs, comp[others] != comp[x], n[others], n[x])]
            at = at[_shared_least(keys[at_set[x]], keys[at_set[at]]) == sig[x]]
            at = at[[top(c) != top(comp[x]) for c in comp[at].tolist()]] if len(at) else at
            if not len(at):
                continue
            both = _overlaps(sets[at_set[x]], [sets[k] for k in at_set[at]])
            for y in at[100 * both >= ngram_join.PERCENT * (n[x] + n[at] - both)]:
                if (a := top(int(comp[x]))) != (b := top(int(comp[y]))):
                    joined[max(a, b)] = min(a, b)
                    found.append((h1[x], h2[x], h1[y], h2[y]))
    columns = np.array(found, np.int64).reshape(-1, 4).T
    return pa.table(list(map(pa.array, columns)), schema=_LINK)


def _across(members: DataFrame, marks: DataFrame, of: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (a1, a2, b1, b2) between nodes of different classes in the same bucket, so many that they join what all such links would join.

    A bucket's nodes outside its largest class (inner) meet all of its nodes (outer), in tiles of TILE of both: first with the first of their minima, which
    leave out nodes that meet nothing, then what is left with texts, from which a block has signatures again: a text is sent once a block, a signature never."""
    tile, block = ngram_join.TILE, ngram_join.BLOCK_ROWS
    classed = settled(members.join(of, "h1", "left").select("sig", "h1", F.coalesce("component", "h1").alias("comp")), "classed")
    by_class = classed.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("many"))
    largest = by_class.groupBy("sig").agg(F.max(F.struct("many", "comp")).alias("top"), F.sum("many").alias("size"))
    mixed = largest.select("sig", "size", F.col("top.comp").alias("main"), F.ceil((F.col("size") - F.col("top.many")) / tile).alias("is"), F.ceil(F.col("size") / tile).alias("js")).where("`is` > 0")
    mixed = settled(mixed, "mixed")
    total = classed.count()
    inside = _by_size(classed, mixed, "sig", total)
    numbers = lambda c: F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)
    i, j = F.pmod(F.xxhash64("h1", F.lit(9)), F.col("is")), F.pmod(F.xxhash64("h1", F.lit(5)), F.col("js"))
    cell = lambda i, j, inner: F.struct(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), F.lit(inner).alias("inner"))
    as_outer = F.transform(numbers("is"), lambda x: cell(x, j, False))
    as_inner = F.when(F.col("comp") != F.col("main"), F.transform(numbers("js"), lambda x: cell(i, x, True)))
    every = F.concat(as_outer, F.coalesce(as_inner, F.array().cast("array<struct<i:bigint,j:bigint,inner:boolean>>")))
    rows = settled(inside.select("sig", "h1", "comp", F.explode(every).alias("c")).select("sig", "h1", "comp", "c.*"), "cells")
    dealt_out = lambda rows: rows.withColumn("block", F.pmod(F.xxhash64("sig", "i", "j"), F.lit(max(1, -(-rows.count() // block)))))
    brief = marks.select("h1", "n", F.substring("point", 1, FIRST).alias("point"))
    met = dealt_out(rows).join(brief, "h1").groupBy("block").applyInArrow(_meeting, "sig bigint, h1 bigint, comp bigint, i bigint, j bigint, inner boolean")
    rows = dealt_out(settled(met, "met"))
    wanted = rows.select("block", "h1").distinct().join(nodes.select("h1", "h2", "key.k1", "key.k2"), "h1").select("k1", "k2", "block", "h1", "h2")
    texts = ngram_join.sent_texts(documents, settled(wanted, "wanted"))
    dealt = rows.join(nodes.select("h1", "h2", "n"), "h1").select("block", "sig", "i", "j", "inner", "h1", "h2", "comp", "n")
    return dealt.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(_linked_across, "a1 bigint, a2 bigint, b1 bigint, b2 bigint")


def _by_size(left: DataFrame, right: DataFrame, on: str, total: int) -> DataFrame:
    """left joined with right, which has one row a key and its ``size``, the number of left rows: the few large ones are broadcast."""
    large = F.col("size") * CARRIED > total
    heavy = F.broadcast(right.where(large))  # sizes add up to total, so fewer than CARRIED rows
    return left.join(heavy, on).unionByName(left.join(heavy.select(on), on, "left_anti").join(right.where(~large), on))


def _buckets(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig, h1) of the nodes of each bucket, and (sig, size) of the buckets, one of those with the same nodes, settled."""
    placed = marks.select(F.explode("bands").alias("sig"), "h1")
    counts = settled(placed.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "counts")
    total = counts.agg(F.sum("size")).head()[0] or 0
    shared = settled(_by_size(placed, counts, "sig", total).select("sig", "h1"), "shared")
    same = [F.bit_xor(F.xxhash64("h1", F.lit(1))).alias("x1"), F.sum(F.pmod(F.xxhash64("h1", F.lit(2)), F.lit(1 << 30))).alias("x2")]
    buckets = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), *same)
    buckets = settled(buckets.groupBy("size", "x1", "x2").agg(F.min("sig").alias("sig")).select("sig", "size"), "buckets")
    return settled(_by_size(shared, buckets, "sig", total).select("sig", "h1"), "members"), buckets


def _star(members: DataFrame, buckets: DataFrame, of: DataFrame | None, number: int) -> DataFrame:
    """Distinct (a, b): every node of a bucket with the bucket's centre, where these are of different classes."""
    comp = F.col("h1") if of is None else F.coalesce("component", "h1")
    own = (members if of is None else members.join(of, "h1", "left")).select("sig", "h1", comp.alias("comp"))
    own = own if of is None else settled(own, "classed")
    centre = own.groupBy("sig").agg(F.min(F.struct(F.xxhash64("h1", F.lit(number)), "h1", "comp")).alias("top"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    centre = centre.where("low <> high").select("sig", F.col("top.h1").alias("centre"), F.col("top.comp").alias("main"))
    total = buckets.agg(F.sum("size")).head()[0] or 0
    pairs = _by_size(own, centre.join(buckets, "sig"), "sig", total).where("comp <> main")
    return pairs.select(F.least("h1", "centre").alias("a"), F.greatest("h1", "centre").alias("b")).distinct()


def _pairs_left(members: DataFrame, of: DataFrame) -> int:
    """Pairs of nodes of different classes that share a bucket, counted once a bucket."""
    classes = members.join(of, "h1", "left").groupBy("sig", F.coalesce("component", "h1")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = classes.groupBy("sig").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("pairs"))
    return int(pairs.agg(F.sum("pairs")).head()[0] or 0) // 2


def sifted(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b: h1 of nodes) that the sequential test leaves; a node of many pairs meets them in several places."""
    pairs = settled(pairs, "pairs")
    total = 2 * pairs.count()
    many = pairs.select(F.explode(F.array("a", "b")).alias("h1")).groupBy("h1").agg(F.count(F.lit(1)).alias("size"))
    large = F.col("size") * CARRIED > total
    places = F.when(large, F.ceil(F.col("size") / HUB)).otherwise(1)
    many = settled(many.select("h1", "size", places.alias("places")), "ends")
    heavy = F.broadcast(many.where(large).select("h1", "places"))  # sizes add up to total, so fewer than CARRIED rows
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("places") - 1))
    carried = marks.join(many, "h1").select("h1", "n", "point", numbers.alias("place"))
    for own, other in (("a", "b"), ("b", "a")):
        placed = pairs.join(heavy.withColumnRenamed("h1", own), own, "left")
        place = F.pmod(F.xxhash64(other), F.coalesce("places", F.lit(1))).alias("place")
        side = carried.select(F.col("h1").alias(own), F.col("n").alias(f"{own}n"), F.col("point").alias(f"{own}_point"), "place")
        pairs = placed.select(*pairs.columns, place).join(side, [own, "place"]).drop("place")
    with batch_rows(pairs.sparkSession, 1 << 13):
        return settled(pairs.mapInArrow(_sifted, "a bigint, b bigint").distinct(), "sifted")


def classes(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(h1, h2, component_id) for every non-empty set of the documents, whose nodes are ``rows``: the smallest doc_id of its class."""
    own = rows.where("n > 0")
    nodes = settled(own.groupBy("h1", "h2").agg(F.min("doc_id").alias("label"), F.max("n").alias("n"), F.min(F.struct("k1", "k2")).alias("key")), "nodes")
    marks = settled(own.where("point is not null").select("h1", "h2", "n", "point", "bands").dropDuplicates(["h1", "h2"]), "marks")
    members, buckets = _buckets(marks)
    points = marks.select("h1", "n", "point")
    # Sets whose keys differ in their second half only share a node name: they are verified with each other.
    twins = settled(nodes.groupBy("h1").count().where("count > 1").select(F.col("h1").alias("a"), F.col("h1").alias("b")), "twins")
    tested, of, links = twins, None, documents.sparkSession.createDataFrame([], "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    if not twins.isEmpty():
        links = settled(ngram_join.verified(twins, nodes, documents, SHINGLE), "links")
    for number in range(STARS):
        left = sifted(_star(members, buckets, of, number).join(tested, ["a", "b"], "left_anti"), points)
        links = settled(links.union(ngram_join.verified(left, nodes, documents, SHINGLE)), "links")
        tested, of = settled(tested.union(left), "tested"), ngram_join.first_classes(links)
        if _pairs_left(members, of) <= SEARCHED * members.count():
            break
    of = ngram_join.first_classes(links) if of is None else of
    # A class in parts whose labels have not met yet only means more pairs here.
    links = settled(links.union(_across(members, marks, of, nodes, documents)), "links")
    return ngram_join.named(nodes, links)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and class of every document, and whether it is the one of its class that stays."""
    bounded_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    schema = "doc_id bigint, k1 bigint, k2 bigint, h1 bigint, h2 bigint, n bigint, point binary, bands array<bigint>"
    rows = settled(documents.select("doc_id", *text_key(F.col("text")), "text").mapInArrow(_node_rows, schema), "rows")
    found = rows.select("doc_id", "h1", "h2", "n").join(classes(documents, rows), ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
