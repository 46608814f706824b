"""Removal of repeated byte strings, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus. Texts are cut
so that equal strings meet: every such string has one anchor, of the ``GRAM``-byte pieces in it the rarest by a sketch of all pieces, then the one with
the smallest hash (the last of equals), so equal strings have equal anchors at equal places, and the strings of a text fall into runs
with a common anchor. As the rarest piece of a string that reaches over the edge of a frequent passage lies at that edge, frequent anchors stand only for
strings inside of frequent passages, whose fragments are equal and count as one. Only runs whose anchor occurs twice can hold a repeat. Their fragments
are counted by content and, with one of each content kept, dealt by anchor into blocks; an anchor with more than ``GROUP_BYTES`` of different fragments
is dealt in pairs of tiles. In a block the Burrows-Wheeler transform of all
fragments is taken and intervals are extended backwards, breadth first: common prefixes between neighbouring suffixes
come out by increasing value (each neighbour is settled at the first extension that parts it) and the search stops
at LENGTH; neighbours not parted by then start repeated strings.

Texts are known by a 128-bit key with their number of copies, so copies meet as one row, and null or repeated doc_ids do no harm. Null texts count as
empty; texts shorter than LENGTH lose nothing. Very long texts are hashed and cut in segments. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import sketches
from panelforge.llm.common import bounded_batches, settled, text_key
from panelforge.llm.text_kernels import chunks, content_key, gram_hashes

LENGTH = 200
GRAM = 64
BLOCK_BYTES = 1 << 20
#: Bytes of a tile of an anchor's different fragments, about.
GROUP_BYTES = 1 << 18
#: Keys of texts that a broadcast carries at most (16 MB); more are joined by a shuffle.
CARRIED_TEXTS = 1_000_000
_U = np.uint64
_SEGMENT = 1 << 18
_POSITION_BITS = 24


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbouring keys, by prefix and suffix minima of blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, level: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, number of starts, anchor hash) of all runs of strings with a common anchor, no run longer than a segment."""
    width = length - gram + 1
    starts = len(data) - length + 1
    found = []
    for lo in range(0, starts, _SEGMENT):
        hi = min(lo + _SEGMENT, starts)
        hashes = gram_hashes(data[lo : hi + length - 1], gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        last = _U((1 << _POSITION_BITS) - 1)
        keys = level[sketches.place(hashes)].astype(np.uint64) << _U(58) | (hashes >> _U(30)) << _U(_POSITION_BITS) | (last - place)
        anchor = (last - (_least(keys, width) & last)).astype(np.int64)
        doc = np.searchsorted(offsets, np.arange(lo, hi), "right") - 1
        at = np.flatnonzero(np.arange(lo, hi) + length <= offsets[doc + 1])
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (anchor[at][1:] != anchor[at][:-1]) | (doc[at][1:] != doc[at][:-1])
        first = np.flatnonzero(new)
        found.append((doc[at[first]], lo + at[first], np.diff(np.append(first, len(at))), hashes[anchor[at[first]]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text (0 parts fragments, every one a symbol of its own) by the order of their first ``depth`` symbols at least, by doubling."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.int64)
    key, parted, size = np.zeros(n, np.int64), np.zeros(n, bool), 7
    for k in range(size):
        parted |= wide[k : n + k] == 0
        key = key << 9 | np.where(parted, 0, wide[k : n + k])
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | parted[order][1:]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while size < depth:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        loose = np.flatnonzero(~(new & last))  # slots whose rank is shared
        if not len(loose):
            break
        place = order[loose]
        following = np.where(place + size < n, rank[np.minimum(place + size, n - 1)], -1)
        own = rank[place]
        again = np.argsort(own * (n + 1) + following + 1)
        place, following, own = place[again], following[again], own[again]
        order[loose] = place
        fresh = np.ones(len(loose), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (following[1:] != following[:-1])
        new[loose] = fresh
        rank[place] = np.maximum.accumulate(np.where(fresh, loose, 0))
        size *= 2
    return order


def unparted(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each slot of the suffix order but the first, whether its common prefix with the slot before has ``length`` symbols; entry 0 and one past the end are False."""
    n = len(text)
    bwt = text[order - 1].astype(np.int64)  # the symbol before the first place is the last, a parting 0
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt.astype(np.int16), kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)  # slots whose common prefix with the slot before is settled
    known[[0, n]] = True
    first = text[order]
    edge = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (first[1:] == 0)]))
    low, high = edge, np.append(edge[1:], n) - 1
    known[high + 1] = True
    for _ in range(1, length):
        single = low == high
        # One suffix has one extension; several are grouped by the symbol before them.
        place = low[single]
        place = place[bwt[place] != 0]
        lows, highs = [lf[place]], [lf[place]]
        many_low, many_high = low[~single], high[~single]
        if len(many_low):
            sizes = many_high - many_low + 1
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(many_low, sizes)
            symbol = bwt[at]
            use = symbol != 0
            key = owner[use] << 9 | symbol[use]
            by = np.argsort(key, kind="stable")
            key, to = key[by], lf[at[use][by]]
            if len(key):
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                lows.append(to[start])
                highs.append(to[np.append(start[1:], len(to)) - 1])
        low, high = np.concatenate(lows), np.concatenate(highs)
        fresh = ~known[high + 1]
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        known[high + 1] = True
    return ~known


def repeated_starts(fragments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of some different fragments, at which of its starts a string begins that begins elsewhere in them too."""
    sizes = np.array([len(f) + 1 for f in fragments])
    ends = np.cumsum(sizes)
    text = np.zeros(ends[-1], np.int16)
    for f, e in zip(fragments, ends, strict=True):
        text[e - 1 - len(f) : e - 1] = np.frombuffer(f, np.uint8)
        text[e - 1 - len(f) : e - 1] += 1
    order = suffix_order(text, length)
    same = unparted(text, order, length)
    hit = np.zeros(len(text), bool)
    slot = same[:-1] | same[1:]
    hit[order[slot]] = True
    return [np.flatnonzero(hit[e - s : e - 1]) for e, s in zip(ends, sizes, strict=True)]


def _ranges(starts: np.ndarray) -> list[dict]:
    """Runs of neighbouring starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)]


def _sketch_rows(batches):
    """One row with the counts of all pieces of GRAM bytes that a task sees."""
    counts = np.zeros(sketches.SKETCH, np.int64)
    for b in batches:
        for _, data, _ in chunks(b.column("text")):
            # Pieces that reach over the end of a text count too: that only blurs the sketch.
            counts += np.bincount(sketches.place(gram_hashes(data, GRAM)), minlength=sketches.SKETCH)
    yield pa.RecordBatch.from_arrays([pa.array([sketches.as_row(counts)])], ["sketch"])


_RUN = pa.struct([("anchor", pa.int64()), ("start", pa.int64()), ("number", pa.int64())])
RUNS = "array<struct<anchor:bigint,start:bigint,number:bigint>>"


def _run_rows(batches, level: np.ndarray):
    """k1, k2, text in; the runs of each text out, starts counted from its first byte."""
    for b in batches:
        for row, data, offsets in chunks(b.column("text")):
            doc, start, number, anchor = runs(data, offsets, level)
            rows = len(offsets) - 1
            ends = np.searchsorted(doc, np.arange(rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (anchor, start - offsets[doc], number)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([b.column("k1").slice(row, rows), b.column("k2").slice(row, rows), lists], ["k1", "k2", "runs"])


def _fragment_rows(batches, whole: bool):
    """Occurrences of fragments in rows (k1, k2, copies, text, runs); whole: with their bytes."""
    for b in batches:
        for k1, k2, copies, text, found in zip(*(b.column(c) for c in ("k1", "k2", "copies", "text", "runs")), strict=True):
            data = text.as_py().encode()
            anchor, start, number = (np.asarray(found.values.field(k)) for k in range(3))
            parts = [data[a : a + n + LENGTH - 1] for a, n in zip(start, number, strict=True)]
            keys = np.array([content_key(p) for p in parts], np.int64).reshape(-1, 2)
            columns = {"anchor": anchor, "f1": keys[:, 0], "f2": keys[:, 1]}
            many = lambda x: np.full(len(parts), x.as_py(), np.int64)  # noqa: E731, B023
            columns |= {"copies": many(copies), "bytes": pa.array(parts, pa.binary())} if whole else {"k1": many(k1), "k2": many(k2), "start": start}
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _search_block(block: pa.Table) -> pa.Table:
    """Ranges of repeated starts of each different fragment in a block, by its anchor's groups together."""
    anchor, f1, f2 = (block.column(c).to_numpy() for c in ("anchor", "f1", "f2"))
    # A fragment can stand in several pairs of tiles of the block.
    _, once = np.unique(np.column_stack([anchor, f1, f2]), axis=0, return_index=True)
    # Strings with different anchors differ, so an anchor with one kind of fragment has nothing to find.
    _, kind, times = np.unique(anchor[once], return_inverse=True, return_counts=True)
    block = block.take(pa.array(once[times[kind] > 1]))
    starts = repeated_starts(block.column("bytes").to_pylist()) if len(block) else []
    ranges = pa.array(list(map(_ranges, starts)), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
    return pa.table({"anchor": block.column("anchor"), "f1": block.column("f1"), "f2": block.column("f2"), "ranges": ranges})


def _cut(batches):
    """What is left of marked texts: rows (k1, k2, text, spans) in, removed bytes and the digest of the rest out."""
    for b in batches:
        removed, spans, digest = [], [], []
        for text, ranges in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            change = np.zeros(len(data) + 1, np.int32)
            for r in ranges:
                change[r["lo"]] += 1
                change[r["hi"]] -= 1
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            digest.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)], ["k1", "k2", "n_removed", "n_spans", "kept_sha256"])


def repeats(documents: DataFrame) -> DataFrame:
    """(k1, k2, text, spans) of every text that loses bytes; spans: byte ranges (lo, hi exclusive) to remove, which may overlap."""
    spark = documents.sparkSession
    texts = documents.select("text").where(F.octet_length("text") >= LENGTH)
    counted = settled(texts.mapInArrow(_sketch_rows, "sketch array<int>"), "sketch")
    level = spark.sparkContext.broadcast(sketches.summed_levels(counted))
    keyed = texts.select(*text_key(F.col("text")), "text")
    cut = settled(keyed.mapInArrow(lambda it: _run_rows(it, level.value), f"k1 bigint, k2 bigint, runs {RUNS}"), "runs")
    each = cut.select("k1", "k2", F.explode("runs").alias("run"))
    shared = settled(each.groupBy("run.anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    placed = each.select("k1", "k2", "run", "run.anchor").join(shared, "anchor")
    marks = settled(placed.groupBy("k1", "k2").agg(F.collect_set("run").alias("runs")), "marks")
    wanted = marks.select("k1", "k2")
    if wanted.count() <= CARRIED_TEXTS:
        wanted = F.broadcast(wanted)
    distinct = keyed.join(wanted, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    marked = settled(distinct.join(marks, ["k1", "k2"]), "marked")
    bytes_of = marked.mapInArrow(lambda it: _fragment_rows(it, True), "anchor bigint, f1 bigint, f2 bigint, copies bigint, bytes binary")
    fragments = settled(bytes_of.groupBy("anchor", "f1", "f2").agg(F.sum("copies").alias("copies"), F.first("bytes").alias("bytes")), "fragments")
    size = F.octet_length("bytes")
    groups = fragments.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(size + 1).alias("size")).where("kinds > 1")
    groups = settled(groups.select("anchor", "size", F.ceil(F.col("size") / GROUP_BYTES).cast("bigint").alias("tiles")), "groups")
    total = groups.agg(F.sum(F.col("size") * F.col("tiles"))).head()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    tile = F.pmod(F.xxhash64("f1", F.lit(5)), F.col("tiles"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("other")
    tiled = fragments.select("anchor", "f1", "f2", "bytes").join(groups, "anchor").select("anchor", "f1", "f2", "bytes", tile.alias("tile"), other)
    block = F.pmod(F.xxhash64("anchor", F.least("tile", "other"), F.greatest("tile", "other")), F.lit(blocks)).alias("block")
    found = tiled.select("anchor", "f1", "f2", "bytes", block).groupBy("block").applyInArrow(_search_block, "anchor bigint, f1 bigint, f2 bigint, ranges array<struct<lo:bigint,hi:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), (size - LENGTH).cast("bigint").alias("hi")))
    copied = fragments.where("copies > 1").select("anchor", "f1", "f2", whole.alias("ranges"))
    all_found = settled(found.union(copied).where(F.size("ranges") > 0), "repeats")
    where = marked.mapInArrow(lambda it: _fragment_rows(it, False), "anchor bigint, f1 bigint, f2 bigint, k1 bigint, k2 bigint, start bigint")
    span = lambda r: F.struct((F.col("start") + r["lo"]).alias("lo"), (F.col("start") + r["hi"] + LENGTH).alias("hi"))
    spans = where.join(all_found, ["anchor", "f1", "f2"]).select("k1", "k2", F.explode(F.transform("ranges", span)).alias("span"))
    return marked.select("k1", "k2", "text").join(spans.groupBy("k1", "k2").agg(F.collect_list("span").alias("spans")), ["k1", "k2"])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when repeated strings of 200 bytes are removed."""
    bounded_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = settled(repeats(documents).mapInArrow(_cut, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string"), "cut")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = documents.select("doc_id", *text_key(F.col("text")), F.octet_length(data).cast("bigint").alias("n_bytes"), F.sha2(data, 256).alias("sha256"))
    zero = F.lit(0).cast("bigint")
    return docs.join(cut, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256")
    )
