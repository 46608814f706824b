"""Quality scores: histogram gradient-boosted trees over document statistics.

The statistics (``STATISTICS``) are computed from each whole text; they are binned at quantiles of the training
rows, trees are grown depth by depth on histograms of gradients, and the forest is flattened into arrays that
numpy walks for all rows of a batch at once. The forest is fitted on at most ``SAMPLE_ROWS`` labelled rows, those
with the smallest hash of doc_id; only their statistics (not their texts) reach the driver.

Null and empty texts have statistics 0 and get a score like any other. Repeated rows score alike; rows with
a null label are left out of the training; without labels every score is 0.5. A null doc_id is in no fold: it is not held out and has no label. Very
long texts are scored whole; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, in_fold, training_rows
from panelforge.llm.text_kernels import Words, chunks

SAMPLE_ROWS = 16_384
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.15, 1.0, 8
STATISTICS = (
    "log_chars", "log_words", "mean_word", "upper", "digit", "mark", "symbol", "bang", "bar", "non_ascii", "space", "lines_per_word", "distinct", "top_word",
    "repeated_next", "long_words", "short_words", "repeated_lines", "mean_line", "stops", "ends_in_stop", "brackets", "commas", "capital_words",
)


def _class_table() -> np.ndarray:
    table = np.zeros((8, 256), bool)
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"-()", "#$%&*@^~+=<>/\\_{}[]`", "!", "|")):
        table[k, [ord(c) for c in chars]] = True
    table[6, 128:] = True
    table[7, [32, 9, 10, 11, 12, 13]] = True
    return table


_CLASS = _class_table()


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    out = [np.zeros((0, len(STATISTICS)))]
    for _, data, offsets in chunks(texts):
        rows = len(offsets) - 1
        w = Words(data, offsets)
        h = w.hashes()
        words = np.diff(w.first)
        sums = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets])
        n = np.diff(offsets)
        chars, many = np.maximum(n - sums((data & 0xC0) == 0x80), 1), np.maximum(words, 1)
        length = w.end - w.start
        by_doc = lambda x: np.bincount(w.doc, x, rows)
        share = [sums(_CLASS[k][data]) / np.maximum(n, 1) for k in range(8)]
        key = np.lexsort((h, w.doc))
        sorted_h, sorted_doc = h[key], w.doc[key]
        new = np.ones(len(h), bool)
        new[1:] = (sorted_h[1:] != sorted_h[:-1]) | (sorted_doc[1:] != sorted_doc[:-1])
        starts = np.flatnonzero(new)
        runs = np.diff(np.append(starts, len(h)))
        top = np.zeros(rows)
        np.maximum.at(top, sorted_doc[starts], runs)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
        breaks = data == 10
        lines = sums(breaks) + 1
        repeated = np.zeros(rows)
        for r in np.flatnonzero(lines > 1):
            own = data[offsets[r] : offsets[r + 1]].tobytes().split(b"\n")
            repeated[r] = 1 - len(set(own)) / len(own)
        stop = np.isin(data, np.frombuffer(b".?!", np.uint8))
        last = np.zeros(rows, bool)
        full = np.flatnonzero(n > 0)
        last[full] = stop[offsets[1:][full] - 1]
        first_capital = _CLASS[0][data[w.start]] if len(h) else np.zeros(0, bool)
        out.append(
            np.column_stack([
                np.log1p(chars * (n > 0)), np.log1p(words), by_doc(length) / many, *share[:7], share[7], lines / many, np.bincount(sorted_doc[starts], minlength=rows) / many, top / many,
                by_doc(again) / many, by_doc(length > 12) / many, by_doc(length < 3) / many, repeated, np.log1p(chars / lines), sums(stop) / many, last, sums(np.isin(data, np.frombuffer(b"()[]{}", np.uint8))) / many,
                sums(data == 44) / many, by_doc(first_capital) / many,
            ])
        )
    return np.concatenate(out)


@dataclass
class Forest:
    """Trees in flat arrays: of node i of a tree, the statistic and threshold it splits by (statistic -1: a leaf) and its value; its children are 2i + 1 and 2i + 2."""

    statistic: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for s, t, v in zip(self.statistic, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                k = s[node]
                node = np.where(k < 0, node, 2 * node + 1 + (x[row, np.maximum(k, 0)] > t[node]))
            total += v[node]
        return total


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for labels 0 and 1 by logistic loss."""
    nodes = 2 ** (DEPTH + 1) - 1
    shape = (TREES, nodes)
    forest = Forest(np.full(shape, -1), np.zeros(shape), np.zeros(shape), 0.0)
    if not len(y):
        return forest
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    forest.base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])
    total = np.full(len(y), forest.base)
    gain = lambda g, h: g * g / (h + L2)
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH + 1):
            low, width = 2**level - 1, 2**level
            here = node >= low
            local = node[here] - low
            G, H = (np.bincount(local, v[here], width) for v in (g, h))
            forest.value[tree, low : low + width] = -RATE * G / (H + L2)
            if level == DEPTH:
                break
            best, at = np.zeros(width), np.full((width, 2), -1)
            for k in range(x.shape[1]):
                cell = local * BINS + bins[here, k]
                left_g, left_h, left_n = (np.cumsum(np.bincount(cell, v, width * BINS).reshape(width, BINS), 1) for v in (g[here], h[here], np.ones(here.sum())))
                right_n = left_n[:, -1:] - left_n
                won = gain(left_g, left_h) + gain(G[:, None] - left_g, H[:, None] - left_h) - gain(G, H)[:, None]
                won[(left_n < LEAST) | (right_n < LEAST)] = -1
                cut = won.argmax(1)
                better = won[np.arange(width), cut] > best + 1e-9
                best[better] = won[better, cut[better]]
                at[better] = np.column_stack([np.full(better.sum(), k), cut[better]])
            split = np.flatnonzero(at[:, 0] >= 0)
            forest.statistic[tree, low + split] = at[split, 0]
            forest.threshold[tree, low + split] = [edges[k][c] for k, c in at[split]]
            parted = np.flatnonzero(here)[at[local, 0] >= 0]
            k, c = at[node[parted] - low].T
            node[parted] = 2 * node[parted] + 1 + (bins[parted, k] > c)
        total += forest.value[tree][node]
    return forest


def statistics_column(text: Column) -> Column:
    """STATISTICS of each text as array<double>."""

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.ravel()))

    return of(text)


def fit(labelled: DataFrame) -> Forest:
    """The forest of a bounded frame (text, label)."""
    rows = labelled.select(statistics_column(F.col("text")).alias("x"), F.col("label").cast("double").alias("label")).toArrow()  # SAMPLE_ROWS rows of 24 numbers at most
    rows = rows.combine_chunks()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
    order = np.lexsort(x.T)  # the same trees whatever order the rows came in
    return grow(x[order], rows.column("label").to_numpy()[order])


def score(text: Column, forest: Forest, spark: SparkSession) -> Column:
    """Probability of label 1 for each whole text."""
    shared = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-shared.value.logits(statistics(texts)))))

    return probability(text)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; rows of fold 2 of 4 are held out of the training."""
    bounded_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = fit(training_rows(documents, labels.select("doc_id", F.col("quality").alias("label")).where(~in_fold("doc_id", 4, 2)), SAMPLE_ROWS))
    out = documents.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), score(F.col("text"), forest, spark).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))
