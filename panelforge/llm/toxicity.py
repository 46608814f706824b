"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashed word unigrams (also of their first letters), bigrams and skip-grams
(one or two words left out) of its whole text, each with value 1. Per-coordinate learning rates and an L1 penalty leave few weights
other than zero, so the model is a small sorted array that each task carries.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hash of doc_id (``common.training_rows``). Rows are
dealt into shards by hash; every round goes through each shard once by FTRL-proximal, from the averaged state (gradient sums and squared
gradient sums of every feature, so that learning rates carry over), and averages the shards' states again.

Null and empty texts have no feature: their score is that of the bias. Repeated rows score alike; labels that
are null are left out, and a document with several labels counts once for each. Very long texts are read in bounded segments. Without any label
every score is 0.5; an empty table gives no rows. A null doc_id is in no fold, so it is not held out, and has no label. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, in_fold, training_rows
from panelforge.llm.text_kernels import Words, chunks, combine

SAMPLE_ROWS = 12_288
SHARD_ROWS = 4_096
ROUNDS = 4
BUCKET_BITS = 22
#: The bucket of the bias, which has no penalty.
BIAS = 1 << BUCKET_BITS
#: Longer words also count by their first bytes, so that inflected forms share a feature.
STEMS = (4, 6)
ALPHA, BETA, L2 = 1.0, 1.0, 0.0
#: The L1 penalty is this times the root of a shard's rows.
L1_PER_ROOT = 0.1
_U = np.uint64


@dataclass
class State:
    """Sorted buckets with their gradient sums (less the weights' part) and squared gradient sums; features that are not there have 0."""

    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    z: np.ndarray = field(default_factory=lambda: np.zeros(0))
    n: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def at(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """z and n of sorted buckets."""
        place = np.searchsorted(self.buckets, buckets)
        there = np.append(self.buckets, -1)[place] == buckets
        return tuple(np.where(there, np.append(x, 0.0)[place], 0.0) for x in (self.z, self.n))


@dataclass
class Linear:
    """Sorted buckets with a weight other than zero, their weights, and the bias."""

    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def proximal(z: np.ndarray, n: np.ndarray, penalty: np.ndarray | float) -> np.ndarray:
    """The weights of a state."""
    return np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def features(texts: pa.Array):
    """(first row, rows, document of each feature, bucket of each feature) for chunks of whole texts; features of a document can repeat."""
    for row, data, offsets in chunks(texts):
        w = Words(data, offsets)
        h, docs, found = w.hashes(), [w.doc], []
        found.append(combine([h], 11))
        for size in STEMS:
            longer = w.end - w.start > size
            found.append(combine([w.hashes(size)[longer]], 20 + size))
            docs.append(w.doc[longer])
        for gap in (1, 2, 3):
            if len(h) > gap:
                same = w.doc[:-gap] == w.doc[gap:]
                found.append(combine([h[:-gap], h[gap:]], 11 + gap)[same])
                docs.append(w.doc[:-gap][same])
        yield row, len(offsets) - 1, np.concatenate(docs), (np.concatenate(found) >> _U(64 - BUCKET_BITS)).astype(np.int64)


def _distinct(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct buckets of each text."""
    out: list[np.ndarray] = []
    for _, rows, doc, bucket in features(texts):
        key = np.unique(doc << BUCKET_BITS | bucket)
        at = np.searchsorted(key, np.arange(rows + 1) << BUCKET_BITS)
        out += [(key[a:b] & ((1 << BUCKET_BITS) - 1)).astype(np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def train_shard(rows: list[np.ndarray], labels: np.ndarray, start: State, l1: float) -> State:
    """One pass of FTRL-proximal over a shard's rows of distinct buckets, from a state to the next.

    A gradient is below 1, so a feature in fewer rows of the shard than the penalty, with nothing gathered yet, would keep weight 0: it is left out."""
    seen, times = np.unique(np.concatenate(rows), return_counts=True) if rows else (np.zeros(0, np.int64), np.zeros(0))
    used = np.union1d(np.union1d(seen[times >= l1], start.buckets[start.buckets < BIAS]), [BIAS]).astype(np.int64)
    z, n = (x.copy() for x in start.at(used))
    penalty = np.where(used == BIAS, 0.0, l1)
    for row, y in zip(rows, labels, strict=True):
        place = np.searchsorted(used, row)
        at = np.append(place[used[place] == row], len(used) - 1)
        zi, ni = z[at], n[at]
        w = proximal(zi, ni, penalty[at])
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
        n[at] = ni + g * g
    return State(used, z, n)


def averaged(states: list[State], start: State) -> State:
    """The mean of shards' states; a shard that left a feature out has its value of the start."""
    buckets = np.unique(np.concatenate([s.buckets for s in states]))
    z, n = np.zeros(len(buckets)), np.zeros(len(buckets))
    for s in states:
        there = np.isin(buckets, s.buckets, assume_unique=True)
        for total, own, before in zip((z, n), s.at(buckets), start.at(buckets), strict=True):
            total += np.where(there, own, before)
    return State(buckets, z / len(states), n / len(states))


def _trainer(start, l1: float):
    def train(shard):
        shard = shard.sort_by("h").combine_chunks()
        new = train_shard(_distinct(shard.column("text")), shard.column("label").to_numpy(), start.value, l1)
        return pa.table({"buckets": pa.array([new.buckets]), "z": pa.array([new.z]), "n": pa.array([new.n])})

    return train


def fit(labelled: DataFrame, rounds: int = ROUNDS) -> Linear:
    """The model of a bounded frame (text, label 0 or 1); ``training_rows`` makes one."""
    spark = labelled.sparkSession
    examples = labelled.select(F.xxhash64("text", "label").alias("h"), "text", F.col("label").cast("double").alias("label"))
    rows = examples.count()
    shards = max(1, -(-rows // SHARD_ROWS))
    l1 = L1_PER_ROOT * max(1.0, rows / shards) ** 0.5
    dealt = examples.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(3)), F.lit(shards)))
    state = State()
    for _ in range(rounds if rows else 0):
        train = _trainer(spark.sparkContext.broadcast(state), l1)
        parts = dealt.groupBy("shard").applyInArrow(train, "buckets array<long>, z array<double>, n array<double>").collect()  # bounded: one sparse state for each shard of the sample
        state = averaged([State(np.array(p["buckets"], np.int64), np.array(p["z"]), np.array(p["n"])) for p in parts], state)
    weights = proximal(state.z, state.n, np.where(state.buckets == BIAS, 0.0, l1))
    keep = (weights != 0) & (state.buckets < BIAS)
    return Linear(state.buckets[keep], weights[keep], float(weights[state.buckets == BIAS].sum()))


def score(text: Column, model: Linear, spark: SparkSession) -> Column:
    """Probability of label 1 for each whole text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        m = shared.value
        dense = np.zeros(1 << BUCKET_BITS, np.float32)
        dense[m.buckets] = m.weights
        total = np.full(len(texts), m.bias)
        for row, _, doc, bucket in features(texts):
            hit = np.flatnonzero(dense[bucket])
            key = np.unique(doc[hit] << BUCKET_BITS | bucket[hit])  # each feature counts once in a document
            np.add.at(total, row + (key >> BUCKET_BITS), dense[key & ((1 << BUCKET_BITS) - 1)])
        return pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    return probability(text)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; rows of fold 0 of 5 are held out of the training."""
    bounded_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(training_rows(documents, labels.select("doc_id", F.col("toxic").alias("label")).where(~in_fold("doc_id", 5, 0)), SAMPLE_ROWS))
    out = documents.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), score(F.col("text"), model, spark).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
