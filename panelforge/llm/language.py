"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed character uni-, bi- and trigrams of the whole lower-cased text, weighted by
(1 + log tf) * idf and scaled to length 1. The document frequencies cover every row that may be learned from, and so do the names.
Weights are learned by follow-the-regularised-leader with L1 and L2 penalties on a bounded sample of
``SAMPLE_ROWS`` rows: every language gets its share, but at least ``LEAST_ROWS`` rows where it has them, taken by smallest hash of doc_id.
Rows are dealt into shards by hash and the shards' states averaged each round; an eighth of the sample is kept apart to fit the temperature
that divides the logits.

A null text, an empty one and one without a letter get ``und`` with score 0. Without any labelled row
every text gets ``und``. Repeated rows score alike; columns other than the text are never inputs. Of languages with equal scores the first by name
wins. Very long texts are read in segments. An empty table gives no rows. A null doc_id is in no fold: it is not held out, and not learned from.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, in_fold, training_rows
from panelforge.llm.text_kernels import CHUNK_BYTES, chunks

SAMPLE_ROWS = 8_192
LEAST_ROWS = 64
SHARD_ROWS = 2_048
ROUNDS = 3
BUCKET_BITS = 15
DIM = 1 << BUCKET_BITS
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 1e-3
NONE = "und"
_U = np.uint64
_TABLE = 0x530


def _folded() -> np.ndarray:
    """Lower case of the code points below 0x530, where it is one character."""
    return np.array([ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(_TABLE)], np.uint64)


def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(_TABLE)])


_LOWER, _LETTER = _folded(), _letters()


def _buckets(points: np.ndarray, before: int = 0) -> list[np.ndarray]:
    """Buckets of the uni-, bi- and trigrams of code points that end behind the first ``before``."""
    low = points.astype(np.uint64)
    small = points < _TABLE
    low[small] = _LOWER[points[small]]
    one = low * _U(0x9E3779B97F4A7C15)
    pairs = (one[:-1] + low[1:]) * _U(0xC2B2AE3D27D4EB4F)
    threes = (pairs[:-1] + low[2:]) * _U(0x165667B19E3779F9)
    cut = lambda h, k: (((h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9 + 2 * k)) >> _U(64 - BUCKET_BITS)).astype(np.int32)
    return [cut(one[before:], 1), cut(pairs[max(before - 1, 0) :], 2), cut(threes[max(before - 2, 0) :], 3)]


def _has_letter(points: np.ndarray) -> bool:
    small = points < _TABLE
    return bool(_LETTER[points[small]].any()) or any(unicodedata.category(chr(c))[0] == "L" for c in np.unique(points[~small]))


def _code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def _counts(texts: pa.Array):
    """(buckets, counts, has a letter) of each text; a text longer than a chunk is read in segments."""
    for _, data, offsets in chunks(texts):
        if len(data) > CHUNK_BYTES:
            total, has, last = np.zeros(DIM, np.int64), False, np.zeros(0, np.uint32)
            lo = 0
            while lo < len(data):
                hi = min(lo + CHUNK_BYTES, len(data))
                while hi < len(data) and data[hi] & 0xC0 == 0x80:
                    hi += 1
                points = np.concatenate([last, _code_points(data[lo:hi])])
                total += np.bincount(np.concatenate(_buckets(points, len(last))), minlength=DIM)
                has = has or _has_letter(points)
                last, lo = points[-2:], hi
            yield np.flatnonzero(total), total[total > 0], has
            continue
        points = _code_points(data)
        ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        grams = _buckets(points)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            own = np.concatenate([g[a : max(a, b - k)] for k, g in enumerate(grams)])
            if len(own) > DIM // 4:
                counts = np.bincount(own, minlength=DIM)
                buckets = np.flatnonzero(counts)
                counts = counts[buckets]
            else:
                buckets, counts = np.unique(own, return_counts=True)
            yield buckets, counts, _has_letter(points[a:b])


def vectors(texts: pa.Array, idf: np.ndarray | None = None):
    """For each text: (buckets, values, has a letter); values are TF-IDF of length 1, or counts when idf is None."""
    for buckets, counts, has in _counts(texts):
        if idf is None:
            yield buckets, counts, has
        else:
            v = (1 + np.log(np.maximum(counts, 1))) * idf[buckets]
            yield buckets, v / max(np.sqrt(v @ v), 1e-12), has


@dataclass
class Languages:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIM + 1 rows (the last is the bias), one column for each name
    temperature: float = 1.0


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """In how many of the rows' texts each bucket occurs, and at the end the number of rows."""

    def count(batches):
        seen = np.zeros(DIM + 1, np.int64)
        for b in batches:
            for buckets, _, _ in vectors(b.column(0)):
                seen[buckets] += 1
                seen[-1] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    parts = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(DIM + 1, np.int64)
    for r in parts.collect():  # DIM + 1 rows at most
        out[r["bucket"]] = r["n"]
    return out


def _weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train_shard(examples: list, labels: list[int], z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of follow-the-regularised-leader over a shard, from the averaged state; the bias has no L1 penalty."""
    z, n = z.copy(), n.copy()
    for (buckets, values), label in zip(examples, labels, strict=True):
        at, x = np.append(buckets, DIM), np.append(values, 1.0)[:, None]
        l1 = np.where(at == DIM, 0.0, L1)[:, None]
        w = _weights(z[at], n[at], l1)
        logits = (w * x).sum(0)
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1
        g = x * p
        grown = n[at] + g * g
        z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
        n[at] = grown
    return z, n


def _logits(model: Languages, buckets: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (values @ model.weights[buckets] + model.weights[-1]) / model.temperature


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor with the least log-loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        top = s.max(1)
        return float(np.mean(top + np.log(np.exp(s - top[:, None]).sum(1)) - s[np.arange(len(labels)), labels]))

    a, b, g = -1.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def sampled(rows: DataFrame, sample_rows: int) -> tuple[DataFrame, list[str]]:
    """At most sample_rows rows (text, label) of rows (doc_id, text, lang), and all names: in order of the hash of doc_id stretched by how
    much rarer the sample is than the language, so that each language comes in with its share or LEAST_ROWS."""
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    names, total = sorted(counts), sum(counts.values())
    stretch = [(n, counts[n] / max(LEAST_ROWS, sample_rows * counts[n] / total)) for n in names]
    known = rows.sparkSession.createDataFrame(stretch, "lang string, stretch double")
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 31)) * F.col("stretch")
    labels = rows.select("doc_id", "lang").join(known, "lang").select("doc_id", F.col("lang").alias("label"), place.alias("priority"))
    return training_rows(rows.select("doc_id", "text"), labels, sample_rows), names


def _examples(texts: pa.ChunkedArray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(buckets, values) for buckets, values, _ in vectors(texts, idf)]


def _trainer(state):
    def train(shard):
        z, n, idf, number = state.value
        shard = shard.sort_by("h").combine_chunks()
        z, n = train_shard(_examples(shard.column("text"), idf), [number[x] for x in shard.column("label").to_pylist()], z, n)
        return pa.table({"z": pa.array([z.ravel()]), "n": pa.array([n.ravel()])})

    return train


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Languages:
    """A model of rows (doc_id, text, lang): those with a null text or lang are left out."""
    spark = rows.sparkSession
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sample, names = sampled(rows, sample_rows)
    if not names:
        return Languages([], np.ones(DIM), np.zeros((DIM + 1, 0)))
    seen = document_frequencies(rows)
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    number = {n: k for k, n in enumerate(names)}
    kept = sample.select(F.xxhash64("text", "label").alias("h"), "label", "text")
    examples = kept.withColumn("apart", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(8)) == 0)
    placed = examples.where("not apart")
    shards = max(1, -(-placed.count() // SHARD_ROWS))
    dealt = placed.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(3)), F.lit(shards)))
    z, n = np.zeros((2, DIM + 1, len(names)))
    for _ in range(rounds):
        train = _trainer(spark.sparkContext.broadcast((z, n, idf, number)))
        parts = dealt.groupBy("shard").applyInArrow(train, "z array<double>, n array<double>").collect()  # one state for each shard of the sample
        if parts:
            z = np.mean([np.array(p["z"]) for p in parts], 0).reshape(z.shape)
            n = np.mean([np.array(p["n"]) for p in parts], 0).reshape(z.shape)
    l1 = np.full((DIM + 1, 1), L1)
    l1[-1] = 0
    model = Languages(names, idf, _weights(z, n, l1))
    shared = spark.sparkContext.broadcast(model)

    def apart(batches):
        for b in batches:
            rows = [_logits(shared.value, *x) for x in _examples(b.column("text"), shared.value.idf)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("label")], ["logits", "label"])

    judged = examples.where("apart").mapInArrow(apart, "logits array<double>, label string").collect()  # an eighth of the sample
    model.temperature = _temperature(np.array([r["logits"] for r in judged]), np.array([number[r["label"]] for r in judged]))
    return model


def identify(text: Column, model: Languages, spark: SparkSession) -> Column:
    """struct<lang, score> of each whole text: the likeliest name and its calibrated probability."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def best(texts: pa.Array) -> pa.Array:
        m = shared.value
        lang, score = [], []
        for buckets, values, has in vectors(texts, m.idf):
            if has and m.names:
                s = _logits(m, buckets, values)
                k = int(s.argmax())
                lang.append(m.names[k])
                score.append(1 / float(np.exp(s - s[k]).sum()))
            else:
                lang.append(NONE)
                score.append(0.0)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return best(text)


def learned(documents: DataFrame) -> Languages:
    """The model of every document outside fold 0 of 5."""
    return fit(documents.where(F.col("doc_id").isNotNull() & ~in_fold("doc_id", 5, 0)).select("doc_id", "text", "lang"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; rows of fold 0 of 5 are held out of the training."""
    bounded_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(F.col("text"), learned(documents), spark)
    out = documents.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), found.alias("found"))
    return out.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
