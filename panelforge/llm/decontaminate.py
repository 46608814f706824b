"""Benchmark decontamination on a distributed positional inverted index.

Words are maximal runs of 0-9, a-z (after lower-casing A-Z) and characters outside ASCII. A benchmark item gives
windows of ``WINDOW`` words (one shorter window if it has fewer). The index holds, for every document word that is
a key of some window, a posting: the word's hash, the text's key, the position, and the hashes of the words around
it. Keys are each window's rarest words by their counts over the whole corpus. A posting, moved back by the key's
offset, names a place where the window may begin; places that the two rarest words agree on are kept and all other
words are compared with those that the posting carries, so a match is exact (64-bit hashes of every word in order).

Null and empty texts have no words and are not contaminated; items without words have no window. Repeated rows, of
either table, count like any other; texts are told apart by a 128-bit key, so repeated or null doc_ids do no harm.
Items with a null item_id contaminate like any other, but have no place in the list of items. Very long texts are read whole, hashed in segments; an
empty table of documents gives no rows, an empty benchmark no hits. Other columns of documents are carried along packed, so their names don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, packed, settled
from panelforge.llm.text_kernels import Words, chunks, content_key

WINDOW = 10
#: Words of the benchmark that a task carries at most; a larger vocabulary takes one more pass over the corpus for each so many.
CARRIED_WORDS = 2_000_000
#: Windows that a broadcast carries at most (some 20 MB); more are joined by a shuffle.
CARRIED_WINDOWS = 100_000


def _word_lists(texts: Column) -> Column:
    """Hashes of all words of each text, in order."""

    @F.arrow_udf("array<bigint>")
    def of(batch: pa.Array) -> pa.Array:
        out = []
        for _, data, offsets in chunks(batch):
            w = Words(data, offsets, "symbol")
            h = w.hashes().view(np.int64)
            out += [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        return pa.array(out, pa.list_(pa.int64()))

    return of(texts)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (item_id, window) with window the array of word hashes."""
    words = items.select("item_id", _word_lists(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, F.lit(size)))).alias("window")).distinct()


def _carried(words: DataFrame) -> list[np.ndarray]:
    """Sorted word hashes in slices of CARRIED_WORDS at most; each slice takes a pass over the corpus."""
    slices = max(1, -(-words.count() // CARRIED_WORDS))
    part = lambda k: words.where(F.pmod(F.xxhash64("word"), F.lit(slices)) == k) if slices > 1 else words
    return [np.sort(part(k).toArrow().column("word").to_numpy().astype(np.int64)) for k in range(slices)]


def corpus_counts(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n) of the given words over all texts; words that don't occur are left out."""
    spark, out = texts.sparkSession, None
    for carried in _carried(words):
        shared = spark.sparkContext.broadcast(carried)

        def count(batches, shared=shared):
            known = shared.value
            seen = np.zeros(len(known) + 1, np.int64)
            for b in batches:
                for _, data, offsets in chunks(b.column(0)):
                    h = Words(data, offsets, "symbol").hashes().view(np.int64)
                    at = np.searchsorted(known, h)
                    at[known[np.minimum(at, len(known) - 1)] != h] = len(known)
                    seen += np.bincount(at, minlength=len(known) + 1)
            at = np.flatnonzero(seen[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(known[at]), pa.array(seen[at])], ["word", "n"])

        if len(carried):
            part = texts.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            out = part if out is None else out.union(part)
    return out if out is not None else words.select("word", F.lit(0).cast("bigint").alias("n")).limit(0)


def keyed(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its two rarest places (count, word, offset); windows with a word that the corpus lacks are left out."""
    each = found.select("window").distinct().select("window", F.posexplode("window").alias("offset", "word"))
    sized = each.join(counts, "word").groupBy("window").agg(F.array_sort(F.collect_list(F.struct("n", "word", "offset"))).alias("places"))
    return sized.where(F.size("places") == F.size("window")).select("window", F.get("places", F.lit(0)).alias("first"), F.coalesce(F.get("places", F.lit(1)), F.get("places", F.lit(0))).alias("second"))


def postings(texts: DataFrame, words: DataFrame, reach: int = WINDOW - 1) -> DataFrame:
    """(word, k1, k2, pos, around): each place of the given words in the texts, with the hashes of ``reach`` words on either side (0 beyond the text)."""
    spark, out = texts.sparkSession, None
    schema = "word bigint, k1 bigint, k2 bigint, pos bigint, around array<bigint>"
    for carried in _carried(words):
        shared = spark.sparkContext.broadcast(carried)

        def post(batches, shared=shared):
            known = shared.value
            for b in batches:
                for _, data, offsets in chunks(b.column(0)):
                    w = Words(data, offsets, "symbol")
                    h = w.hashes().view(np.int64)
                    at = np.searchsorted(known, h)
                    hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h)
                    if not len(hit):
                        continue
                    doc = w.doc[hit]
                    near = hit[:, None] + np.arange(-reach, reach + 1)
                    inside = (near >= w.first[doc][:, None]) & (near < w.first[doc + 1][:, None])
                    around = np.where(inside, h[np.clip(near, 0, len(h) - 1)], 0)
                    keys = {d: content_key(data[offsets[d] : offsets[d + 1]].tobytes()) for d in np.unique(doc)}
                    pair = np.array([keys[d] for d in doc], np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hit) + 1) * (2 * reach + 1), pa.int32()), pa.array(around.ravel()))
                    columns = [pa.array(h[hit]), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(hit - w.first[doc]), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["word", "k1", "k2", "pos", "around"])

        if len(carried):
            part = texts.select("text").mapInArrow(post, schema)
            out = part if out is None else out.union(part)
    return out if out is not None else texts.sparkSession.createDataFrame([], schema)


def proximity(index: DataFrame, keys: DataFrame, slop: int) -> DataFrame:
    """(window, k1, k2, pos, other): places of a window's two rarest words whose distance is off by ``slop`` words at most."""
    ahead = index.select(F.col("word").alias("w1"), "k1", "k2", "pos")
    first = ahead.join(keys.select("window", F.col("first.word").alias("w1"), F.col("second.word").alias("w2"), (F.col("second.offset") - F.col("first.offset")).alias("step")), "w1")
    offered = first.select("window", "k1", "k2", "w2", "pos", F.explode(F.sequence(F.col("pos") + F.col("step") - slop, F.col("pos") + F.col("step") + slop)).alias("other"))
    there = index.select(F.col("word").alias("w2"), "k1", "k2", F.col("pos").alias("other")).distinct()
    return offered.join(there, ["w2", "k1", "k2", "other"]).select("window", "k1", "k2", "pos", "other").distinct()


def phrase_matches(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct (window, k1, k2, start): every place where a whole window occurs."""
    wanted = keys.select("window", F.col("first.word").alias("word"), F.col("first.offset").alias("offset"), F.col("second.word").alias("w2"), F.col("second.offset").alias("offset2"))
    if keys.count() <= CARRIED_WINDOWS:
        wanted = F.broadcast(wanted)
    places = index.join(wanted, "word").where("pos >= offset")
    reach = (F.size("around") - 1) / 2
    there = F.slice("around", (reach - F.col("offset") + 1).cast("int"), F.size("window"))
    moved = places.select("window", "k1", "k2", (F.col("pos") - F.col("offset")).alias("start"), "w2", (F.col("pos") - F.col("offset") + F.col("offset2")).alias("pos2"), (there == F.col("window")).alias("same"))
    second = index.select(F.col("word").alias("w2"), "k1", "k2", F.col("pos").alias("pos2")).distinct()
    return moved.where("same").join(second, ["w2", "k1", "k2", "pos2"], "left_semi").select("window", "k1", "k2", "start").distinct()


def facts(text: Column) -> Column:
    """struct<k1, k2, n_words> of each text."""

    @F.arrow_udf("k1 bigint, k2 bigint, n_words bigint")
    def of(batch: pa.Array) -> pa.Array:
        keys, counts = [], [np.zeros(0, np.int64)]
        for _, data, offsets in chunks(batch):
            keys += [content_key(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            counts.append(np.diff(Words(data, offsets, "symbol").first))
        k1, k2 = np.array(keys, np.int64).reshape(-1, 2).T
        return pa.StructArray.from_arrays([pa.array(k1), pa.array(k2), pa.array(np.concatenate(counts))], ["k1", "k2", "n_words"])

    return of(text)


def _covered(spans: Column) -> Column:
    """How many words sorted spans (start, size) cover."""
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("bigint"), x["start"] + x["size"] - F.greatest(x["start"], s["end"]))).alias("n"), F.greatest(s["end"], x["start"] + x["size"]).alias("end")
    )
    zero = F.lit(0).cast("bigint")
    return F.aggregate(spans, F.struct(zero.alias("n"), zero.alias("end")), step, lambda s: s["n"])


def find(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k1, k2, n_hit, items) of every contaminated text; items: the ids, where not null, of items with a window there."""
    found = settled(windows(benchmark), "windows")
    texts = documents.select("text")
    counts = corpus_counts(texts, found.select(F.explode("window").alias("word")).distinct())
    keys = settled(keyed(found, counts), "keys")
    words = keys.select(F.explode(F.array("first.word", "second.word")).alias("word")).distinct()
    index = settled(postings(texts, words), "postings")
    matches = settled(phrase_matches(index, keys), "matches")
    spans = matches.select("k1", "k2", F.struct("start", F.size("window").cast("bigint").alias("size")).alias("span"))
    hits = spans.groupBy("k1", "k2").agg(_covered(F.array_sort(F.collect_list("span"))).alias("n_hit"))
    items = matches.select("window", "k1", "k2").distinct().join(found, "window").groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return settled(hits.join(items, ["k1", "k2"]), "hits")


def marked(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, n_words, n_hit, items): every document as a struct, its words, those hit, and the ids of the items found in it."""
    hits = find(documents, benchmark)
    own = documents.select(packed(documents).alias("row"), facts(F.col("text")).alias("own")).select("row", "own.*")
    both = own.join(hits, ["k1", "k2"], "left")
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    return both.select("row", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", none).alias("items"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words hit, and items found, in every document."""
    bounded_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = marked(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("row.doc_id", "n_words", "n_hit", "items")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
