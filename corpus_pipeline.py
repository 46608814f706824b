"""Corpus pipeline: language, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next. All but the last return the columns of ``documents``. Each stage is judged on its own input:
models and statistics are learned from the documents it is given.

A null text has no letter and goes in the first stage; so do empty texts. Later stages keep null and empty texts: they have no near copies, leaks or
secrets and no tokens. Nulls in other columns are carried along; rows with a null doc_id are learned from by no model. Repeated rows count as near copies,
and of a class of near copies one row stays whatever its ids: the smallest, one of several with the same id, one of several without any. Very long texts are
read whole, in segments. Empty tables give no rows. Columns of any further name are carried along: every stage packs the row it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bpe, decontaminate, language, ngram_join, secrets
from panelforge.llm.common import bounded_batches, packed, settled, unpacked

#: Below this probability of its likeliest language a document is rejected.
LEAST_LANGUAGE = 0.4
REDACTED = "[REDACTED]"


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter or with a doubtful language go."""
    bounded_batches(spark)
    found = docs.select(packed(docs).alias("row"), language.identify(F.col("text"), language.learned(docs), spark).alias("found"))
    kept = found.where((F.col("found.lang") != language.NONE) & (F.col("found.score") >= LEAST_LANGUAGE))
    return kept.select(*unpacked("row", docs.columns))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class: the one with the smallest doc_id (null last), then by keys of its text and of the whole row.

    Texts without words have no class but their own: of them, rows with the same doc_id and text count as one."""
    bounded_batches(spark)
    joined = ngram_join.joined(docs)
    words = F.col("n") > 0
    of = [words.alias("words"), F.when(words, F.col("c1")).otherwise(F.col("k1")).alias("c1"), F.when(words, F.col("c2")).otherwise(F.col("k2")).alias("c2"), F.when(~words, F.col("row.doc_id")).alias("id")]
    order = F.struct(F.col("row.doc_id").isNull().alias("without"), F.col("row.doc_id").alias("doc_id"), "k1", "k2", F.xxhash64("row").alias("h"))
    placed = settled(joined.select("row", *of, order.alias("place")), "placed")
    group = ["words", "c1", "c2", "id"]
    best = settled(placed.groupBy(*group).agg(F.min("place").alias("place")), "best")
    a, b = placed.alias("a"), best.alias("b")
    # The place is part of the key, so a large class does not meet in one task.
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "place")]
    return a.join(b, same, "left_semi").dropDuplicates([*group, "place"]).select(*unpacked("row", docs.columns))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    bounded_batches(spark)
    marked = decontaminate.marked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where("n_hit = 0").select(*unpacked("row", docs.columns))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each run of secret spans replaced by a mark and n_chars brought up to date."""
    found = secrets.scan(docs.select(packed(docs).alias("row"), "text"), secrets.fit(docs), spans="_secrets")
    text = F.col("text")

    def cut(acc, s):
        before = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        mark = F.when(s["start"] >= acc["at"], F.lit(REDACTED)).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], before, mark).alias("out"))

    done = F.aggregate("_secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    hit = F.size("_secrets") > 0
    out = found.select("row", F.when(hit, done).otherwise(text).alias("clean"), hit.alias("hit"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("hit"), F.length("clean").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return out.select(*[new[c].alias(c) if c in new else one for c, one in zip(docs.columns, unpacked("row", docs.columns), strict=True)])


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text of every document."""
    from public_tokenizers import path

    bounded_batches(spark)
    vocabulary = path("byte_bpe_50k.json")
    out = bpe.tokenise(docs.select("doc_id", "text"), vocabulary)
    return bpe.with_digests(out).withColumn("ids", bpe.ids_array(F.col("ids_le"))).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", identified),
    ("near_duplicates", one_of_each_class),
    ("benchmark_leaks", without_leaks),
    ("secrets", redacted),
    ("tokens", tokenised),
]

#: No stage but the third could be put into SQL over whole tables; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
