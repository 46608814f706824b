"""What the operators of this subpackage share: bounded Arrow batches, folds, shared-folder tables."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches small, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Larger Arrow batches for what runs inside, where rows are short."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def packed(df: DataFrame) -> Column:
    """All columns of a row in one struct, whatever their names, so that columns added beside it clash with none."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(row: str, columns: list[str]) -> list[Column]:
    """The columns of a packed row again."""
    return [F.col(f"{row}.`{c}`").alias(c) for c in columns]


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; one below the warehouse only where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return where or f"{spark.conf.get('spark.sql.warehouse.dir')}/panelforge_shared"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> list[Column]:
    """k1, k2: 128-bit key of each text; null texts count as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2")]


def in_fold(key: str, parts: int, number: int) -> Column:
    """Whether the remainder of the key's crc32 (of its text) by ``parts`` is ``number``; false for a null key."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % parts == number, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` rows (text, label), read from a settled table: documents with labels (doc_id, label), those with the smallest ``priority`` of
    labels if it has such a column, else with the smallest hash of doc_id. Rows with one doc_id, text and label count as one; null ids and labels are left out.

    The bound holds whatever repeats: it is applied to the labels before the texts are read (once), and to the rows found."""
    order = [*(["priority"] if "priority" in labels.columns else []), F.xxhash64("doc_id"), "doc_id", "label"]
    wanted = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).distinct().orderBy(*order).limit(sample_rows)
    # The broadcast side has sample_rows short rows at most.
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    numbered = own.join(F.broadcast(wanted), "doc_id").withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    found = settled(numbered, "labelled")
    keys = [*[c for c in ("priority",) if c in found.columns], "doc_id", "label", "h"]
    kept = found.groupBy(*keys).agg(F.min("row").alias("row")).orderBy(*order, "h").limit(sample_rows).select("row")
    return found.join(F.broadcast(kept), "row").select("text", "label")
