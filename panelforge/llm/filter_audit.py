"""Interaction of five filters, audited for every order in which they can be applied.

Failure conditions of a whole text (null: empty), words being maximal runs of other than [\\x20\\x09-\\x0D]: A: under 100 words; B: 100 * distinct
words < 80 * words; C: 100 * [A-Z] characters > 10 * code points; D: any of #$%&*|; E: a smaller doc_id has the identical text.

E is an existential self-join: a left-semi join of the rows whose text hash repeats with the smallest doc_id of each of their texts, on hash, exact text and
smaller doc_id. Its rows are united with those of the other failures, and what is left of the corpus are counts of each combination of failures by part
and labels (at most 32 * 4 rows a part), from which all 120 orders are answered.

A hash that many rows share (more than one in ``CARRIED``, so these are fewer than ``CARRIED`` and can be broadcast) is spread: its rows by a hash of their
doc_id, its texts' smallest ids to each of those places, so no task takes a whole group of copies. Null doc_ids are smaller than none and have none below them, so such rows are neither copies nor originals; rows that share a doc_id are
documents of their own and no copies of each other. Repeated or contradicting label rows count as 1 where any says 1; null labels count as 0.
A null lang is the part of the empty string. Very long texts are read whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import settled, text_key

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80
MOST_CAPITALS = 10
SIGNS = "[#$%&*|]"
#: A hash with more than this part of all rows is spread, over places of so many rows on average.
CARRIED = 10_000
SPREAD = 2048
_BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_failures(text: Column) -> Column:
    """Bits of the failures A to D of each text."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) < LEAST_WORDS, _BIT["A"]).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w), _BIT["B"]).otherwise(0)
        + F.when(100 * capitals > MOST_CAPITALS * F.length(text), _BIT["C"]).otherwise(0)
        + F.when(F.rlike(text, F.lit(SIGNS)), _BIT["D"]).otherwise(0),
    )[0]


def copies(documents: DataFrame, facts: DataFrame, spread: int = SPREAD) -> DataFrame:
    """The rows (doc_id, lang, k1, k2) of documents whose text a smaller doc_id has too; facts holds the keys of all rows."""
    total = facts.count()
    many = facts.where("doc_id is not null").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    places = F.when(F.col("n") * CARRIED > total, F.ceil(F.col("n") / spread)).otherwise(1).alias("places")
    repeated = settled(many.where("first < last").select("k1", "k2", "n", places), "repeated")
    heavy = F.broadcast(repeated.where(F.col("n") * CARRIED > total).select("k1", "k2", "places"))  # fewer than CARRIED rows
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("places") - 1)).alias("place")
    keyed = documents.where("doc_id is not null").select("doc_id", "lang", *text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    dealt = keyed.join(heavy, ["k1", "k2"], "left").withColumn("place", F.pmod(F.xxhash64("doc_id"), F.coalesce("places", F.lit(1)))).drop("places")
    again = settled(dealt.join(repeated.select("k1", "k2", "places", numbers), ["k1", "k2", "place"]), "again")
    originals = again.groupBy("k1", "k2", "places", "place", "text").agg(F.min("doc_id").alias("first"))
    originals = originals.groupBy("k1", "k2", "places", "text").agg(F.min("first").alias("first"))
    everywhere = originals.select("k1", "k2", "text", "first", numbers)
    a, b = again.alias("a"), everywhere.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("k1", "k2", "place", "text")]
    return a.join(b, [*same, F.col("b.first") < F.col("a.doc_id")], "left_semi").select("doc_id", "lang", "k1", "k2")


def combinations(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): how many documents of each part and label fail each combination of filters (bits of FILTERS)."""
    text = F.coalesce("text", F.lit(""))
    facts = settled(documents.select("doc_id", "lang", *text_key(F.col("text")), own_failures(text).alias("fails")), "facts")
    found = copies(documents, facts).select("doc_id", "lang", "k1", "k2", F.lit(_BIT["E"]).alias("fails"), F.lit(0).alias("n"))
    united = facts.withColumn("n", F.lit(1)).unionByName(found)
    rows = united.groupBy("doc_id", "lang", "k1", "k2").agg(F.bit_or("fails").alias("fails"), F.sum("n").alias("n"))
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    unnamed = rows.where("doc_id is null").select("*", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    labelled = rows.where("doc_id is not null").join(marks, "doc_id", "left").unionByName(unnamed)
    part = F.coalesce("lang", F.lit("")).alias("part")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return labelled.groupBy(part, "fails", no("good"), no("toxic")).agg(F.sum("n").alias("n"))


def audited(combined: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts of each combination."""
    orders = map("".join, itertools.permutations(FILTERS))
    steps = [{"filter_order": o, "step": k + 1, "before": sum(_BIT[f] for f in o[:k]), "own": _BIT[o[k]]} for o in orders for k in range(len(FILTERS))]
    cells = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,own:int>>")
    each = combined.withColumn("at", F.explode(cells)).select("part", "fails", "good", "toxic", "n", "at.*")
    fails, passed = F.col("fails").bitwiseAND(F.col("own")) > 0, F.col("fails").bitwiseAND(F.col("before")) == 0
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("long")
    table = each.groupBy("part", "filter_order", "step", "own").agg(
        count(passed & ~fails).alias("kept"),
        count(passed & fails).alias("removed"),
        count(~passed & fails).alias("redundant"),
        count(F.col("fails") == F.col("own")).alias("unique_fails"),
        count(passed & fails & F.col("good")).alias("good_lost"),
        count(passed & fails & F.col("toxic")).alias("toxic_lost"),
    )
    table = settled(table, "audit")
    shapley = table.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return table.join(shapley, ["part", "own"]).drop("own")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each part, filter order and step."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return audited(combinations(documents, labels)).select(*columns)


ORACLE_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS t FROM documents
), worded AS (
  SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM texts
), labelled AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), firsts AS (
  SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t
), failing AS (
  SELECT w.part,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN f.first_id < w.doc_id THEN 16 ELSE 0 END AS fails,
    coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM worded w JOIN firsts f ON w.t = f.t LEFT JOIN labelled l ON w.doc_id = l.doc_id
), combined AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM failing GROUP BY ALL
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, step, own.letter, own.bit AS own,
    coalesce((SELECT sum(l.bit) FROM letters l WHERE instr(filter_order, l.letter) < step), 0)::BIGINT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s, letters own
  WHERE instr(filter_order, own.letter) = step
), counted AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (WHERE (fails & (before | own)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE (fails & before) = 0 AND (fails & own) > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE (fails & before) > 0 AND (fails & own) > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (WHERE (fails & before) = 0 AND (fails & own) > 0 AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (WHERE (fails & before) = 0 AND (fails & own) > 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM combined, steps GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""
