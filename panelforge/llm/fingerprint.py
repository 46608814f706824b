"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its paragraphs (pieces between line feeds). Every paragraph hashes to a wide vector and
the fingerprint is the sum of these vectors modulo powers of two: the order of paragraphs plays no part, and a
paragraph is put in or taken out by adding or subtracting its vector (``combine``). The vector has two parts:

* ``EXACT`` lanes of 32 bits from the paragraph's SHA-256, for equality;
* ``NEAR`` lanes of 32 bits that count, for each bit of their 64-bit hashes, the paragraph's word pairs which have
  it, and a lane with their number. Twice the count less the number is a random projection, so the cosine of two
  such vectors estimates how much of their word pairs two texts share.

Null texts count as empty; an empty text is one empty paragraph. Very long texts are taken whole, paragraph by paragraph; an empty table gives no rows, and
other columns are ignored. Repeated rows have equal fingerprints. Where
doc_id repeats or is null, the order of documents goes by (doc_id descending, nulls last, SHA-256 of the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import settled

EXACT = 8
NEAR = 32
_LOW = 0xFFFFFFFF
_TWO_LANES = 0x0000000100000001
#: Ranges of doc_id for each shuffle partition, when documents are put in order.
RANGES_PER_PARTITION = 4


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and ``lanes`` (array<bigint>: EXACT, then NEAR, then the number of word pairs) of every row; keys must tell rows apart."""
    paragraphs = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_paragraph"))
    words = F.split("_paragraph", "[ \\t\\r\\x0B\\f]+")
    hashed = paragraphs.select(*keys, F.sha2(F.encode("_paragraph", "UTF-8"), 256).alias("_digest"), words.alias("_words"))
    pairs = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1)))
    each = hashed.select(*keys, "_digest", F.posexplode(pairs).alias("_at", "_hash"))
    # Exact lanes count once for each paragraph; two near lanes share a 64-bit sum, each with room for 2**31 pairs.
    exact = [F.sum(F.when(F.col("_at") == 0, F.xxhash64("_digest", F.lit(k)).bitwiseAND(F.lit(_LOW))).otherwise(F.lit(0))) for k in range(EXACT)]
    near = [F.sum(F.shiftrightunsigned("_hash", k).bitwiseAND(F.lit(_TWO_LANES))) for k in range(NEAR // 2)]
    sums = each.groupBy(*keys).agg(*[e.alias(f"_e{k}") for k, e in enumerate(exact)], *[n.alias(f"_n{k}") for k, n in enumerate(near)], F.count(F.lit(1)).alias("_pairs"))
    low = [F.col(f"_n{k}").bitwiseAND(F.lit(_LOW)) for k in range(NEAR // 2)]
    high = [F.shiftrightunsigned(f"_n{k}", 32) for k in range(NEAR // 2)]
    lanes = F.array(*[F.col(f"_e{k}").bitwiseAND(F.lit(_LOW)) for k in range(EXACT)], *low, *high, F.col("_pairs").bitwiseAND(F.lit(_LOW)))
    return sums.select(*keys, lanes.alias("lanes"))


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """Lanes of the multiset sum of two fingerprints, or of the difference for sign -1."""
    return F.zip_with(left, right, lambda a, b: (a + sign * b).bitwiseAND(F.lit(_LOW)))


def as_hex(lanes: Column) -> Column:
    """A fingerprint as a string of 8 hexadecimal digits for each lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """0 to 1: the cosine of the near lanes, at least 0; 1 for equal fingerprints, 0 where one has no near lane to compare."""
    signed = lambda lanes: F.transform(F.slice(lanes, EXACT + 1, NEAR), lambda x: 2 * x - F.get(lanes, F.lit(EXACT + NEAR)))
    both = F.zip_with(signed(left), signed(right), lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    zero = F.lit(0.0)
    sums = F.aggregate(
        both,
        F.struct(zero.alias("ab"), zero.alias("aa"), zero.alias("bb")),
        lambda s, x: F.struct((s["ab"] + x["a"] * x["b"]).alias("ab"), (s["aa"] + x["a"] * x["a"]).alias("aa"), (s["bb"] + x["b"] * x["b"]).alias("bb")),
        lambda s: F.when((s["aa"] > 0) & (s["bb"] > 0), F.greatest(zero, F.least(F.lit(1.0), s["ab"] / F.sqrt(s["aa"]) / F.sqrt(s["bb"])))).otherwise(zero),
    )
    return F.when(left == right, F.lit(1.0)).otherwise(sums)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_id, next_text of every document: the next by descending doc_id, after the last the first.

    doc_id is cut into ranges, each put in order by itself; the head of every range also stands, marked, at the end of
    the range before it, so that no task sees more than a range.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 100 * ranges)).head()[0] or []
    cuts = sorted(set(cuts))  # fewer numbers than there are ranges
    place = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    number = F.coalesce(F.size(F.filter(place, lambda c: c <= F.col("doc_id"))), F.lit(-1))  # nulls come last
    placed = docs.withColumn("_range", number)
    order = [F.col("doc_id").desc_nulls_last(), F.sha2(F.encode("text", "UTF-8"), 256)]
    # A head is the largest doc_id of its range; the number of ranges bounds them.
    heads = placed.groupBy("_range").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_range")).collect()
    if not heads:
        return docs.select("doc_id", "text", F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    to = {h["_range"]: heads[k - 1]["_range"] for k, h in enumerate(heads)}  # the first head goes to the last range
    wanted = spark.createDataFrame([(h["_range"], h["doc_id"], to[h["_range"]]) for h in heads], "_range int, _head bigint, _to int")
    copies = placed.join(F.broadcast(wanted), "_range").where(F.col("doc_id").eqNullSafe(F.col("_head")))
    # Several rows may share a head's doc_id: the first by the order of documents.
    copies = copies.groupBy("_to").agg(F.min_by(F.struct("doc_id", "text"), F.sha2(F.encode("text", "UTF-8"), 256)).alias("_first"))
    marked = copies.select(F.col("_first.doc_id").alias("doc_id"), F.col("_first.text").alias("text"), F.col("_to").alias("_range"), F.lit(1).alias("_mark"))
    every = placed.select("doc_id", "text", "_range", F.lit(0).alias("_mark")).unionByName(marked)
    window = Window.partitionBy("_range").orderBy("_mark", *order)
    following = every.select("doc_id", "text", "_mark", F.lead("doc_id").over(window).alias("next_id"), F.lead("text").over(window).alias("next_text"))
    return following.where("_mark = 0").drop("_mark")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to the edited text and to the next document."""
    docs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.length("text")
    moved = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - moved), F.substring("next_text", F.lit(1), moved))
    rows = docs.select("doc_id", "text", "next_id", "next_text", n.cast("long").alias("n_chars"), edited.alias("edited"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("row", "doc_id", "n_chars", "next_id", F.xxhash64("next_text").alias("next_digest"), F.xxhash64("text").alias("digest"), F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256)).alias("edited_digest"), "text", "edited")
    about = ["row", "doc_id", "n_chars", "next_id", "next_digest", "digest", "edited_digest"]
    each = rows.select(*about, F.posexplode(F.array("text", "edited")).alias("edit", "text"))
    lanes = fingerprints(each, [*about, "edit"])
    both = settled(lanes.groupBy(*about).agg(*[F.max(F.when(F.col("edit") == k, F.col("lanes"))).alias(name) for k, name in enumerate(("own", "changed"))]), "fingerprints")
    of_next = both.groupBy(F.col("doc_id").alias("next_id"), F.col("digest").alias("next_digest")).agg(F.max("own").alias("following"))
    found = both.join(of_next, both["next_id"].eqNullSafe(of_next["next_id"]) & (both["next_digest"] == of_next["next_digest"]), "left")
    return found.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("edited_digest")).alias("edited_sha256"),
        as_hex(F.col("own")).alias("fingerprint"),
        as_hex(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
