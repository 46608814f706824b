"""Secret scan in DataFrame functions only: three base patterns and two character Markov models.

Base spans are the leftmost non-overlapping matches of each pattern. A further span, kind ``markov``, is a run
of at least ``RUN`` token characters, or what base spans leave of one if that is still as long, with a part of at least ``PART`` characters
between ``-``, ``_`` and ``/`` (so that dates, UUIDs and most paths have none), whose bigrams are
likelier under the model of random strings than under the one of ordinary identifiers by ``THRESHOLD`` nats for each
character. Both models are bigram counts learned from labelled samples: values of base matches are random strings,
longer words, identifiers and paths of documents without a base match are ordinary. Base matches are looked for in all documents; each label
is then sampled by itself, from the ``SAMPLE_DOCS`` documents of its kind with the smallest hash (all documents with the last hash come along,
so repeated rows and ties change nothing). Without any base match, or any ordinary word, in the whole table no span is added.

A key that stands alone in a document must not teach the ordinary model what it is to be told from: an ordinary sample consists of pieces that read
like words (``PIECE``), every value counts once however often it occurs, and the models are fitted twice, the second time without the ordinary samples
that the first ones call random.

Null texts count as empty and have no spans; positions are code points, ends exclusive. Repeated rows get the
same spans, whatever their doc_id. Very long texts are scanned whole; an empty table gives no rows. Columns named ``_<spans>_...`` and the
one for spans are replaced, others carried along.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import settled

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"[0-9a-f]{16,}"  # [0-9a-f]+ of 16 characters or more
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")

RUN = 20
PART = 16
SAMPLE_DOCS = 16_384
THRESHOLD = 0.5
SMOOTH = 4.0
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
WIDTH = len(ALPHABET) + 1
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{RUN},}}"
ORDINARY = "[A-Za-z0-9+/_=-]{8,}"
#: What ordinary samples consist of: words, capitals, short numbers, separators.
PIECE = "[A-Z]?[a-z]{3,}+|[A-Z]{3,}+|(?<![0-9])[0-9]{1,4}(?![0-9])|[-_/+=]"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _spans(text: Column, found: Column, pattern: str, kind: int) -> Column:
    """Places of the matches in found: the pieces of text between them have the remaining lengths."""
    none = F.array().cast(SPANS)
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda piece, value: F.struct(F.length(piece).alias("gap"), value.alias("value")))

    def add(acc: Column, step: Column) -> Column:
        start = acc["at"] + step["gap"]
        end = start + F.length(step["value"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), step["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


def base_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with the array ``spans`` (start, kind number, end, value) of all base matches, by start and kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    names = [f"_{spans}_{k}" for k in range(3)]
    found = docs.withColumns({n: _found(t, p) for n, p in zip(names, (ASSIGN, ACCESS, HEX), strict=True)})
    each = [_spans(t, F.col(n), p, k) for k, (n, p) in enumerate(zip(names, (ASSIGN, ACCESS, HEX), strict=True))]
    each[0] = F.filter(each[0], lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_VALUE)
    any_found = F.size(names[0]) + F.size(names[1]) + F.size(names[2]) > 0
    return found.withColumn(spans, F.when(any_found, F.array_sort(F.concat(*each))).otherwise(F.array().cast(SPANS))).drop(*names)


def _pairs(value: Column) -> Column:
    """Places in the model's array of all pairs of neighbouring characters; characters outside the alphabet share one."""
    chars = F.split(value, "")
    n = F.length(value) - 1
    place = lambda c: F.position(c, F.lit(ALPHABET))
    return F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: place(a) * WIDTH + place(b))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float] | None:
    """Log-likelihood ratio of each pair of characters, random against ordinary; None without samples of either kind."""
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("h"))
    secret = F.transform("spans", lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"]))
    labels = settled(base_spans(hashed).select("h", F.when(F.size("spans") > 0, secret).alias("values")), "labels")
    kept = labels.where("values is not null").orderBy("h").limit(sample_docs)
    # Documents are taken up to the hash of the last that fits; copies of it come along.
    last = labels.where("values is null").select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).head()[0]
    if last is None:
        return None
    plain = base_spans(hashed.where(F.col("h") <= last)).where(F.size("spans") == 0)
    random, ordinary = kept.select(F.lit(1).alias("random"), "values"), plain.select(F.lit(0).alias("random"), _found(F.col("text"), ORDINARY).alias("values"))
    values = random.union(ordinary).select("random", F.explode("values").alias("value")).where(F.length("value") > 1)
    reads = F.regexp_replace("value", PIECE, "") == ""
    samples = settled(values.where((F.col("random") == 1) | reads).distinct(), "samples")
    first = _ratios(samples)
    return first and _ratios(samples.where((F.col("random") == 1) | ~_looks_random(F.array("value"), first)))


def _ratios(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of each pair of characters from samples (random, value)."""
    counts = samples.select("random", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("pair").agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o"))
    seen = {row["pair"]: (row["r"], row["o"]) for row in counts.collect()}  # WIDTH squared rows at most
    if not all(any(v[k] for v in seen.values()) for k in (0, 1)):
        return None
    random, ordinary = (_conditional([[seen.get(a * WIDTH + b, (0, 0))[k] for b in range(WIDTH)] for a in range(WIDTH)]) for k in (0, 1))
    return [math.log(r / o) for r, o in zip(random, ordinary, strict=True)]


def _looks_random(parts: Column, model: list[float]) -> Column:
    """Whether the pairs of all parts together are likelier under the model of random strings by THRESHOLD a pair."""
    ratios = F.from_json(F.lit(json.dumps(model)), "array<double>")
    sums = F.aggregate(F.flatten(F.transform(parts, _pairs)), F.lit(0.0), lambda a, p: a + F.get(ratios, p))
    pairs = F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(p) - 1)
    return (pairs > 0) & (sums >= THRESHOLD * pairs)


def _conditional(counts: list[list[int]]) -> list[float]:
    """Probability of each second character after each first one, from counts of pairs, drawn to that of the second alone as if by SMOOTH more pairs."""
    total = sum(map(sum, counts)) + 0.5 * WIDTH
    alone = [(sum(row[b] for row in counts) + 0.5) / total for b in range(WIDTH)]
    return [(row[b] + SMOOTH * alone[b]) / (sum(row) + SMOOTH) for row in counts for b in range(WIDTH)]


def _left_over(run: Column, taken: Column) -> Column:
    """The parts of a run of at least RUN characters that spans, sorted by start, leave."""

    def part(start: Column, end: Column) -> Column:
        value = F.substring(run["value"], start - run["start"] + 1, end - start)
        return F.filter(F.array(F.struct(start.alias("start"), run["kind"].alias("kind"), end.alias("end"), value.alias("value"))), lambda p: p["end"] - p["start"] >= RUN)

    def add(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["parts"], part(acc["at"], b["start"])).alias("parts"))

    cut = F.aggregate(taken, F.struct(run["start"].alias("at"), F.array().cast(SPANS).alias("parts")), add, lambda acc: F.concat(acc["parts"], part(acc["at"], run["end"])))
    return F.when(F.size(taken) > 0, cut).otherwise(F.array(run))


def scan(docs: DataFrame, model: list[float] | None, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with ``spans``: base spans and those that the models add, by start and kind."""
    base = base_spans(docs, text, spans)
    if model is None:
        return base
    t = F.coalesce(F.col(text), F.lit(""))
    runs = _spans(t, F.col(f"_{spans}_runs"), CANDIDATE, 3)
    between = lambda s: F.flatten(F.transform(s, lambda r: _left_over(r, F.filter(spans, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))))
    parts = lambda s: F.filter(F.split(s["value"], "[-_/]"), lambda p: F.length(p) >= PART)
    added = F.filter(between(runs), lambda s: _looks_random(parts(s), model))
    found = base.withColumn(f"_{spans}_runs", _found(t, CANDIDATE))
    return found.withColumn(spans, F.when(F.size(f"_{spans}_runs") > 0, F.array_sort(F.concat(spans, added))).otherwise(F.col(spans))).drop(f"_{spans}_runs")


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of secrets in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, fit(docs))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.encode(joined(F.filter("spans", lambda s: s["kind"] < 3)), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
