"""Ingestion-side operators: scans, nested facts, merges, membership flags, keys and fuzzy names."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.tables import settled

NAME_SUFFIXES = ("inc", "corp", "corporation", "company", "co", "ltd", "limited", "plc", "llc")


def first_existing(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """The first of the paths that Spark's readers can open, as Parquet or CSV by its ending; lines from '#' on in CSV are comments."""
    missing = None
    for path in paths:
        try:
            return spark.read.csv(path, **({"header": True, "comment": "#"} | options)) if path.endswith(".csv") else spark.read.parquet(path)
        except Exception as error:  # the reader says that it isn't there; the next one is tried
            if "PATH_NOT_FOUND" not in str(error):
                raise
            missing = error
    raise FileNotFoundError(f"none of {paths}") from missing


def without_flagged(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag isn't true; a null flag is kept."""
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def write_table(df: DataFrame, path: str, caveat: str | None = None) -> None:
    """df as Parquet, with a caveat column if one is given."""
    (df.withColumn("caveat", F.lit(caveat)) if caveat else df).write.mode("overwrite").parquet(path)


#: Layout of nested filing facts, and the units that a tag's values are taken from, in this order.
FACTS_SCHEMA = "map<string, struct<units: map<string, array<struct<form: string, end: string, val: double>>>>>"
UNIT_PRIORITY = ("USD", "pure", "shares", "USD/shares")


def facts(df: DataFrame, key: str, namespaces: dict[str, str]) -> DataFrame:
    """(key, namespace, tag, form, end, val): facts of JSON columns (namespace -> column), each tag in the first unit of UNIT_PRIORITY that it has."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("namespace"), F.from_json(c, FACTS_SCHEMA).alias("tags")) for n, c in namespaces.items()]))
    tags = df.select(key, each.alias("f")).select(key, "f.namespace", F.explode("f.tags").alias("tag", "body"))
    units = F.map_keys("body.units")
    best = F.coalesce(*[F.when(F.array_contains(units, u), F.lit(u)) for u in UNIT_PRIORITY])
    return tags.withColumn("_u", best).where("_u is not null").select(key, "namespace", "tag", F.explode(F.element_at("body.units", F.col("_u"))).alias("v")).select(key, "namespace", "tag", "v.*")


def latest_annual(facts: DataFrame, key: str, forms=("10-K", "10-K/A", "DEF 14A"), since: str = "2022-01-01") -> DataFrame:
    """(key, tag, value): the value with the latest end among annual forms, else among facts that end on or after ``since``."""
    annual = F.col("form").isin(*forms)
    pick = lambda c: F.max_by(F.when(c, F.col("val")), F.when(c, F.col("end")))
    return facts.groupBy(key, "tag").agg(F.coalesce(pick(annual), pick(F.col("end") >= since)).alias("value")).where("value is not null")


def first_reported(values: DataFrame, key: str, tags: list[str], out: str) -> DataFrame:
    """(key, out): the value of the first of several tags that is reported."""
    return values.groupBy(key).agg(F.coalesce(*[F.max(F.when(F.col("tag") == t, F.col("value"))) for t in tags]).alias(out))


def normalised_key(x: Column) -> Column:
    """Exchange suffix off, upper case."""
    return F.upper(F.substring_index(F.trim(x), ".", 1))


def padded(x: Column, width: int = 10) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def plain_name(x: Column) -> Column:
    """Lower-case letters and digits of a company name without legal suffixes."""
    words = F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(*NAME_SUFFIXES))
    return F.array_join(words, " ")


#: Names of one side that a tile of a hot key holds at most.
HOT_NAMES = 2_000
#: Joins of keys and names are by shuffle: plans take keys for as few as the names they come from, and a small file holds many names, so the driver would be handed tables for broadcast that it can't hold.
BY_SHUFFLE = "merge"
#: Steps in which the edits allowed grow, and ways to shorten a name beyond which it is cut into pieces instead.
STEPS, WAYS = 3, 2_000


def _shortened(names: DataFrame, name: str, dropped: dict[int, set[tuple[int, int, int]]]) -> DataFrame:
    """(name, key): numbers of what is left of a name without some of its characters, for ``dropped`` (length -> (own part of the key, two numbers; characters left out)).

    Two names of given lengths with at most t edits have a part in common that leaves out t characters of the longer and t less the difference of the shorter."""

    def of(batches):
        for b in batches:
            column = b.column(0).to_pylist()
            sizes = np.array([len(x) for x in column])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                own = [column[i] for i in at]
                codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), size).astype(np.uint64)
                for one, other, out in sorted(dropped.get(size, ())):
                    kept = np.array(list(combinations(range(size), size - out)), dtype=int).reshape(comb(size, out), size - out)
                    factors = np.random.default_rng([one, other]).integers(1, 1 << 63, size - out + 1, dtype=np.uint64) | np.uint64(1)
                    step = max(1, (1 << 20) // max(1, kept.size))
                    for lo in range(0, len(own), step):
                        keys = (codes[lo : lo + step, kept] * factors[1:]).sum(-1, dtype=np.uint64) + factors[0]
                        offsets = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array(own[lo : lo + step]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))], [name, "_k"])

    return names.mapInArrow(of, f"{name} string, _k array<bigint>").select(name, F.explode(F.array_distinct("_k")).alias("_k"))


def _likeness_keys(names: DataFrame, name: str, least: float, indexed: bool) -> DataFrame:
    """(name, key): the pieces of an indexed name, or the substrings of a probing name that can equal them.

    A name of n characters is at most ``t`` edits from any that is at least ``least`` like it; of its t + 1 pieces some piece i is then whole
    with i edits at most before it and the others after it, which bounds its place in the probing name.
    """
    share, slack = 1 - least, 1e-9
    floor = lambda c: F.floor(c + slack).cast("int")
    own = F.length(name)
    sizes = F.array(own) if indexed else F.sequence(F.ceil(own * least - slack).cast("int"), floor(own / least))
    n, i = F.col("_n"), F.col("_i")
    parts = floor(floor(n / least) * share) + 1
    place = lambda j: F.floor(j * n / parts).cast("int")
    edits = floor(F.greatest(own, n) * share)
    k = names.select(name, F.explode(sizes).alias("_n")).select(name, "_n", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_i")).select(name, "_n", "_i", place(i).alias("_p"), (place(i + 1) - place(i)).alias("_s"))
    if not indexed:
        first = F.greatest(-i, own - n - edits + i, -F.col("_p"))
        last = F.least(i, own - n + edits - i, own - F.col("_s") - F.col("_p"))
        k = k.where(first <= last).select(name, "_n", "_i", "_s", F.explode(F.sequence(F.col("_p") + first, F.col("_p") + last)).alias("_p"))
    return k.select(name, F.concat_ws("|", "_n", "_i", F.substring(F.col(name), F.col("_p") + 1, F.col("_s"))).alias("_k")).distinct()


def _near(a: DataFrame, b: DataFrame, least: float, lengths: list[tuple[int, int]]) -> DataFrame:
    """(_a, _m): for names _a the best (match, ratio) among names (_b, _r), of the pairs that are at least ``least`` alike; lengths are those of pairs there may be."""
    short: tuple[dict, dict] = ({}, {})
    long: tuple[set, set] = (set(), set())
    for m, n in lengths:
        t = floor(max(m, n) * (1 - least) + 1e-9)
        drop = (t - max(0, n - m), t - max(0, m - n))
        if min(drop) < 0:
            continue
        few = max(comb(m, drop[0]), comb(n, drop[1])) <= WAYS
        for side, own in enumerate((m, n)):
            if few:
                short[side].setdefault(own, set()).add((m, n, drop[side]))
            else:
                long[side].add(own)

    def keys(names: DataFrame, name: str, side: int) -> DataFrame:
        sized = lambda of: names.where(F.length(name).isin(*of))
        pieces = _likeness_keys(sized(long[side]), name, least, indexed=side == 1).select(name, F.xxhash64("_k").alias("_k"))
        return reduce(DataFrame.unionByName, [x for x, used in ((_shortened(sized(short[side]), name, short[side]), short[side]), (pieces, long[side])) if used])

    if not short[0] and not long[0]:
        return a.sparkSession.createDataFrame([], "_a string, _m struct<_r: string, ratio: double>")
    probes, indexed = keys(a, "_a", 0), keys(b.select("_b"), "_b", 1)
    tiles = lambda n: F.ceil(F.col(n) / HOT_NAMES).cast("int")
    size = lambda df, n: df.groupBy("_k").agg(F.count(F.lit(1)).alias(n))
    hot = size(probes, "_na").join(size(indexed, "_nb").hint(BY_SHUFFLE), "_k").where(F.greatest("_na", "_nb") > HOT_NAMES).select("_k", tiles("_na").alias("_ta"), tiles("_nb").alias("_tb"))

    def dealt(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        t = lambda side: F.coalesce(f"_t{side}", F.lit(1))
        return df.join(hot.hint(BY_SHUFFLE), "_k", "left").select(name, "_k", F.pmod(F.xxhash64(name), t(own)).cast("int").alias(f"_x{own}"), F.explode(F.sequence(F.lit(0), t(other) - 1)).alias(f"_x{other}"))

    pairs = dealt(probes, "_a", "a", "b").join(dealt(indexed, "_b", "b", "a").hint(BY_SHUFFLE), ["_k", "_xa", "_xb"])
    like = 1 - F.levenshtein("_a", "_b") / F.greatest(F.length("_a"), F.length("_b"), F.lit(1))
    near = pairs.select("_a", "_b", like.alias("ratio")).where(F.col("ratio") >= least)
    # The best of a task's pairs first: the same pair may come by several keys, which changes no best.
    best = near.groupBy("_a", "ratio", "_b").agg(F.lit(1).alias("_one")).join(b.hint(BY_SHUFFLE), "_b")
    return best.groupBy("_a").agg(F.min_by(F.struct("_r", "ratio"), F.struct((-F.col("ratio")).alias("x"), "_r")).alias("_m"))


def fuzzy_match(left: DataFrame, right: DataFrame, left_name: str, right_name: str, least: float = 0.78) -> DataFrame:
    """left with the right name most like its own (1 - edit distance / longer length, at least ``least``, which is above 0) among all; ties go to the smaller name.

    Names meet by what is left of them without some characters, long ones by pieces, of which every pair that is alike shares one; keys of many names are dealt
    to tiles. The likeness asked for sinks in steps, and a name that has found its best is not looked at again.
    """
    a = settled(left.select(F.col(left_name).alias("_l")).distinct().select("_l", plain_name(F.col("_l")).alias("_a")).where("_a is not null"), "left_names")
    b = settled(right.select(plain_name(F.col(right_name)).alias("_b"), F.col(right_name).alias("_r")).where("_b is not null").groupBy("_b").agg(F.min("_r").alias("_r")), "right_names")
    # Lengths of names: as many as the longest name has characters.
    own, other = ([r[0] for r in df.select(F.length(n)).distinct().collect()] for df, n in ((a, "_a"), (b, "_b")))
    lengths = [(m, n) for m in own for n in other]
    names, found = a.select("_a").distinct(), []
    for step in range(1, STEPS + 1):
        at_least = least if step == STEPS else 1 - (1 - least) * step / STEPS
        found.append(settled(_near(names, b, at_least, lengths), "matches"))
        if step < STEPS:
            names = settled(names.join(found[-1].hint(BY_SHUFFLE), "_a", "left_anti"), "unmatched")
    matched = a.join(reduce(DataFrame.unionByName, found).hint(BY_SHUFFLE), "_a").select("_l", "_m")
    return left.join(matched.hint(BY_SHUFFLE), left[left_name] == matched["_l"], "left").select(left["*"], F.col("_m._r").alias("match"), F.col("_m.ratio").alias("ratio"))


def merged(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """base left-joined with others; a column that both have is filled from the other where it is null."""
    for o in others:
        shared = [c for c in o.columns if c in base.columns and c != key]
        right = o.select(key, *[F.col(c).alias(f"{c}__other") if c in shared else F.col(c) for c in o.columns if c != key])
        base = base.join(right, key, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"{c}__other")) for c in shared}).drop(*[f"{c}__other" for c in shared])
    return base


def facility_totals(df: DataFrame, parent: str, measures: dict[str, list[str]], kind: str) -> DataFrame:
    """(parent, total of each measure, n_kinds): a measure is the first of its columns that isn't null; parents whose totals are all 0 are left out."""
    total = {m: F.sum(F.coalesce(*cols, F.lit(0.0))) for m, cols in measures.items()}
    out = df.groupBy(parent).agg(*[t.alias(m) for m, t in total.items()], F.count_distinct(kind).alias("n_kinds"))
    return out.where(sum((F.col(m) for m in measures), F.lit(0.0)) > 0)


def membership_score(df: DataFrame, key: str, registries: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(key, one flag for each registry, score, n): registries has rows (registry, key)."""
    flags = registries.groupBy(key).agg(*[F.max((F.col("registry") == r).cast("int")).alias(r) for r in weights])
    out = df.select(key).join(flags, key, "left").fillna(0, list(weights))
    return out.withColumn("score", sum((F.col(r) * w for r, w in weights.items()), F.lit(0.0))).withColumn("n", sum((F.col(r) for r in weights), F.lit(0)))
