"""Operators on small exact cases, queries against their SQL, and the shape of plans."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from panelforge.functions import expressions as E
from panelforge.operators import cleaning, inference, portfolio, profiling, ranking, resampling, scoring, similarity
from panelforge.plans import registered
from panelforge.sources import ingest

ORACLES = [
    "stat_profile", "dq_missingness", "out_consensus", "win_adaptive", "imp_by_type", "trf_proxies", "rank_global", "rank_descending", "nrm_robust", "nrm_adaptive", "scr_pillars", "scr_sector_position", "pref_top", "pref_gated",
    "agg_strategies", "agg_crosstab", "agg_bin_spread", "agg_gini", "agg_movers", "corr_rank_ic", "corr_kendall", "reg_multiple", "test_kruskal", "test_wilcoxon", "test_ks", "test_jonckheere", "ts_measures", "src_facts", "src_fuzzy",
    "test_two_groups", "reg_breusch_pagan", "scr_pillars_full", "scr_config", "corr_decay", "test_validity", "agg_verdicts", "res_weight_cv", "sim_euclidean", "sim_jaccard", "sim_nearest", "res_grid", "res_bootstrap_ic", "res_folds",
]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, sf_dir, name):
    query, sql = registered()[name]
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
    expected = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall()
    assert got == sorted(str([plain(v) for v in r]) for r in expected)


def test_registered_queries_have_names_and_sql():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and len(names) > 100


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 20


def test_global_ranks_use_no_single_partition(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_extendedprice")
    plan = ranking.with_rank(lines, "l_extendedprice")._jdf.queryExecution().executedPlan().toString()
    big = [part for part in plan.split("Exchange SinglePartition")[1:] if "l_extendedprice" in part.split("\n")[1]]
    assert not big


def test_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, None), (5, 2.0)], "id int, x double")
    got = {r["id"]: r["rank"] for r in ranking.with_rank(df, "x").collect()}
    assert got == {1: 3.5, 2: 1.0, 3: 3.5, 4: None, 5: 2.0}
    down = {r["id"]: r["rank"] for r in ranking.with_rank(df, "x", descending=True).collect()}
    assert down == {1: 1.5, 2: 4.0, 3: 1.5, 4: None, 5: 3.0}
    q = ranking.quantiles(df, [], "x", {"m": 0.5, "a": 0.25}).head()
    assert (q["m"], q["a"]) == (2.5, 1.75)
    assert ranking.with_rank(df.limit(0), "x").count() == 0


def test_group_median_fill(spark):
    rows = [("A", "Tech", 1.0), ("B", "Tech", None), ("C", "Health", 3.0), ("D", "Health", None), ("E", "Tech", 5.0), ("F", "Health", 6.0), ("G", "None", None)]
    long = spark.createDataFrame(rows, "entity_id string, sector string, value double").withColumn("indicator", F.lit("x"))
    got = {r["entity_id"]: (r["value"], r["filled"]) for r in cleaning.filled_by_group(long, "sector").collect()}
    assert got["B"] == (3.0, "group") and got["D"] == (4.5, "group") and got["A"] == (1.0, "real") and got["G"] == (4.0, "all")


def test_caps_and_flags(spark):
    values = [*map(float, range(1, 10)), 1000.0]
    long = spark.createDataFrame([("x", v) for v in values] + [("same", 5.0)] * 10, "indicator string, value double")
    clipped = cleaning.quantile_clipped(long, 0.05, 0.95, ["indicator"])
    top = clipped.where("indicator = 'x'").agg(F.max("value"), F.min("value")).head()
    assert top[0] == pytest.approx(554.05) and top[1] == pytest.approx(1.45)
    flags = {r["indicator"]: r for r in cleaning.consensus_outliers(long).collect()}
    assert flags["same"]["n_consensus"] == 0 and flags["x"]["n_consensus"] == 1


def test_robust_z_of_constant_is_zero(spark):
    long = spark.createDataFrame([("x", 2.0)] * 4, "indicator string, value double")
    assert {r["norm"] for r in scoring.robust_z(long, ["indicator"]).collect()} == {0.0}


def test_flips(spark):
    long = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 4.0)], "indicator string, value double")
    for method, flip in (("zscore", lambda v: -v), ("minmax", lambda v: 1 - v), ("percentile", lambda v: 100 - v)):
        a = [r["norm"] for r in scoring.normalised(long, method).orderBy("value").collect()]
        b = [r["norm"] for r in scoring.normalised(long, method, inverse=["x"]).orderBy("value").collect()]
        assert b == pytest.approx([flip(v) for v in a])


def test_similarities(spark):
    one, other, zero = [1.0, 0.0, 2.0], [0.0, 3.0, 0.0], [0.0, 0.0, 0.0]
    df = spark.createDataFrame([(one, one), (one, other), (one, zero)], "a array<double>, b array<double>")
    got = df.select(similarity.cosine(F.col("a"), F.col("b")), similarity.jaccard(F.col("a"), F.col("b")), similarity.distance(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 9) for r in got] == [1.0, 0.0, 0.0] and [r[1] for r in got] == [1.0, 0.0, 0.0] and got[0][2] == 0.0


def test_normal_functions(spark):
    df = spark.createDataFrame([(0.975,), (0.5,), (0.001,)], "p double").withColumn("z", E.probit(F.col("p"))).withColumn("back", E.normal_cdf(F.col("z")))
    for r in df.collect():
        assert r["back"] == pytest.approx(r["p"], abs=1e-6)
    assert df.where("p = 0.975").head()["z"] == pytest.approx(1.959964, abs=1e-6)


def test_tests_on_textbook_values(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "a"), (4.0, "b"), (5.0, "b"), (6.0, "b")], "x double, g string")
    assert inference.mann_whitney(df, "x", "g", "a", "b").head()["u"] == 0.0
    assert inference.mann_whitney(df, "x", "g", "b", "a").head()["cliffs_delta"] == 1.0
    assert inference.kruskal(df, "x", "g").head()["h"] == pytest.approx(27 / 7)
    assert inference.anova(df, "x", "g").head()["f"] == pytest.approx(13.5)
    assert inference.two_sample_ks(df, "x", F.col("g") == "a").head()["d"] == 1.0
    ranks = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 1.0)], "x double, y double")
    assert inference.kendall(ranks, "x", "y").head()["tau_b"] == pytest.approx(-1 / 3)


def test_portfolios(spark):
    scores = spark.createDataFrame([(i, "s", float(i // 2)) for i in range(6)], "entity_id int, strategy string, score double")
    assert sorted(r["entity_id"] for r in portfolio.members(scores, 3).collect()) == [2, 4, 5]
    assert portfolio.gini(spark.createDataFrame([(1.0,)] * 5, "x double"), "x").head()["gini"] == pytest.approx(0.04)  # the first trapezoid begins at the first row


def test_profiles_of_empty_frames(spark):
    empty = spark.createDataFrame([], "entity_id int, indicator string, value double")
    assert profiling.column_statistics(empty, ["indicator"]).count() == 0
    assert cleaning.consensus_outliers(empty).count() == 0


def test_weights_and_batches():
    grid = resampling.grid({"a": [0.3, 0.6], "b": [0.3, 0.5]}, ["c", "d"])
    assert all(sum(w.values()) == pytest.approx(1) for w in grid.values()) and len(grid) == 2
    assert resampling.batches(100_000_000, 5) == [(0, 1), (2, 3), (4, 4)]


def test_sources(spark, tmp_path):
    frame = spark.createDataFrame([(1, True), (2, None), (3, False)], "id int, flag boolean")
    ingest.write_table(frame, f"{tmp_path}/t", "sample only")
    back = ingest.first_existing(spark, [f"{tmp_path}/absent", f"{tmp_path}/t"])
    assert back.columns == ["id", "flag", "caveat"] and ingest.without_flagged(back, "flag").count() == 2
    (tmp_path / "c.csv").write_text("# note\na,b\n1,2\n")
    assert ingest.first_existing(spark, [f"{tmp_path}/c.csv"]).collect()[0].asDict() == {"a": "1", "b": "2"}
    with pytest.raises(FileNotFoundError):
        ingest.first_existing(spark, [f"{tmp_path}/absent"])


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("hot", [2_000, 3])
def test_fuzzy_names_equal_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(ingest, "HOT_NAMES", hot)
    rnd = random.Random(5)
    stems = ["google", "acme steel works", "north sea oil", "zeta", "ab", "x", "", "general electric holdings of ohio"]

    def changed(name: str) -> str:
        for _ in range(rnd.randint(0, 1 + len(name) // 4)):
            at = rnd.randint(0, len(name))
            name = rnd.choice([name[:at] + rnd.choice("abeo ") + name[at:], name[:at] + name[at + 1 :], name[:at] + rnd.choice("abeo") + name[at + 1 :]])
        return name

    left, right = ([changed(rnd.choice(stems)) + end for _ in range(120)] for end in (" Inc", " Corp."))
    left, right = [*left, "Gogle", None, "Inc"], [*right, "Google", None]
    plain = lambda n: " ".join(w for w in n.lower().replace(".", " ").split() if w not in ingest.NAME_SUFFIXES)
    like = lambda a, b: 1 - edits(a, b) / max(len(a), len(b), 1)
    best = lambda n: min(((-r, m) for m in right if m is not None and (r := like(plain(n), plain(m))) >= 0.78), default=(None, None))[1]
    frame = lambda names, c: spark.createDataFrame(list(enumerate(names)), f"id int, {c} string")
    got = {r["id"]: r["match"] for r in ingest.fuzzy_match(frame(left, "name"), frame(right, "firm").drop("id"), "name", "firm").collect()}
    assert got == {i: None if n is None else best(n) for i, n in enumerate(left)}
    assert best("Gogle") is not None


def test_fuzzy_query_reads_every_customer(spark, sf_dir):
    test_query_equals_sql(spark, sf_dir, "src_fuzzy_all")


@pytest.mark.parametrize("ways", [2_000, 1])
def test_fuzzy_names_by_shortened_names_and_by_pieces(spark, monkeypatch, ways):
    """Numbers behind a prefix that all names share; with one way to shorten, all go by pieces."""
    monkeypatch.setattr(ingest, "WAYS", ways)
    left, right = [f"Acme {i * 37:09d} Corp." for i in range(60)], [f"ACME {i * 11:09d}x Inc" for i in range(40)]
    plain = lambda n: " ".join(n.lower().split()[:2])
    like = lambda a, b: 1 - edits(a, b) / max(len(a), len(b))
    best = [min(((-r, m) for m in right if (r := like(plain(n), plain(m))) >= 0.78), default=(None, None))[1] for n in left]
    rows = ingest.fuzzy_match(spark.createDataFrame(list(enumerate(left)), "id int, name string"), spark.createDataFrame([(r,) for r in right], "firm string"), "name", "firm").collect()
    assert {r["id"]: r["match"] for r in rows} == dict(enumerate(best))


def test_shortened_names_are_few(spark):
    """Candidates of a number's name: not every name with the same prefix."""
    names = spark.createDataFrame([(f"acme {i:09d}",) for i in range(50)], "_a string")
    keys = ingest._shortened(names, "_a", {14: {(14, 15, 0)}}).groupBy("_k").count()
    assert keys.count() == 50 and keys.agg({"count": "max"}).head()[0] == 1
