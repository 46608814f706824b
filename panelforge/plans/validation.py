"""Registered queries: folds, held-out sectors and the weights that training groups prefer, over three horizons of spending growth."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.expressions import ratio
from panelforge.functions.tables import settled
from panelforge.operators import resampling as W
from panelforge.operators import splits as V
from panelforge.plans.clean import rounded
from panelforge.plans.score import FACTORS
from panelforge.plans.series_and_weights import uniform_sql
from panelforge.sources.panels import PANEL_SQL, entity_panel, table

#: Days of a window and of the one before it: growth of spending from one to the other.
HORIZONS = {"g180": 180, "g365": 365, "g730": 730}
FOLDS = 5
CANDIDATES = 2000
HELD_OUT = 2
#: market segments of the customers
SECTORS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
XS = [f for f in FACTORS if f != "momentum"] + ["mean_discount"]
PAIRS = [f"{f}~{h}" for f in XS for h in HORIZONS]


def growth(spark, sf_dir):
    """entity_id, the growth of spending over each horizon, and the age in days at the first order."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate").alias("last"))  # one row
    age = F.datediff("last", "o_orderdate")
    window = lambda lo, hi: F.sum(F.when((age >= lo) & (age < hi), F.col("o_totalprice")))
    sums = orders.crossJoin(F.broadcast(last)).groupBy(F.col("o_custkey").alias("entity_id")).agg(
        F.max(age).alias("age"), *[window(lo, hi).alias(f"{n}_{k}") for n, d in HORIZONS.items() for k, (lo, hi) in enumerate(((0, d), (d, 2 * d)))]
    )
    return sums.select("entity_id", "age", *[F.round(ratio(F.col(f"{n}_0"), F.col(f"{n}_1")) - 1, 6).alias(n) for n in HORIZONS])


GROWTH_SQL = f"""sums AS (
  SELECT o_custkey AS entity_id, max(age) AS age, {", ".join(f"sum(o_totalprice) FILTER (age < {d}) AS {n}_0, sum(o_totalprice) FILTER (age >= {d} AND age < {2 * d}) AS {n}_1" for n, d in HORIZONS.items())}
  FROM (SELECT *, date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) AS age FROM orders) GROUP BY o_custkey
), growth AS (
  SELECT entity_id, age, {", ".join(f"ROUND({n}_0 / nullif({n}_1, 0) - 1, 6) AS {n}" for n in HORIZONS)} FROM sums
)"""


def _rows(spark, sf_dir):
    return settled(entity_panel(spark, sf_dir).join(growth(spark, sf_dir), "entity_id", "left"), "panel")


def _folded(spark, sf_dir):
    return settled(V.quasi_temporal_folds(_rows(spark, sf_dir), "revenue", "age", FOLDS), "folds")


def _long(rows, group: str):
    pairs = [F.struct(F.lit(f"{f}~{h}").alias("pair"), F.col(f).cast("double").alias("x"), F.col(h).cast("double").alias("y")) for f in XS for h in HORIZONS]
    return rows.select(F.col(group).alias("group"), F.explode(F.array(*pairs)).alias("p")).select("group", "p.*")


def _statistics(rows, group: str, groups: list, splits: dict[str, list]):
    s = V.split_statistics(_long(rows, group), PAIRS, groups, splits)
    return settled(s.select(F.substring_index("pair", "~", 1).alias("factor"), F.substring_index("pair", "~", -1).alias("target"), "split", "side", "n", "rho", "spread"), "statistics")


FOLD_SPLITS = {str(k): [k] for k in range(FOLDS)}
SECTOR_SPLITS = {s: [s] for s in SECTORS}
WALK_SPLITS = V.held_out_sets(SECTORS, HELD_OUT)


def res_quasi_folds(spark, sf_dir):
    """Folds by size bins and age of every entity."""
    return _folded(spark, sf_dir).select("entity_id", "fold")


def res_fold_statistics(spark, sf_dir):
    """Rank correlation and spread of every factor and horizon, in training and test groups of each fold."""
    return rounded(_statistics(_folded(spark, sf_dir), "fold", list(range(FOLDS)), FOLD_SPLITS))


def _candidates(spark):
    even = W.weight_rows(spark, {"even": dict.fromkeys(XS, 1.0)})
    return settled(V.bounded_weights(W.random_weights(spark, XS, CANDIDATES, 31).unionByName(even), len(XS)), "candidates")


def res_fold_weights(spark, sf_dir):
    """The weights that each fold's training groups prefer, of 2,000 drawn within their bounds."""
    rows = _folded(spark, sf_dir)
    stats = _statistics(rows, "fold", list(range(FOLDS)), FOLD_SPLITS)
    return rounded(V.fold_weights(stats, _candidates(spark), V.split_sizes(rows, "fold", "sector", FOLD_SPLITS)))


def _ratios(rows, group, groups, splits, spark):
    stats, sizes = _statistics(rows, group, groups, splits), settled(V.split_sizes(rows, group, "sector", splits), "sizes")
    return rounded(V.weighted_ratios(stats, V.fold_weights(stats, _candidates(spark), sizes), sizes), 4)


def res_fold_ratios(spark, sf_dir):
    """Information ratios of the weighted spreads in and outside each fold, adjusted for the effective number of rows."""
    return _ratios(_folded(spark, sf_dir), "fold", list(range(FOLDS)), FOLD_SPLITS, spark)


def res_sector_out(spark, sf_dir):
    """Rank correlations inside and outside each held-out sector."""
    return rounded(_statistics(_rows(spark, sf_dir), "sector", SECTORS, SECTOR_SPLITS).drop("spread"))


def res_walk_forward(spark, sf_dir):
    """Ratios for every choice of two held-out sectors."""
    return _ratios(_rows(spark, sf_dir), "sector", SECTORS, WALK_SPLITS, spark)


_FOLDS_SQL = f"""WITH {PANEL_SQL}, {GROWTH_SQL}, both_sides AS (
  SELECT panel.*, age, {", ".join(HORIZONS)} FROM panel LEFT JOIN growth USING (entity_id)
), sized AS (
  SELECT *, coalesce(revenue, (SELECT quantile_cont(revenue, 0.5) FROM panel)) AS size, coalesce(age, (SELECT quantile_cont(age, 0.5) FROM growth)) AS seniority FROM both_sides
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY size, entity_id) - 1 AS r, count(*) OVER () AS total FROM sized
), binned AS (
  SELECT *, {" + ".join(f"(r > (total - 1) * {j / FOLDS})::INT" for j in range(1, FOLDS))} AS bin FROM ranked
), rows_in AS (
  SELECT *, ((row_number() OVER (PARTITION BY bin ORDER BY seniority, entity_id) - 1) % {FOLDS})::INT AS fold FROM binned
)"""


def _splits_sql(group: str, splits: dict[str, list]) -> str:
    values = ", ".join(f"('{s}', '{g}')" for s, names in splits.items() for g in names)
    return f"""{_FOLDS_SQL}, tested(split, grp) AS (
  VALUES {values}
), names AS (
  SELECT DISTINCT split FROM tested
), placed AS (
  SELECT rows_in.*, split, CASE WHEN EXISTS (SELECT 1 FROM tested t WHERE t.split = names.split AND t.grp = rows_in.{group}::VARCHAR) THEN 'test' ELSE 'train' END AS side FROM rows_in, names
), long AS (
  {" UNION ALL ".join(f"SELECT '{f}' AS factor, '{h}' AS target, split, side, {f} AS x, {h} AS y FROM placed WHERE {f} IS NOT NULL AND {h} IS NOT NULL" for f in XS for h in HORIZONS)}
), ranks AS (
  SELECT factor, target, split, side, x, y, rank() OVER (PARTITION BY factor, target, split, side ORDER BY x) + (count(*) OVER (PARTITION BY factor, target, split, side, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY factor, target, split, side ORDER BY y) + (count(*) OVER (PARTITION BY factor, target, split, side, y) - 1) / 2.0 AS ry FROM long
), edges AS (
  SELECT factor, target, split, side, quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi FROM long GROUP BY ALL
), stats AS (
  SELECT factor, target, split, side, count(*) AS n, CASE WHEN count(*) >= 10 THEN corr(rx, ry) END AS rho, CASE WHEN count(*) >= 15 THEN avg(y) FILTER (x > hi) - avg(y) FILTER (x <= lo) END AS spread
  FROM ranks JOIN edges USING (factor, target, split, side) GROUP BY ALL
)"""


_SIZES = """, counts AS (
  SELECT split, side, sector, count(*)::DOUBLE AS n FROM placed GROUP BY ALL
), sizes AS (
  SELECT split, side, sum(n)::BIGINT AS nrows, sum(n) FILTER (sector IS NOT NULL) ** 2 / sum(n * n) FILTER (sector IS NOT NULL) AS effective FROM counts GROUP BY ALL
)"""
_WEIGHTS = f"""{_SIZES}, drawn AS (
  SELECT i::VARCHAR AS candidate, factor, -ln(greatest({uniform_sql("'31'", "i::VARCHAR", "factor")}, 1e-12)) AS e FROM range({CANDIDATES}) t(i), (SELECT unnest([{", ".join(f"'{f}'" for f in XS)}]) AS factor)
  UNION ALL SELECT 'even', factor, 1 FROM (SELECT unnest([{", ".join(f"'{f}'" for f in XS)}]) AS factor)
), scaled AS (
  SELECT candidate, factor, 0.02::DOUBLE + (1 - {len(XS)} * 0.02::DOUBLE) * e / sum(e) OVER (PARTITION BY candidate) AS w FROM drawn
), bounded AS (
  SELECT * FROM scaled QUALIFY max(w) OVER (PARTITION BY candidate) <= 0.35
), ics AS (
  SELECT split, factor, avg(rho) AS ic FROM stats WHERE side = 'train' GROUP BY ALL
), moments AS (
  SELECT split, avg(ic) AS m, count(ic) AS k, var_pop(ic) * count(ic) AS spread, 1 / greatest(any_value(nrows) - 3, 1)::DOUBLE AS v FROM ics JOIN (SELECT * FROM sizes WHERE side = 'train') USING (split) GROUP BY split
), shrunk AS (
  SELECT split, factor, ic, CASE WHEN k <= 3 THEN ic WHEN spread <= 1e-12 THEN m ELSE m + greatest(0, least(1, 1 - (k - 3) * v / spread)) * (ic - m) END AS s FROM ics JOIN moments USING (split)
), goals AS (
  SELECT split, candidate, ROUND(sum(w * s) - 0.25::DOUBLE * sum(w * w) - 0.05::DOUBLE * sum(w * ln(w)), 12) AS goal FROM bounded JOIN shrunk USING (factor) GROUP BY ALL
), best AS (
  SELECT * FROM goals QUALIFY row_number() OVER (PARTITION BY split ORDER BY goal DESC, candidate DESC) = 1
), chosen AS (
  SELECT split, candidate, goal, factor, ic, s, w FROM best JOIN bounded USING (candidate) JOIN shrunk USING (split, factor)
)"""
_RATIOS = f"""{_WEIGHTS}, spreads AS (
  SELECT split, side, target, sum(w * coalesce(spread, 0)) AS s FROM stats JOIN (SELECT split, factor, w FROM chosen) USING (split, factor) GROUP BY ALL
), irs AS (
  SELECT split, side, CASE WHEN count(s) > 1 AND stddev_samp(s) > 1e-12 THEN avg(s) / stddev_samp(s) END AS ir FROM spreads GROUP BY ALL
), adjusted AS (
  SELECT split, side, ir, ir * sqrt(effective / nrows) AS a, nrows FROM irs JOIN sizes USING (split, side)
), wide AS (
  SELECT split, max(ir) FILTER (side = 'train') AS ti, max(ir) FILTER (side = 'test') AS si, max(a) FILTER (side = 'train') AS ta, max(a) FILTER (side = 'test') AS sa, max(nrows) FILTER (side = 'train') AS n_train, max(nrows) FILTER (side = 'test') AS n_test FROM adjusted GROUP BY split
)
SELECT split, round(ti, 4) AS train_ir, round(si, 4) AS test_ir, round(ta, 4) AS train_adjusted, round(sa, 4) AS test_adjusted, round(CASE WHEN abs(sa) > 1e-12 THEN ta / sa END, 4) AS ratio, n_train, n_test FROM wide"""

QUERIES = {
    "res_quasi_folds": (res_quasi_folds, f"{_FOLDS_SQL} SELECT entity_id, fold FROM rows_in"),
    "res_fold_statistics": (res_fold_statistics, f"{_splits_sql('fold', FOLD_SPLITS)} SELECT factor, target, split, side, n, round(rho, 5) AS rho, round(spread, 5) AS spread FROM stats"),
    "res_fold_weights": (
        res_fold_weights,
        f"{_splits_sql('fold', FOLD_SPLITS)}{_WEIGHTS} SELECT split, candidate, round(goal, 5) AS goal, factor, round(ic, 5) AS ic, round(s, 5) AS shrunk, round(w, 5) AS w FROM chosen",
    ),
    "res_fold_ratios": (res_fold_ratios, f"{_splits_sql('fold', FOLD_SPLITS)}{_RATIOS}"),
    "res_sector_out": (res_sector_out, f"{_splits_sql('sector', SECTOR_SPLITS)} SELECT factor, target, split, side, n, round(rho, 5) AS rho FROM stats"),
    "res_walk_forward": (res_walk_forward, f"{_splits_sql('sector', WALK_SPLITS)}{_RATIOS}"),
}
