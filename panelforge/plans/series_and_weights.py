"""Registered queries: price series, ingestion, similarity, resampling and weight sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.expressions import uniform
from panelforge.functions.tables import settled
from panelforge.operators import resampling as W
from panelforge.operators import scoring as S
from panelforge.operators import series as T
from panelforge.operators import similarity as M
from panelforge.operators import splits as V
from panelforge.operators.draws import rank_correlations
from panelforge.plans.clean import rounded
from panelforge.plans.portfolios import BIN_SQL
from panelforge.plans.score import FACTORS, PROFILES, RANKED_SQL, sql_rank
from panelforge.sources import ingest as N
from panelforge.sources.panels import PANEL_SQL, PRICES_SQL, entity_panel, price_history

TOP = 20


def uniform_sql(*parts: str) -> str:
    """The portable uniform number for DuckDB."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def ts_measures(spark, sf_dir):
    return rounded(T.trailing_measures(price_history(spark, sf_dir)).drop("illiquidity"), 4)


TS_MEASURES = f"""WITH {PRICES_SQL}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY entity ORDER BY day) - 1 AS ret, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS rn FROM prices),
k AS (SELECT *, CASE WHEN rn <= 252 THEN max(CASE WHEN rn <= 252 THEN close END) OVER (PARTITION BY entity ORDER BY day) END AS peak FROM r)
SELECT entity, count(*) AS n_days, round(avg(volume) FILTER (rn <= 30), 4) AS volume_30, round(CASE WHEN count(*) > 90 THEN avg(volume) FILTER (rn <= 90) END, 4) AS volume_90,
  round(100 * stddev_samp(ret) * sqrt(252), 4) AS volatility, round(CASE WHEN count(ret) > 30 THEN 100 * stddev_samp(ret) FILTER (rn <= 30) * sqrt(252) END, 4) AS volatility_30,
  {", ".join(f"round(CASE WHEN count(*) > {k} THEN max(close) FILTER (rn = 1) / max(close) FILTER (rn = {k}) - 1 END, 4) AS momentum_{n}" for n, k in T.MOMENTUM_DAYS.items())},
  round(CASE WHEN count(*) > 252 THEN min(close / peak - 1) END, 4) AS max_drawdown, round(CASE WHEN count(ret) > 252 THEN avg(ret) FILTER (rn <= 252) * 252 / (stddev_samp(ret) FILTER (rn <= 252) * sqrt(252) + 1e-10) END, 4) AS sharpe,
  round(CASE WHEN count(ret) > 252 THEN avg(ret) FILTER (rn <= 252) * 252 / (stddev_samp(ret) FILTER (rn <= 252 AND ret < 0) * sqrt(252) + 1e-10) END, 4) AS sortino, round(avg(ret), 4) AS mean_return, round(skewness(ret), 4) AS skew, round(kurtosis(ret), 4) AS kurtosis FROM k GROUP BY entity"""


def ts_illiquidity(spark, sf_dir):
    return rounded(T.trailing_measures(price_history(spark, sf_dir)).select("entity", "illiquidity"), 5)


TS_ILLIQUIDITY = f"WITH {PRICES_SQL}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY entity ORDER BY day) - 1 AS ret FROM prices) SELECT entity, round(avg(abs(ret) / nullif(volume * close, 0)) * 1e6, 5) AS illiquidity FROM r GROUP BY entity"


def ts_forward(spark, sf_dir):
    p = price_history(spark, sf_dir)
    return rounded(T.forward_returns(p, T.snapshot_day(p), {"1m": 21, "6m": 126}), 5)


TS_FORWARD = f"""WITH {PRICES_SQL}, d AS (SELECT day FROM prices GROUP BY day HAVING count(DISTINCT entity) >= 0.5 * (SELECT count(DISTINCT entity) FROM prices) ORDER BY day DESC LIMIT 127), s AS (SELECT min(day) AS s FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day) - 1 AS i FROM prices, s WHERE day >= s), g AS (SELECT entity, min(day) AS anchor, max(i) AS n, max(close) FILTER (i = 0) AS f, max_by(close, i) AS z, max(close) FILTER (i = 21) AS a, max(close) FILTER (i = 126) AS b FROM l GROUP BY entity)
SELECT entity, anchor, round(CASE WHEN n >= 21 THEN a / f - 1 WHEN n + 1 > 5 THEN z / f - 1 END, 5) AS fwd_1m, n < 21 AS partial_1m, round(CASE WHEN n >= 126 THEN b / f - 1 WHEN n + 1 > 5 THEN z / f - 1 END, 5) AS fwd_6m, n < 126 AS partial_6m FROM g"""


def src_facts(spark, sf_dir):
    """Nested facts built from orders, made long, latest annual value for each customer and priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    fact = F.struct(F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("8-K").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"))
    tag = F.map_from_arrays(F.array(F.concat(F.lit("T"), F.substring("o_orderpriority", 1, 1))), F.array(F.struct(F.map_from_arrays(F.array(F.when(F.col("o_orderkey") % 3 == 0, "USD").otherwise("pure")), F.array(F.array(fact))).alias("units"))))
    nested = o.select("o_custkey", F.to_json(tag).alias("gaap"))
    long = N.facts(nested, "o_custkey", {"us-gaap": "gaap"})
    daily = long.groupBy("o_custkey", "tag", "form", "end").agg(F.max("val").alias("val"))
    return rounded(N.latest_annual(daily, "o_custkey", since="1996-01-01"), 2)


SRC_FACTS = """WITH f AS (SELECT o_custkey, 'T' || substr(o_orderpriority, 1, 1) AS tag, CASE WHEN o_orderstatus = 'F' THEN '10-K' ELSE '8-K' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS e, max(o_totalprice) AS val FROM orders GROUP BY ALL),
g AS (SELECT o_custkey, tag, coalesce(max_by(val, e) FILTER (form = '10-K'), max_by(val, e) FILTER (e >= '1996-01-01')) AS value FROM f GROUP BY ALL) SELECT o_custkey, tag, round(value, 2) AS value FROM g WHERE value IS NOT NULL"""


def src_country_latest(spark, sf_dir):
    """Latest non-null value by country and year, as columns."""
    from panelforge.operators.cleaning import latest

    p = entity_panel(spark, sf_dir)
    rows = p.select("country", (F.col("entity_id") % 7 + 2015).alias("year"), "momentum").groupBy("country", "year").agg(F.sum(F.when(F.col("year") < 2020, F.col("momentum"))).alias("value"))
    return rounded(latest(rows, ["country"], "year", "value", "value").join(rows.where("value is not null").groupBy("country").agg(F.max("year").alias("year")), "country"), 4)


SRC_COUNTRY = f"WITH {PANEL_SQL}, r AS (SELECT country, entity_id % 7 + 2015 AS year, sum(CASE WHEN entity_id % 7 + 2015 < 2020 THEN momentum END) AS value FROM panel GROUP BY ALL) SELECT country, round(max_by(value, year), 4) AS value, max(year) AS year FROM r WHERE value IS NOT NULL GROUP BY country"


def src_facilities(spark, sf_dir):
    parts, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    return rounded(N.facility_totals(rows, "p_brand", {"total": [F.col("tax"), F.col("l_discount")], "volume": [F.col("l_quantity")]}, "p_type"), 3)


SRC_FACILITIES = "SELECT p_brand, round(sum(coalesce(CASE WHEN l_tax > 0 THEN l_tax END, l_discount, 0)), 3) AS total, round(sum(l_quantity), 3) AS volume, count(DISTINCT p_type) AS n_kinds FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand HAVING sum(coalesce(CASE WHEN l_tax > 0 THEN l_tax END, l_discount, 0)) + sum(l_quantity) > 0"


def src_membership(spark, sf_dir):
    p = entity_panel(spark, sf_dir).select("entity_id", "revenue", "momentum")
    reg = p.where("entity_id % 2 = 0").select(F.lit("even").alias("registry"), "entity_id").union(p.where("momentum > 0").select(F.lit("rising"), "entity_id")).union(p.where("entity_id % 5 = 0").select(F.lit("fifth"), "entity_id"))
    return rounded(N.membership_score(p, "entity_id", reg, {"even": 25.0, "rising": 25.0, "fifth": 30.0}))


SRC_MEMBERSHIP = f"WITH {PANEL_SQL}, f AS (SELECT entity_id, (entity_id % 2 = 0)::INT AS even, coalesce(momentum > 0, false)::INT AS rising, (entity_id % 5 = 0)::INT AS fifth FROM panel) SELECT *, 25.0::DOUBLE * even + 25.0::DOUBLE * rising + 30.0::DOUBLE * fifth AS score, even + rising + fifth AS n FROM f"


def src_merge(spark, sf_dir):
    p = entity_panel(spark, sf_dir)
    left = p.select("entity_id", F.when(F.col("entity_id") % 3 != 0, F.col("revenue")).alias("revenue"))
    right = p.where("entity_id % 2 = 0").select("entity_id", (F.col("revenue") + 1).alias("revenue"), "sector")
    return rounded(N.merged(left, [right], "entity_id"), 3)


SRC_MERGE = f"WITH {PANEL_SQL} SELECT entity_id, round(CASE WHEN entity_id % 3 <> 0 THEN revenue WHEN entity_id % 2 = 0 THEN revenue + 1 END, 3) AS revenue, CASE WHEN entity_id % 2 = 0 THEN sector END AS sector FROM panel"


def src_fuzzy(spark, sf_dir):
    """Every customer's name against names of suppliers that have the same legal form and number."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("Acme "), F.substring("c_name", 15, 4), F.lit(" Corp.")).alias("name"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("ACME "), F.substring("s_name", 15, 4), F.lit("x Inc")).alias("firm"))
    return rounded(N.fuzzy_match(c, s, "name", "firm").select("c_custkey", "match", "ratio"))


SRC_FUZZY = """WITH c AS (SELECT c_custkey, 'acme ' || lower(substr(c_name, 15, 4)) AS a FROM customer), s AS (SELECT DISTINCT 'ACME ' || substr(s_name, 15, 4) || 'x Inc' AS firm, 'acme ' || lower(substr(s_name, 15, 4)) || 'x' AS b FROM supplier),
p AS (SELECT c_custkey, firm, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS ratio FROM c, s), q AS (SELECT * FROM p WHERE ratio >= 0.78 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY ratio DESC, firm) = 1)
SELECT c_custkey, firm AS match, round(ratio, 5) AS ratio FROM c LEFT JOIN q USING (c_custkey)"""


def src_fuzzy_all(spark, sf_dir):
    """Every customer's name against the suppliers' names, with whole numbers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("Acme "), F.substring("c_name", 10, 9), F.lit(" Corp.")).alias("name"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("ACME "), F.substring("s_name", 10, 9), F.lit("x Inc")).alias("firm"))
    return rounded(N.fuzzy_match(c, s, "name", "firm").select("c_custkey", "match", "ratio"))


SRC_FUZZY_ALL = """WITH c AS (SELECT c_custkey, 'acme ' || lower(substr(c_name, 10, 9)) AS a FROM customer), s AS (SELECT DISTINCT 'ACME ' || substr(s_name, 10, 9) || 'x Inc' AS firm, 'acme ' || lower(substr(s_name, 10, 9)) || 'x' AS b FROM supplier),
p AS (SELECT c_custkey, firm, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS ratio FROM c, s), q AS (SELECT * FROM p WHERE ratio >= 0.78 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY ratio DESC, firm) = 1)
SELECT c_custkey, firm AS match, round(ratio, 5) AS ratio FROM c LEFT JOIN q USING (c_custkey)"""


def src_keys(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", N.normalised_key(F.concat(F.lit(" x"), F.col("c_custkey").cast("string"), F.lit(".ns "))).alias("ticker"), N.padded(F.col("c_custkey")).alias("padded"))


SRC_KEYS = "SELECT c_custkey, 'X' || c_custkey AS ticker, lpad(c_custkey::VARCHAR, 10, '0') AS padded FROM customer"


def sim_target(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(M.to_target(e, "vec_id", "embedding", 7, 15), 5)


SIM_TARGET = """WITH t AS (SELECT embedding AS t FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, ROUND(list_sum(list_transform(list_zip(embedding, t), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(t, lambda x: x::DOUBLE * x))), 9) AS similarity FROM embeddings, t WHERE vec_id <> 7)
SELECT vec_id, round(similarity, 5) AS similarity, row_number() OVER (ORDER BY similarity DESC, vec_id)::INT AS position FROM s QUALIFY position <= 15"""


def sim_nearest(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(M.nearest(e, "vec_id", "embedding", 5), 5)


SIM_NEAREST = """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS peer, ROUND(list_cosine_similarity(a.e, b.e), 9) AS similarity FROM n a JOIN n b ON a.vec_id <> b.vec_id)
SELECT vec_id, peer, round(similarity, 5) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, peer) <= 5"""


def sim_peer_excess(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.col("label").cast("double"))
    return rounded(M.peer_excess(e, "vec_id", "embedding", "label", 15), 5)


SIM_PEER_EXCESS = """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, label::DOUBLE AS l FROM embeddings), p AS (SELECT a.vec_id, b.l AS bl, a.l AS al FROM n a JOIN n b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY ROUND(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id) <= 15),
x AS (SELECT vec_id, max(al) - avg(bl) AS x FROM p GROUP BY vec_id) SELECT vec_id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 5) AS excess FROM x"""


def _factors(spark, sf_dir):
    norms = S.factor_norms(entity_panel(spark, sf_dir), "entity_id", FACTORS, "rank")
    return norms.unpivot("entity_id", FACTORS, "factor", "x")


def _returns(spark, sf_dir):
    return entity_panel(spark, sf_dir).select("entity_id", F.col("momentum").alias("ret"))


def _candidates_sql(candidates: dict[str, dict[str, float]]) -> str:
    rows = ", ".join(f"('{c}', '{f}', {float(w) / sum(ws.values())!r}::DOUBLE)" for c, ws in candidates.items() for f, w in ws.items())
    long = " UNION ALL ".join(f"SELECT entity_id, '{f}' AS factor, {f} AS x FROM f" for f in FACTORS)
    return f"{RANKED_SQL}, w(candidate, factor, w) AS (VALUES {rows}), long AS ({long}), s AS (SELECT entity_id, candidate, ROUND(sum(w * x), 8) AS score FROM long JOIN w USING (factor) GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, entity_id) AS position FROM s)"


GRID = W.grid({"revenue": [0.1, 0.2, 0.3], "momentum": [0.1, 0.2, 0.3], "return_rate": [0.1, 0.2]}, ["unit_price", "urgent_share"])
CSIR_SQL = f"SELECT candidate, round(avg(momentum), 5) AS mean, round(stddev_samp(momentum), 5) AS std, round(CASE WHEN stddev_samp(momentum) > 1e-12 THEN avg(momentum) / stddev_samp(momentum) ELSE 0 END, 5) AS cs_ir FROM top JOIN panel USING (entity_id) WHERE position <= {TOP} GROUP BY candidate"


def res_grid(spark, sf_dir):
    s = W.evaluated(_factors(spark, sf_dir), W.weight_rows(spark, GRID))
    return rounded(W.ratio_of_top(s, _returns(spark, sf_dir), TOP, ["candidate"]))


RES_GRID = f"{_candidates_sql(GRID)} {CSIR_SQL}"
BASE = PROFILES["even"]
CHANGED = W.one_at_a_time(BASE, [-0.5, 0.5])


def _overlap(candidates):
    def query(spark, sf_dir):
        long = _factors(spark, sf_dir)
        base = W.evaluated(long, W.weight_rows(spark, {"base": BASE})).drop("candidate")
        return rounded(W.overlap_with_base(W.evaluated(long, W.weight_rows(spark, candidates)), base, TOP, ["candidate"]))

    return query


def _overlap_sql(candidates) -> str:
    return f"{_candidates_sql(candidates | {'base': BASE})}, b AS (SELECT entity_id FROM top WHERE candidate = 'base' AND position <= {TOP}) SELECT candidate, round(count(b.entity_id) / {TOP}.0, 5) AS overlap FROM top LEFT JOIN b USING (entity_id) WHERE candidate <> 'base' AND position <= {TOP} GROUP BY candidate"


REPLICATES = 100


def res_perturbed(spark, sf_dir):
    """Ranks of every entity over replicates of changed weights."""
    long = settled(_factors(spark, sf_dir), "factors")
    return rounded(W.rank_stability(long, W.weight_rows(spark, {"even": BASE}), REPLICATES, 0.2, TOP, 42), 4)


RES_PERTURBED = f"""{RANKED_SQL}, long AS ({" UNION ALL ".join(f"SELECT entity_id, '{f}' AS factor, {f} AS x FROM f" for f in FACTORS)}), r AS (SELECT unnest(range({REPLICATES}))::INT AS replicate), b AS (SELECT DISTINCT factor FROM long),
u AS (SELECT replicate, factor, 0.2::DOUBLE * (1 + 0.2::DOUBLE * (2 * {uniform_sql("'42'", "replicate::VARCHAR", "'even'", "factor")} - 1)) AS w FROM r, b), w AS (SELECT replicate, factor, w / sum(w) OVER (PARTITION BY replicate) AS w FROM u),
s AS (SELECT entity_id, replicate, ROUND(sum(w * x), 8) AS score FROM long JOIN w USING (factor) GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY replicate ORDER BY score DESC) + (count(*) OVER (PARTITION BY replicate, score) - 1) / 2.0 AS rank, row_number() OVER (PARTITION BY replicate ORDER BY score DESC, entity_id) AS pos FROM s)
SELECT entity_id, round(avg(rank), 4) AS mean_rank, round(stddev_pop(rank), 4) AS std_rank, round(min(rank), 4) AS low_rank, round(max(rank), 4) AS high_rank, round(sum((pos <= {TOP})::INT) / {REPLICATES}.0, 4) AS kept, stddev_pop(rank) < 5 AS stable FROM k GROUP BY entity_id"""


DRAWS = 1000


def res_bootstrap_ic(spark, sf_dir):
    """Percentile interval of a rank correlation over bootstrap replicates."""
    rows = entity_panel(spark, sf_dir).select("entity_id", F.col("return_rate").alias("x"), F.col("momentum").alias("y")).where("x is not null and y is not null")
    rows = settled(rows, "pairs")
    ics = W.in_batches(rows, DRAWS, lambda first, last: rank_correlations(rows, (first, last), 42))
    return rounded(ics.agg(F.avg("rho").alias("mean"), F.stddev_samp("rho").alias("se"), F.expr("percentile(rho, 0.025)").alias("low"), F.expr("percentile(rho, 0.975)").alias("high")))


_U = uniform_sql("'42'", "replicate::VARCHAR", "entity_id::VARCHAR")
_limits, _p, _t = [], 2.718281828459045**-1, 0.0
for _k in range(8):
    _t += _p
    _limits.append(_t)
    _p /= _k + 1
RES_BOOTSTRAP = f"""WITH {PANEL_SQL}, d AS (SELECT entity_id, return_rate AS x, momentum AS y, replicate FROM panel, (SELECT unnest(range({DRAWS}))::INT AS replicate) WHERE return_rate IS NOT NULL AND momentum IS NOT NULL), m AS (SELECT *, CASE {" ".join(f"WHEN {_U} < {limit!r}::DOUBLE THEN {k}" for k, limit in enumerate(_limits))} ELSE 8 END AS m FROM d),
b AS (SELECT * FROM m WHERE m > 0), tx AS (SELECT replicate, x, sum(m) AS t, sum(sum(m)) OVER (PARTITION BY replicate ORDER BY x) AS c FROM b GROUP BY replicate, x), ty AS (SELECT replicate, y, sum(m) AS t, sum(sum(m)) OVER (PARTITION BY replicate ORDER BY y) AS c FROM b GROUP BY replicate, y),
r AS (SELECT b.replicate, b.m, (tx.c - tx.t + (tx.t + 1) / 2.0)::DOUBLE AS rx, (ty.c - ty.t + (ty.t + 1) / 2.0)::DOUBLE AS ry FROM b JOIN tx USING (replicate, x) JOIN ty USING (replicate, y)), s AS (SELECT replicate, sum(m)::DOUBLE AS n, sum(m * rx) AS sx, sum(m * ry) AS sy, sum(m * rx * rx) AS sxx, sum(m * ry * ry) AS syy, sum(m * rx * ry) AS sxy FROM r GROUP BY replicate),
i AS (SELECT (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS rho FROM s) SELECT round(avg(rho), 5) AS mean, round(stddev_samp(rho), 5) AS se, round(quantile_cont(rho, 0.025), 5) AS low, round(quantile_cont(rho, 0.975), 5) AS high FROM i"""


SUBSAMPLES = 500


def _even(spark, sf_dir):
    return settled(W.evaluated(_factors(spark, sf_dir), W.weight_rows(spark, {"even": BASE})).select("entity_id", "score"), "scores")


def res_subsample(spark, sf_dir):
    """How often an entity is among the 20 best of 80 pct subsamples, of all of them and of those that it is in."""
    out = W.subsample_tops(_even(spark, sf_dir), SUBSAMPLES, 0.8, TOP, 7)
    return rounded(out.select("entity_id", "n", (F.col("n") / SUBSAMPLES).alias("share"), (F.col("n") / F.col("drawn")).alias("share_where_drawn")))


RES_SUBSAMPLE = f"""{_candidates_sql({"even": BASE})}, r AS (SELECT entity_id, score, replicate FROM s, (SELECT unnest(range({SUBSAMPLES}))::INT AS replicate) WHERE {uniform_sql("'7'", "replicate::VARCHAR", "entity_id::VARCHAR")} < 0.8), t AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY score DESC, entity_id) AS pos FROM r)
SELECT entity_id, sum((pos <= {TOP})::INT)::BIGINT AS n, round(sum((pos <= {TOP})::INT) / {SUBSAMPLES}.0, 5) AS share, round(sum((pos <= {TOP})::INT) / count(*), 5) AS share_where_drawn FROM t GROUP BY entity_id"""
STABILITY_DRAWS = 500


def res_rank_stability(spark, sf_dir):
    """Overlap of the best and rank agreement of successive bootstrap draws."""
    return rounded(W.draw_stability(_even(spark, sf_dir), STABILITY_DRAWS, 11), 3)


RES_RANK_STABILITY = f"""{_candidates_sql({"even": BASE})}, d AS (SELECT entity_id, score, replicate FROM s, (SELECT unnest(range({STABILITY_DRAWS}))::INT AS replicate) WHERE {uniform_sql("'11'", "replicate::VARCHAR", "entity_id::VARCHAR")} < {1 - 2.718281828459045**-1!r}::DOUBLE),
k AS (SELECT *, rank() OVER (PARTITION BY replicate ORDER BY score DESC) + (count(*) OVER (PARTITION BY replicate, score) - 1) / 2.0 AS rank, row_number() OVER (PARTITION BY replicate ORDER BY score DESC, entity_id) AS pos FROM d),
o AS (SELECT replicate, n, count(*) FILTER (position <= n)::DOUBLE AS value FROM k JOIN top USING (entity_id), (SELECT unnest([10, 20]) AS n) WHERE pos <= n GROUP BY ALL),
j AS (SELECT a.replicate, b.rank AS x, a.rank AS y FROM k a JOIN k b ON a.entity_id = b.entity_id AND a.replicate = b.replicate + 1),
q AS (SELECT replicate, abs(y - x) <= 10 AS near, {sql_rank("x", "replicate", False)} AS rx, {sql_rank("y", "replicate", False)} AS ry FROM j), p AS (SELECT replicate, corr(rx, ry) AS rho, 100 * avg(near::INT) AS near FROM q GROUP BY replicate),
v AS (SELECT 'top' || n || '_overlap' AS metric, value FROM o UNION ALL SELECT 'successive_correlation', rho FROM p UNION ALL SELECT 'pct_within_10', near FROM p) SELECT metric, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS std FROM v GROUP BY metric"""
HALVED = W.double_halve(BASE)


def res_double_halve(spark, sf_dir):
    """Change of the ratio of the 20 best when one factor's weight is doubled and another's halved."""
    s = settled(W.evaluated(_factors(spark, sf_dir), W.weight_rows(spark, HALVED | {"base": BASE})), "scores")
    table = settled(W.ratio_of_top(s, _returns(spark, sf_dir), TOP, ["candidate"]), "ratios")
    base = table.where("candidate = 'base'").select(F.col("cs_ir").alias("_base"))
    return rounded(table.where("candidate <> 'base'").crossJoin(F.broadcast(base)).select("candidate", "cs_ir", (F.col("cs_ir") - F.col("_base")).alias("change")))


_RATIOS_SQL = f"ratios AS (SELECT candidate, avg(momentum) AS mean, stddev_samp(momentum) AS std, CASE WHEN stddev_samp(momentum) > 1e-12 THEN avg(momentum) / stddev_samp(momentum) ELSE 0 END AS cs_ir FROM top JOIN panel USING (entity_id) WHERE position <= {TOP} GROUP BY candidate)"
RES_DOUBLE_HALVE = f"{_candidates_sql(HALVED | {'base': BASE})}, {_RATIOS_SQL} SELECT candidate, round(cs_ir, 5) AS cs_ir, round(cs_ir - (SELECT cs_ir FROM ratios WHERE candidate = 'base'), 5) AS change FROM ratios WHERE candidate <> 'base'"
TILTS = 1000


def res_tilts(spark, sf_dir):
    """Of 1,000 random weight vectors those with the best ratio, the least deviation and the largest mean return of the 20 best."""
    long = settled(_factors(spark, sf_dir), "factors")
    s = W.candidate_tops(long, W.random_weights(spark, FACTORS, TILTS, 13), TOP)
    return rounded(W.best_candidates(settled(W.ratio_of_top(s, _returns(spark, sf_dir), TOP, ["candidate"]), "ratios")))


RES_TILTS = f"""{RANKED_SQL}, long AS ({" UNION ALL ".join(f"SELECT entity_id, '{f}' AS factor, {f} AS x FROM f" for f in FACTORS)}), u AS (SELECT i::VARCHAR AS candidate, factor, -ln(greatest({uniform_sql("'13'", "i::VARCHAR", "factor")}, 1e-12)) AS w FROM range({TILTS}) t(i), (SELECT DISTINCT factor FROM long)),
w AS (SELECT candidate, factor, w / sum(w) OVER (PARTITION BY candidate) AS w FROM u), s AS (SELECT entity_id, candidate, ROUND(sum(w * x), 8) AS score FROM long JOIN w USING (factor) GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, entity_id) AS position FROM s), {_RATIOS_SQL},
b AS ((SELECT 'best_ratio' AS goal, * FROM ratios ORDER BY cs_ir DESC, candidate LIMIT 1) UNION ALL (SELECT 'least_risk', * FROM ratios ORDER BY std, candidate LIMIT 1) UNION ALL (SELECT 'largest_return', * FROM ratios ORDER BY mean DESC, candidate LIMIT 1))
SELECT goal, candidate, round(mean, 5) AS mean, round(std, 5) AS std, round(cs_ir, 5) AS cs_ir FROM b"""


def res_weight_cv(spark, sf_dir):
    """The grid's best weights outside each of five folds, judged inside it."""
    weights = W.weight_rows(spark, GRID)
    s = settled(W.evaluated(_factors(spark, sf_dir), weights), "scores")
    folds = entity_panel(spark, sf_dir).select("entity_id", F.floor(5 * uniform(F.lit("cv"), F.col("entity_id").cast("string"))).cast("int").alias("fold"))
    return rounded(W.weights_cross_validated(s, _returns(spark, sf_dir), folds, weights, 10), 4)


RES_WEIGHT_CV = f"""{_candidates_sql(GRID)}, o AS (SELECT entity_id, floor(5 * {uniform_sql("'cv'", "entity_id::VARCHAR")})::INT AS fold FROM panel), g AS (SELECT s.*, h.fold AS held, o.fold = h.fold AS test FROM s JOIN o USING (entity_id), (SELECT DISTINCT fold FROM o) h),
t AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY held, test, candidate ORDER BY score DESC, entity_id) <= 10), r AS (SELECT held, test, candidate, CASE WHEN stddev_samp(momentum) > 1e-12 THEN avg(momentum) / stddev_samp(momentum) ELSE 0 END AS ir FROM t JOIN panel USING (entity_id) GROUP BY ALL),
b AS (SELECT held, candidate, ir FROM r WHERE NOT test QUALIFY row_number() OVER (PARTITION BY held ORDER BY ir DESC, candidate DESC) = 1), h AS (SELECT candidate, sum(w * w) AS hhi FROM w GROUP BY candidate)
SELECT b.held AS fold, b.candidate, round(b.ir, 4) AS train_ir, round(r.ir, 4) AS test_ir, round(hhi, 4) AS hhi, round(b.ir / nullif(r.ir, 0), 4) AS overfit FROM b LEFT JOIN r ON r.held = b.held AND r.candidate = b.candidate AND r.test JOIN h ON h.candidate = b.candidate"""


def _outside(p, group: str, groups: list):
    """(held_out, rho, n): the rank correlation of two indicators over all groups but one, for each."""
    rows = p.select(F.lit("xy").alias("pair"), F.col(group).alias("group"), F.col("return_rate").alias("x"), F.col("momentum").alias("y"))
    found = V.split_statistics(rows, ["xy"], groups, {str(g): [g] for g in groups})
    return found.where("side = 'train'").select(F.col("split").alias("held_out"), "rho", "n")


def res_folds(spark, sf_dir):
    """Size-stratified folds and the rank correlation outside each."""
    p = W.folds(entity_panel(spark, sf_dir).where("revenue is not null"), "revenue", 5, 5)
    return rounded(_outside(p, "fold", list(range(5))).withColumn("held_out", F.col("held_out").cast("int")))


RES_FOLDS = f"""WITH {PANEL_SQL}, b AS (SELECT *, {BIN_SQL.format(v="revenue")} AS bin FROM panel WHERE revenue IS NOT NULL), f AS (SELECT *, ((row_number() OVER (PARTITION BY bin ORDER BY {uniform_sql("'fold'", "entity_id::VARCHAR")}, entity_id) - 1) % 5)::INT AS fold FROM b),
h AS (SELECT g.fold AS held_out, return_rate AS x, momentum AS y FROM f JOIN (SELECT DISTINCT fold FROM f) g ON f.fold <> g.fold WHERE return_rate IS NOT NULL AND momentum IS NOT NULL), r AS (SELECT held_out, {sql_rank("x", "held_out", False)} AS rx, {sql_rank("y", "held_out", False)} AS ry FROM h)
SELECT held_out, round(corr(rx, ry), 5) AS rho, count(*) AS n FROM r GROUP BY held_out"""


def res_leave_sector_out(spark, sf_dir):
    p = settled(entity_panel(spark, sf_dir), "panel")
    sectors = [r["sector"] for r in p.select("sector").distinct().orderBy("sector").collect()]  # a few sectors
    return rounded(_outside(p, "sector", sectors))


RES_LOSO = f"""WITH {PANEL_SQL}, h AS (SELECT g.sector AS held_out, return_rate AS x, momentum AS y FROM panel p JOIN (SELECT DISTINCT sector FROM panel) g ON p.sector <> g.sector WHERE return_rate IS NOT NULL AND momentum IS NOT NULL), r AS (SELECT held_out, {sql_rank("x", "held_out", False)} AS rx, {sql_rank("y", "held_out", False)} AS ry FROM h)
SELECT held_out, round(corr(rx, ry), 5) AS rho, count(*) AS n FROM r GROUP BY held_out"""


def res_restandardised(spark, sf_dir):
    return rounded(W.restandardised(entity_panel(spark, sf_dir).where("revenue is not null"), "mean_discount", "sector").select("entity_id", "z"))


RES_RESTANDARDISED = f"WITH {PANEL_SQL}, g AS (SELECT a.sector, avg(b.mean_discount) AS m, stddev_samp(b.mean_discount) AS s FROM (SELECT DISTINCT sector FROM panel) a JOIN panel b ON a.sector <> b.sector WHERE b.revenue IS NOT NULL GROUP BY a.sector) SELECT entity_id, round((mean_discount - m) / s, 5) AS z FROM panel JOIN g USING (sector) WHERE revenue IS NOT NULL"


def res_turnover(spark, sf_dir):
    base = W.evaluated(_factors(spark, sf_dir), W.weight_rows(spark, {"even": BASE})).select("entity_id", "score")
    return rounded(W.turnover(base, 20, 0.2, TOP, 5, 0.001))


RES_TURNOVER = f"""{_candidates_sql({"even": BASE})}, m AS (SELECT entity_id, replicate, ROUND(score * (1 + 0.2::DOUBLE * (2 * {uniform_sql("'5'", "replicate::VARCHAR", "entity_id::VARCHAR")} - 1)), 8) AS z FROM s, (SELECT unnest(range(20))::INT AS replicate)), t AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY z DESC, entity_id) AS pos FROM m),
o AS (SELECT replicate, count(b.entity_id) / {TOP}.0 AS o FROM t LEFT JOIN (SELECT entity_id FROM top WHERE position <= {TOP}) b USING (entity_id) WHERE pos <= {TOP} GROUP BY replicate) SELECT replicate, round(1 - o, 5) AS turnover, round((1 - o) * 2 * 0.001, 5) AS cost FROM o"""


def res_capacity(spark, sf_dir):
    p = entity_panel(spark, sf_dir).where("revenue is not null").withColumn("w", F.lit(0.01))
    return rounded(W.capacity(p, [1e5, 1e6, 1e7], "w", "mean_order"))


RES_CAPACITY = f"WITH {PANEL_SQL} SELECT tier, round(avg(tier * 0.01::DOUBLE / mean_order), 5) AS mean_participation, round(avg((tier * 0.01::DOUBLE / mean_order <= 0.1)::INT), 5) AS pass_rate FROM panel, (SELECT unnest([1e5, 1e6, 1e7])::DOUBLE AS tier) WHERE revenue IS NOT NULL GROUP BY tier"


def res_costs(spark, sf_dir):
    """Square-root impact, half spread and commission of equal trades, in basis points, with the total."""
    p = entity_panel(spark, sf_dir).where("revenue is not null")
    impact = W.market_impact(F.lit(1e4), F.col("revenue"), F.lit(0.02))
    rows = p.select("sector", impact.alias("impact")).withColumn("cost", F.col("impact") + 5 + 2)
    return rounded(rows.rollup("sector").agg(F.avg("impact").alias("impact"), F.avg("cost").alias("cost")).withColumn("sector", F.coalesce("sector", F.lit("All"))))


RES_COSTS = f"WITH {PANEL_SQL}, c AS (SELECT sector, CASE WHEN revenue > 0 THEN 1e4::DOUBLE * 0.02::DOUBLE * sqrt(1e4::DOUBLE / revenue) ELSE 0 END AS i FROM panel WHERE revenue IS NOT NULL) SELECT coalesce(sector, 'All') AS sector, round(avg(i), 5) AS impact, round(avg(i + 7), 5) AS cost FROM c GROUP BY ROLLUP (sector)"

QUERIES = {
    "ts_measures": (ts_measures, TS_MEASURES), "ts_illiquidity": (ts_illiquidity, TS_ILLIQUIDITY), "ts_forward": (ts_forward, TS_FORWARD),
    "src_facts": (src_facts, SRC_FACTS), "src_country_latest": (src_country_latest, SRC_COUNTRY), "src_facilities": (src_facilities, SRC_FACILITIES), "src_membership": (src_membership, SRC_MEMBERSHIP), "src_merge": (src_merge, SRC_MERGE), "src_fuzzy": (src_fuzzy, SRC_FUZZY), "src_fuzzy_all": (src_fuzzy_all, SRC_FUZZY_ALL), "src_keys": (src_keys, SRC_KEYS),
    "sim_target": (sim_target, SIM_TARGET), "sim_nearest": (sim_nearest, SIM_NEAREST), "sim_peer_excess": (sim_peer_excess, SIM_PEER_EXCESS),
    "res_grid": (res_grid, RES_GRID), "res_one_at_a_time": (_overlap(CHANGED), _overlap_sql(CHANGED)), "res_ablation": (_overlap(W.ablations(BASE)), _overlap_sql(W.ablations(BASE))), "res_perturbed": (res_perturbed, RES_PERTURBED), "res_bootstrap_ic": (res_bootstrap_ic, RES_BOOTSTRAP),
    "res_subsample": (res_subsample, RES_SUBSAMPLE), "res_rank_stability": (res_rank_stability, RES_RANK_STABILITY), "res_double_halve": (res_double_halve, RES_DOUBLE_HALVE), "res_tilts": (res_tilts, RES_TILTS), "res_weight_cv": (res_weight_cv, RES_WEIGHT_CV), "res_folds": (res_folds, RES_FOLDS), "res_leave_sector_out": (res_leave_sector_out, RES_LOSO), "res_restandardised": (res_restandardised, RES_RESTANDARDISED), "res_turnover": (res_turnover, RES_TURNOVER), "res_capacity": (res_capacity, RES_CAPACITY), "res_costs": (res_costs, RES_COSTS),
}
