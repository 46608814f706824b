"""Principal components, clusters and their quality measures."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.tables import settled
from panelforge.operators.inference import moments


def correlation(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlation matrix over complete rows, from one aggregate of k squared moments."""
    _, cov, _ = moments(df, columns)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    return cov / np.outer(sd, sd)


def principal_components(df: DataFrame, columns: list[str]) -> DataFrame:
    """(component, eigenvalue, share, cumulative, kept, one loading for each column); kept: eigenvalue over 1. Loadings' signs make their sum positive."""
    values, vectors = np.linalg.eigh(correlation(df, columns))
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors = vectors * np.where(vectors.sum(0) < 0, -1, 1)
    share = values / values.sum()
    rows = [(i + 1, float(v), float(s), float(c), bool(v > 1), *map(float, vectors[:, i])) for i, (v, s, c) in enumerate(zip(values, share, np.cumsum(share), strict=True))]
    return df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, share double, cumulative double, kept boolean, " + ", ".join(f"`{c}` double" for c in columns))


def projected(df: DataFrame, key: str, columns: list[str], k: int) -> DataFrame:
    """(key, pc1..pck) of complete rows, as expressions on standardised columns."""
    loadings = principal_components(df, columns).orderBy("component").limit(k).collect()  # k rows
    whole = df.dropna(subset=columns)
    s = whole.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    z = whole.crossJoin(F.broadcast(s))
    return z.select(key, *[sum(((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") * F.lit(row[c]) for c in columns), F.lit(0.0)).alias(f"pc{i + 1}") for i, row in enumerate(loadings)])


def loading_weights(df: DataFrame, columns: list[str], explained: float = 0.8) -> dict[str, float]:
    """Weights from squared loadings of the first components that explain a share, each weighted by its own share."""
    rows = principal_components(df, columns).orderBy("component").collect()
    used = [r for i, r in enumerate(rows) if i == 0 or rows[i - 1]["cumulative"] < explained]
    raw = {c: sum(r["share"] * r[c] ** 2 for r in used) for c in columns}
    return {c: w / sum(raw.values()) for c, w in raw.items()}


def _features(df: DataFrame, columns: list[str]) -> DataFrame:
    whole = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df.dropna(subset=columns))
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(whole).transform(whole).drop("_raw")


def elbow(df: DataFrame, columns: list[str], ks: list[int], seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette) of k-means; silhouette by squared Euclidean distance."""
    x = settled(_features(df, columns).select("features"), "features")  # read again by every pass of every k
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=20).fit(x)
        rows.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(x)))))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def tree(df: DataFrame, key: str, columns: list[str], most: int, seed: int = 42) -> list[DataFrame]:
    """(key, cluster) of complete rows for each cut of one cluster tree, from 1 to ``most`` clusters: every step parts the cluster with the largest sum of
    squares by two means, and the new one takes the next number. A cluster whose rows are all alike is not parted, so later cuts can be as the last."""
    x = settled(_features(df, columns).select(key, "features"), "features")
    cut = settled(x.select(key, "features", F.lit(0).alias("cluster")), "cut")
    cuts = [cut]
    for number in range(1, most):
        square = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, v: s + v * v)
        parts = [F.sum(F.get(vector_to_array("features"), F.lit(k))) for k in range(len(columns))]
        spread = cut.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("q"), F.array(*parts).alias("s")).collect()  # a row per cluster
        within = {r["cluster"]: r["q"] - sum(v * v for v in r["s"]) / r["n"] for r in spread if r["n"] > 1}
        widest = max(within, key=lambda c: (within[c], -c), default=None)
        if widest is not None and within[widest] > 1e-9:
            own = cut.where(F.col("cluster") == widest)
            halves = KMeans(k=2, seed=seed, maxIter=20).fit(own).transform(own)
            moved = F.when(F.col("prediction") == 1, number).otherwise(widest).cast("int")
            cut = settled(cut.where(F.col("cluster") != widest).unionByName(halves.select(key, "features", moved.alias("cluster"))), "cut")
        cuts.append(cut)
    return [c.select(key, "cluster") for c in cuts]


def clusters(df: DataFrame, key: str, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """(key, cluster): the cluster tree cut at k clusters."""
    return tree(df, key, columns, k, seed)[-1]


def cuts(df: DataFrame, key: str, columns: list[str], ks: list[int], seed: int = 42) -> DataFrame:
    """(k, key, cluster): one cluster tree cut at each number of clusters."""
    each = tree(df, key, columns, max(ks), seed)
    return reduce(lambda a, b: a.unionByName(b), [each[k - 1].select(F.lit(k).alias("k"), key, "cluster") for k in ks])


def cut_measures(df: DataFrame, assigned: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(k, clusters, n, silhouette, calinski_harabasz) of cuts (k, key, cluster) over standardised columns, complete rows only.

    The silhouette is that of squared distances, so it follows from the sums and squares of each cluster: a row's mean squared distance to a cluster of n
    rows is |x|^2 - 2 x.mean + mean square; a cluster of one row counts 0."""
    s = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])  # one row
    z = df.dropna(subset=columns).crossJoin(F.broadcast(s)).select(key, *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) for c in columns])
    rows = settled(z.join(assigned, key), "placed")
    square = lambda prefix: sum((F.col(f"{prefix}{c}") * F.col(f"{prefix}{c}") for c in columns), F.lit(0.0))
    of = settled(rows.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("_n"), F.avg(square("")).alias("_q"), *[F.avg(c).alias(f"_a_{c}") for c in columns]), "clusters")
    lists = of.groupBy("k").agg(F.collect_list(F.struct("cluster", "_n", "_q", F.array(*[f"_a_{c}" for c in columns]).alias("a"))).alias("all"))  # a few clusters
    x = F.array(*columns)
    dot = lambda a: F.aggregate(F.zip_with(x, a, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)
    far = lambda c: square("") - 2 * dot(c["a"]) + c["_q"]
    joined = rows.join(F.broadcast(lists), "k")
    mine = F.filter("all", lambda c: c["cluster"] == F.col("cluster"))[0]
    inside = F.when(mine["_n"] > 1, far(mine) * mine["_n"] / (mine["_n"] - 1))
    outside = F.array_min(F.transform(F.filter("all", lambda c: c["cluster"] != F.col("cluster")), far))
    measured = joined.select("k", inside.alias("_i"), outside.alias("_o"))
    width = F.when(F.col("_i").isNull(), 0.0).when(F.greatest("_i", "_o") > 0, (F.col("_o") - F.col("_i")) / F.greatest("_i", "_o")).otherwise(0.0)
    silhouettes = measured.groupBy("k").agg(F.avg(width).alias("silhouette"))
    middle = of.groupBy("k").agg(*[(F.sum(F.col("_n") * F.col(f"_a_{c}")) / F.sum("_n")).alias(f"_g_{c}") for c in columns])
    away = sum(((F.col(f"_a_{c}") - F.col(f"_g_{c}")) * (F.col(f"_a_{c}") - F.col(f"_g_{c}")) for c in columns), F.lit(0.0))
    between, within = F.sum(F.col("_n") * away), F.sum(F.col("_n") * (F.col("_q") - square("_a_")))
    k, n = F.count(F.lit(1)), F.sum("_n")
    ratios = of.join(middle, "k").groupBy("k").agg(k.alias("clusters"), n.alias("n"), F.when((k > 1) & (n > k) & (within > 0), (between / (k - 1)) / (within / (n - k))).alias("calinski_harabasz"))
    return ratios.join(silhouettes, "k").select("k", "clusters", "n", "silhouette", "calinski_harabasz")


def best_by_cluster(best: DataFrame, assigned: DataFrame, key: str, profile: str = "profile") -> DataFrame:
    """(profile, cluster, n, share, expected, lift) of the best rows (profile, key) in the clusters (key, cluster): their share in each cluster against that of
    all rows; clusters without any of them are 0."""
    size = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("_size"))
    whole = size.agg(F.sum("_size").alias("_all"))  # one row
    placed = best.join(assigned, key)
    total = placed.groupBy(profile).agg(F.count(F.lit(1)).alias("_best"))
    found = placed.groupBy(profile, "cluster").agg(F.count(F.lit(1)).alias("n"))
    every = total.crossJoin(F.broadcast(size.crossJoin(F.broadcast(whole))))  # profiles x clusters, a few each
    out = every.join(found, [profile, "cluster"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share, expected = F.col("n") / F.col("_best"), F.col("_size") / F.col("_all")
    return out.select(profile, "cluster", F.col("n").cast("bigint").alias("n"), share.alias("share"), expected.alias("expected"), (share / expected).alias("lift"))


def cluster_profiles(df: DataFrame, assigned: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(cluster, n, mean of each column)."""
    return df.join(assigned, key).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def variance_ratio(df: DataFrame, assigned: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(calinski_harabasz) of standardised columns over clusters."""
    s = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    z = df.dropna(subset=columns).crossJoin(F.broadcast(s)).select(key, *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) for c in columns]).join(assigned, key)
    g = z.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_a_{c}") for c in columns], *[F.var_pop(c).alias(f"_v_{c}") for c in columns])
    between = sum((F.sum(F.col("n") * F.col(f"_a_{c}") * F.col(f"_a_{c}")) for c in columns), F.lit(0.0))
    within = sum((F.sum(F.col("n") * F.col(f"_v_{c}")) for c in columns), F.lit(0.0))
    k, n = F.count(F.lit(1)), F.sum("n")
    return g.agg(((between / (k - 1)) / (within / (n - k))).alias("calinski_harabasz"))
