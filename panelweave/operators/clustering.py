"""Clusterings with a wanted number of groups, and choices of that number."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.ranks import row_index
from panelweave.operators.factor import _add_up, _few_tasks
from panelweave.session import pin

#: Cells of a one-hot matrix held at a time.
ONE_HOT_CELLS = 4_000_000


def cluster_to_n(edges: DataFrame, n: int, max_iter: int = 20) -> DataFrame:
    """Exactly ``n`` clusters of a neighbour graph (power iteration on similarities)."""
    edges = pin(edges.select("cell_id", "neighbor", "dist"))
    # The solver wants integer ids; ids of any type are numbered and mapped back.
    nodes = pin(edges.select(F.explode(F.array("cell_id", "neighbor")).alias("_id")).distinct())
    nodes = pin(row_index(nodes, [], F.col("_id"), "_no"))
    ends = edges.join(nodes.select(F.col("_id").alias("cell_id"), F.col("_no").alias("_a")), "cell_id").join(
        nodes.select(F.col("_id").alias("neighbor"), F.col("_no").alias("_b")), "neighbor")
    sim = ends.select(
        F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), (1.0 / (1.0 + F.col("dist"))).alias("weight")
    ).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    pic = PowerIterationClustering(k=n, maxIter=max_iter, initMode="degree", weightCol="weight")
    return pic.assignClusters(sim).join(nodes, F.col("id") == F.col("_no")).select(
        F.col("_id").alias("cell_id"), F.col("cluster").cast("string").alias("cluster"), F.lit(n).alias("n_clusters"))


def kmeans_clusters(vecs: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, float]:
    """Cluster label per cell and the training cost."""
    data = vecs.select("cell_id", array_to_vector("vec").alias("features")).persist()
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    out = model.transform(data).select("cell_id", F.col("cluster").cast("string").alias("cluster"))
    cost = float(model.summary.trainingCost)
    data.unpersist()
    return out, cost


def chord_knee(curve: DataFrame, x: str = "k", y: str = "score", by: Sequence[str] = (), decreasing: bool = True) -> DataFrame:
    """The point farthest from the line between the curve's ends, after min-max scaling.

    ``curve`` has one row per candidate x.
    """
    first, last = F.min_by(y, x).alias("_y0"), F.max_by(y, x).alias("_y1")
    s = curve.groupBy(*by).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), first, last, F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    if by:
        j = curve.join(s, list(by))
    else:
        j = curve.withColumns({c: s.select(c).scalar() for c in s.columns})

    def unit(v, lo, hi):
        return F.when(hi == lo, 0.0).otherwise((v - lo) / (hi - lo))

    ux = unit(F.col(x), F.col("_x0"), F.col("_x1"))
    uy, u0, u1 = (unit(F.col(c), F.col("_lo"), F.col("_hi")) for c in (y, "_y0", "_y1"))
    j = j.withColumn("_d", F.abs(uy - (u0 + (u1 - u0) * ux)) / F.sqrt(1 + (u1 - u0) * (u1 - u0)))
    return j.groupBy(*by).agg(F.min_by(x, F.struct(-F.round("_d", 12), x)).alias(f"best_{x}"), F.max("_d").alias("distance"))


def select_k(metrics: DataFrame, method: str = "elbow") -> DataFrame:
    """Best k from (k, mean_error, silhouette)."""
    if method == "elbow":
        return chord_knee(metrics, "k", "mean_error").select("best_k")
    if method == "silhouette":
        return metrics.agg(F.min_by("k", F.struct(-F.col("silhouette"), "k")).alias("best_k"))
    raise ValueError(f"unknown method {method}")


def kmeans_elbow(vecs: DataFrame, k_min: int = 1, k_max: int = 10, default: int = 3, min_size: int = 5, seed: int = 42) -> tuple[int, DataFrame]:
    """K at the knee of the inertia curve, lowered until every cluster has ``min_size`` cells."""
    spark = vecs.sparkSession
    data = pin(vecs)
    runs = {k: kmeans_clusters(data, k, seed) for k in range(max(2, k_min), k_max + 1)}
    curve = [(k, c) for k, (_, c) in runs.items()]
    if k_min <= 1:
        d = data.select(F.posexplode("vec").alias("i", "v")).groupBy("i").agg((F.var_pop("v") * F.count("v")).alias("ss"))
        curve.append((1, float(d.agg(F.sum("ss")).first()[0] or 0.0)))
    k = default
    if len(curve) > 2:
        k = chord_knee(spark.createDataFrame(curve, "k int, score double")).first()["best_k"]
    while k > 1:
        labels = runs[k][0] if k in runs else kmeans_clusters(data, k, seed)[0]
        if labels.groupBy("cluster").count().agg(F.min("count")).first()[0] >= min_size:
            return k, labels
        k -= 1
    return 1, data.select("cell_id", F.lit("0").alias("cluster"))


def component_clusters(usage: DataFrame) -> DataFrame:
    """(run, cell_id, cluster): the factor of largest usage; ``usage(run, cell_id, factor, weight)``."""
    return usage.groupBy("run", "cell_id").agg(F.min_by("factor", F.struct(-F.col("weight"), "factor")).alias("cluster"))


def coclustering_stability(labels: DataFrame) -> DataFrame:
    """Dispersion of the co-membership frequencies over runs, from tables of runs and clusters only.

    C(i, j) is the share of runs that put cells i and j together.  The sums of C
    and C squared over all pairs follow from the pairwise contingency tables of
    the runs, so no cell-by-cell matrix is ever formed.
    ``labels(k, run, cell_id, cluster)``; the result is sum 4 (C - 1/2)^2 / n^2.
    """
    labels = pin(labels.select("k", "run", "cell_id", "cluster"))
    n = labels.groupBy("k").agg(F.count_distinct("cell_id").alias("n"), F.count_distinct("run").alias("r"))
    # Numbers for the clusters of all runs of a k: a table of runs x clusters rows.
    order = Window.partitionBy("k").orderBy("run", "cluster")
    index = pin(labels.select("k", "run", "cluster").distinct().withColumn("_i", F.row_number().over(order) - 1))
    size = {r.k: r.n for r in index.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    per = labels.join(index, ["k", "run", "cluster"]).groupBy("k", "cell_id").agg(F.collect_list("_i").alias("at")).select("k", "at")

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for k, g in b.groupby("k", sort=False):
                m = size[k]
                total = sums.setdefault(k, np.zeros((m, m)))
                step = max(1, ONE_HOT_CELLS // m)
                for lo in range(0, len(g), step):
                    at = g["at"].iloc[lo : lo + step]
                    hot = np.zeros((len(at), m))
                    hot[np.repeat(np.arange(len(at)), at.map(len)), np.concatenate(at.to_numpy())] = 1
                    total += hot.T @ hot
        for k, total in sums.items():
            yield pd.DataFrame({"k": k, "i": np.arange(len(total), dtype="int32"), "v": list(total)})

    # Cells that two clusters share, for every pair of clusters of a k.
    kind = labels.schema["k"].dataType.simpleString()
    shared = _add_up(_few_tasks(per).mapInPandas(gram, f"k {kind}, i int, v array<double>"), ["k", "i"])
    own = F.get("v", F.col("i"))
    sums = shared.groupBy("k").agg(F.sum(own * own).alias("s1"), F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("s2"))
    j = n.join(sums, "k")
    nn, r = F.col("n") * F.col("n"), F.col("r")
    total = 4 * F.col("s2") / (r * r) - 4 * F.col("s1") / r + nn
    return j.select("k", F.col("n").alias("n_cells"), (total / nn).alias("dispersion"))


def most_stable_k(stability: DataFrame) -> DataFrame:
    return stability.agg(F.min_by("k", F.struct(-F.col("dispersion"), "k")).alias("best_k"))


def top_genes_per_component(loadings: DataFrame, n: int = 20) -> DataFrame:
    """The n largest loadings of every factor with their rank."""
    w = Window.partitionBy("scope", "factor").orderBy(F.desc("loading"), "gene")
    return loadings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
