"""Consensus factors over restarts: density filter, clustering of spectra, median spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators import factor as fa
from panelweave.operators.clustering import kmeans_clusters
from panelweave.operators.neighbors import knn
from panelweave.operators.predict import _blocks
from panelweave.session import pin

# Defaults of the consensus.
NEIGHBORHOOD = 0.30
DENSITY_THRESHOLD = 0.5


def unit_spectra(loadings: DataFrame) -> DataFrame:
    """(spectrum, run, factor, vec): each restart's factors scaled to unit length, genes in name order."""
    name = F.concat_ws("/", "run", F.col("factor").cast("string"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("gene", "loading"))), lambda s: s["loading"])
    s = loadings.groupBy(name.alias("spectrum"), "run", "factor").agg(v.alias("raw"), F.sqrt(F.sum(F.col("loading") * F.col("loading"))).alias("_n"))
    return s.select("spectrum", "run", "factor", F.transform("raw", lambda x: x / F.when(F.col("_n") == 0, 1.0).otherwise(F.col("_n"))).alias("vec"))


def local_density(spectra: DataFrame, n_runs: int, share: float = NEIGHBORHOOD) -> DataFrame:
    """Mean distance to the nearest share of runs, itself included, and its min-max scaled value."""
    n = max(1, int(share * n_runs))
    e = knn(spectra.select(F.col("spectrum").alias("cell_id"), "vec"), spectra.select(F.col("spectrum").alias("cell_id"), "vec"), n)
    d = pin(e.groupBy("cell_id").agg(F.avg("dist").alias("density")).withColumnRenamed("cell_id", "spectrum"))
    lo, hi = d.agg(F.min("density")).scalar(), d.agg(F.max("density")).scalar()
    return d.withColumns({"_lo": lo, "_hi": hi}).select("spectrum", "density", ((F.col("density") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-10)).alias("scaled"))


def keep_dense(density: DataFrame, k: int, threshold: float = DENSITY_THRESHOLD) -> DataFrame:
    """Spectra below the threshold; all of them when fewer than k would remain."""
    n = density.agg(F.count_if(F.col("scaled") < threshold)).scalar()
    return density.withColumn("_n", n).filter((F.col("scaled") < threshold) | (F.col("_n") < k)).drop("_n")


def median_spectra(loadings: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, gene, loading): per-gene median over a cluster's spectra, scaled to sum 1.

    A (cluster, gene) group has at most one value per spectrum.
    """
    l = loadings.withColumn("spectrum", F.concat_ws("/", "run", F.col("factor").cast("string")))
    m = l.join(clusters.select("spectrum", "cluster"), "spectrum").groupBy("cluster", "gene").agg(F.percentile("loading", F.lit(0.5)).alias("m"))
    t = m.groupBy("cluster").agg(F.sum("m").alias("_t"))
    return m.join(t, "cluster").select("cluster", "gene", (F.col("m") / (F.col("_t") + 1e-10)).alias("loading"))


def silhouette(spectra: DataFrame, clusters: DataFrame, block: int = 2048) -> float:
    """Mean Euclidean silhouette of the spectra: sums of distances to every cluster, by pairs of blocks of spectra."""
    rows = pin(spectra.join(clusters, "spectrum").select(F.col("spectrum").alias("id"), F.col("cluster").cast("string").alias("cluster"), "vec"))
    sizes = {r.cluster: r.n for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    names, total = sorted(sizes), sum(sizes.values())
    if len(names) < 2 or total <= len(names):
        return float("nan")
    n = -(-total // block)
    place, size = {c: i for i, c in enumerate(names)}, np.array([sizes[c] for c in names], float)

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"id": a["id"].iloc[:0], "cluster": a["cluster"].iloc[:0], "v": pd.Series([], dtype=object)})
        x, y = np.stack(a["vec"].to_numpy()), np.stack(b["to"].to_numpy())
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0.0))
        d[a["id"].to_numpy()[:, None] == b["other"].to_numpy()[None, :]] = 0.0
        return pd.DataFrame({"id": a["id"], "cluster": a["cluster"], "v": list(d @ np.eye(len(names))[b["of"].map(place)])})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d, c = np.stack(b["v"].to_numpy()), b["cluster"].map(place).to_numpy()
            own, i = size[c], np.arange(len(c))
            near = d[i, c] / np.maximum(own - 1, 1)
            d = d / size
            d[i, c] = np.inf
            far = d.min(1)
            yield pd.DataFrame({"s": np.where(own > 1, (far - near) / np.maximum(np.maximum(near, far), 1e-300), 0.0)})

    left = _blocks(rows, "ab", "bb", n, n).select("id", "cluster", "vec", F.col("ab").alias("x"), F.col("bb").alias("y"))
    right = _blocks(rows, "bb", "ab", n, n).select(F.col("id").alias("other"), F.col("cluster").alias("of"), F.col("vec").alias("to"), F.col("ab").alias("x"), F.col("bb").alias("y"))
    pairs = left.groupBy("x", "y").cogroup(right.groupBy("x", "y"))
    each = fa._add_up(pairs.applyInPandas(sums, "id string, cluster string, v array<double>"), ["id", "cluster"])
    return float(each.mapInPandas(score, "s double").agg(F.avg("s")).first()[0])


def consensus_nmf(p: fa.Packed, k_values: list[int], runs: int = 100, iters: int = 30, loss: str = "kullback-leibler", seed: int = 42,
                  threshold: float = DENSITY_THRESHOLD, inner: int = 10) -> tuple[DataFrame, DataFrame]:
    """Consensus spectra (k, scope, cluster, gene, loading) and a row of metrics per (k, scope).

    All restarts of a k advance in the same passes over the data.
    """
    spark = p.cells.sparkSession
    spectra_out, metrics = None, []
    for k in k_values:
        fit = fa.nmf(p, k, iters, loss, seed, runs, inner)
        if not fit.h:
            continue
        every = pin(fit.loadings(spark))
        for scope in sorted({sc for _r, sc in fit.h}):
            l = every.filter(F.col("scope") == scope)
            s = pin(unit_spectra(l))
            kept = pin(keep_dense(local_density(s, runs), k, threshold))
            inside = s.join(kept.select("spectrum"), "spectrum")
            cl, _cost = kmeans_clusters(inside.select(F.col("spectrum").alias("cell_id"), "vec"), k, seed)
            cl = pin(cl.withColumnRenamed("cell_id", "spectrum"))
            err = [np.sqrt(fit.errors[key]["sse"]) for key in fit.errors if key[1] == scope]
            metrics.append((k, scope, float(np.mean(err)), float(np.std(err)), len(err), silhouette(inside, cl), kept.count()))
            m = median_spectra(l, cl).select(F.lit(k).alias("k"), F.lit(scope).alias("scope"), F.col("cluster").cast("int").alias("factor"), "gene", "loading")
            spectra_out = m if spectra_out is None else spectra_out.unionByName(m)
    rows = spark.createDataFrame(metrics, "k int, scope string, mean_error double, std_error double, n_runs int, silhouette double, n_kept bigint")
    return spectra_out, rows


def consensus_usage(p: fa.Packed, spectra: DataFrame, k: int, iters: int = 100, loss: str = "kullback-leibler") -> DataFrame:
    """Usage of the consensus spectra, solved with them fixed.

    Averaging the restarts' usages would mix factors that carry the same number
    but mean different things.
    """
    rows = spectra.filter(F.col("k") == k).toPandas()
    at = {g: i for i, g in enumerate(p.genes)}
    hs = {}
    for scope, d in rows.groupby("scope"):
        h = np.zeros((len(p.genes), k))
        h[d["gene"].map(at).to_numpy(), d["factor"].to_numpy()] = d["loading"].to_numpy()
        hs[("consensus", scope)] = h
    return fa.nmf_transform(p, hs, iters, loss)


def k_selection_metrics(runs: DataFrame) -> DataFrame:
    """Mean and population std of the restart errors and mean silhouette per k."""
    return runs.groupBy("k").agg(F.avg("error").alias("mean_error"), F.stddev_pop("error").alias("std_error"), F.count("error").alias("n_runs"), F.avg("silhouette").alias("silhouette"))
