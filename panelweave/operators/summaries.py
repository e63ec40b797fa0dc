"""Summary tables over panels, folds and repeated runs -- the data behind reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.ranks import exact_quantiles


def gene_frequency(counts: DataFrame, n: int = 30) -> DataFrame:
    """Genes selected more than once, most frequent first; ``counts(gene, n_selected)``."""
    return counts.filter(F.col("n_selected") > 1).orderBy(F.desc("n_selected"), "gene").limit(n)


def stability_distribution(counts: DataFrame, n_runs: int, pools: Sequence[str] = ("n_rf_pool", "n_nmf_pool")) -> DataFrame:
    """Genes per selection frequency 1..n_runs for each pool, and their share of all selected genes."""
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pool"), F.col(p).cast("int").alias("frequency")) for p in pools])).alias("x")).select("x.*")
    long = long.filter(F.col("frequency") > 0)
    c = long.groupBy("pool", "frequency").agg(F.count(F.lit(1)).alias("n_genes"))
    tot = long.groupBy("pool").agg(F.count(F.lit(1)).alias("_t"))
    grid = tot.withColumn("frequency", F.explode(F.sequence(F.lit(1), F.lit(n_runs))))
    j = grid.join(c, ["pool", "frequency"], "left").na.fill(0, ["n_genes"])
    return j.select("pool", "frequency", "n_genes", (F.col("n_genes") / F.col("_t") * 100).alias("percent"))


def selection_overlap(panels: DataFrame, by: Sequence[str] = ("k_value", "method"), run: str = "iteration") -> DataFrame:
    """Jaccard and intersection percent of every two runs of the same group.

    ``panels(*by, iteration, gene)``.  Pairs of runs come from the gene's list
    of runs, so the work is genes x runs^2, never genes squared.
    """
    by = list(by)
    p = panels.select(*by, F.col(run).alias("r"), "gene").distinct()
    sizes = p.groupBy(*by, "r").agg(F.count(F.lit(1)).alias("n"))
    # A gene's runs: as long as there are repeats of one setting.
    g = p.groupBy(*by, "gene").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    two = g.select(*by, "rs", F.explode("rs").alias("i")).select(*by, "i", F.explode("rs").alias("j")).filter(F.col("i") < F.col("j"))
    inter = two.groupBy(*by, "i", "j").agg(F.count(F.lit(1)).alias("inter"))
    runs = sizes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("r", "n"))).alias("rs"))
    grid = runs.select(*by, "rs", F.explode("rs").alias("a")).select(*by, "a", F.explode("rs").alias("b")).filter(F.col("a.r") < F.col("b.r"))
    grid = grid.select(*by, F.col("a.r").alias("i"), F.col("b.r").alias("j"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))
    j = grid.join(inter, [*by, "i", "j"], "left").na.fill(0, ["inter"])
    return j.select(*by, "i", "j", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("pairwise_jaccard"),
                    (F.col("inter") / F.least("na", "nb") * 100).alias("intersection_pct"))


def k_varying_aggregate(df: DataFrame, metrics: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Mean and sample std by k and method pair, optionally some (selection, evaluation) pairs only."""
    if pairs is not None:
        keep = F.lit(False)
        for s, e in pairs:
            keep = keep | ((F.col("selection_method") == s) & (F.col("eval_method") == e))
        df = df.filter(keep)
    return df.groupBy("k_value", "selection_method", "eval_method").agg(
        F.count(F.lit(1)).alias("n_runs"), *[a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))])


def valid_celltypes(df: DataFrame, min_cells: float = 20) -> DataFrame:
    """Cell types not skipped with a mean of at least ``min_cells`` cells, largest first."""
    ok = df.filter(~F.coalesce(F.col("skipped"), F.lit(False)) & (F.col("n_cells") >= min_cells))
    return ok.groupBy("celltype").agg(F.avg("n_cells").alias("mean_cells")).orderBy(F.desc("mean_cells"), "celltype")


def drop_outliers(df: DataFrame, metrics: Sequence[str], width: float = 10.0) -> DataFrame:
    """Remove rows beyond ``width`` interquartile ranges, metric after metric on what remains."""
    for m in metrics:
        b = exact_quantiles(df, [], m, {"q1": 0.25, "q3": 0.75})
        span = width * (F.col("_b.q3") - F.col("_b.q1"))
        inside = F.col(m).between(F.col("_b.q1") - span, F.col("_b.q3") + span)
        df = df.withColumn("_b", b.select(F.struct("q1", "q3")).scalar()).filter(inside | F.col(m).isNull()).drop("_b")
    return df


def improvement_pct(x: Column, base: Column, higher_is_better: bool = False) -> Column:
    """Relative improvement over a baseline in percent."""
    gain = (x - base) / F.abs(base) if higher_is_better else (base - x) / base
    return F.when(base != 0, gain * 100)


def improvement_summary(df: DataFrame, base: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean improvement in mse and expvar of every row over its group's baseline."""
    j = df.join(base.select(*by, F.col("mse").alias("_bm"), F.col("expvar").alias("_be")), list(by))
    return j.groupBy(*by).agg(F.avg(improvement_pct(F.col("mse"), F.col("_bm"))).alias("mse_improvement"),
                              F.avg(improvement_pct(F.col("expvar"), F.col("_be"), True)).alias("expvar_improvement"))


def gene_sharing(panel: DataFrame) -> DataFrame:
    """Cell types per gene: (n_celltypes, n_genes)."""
    per = panel.groupBy("gene").agg(F.count_distinct("celltype").alias("n_celltypes"))
    return per.groupBy("n_celltypes").agg(F.count(F.lit(1)).alias("n_genes"))


def gene_sharing_summary(panel: DataFrame) -> DataFrame:
    """One row: genes in several types, in one only, and the largest and mean number of types."""
    d = gene_sharing(panel)
    n, g = F.col("n_celltypes"), F.col("n_genes")
    return d.agg(F.sum(g).alias("total"), F.sum(F.when(n > 1, g).otherwise(0)).alias("shared"), F.sum(F.when(n == 1, g).otherwise(0)).alias("unique"),
                 F.max(n).alias("max_celltypes"), (F.sum(n * g) / F.sum(g)).alias("avg_celltypes"))


def f1_matrix(report: DataFrame, datasets: Sequence[str], key: str | None = None) -> DataFrame:
    """Cell types by datasets of F1, rows ordered by their mean; of several values that of the smallest ``key``, else the smallest."""
    order = F.struct(*([key] if key else []), "f1")
    wide = report.groupBy("celltype").pivot("dataset", list(datasets)).agg(F.min_by("f1", F.when(F.col("f1").isNotNull(), order)))
    total = sum((F.coalesce(F.col(f"`{d}`"), F.lit(0.0)) for d in datasets), F.lit(0.0))
    have = sum((F.when(F.col(f"`{d}`").isNotNull(), 1).otherwise(0) for d in datasets), F.lit(0))
    return wide.withColumn("row_mean", F.when(have > 0, total / have)).orderBy(F.desc("row_mean"), "celltype")


def preservation_matrix(scores: DataFrame, ks: Sequence[int], key: str | None = None) -> DataFrame:
    """Datasets by neighbourhood size of the preservation score; of several values that of the smallest ``key``, else the smallest."""
    order = F.struct(*([key] if key else []), "preservation_score")
    return scores.groupBy("dataset").pivot("k", [str(k) for k in ks]).agg(F.min_by("preservation_score", F.when(F.col("preservation_score").isNotNull(), order)))


def results_reshape(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long rows per (dataset, analysis_type, celltype, metric) from wide per-panel metrics."""
    kept = df.filter(~F.coalesce(F.col("skipped"), F.lit(False)))
    return kept.unpivot(["dataset", "analysis_type", "celltype"], list(metrics), "metric", "value")


def results_summary(long: DataFrame) -> DataFrame:
    """Per dataset and metric: the global value and the mean over cell types."""
    g = F.avg(F.when(F.col("analysis_type") == "global", F.col("value"))).alias("global_value")
    m = F.avg(F.when(F.col("analysis_type") == "per_celltype", F.col("value"))).alias("macro_value")
    n = F.count_if((F.col("analysis_type") == "per_celltype") & F.col("value").isNotNull()).alias("n_celltypes")
    return long.groupBy("dataset", "metric").agg(g, m, n)


def mean_std_lookup(df: DataFrame, metric: str = "expvar") -> DataFrame:
    """Pair the 'summary_mean' and 'summary_std' rows of each cell type; a missing std is 0."""
    m = df.filter("iteration = 'summary_mean'").select("celltype", F.col(metric).alias("mean"))
    s = df.filter("iteration = 'summary_std'").select("celltype", F.col(metric).alias("std"))
    return m.join(s, "celltype", "left").na.fill(0.0, ["std"]).orderBy(F.desc("mean"), "celltype")


def method_results(df: DataFrame) -> DataFrame:
    """Macro and cell-weighted scores per dataset file, with the panel size read from its name."""
    size = F.regexp_extract("dataset", r"_(100|200)(?:_|$)", 1)
    w = F.sum("n_cells")
    return df.groupBy("dataset").agg(
        F.avg("mse").alias("macro_mse"), F.avg("expvar").alias("macro_expvar"),
        (F.sum(F.col("mse") * F.col("n_cells")) / w).alias("weighted_mse"), (F.sum(F.col("expvar") * F.col("n_cells")) / w).alias("weighted_expvar"),
    ).withColumn("n_genes", F.when(size != "", size.cast("int")))
