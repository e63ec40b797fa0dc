"""Errors between matrices, correlations, and averages over cell types and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import safe_div
from panelweave.functions.ranks import SAMPLE_RATE, row_tie_ranks, weight_before
from panelweave.schema import ExprData, group_sizes, with_celltype
from panelweave.session import pin


def paired(truth: DataFrame, pred: DataFrame, value: str = "value") -> DataFrame:
    """Stored cells of either matrix side by side, absent = 0: (cell_id, gene, x, y)."""
    x = truth.select("cell_id", "gene", F.col(value).alias("x"))
    y = pred.select("cell_id", "gene", F.col(value).alias("y"))
    return x.join(y, ["cell_id", "gene"], "full_outer").na.fill(0.0, ["x", "y"])


def _sums() -> list[Column]:
    x, y = F.col("x"), F.col("y")
    d = x - y
    return [
        F.count(F.lit(1)).alias("stored"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.sum(d * d).alias("sdd"), F.sum(F.abs(d)).alias("sad"),
    ]


def pair_metrics(sums: DataFrame, n: Column, keep: Sequence[str] = ()) -> DataFrame:
    """All pairwise metrics from the sums of :func:`_sums` over ``n`` entries (zeros included)."""
    s = sums.withColumn("_n", n.cast("double"))
    N = F.col("_n")
    vx = F.greatest(F.col("sxx") / N - (F.col("sx") / N) * (F.col("sx") / N), F.lit(0.0))
    vy = F.greatest(F.col("syy") / N - (F.col("sy") / N) * (F.col("sy") / N), F.lit(0.0))
    s = s.withColumns({"_vx": vx, "_vy": vy})
    mse = F.col("sdd") / N
    dm = (F.col("sx") - F.col("sy")) / N
    tiny = F.lit(1e-12)
    vx, vy = F.col("_vx"), F.col("_vy")
    flat = vx <= tiny * F.greatest(F.col("sxx") / N, F.lit(1e-300))
    flat_y = vy <= tiny * F.greatest(F.col("syy") / N, F.lit(1e-300))
    cov = F.col("sxy") / N - (F.col("sx") / N) * (F.col("sy") / N)
    norm = F.sqrt("sxx") * F.sqrt("syy")
    return s.select(
        *keep, F.col("_n").cast("long").alias("n"), mse.alias("mse"), (F.col("sad") / N).alias("mae"), F.sqrt(mse).alias("rmse"),
        F.when(~flat, 1 - (mse - dm * dm) / vx).alias("explained_variance"),
        F.when(flat, 0.0).otherwise(1 - mse / vx).alias("explained_variance_v2"),
        F.when(~flat, 1 - mse / vx).alias("r2"),
        F.when(~flat & ~flat_y, cov / F.sqrt(vx * vy)).alias("pearson"),
        safe_div(F.col("sxy"), norm).alias("cosine"),
        (mse - dm * dm).alias("residual_var"), vx.alias("total_var"),
    )


def pair_metrics_flat(pairs: DataFrame, by: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Metrics of a plain table of (x, y) rows, over all rows or per ``by``."""
    p = pairs.withColumns({"x": F.col(x).cast("double"), "y": F.col(y).cast("double")})
    return pair_metrics(p.groupBy(*by).agg(*_sums()), F.col("stored"), list(by))


def metrics_per_gene(truth: DataFrame, pred: DataFrame, cells: DataFrame) -> DataFrame:
    n = cells.agg(F.count(F.lit(1))).scalar()
    return pair_metrics(paired(truth, pred).groupBy("gene").agg(*_sums()), n, ["gene"])


def reconstruction_metrics(truth: DataFrame, pred: DataFrame, cells: DataFrame, genes: DataFrame,
                           group: str | None = None) -> DataFrame:
    """Metrics over all cells and genes, or per cell type."""
    g = genes.select("gene").distinct().agg(F.count(F.lit(1))).scalar()
    p = paired(truth, pred)
    if group is None:
        n_cells = cells.agg(F.count(F.lit(1))).scalar()
        sums = p.agg(*_sums()).withColumns({"n_cells": n_cells, "n_genes": g})
        return pair_metrics(sums, F.col("n_cells") * F.col("n_genes"), ["n_cells", "n_genes"])
    sums = p.join(cells.select("cell_id", group), "cell_id").groupBy(group).agg(*_sums())
    sums = group_sizes(cells, group).join(sums, group, "left").na.fill(0).withColumn("n_genes", g)
    return pair_metrics(sums, F.col("n_cells") * F.col("n_genes"), [group, "n_cells", "n_genes"])


def spearman(truth: DataFrame, pred: DataFrame, n: Column | DataFrame, by: str = "gene", sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """Rank correlation per gene (``n`` cells) or per cell (``n`` genes), average ranks, zeros included.

    ``n`` is one number for all keys, or a table of ``by`` and the key's number.
    """
    # One pass over the facts; everything after works on distinct (x, y) with counts.
    pairs = pin(paired(truth, pred).filter((F.col("x") != 0) | (F.col("y") != 0)).groupBy(by, "x", "y").agg(
        F.count(F.lit(1)).alias("c")
    ))
    stored = pairs.groupBy(by).agg(F.sum("c").alias("stored"))
    if isinstance(n, DataFrame):
        own = next(c for c in n.columns if c != by)
        stored, n = stored.join(n, by), F.col(own)
    both_zero = stored.select(by, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (n - F.col("stored")).alias("c")).filter(F.col("c") > 0)
    # Each pass orders by one side and carries the other along.
    r = pin(row_tie_ranks(pairs.unionByName(both_zero), [by], "x", "c", "rx", sample_rate))
    r = row_tie_ranks(r, [by], "y", "c", "ry", sample_rate)
    c = F.col("c")
    s = r.groupBy(by).agg(
        F.sum(c).alias("n"), F.sum(c * F.col("rx")).alias("a"), F.sum(c * F.col("ry")).alias("b"),
        F.sum(c * F.col("rx") * F.col("rx")).alias("aa"), F.sum(c * F.col("ry") * F.col("ry")).alias("bb"),
        F.sum(c * F.col("rx") * F.col("ry")).alias("ab"),
    )
    N = F.col("n")
    va, vb = F.col("aa") - F.col("a") * F.col("a") / N, F.col("bb") - F.col("b") * F.col("b") / N
    return s.select(by, F.when((va > 1e-9) & (vb > 1e-9), (F.col("ab") - F.col("a") * F.col("b") / N) / F.sqrt(va * vb)).alias("spearman"))


def celltype_profile_quality(truth: ExprData, pred: DataFrame, group: str = "celltype") -> DataFrame:
    """Compare per-type mean profiles of truth and prediction over the genes both have."""
    shared = truth.genes.select("gene").join(pred.select("gene").distinct(), "gene", "left_semi")

    def sums(e: DataFrame, name: str) -> DataFrame:
        return with_celltype(e, truth.cells, group).groupBy(group, "gene").agg(F.sum("value").alias(name))

    p = sums(truth.expr, "x").join(sums(pred, "y"), [group, "gene"], "full_outer").na.fill(0.0, ["x", "y"])
    p = p.join(shared, "gene", "left_semi").join(group_sizes(truth.cells, group), group)
    p = p.withColumns({"x": F.col("x") / F.col("n_cells"), "y": F.col("y") / F.col("n_cells")})
    n = shared.agg(F.count(F.lit(1))).scalar()
    m = pair_metrics(p.groupBy(group, "n_cells").agg(*_sums()), n, [group, "n_cells"])
    m = pin(m.select(group, "n_cells", "pearson", "mse", "explained_variance"))
    m = m.withColumn("_w", m.agg(F.max("mse")).scalar())
    return m.withColumn("score", F.when(F.col("_w") > 0, 1 - F.col("mse") / F.col("_w")).otherwise(1.0)).drop("_w")


# --- averages over cell types ----------------------------------------------------------------

def _usable(metric: str, skipped: str | None) -> Column:
    ok = F.col(metric).isNotNull() & ~F.isnan(metric)
    return ok if skipped is None else ok & ~F.coalesce(F.col(skipped), F.lit(False))


def macro_mean(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), skipped: str | None = "skipped") -> DataFrame:
    """Plain mean over cell types that were not skipped and have a value."""
    return df.groupBy(*by).agg(*[F.avg(F.when(_usable(m, skipped), F.col(m))).alias(f"macro_{m}") for m in metrics])


def weighted_mean(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), weight: str = "n_cells",
                  skipped: str | None = "skipped") -> DataFrame:
    """Mean over cell types weighted by their cells."""
    aggs = []
    for m in metrics:
        ok = _usable(m, skipped)
        aggs.append(safe_div(F.sum(F.when(ok, F.col(m) * F.col(weight))), F.sum(F.when(ok, F.col(weight))), None).alias(f"weighted_{m}"))
    return df.groupBy(*by).agg(*aggs)


def inverse_freq_f1(df: DataFrame, by: Sequence[str] = (), f1: str = "f1", n: str = "n_cells", weighting: str = "inverse") -> DataFrame:
    """F1 averaged with weights 1/n or ln(N/n) so that rare types count more."""
    ok = df.filter(F.col(f1).isNotNull() & ~F.isnan(f1) & (F.col(n) > 0))
    if weighting == "log":
        tot = ok.groupBy(*by).agg(F.sum(n).alias("_t"))
        ok = ok.join(tot, list(by)) if by else ok.withColumn("_t", tot.scalar())
        w = F.log(F.col("_t") / F.col(n))
    else:
        w = 1.0 / F.col(n)
    return ok.groupBy(*by).agg(safe_div(F.sum(w * F.col(f1)), F.sum(w), None).alias("inverse_freq_f1"))


def standardized_score(df: DataFrame, by: Sequence[str], metrics: Sequence[str] = ("macro_mse", "macro_expvar", "weighted_mse", "weighted_expvar")) -> DataFrame:
    """Mean z score over metrics within each group; errors are negated, constant metrics left out."""
    present = [m for m in metrics if m in df.columns]
    stats = df.groupBy(*by).agg(*[a for m in present for a in (F.avg(m).alias(f"_m_{m}"), F.stddev_samp(m).alias(f"_s_{m}"))])
    slim = stats.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], *[c for c in stats.columns if c not in by])
    cond = F.lit(True)
    for i, b in enumerate(by):
        cond = cond & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    j = df.join(slim, cond)
    zs, used = F.lit(0.0), F.lit(0)
    for m in present:
        live = F.coalesce(F.col(f"_s_{m}") > 0, F.lit(False))
        z = (F.col(m) - F.col(f"_m_{m}")) / F.col(f"_s_{m}")
        zs = zs + F.when(live, -z if "mse" in m else z).otherwise(0.0)
        used = used + F.when(live, 1).otherwise(0)
    return j.withColumn("standardized_score", F.when(used > 0, zs / used)).select(*df.columns, "standardized_score")


def fold_aggregate(df: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation over folds; a null cell type is its own group."""
    return df.groupBy(*by).agg(*[a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))])


def mapping_fold_aggregate(df: DataFrame, metrics: Sequence[str], by: Sequence[str], skipped: str = "skipped") -> DataFrame:
    """Mean and population standard deviation over the folds that ran."""
    ran = df.filter(~F.coalesce(F.col(skipped), F.lit(False)))
    return ran.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_folds"),
        *[a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))],
    )


def competition_rank(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Min-rank, highest first, on each metric and the mean of the ranks.

    ``df`` has one row per dataset (panel).
    """
    df = pin(df)
    out = df
    for m in metrics:
        seen = df.filter(F.col(m).isNotNull()).groupBy(F.col(m).alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
        place = weight_before(seen, [], -F.col("_v"), F.col("_w"), "_b")
        place = place.select("_v", (F.col("_b") + 1).alias(f"{m}_rank"))
        out = out.join(place, F.col(m) == F.col("_v"), "left").drop("_v")
    total = sum((F.col(f"{m}_rank") for m in metrics), F.lit(0))
    return out.withColumn("average_rank", total / len(metrics))


# --- ratios ----------------------------------------------------------------------------------

def mse_ratio(probe: Column, base: Column) -> Column:
    """probe / base; infinite when the baseline has no error."""
    return F.when(base == 0, F.lit(float("inf"))).otherwise(probe / base)


def expvar_ratio(probe: Column, base: Column) -> Column:
    """probe / base; 0 when the baseline explains nothing."""
    return F.when(base <= 0, F.lit(0.0)).otherwise(probe / base)


def variability_ratios(df: DataFrame) -> DataFrame:
    """Add mse and expvar ratios of probe to baseline for train and test, and the generalisation gap."""
    for part in ("train", "test"):
        df = df.withColumn(f"mse_ratio_{part}", mse_ratio(F.col(f"mse_{part}_probe"), F.col(f"mse_{part}_baseline")))
        df = df.withColumn(f"expvar_ratio_{part}", expvar_ratio(F.col(f"expvar_{part}_probe"), F.col(f"expvar_{part}_baseline")))
    return df.withColumn("generalization_gap", F.col("mse_ratio_test") - F.col("mse_ratio_train"))
