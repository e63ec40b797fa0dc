"""Validation, cell and gene filters, normalisation and variable-gene ranking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import is_finite, shifted_log
from panelweave.functions.ranks import exact_quantiles
from panelweave.schema import ExprData, gene_moments, grid, group_sizes, with_celltype
from panelweave.session import pin

# Name patterns of the quality flags (case-sensitive, mixed species).
QC_PATTERNS = {"mt": "^MT-", "ribo": "^(Rps|Rpl)", "hb": "^Hb[^(P)]"}
TARGET_SUM = 1e4
MIN_GENES_PER_CELL = 100
MIN_CELLS_PER_GENE = 3


def is_raw_counts(expr: DataFrame, value: str = "value") -> DataFrame:
    """One row: are all stored values whole numbers within floating tolerance?"""
    v, r = F.col(value), F.round(F.col(value))
    ok = F.abs(v - r) <= 1e-8 + 1e-5 * F.abs(r)
    return expr.agg(F.coalesce(F.bool_and(F.when(v != 0, ok)), F.lit(True)).alias("is_raw_counts"))


def data_issues(expr: DataFrame, cells: DataFrame, value: str = "value") -> DataFrame:
    """One row of problem counts: NaN, infinite and negative values, cells with zero total."""
    v = F.col(value)
    stats = expr.agg(
        F.count_if(F.isnan(v)).alias("n_nan"),
        F.count_if(F.abs(v) == F.lit(float("inf"))).alias("n_inf"),
        F.count_if((v < 0) & is_finite(v)).alias("n_negative"),
    )
    live = expr.groupBy("cell_id").agg(F.sum(value).alias("t")).filter(F.col("t") != 0)
    empty = cells.join(live, "cell_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return stats.withColumn("n_zero_cells", empty.scalar())


def sanitize(
    expr: DataFrame, value: str = "value", nan: float = 0.0, posinf: float | None = None, neginf: float = 0.0
) -> DataFrame:
    """Replace non-finite values; ``posinf=None`` means the largest finite value."""
    v = F.col(value)
    if posinf is None:
        top = expr.filter(is_finite(v)).agg(F.max(value)).scalar()
    else:
        top = F.lit(float(posinf))
    inf = F.lit(float("inf"))
    return expr.withColumn(
        value,
        F.when(F.isnan(v), F.lit(float(nan))).when(v == inf, top).when(v == -inf, F.lit(float(neginf))).otherwise(v),
    )


def qc_metrics(
    expr: DataFrame, cells: DataFrame, patterns: Mapping[str, str] = QC_PATTERNS, value: str = "value"
) -> DataFrame:
    """Per cell: genes seen, total, share of each flagged gene family, and log1p copies."""
    v = F.col(value)
    aggs = [F.count_if(v != 0).alias("n_genes"), F.sum(v).alias("total")]
    aggs += [F.sum(F.when(F.col("gene").rlike(p), v).otherwise(0.0)).alias(f"total_{n}") for n, p in patterns.items()]
    out = cells.select("cell_id").join(expr.groupBy("cell_id").agg(*aggs), "cell_id", "left").na.fill(0)
    for n in patterns:
        share = F.when(F.col("total") != 0, F.col(f"total_{n}") / F.col("total") * 100).otherwise(0.0)
        out = out.withColumn(f"pct_{n}", share)
    return out.withColumns({
        "log1p_n_genes": F.log1p(F.col("n_genes").cast("double")),
        "log1p_total": F.log1p("total"),
        **{f"log1p_total_{n}": F.log1p(f"total_{n}") for n in patterns},
    })


def filter_cells(data: ExprData, min_genes: int = MIN_GENES_PER_CELL, value: str = "value") -> ExprData:
    """Keep cells that express at least ``min_genes`` genes.

    The count is a window over the cell, so the same partitioning serves the
    filter and a later per-cell normalisation: one shuffle of the facts.
    """
    per_cell = Window.partitionBy("cell_id")
    seen = F.count_if(F.col(value) > 0).over(per_cell)
    expr = data.expr.withColumn("_seen", seen).filter(F.col("_seen") >= min_genes).drop("_seen")
    cells = data.cells
    if min_genes > 0:
        kept = data.expr.filter(F.col(value) > 0).groupBy("cell_id").count().filter(F.col("count") >= min_genes)
        cells = cells.join(kept, "cell_id", "left_semi")
    return ExprData(expr, cells, data.genes)


def filter_genes(data: ExprData, min_cells: int = MIN_CELLS_PER_GENE, value: str = "value") -> ExprData:
    """Keep genes seen in at least ``min_cells`` cells."""
    kept = data.expr.filter(F.col(value) > 0).groupBy("gene").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= min_cells
    )
    return keep_genes(data, kept)


def filter_genes_min_counts(data: ExprData, min_counts: float = 1, value: str = "value") -> ExprData:
    """Keep genes whose total over all cells is at least ``min_counts``."""
    kept = data.expr.groupBy("gene").agg(F.sum(value).alias("t")).filter(F.col("t") >= min_counts)
    return keep_genes(data, kept)


def normalize_total(
    expr: DataFrame, target: float | None = TARGET_SUM, value: str = "value", out: str | None = None
) -> DataFrame:
    """Scale each cell to ``target``, or to the median of the non-zero totals when it is None."""
    out = out or value
    total = F.sum(value).over(Window.partitionBy("cell_id"))
    if target is None:
        totals = expr.groupBy("cell_id").agg(F.sum(value).alias("t")).filter(F.col("t") > 0)
        goal = exact_quantiles(totals, [], "t", {"median": 0.5}).scalar()
    else:
        goal = F.lit(float(target))
    scaled = expr.withColumn("_total", total)
    ratio = F.when(F.col("_total") == 0, F.col(value)).otherwise(F.col(value) / F.col("_total") * goal)
    return scaled.withColumn(out, ratio).drop("_total")


def log1p(expr: DataFrame, value: str = "value", out: str | None = None) -> DataFrame:
    return expr.withColumn(out or value, F.log1p(value))


def transform_values(df: DataFrame, value: str = "value", shift: float = 0.0, out: str | None = None) -> DataFrame:
    return df.withColumn(out or value, shifted_log(F.col(value), shift))


def robust_limits(df: DataFrame, value: str = "value", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row (vmin, vmax): quantiles of the finite values; (0, 1) if none, widened when equal."""
    q = exact_quantiles(df.filter(is_finite(F.col(value))), [], value, {"lo": low, "hi": high})
    lo, hi = F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(1.0))
    return q.agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")).select(
        lo.alias("vmin"), F.when(lo == hi, hi + 1.0).otherwise(hi).alias("vmax")
    )


def scale(data: ExprData, max_value: float = 10.0, value: str = "value") -> DataFrame:
    """Z-score per gene (sample std), clipped; dense, so meant for panel-sized gene sets."""
    m = gene_moments(data.expr, data.cells, data.genes, value)
    std = F.sqrt("var_samp")
    m = m.select("gene", "mean", F.when((std == 0) | std.isNull(), 1.0).otherwise(std).alias("std"))
    names = m.agg(F.collect_list(F.struct("gene", "mean", "std")).alias("gs")).scalar()
    dense = data.cells.select("cell_id").withColumn("_g", F.explode(names)).select("cell_id", "_g.*")
    z = (F.coalesce(F.col(value), F.lit(0.0)) - F.col("mean")) / F.col("std")
    lim = F.lit(float(max_value))
    return dense.join(data.expr.select("cell_id", "gene", value), ["cell_id", "gene"], "left").select(
        "cell_id", "gene", F.greatest(F.least(z, lim), -lim).alias(value)
    )


def variable_genes(data: ExprData, min_genes: int = 0, value: str = "value") -> DataFrame:
    """Genes with a standard deviation above zero; empty when fewer than ``min_genes`` remain."""
    keep = gene_moments(data.expr, data.cells, data.genes, value).filter(F.col("var_pop") > 0)
    keep = keep.select("gene", F.sqrt("var_pop").alias("std"))
    if min_genes:
        n = keep.agg(F.count(F.lit(1))).scalar()
        keep = keep.withColumn("_n", n).filter(F.col("_n") >= min_genes).drop("_n")
    return keep


# --- means -----------------------------------------------------------------------------------

def mean_expr_global(data: ExprData, value: str = "value") -> DataFrame:
    return gene_moments(data.expr, data.cells, data.genes, value).select("gene", F.col("mean").alias("mean_expr"))


def mean_expr_by_celltype(data: ExprData, dense: bool = False, group: str = "celltype", value: str = "value") -> DataFrame:
    """Mean per (celltype, gene) over all cells of the type, zeros included."""
    sums = with_celltype(data.expr, data.cells, group).groupBy(group, "gene").agg(F.sum(value).alias("s"))
    if dense:
        sums = grid(data.genes, data.cells, group).join(sums, [group, "gene"], "left").na.fill(0.0, ["s"])
    return sums.join(group_sizes(data.cells, group), group).select(
        group, "gene", (F.col("s") / F.col("n_cells")).alias("mean_expr")
    )


def dot_summary(
    data: ExprData, cutoff: float = 0.0, expressed_only: bool = False, standard_scale: str | None = None,
    group: str = "celltype", value: str = "value",
) -> DataFrame:
    """Per (group, gene): share of cells above ``cutoff`` and mean, optionally min-max scaled.

    ``standard_scale`` is None, 'gene' (scale each gene over groups) or 'group'.
    """
    v = F.col(value)
    above = v > cutoff
    zero_above = 1.0 if cutoff < 0 else 0.0
    agg = with_celltype(data.expr, data.cells, group).groupBy(group, "gene").agg(
        F.count(F.lit(1)).alias("nnz"), F.count_if(above).alias("n_above"),
        F.sum(v).alias("s"), F.sum(F.when(above, v)).alias("s_above"),
    )
    d = grid(data.genes, data.cells, group).join(agg, [group, "gene"], "left").na.fill(0, ["nnz", "n_above", "s", "s_above"])
    d = d.join(group_sizes(data.cells, group), group)
    n_above = F.col("n_above") + zero_above * (F.col("n_cells") - F.col("nnz"))
    mean = F.when(n_above > 0, F.col("s_above") / n_above).otherwise(0.0) if expressed_only else F.col("s") / F.col("n_cells")
    d = d.select(group, "gene", (n_above / F.col("n_cells")).alias("fraction"), mean.alias("mean_expr"))
    if standard_scale:
        w = Window.partitionBy("gene" if standard_scale == "gene" else group)
        lo, hi = F.min("mean_expr").over(w), F.max("mean_expr").over(w)
        d = d.withColumns({"_lo": lo, "_hi": hi})
        span = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.col("_hi") - F.col("_lo"))
        d = d.withColumn("mean_expr", (F.col("mean_expr") - F.col("_lo")) / span).drop("_lo", "_hi")
    return d


def dot_size(fraction: Column, smallest: float = 0.0, largest: float = 200.0, exponent: float = 1.5) -> Column:
    """Marker area for a fraction of expressing cells."""
    return F.lit(smallest) + (F.lit(largest) - F.lit(smallest)) * F.pow(fraction, F.lit(exponent))


# --- variable-gene ranking -------------------------------------------------------------------

def _top(df: DataFrame, n: int, score: str) -> DataFrame:
    df = pin(df)
    best = df.filter(F.col(score).isNotNull() & is_finite(F.col(score))).orderBy(F.desc(score), "gene").limit(n)
    flag = best.select("gene", F.lit(True).alias("highly_variable"))
    return df.join(flag, "gene", "left").na.fill(False, ["highly_variable"])


def _mean_dispersion(data: ExprData, value: str) -> DataFrame:
    m = gene_moments(data.expr, data.cells, data.genes, value)
    mean = F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    return m.select("gene", F.col("mean"), (F.col("var_samp") / mean).alias("disp"))


def hvg_seurat(data: ExprData, n: int = 2000, bins: int = 20, value: str = "value") -> DataFrame:
    """Normalised log dispersion within equal-width bins of log mean; input is log1p data."""
    raw = ExprData(data.expr.withColumn(value, F.expm1(value)), data.cells, data.genes)
    # Gene-sized and read by several branches below: one pass over the facts.
    d = pin(_mean_dispersion(raw, value).select(
        "gene", F.log1p(F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))).alias("means"),
        F.when(F.col("disp") > 0, F.log("disp")).alias("dispersions"),
    ))
    lo, hi = d.agg(F.min("means")).scalar(), d.agg(F.max("means")).scalar()
    d = d.withColumns({"_lo": lo, "_hi": hi})
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width == 0, 1).otherwise(F.greatest(F.ceil((F.col("means") - F.col("_lo")) / width), F.lit(1)))
    d = d.withColumn("bin", F.least(b, F.lit(bins)).cast("int"))
    per_bin = d.groupBy("bin").agg(F.avg("dispersions").alias("m"), F.stddev_samp("dispersions").alias("sd"))
    single = F.col("sd").isNull() | F.isnan("sd")
    per_bin = per_bin.select(
        "bin", F.when(single, 0.0).otherwise(F.col("m")).alias("m"), F.when(single, F.col("m")).otherwise(F.col("sd")).alias("sd")
    )
    norm = F.when(F.col("sd") != 0, (F.col("dispersions") - F.col("m")) / F.col("sd"))
    d = d.join(per_bin, "bin").select("gene", "means", "dispersions", norm.alias("dispersions_norm"))
    return _top(d, n, "dispersions_norm")


def hvg_cell_ranger(data: ExprData, n: int = 8000, value: str = "value") -> DataFrame:
    """Dispersion minus bin median over bin MAD, bins at the 10th, 15th ... 100th mean percentiles."""
    # The gene table is read by three quantile passes: write it once.
    d = pin(_mean_dispersion(data, value).select("gene", F.col("mean").alias("means"), F.col("disp").alias("dispersions")))
    names = [f"p{p}" for p in range(10, 105, 5)]
    cuts = exact_quantiles(d, [], "means", {f"p{p}": p / 100 for p in range(10, 105, 5)})
    edges = cuts.select(F.array(*names)).scalar()
    d = d.withColumn("_e", edges)
    d = d.withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col("means")))).drop("_e")
    d = pin(d)
    med = exact_quantiles(d, ["bin"], "dispersions", {"med": 0.5})
    dev = pin(d.join(med, "bin").withColumn("_dev", F.abs(F.col("dispersions") - F.col("med"))))
    mad = exact_quantiles(dev, ["bin"], "_dev", {"mad": 0.5})
    # Fixed value: 0.75 quantile of the standard normal.
    norm = F.when(F.col("mad") != 0, (F.col("dispersions") - F.col("med")) / (F.col("mad") / 0.6744897501960817))
    d = dev.join(mad, "bin").select("gene", "means", "dispersions", norm.alias("dispersions_norm"))
    return _top(d, n, "dispersions_norm")


def hvg_seurat_v3(data: ExprData, n: int = 2000, value: str = "value") -> DataFrame:
    """Variance of clipped standardised counts; the mean-variance trend is a quadratic in log10."""
    m = pin(gene_moments(data.expr, data.cells, data.genes, value).select("gene", "n", "mean", "var_samp"))
    fit = m.filter((F.col("mean") > 0) & (F.col("var_samp") > 0)).select(
        F.log10("mean").alias("x"), F.log10("var_samp").alias("y")
    )
    fit = fit.withColumn("_c", fit.agg(F.avg("x")).scalar()).withColumn("x", F.col("x") - F.col("_c"))
    x, y = F.col("x"), F.col("y")
    s = fit.agg(
        F.max("_c").alias("c"), F.count(F.lit(1)).cast("double").alias("s0"), F.sum(x).alias("s1"),
        F.sum(x * x).alias("s2"), F.sum(x * x * x).alias("s3"), F.sum(x * x * x * x).alias("s4"),
        F.sum(y).alias("t0"), F.sum(x * y).alias("t1"), F.sum(x * x * y).alias("t2"),
    )

    def det(a):
        c = [[F.col(v) for v in row] for row in a]
        return (
            c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1])
            - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0])
            + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])
        )

    base = [["s0", "s1", "s2"], ["s1", "s2", "s3"], ["s2", "s3", "s4"]]
    rhs = ["t0", "t1", "t2"]

    def coef(j):
        return det([[rhs[r] if i == j else base[r][i] for i in range(3)] for r in range(3)]) / det(base)

    co = s.select(F.struct("c", coef(0).alias("b0"), coef(1).alias("b1"), coef(2).alias("b2"))).scalar()
    m = m.withColumn("_co", co)
    lx = F.log10("mean") - F.col("_co.c")
    est = F.col("_co.b0") + F.col("_co.b1") * lx + F.col("_co.b2") * lx * lx
    m = m.withColumn("std", F.when(F.col("mean") > 0, F.sqrt(F.pow(F.lit(10.0), est)))).drop("_co")
    limit = F.col("mean") + F.col("std") * F.sqrt(F.col("n").cast("double"))
    clip = data.expr.join(m.select("gene", limit.alias("_lim")), "gene").withColumn("_v", F.least(F.col(value), F.col("_lim")))
    sums = clip.groupBy("gene").agg(F.sum("_v").alias("c1"), F.sum(F.col("_v") * F.col("_v")).alias("c2"))
    d = m.join(sums, "gene", "left").na.fill(0.0, ["c1", "c2"])
    nv = (F.col("n") * F.col("mean") * F.col("mean") + F.col("c2") - 2 * F.col("mean") * F.col("c1")) / (
        (F.col("n") - 1) * F.col("std") * F.col("std")
    )
    d = d.select("gene", F.col("mean").alias("means"), F.col("var_samp").alias("variances"),
                 F.when(F.col("std") > 0, nv).otherwise(0.0).alias("variances_norm"))
    return _top(d, n, "variances_norm")


def hvg(data: ExprData, flavor: str = "seurat", n: int = 2000, value: str = "value",
        known: DataFrame | None = None) -> DataFrame:
    """Rank genes by variability; ``known`` flags are reused when they mark at least ``n`` genes."""
    if known is not None and known.filter("highly_variable").limit(n).count() >= n:
        return known
    flavors = {"seurat": hvg_seurat, "cell_ranger": hvg_cell_ranger, "seurat_v3": hvg_seurat_v3}
    if flavor not in flavors:
        raise ValueError(f"unknown flavor {flavor}")
    return flavors[flavor](data, n=n, value=value)


def keep_genes(data: ExprData, genes: DataFrame) -> ExprData:
    """Restrict facts and dimension to some genes.

    The list is written first: its size is then known when the join with the
    facts is planned, and a small list is broadcast without shuffling them.
    """
    names = pin(genes.select("gene").distinct())
    return ExprData(data.expr.join(names, "gene", "left_semi"), data.cells, data.genes.join(names, "gene", "left_semi"))
