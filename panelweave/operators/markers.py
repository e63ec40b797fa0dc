"""Differential-expression tests per cell type, and tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import normal_two_sided_p
from panelweave.functions.ranks import SAMPLE_RATE, row_index, running_min_from_end, tie_ranks
from panelweave.session import pin
from panelweave.schema import ExprData, grid, group_sizes, total_cells, with_celltype


def _fold_change(mean_a, mean_b):
    """log2 ratio of back-transformed means of log data."""
    eps = F.lit(1e-9)
    return F.log2((F.expm1(mean_a) + eps) / (F.expm1(mean_b) + eps))


def rank_genes_wilcoxon(
    data: ExprData, group: str = "celltype", value: str = "value", p_values: bool = True, sample_rate: int = SAMPLE_RATE
) -> DataFrame:
    """Rank-sum score of every (group, gene) against all other cells, zeros included.

    Ranks are taken over distinct values: one pass shrinks the facts to (gene,
    value, group, count), written once; only that table is ordered and joined,
    and the implicit zeros of a gene are a single row.
    """
    total = total_cells(data.cells)
    counted = pin(
        with_celltype(data.expr.filter(F.col(value) != 0), data.cells, group)
        .groupBy("gene", group, F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    distinct = counted.groupBy("gene", "v").agg(F.sum("c").alias("w"))
    stored = distinct.groupBy("gene").agg(F.sum("w").alias("nnz"))
    zeros = (
        data.genes.select("gene").join(stored, "gene", "left")
        .select("gene", F.lit(0.0).alias("v"), (total - F.coalesce("nnz", F.lit(0))).alias("w"))
        .filter(F.col("w") > 0)
    )
    ranks = tie_ranks(distinct.unionByName(zeros), ["gene"], "v", "w", "r", sample_rate)
    stats = counted.join(ranks.select("gene", "v", "r"), ["gene", "v"]).groupBy(group, "gene").agg(
        F.sum(F.col("c") * F.col("r")).alias("rsum"),
        F.sum("c").alias("nnz"),
        F.sum(F.col("c") * F.col("v")).alias("s"),
    )
    zero_rank = ranks.filter(F.col("v") == 0).select("gene", F.col("r").alias("r0"))
    d = (
        grid(data.genes, data.cells, group)
        .join(stats, [group, "gene"], "left")
        .join(zero_rank, "gene", "left")
        .join(group_sizes(data.cells, group), group)
        .na.fill(0, ["rsum", "nnz", "s", "r0"])
        # A gene has one row per label here.
        .withColumns({"n": total, "s_all": F.sum("s").over(Window.partitionBy("gene"))})
    )
    # As doubles: the product of three counts passes a long at a few million cells.
    na, n = F.col("n_cells").cast("double"), F.col("n").cast("double")
    nr = n - na
    rsum = F.col("rsum") + (na - F.col("nnz")) * F.col("r0")
    sd = F.sqrt(na * nr * (n + 1) / 12.0)
    z = F.when(sd > 0, (rsum - na * (n + 1) / 2.0) / sd).otherwise(0.0)
    mean_rest = F.when(nr > 0, (F.col("s_all") - F.col("s")) / nr).otherwise(0.0)
    out = d.select(
        F.col(group).alias("group"), "gene", z.alias("scores"),
        _fold_change(F.col("s") / na, mean_rest).alias("logfoldchanges"),
    )
    if p_values:
        out = bh_adjust(out.withColumn("pvals", normal_two_sided_p("scores")), sample_rate=sample_rate)
    return out


def rank_genes_ttest(data: ExprData, group: str = "celltype", value: str = "value") -> DataFrame:
    """Welch t score of every (group, gene) against all other cells, with its degrees of freedom."""
    v = F.col(value)
    per = with_celltype(data.expr, data.cells, group).groupBy(group, "gene").agg(
        F.sum(v).alias("s1"), F.sum(v * v).alias("s2")
    )
    labels = Window.partitionBy("gene")
    d = (
        grid(data.genes, data.cells, group).join(per, [group, "gene"], "left")
        .join(group_sizes(data.cells, group), group).na.fill(0.0, ["s1", "s2"])
        .withColumns({"n": total_cells(data.cells), "a1": F.sum("s1").over(labels), "a2": F.sum("s2").over(labels)})
    )
    na = F.col("n_cells")
    d = d.withColumns({
        "nr": F.col("n") - na, "m1": F.col("s1") / na,
        "r1": F.col("a1") - F.col("s1"), "r2": F.col("a2") - F.col("s2"),
    }).filter(F.col("nr") > 0)
    nr = F.col("nr")
    d = d.withColumns({
        "m2": F.col("r1") / nr,
        "v1": F.when(na > 1, F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / na, F.lit(0.0)) / (na - 1)).otherwise(0.0),
        "v2": F.when(nr > 1, F.greatest(F.col("r2") - F.col("r1") * F.col("r1") / nr, F.lit(0.0)) / (nr - 1)).otherwise(0.0),
    })
    a, b = F.col("v1") / na, F.col("v2") / nr
    se = a + b
    t = F.when(se > 0, (F.col("m1") - F.col("m2")) / F.sqrt(se)).otherwise(0.0)
    parts = F.when(na > 1, a * a / (na - 1)).otherwise(0.0) + F.when(nr > 1, b * b / (nr - 1)).otherwise(0.0)
    dof = F.when(parts > 0, se * se / parts)
    return d.select(F.col(group).alias("group"), "gene", t.alias("scores"), dof.alias("dof"),
                    _fold_change(F.col("m1"), F.col("m2")).alias("logfoldchanges"))


def bh_adjust(df: DataFrame, p: str = "pvals", group: str = "group", key: str = "gene", out: str = "pvals_adj",
              sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """Benjamini-Hochberg adjusted p within each group."""
    df = pin(df)
    order = F.struct(F.col(p).alias("p"), F.col(key).alias("k"))
    ranked = row_index(df, [group], order, "_rk", sample_rate)
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_m"))
    scaled = ranked.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_q", F.col(p) * F.col("_m") / F.col("_rk"))
    best = running_min_from_end(scaled, [group], order, F.col("_q"), out, sample_rate)
    return best.withColumn(out, F.least(F.col(out), F.lit(1.0))).drop("_rk", "_g", "_m", "_q")


def deg_filter(deg: DataFrame, max_pval: float = 0.05) -> DataFrame:
    return deg.filter(F.col("pvals_adj") <= max_pval)


def best_group_per_gene(deg: DataFrame) -> DataFrame:
    """The row of each gene with the smallest adjusted p; group name breaks ties."""
    rest = [c for c in deg.columns if c not in ("gene", "pvals_adj", "group")]
    best = F.min(F.struct("pvals_adj", "group", *rest)).alias("b")
    return deg.groupBy("gene").agg(best).select("gene", "b.*")


def deg_candidates(deg: DataFrame, size: int, n_groups: int) -> DataFrame:
    """Head of each group by score, then the best score per gene."""
    n = max(50, size // max(n_groups, 1) * 3)
    w = Window.partitionBy("group").orderBy(F.desc("scores"), "gene")
    head = deg.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n)
    return head.groupBy("gene").agg(F.max("scores").alias("scores")).orderBy(F.desc("scores"), "gene")


def deg_group_summary(deg: DataFrame, max_pval: float = 0.05) -> DataFrame:
    """Tested and significant genes per group."""
    sig = F.col("pvals_adj") <= max_pval
    return deg.groupBy("group").agg(
        F.count(F.lit(1)).alias("n_tested"), F.count_if(sig).alias("n_significant"),
        F.avg(F.when(sig, F.abs("logfoldchanges"))).alias("mean_abs_lfc"),
    )


def marker_panel(data: ExprData, per_group: int = 5, group: str = "celltype", value: str = "value") -> DataFrame:
    """The ``per_group`` best-scoring genes of every group."""
    deg = rank_genes_wilcoxon(data, group, value, p_values=False)
    w = Window.partitionBy("group").orderBy(F.desc("scores"), "gene")
    return deg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_group)


def rare_celltype_coverage(
    cells: DataFrame, deg: DataFrame, panel: DataFrame, min_fraction: float = 0.01, min_cells: int = 50,
    top_n: int = 50, min_lfc: float = 1.0, max_pval: float = 0.05, group: str = "celltype",
) -> DataFrame:
    """Per rare type: exclusive markers among its top genes, and how many the panel holds."""
    sizes = cells.groupBy(F.col(group).alias("celltype")).agg(F.count(F.lit(1)).alias("n_cells")).withColumn("_n", total_cells(cells))
    rare = sizes.filter((F.col("n_cells") < min_cells) | (F.col("n_cells") < F.col("_n") * min_fraction))
    w = Window.partitionBy("group").orderBy(F.desc("scores"), "gene")
    top = deg.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= top_n)
    marks = top.filter((F.col("logfoldchanges") >= min_lfc) & (F.col("pvals_adj") < max_pval)).select(
        F.col("group").alias("celltype"), "gene"
    )
    inside = panel.select("gene").distinct().withColumn("_in", F.lit(1))
    counts = marks.join(inside, "gene", "left").groupBy("celltype").agg(
        F.count(F.lit(1)).alias("n_exclusive_markers_total"), F.count("_in").alias("n_exclusive_markers_in_panel")
    )
    return rare.join(counts, "celltype", "left").na.fill(0).select(
        "celltype", "n_cells", (F.col("n_cells") / F.col("_n")).alias("fraction_cells"),
        "n_exclusive_markers_total", "n_exclusive_markers_in_panel",
    )


def rare_coverage_summary(per_type: DataFrame) -> DataFrame:
    """One row: rare types and the share with at least one marker in the panel."""
    n, c = F.count(F.lit(1)), F.count_if(F.col("n_exclusive_markers_in_panel") >= 1)
    return per_type.agg(
        n.alias("n_rare_celltypes"), c.alias("panel_n_rare_ct_covered"),
        F.when(n > 0, c / n).otherwise(F.lit(float("nan"))).alias("panel_fraction_rare_ct_covered"),
    )
