"""Gene filters: name blacklist, expression bounds, small cell types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default blacklist prefixes and expression bounds.
BLACKLIST_PREFIXES = ["mt-", "hsp"]
MIN_EXPRESSION = 0.1
MAX_EXPRESSION = 100.0


def blacklist_filter(
    genes: DataFrame, patterns: Sequence[str] = (), use_default: bool = True, force_include: Sequence[str] = ()
) -> DataFrame:
    """Add ``blacklist_status``: 'forced', 'removed' or 'kept' (case-insensitive prefixes)."""
    prefixes = [p.lower() for p in [*(BLACKLIST_PREFIXES if use_default else []), *patterns]]
    low = F.lower("gene")
    hit: Column = F.lit(False)
    for p in prefixes:
        hit = hit | low.startswith(p)
    status = F.when(hit, "removed").otherwise("kept")
    if force_include:
        status = F.when(low.isin([g.lower() for g in force_include]), "forced").otherwise(status)
    return genes.withColumn("blacklist_status", status)


def _check_bounds(lo: float, hi: float) -> None:
    if lo >= hi:
        raise ValueError(f"lower bound {lo} must be below upper bound {hi}")


def expression_filter_global(panel: DataFrame, means: DataFrame, lo: float = MIN_EXPRESSION, hi: float = MAX_EXPRESSION) -> DataFrame:
    """Mark genes by their mean over all cells; ``means(gene, mean_expr)``, missing = 0."""
    _check_bounds(lo, hi)
    e = F.coalesce("_mean", F.lit(0.0))
    reason = F.when(e < lo, "too_low_expression_global").when(e > hi, "too_high_expression_global")
    return (
        panel.drop("passed_xenium", "xenium_failure_reason")
        .join(means.select("gene", F.col("mean_expr").alias("_mean")), "gene", "left")
        .withColumn("xenium_failure_reason", reason)
        .withColumn("passed_xenium", F.col("xenium_failure_reason").isNull())
        .drop("_mean")
    )


def expression_filter(
    panel: DataFrame, means: DataFrame, lo: float = MIN_EXPRESSION, hi: float = MAX_EXPRESSION, celltype_aware: bool = True
) -> DataFrame:
    """Mark genes by ``means(celltype, gene, mean_expr)``.

    Genes of a known cell type are judged there; genes marked 'global' or of an
    unknown type, and all genes when not ``celltype_aware``, pass if any cell
    type has them in range.
    """
    _check_bounds(lo, hi)
    known = means.select(F.col("celltype").alias("_ct")).distinct().withColumn("_known", F.lit(True))
    own = means.select(F.col("celltype").alias("_oct"), F.col("gene").alias("_og"), F.col("mean_expr").alias("_own"))
    anywhere = means.groupBy(F.col("gene").alias("_ag")).agg(
        F.bool_or(F.col("mean_expr").between(lo, hi)).alias("_any")
    )
    p = panel.drop("passed_xenium", "xenium_failure_reason")
    p = p.join(anywhere, F.col("gene") == F.col("_ag"), "left").drop("_ag")
    anyfail = F.when(~F.coalesce("_any", F.lit(False)), "failed_all_celltypes")
    if celltype_aware:
        p = p.join(known, F.col("celltype") == F.col("_ct"), "left")
        p = p.join(own, (F.col("celltype") == F.col("_oct")) & (F.col("gene") == F.col("_og")), "left")
        e = F.coalesce("_own", F.lit(0.0))
        specific = F.when(e < lo, F.concat(F.lit("too_low_expression_"), "celltype")).when(
            e > hi, F.concat(F.lit("too_high_expression_"), "celltype")
        )
        use_own = F.coalesce("_known", F.lit(False)) & (F.col("celltype") != "global")
        reason = F.when(use_own, specific).otherwise(anyfail)
    else:
        reason = anyfail
    return (
        p.withColumn("xenium_failure_reason", reason)
        .withColumn("passed_xenium", F.col("xenium_failure_reason").isNull())
        .drop("_any", "_ct", "_known", "_oct", "_og", "_own")
    )


def filter_celltypes(cells: DataFrame, min_cells: int = 10, group: str = "celltype") -> DataFrame:
    """Cells per type and whether the type is large enough."""
    return cells.groupBy(group).agg(F.count(F.lit(1)).alias("n_cells")).withColumn("valid", F.col("n_cells") >= min_cells)


def top_n_passing(panel: DataFrame, n: int, per_celltype: bool = False) -> DataFrame:
    """First ``n`` passing genes by rank; optionally in proportion to the passing genes of each type."""
    if n <= 0:
        raise ValueError("n must be positive")
    passing = panel.filter(F.col("passed_xenium"))
    if not per_celltype:
        return passing.orderBy("rank", "gene").limit(n)
    sizes = passing.groupBy("celltype").agg(F.count(F.lit(1)).alias("_c"))
    total = passing.agg(F.count(F.lit(1))).scalar()
    # No type gets more than n, so the literal bound lets Spark trim each map task first.
    w = Window.partitionBy("celltype").orderBy("rank", "gene")
    ranked = passing.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n)
    quota = F.floor(F.lit(n) * (F.col("_c") / F.col("_total")))
    first = (
        ranked.join(sizes.withColumn("_total", total), "celltype")
        .filter(F.col("_i") <= quota)
        .drop("_i", "_c", "_total")
    )
    used = first.select("gene")
    rest = passing.join(used, "gene", "left_anti").orderBy("rank", "gene").limit(n)
    both = first.withColumn("_t", F.lit(0)).unionByName(rest.withColumn("_t", F.lit(1)))
    return both.orderBy("_t", "rank", "gene").limit(n).drop("_t")
