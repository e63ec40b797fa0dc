"""From factor loadings to a gene panel: pools, duplicate resolution, balanced selection.

``loadings(scope, factor, gene, loading)``: scope is a cell type or 'global',
factor an integer.  Groups in here are (scope, factor) and never larger than
the gene list; everything after the pool step is at most factors x pool size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.filters import MAX_EXPRESSION, MIN_EXPRESSION
from panelweave.session import pin

POOL_SIZE = 200
# Allowed imbalance between factors and least genes of a factor.
BALANCE_TOLERANCE = 0.1
MIN_CONTRIBUTION = 1


def factor_pool(loadings: DataFrame, size: int = POOL_SIZE) -> DataFrame:
    """Top ``size`` genes by |loading| of every (scope, factor)."""
    w = Window.partitionBy("scope", "factor").orderBy(F.desc("weight"), "gene")
    p = loadings.withColumn("weight", F.abs("loading"))
    return p.withColumn("pool_rank", F.row_number().over(w)).filter(F.col("pool_rank") <= size)


def pool_size_per_factor(pool_size: int, k: int) -> int:
    return max(1, pool_size // k)


def pool_expression_filter(pool: DataFrame, means: DataFrame, per_celltype: bool, lo: float = MIN_EXPRESSION,
                           hi: float = MAX_EXPRESSION) -> DataFrame:
    """Drop pool genes whose mean is out of range.

    Globally the mean of the cell-type means counts; per cell type its own mean,
    and cell types without any means are left alone.
    """
    if not per_celltype:
        # A type without a row for the gene has mean zero there.
        types = means.agg(F.count_distinct("celltype")).scalar()
        m = means.groupBy("gene").agg(F.sum("mean_expr").alias("_s")).select("gene", (F.col("_s") / types).alias("_m"))
        return pool.join(m, "gene", "left").filter(F.coalesce("_m", F.lit(0.0)).between(lo, hi)).drop("_m")
    m = means.select(F.col("celltype").alias("scope"), "gene", F.col("mean_expr").alias("_m"))
    known = means.select(F.col("celltype").alias("scope")).distinct().withColumn("_k", F.lit(True))
    j = pool.join(known, "scope", "left").join(m, ["scope", "gene"], "left")
    return j.filter(F.col("_k").isNull() | F.coalesce("_m", F.lit(0.0)).between(lo, hi)).drop("_k", "_m")


def assign_primary_factor(pool: DataFrame) -> DataFrame:
    """Each gene of a scope once, in the factor of largest weight (first factor on ties)."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), "factor", "loading")).alias("x")
    return pool.groupBy("scope", "gene").agg(best).select(
        "scope", F.col("x.factor").alias("factor"), "gene", F.col("x.loading").alias("loading"), (-F.col("x.w")).alias("weight"))


def resolve_duplicates(pool: DataFrame, loadings: DataFrame, k: int, target: int | None = None) -> DataFrame:
    """Primary factors, then factors below target topped up by signed loading with unused genes.

    ``target`` None means pool rows of the scope // k.  Factors are served in
    order, all scopes at once; each step works on tables of pool size.
    """
    pool, loadings = pin(pool), pin(loadings)
    chosen = assign_primary_factor(pool).withColumn("source", F.lit("pool"))
    counts = chosen.groupBy("scope", "factor").agg(F.count(F.lit(1)).alias("_c"))
    every = loadings.select("scope", "factor").distinct()
    goal = pool.groupBy("scope").agg(F.count(F.lit(1)).alias("_p"))
    want = F.lit(target) if target is not None else F.greatest(F.lit(1), F.floor(F.col("_p") / k)).cast("int")
    gaps = every.join(counts, ["scope", "factor"], "left").join(goal, "scope").select(
        "scope", "factor", (want - F.coalesce("_c", F.lit(0))).alias("_gap")).filter(F.col("_gap") > 0)
    chosen, gaps = pin(chosen), pin(gaps)
    for f in sorted(r.factor for r in gaps.select("factor").distinct().collect()):
        gap = gaps.filter(F.col("factor") == f).drop("factor")
        free = loadings.filter(F.col("factor") == f).join(gap, "scope").join(chosen.select("scope", "gene"), ["scope", "gene"], "left_anti")
        w = Window.partitionBy("scope").orderBy(F.desc("loading"), "gene")
        add = free.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= F.col("_gap")).select(
            "scope", "factor", "gene", "loading", F.abs("loading").alias("weight"), F.lit("replacement").alias("source"))
        chosen = pin(chosen.unionByName(add))
    return chosen


def resolve_across_celltypes(resolved: DataFrame, pool: DataFrame) -> DataFrame:
    """Each gene once over all cell types (the last type in name order owns it), with its contributing types."""
    own = F.max_by(F.struct("factor", "loading", "weight"), F.struct("scope", "factor")).alias("x")
    r = resolved.groupBy("gene").agg(F.max("scope").alias("celltype"), own)
    types = pool.groupBy("gene").agg(F.count_distinct("scope").alias("n_celltypes"), F.array_join(F.array_sort(F.collect_set("scope")), ", ").alias("contributing_celltypes"))
    return r.join(types, "gene", "left").select(
        "gene", "celltype", F.col("x.factor").alias("factor"), F.col("x.loading").alias("loading"), F.col("x.weight").alias("weight"),
        F.coalesce("n_celltypes", F.lit(1)).cast("long").alias("n_celltypes"), F.coalesce("contributing_celltypes", "celltype").alias("contributing_celltypes"))


def fill_gap_factor_aware(loadings: DataFrame, used: DataFrame, gaps: DataFrame, k: int) -> DataFrame:
    """``gaps(scope, gap)`` spread evenly over factors 0..k-1, best unused signed loading first."""
    taken, loadings = pin(used.select("scope", "gene")), pin(loadings)
    out = None
    for f in range(k):
        quota = (F.floor(F.col("gap") / k) + F.when(F.lit(f) < F.col("gap") % k, 1).otherwise(0)).alias("_q")
        free = loadings.filter(F.col("factor") == f).join(gaps.select("scope", quota), "scope").join(taken, ["scope", "gene"], "left_anti")
        w = Window.partitionBy("scope").orderBy(F.desc("loading"), "gene")
        add = pin(free.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= F.col("_q")).select("scope", "factor", "gene", "loading"))
        out = add if out is None else out.unionByName(add)
        taken = taken.unionByName(add.select("scope", "gene"))
    return out


def replacement_pools(panel: DataFrame, by: tuple[str, ...] = ("component",)) -> DataFrame:
    """Genes per component by rank, as one joined text."""
    genes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gene"))), lambda s: s["gene"]), ",")
    return panel.groupBy(*by).agg(genes.alias("genes"))


def factor_balance_report(selected: DataFrame, target: float) -> DataFrame:
    """Genes per factor, deviation from target and flags."""
    c = selected.groupBy("factor").agg(F.count(F.lit(1)).alias("n_genes"))
    dev = F.abs(F.col("n_genes") - F.lit(float(target))) / F.lit(float(target))
    return c.select("factor", "n_genes", dev.alias("deviation"), (dev > BALANCE_TOLERANCE).alias("imbalanced"),
                    (F.col("n_genes") < MIN_CONTRIBUTION).alias("too_few"))


def _number(df: DataFrame, *order) -> DataFrame:
    """Position column; ``df`` is at most a panel plus one gene per factor."""
    return df.withColumn("_i", F.row_number().over(Window.orderBy(*order)))


def select_from_pool_global(assigned: DataFrame, size: int, k: int) -> DataFrame:
    """ceil(size/k) best genes per factor, trimmed to ``size``.

    Trimming one gene at a time from over-represented factors equals taking the
    lowest loadings among each factor's removable tail, then the lowest overall.
    """
    per = math.ceil(size / k)
    assigned = pin(assigned)
    w = Window.partitionBy("factor").orderBy(F.desc("weight"), "gene")
    s = assigned.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per)
    s = s.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("factor")))
    limit = math.floor(size / k * (1 + BALANCE_TOLERANCE))
    removable = F.greatest(F.lit(0), F.least(F.col("_c") - limit, F.col("_c") - MIN_CONTRIBUTION))
    s = s.withColumn("_tail", F.col("_r") > F.col("_c") - removable)
    # At most k * ceil(size / k) rows from here on.
    over = F.greatest(F.lit(0), s.agg(F.count(F.lit(1))).scalar() - F.lit(size))
    tail = _number(s.filter("_tail"), F.asc("weight"), F.desc("gene")).withColumn("_over", over)
    drop1 = tail.filter(F.col("_i") <= F.col("_over")).select("gene")
    left = s.join(drop1, "gene", "left_anti")
    return left.orderBy(F.desc("weight"), "gene").limit(size).drop("_r", "_c", "_tail")


def select_from_pool_per_celltype(resolved: DataFrame, size: int, k: int, n_celltypes: int) -> DataFrame:
    """ceil(size/types/k) per (celltype, factor); short: fill by n_celltypes, over: drop lowest loading."""
    per = math.ceil(size / n_celltypes / k)
    resolved = pin(resolved)
    w = Window.partitionBy("celltype", "factor").orderBy(F.desc("weight"), "gene")
    s = resolved.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per).drop("_r")
    s = s.withColumn("source", F.lit("strict"))
    kept = s.orderBy(F.desc("weight"), "gene").limit(size)
    fill = resolved.join(s.select("gene"), "gene", "left_anti").orderBy(F.desc("n_celltypes"), F.desc("weight"), "gene").limit(size)
    fill = _number(fill, F.desc("n_celltypes"), F.desc("weight"), F.asc("gene"))
    gap = F.lit(size) - kept.agg(F.count(F.lit(1))).scalar()
    fill = fill.withColumn("_gap", gap).filter(F.col("_i") <= F.col("_gap")).drop("_i", "_gap").withColumn("source", F.lit("fill"))
    return kept.unionByName(fill)
