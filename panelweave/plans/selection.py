"""Selection strategies: from a matrix (or ready score tables) to a ranked panel."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import md5_key
from panelweave.functions.ranks import row_index
from panelweave.operators import factor as fa
from panelweave.operators import filters as fl
from panelweave.operators import loadings as ld
from panelweave.operators import markers as mk
from panelweave.operators import panels as pn
from panelweave.operators import quality as q
from panelweave.operators.sampling import bootstrap_draws, fold_of_cell
from panelweave.schema import ExprData
from panelweave.session import pin

# Defaults of the strategies.
PANEL_SIZE = 100
MIN_CELLS = 10
FOREST_SEEDS = (42, 43, 44, 45, 46)
FOREST_FOLDS = 5
FOREST_TREES = 100
FOREST_DEPTH = 3
OVERSAMPLE = 1.5
SINGLE = ("deg_only", "rf_simple", "rf_deg", "hvg", "random", "dimred_only")
COMBINED = ("rf_nmf", "rf_pca")


def restrict_celltypes(data: ExprData, min_cells: int = MIN_CELLS, group: str = "celltype") -> ExprData:
    """Drop cells of types with fewer than ``min_cells`` cells."""
    ok = fl.filter_celltypes(data.cells, min_cells, group).filter("valid")
    cells = data.cells.join(ok.select(group), group, "left_semi")
    return ExprData(data.expr.join(cells.select("cell_id"), "cell_id", "left_semi"), cells, data.genes)


def select_deg(deg: DataFrame, size: int, n_groups: int, max_pval: float = 0.05) -> DataFrame:
    """Best significant genes of each group, filled from the other significant genes and then all.

    ``deg(group, gene, scores, pvals_adj, ...)``.  A gene named by several
    groups counts once, for the group where it scores best.  Every significant
    gene stays in the table as a replacement candidate.
    """
    per = max(1, size // max(n_groups, 1))
    sig = F.col("pvals_adj") <= max_pval
    w = Window.partitionBy("group").orderBy(F.desc("scores"), "gene")
    top = deg.filter(sig).withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= per)
    best = F.max(F.struct("scores", "group")).alias("x")
    first = top.groupBy("gene").agg(best).select("gene", F.lit(0).alias("tier"), F.col("x.group").alias("celltype"), F.col("x.scores").alias("selection_score"))
    offers = deg.join(first.select("gene"), "gene", "left_anti").groupBy("gene").agg(
        F.min(F.struct(F.when(sig, 1).otherwise(2).alias("tier"), "group", (-F.col("scores")).alias("m"))).alias("o"), best)
    offers = offers.select("gene", F.col("o.tier").alias("tier"), F.col("x.group").alias("celltype"), F.col("x.scores").alias("selection_score"),
                           F.col("o.group").alias("_g"), F.col("o.m").alias("_m"))
    gap = F.lit(size) - first.agg(F.count(F.lit(1))).scalar()
    # At most a panel of fill candidates is numbered.
    fill = offers.orderBy("tier", "_g", "_m", "gene").limit(size)
    fill = fill.withColumn("_i", F.row_number().over(Window.orderBy("tier", "_g", "_m", "gene"))).withColumn("_gap", gap).filter(F.col("_i") <= F.col("_gap"))
    chosen = first.unionByName(fill.select(*first.columns)).withColumn("selected_initial", F.lit(True))
    rest = offers.filter("tier = 1").select(*first.columns).join(chosen.select("gene"), "gene", "left_anti").withColumn("selected_initial", F.lit(False))
    return chosen.unionByName(rest)


def with_rank(panel: DataFrame, score: str = "selection_score") -> DataFrame:
    """Rank a gene table by score, best first, ties by gene, genes without a score last."""
    return row_index(panel, [], F.struct(F.col(score).isNull().alias("n"), (-F.col(score)).alias("s"), F.col("gene").alias("g")), "rank")


def _steady_mean(c: Column) -> Column:
    """Mean of the few values of a group, added up by size: equal values give equal means in every order of the rows."""
    return F.aggregate(F.array_sort(F.collect_list(c.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.count(c), F.lit(0))


def forest_gene_summary(scores: DataFrame) -> DataFrame:
    """Consensus over all fits: ``scores(gene, fold, importance, f1_score)``."""
    imp, f1 = F.col("importance"), F.col("f1_score")
    return scores.groupBy("gene").agg(
        _steady_mean(imp).alias("avg_importance"), F.max(imp).alias("max_importance"), _steady_mean(f1).alias("avg_f1_score"), _steady_mean(imp * f1).alias("final_score"))


def forest_scores(data: ExprData, candidates: DataFrame, group: str = "celltype", seeds: Sequence[int] = FOREST_SEEDS, folds: int = FOREST_FOLDS,
                  trees: int = FOREST_TREES, depth: int = FOREST_DEPTH) -> DataFrame:
    """Importances and macro F1 of balanced forests, one fit per seed and stratified fold."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    from panelweave.operators.agreement import classification_summary
    from panelweave.operators.neighbors import vectors

    spark = data.expr.sparkSession
    genes = sorted(r.gene for r in candidates.select("gene").distinct().join(data.genes.select("gene"), "gene", "left_semi").collect())
    if not genes:
        raise ValueError("no candidate genes in the data")
    v = vectors(data.expr, data.cells, candidates.join(data.genes.select("gene"), "gene", "left_semi"))
    v = v.select("cell_id", array_to_vector("vec").alias("x")).join(data.cells.select("cell_id", group), "cell_id")
    for i, seed in enumerate(seeds):
        v = v.join(fold_of_cell(data.cells, folds, seed, group).select("cell_id", F.col("fold").alias(f"fold{i}")), "cell_id")
    # The matrix is kept once, on disk: memory is for the binned points that a fit keeps.
    v = StringIndexer(inputCol=group, outputCol="y", stringOrderType="alphabetAsc").fit(data.cells).transform(v).persist(StorageLevel.DISK_ONLY)
    rows = []
    for i, seed in enumerate(seeds):
        f = v.select("x", "y", F.col(f"fold{i}").alias("fold"))
        for fold in range(folds):
            train, test = f.filter(F.col("fold") != fold), f.filter(F.col("fold") == fold)
            sizes = train.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
            k, n = sizes.agg(F.count(F.lit(1)), F.sum("_n")).first()
            weighted = train.join(sizes, "y").withColumn("wt", F.lit(float(n)) / (F.lit(float(k)) * F.col("_n")))
            m = RandomForestClassifier(featuresCol="x", labelCol="y", predictionCol="p", weightCol="wt", numTrees=trees, maxDepth=depth, seed=seed + fold).fit(weighted)
            f1 = float(classification_summary(m.transform(test), "y", "p").first()["macro_f1"])
            imp = m.featureImportances.toArray()
            rows += [(g, f"seed{seed}_fold{fold}", float(imp[i]), f1) for i, g in enumerate(genes)]
    v.unpersist()
    # Candidates x fits rows, a gene-sized table.
    return spark.createDataFrame(rows, "gene string, fold string, importance double, f1_score double")


def select_rf(scores: DataFrame, size: int) -> DataFrame:
    """Rank by the F1-weighted importance; first ``size`` selected."""
    p = forest_gene_summary(scores).withColumn("selection_score", F.col("final_score"))
    return with_rank(p).withColumn("selected_initial", F.col("rank") <= size)


def select_hvg(flags: DataFrame, size: int) -> DataFrame:
    """Most variable genes by dispersions_norm, else variances_norm, else variances."""
    score = next((c for c in ("dispersions_norm", "variances_norm", "variances") if c in flags.columns), None)
    if score is None:
        raise ValueError("no variability score")
    s = F.when(F.isnan(score), None).otherwise(F.col(score))
    p = flags.select("gene", s.alias("selection_score")).filter(F.col("selection_score").isNotNull())
    best = p.orderBy(F.desc("selection_score"), "gene").limit(size)
    # At most ``size`` rows are numbered.
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("selection_score"), "gene")).cast("long"))
    return best.withColumn("selected_initial", F.lit(True))


def _enough(df: DataFrame, genes: DataFrame, n: int) -> DataFrame:
    have = genes.select("gene").distinct().agg(F.count(F.lit(1))).scalar()
    bad = F.when(have < n, F.raise_error(F.lit(f"fewer than {n} genes")).cast("boolean")).otherwise(F.lit(True))
    return df.filter(bad)


def select_random(genes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n distinct genes in the order of a seeded hash; too few genes is an error."""
    g = _enough(genes.select("gene").distinct(), genes, n)
    best = g.withColumn("_h", md5_key(F.col("gene"), seed)).orderBy("_h", "gene").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("_h", "gene")).cast("long")).drop("_h").withColumn("selected_initial", F.lit(True))


def select_random_bootstrap(genes: DataFrame, n: int, draws: int = 10, seed: int = 42) -> DataFrame:
    """The n genes drawn most often over repeated random draws."""
    f = _enough(bootstrap_draws(genes, n, draws, seed), genes, n).groupBy("gene").agg(F.count(F.lit(1)).alias("frequency"))
    best = f.orderBy(F.desc("frequency"), "gene").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("frequency"), "gene")).cast("long"))


def select_dimred(loadings: DataFrame, means: DataFrame | None, size: int, k: int, per_celltype: bool = True, pool: int = ld.POOL_SIZE,
                  bounds: tuple[float, float] | None = None) -> DataFrame:
    """Panel from factor loadings: pool, expression bounds, duplicates, balanced selection.

    All pool genes are returned; ``selected_initial`` marks the panel.
    """
    bounds = bounds or (fl.MIN_EXPRESSION, fl.MAX_EXPRESSION)
    if per_celltype:
        raw = ld.factor_pool(loadings, ld.pool_size_per_factor(pool, k))
        raw = pin(raw if means is None else ld.pool_expression_filter(raw, means, True, *bounds))
        res = pin(ld.resolve_across_celltypes(ld.resolve_duplicates(raw, loadings, k), raw))
        n_ct = loadings.select("scope").distinct().count()
        chosen = ld.select_from_pool_per_celltype(res, size, k, n_ct).select("gene", F.lit(True).alias("_sel"))
        order = F.struct((-F.col("n_celltypes")).alias("n"), (-F.col("weight")).alias("w"), F.col("gene").alias("g"))
    else:
        raw = ld.factor_pool(loadings, pool)
        raw = raw if means is None else ld.pool_expression_filter(raw, means, False, *bounds)
        res = pin(ld.assign_primary_factor(raw).withColumn("celltype", F.lit("global")))
        chosen = ld.select_from_pool_global(res, size, k).select("gene", F.lit(True).alias("_sel"))
        order = F.struct((-F.col("weight")).alias("w"), F.col("gene").alias("g"))
    p = res.join(chosen, "gene", "left").withColumn("selected_initial", F.coalesce("_sel", F.lit(False))).drop("_sel", "scope", "source")
    return row_index(p, [], order, "rank").select(
        "*", F.col("weight").alias("selection_score"), F.col("factor").cast("string").alias("component"))


def factor_loadings(data: ExprData, reduction: str = "nmf", k: int = 5, per_celltype: bool = True, iters: int = 100, seed: int = 42, group: str = "celltype") -> DataFrame:
    """loadings(scope, factor, gene, loading) of a matrix by NMF (counts, KL) or PCA."""
    p = fa.pack(data.expr, data.cells, data.genes, group if per_celltype else None, min_cells=MIN_CELLS if per_celltype else 1)
    if reduction == "nmf":
        return fa.nmf(p, k, iters, "kullback-leibler", seed).loadings(data.expr.sparkSession).drop("run")
    if reduction == "pca":
        return pin(fa.pca(p, k).select("scope", "factor", "gene", "loading"))
    raise ValueError(f"unknown reduction {reduction}")


def select_combination(rf: DataFrame, dimred: DataFrame, size: int, forced: DataFrame | None = None, n_forced: int = 0, rf_share: float = 0.25,
                       analysis_type: str = "per_celltype", global_pool: DataFrame | None = None) -> DataFrame:
    """Forest and factor lists combined, then filled to ``size``.

    ``rf`` and ``dimred``: (gene, rank, selection_score, celltype), already
    filtered; genes that did not pass are expected to be gone.
    """
    n_rf, n_dim = pn.combination_targets(size, n_forced, rf_share)
    c = pin(pn.combine_rf_dimred(rf, dimred, n_rf, n_dim, forced))
    return pn.gap_fill(c, pn.gap_fill_tiers(analysis_type, dimred, global_pool, rf), size)


def component_cache_usable(cached_flags: dict, wanted_flags: dict) -> bool:
    """A stored component list may stand in only when it was filtered the same way."""
    keys = ("expression_filter", "blacklist_patterns", "use_default_blacklist")
    return all(cached_flags.get(x) == wanted_flags.get(x) for x in keys)


@dataclass(frozen=True)
class SelectionConfig:
    strategy: str = "deg_only"
    size: int = PANEL_SIZE
    analysis_type: str = "per_celltype"
    reduction: str = "nmf"
    k: int = 5
    pool: int = ld.POOL_SIZE
    rf_share: float = 0.25
    expression_bounds: tuple[float, float] | None = (fl.MIN_EXPRESSION, fl.MAX_EXPRESSION)
    blacklist: Sequence[str] = ()
    use_default_blacklist: bool = True
    force_include: Sequence[str] = ()
    max_pval: float = 0.05
    seed: int = 42
    min_cells: int = MIN_CELLS
    factor_iters: int = 100
    forest: dict = field(default_factory=dict)


def select(data: ExprData, cfg: SelectionConfig) -> DataFrame:
    """Blacklist, strategy, expression bounds, gap fill: a finished panel table (the fold of ``selection_log.select_logged``)."""
    from panelweave.plans.selection_log import select_logged

    return select_logged(data, cfg).panel()
