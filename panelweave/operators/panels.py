"""The ranked panel table: building, selecting, filling, combining, reporting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of where a panel gene came from.
FORCE, RF, DIMRED, OVERLAP = "force_include", "rf_deg", "dimred", "overlap→rf_deg"
REPLACEMENT = "dimred_replacement"
GAP_CELLTYPE, GAP_GLOBAL, GAP_DEG = "gap_fill_celltype", "gap_fill_global", "gap_fill_deg"

PANEL_TYPES = {
    "rank": "bigint", "selection_score": "double", "selection_strategy": "string", "analysis_type": "string",
    "celltype": "string", "mean_expression": "double", "selected_initial": "boolean", "passed_xenium": "boolean",
    "final_selection": "boolean", "xenium_failure_reason": "string", "replaced_by": "string",
    "replaces_gene": "string", "replacement_reason": "string",
}


def new_panel(genes: DataFrame, strategy: str, analysis_type: str = "global") -> DataFrame:
    """Give a gene table all panel columns, one row per gene; the best score keeps a repeated gene."""
    have = set(genes.columns)
    given = {"selection_strategy": F.lit(strategy), "analysis_type": F.lit(analysis_type),
             "selected_initial": F.lit(False), "final_selection": F.lit(False)}
    cols = []
    for c, t in PANEL_TYPES.items():
        src = F.col(c) if c in have else given.get(c, F.lit(None))
        cols.append(src.cast(t).alias(c))
    extra = [c for c in genes.columns if c not in PANEL_TYPES and c != "gene"]
    full = genes.select("gene", *cols, *extra)
    body = [c for c in full.columns if c not in ("gene", "selection_score")]
    best = F.max_by(F.struct("selection_score", *body), F.coalesce("selection_score", F.lit(float("-inf")))).alias("r")
    return full.groupBy("gene").agg(best).select("gene", "r.*")


def add_genes(panel: DataFrame, more: DataFrame) -> DataFrame:
    """Append rows; a gene already present keeps the row with the better score."""
    both = panel.unionByName(more, allowMissingColumns=True)
    body = [c for c in both.columns if c != "gene"]
    best = F.max_by(F.struct(*body), F.coalesce("selection_score", F.lit(float("-inf")))).alias("r")
    return both.groupBy("gene").agg(best).select("gene", "r.*")


def mark_selected(panel: DataFrame, genes: DataFrame, stage: str = "initial") -> DataFrame:
    """Set the 'initial' or 'final' flag of the listed genes."""
    flag = {"initial": "selected_initial", "final": "final_selection"}[stage]
    hit = genes.select("gene").distinct().withColumn("_hit", F.lit(True))
    j = panel.join(hit, "gene", "left")
    return j.withColumn(flag, F.coalesce(F.col("_hit") | F.col(flag), F.col("_hit"), F.col(flag), F.lit(False))).drop("_hit")


def record_replacements(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(removed, replacement, reason)`` noted on both rows."""
    out = pairs.groupBy(F.col("removed").alias("gene")).agg(F.min("replacement").alias("_by"))
    into = pairs.groupBy(F.col("replacement").alias("gene")).agg(F.min(F.struct("removed", "reason")).alias("_of"))
    j = panel.join(out, "gene", "left").join(into, "gene", "left")
    return j.withColumns({
        "replaced_by": F.coalesce("_by", "replaced_by"),
        "replaces_gene": F.coalesce("_of.removed", "replaces_gene"),
        "replacement_reason": F.coalesce("_of.reason", "replacement_reason"),
    }).drop("_by", "_of")


def set_mean_expression(panel: DataFrame, means: DataFrame) -> DataFrame:
    """Mean of the gene in its own cell type, else over all cells; ``means(celltype, gene, mean_expr)``.

    Rows of ``means`` with celltype 'global' hold the overall mean.
    """
    own = means.select(F.col("celltype").alias("_c"), F.col("gene").alias("_g"), F.col("mean_expr").alias("_m"))
    overall = means.filter(F.col("celltype") == "global").select("gene", F.col("mean_expr").alias("_o"))
    j = panel.join(own, (F.col("gene") == F.col("_g")) & (F.col("celltype") == F.col("_c")), "left").join(overall, "gene", "left")
    return j.withColumn("mean_expression", F.coalesce("_m", "_o", "mean_expression")).drop("_c", "_g", "_m", "_o")


def untested_or_passed() -> Column:
    """A gene that was never tested counts as passing."""
    return F.coalesce(F.col("passed_xenium"), F.lit(True))


def stage_genes(panel: DataFrame, stage: str) -> DataFrame:
    """Genes at 'initial', 'post_xenium' (initial and not failed) or 'final'."""
    cond = {
        "initial": F.col("selected_initial"),
        "post_xenium": F.col("selected_initial") & untested_or_passed(),
        "final": F.col("final_selection"),
    }[stage]
    return panel.filter(cond)


def sort_panel(panel: DataFrame) -> DataFrame:
    return panel.orderBy(F.col("rank").asc_nulls_last(), "gene")


def panel_stats(panel: DataFrame) -> DataFrame:
    """One row of counts per stage and filter."""
    p = F.col("passed_xenium")
    return panel.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("selected_initial").alias("initial"),
        F.count_if(F.col("selected_initial") & untested_or_passed()).alias("post_xenium"),
        F.count_if("final_selection").alias("final"), F.count_if(p).alias("passed"), F.count_if(~p).alias("failed"),
        F.count_if(p.isNull()).alias("untested"), F.count_if(F.col("replaces_gene").isNotNull()).alias("replacements"),
    )


def single_gap_fill(panel: DataFrame, size: int) -> DataFrame:
    """Fill up to ``size`` from unselected passing genes by score, then make the selection final."""
    ok = untested_or_passed()
    have = panel.filter(F.col("selected_initial") & ok)
    gap = F.lit(size) - have.agg(F.count(F.lit(1))).scalar()
    spare = panel.filter(~F.col("selected_initial") & ok).orderBy(F.desc("selection_score"), "gene").limit(size)
    # ``spare`` is at most the panel size, so numbering it in one place is bounded.
    spare = spare.select("gene", F.row_number().over(Window.orderBy(F.desc("selection_score"), "gene")).alias("_i"))
    fill = spare.withColumn("_gap", gap).filter(F.col("_i") <= F.col("_gap")).select("gene", F.lit(True).alias("_fill"))
    j = panel.join(fill, "gene", "left")
    filled = F.coalesce("_fill", F.lit(False))
    return j.withColumn("final_selection", (F.col("selected_initial") & ok) | filled).withColumn(
        "selected_initial", F.col("selected_initial") | filled).drop("_fill")


def ranked_list(panel: DataFrame, filtered: bool = True) -> DataFrame:
    """Rows for the ranked-list file: ``in_panel`` first, then by rank; failed genes left out."""
    p = panel.filter(untested_or_passed()) if filtered else panel
    rest = [c for c in p.columns if c != "gene"]
    p = p.select("gene", F.coalesce("final_selection", F.lit(False)).alias("in_panel"), *rest)
    return p.orderBy(F.desc("in_panel"), F.col("rank").asc_nulls_last(), "gene")


def selection_summary(panel: DataFrame, strategy: str, target: int, filtered: bool = True,
                      patterns: Sequence[str] = (), use_default: bool = True) -> DataFrame:
    """One row with a JSON text of counts per stage and the filters applied."""
    init = F.count_if("selected_initial")
    post = F.count_if(F.col("selected_initial") & untested_or_passed())
    failed = F.count_if(F.coalesce(~F.col("passed_xenium"), F.lit(False)))
    s = panel.agg(F.to_json(F.struct(
        F.lit(strategy).alias("strategy"), F.lit(target).alias("target_size"), init.alias("initial_selected"),
        (post if filtered else init).alias("after_xenium"), F.count_if("final_selection").alias("final_selected"),
        (failed if filtered else F.lit(0)).alias("xenium_failed"),
        F.count_if(F.col("replaces_gene").isNotNull()).alias("replacements"),
        F.struct(F.lit(filtered).alias("xenium"), F.array(*[F.lit(p) for p in patterns]).cast("array<string>").alias("blacklist_custom_patterns"),
                 F.lit(use_default).alias("blacklist_use_default"), F.lit(bool(patterns) or use_default).alias("blacklist_any_active")).alias("filters_applied"),
    )).alias("summary"))
    return s


# --- combination of two component lists ------------------------------------------------------

def force_include(genes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Wanted genes that exist in the data; as many as the panel or more is an error."""
    out = wanted.select("gene").distinct().join(genes.select("gene"), "gene", "left_semi")
    if out.limit(size).count() >= size:
        raise ValueError("force-included genes fill or exceed the panel")
    return out


def combination_targets(size: int, n_forced: int, rf_share: float = 0.25) -> tuple[int, int]:
    """Genes to take from the forest and from the factors."""
    left = size - n_forced
    if left <= 0:
        raise ValueError("force-included genes fill or exceed the panel")
    n_rf = int(left * rf_share)
    return n_rf, left - n_rf


def combine_rf_dimred(rf: DataFrame, dimred: DataFrame, n_rf: int, n_dimred: int, forced: DataFrame | None = None,
                      replace_lost: bool = False) -> DataFrame:
    """Top genes of both lists; a gene in both is credited to the forest.

    ``rf`` and ``dimred`` have (gene, rank, selection_score, celltype).  With
    ``replace_lost`` the places lost to overlaps go to the next factor genes.
    """
    cols = ["gene", "rank", "selection_score", "celltype"]
    rf, dimred = rf.select(*cols), dimred.select(*cols)
    if forced is not None:
        rf, dimred = rf.join(forced, "gene", "left_anti"), dimred.join(forced, "gene", "left_anti")
    top_rf = rf.orderBy("rank", "gene").limit(n_rf)
    top_dim = dimred.orderBy("rank", "gene").limit(n_dimred)
    both = top_dim.select("gene").withColumn("_both", F.lit(True))
    out = top_rf.join(both, "gene", "left").withColumn("gene_source", F.when(F.col("_both"), OVERLAP).otherwise(RF)).drop("_both")
    out = out.unionByName(top_dim.join(top_rf.select("gene"), "gene", "left_anti").withColumn("gene_source", F.lit(DIMRED)))
    if forced is not None:
        nothing = {"rank": F.lit(None).cast("bigint"), "selection_score": F.lit(None).cast("double"), "celltype": F.lit("global")}
        out = out.unionByName(forced.select("gene").withColumns(nothing).withColumn("gene_source", F.lit(FORCE)))
    if replace_lost:
        lost = top_rf.join(top_dim, "gene", "left_semi").agg(F.count(F.lit(1))).scalar()
        out = out.unionByName(_fill(out, dimred, lost, n_dimred).select(*cols).withColumn("gene_source", F.lit(REPLACEMENT)))
    return out


def _fill(current: DataFrame, candidates: DataFrame, gap: Column, most: int) -> DataFrame:
    """First ``gap`` (at most ``most``) candidates by rank that are not in ``current``."""
    c = candidates.join(current.select("gene"), "gene", "left_anti").orderBy("rank", "gene").limit(most)
    i = F.row_number().over(Window.orderBy("rank", "gene"))
    return c.withColumn("_i", i).withColumn("_gap", gap).filter(F.col("_i") <= F.col("_gap")).drop("_i", "_gap")


def gap_fill(current: DataFrame, tiers: Sequence[tuple[DataFrame, str]], size: int) -> DataFrame:
    """Add genes tier by tier, each by rank, until ``size`` is reached.

    ``tiers`` holds (candidates(gene, rank), label) in priority order.  A gene
    offered by several tiers counts for the first.
    """
    if not tiers:
        return current
    offers = None
    for t, (cand, label) in enumerate(tiers):
        o = cand.select(F.lit(t).alias("tier"), F.col("rank").cast("long").alias("_rank"), "gene", F.lit(label).alias("label"))
        offers = o if offers is None else offers.unionByName(o)
    offers = offers.join(current.select("gene"), "gene", "left_anti")
    first = offers.groupBy("gene").agg(F.min(F.struct("tier", "_rank", "label")).alias("o")).select("gene", "o.*")
    best = first.orderBy("tier", "_rank", "gene").limit(size)
    gap = F.lit(size) - current.agg(F.count(F.lit(1))).scalar()
    i = F.row_number().over(Window.orderBy("tier", "_rank", "gene"))
    add = best.withColumn("_i", i).withColumn("_gap", gap).filter(F.col("_i") <= F.col("_gap"))
    have = set(current.columns)
    add = add.select("gene", F.col("label").alias("gene_source"), *([F.lit("global").alias("celltype")] if "celltype" in have else []))
    return current.unionByName(add, allowMissingColumns=True)


def gap_fill_tiers(analysis_type: str, celltype_pool: DataFrame | None, global_pool: DataFrame | None, deg_pool: DataFrame | None):
    """Tier order: per_celltype uses the cell-type pool then the forest, global the global pool then the forest."""
    if analysis_type == "per_celltype":
        first = (celltype_pool, GAP_CELLTYPE)
    elif analysis_type == "global":
        first = (global_pool, GAP_GLOBAL)
    else:
        raise ValueError(f"unknown analysis type {analysis_type}")
    return [t for t in (first, (deg_pool, GAP_DEG)) if t[0] is not None]


def gene_details(final: DataFrame, loadings: DataFrame | None = None, consensus: DataFrame | None = None,
                 deg: DataFrame | None = None) -> DataFrame:
    """Metadata of the final genes from whichever strategy tables are given."""
    out = final.select("gene").distinct()
    if loadings is not None:
        best = F.max(F.struct(F.abs("loading").alias("a"), (-F.col("factor")).alias("f"), "loading")).alias("x")
        w = loadings.groupBy("gene").agg(best).select(
            "gene", (-F.col("x.f")).alias("best_component"), F.col("x.loading").alias("best_weight"))
        out = out.join(w, "gene", "left")
    if consensus is not None:
        out = out.join(consensus.select("gene", "final_score", "avg_importance", "max_importance", "avg_f1_score"), "gene", "left")
    if deg is not None:
        best = F.min(F.struct("pvals_adj", "group", "logfoldchanges", "scores")).alias("x")
        d = deg.groupBy("gene").agg(best).select(
            "gene", F.col("x.group").alias("best_group"), F.col("x.logfoldchanges").alias("logfoldchange"),
            F.col("x.pvals_adj").alias("pval_adj"), F.col("x.scores").alias("deg_score"))
        out = out.join(d, "gene", "left")
    return out
