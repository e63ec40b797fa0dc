"""Selection as a log of decisions.

Every stage of a strategy appends rows saying what it decided about a gene.  A
row's ``effect`` is 'offer' (a candidate), 'in' (chosen), 'out' (refused) or
'keep' (looked at, nothing changed).  The panel and every gene's provenance are
folds over the log: a gene is in the panel when it was last chosen after it was
last refused.  The log is gene-sized; the matrix is only read by the stages that
score genes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.operators import filters as fl
from panelweave.operators import loadings as ld
from panelweave.operators import markers as mk
from panelweave.operators import panels as pn
from panelweave.operators import quality as q
from panelweave.plans import selection as se
from panelweave.schema import ExprData
from panelweave.session import pin

#: The order in which a log is read.
STAGES = ("blacklist", "force_include", "forest", "forest_bounds", "pool", "pool_bounds", "strategy", "bounds", "combine", "gap_fill")


@dataclass(frozen=True)
class Learned:
    """Ready score tables that take the place of a test or fit.

    ``deg(group, gene, scores, pvals_adj)``, ``forest(gene, fold, importance, f1_score)`` and
    ``loadings(scope, factor, gene, loading)``.  Genes the blacklist removed are ignored.
    """

    deg: DataFrame | None = None
    forest: DataFrame | None = None
    loadings: DataFrame | None = None


@dataclass
class SelectionLog:
    strategy: str
    analysis_type: str
    parts: list[DataFrame] = field(default_factory=list)

    def add(self, stage: str, rows: DataFrame, decision: Column, effect: Column, reason: Column | None = None) -> None:
        """One decision per row of ``rows(gene, ...)``; celltype, rank and selection_score go along where present."""
        given = {c: F.col(c) if c in rows.columns else F.lit(None) for c in ("celltype", "rank", "selection_score")}
        self.parts.append(rows.select(
            F.lit(STAGES.index(stage)).alias("step"), F.lit(stage).alias("stage"), "gene", given["celltype"].cast("string").alias("celltype"),
            decision.cast("string").alias("decision"), effect.alias("effect"), (F.lit(None) if reason is None else reason).cast("string").alias("reason"),
            given["rank"].cast("bigint").alias("rank"), given["selection_score"].cast("double").alias("selection_score")))

    def close(self) -> SelectionLog:
        """Write the log once; every fold reads that table."""
        whole = self.parts[0]
        for p in self.parts[1:]:
            whole = whole.unionByName(p)
        self.parts = [pin(whole)]
        return self

    @property
    def events(self) -> DataFrame:
        return self.parts[0]

    def provenance(self) -> DataFrame:
        """One row per gene: its whole path, where its place came from, and whether it is in the panel."""
        last = lambda effect: F.max(F.when(F.col("effect") == effect, F.col("step")))
        said = F.concat_ws(":", "stage", "decision")
        known = F.when(F.col("effect").isin("in", "offer"), F.col("step"))
        steps = F.array_sort(F.collect_list(F.struct("step", said.alias("said"))))
        out = self.events.groupBy("gene").agg(
            F.array_join(F.transform(steps, lambda s: s["said"]), " > ").alias("path"), last("in").alias("_in"), last("out").alias("_out"),
            F.max_by("decision", F.when(F.col("effect") == "in", F.col("step"))).alias("_what"), F.max_by("stage", F.when(F.col("effect") == "in", F.col("step"))).alias("_where"),
            F.max_by(F.struct("celltype", "rank", "selection_score"), known).alias("_k"),
            F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("step"))).alias("failure_reason"))
        final = F.coalesce(F.col("_in") > F.coalesce("_out", F.lit(-1)), F.lit(False))
        # The combination and the fill name their sources; elsewhere the stage is the source.
        source = F.when(final, F.when(F.col("_where").isin("combine", "gap_fill"), F.col("_what")).otherwise(F.col("_where")))
        return out.select("gene", "path", final.alias("final_selection"), source.alias("gene_source"), F.col("_k.celltype").alias("celltype"), F.col("_k.rank").alias("rank"),
                          F.col("_k.selection_score").alias("selection_score"), "failure_reason")

    def panel(self) -> DataFrame:
        """The panel table: genes that were offered or chosen, with the flags of the log."""
        was = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
        stage, effect = F.col("stage"), F.col("effect")
        flags = self.events.groupBy("gene").agg(
            was((effect == "in") & (stage != "gap_fill")).alias("_initial"), was((effect == "in") & (stage == "gap_fill")).alias("_filled"), was(effect.isin("in", "offer")).alias("_seen"),
            F.max_by(effect != "out", F.when(stage == "bounds", F.col("step"))).alias("passed_xenium"), F.max_by("reason", F.when(stage == "bounds", F.col("step"))).alias("xenium_failure_reason"))
        p = self.provenance().join(flags.filter("_seen").drop("_seen"), "gene").withColumn("selected_initial", F.col("_initial") | F.col("_filled"))
        p = p.drop("_initial", "_filled", "path", "failure_reason")
        return pn.new_panel(p, self.strategy, self.analysis_type)

    def stage_counts(self) -> DataFrame:
        """Rows of every stage, decision and effect."""
        return self.events.groupBy("step", "stage", "decision", "effect").agg(F.count(F.lit(1)).alias("n"))


def _offer(selected: Column) -> tuple[Column, Column]:
    return F.when(selected, "selected").otherwise("candidate"), F.when(selected, "in").otherwise("offer")


def _bounds(log: SelectionLog, stage: str, judged: DataFrame) -> None:
    ok = F.col("passed_xenium")
    log.add(stage, judged.select("gene", "passed_xenium", "xenium_failure_reason"), F.when(ok, "passed").otherwise("failed"), F.when(ok, "keep").otherwise("out"), F.col("xenium_failure_reason"))


def select_logged(data: ExprData, cfg: se.SelectionConfig, learned: Learned = Learned()) -> SelectionLog:
    """Blacklist, strategy, expression bounds and gap fill, every decision logged.

    ``data.expr`` has log values in ``value`` and, for NMF, counts in ``counts`` when that column exists.
    """
    if cfg.strategy not in se.SINGLE + se.COMBINED:
        raise ValueError(f"unknown strategy {cfg.strategy}")
    if cfg.analysis_type not in ("per_celltype", "global"):
        raise ValueError(f"unknown analysis type {cfg.analysis_type}")
    log = SelectionLog(cfg.strategy, cfg.analysis_type)
    marked = pin(fl.blacklist_filter(data.genes.select("gene").distinct(), cfg.blacklist, cfg.use_default_blacklist, cfg.force_include))
    removed = F.col("blacklist_status") == "removed"
    log.add("blacklist", marked, F.col("blacklist_status"), F.when(removed, "out").otherwise("keep"))
    allowed = marked.filter(~removed)
    data = se.restrict_celltypes(q.keep_genes(data, allowed), cfg.min_cells)
    data = ExprData(pin(data.expr), pin(data.cells), pin(data.genes))
    means = pin(q.mean_expr_by_celltype(data))
    per_ct = cfg.analysis_type == "per_celltype"
    n_groups = data.cells.select("celltype").distinct().count()
    known = lambda df: df.join(data.genes.select("gene"), "gene", "left_semi")

    def deg() -> DataFrame:
        return pin(known(learned.deg) if learned.deg is not None else mk.rank_genes_wilcoxon(data))

    def forest(use_deg: bool, size: int) -> DataFrame:
        cand = mk.deg_candidates(deg(), size, n_groups).select("gene") if use_deg else data.genes.select("gene")
        scores = se.forest_scores(data, cand, **cfg.forest) if learned.forest is None else known(learned.forest).join(cand, "gene", "left_semi")
        return pin(se.select_rf(scores, size).withColumn("celltype", F.lit("global")))

    def factors(size: int, reduction: str) -> DataFrame:
        counts = "counts" in data.expr.columns and reduction == "nmf"
        source = ExprData(data.expr.withColumn("value", F.col("counts").cast("double")), data.cells, data.genes) if counts else data
        l = pin(known(learned.loadings) if learned.loadings is not None else se.factor_loadings(source, reduction, cfg.k, per_ct, cfg.factor_iters, cfg.seed))
        bounds = means if cfg.expression_bounds else None
        pool = pin(ld.factor_pool(l, ld.pool_size_per_factor(cfg.pool, cfg.k) if per_ct else cfg.pool))
        log.add("pool", pool.select("gene").distinct(), F.lit("pooled"), F.lit("offer"))
        if bounds is not None:
            lo, hi = cfg.expression_bounds
            left = ld.pool_expression_filter(pool, bounds, per_ct, lo, hi).select("gene").distinct().withColumn("_ok", F.lit(True))
            j = pool.select("gene").distinct().join(left, "gene", "left")
            log.add("pool_bounds", j, F.when(F.col("_ok"), "passed").otherwise("failed"), F.when(F.col("_ok"), "keep").otherwise("out"), F.when(F.col("_ok").isNull(), "out_of_range_in_pool"))
        return pin(se.select_dimred(l, bounds, size, cfg.k, per_ct, cfg.pool, cfg.expression_bounds))

    s = cfg.strategy
    if s in se.COMBINED:
        return _combined(log, data, cfg, means, forest, factors)
    if s == "deg_only":
        table = pin(se.with_rank(pin(se.select_deg(deg(), cfg.size, n_groups, cfg.max_pval))))
    elif s in ("rf_simple", "rf_deg"):
        table = forest(s == "rf_deg", cfg.size)
    elif s == "hvg":
        table = pin(se.select_hvg(q.hvg(data, "seurat", cfg.size), cfg.size).withColumn("celltype", F.lit("global")))
    elif s == "random":
        table = pin(se.select_random(data.genes, cfg.size, cfg.seed).withColumns({"celltype": F.lit("global"), "selection_score": F.lit(None).cast("double")}))
    else:
        table = factors(cfg.size, cfg.reduction)
    log.add("strategy", table, *_offer(F.col("selected_initial")))
    # Factor pools were held against the bounds already.
    if cfg.expression_bounds and s != "dimred_only":
        table = pin(fl.expression_filter(table, means, *cfg.expression_bounds, celltype_aware=s == "deg_only"))
        _bounds(log, "bounds", table)
    else:
        table = table.withColumn("passed_xenium", F.lit(None).cast("boolean"))
    filled = pn.single_gap_fill(table, cfg.size).filter("final_selection").join(table.filter("selected_initial").select("gene"), "gene", "left_anti")
    log.add("gap_fill", pin(filled), F.lit("filled"), F.lit("in"))
    return log.close()


def _combined(log: SelectionLog, data: ExprData, cfg: se.SelectionConfig, means: DataFrame, forest, factors) -> SelectionLog:
    wanted = data.expr.sparkSession.createDataFrame([(g,) for g in cfg.force_include], "gene string")
    forced = pin(pn.force_include(data.genes, wanted, cfg.size))
    log.add("force_include", forced, F.lit("forced"), F.lit("in"))
    n_forced = forced.count()
    n_rf, n_dim = pn.combination_targets(cfg.size, n_forced, cfg.rf_share)
    rf = forest(True, int(n_rf * se.OVERSAMPLE))
    log.add("forest", rf, *(F.lit("candidate"), F.lit("offer")))
    if cfg.expression_bounds:
        judged = pin(fl.expression_filter(rf, means, *cfg.expression_bounds, celltype_aware=False))
        _bounds(log, "forest_bounds", judged)
        rf = judged.filter("passed_xenium")
    dim = factors(int(n_dim * se.OVERSAMPLE), cfg.strategy.removeprefix("rf_"))
    log.add("strategy", dim, F.lit("candidate"), F.lit("offer"))
    combined = pin(pn.combine_rf_dimred(rf, dim, n_rf, n_dim, forced))
    log.add("combine", combined, F.col("gene_source"), F.lit("in"))
    filled = pn.gap_fill(combined, pn.gap_fill_tiers(cfg.analysis_type, dim, dim, rf), cfg.size).join(combined.select("gene"), "gene", "left_anti")
    log.add("gap_fill", pin(filled.select("gene", "celltype", "gene_source")), F.col("gene_source"), F.lit("in"))
    return log.close()
