"""Composed evaluations of panels: how well a few genes stand in for all of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators import factor as fa
from panelweave.operators.metrics import macro_mean, variability_ratios, weighted_mean
from panelweave.schema import ExprData
from panelweave.session import pin

_PARTS = [f"{m}_{r}_{w}" for r in ("train", "test") for m in ("mse", "expvar") for w in ("baseline", "probe")]
_SEP = "␟"


def nmf_variability(data: ExprData, panels: DataFrame, splits: DataFrame, k: int = 5, scope: str | None = None, fit_iters: int = 30,
                    iters: int = 100, seed: int = 42, loss: str = "frobenius") -> DataFrame:
    """Reconstruction from panel genes against the full factorisation, for every panel, fold and cell type.

    Every fold, role and cell type is a scope of one packed matrix: the full
    baselines are fitted together once, and all panels are judged together with
    the gene factors of their fold's training cells.
    """
    spark = data.expr.sparkSession
    ct = F.coalesce(F.col(scope).cast("string"), F.lit("null")) if scope else F.lit("global")
    who = splits.select("cell_id", "fold", "role").join(data.cells, "cell_id").select(
        "cell_id", F.concat_ws(_SEP, F.col("fold").cast("string"), "role", ct).alias("part"))
    p = fa.pack(data.expr, who, data.genes, "part")
    fit = fa.nmf(p, k, fit_iters, loss, seed)
    base = {sc: fit.errors[("0", sc)] for _r, sc in fit.h}
    members: dict[str, set[str]] = {}
    for r in panels.select("panel", "gene").distinct().collect():
        members.setdefault(r.panel, set()).add(r.gene)
    masks = {name: np.array([g in genes for g in p.genes]) for name, genes in members.items()}
    hs, keep = {}, {}
    for sc in p.n_cells:
        fold, _role, c = sc.split(_SEP)
        train = ("0", _SEP.join([fold, "train", c]))
        if train in fit.h:
            for name, m in masks.items():
                hs[(name, sc)], keep[(name, sc)] = fit.h[train], m
    probe = fa.panel_errors(p, hs, keep, iters, loss)
    rows = []
    units = sorted({(sc.split(_SEP)[0], sc.split(_SEP)[2]) for sc in p.n_cells})
    for name, m in masks.items():
        for fold, c in units:
            tr, te = (_SEP.join([fold, r, c]) for r in ("train", "test"))
            n = p.n_cells.get(tr, 0) + p.n_cells.get(te, 0)
            vals, reason = [None] * 8, None
            if n < 2 * k:
                reason = "insufficient_cells"
            elif not (tr in base and te in base and (name, tr) in probe and (name, te) in probe):
                reason = "evaluation_failed"
            else:
                vals = [x for sc in (tr, te) for key in ("mse", "expvar") for x in (base[sc][key], probe[(name, sc)][key])]
            rows.append((name, c, int(fold), *[None if v is None else float(v) for v in vals], len(members[name]), int(m.sum()), n, reason is not None, reason))
    schema = "dataset string, celltype string, fold int, " + ", ".join(f"{c} double" for c in _PARTS) + \
        ", probeset_size int, probeset_genes_found int, n_cells bigint, skipped boolean, skip_reason string"
    # One row per panel, fold and cell type.
    return variability_ratios(spark.createDataFrame(rows, schema))


def variability_summary(rows: DataFrame) -> DataFrame:
    """One 'summary' row per panel and fold: weighted and macro means over the cell types that ran."""
    m = ["mse_test_probe", "mse_test_baseline", "expvar_test_probe", "expvar_test_baseline"]
    by = ["dataset", "fold"]
    counts = rows.groupBy(*by).agg(F.sum(F.when(~F.col("skipped"), F.col("n_cells"))).alias("total_cells"), F.count_if(~F.col("skipped")).alias("n_celltypes_processed"),
                                   F.count_if("skipped").alias("n_celltypes_skipped"))
    return weighted_mean(rows, m, by).join(macro_mean(rows, m, by), by).join(counts, by)


def celltype_identification(data: ExprData, panels: DataFrame, group: str = "celltype", size: int = 500, depths=(30, 5, 10, 15, 20), seed: int = 2020) -> DataFrame:
    """How well a decision tree tells cell types apart from each panel's genes alone: one row per (panel, label).

    See :mod:`panelweave.plans.identification`, which also has the scores per panel and depth and the importances.
    """
    from panelweave.plans.identification import identify, label_scores

    ident = identify(data, panels, group, size, depths, seed)
    imp = ident.importances.groupBy("dataset", F.col("depth").alias("best_max_depth")).agg(F.avg("importance").alias("avg_feature_importance"))
    return label_scores(ident).join(imp, ["dataset", "best_max_depth"]).select(
        "dataset", "celltype", "precision", "recall", "f1", "support", "best_max_depth", "macro_f1", "avg_feature_importance")
