"""Scores of held-out genes in the pass over the cells."""

import numpy as np

from panelweave.operators import factor as fa
from panelweave.operators import predict as pr
from panelweave.operators.sampling import gene_holdout
from panelweave.schema import ExprData


def test_holdout_scores_equal_the_tables_of_predictions_and_pairs(spark):
    rng = np.random.default_rng(3)
    genes = [f"g{i}" for i in range(8)]
    rows = [(int(c), g, float(rng.integers(1, 4))) for c in range(60) for g in genes if rng.random() < 0.5]
    cells = spark.createDataFrame([(c, "ab"[c % 2] if c % 7 else None) for c in range(60)], "cell_id long, celltype string")
    data = ExprData(spark.createDataFrame(rows, "cell_id long, gene string, value double"), cells, spark.createDataFrame([(g,) for g in genes], "gene string"))
    h = {("0", s): rng.random((8, 2)) for s in ("a", "null")}
    h[("0", "a")][3] = h[("0", "a")][4]
    # Cluster b has no model: its cells keep their rows, without values.
    model = fa.NmfFit(genes, h, {}, {}, "frobenius")
    known = spark.createDataFrame([(c, g) for c in ("a", "b", "null") for g in genes], "cluster string, gene string")
    roles = gene_holdout(known, 4, 3, 42, ("cluster",))
    old = pr.holdout_correlations(data, pr.holdout_predictions(data, model, roles, iters=10), roles)
    sets = [{(r.cluster, r.trial, r.cell_id): (r.spearman, r.pearson) for r in d.collect()} for d in (old, pr.holdout_scores(data, model, roles, iters=10))]
    assert sets[0].keys() == sets[1].keys() and {k[0] for k in sets[1]} == {"a", "b", "null"}
    for k, want in sets[0].items():
        for x, y in zip(want, sets[1][k]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9), (k, want, sets[1][k])


def test_experiment_needs_no_shuffle_after_the_cells_are_packed(spark):
    cells = spark.createDataFrame([(c, "a") for c in range(30)], "cell_id long, celltype string")
    genes = [f"g{i}" for i in range(6)]
    expr = spark.createDataFrame([(c, g, float(1 + (c * 7 + i * i) % 5)) for c in range(30) for i, g in enumerate(genes) if (c + i) % 3], "cell_id long, gene string, value double")
    data = ExprData(expr, cells, spark.createDataFrame([(g,) for g in genes], "gene string"))
    out = pr.holdout_gene_experiment(data, data, 2, 2, 2, fit_iters=2, iters=5)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() > 0
