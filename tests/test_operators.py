"""Hand-computed frames: implicit zeros, ties, nulls, empty and single-type inputs."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions.columns import normal_two_sided_p, resolve_column
from panelweave.operators import filters as fl
from panelweave.operators import markers as mk
from panelweave.operators import metrics as me
from panelweave.operators import panels as pn
from panelweave.operators import quality as q
from panelweave.operators import sampling as sa
from panelweave.operators import sets as st
from panelweave.plans import selection as se
from panelweave.plans.preprocess import compose_steps, preprocess, preprocess_metadata
from panelweave.schema import ExprData, gene_moments

X = np.array([[1, 0, 4, 2], [0, 0, 4, 2], [3, 0, 0, 2], [0, 5, 4, 2], [0, 0, 0, 0]], dtype=float)
TYPES = ["a", "a", "b", "b", None]


@pytest.fixture(scope="module", params=["sparse", "dense"])
def data(request, spark):
    """The same matrix without and with explicit zeros."""
    rows = [(i, f"g{j}", float(X[i, j])) for i in range(5) for j in range(4) if X[i, j] or request.param == "dense"]
    return ExprData(
        spark.createDataFrame(rows, "cell_id long, gene string, value double"),
        spark.createDataFrame(list(enumerate(TYPES)), "cell_id long, celltype string"),
        spark.createDataFrame([(f"g{j}",) for j in range(4)], "gene string"))


def test_moments_count_zeros(data):
    m = gene_moments(data.expr, data.cells, data.genes).toPandas().set_index("gene").sort_index()
    assert np.allclose(m["mean"], X.mean(0)) and np.allclose(m["var_pop"], X.var(0)) and np.allclose(m["var_samp"], X.var(0, ddof=1))


def test_group_means_and_null_type(data):
    m = {(r.celltype, r.gene): r.mean_expr for r in q.mean_expr_by_celltype(data).collect()}
    assert m[("a", "g0")] == 0.5 and m[("b", "g1")] == 2.5


def test_wilcoxon_same_for_sparse_and_dense(data):
    z = {(r.group, r.gene): r.scores for r in mk.rank_genes_wilcoxon(ExprData(data.expr, data.cells.na.fill("n"), data.genes), p_values=False, sample_rate=1).collect()}
    for j in range(4):
        rank = (X[:, j][:, None] > X[:, j]).sum(1) + ((X[:, j][:, None] == X[:, j]).sum(1) + 1) / 2
        want = (rank[:2].sum() - 2 * 6 / 2) / math.sqrt(2 * 3 * 6 / 12)
        assert z[("a", f"g{j}")] == pytest.approx(want)


def test_constant_gene_has_no_variance(data):
    d = ExprData(data.expr.filter("cell_id < 4"), data.cells.filter("cell_id < 4"), data.genes)
    assert {r.gene for r in q.variable_genes(d).collect()} == {"g0", "g1", "g2"}
    assert q.variable_genes(d, 4).count() == 0


def test_spearman_and_metrics_with_zeros(spark, data):
    y = X[:, ::-1]
    pred = spark.createDataFrame([(i, f"g{j}", float(y[i, j])) for i in range(5) for j in range(4)], "cell_id long, gene string, value double")
    r = me.reconstruction_metrics(data.expr, pred, data.cells, data.genes).first()
    assert r.mse == pytest.approx(((X - y) ** 2).mean())
    assert r.explained_variance == pytest.approx(1 - (X - y).var() / X.var())
    assert r.pearson == pytest.approx(np.corrcoef(X.ravel(), y.ravel())[0, 1])
    s = {v.gene: v.spearman for v in me.spearman(data.expr, pred, F.lit(5), sample_rate=1).collect()}
    import pandas as pd
    for j in range(4):
        want = pd.Series(X[:, j]).rank().corr(pd.Series(y[:, j]).rank())
        assert s[f"g{j}"] == pytest.approx(want)


def test_normalisation_and_zero_total(data):
    e = q.normalize_total(data.expr, 10.0).groupBy("cell_id").agg(F.sum("value").alias("t")).collect()
    assert {round(r.t, 9) for r in e} <= {10.0, 0.0}
    med = q.normalize_total(data.expr, None).groupBy("cell_id").agg(F.sum("value").alias("t")).collect()
    assert {round(r.t, 9) for r in med} <= {6.5, 0.0}


def test_metric_vectors(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2)], "x double, y double")
    r = me.pair_metrics_flat(df).first()
    assert r.mse == pytest.approx(0.02) and r.mae == pytest.approx(0.4 / 3) and r.pearson == pytest.approx(np.corrcoef([1, 2, 3], [1.1, 1.9, 3.2])[0, 1])
    zero = me.pair_metrics_flat(spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "x double, y double")).first()
    assert zero.cosine == 0.0 and zero.explained_variance_v2 == 0.0 and zero.pearson is None


def test_p_values(spark):
    p = [r.p for r in spark.createDataFrame([(0.0,), (1.959963985,)], "z double").select(normal_two_sided_p("z").alias("p")).collect()]
    assert p[0] == 1.0 and p[1] == pytest.approx(0.05)


def test_untested_genes_pass(spark):
    p = spark.createDataFrame([("A", 1, 3.0, True, None), ("B", 2, 2.0, True, False), ("C", 3, 1.0, False, True), ("D", 4, 5.0, False, False)],
                              "gene string, rank long, selection_score double, selected_initial boolean, passed_xenium boolean")
    f = {r.gene: r.final_selection for r in pn.single_gap_fill(p, 3).collect()}
    assert f == {"A": True, "B": False, "C": True, "D": False}


def test_bounds_and_errors(spark, data):
    with pytest.raises(ValueError):
        fl.expression_filter_global(data.genes, data.genes, 2, 1)
    with pytest.raises(ValueError):
        pn.combination_targets(5, 5)
    with pytest.raises(ValueError):
        pn.force_include(data.genes, data.genes, 4)
    with pytest.raises(Exception):
        se.select_random(data.genes, 5).collect()
    with pytest.raises(ValueError):
        st.shared_genes(data.genes, data.genes.filter("false"), required=True)
    assert resolve_column(data.cells.withColumnRenamed("celltype", "louvain"), None) == "louvain"
    with pytest.raises(ValueError):
        resolve_column(data.cells, "x")


def test_empty_panel(spark, data):
    none = data.genes.filter("false").withColumn("panel", F.lit("p")).withColumn("position", F.lit(0))
    assert st.subset_to_panels(data.expr, none).count() == 0
    assert st.panel_coverage(none, data.genes).count() == 0


def test_robust_limits_edges(spark):
    none = spark.createDataFrame([(float("nan"),), (float("inf"),)], "value double")
    assert tuple(q.robust_limits(none).first()) == (0.0, 1.0)
    same = spark.createDataFrame([(2.0,), (2.0,)], "value double")
    assert tuple(q.robust_limits(same).first()) == (2.0, 3.0)


@pytest.mark.parametrize("rate", [1, 32768])
def test_splits_partition_the_cells(spark, rate):
    c = spark.range(200).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("celltype"))
    f = sa.fold_of_cell(c, 5, sample_rate=rate)
    per = f.groupBy("celltype", "fold").count().groupBy("celltype").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert f.count() == 200 and max(r.d for r in per) <= 1
    s = sa.split_simple(c, 0.3, sample_rate=rate)
    assert s.filter("role = 'test'").count() == 60
    u = sa.uniform_samples(c, 50, sample_rate=rate).groupBy("celltype").agg(F.count("*").alias("n"), F.count_distinct("cell_id").alias("u")).collect()
    assert all(r.n == 50 for r in u) and {r.celltype: r.u for r in u}["hot"] == 50


def test_compose_and_preprocess(spark, data):
    same = compose_steps(None, lambda d: d.filter("value > 0"), None)(data.expr)
    assert same.count() == int((X > 0).sum())
    p = preprocess(data, "scanpy", min_genes=2, min_cells=2)
    assert {r.gene for r in p.expr.select("gene").distinct().collect()} == {"g0", "g2", "g3"}
    assert preprocess_metadata(p, "scanpy", None).first()["n_genes"] == 3


def test_single_celltype(spark):
    d = ExprData(spark.createDataFrame([(0, "g", 1.0)], "cell_id long, gene string, value double"),
                 spark.createDataFrame([(0, "only"), (1, "only")], "cell_id long, celltype string"), spark.createDataFrame([("g",)], "gene string"))
    assert mk.rank_genes_wilcoxon(d, p_values=False).first()["scores"] == 0.0
    assert mk.rank_genes_ttest(d).count() == 0


def test_celltype_travels_along_long_chains(spark):
    """Six links, a ring, and a gene whose own type wins."""
    from panelweave.operators.provenance import inherit_celltype

    rows = [(f"p{i}", f"p{i - 1}" if i else None) for i in range(7)] + [("r1", "r2"), ("r2", "r1"), ("own", "p6")]
    prov = spark.createDataFrame([(g, None, f, None) for g, f in rows], "gene string, blacklist_replacement_for string, xenium_replacement_for string, odt_replacement_for string")
    types = spark.createDataFrame([("p0", "T"), ("own", "U")], "gene string, celltype string")
    got = {r.gene: r.celltype for r in inherit_celltype(prov, types).collect()}
    assert got == {f"p{i}": "T" for i in range(7)} | {"r1": None, "r2": None, "own": "U"}


def test_clusters_of_text_ids(spark):
    from panelweave.operators.clustering import cluster_to_n

    edges = [(f"{g}{i}", f"{g}{j}", 0.1) for g in "ab" for i in range(8) for j in range(8) if i != j] + [("a0", "b0", 50.0)]
    out = cluster_to_n(spark.createDataFrame(edges, "cell_id string, neighbor string, dist double"), 2).collect()
    assert sorted(r.cell_id for r in out) == sorted(f"{g}{i}" for g in "ab" for i in range(8)) and 1 <= len({r.cluster for r in out}) <= 2


def test_workspace_removes_what_it_wrote(spark):
    import os

    from panelweave.session import fresh_path, pin, workspace

    with workspace(spark):
        path = pin(spark.range(5)).inputFiles()[0].removeprefix("file://")
        unused = fresh_path(spark, "unused")
        assert os.path.exists(path)
    assert not os.path.exists(path) and not os.path.exists(unused)


def test_wilcoxon_of_millions_of_cells(spark):
    # The product of the three counts is above the largest long.
    cells = spark.range(6_000_000).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("celltype"))
    expr = spark.createDataFrame([(0, "g", 1.0), (2, "g", 2.0), (4, "g", 3.0)], "cell_id long, gene string, value double")
    d = mk.rank_genes_wilcoxon(ExprData(expr, cells, expr.select("gene").distinct()), p_values=False)
    z = {r.group: r.scores for r in d.collect()}
    n, half = 6_000_000, 3_000_000
    zeros = (n - 3 + 1) / 2
    want = (3 * (n - 1) + (half - 3) * zeros - half * (n + 1) / 2) / (half * half * (n + 1) / 12) ** 0.5
    assert z["a"] == pytest.approx(want) and z["b"] == pytest.approx(-want)


def test_hash_orders_need_no_cuts(spark):
    cells = spark.range(5000).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("celltype"))
    for d in (sa.split_simple(cells, 0.3), sa.split_ratio(cells, 4, "celltype"), sa.fold_of_cell(cells), sa.uniform_samples(cells, 50)):
        assert "_cuts" not in d._jdf.queryExecution().optimizedPlan().toString()
    order = sorted(range(5000), key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))
    assert {r.cell_id for r in sa.split_simple(cells, 0.3).filter("role = 'test'").collect()} == set(order[:1500])
    types = {i: "a" if i % 3 == 0 else "b" for i in range(5000)}
    want, seen = {}, {"a": 0, "b": 0}
    for i in order:
        want[i], seen[types[i]] = seen[types[i]] % 5, seen[types[i]] + 1
    assert {r.cell_id: r.fold for r in sa.fold_of_cell(cells).collect()} == want


def test_forest_scores_do_not_depend_on_the_order_of_the_fits(spark):
    """Genes with the same fits in another order tie and are ranked by name."""
    fits = [(0.1, 0.7), (0.2, 0.3), (0.3, 0.9), (1e9, 0.1), (0.7, 0.6), (0.013, 0.21), (5.5, 0.44)]
    rows = [(f"g{i}", f"f{(i + j) % 7}", *fits[(i * 3 + j * (1 + i % 6)) % 7]) for i in range(12) for j in range(7)]
    t = spark.createDataFrame(rows, "gene string, fold string, importance double, f1_score double").coalesce(1)
    got = se.select_rf(t, 5).orderBy("rank").collect()
    assert len({r.final_score for r in got}) == 1 and len({r.avg_importance for r in got}) == 1
    assert [r.gene for r in got] == sorted(r.gene for r in got)
