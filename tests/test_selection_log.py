"""The log of a selection, identification at all depths, and the blocked projection."""

import duckdb
import numpy as np
import pytest

from panelweave.operators import predict as pr
from panelweave.plans import identification as ids
from panelweave.plans import selection as se
from panelweave.plans.selection_log import Learned, select_logged
from panelweave.schema import ExprData
from panelweave.session import fresh_path


def _data(spark, x, types, genes=None):
    genes = genes or [f"g{i:03d}" for i in range(x.shape[1])]
    rows = [(int(i), genes[j], float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return ExprData(spark.createDataFrame(rows, "cell_id int, gene string, value double"), spark.createDataFrame(list(enumerate(types)), "cell_id int, celltype string"),
                    spark.createDataFrame([(g,) for g in genes], "gene string"))


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(4)
    x = np.log1p(rng.poisson(1.5, (120, 24)))
    return _data(spark, x, ["a", "b", "c"] * 40, ["mt-x", "hsp1"] + [f"g{i:02d}" for i in range(22)])


def test_log_folds_into_panel(spark, small):
    cfg = se.SelectionConfig("random", 8, expression_bounds=(0.7, 0.82), force_include=("hsp1",))
    log = select_logged(small, cfg)
    events = {}
    for r in log.events.collect():
        events.setdefault(r.gene, []).append((r.step, r.decision, r.effect))
    paths = {r.gene: r for r in log.provenance().collect()}
    assert set(paths) == {"mt-x", "hsp1"} | {f"g{i:02d}" for i in range(22)}
    assert paths["mt-x"].path == "blacklist:removed" and paths["hsp1"].path.startswith("blacklist:forced")
    for g, e in events.items():
        last = {kind: max((s for s, _, x in e if x == kind), default=-1) for kind in ("in", "out")}
        assert paths[g].final_selection == (last["in"] > last["out"])
    panel = {r.gene: r for r in log.panel().collect()}
    assert {g for g, r in panel.items() if r.final_selection} == {g for g, r in paths.items() if r.final_selection}
    assert len(panel) == 8 and all(r.passed_xenium == (r.xenium_failure_reason is None) for r in panel.values())
    assert sum(r.n for r in log.stage_counts().collect()) == sum(map(len, events.values()))


def test_every_strategy_fills_its_panel(spark, small):
    genes = [r.gene for r in small.genes.collect()]
    forest = spark.createDataFrame([(g, f"f{k}", (7 * i + k) % 11 / 11.0, 0.5) for i, g in enumerate(genes) for k in range(2)], "gene string, fold string, importance double, f1_score double")
    loadings = spark.createDataFrame([(s, f, g, float((5 * i + 3 * f) % 13 - 4)) for s in "abc" for f in range(2) for i, g in enumerate(genes)], "scope string, factor int, gene string, loading double")
    for strategy in se.SINGLE + se.COMBINED:
        cfg = se.SelectionConfig(strategy, 9, k=2, pool=20, expression_bounds=(0.01, 50.0), force_include=("hsp1",), max_pval=1.0)
        panel = select_logged(small, cfg, Learned(forest=forest, loadings=loadings)).panel()
        final = {r.gene for r in panel.filter("final_selection").collect()}
        assert len(final) == 9 and "mt-x" not in final, strategy
        assert ("hsp1" in final) or strategy in se.SINGLE
    with pytest.raises(ValueError):
        select_logged(small, se.SelectionConfig("other"))
    with pytest.raises(ValueError):
        select_logged(small, se.SelectionConfig("hvg", analysis_type="other"))


def test_identification_scores_from_written_predictions(spark):
    rng = np.random.default_rng(1)
    types = ["a"] * 60 + ["b"] * 40 + ["c"] * 12 + ["d"]
    x = rng.poisson(1.0, (113, 9)) + np.array([{"a": 2, "b": 0, "c": 1, "d": 0}[t] for t in types])[:, None] * (np.arange(9) < 4)
    d = _data(spark, x, types)
    panels = spark.createDataFrame([("good", f"g{i:03d}") for i in range(4)] + [("poor", f"g{i:03d}") for i in range(5, 9)] + [("all", f"g{i:03d}") for i in range(9)] + [("none", "other")], "panel string, gene string")
    ident = ids.identify(d, panels, size=50)
    path = fresh_path(spark, "predictions")
    ident.predictions.write.parquet(path)
    con = duckdb.connect()
    want = {(r[0], r[1]): r[2:] for r in con.execute(f"""WITH p AS (SELECT * FROM read_parquet('{path}/*.parquet')),
      k AS (SELECT dataset, depth, celltype AS c, COUNT(*) AS n, COUNT(*) FILTER (celltype = predicted) AS tp FROM p GROUP BY ALL), s AS (SELECT dataset, depth, predicted AS c, COUNT(*) AS m FROM p GROUP BY ALL)
      SELECT dataset, depth, SUM(tp) / SUM(n), AVG(2 * tp / (n + coalesce(m, 0))) FROM k LEFT JOIN s USING (dataset, depth, c) GROUP BY ALL""").fetchall()}
    got = {(r.dataset, r.depth): r for r in ids.depth_scores(ident).collect()}
    assert set(got) == {(p, k) for p in ("good", "poor", "all") for k in ids.DEPTHS} == set(want)
    for key, r in got.items():
        assert (r.accuracy, r.macro_f1) == pytest.approx(want[key])
    best = {r.dataset: r for r in ids.dataset_scores(ident).collect()}
    assert best["good"].macro_f1 > best["poor"].macro_f1 and best["good"].macro_f1_rank < best["poor"].macro_f1_rank
    imp = ids.gene_importances(ident).groupBy("dataset").agg({"importance": "sum"}).collect()
    assert [r[1] for r in imp] == pytest.approx([1.0] * 3)
    # A type with one cell cannot be on both sides.
    assert {r.celltype for r in ids.label_scores(ident).collect()} == {"a", "b", "c"}


def test_shallow_trees_are_prefixes():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, (300, 7)).astype(float), rng.integers(0, 4, 300)
    deep = ids.grow(x, y, 4, 12)
    got = ids.labels_at(deep, x, (1, 3, 12))
    for d in (1, 3, 12):
        assert np.array_equal(ids.labels_at(ids.grow(x, y, 4, d), x, (d,))[d], got[d])
    assert (got[12] == y).mean() > (got[3] == y).mean() > (got[1] == y).mean()


@pytest.mark.parametrize("block", [7, 2048])
def test_projection_without_the_weight_matrix(spark, block):
    rng = np.random.default_rng(5)
    a, b, x = rng.standard_normal((40, 6)), rng.standard_normal((23, 6)), rng.poisson(1.0, (40, 5)).astype(float)
    x[3] = 0
    dens = rng.random(23)
    dens[4] = 0
    vec = lambda m, at: spark.createDataFrame([(at + i, [float(v) for v in r]) for i, r in enumerate(m)], "cell_id int, vec array<double>")
    d = _data(spark, x, ["t"] * 40)
    got = pr.softmax_projection(vec(a, 0), vec(b, 100), d.expr, spark.createDataFrame([(100 + i, float(v)) for i, v in enumerate(dens)], "cell_id int, density double"), 0.02, block=block)
    s = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1) / 0.02
    w = np.exp(s - s.max(axis=1, keepdims=True)) * dens
    want = (w / w.sum(axis=1, keepdims=True)).T @ x
    table = {(r.spot_id - 100, int(r.gene[1:])): r.value for r in got.collect()}
    assert len(table) == 22 * 5 and all(v == pytest.approx(want[k]) for k, v in table.items())


def test_mapping_predicts_like_a_model(spark):
    rng = np.random.default_rng(6)
    x = rng.poisson(2.0, (50, 12)).astype(float) + 0.5
    d = _data(spark, x, ["t"] * 50)
    q = ExprData(d.expr.filter("cell_id >= 40"), d.cells.filter("cell_id >= 40"), d.genes)
    ref = ExprData(d.expr.filter("cell_id < 40"), d.cells.filter("cell_id < 40"), d.genes)
    dens, pred = pr.MappingPredictor().fit(ref).predict(q.expr, q.cells, d.genes.filter("gene < 'g008'"), d.genes.filter("gene >= 'g008'"))
    assert pred.count() == 10 * 4 and dens.count() == 10


def test_scores_round_like_their_sql(spark):
    # Means of five multiples of 1/2048, among them 0.0640625 and its negative: halves of the sixth digit that scale to just below a half.
    from panelweave.workload.standins import rounded

    x = [k / 2048 / 5 for k in range(-4000, 4000)] + [None, float("nan"), float("inf")]
    got = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", rounded("x").alias("y")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT list_transform(?::DOUBLE[], lambda v: round(v, 6))", [x]).fetchall()[0][0]][0]
    assert [repr(v + 0.0) if v is not None else v for v in got] == [repr(v + 0.0) if v is not None else v for v in want]
