"""Properties of the factorisations."""

import numpy as np
import pytest

from panelweave.operators import consensus as co
from panelweave.operators import factor as fa
from panelweave.operators import krylov as kr
from panelweave.operators import predict as pr
from panelweave.schema import ExprData


def _data(spark, x, types=None):
    n, g = x.shape
    rows = [(i, f"g{j:03d}", float(x[i, j])) for i in range(n) for j in range(g) if x[i, j] != 0]
    expr = spark.createDataFrame(rows, "cell_id long, gene string, value double")
    types = types or ["t"] * n
    cells = spark.createDataFrame([(i, types[i]) for i in range(n)], "cell_id long, celltype string")
    genes = spark.createDataFrame([(f"g{j:03d}",) for j in range(g)], "gene string")
    return ExprData(expr, cells, genes)


@pytest.fixture(scope="module")
def poisson():
    return np.random.default_rng(0).poisson(10, (100, 50)).astype(float)


@pytest.mark.parametrize("loss", ["frobenius", "kullback-leibler"])
def test_nmf_loss_falls_and_factors_are_positive(spark, poisson, loss):
    d = _data(spark, poisson)
    fit = fa.nmf(fa.pack(d.expr, d.cells, d.genes), 4, iters=8, loss=loss, inner=30)
    (key, h), = fit.h.items()
    past = fit.history[key]
    assert (h >= 0).all() and past[-1] < past[0]
    if loss == "frobenius":
        assert all(b <= a * (1 + 1e-6) for a, b in zip(past, past[1:]))


def test_error_sums_equal_dense_error(spark, poisson):
    x = poisson * (np.random.default_rng(1).random(poisson.shape) < 0.3)
    x[5] = 0  # a cell without anything
    d = _data(spark, x)
    p = fa.pack(d.expr, d.cells, d.genes)
    h = np.abs(np.random.default_rng(2).standard_normal((50, 3)))
    sums = fa._pass(p, {("0", "global"): h}, 15, "frobenius")[("0", "global")]
    u = {r.cell_id: r.weights for r in fa.nmf_transform(p, {("0", "global"): h}, 15).collect()}
    w = np.array([u.get(i, [0, 0, 0]) for i in range(100)])
    e = fa._errors(h, sums, 100)
    assert e["mse"] == pytest.approx(((x - w @ h.T) ** 2).mean())
    assert e["expvar"] == pytest.approx(1 - ((x - w @ h.T) ** 2).mean() / x.var())


def test_pca_matches_eigenvectors(spark, poisson):
    d = _data(spark, poisson)
    p = fa.pack(d.expr, d.cells, d.genes)
    l = fa.pca(p, 3).toPandas().sort_values(["factor", "gene"])
    comp = l["loading"].to_numpy().reshape(3, 50)
    val, vec = np.linalg.eigh(np.cov(poisson.T))
    assert np.allclose(np.abs(comp @ vec[:, ::-1][:, :3]), np.eye(3), atol=1e-6)
    assert np.allclose(l.groupby("factor")["explained_variance"].first(), val[::-1][:3])


def test_krylov_in_small_blocks(spark, poisson, monkeypatch):
    d = _data(spark, poisson, ["a"] * 60 + ["b"] * 40)
    p = fa.pack(d.expr, d.cells, d.genes, "celltype")
    monkeypatch.setattr(kr, "BLOCK", 1)
    for blocks in (100, 2):  # the whole space, and restarts
        monkeypatch.setattr(kr, "MAX_BLOCKS", blocks)
        for scope, rows in (("a", poisson[:60]), ("b", poisson[60:])):
            val, vec = np.linalg.eigh(np.cov(rows.T))
            r = kr.leading(p, 3)[scope]
            assert np.allclose(r.values, val[::-1][:3], rtol=1e-7) and r.trace == pytest.approx(np.trace(np.cov(rows.T)))
            assert np.allclose(np.abs(r.vectors.T @ vec[:, ::-1][:, :3]), np.eye(3), atol=1e-5)
    sv = np.linalg.svd(poisson[:60], compute_uv=False)
    got = {r.k: r.score for r in kr.explained_curve(p, [1, 4]).filter("scope = 'a'").collect()}
    for k, score in got.items():
        assert score == pytest.approx(1 - (sv[k:] ** 2).sum() / (poisson[:60].var() * poisson[:60].size), abs=1e-6)


def test_rank_below_the_wanted_number(spark):
    x = np.outer(np.arange(1.0, 9.0), np.ones(20))
    d = _data(spark, x)
    p = fa.pack(d.expr, d.cells, d.genes)
    r = kr.leading(p, 5)["global"]
    assert r.values[0] == pytest.approx(np.trace(np.cov(x.T))) and np.allclose(r.values[1:], 0, atol=1e-9)


@pytest.mark.parametrize("method", ["knee", "stability"])
def test_k_is_found_from_planted_blocks(spark, method):
    rng = np.random.default_rng(3)
    x = np.zeros((90, 30))
    for b in range(3):
        x[b * 30 : b * 30 + 30, b * 10 : b * 10 + 10] = rng.uniform(1, 3, (30, 1)) * rng.uniform(1, 3, (1, 10))
    d = _data(spark, x)
    how = {} if method == "knee" else {"runs": 5, "iters": 30}
    model = pr.NmfPredictor(kr.k_resolver(range(1, 7) if method == "knee" else range(2, 5), method, **how), iters=40).fit(d)
    assert model.k == 3


def test_scopes_skip_small_types(spark, poisson):
    d = _data(spark, poisson, ["a"] * 95 + ["b"] * 5)
    p = fa.pack(d.expr, d.cells, d.genes, "celltype", min_cells=10)
    assert set(sc for _r, sc in fa.nmf(p, 3, iters=1).h) == {"a"}


@pytest.mark.parametrize("k", [3, 5])
@pytest.mark.parametrize("kind", ["pca", "nmf", "fastica"])
def test_predictors_shapes(spark, poisson, kind, k):
    d = _data(spark, poisson)
    train = ExprData(d.expr.filter("cell_id < 90"), d.cells.filter("cell_id < 90"), d.genes)
    model = {"pca": pr.PcaPredictor(k), "nmf": pr.NmfPredictor(k, iters=3), "fastica": pr.FastIcaPredictor(k, iters=5)}[kind].fit(train)
    seen = d.genes.filter("gene < 'g040'")
    _s, pred = model.predict(d.expr.filter("cell_id >= 90"), d.cells.filter("cell_id >= 90"), seen, d.genes)
    assert pred.count() == 10 * 50
    assert pred.filter("isnan(value)").count() == 0


def test_component_count_may_be_a_function(spark, poisson):
    d = _data(spark, poisson)
    m = pr.NmfPredictor(lambda data: 2, iters=1).fit(d)
    assert m.k == 2 and next(iter(m.model.h.values())).shape == (50, 2)


def test_planted_factors_are_found_by_consensus(spark):
    rng = np.random.default_rng(3)
    h = np.zeros((2, 20))
    h[0, :10], h[1, 10:] = 5, 5
    x = rng.poisson(rng.random((120, 2)) * 4 @ h).astype(float)
    d = _data(spark, x)
    p = fa.pack(d.expr, d.cells, d.genes)
    spectra, metrics = co.consensus_nmf(p, [2], runs=5, iters=15, loss="frobenius", inner=20)
    m = spectra.toPandas().pivot(index="factor", columns="gene", values="loading").to_numpy()
    assert sorted([m[0, :10].sum() > 0.9, m[1, :10].sum() > 0.9]) == [False, True]
    assert metrics.first()["silhouette"] > 0.8
    assert co.consensus_usage(p, spectra, 2).count() <= 120


def test_packed_chunks_do_not_change_results(spark, poisson, monkeypatch):
    d = _data(spark, poisson)
    p = fa.pack(d.expr, d.cells, d.genes)
    h = {("0", "global"): np.abs(np.random.default_rng(4).standard_normal((50, 3)))}
    row = p.cells.toPandas()
    big = list(fa._chunks(iter([row]), 1))
    monkeypatch.setattr(fa, "CHUNK_VALUES", 500)
    small = list(fa._chunks(iter([row]), 1))
    assert len(big) == 1 and len(small) > 5
    assert sum(len(c[1]) for c in small) == 100
    assert sum(c[4].sum() for c in small) == pytest.approx(big[0][4].sum())
    assert h


@pytest.mark.parametrize("block", [11, 4096])
def test_silhouette_in_blocks(spark, block):
    rng = np.random.default_rng(8)
    x, c = rng.standard_normal((60, 4)) + np.repeat(np.eye(4)[:3] * 3, 20, axis=0), [i // 20 for i in range(59)] + [7]
    s = spark.createDataFrame([(f"s{i}", [float(v) for v in r]) for i, r in enumerate(x)], "spectrum string, vec array<double>")
    got = co.silhouette(s, spark.createDataFrame([(f"s{i}", str(k)) for i, k in enumerate(c)], "spectrum string, cluster string"), block)
    d, c, want = np.linalg.norm(x[:, None] - x[None], axis=2), np.array(c), []
    for i in range(60):
        own = (c == c[i]) & (np.arange(60) != i)
        a, b = d[i, own].mean() if own.any() else 0.0, min(d[i, c == k].mean() for k in set(c) - {c[i]})
        want.append((b - a) / max(a, b) if own.any() else 0.0)
    assert got == pytest.approx(np.mean(want))
