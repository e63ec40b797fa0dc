"""Leading eigenpairs of every scope's second-moment or covariance matrix, for any number of genes.

The matrix itself is never formed.  A pass over the packed cells multiplies it
with one block of gene vectors per scope; all scopes share the pass.  The blocks
of all passes together span a Krylov space that is kept orthonormal, so that the
eigenpairs seen from inside it (Ritz pairs) converge fast, and are exact as soon
as the space has as many directions as the data.  Scopes whose pairs meet the
tolerance are locked and leave the passes.  When a space reaches ``MAX_BLOCKS``
blocks it shrinks to its leading Ritz vectors and goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators import factor as fa

#: Vectors of a block at least (fewer where there are fewer genes), blocks of a space, and residual accepted as a part of the largest eigenvalue.
BLOCK, MAX_BLOCKS, TOLERANCE = 64, 8, 1e-9


@dataclass(frozen=True)
class Leading:
    """Largest eigenvalues with their vectors (genes x k), residual norms, column means, sum of all eigenvalues, stored sum and sum of squares."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    mean: np.ndarray
    trace: float
    total: float
    squares: float


def multiply(p: fa.Packed, blocks: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """X'X times each scope's block, by one pass per batch of scopes that fits the tasks."""
    g, out = len(p.genes), {}
    for keys in fa._batched(list(blocks), max(b.size for b in blocks.values())):
        part = {s: blocks[s] for s in keys}

        def work(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            acc: dict[str, np.ndarray] = {}
            for scope, ids, row, idx, val in fa._chunks(batches, BLOCK):
                if scope in part:
                    y = fa._row_sum(val[:, None] * part[scope][idx], row, len(ids))
                    acc[scope] = acc.get(scope, 0) + fa._gene_sum(val[:, None] * y[row], idx, g)
            for scope, a in acc.items():
                n = range(-(-g // fa.BLOCK_GENES))
                yield pd.DataFrame({"scope": scope, "i": np.array(n, dtype="int32"), "v": [a[b * fa.BLOCK_GENES:(b + 1) * fa.BLOCK_GENES].ravel() for b in n]})

        got = fa._add_up(fa._few_tasks(p.cells).mapInPandas(work, "scope string, i int, v array<double>"), ["scope", "i"]).toPandas()
        for s in keys:
            out[s] = np.zeros(part[s].shape)
        for scope, i, v in zip(got["scope"], got["i"], got["v"]):
            out[scope][i * fa.BLOCK_GENES:(i + 1) * fa.BLOCK_GENES] = np.asarray(v).reshape(-1, part[scope].shape[1])
    return out


def _fresh(block: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Orthonormal directions of ``block`` that ``basis`` lacks; none where only rounding is left."""
    size = np.linalg.norm(block, axis=0).max(initial=0.0)
    if basis is not None:
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-12 * max(size, 1e-300)]
    return u if basis is None or not u.shape[1] else np.linalg.qr(u - basis @ (basis.T @ u))[0]


def leading(p: fa.Packed, k: int, centred: bool = True, passes: int = 300, tolerance: float = TOLERANCE, seed: int = 0) -> dict[str, Leading]:
    """The ``k`` leading eigenpairs of each scope: of the covariance matrix, or of X'X if not ``centred``.

    A scope gives at most as many pairs as it has cells or genes.  After ``passes`` passes the best pairs so far are returned.
    """
    g = len(p.genes)
    moments = p.cells.select("scope", F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy("scope", F.col("e.idx").alias("i")).agg(
        F.sum("e.val").alias("s1"), F.sum(F.col("e.val") * F.col("e.val")).alias("s2")).toPandas()
    mean, trace, total, squares = {}, {}, {}, {}
    for scope, n in p.n_cells.items():
        d = moments[moments["scope"] == scope]
        mu = np.zeros(g)
        mu[d["i"]] = d["s1"] / n
        mean[scope], total[scope], squares[scope] = mu, float(d["s1"].sum()), float(d["s2"].sum())
        trace[scope] = (squares[scope] - n * float(mu @ mu)) / max(n - 1, 1) if centred else squares[scope]
    width = min(g, max(k + 10, BLOCK))
    block = {s: np.linalg.qr(np.random.default_rng(seed).standard_normal((g, width)))[0] for s in p.n_cells}
    basis: dict[str, np.ndarray] = {}
    image: dict[str, np.ndarray] = {}
    out: dict[str, Leading] = {}
    for turn in range(passes):
        product = multiply(p, block)
        for s in list(block):
            n, q, z = p.n_cells[s], block[s], product[s]
            if centred:
                z = (z - n * np.outer(mean[s], mean[s] @ q)) / max(n - 1, 1)
            basis[s] = np.hstack([basis[s], q]) if s in basis else q
            image[s] = np.hstack([image[s], z]) if s in image else z
            small = basis[s].T @ image[s]
            val, vec = np.linalg.eigh((small + small.T) / 2)
            order = np.argsort(val)[::-1]
            top = order[:min(k, n, g)]
            off = np.linalg.norm(image[s] @ vec[:, top] - basis[s] @ vec[:, top] * val[top], axis=0)
            more = _fresh(z, basis[s]) if basis[s].shape[1] < g else np.zeros((g, 0))
            settled = off.max(initial=0.0) <= tolerance * max(float(val.max(initial=0.0)), 1e-300)
            if settled or not more.shape[1] or turn == passes - 1:
                out[s] = Leading(np.maximum(val[top], 0.0), fa._fix_sign(basis[s] @ vec[:, top]), off, mean[s], trace[s], total[s], squares[s])
                del block[s], basis[s], image[s]
                continue
            if basis[s].shape[1] + more.shape[1] > MAX_BLOCKS * width:
                keep = vec[:, order[:width]]
                basis[s], image[s] = basis[s] @ keep, image[s] @ keep
                more = _fresh(more, basis[s])
            block[s] = more[:, : g - basis[s].shape[1]]
        if not block:
            break
    return out


# --- number of components --------------------------------------------------------------------

def explained_curve(p: fa.Packed, ks: range | list[int], seed: int = 0) -> DataFrame:
    """(scope, k, score): the part of the variance the best factorisation of rank ``k`` explains, for all ``k`` from one solve.

    The squared error of the best rank-k approximation is the sum of squares less the k leading eigenvalues of X'X; no
    factorisation of that rank explains more.  Variance is taken around the mean of all entries.
    """
    ks = sorted(set(ks))
    rows = []
    for scope, r in leading(p, max(ks), centred=False, seed=seed).items():
        entries = p.n_cells[scope] * len(p.genes)
        variance = r.squares - r.total * r.total / max(entries, 1)
        got = np.concatenate([[0.0], np.cumsum(r.values)])
        rows += [(scope, k, 1.0 - float(max(r.squares - got[min(k, len(got) - 1)], 0.0)) / variance if variance > 0 else 0.0) for k in ks]
    return p.cells.sparkSession.createDataFrame(rows, "scope string, k int, score double")


def farthest_from_chord(curve: DataFrame, x: str = "k", y: str = "score", by: tuple[str, ...] = ("scope",)) -> DataFrame:
    """(by..., best_x, distance): the point farthest from the line through the curve's ends, in plain coordinates; the first on ties."""
    w = Window.partitionBy(*by)
    x0, x1 = F.min(x).over(w), F.max(x).over(w)
    y0, y1 = F.min_by(y, x).over(w), F.max_by(y, x).over(w)
    length = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    away = F.abs((x1 - x0) * (F.col(y) - y0) - (y1 - y0) * (F.col(x) - x0))
    d = curve.withColumn("_d", F.when(length > 0, away / length).otherwise(0.0))
    return d.groupBy(*by).agg(F.min_by(x, F.struct(-F.round("_d", 9), x)).alias(f"best_{x}"), F.max("_d").alias("distance"))


def stability_curve(p: fa.Packed, ks: range | list[int], runs: int = 10, iters: int = 100, loss: str = "frobenius", seed: int = 42) -> DataFrame:
    """(k, n_cells, dispersion): how far ``runs`` restarts agree on which cells belong together, for every ``k``; one scope."""
    from panelweave.operators.clustering import coclustering_stability, component_clusters
    from panelweave.session import pin

    out = None
    for k in sorted(set(ks)):
        fit = fa.nmf(p, k, iters, loss, seed, runs=runs)
        usage = fa.nmf_transform(p, fit.h, iters, loss).select("run", "cell_id", F.posexplode("weights").alias("factor", "weight"))
        labels = pin(component_clusters(usage)).withColumn("k", F.lit(k)).select("k", "run", "cell_id", "cluster")
        part = pin(coclustering_stability(labels))
        out = part if out is None else out.unionByName(part)
    return out


def choose_k(p: fa.Packed, ks: range | list[int], method: str = "knee", **how) -> dict[str, int]:
    """Number of components per scope, from the data: the knee of the explained variance, or the most stable restarts (one scope)."""
    if method == "knee":
        return {r.scope: r.best_k for r in farthest_from_chord(explained_curve(p, ks, **how)).collect()}
    if method == "stability":
        from panelweave.operators.clustering import most_stable_k

        (scope,) = p.n_cells
        return {scope: most_stable_k(stability_curve(p, ks, **how)).first()["best_k"]}
    raise ValueError(f"unknown method {method}")


def k_resolver(ks: range | list[int], method: str = "knee", **how):
    """A function from training data to a number of components, as ``NmfPredictor(k=...)`` takes it."""
    def resolve(data) -> int:
        return choose_k(fa.pack(data.expr, data.cells, data.genes), ks, method, **how)["global"]

    return resolve
