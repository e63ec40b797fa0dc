"""Matrix factorisation over a packed sparse matrix.

A matrix is packed once -- one row per cell with its gene indexes and values --
and every pass over it is one narrow job: tasks hold only the small gene-side
factor, solve their own cells, and return partial gene-side sums that Spark adds
up.  The facts are never shuffled between iterations, all scopes (cell types)
and runs (restarts) advance in the same pass, and cell-side factors are
recomputed rather than stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.session import pin

MAX_FACTOR_VALUES = 40_000_000
CHUNK_VALUES = 2_000_000
#: Genes in one row of a partial factor, and groups of tasks that are added up first.
BLOCK_GENES = 512
SALTS = 64
EPS = 1e-8


@dataclass(frozen=True)
class Packed:
    """cells(scope, cell_id, idx ARRAY<INT>, val ARRAY<DOUBLE>), the gene names, and cells per scope."""

    cells: DataFrame
    genes: list[str]
    n_cells: dict[str, int]


def pack(expr: DataFrame, cells: DataFrame, genes: DataFrame, scope: str | None = None, value: str = "value",
         min_cells: int = 1) -> Packed:
    """Pack ``expr`` for repeated passes; ``scope`` names a cell column or None for 'global'.

    Scopes with fewer than ``min_cells`` cells are left out.
    """
    names = sorted(r.gene for r in genes.select("gene").distinct().collect())
    sc = F.col(scope) if scope else F.lit("global")
    who = cells.select("cell_id", F.coalesce(sc.cast("string"), F.lit("null")).alias("scope"))
    sizes = {r.scope: r.n for r in who.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).collect() if r.n >= min_cells}
    # Written, so that its size is known: the facts meet it without being shuffled by gene.
    index = pin(expr.sparkSession.createDataFrame([(g, i) for i, g in enumerate(names)], "gene string, idx int"))
    e = expr.filter(F.col(value) != 0).select("cell_id", "gene", F.col(value).cast("double").alias("v")).join(index, "gene")
    rows = e.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("x"))
    rows = rows.join(who, "cell_id").filter(F.col("scope").isin(list(sizes)))
    rows = rows.select("scope", "cell_id", F.col("x.idx").alias("idx"), F.col("x.v").alias("val"))
    if len(sizes) > 1:
        # Keep a scope's cells together so that a task meets few scopes and returns
        # few partial factors; a range over (scope, cell) still splits a big scope.
        rows = rows.repartitionByRange("scope", "cell_id")
    return Packed(pin(rows), names, sizes)


def _chunks(batches: Iterator[pd.DataFrame], width: int):
    """Yield (scope, ids, row, idx, val): one scope's cells with a bounded number of stored values."""
    for b in batches:
        for scope, g in b.groupby("scope", sort=False):
            lens = g["idx"].map(len).to_numpy()
            cut = (np.cumsum(lens) * max(1, width)) // CHUNK_VALUES
            for _, part in g.groupby(cut, sort=False):
                n = part["idx"].map(len).to_numpy()
                yield scope, part["cell_id"].to_numpy(), np.repeat(np.arange(len(part)), n), np.concatenate(part["idx"].to_numpy()), np.concatenate(part["val"].to_numpy())


def _row_sum(a: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sum rows of ``a`` that belong to the same cell; ``row`` ascends."""
    start = np.searchsorted(row, np.arange(n))
    return np.add.reduceat(a, start, axis=0)


def _gene_sum(a: np.ndarray, idx: np.ndarray, n_genes: int) -> np.ndarray:
    out = np.empty((n_genes, a.shape[1]))
    for f in range(a.shape[1]):
        out[:, f] = np.bincount(idx, weights=a[:, f], minlength=n_genes)
    return out


def solve_usage(h: np.ndarray, row: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int, iters: int, loss: str,
                start: np.ndarray | None = None, keep: np.ndarray | None = None) -> np.ndarray:
    """Multiplicative updates of the cell factor for a fixed gene factor ``h`` (genes x k), from ones.

    ``keep`` marks the genes to fit on; the others are unseen.
    """
    if keep is not None:
        h = np.where(keep[:, None], h, 0.0)
    w = np.ones((n, h.shape[1])) if start is None else start.copy()
    hv = h[idx]
    if loss == "frobenius":
        num, gram = _row_sum(val[:, None] * hv, row, n), h.T @ h
        for _ in range(iters):
            w *= num / (w @ gram + EPS)
        return w
    den = h.sum(0) + EPS
    for _ in range(iters):
        fit = np.maximum((w[row] * hv).sum(1), EPS)
        w *= _row_sum((val / fit)[:, None] * hv, row, n) / den
    return w


def _few_tasks(cells: DataFrame) -> DataFrame:
    """The packed cells in about as many tasks as there are cores, since every task returns gene-sized sums."""
    return cells.coalesce(max(1, 2 * cells.sparkSession.sparkContext.defaultParallelism))


def _add_up(part: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise sums of the arrays ``v`` per key, in two levels: first within groups of tasks, then across them."""

    def plus(arrays):
        rest = F.slice(arrays, F.lit(2), F.greatest(F.size(arrays) - 1, F.lit(0)))
        return F.aggregate(rest, F.element_at(arrays, 1), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))

    def level(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.collect_list("v").alias("_vs")).select(*by, plus(F.col("_vs")).alias("v"))

    salted = part.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return level(level(salted, [*keys, "_salt"]).drop("_salt"), keys)


def with_scopes(p: Packed, scopes: list[str]) -> Packed:
    """The same packed cells, some scopes only."""
    return Packed(p.cells.filter(F.col("scope").isin(scopes)), p.genes, {s: n for s, n in p.n_cells.items() if s in set(scopes)})


def _batched(keys: list, values_each: int) -> list[list]:
    """Groups of factors small enough to ship to every task together."""
    per = max(1, MAX_FACTOR_VALUES // max(1, values_each))
    return [keys[i:i + per] for i in range(0, len(keys), per)]


def _pass(p: Packed, hs: dict[tuple[str, str], np.ndarray], inner: int, loss: str,
          keep: dict[tuple[str, str], np.ndarray] | None = None) -> dict[tuple[str, str], dict]:
    """One pass for all (run, scope): gene-side numerators, k x k usage products and error sums.

    With ``keep`` the usage is solved on a gene subset but judged on all genes.
    """
    g = len(p.genes)
    keep = keep or {}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple[str, str], list] = {}
        k = max(h.shape[1] for h in hs.values())
        for scope, _ids, row, idx, val in _chunks(batches, k):
            n = int(row[-1]) + 1
            for (run, sc), h in hs.items():
                if sc != scope:
                    continue
                w = solve_usage(h, row, idx, val, n, inner, loss, keep=keep.get((run, sc)))
                a = acc.setdefault((run, sc), [np.zeros_like(h), np.zeros((h.shape[1], h.shape[1])), np.zeros(h.shape[1]), np.zeros(h.shape[1]), 0.0, 0.0, 0.0])
                wv, hv = w[row], h[idx]
                ratio = val
                if loss != "frobenius":
                    ratio = val / np.maximum((wv * hv).sum(1), EPS)
                    a[6] += float((val * np.log(np.maximum(ratio, EPS)) - val).sum())
                a[0] += _gene_sum(ratio[:, None] * wv, idx, g)
                a[1] += w.T @ w
                a[2] += w.sum(0)
                a[3] += (val[:, None] * wv * hv).sum(0)
                a[4] += float((val * val).sum())
                a[5] += float(val.sum())
        for (run, sc), a in acc.items():
            blocks = [(b, a[0][b * BLOCK_GENES:(b + 1) * BLOCK_GENES]) for b in range(-(-g // BLOCK_GENES))]
            kinds = [("gene", b, x.ravel()) for b, x in blocks if x.any()] + [("ww", 0, a[1].ravel())]
            kinds += [("w", 0, a[2]), ("xwh", 0, a[3]), ("x", 0, np.array(a[4:7]))]
            yield pd.DataFrame({"run": run, "scope": sc, "kind": [x[0] for x in kinds], "i": [x[1] for x in kinds], "v": [x[2] for x in kinds]})

    # A task returns one row per (run, scope, block of genes), whatever the number of cells it read.
    part = _few_tasks(p.cells).mapInPandas(work, "run string, scope string, kind string, i int, v array<double>")
    summed = _add_up(part, ["run", "scope", "kind", "i"])
    out: dict[tuple[str, str], dict] = {}
    for key, h in hs.items():
        k = h.shape[1]
        out[key] = {"gene": np.zeros((g, k)), "ww": np.zeros((k, k)), "w": np.zeros((1, k)), "xwh": np.zeros((1, k)), "x": np.zeros((1, 3))}
    # Gene-sized result, bounded by MAX_FACTOR_VALUES.
    got = summed.toPandas()
    for run, scope, kind, i, v in zip(got["run"], got["scope"], got["kind"], got["i"], got["v"]):
        to = out[(run, scope)][kind]
        rows = slice(i * BLOCK_GENES, (i + 1) * BLOCK_GENES) if kind == "gene" else slice(None)
        to[rows] = np.asarray(v).reshape(to[rows].shape)
    return out


def _errors(h: np.ndarray, s: dict, n_cells: int) -> dict:
    """Squared error, divergence (for that loss), mse and explained variance from sums; the dense product is never formed."""
    n = float(n_cells) * h.shape[0]
    x2, x1, ratio_part = s["x"][0]
    cross = s["xwh"].sum()
    fit2 = float((s["ww"] * (h.T @ h)).sum())
    sse = max(x2 - 2 * cross + fit2, 0.0)
    var_x = x2 / n - (x1 / n) ** 2
    per = []
    hh = (h * h).sum(0)
    for f in range(h.shape[1]):
        e = x2 - 2 * s["xwh"][0, f] + s["ww"][f, f] * hh[f]
        per.append(float(1 - e / n / var_x) if var_x > 0 else 0.0)
    # Entries without a stored value only add their fitted value to the divergence.
    divergence = float(ratio_part + (s["w"][0] * h.sum(0)).sum())
    return {"sse": float(sse), "divergence": divergence, "mse": float(sse / n), "expvar": float(1 - sse / n / var_x) if var_x > 0 else 0.0, "factor_r2": per}


def _update_spectra(h: np.ndarray, s: dict, inner: int, loss: str) -> np.ndarray:
    """Gene-side update from one pass's sums.

    The squared error given the usages depends on the data only through these
    sums, so it can be driven down by many small steps without another pass.
    """
    if loss == "frobenius":
        for _ in range(max(1, inner)):
            h = h * s["gene"] / (h @ s["ww"] + EPS)
        return h
    return h * s["gene"] / (np.broadcast_to(s["w"], h.shape) + EPS)


def panel_errors(p: Packed, hs: dict[tuple[str, str], np.ndarray], keep: dict[tuple[str, str], np.ndarray], iters: int = 100,
                 loss: str = "frobenius") -> dict[tuple[str, str], dict]:
    """Errors over all genes of usages solved on gene subsets, many subsets in one pass."""
    out = {}
    for keys in _batched(list(hs), max((h.size for h in hs.values()), default=1)):
        sums = _pass(p, {key: hs[key] for key in keys}, iters, loss, {key: keep[key] for key in keys if key in keep})
        out.update({key: _errors(hs[key], sums[key], p.n_cells[key[1]]) for key in keys})
    return out


@dataclass(frozen=True)
class NmfFit:
    """Gene factors per (run, scope) with the loss after every pass."""

    genes: list[str]
    h: dict[tuple[str, str], np.ndarray]
    history: dict[tuple[str, str], list[float]]
    errors: dict[tuple[str, str], dict]
    loss: str

    def loadings(self, spark) -> DataFrame:
        """loadings(run, scope, factor, gene, loading)."""
        rows = [(run, sc, f, h[:, f].tolist()) for (run, sc), h in self.h.items() for f in range(h.shape[1])]
        packed = spark.createDataFrame(rows, "run string, scope string, factor int, v array<double>")
        names = spark.createDataFrame(list(enumerate(self.genes)), "i int, gene string")
        long = packed.select("run", "scope", "factor", F.posexplode("v").alias("i", "loading"))
        return long.join(names, "i").select("run", "scope", "factor", "gene", "loading")

    def metrics(self, spark) -> DataFrame:
        rows = [(run, sc, f, e["sse"], e["mse"], e["expvar"], float(r)) for (run, sc), e in self.errors.items() for f, r in enumerate(e["factor_r2"])]
        return spark.createDataFrame(rows, "run string, scope string, factor int, sse double, mse double, expvar double, factor_r2 double")


def random_start(n_genes: int, k: int, mean: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.abs(rng.standard_normal((n_genes, k))) * np.sqrt(max(mean, 1e-12) / k) + EPS


def nmf(p: Packed, k: int, iters: int = 20, loss: str = "frobenius", seed: int = 42, runs: int = 1, inner: int = 20,
        init: dict[str, np.ndarray] | None = None, tol: float = 0.0) -> NmfFit:
    """Non-negative factors for every scope and restart.

    Scopes with fewer varying genes or cells than ``k`` are skipped.  ``loss``
    is 'frobenius' or 'kullback-leibler'.
    """
    if loss not in ("frobenius", "kullback-leibler"):
        raise ValueError(f"unknown loss {loss}")
    g = len(p.genes)
    stats = {r.scope: (r.s, r.ng) for r in p.cells.select("scope", F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy("scope", F.col("e.idx").alias("i")).agg(
        F.sum("e.val").alias("t")).groupBy("scope").agg(F.sum("t").alias("s"), F.count(F.lit(1)).alias("ng")).collect()}
    scopes = [s for s, n in p.n_cells.items() if n >= k and s in stats and stats[s][1] >= k]
    start = {}
    for s in scopes:
        for r in range(runs):
            first = init[s] if init and s in init else random_start(g, k, stats[s][0] / (p.n_cells[s] * g), seed + r)
            start[(str(r), s)] = np.asarray(first, dtype=float)
    done, history, errors = {}, {key: [] for key in start}, {}
    for keys in _batched(list(start), g * k):
        hs = {key: start[key] for key in keys}
        live = set(keys)
        for it in range(iters + 1):
            sums = _pass(p, {key: hs[key] for key in live}, inner, loss)
            for key in list(live):
                s, h = sums[key], hs[key]
                errors[key] = _errors(h, s, p.n_cells[key[1]])
                history[key].append(errors[key]["sse" if loss == "frobenius" else "divergence"])
                past = history[key]
                flat = len(past) > 1 and tol > 0 and past[-2] - past[-1] <= tol * max(past[0], EPS)
                if it == iters or flat:
                    live.discard(key)
                    continue
                hs[key] = _update_spectra(h, s, inner, loss)
            if not live:
                break
        done.update(hs)
    return NmfFit(p.genes, done, history, errors, loss)


def nmf_transform(p: Packed, h: dict[tuple[str, str], np.ndarray], iters: int = 100, loss: str = "frobenius",
                  keep: dict[tuple[str, str], np.ndarray] | None = None) -> DataFrame:
    """Usage (run, scope, cell_id, weights) of packed cells for fixed gene factors.

    ``keep`` restricts each factor to a gene subset (boolean per gene).
    """
    ct = p.cells.schema["cell_id"].dataType.simpleString()
    out = None
    size = max((v.size for v in h.values()), default=1)
    for keys in _batched(list(h), size):
        part = {key: h[key] for key in keys}
        mask = {key: keep[key] for key in keys} if keep else {}

        def work(batches: Iterator[pd.DataFrame], part=part, mask=mask) -> Iterator[pd.DataFrame]:
            width = max(v.shape[1] for v in part.values())
            for scope, ids, row, idx, val in _chunks(batches, width):
                for (run, sc), hh in part.items():
                    if sc == scope:
                        w = solve_usage(hh, row, idx, val, len(ids), iters, loss, keep=mask.get((run, sc)))
                        yield pd.DataFrame({"run": run, "scope": sc, "cell_id": ids, "weights": list(w)})

        d = p.cells.mapInPandas(work, f"run string, scope string, cell_id {ct}, weights array<double>")
        out = d if out is None else out.unionByName(d)
    return out


def reconstruct(usage: DataFrame, h: dict[tuple[str, str], np.ndarray], genes: list[str], wanted: list[str]) -> DataFrame:
    """Predicted values of the ``wanted`` genes only: (run, scope, cell_id, gene, value)."""
    at = {g: i for i, g in enumerate(genes)}
    rows = [(run, sc, [(g, [float(x) for x in m[at[g]]]) for g in wanted if g in at]) for (run, sc), m in h.items()]
    side = usage.sparkSession.createDataFrame(rows, "run string, scope string, gs array<struct<gene:string,h:array<double>>>")
    e = usage.join(side, ["run", "scope"]).select("run", "scope", "cell_id", "weights", F.explode("gs").alias("g"))
    dot = F.aggregate(F.zip_with("weights", "g.h", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return e.select("run", "scope", "cell_id", F.col("g.gene").alias("gene"), dot.alias("value"))


def nmf_init_from_clusters(labels: list[int], scores: np.ndarray, means: np.ndarray, sizes: list[int], min_size: int = 5):
    """Starting factors from a clustering: usage 1 in the own cluster else 0.1, spectra from marker scores.

    Negative scores become 0.1, everything is lifted by 0.01, and clusters below
    ``min_size`` cells use their mean profile.
    """
    k = scores.shape[1]
    w = np.full((len(labels), k), 0.1)
    w[np.arange(len(labels)), labels] = 1.0
    h = np.where(scores < 0, 0.1, scores) + 0.01
    for f, n in enumerate(sizes):
        if n < min_size:
            h[:, f] = means[:, f] + 0.01
    return w, h


def init_spectra(deg: DataFrame, means: DataFrame, sizes: DataFrame, min_size: int = 5) -> DataFrame:
    """The spectra half of :func:`nmf_init_from_clusters` as a table: (group, gene, h)."""
    tiny = F.col("n_cells") < min_size
    h = F.when(tiny, F.coalesce("mean_expr", F.lit(0.0))).otherwise(F.when(F.col("scores") < 0, 0.1).otherwise(F.col("scores")))
    return deg.join(means, ["group", "gene"], "left").join(sizes, "group").select("group", "gene", (h + 0.01).alias("h"))


# --- principal components --------------------------------------------------------------------

def _fix_sign(comp: np.ndarray) -> np.ndarray:
    """Largest absolute loading of each component positive; ``comp`` is genes x k."""
    top = comp[np.abs(comp).argmax(0), np.arange(comp.shape[1])]
    return comp * np.where(top < 0, -1.0, 1.0)


def pca(p: Packed, k: int, iters: int = 300, seed: int = 0) -> DataFrame:
    """(scope, factor, gene, loading, mean, explained_variance, ratio) of the k leading components.

    One block Krylov solver for any number of genes and all scopes at once; at most ``iters`` passes over the cells.
    """
    from panelweave.operators.krylov import leading

    schema = "scope string, factor int, gene string, loading double, mean double, explained_variance double, ratio double"
    frames, g = [], len(p.genes)
    for scope, r in leading(p, k, passes=iters, seed=seed).items():
        kk = len(r.values)
        frames.append(pd.DataFrame({
            "scope": scope, "factor": np.repeat(np.arange(kk, dtype="int32"), g), "gene": p.genes * kk, "loading": r.vectors.T.ravel(), "mean": np.tile(r.mean, kk),
            "explained_variance": np.repeat(r.values, g), "ratio": np.repeat(r.values / max(r.trace, 1e-300), g)}))
    # Gene-sized: genes x components x scopes.
    return p.cells.sparkSession.createDataFrame(pd.concat(frames), schema)


def project(expr: DataFrame, cells: DataFrame, loadings: DataFrame, value: str = "value") -> DataFrame:
    """Scores (cell_id, factor, score): (x - mean) times the loadings, over the genes ``loadings`` has.

    Only stored values are joined; the zeros' share is one constant per factor.
    """
    # Gene-sized: written first so that its size is known when it meets the facts.
    loadings = pin(loadings.select("factor", "gene", "loading", "mean"))
    base = loadings.groupBy("factor").agg((-F.sum(F.col("mean") * F.col("loading"))).alias("base"))
    moved = expr.join(loadings.select("gene", "factor", "loading"), "gene").groupBy("cell_id", "factor").agg(
        F.sum(F.col(value) * F.col("loading")).alias("s"))
    arr = base.agg(F.array_sort(F.collect_list(F.struct("factor", "base")))).scalar()
    grid = cells.select("cell_id").withColumn("b", F.explode(arr)).select("cell_id", "b.*")
    return grid.join(moved, ["cell_id", "factor"], "left").select("cell_id", "factor", (F.col("base") + F.coalesce("s", F.lit(0.0))).alias("score"))


def scores_to_vectors(scores: DataFrame) -> DataFrame:
    v = F.transform(F.array_sort(F.collect_list(F.struct("factor", "score"))), lambda s: s["score"])
    return scores.groupBy("cell_id").agg(v.alias("vec"))


def linear_reconstruct(scores: DataFrame, loadings: DataFrame, genes: DataFrame) -> DataFrame:
    """Mean plus scores times loadings for the given genes: (cell_id, gene, value)."""
    side = loadings.join(genes.select("gene"), "gene", "left_semi").select("factor", "gene", "loading", "mean")
    return scores.join(side, "factor").groupBy("cell_id", "gene").agg((F.max("mean") + F.sum(F.col("score") * F.col("loading"))).alias("value"))


# --- independent components ------------------------------------------------------------------

def fastica(p: Packed, k: int, iters: int = 50, seed: int = 0, tol: float = 1e-6) -> tuple[DataFrame, np.ndarray]:
    """Unmixing of the k leading components (log-cosh contrast, symmetric orthogonalisation).

    Returns loadings(scope, factor, gene, loading, mean) with score = (x - mean) . loading,
    and the k x genes mixing matrix that maps scores back to genes.
    """
    if len(p.n_cells) != 1:
        raise ValueError("one scope at a time")
    spark = p.cells.sparkSession
    (scope, n), genes, g = next(iter(p.n_cells.items())), p.genes, len(p.genes)
    pc = pca(p, k).toPandas().sort_values(["factor", "gene"])
    mu = pc[pc["factor"] == 0]["mean"].to_numpy()
    comp = pc["loading"].to_numpy().reshape(-1, g)
    ev = pc.groupby("factor")["explained_variance"].first().to_numpy()
    white = comp / np.sqrt(np.maximum(ev, 1e-12))[:, None]
    shift = white @ mu

    def step(u: np.ndarray):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc, d, seen = np.zeros((k, k)), np.zeros(k), 0
            for _s, ids, row, idx, val in _chunks(batches, k):
                z = _row_sum(val[:, None] * white.T[idx], row, len(ids)) - shift
                t = np.tanh(z @ u.T)
                acc += t.T @ z
                d += (1 - t * t).sum(0)
                seen += len(ids)
            yield pd.DataFrame({"scope": [scope], "v": [np.concatenate([acc.ravel(), d, [float(seen)]])]})

        got = _add_up(_few_tasks(p.cells).mapInPandas(work, "scope string, v array<double>"), ["scope"]).first()
        v = np.zeros(k * k + k + 1) if got is None else np.array(got.v)
        a, d, seen = v[:k * k].reshape(k, k), v[k * k:-1], v[-1]
        # Cells without stored values all sit at the same point.
        rest, z0 = n - seen, -shift
        t0 = np.tanh(u @ z0)
        return (a + rest * np.outer(t0, z0)) / n - ((d + rest * (1 - t0 * t0)) / n)[:, None] * u

    def orth(u):
        val, vec = np.linalg.eigh(u @ u.T)
        return vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-15))) @ vec.T @ u

    u = orth(np.random.default_rng(seed).standard_normal((k, k)))
    for _ in range(iters):
        new = orth(step(u))
        moved = np.max(np.abs(np.abs((new * u).sum(1)) - 1))
        u = new
        if moved < tol:
            break
    unmix = u @ white
    mixing = np.linalg.pinv(unmix).T
    rows = [(scope, f, gname, float(unmix[f, i]), float(mu[i])) for f in range(k) for i, gname in enumerate(genes)]
    return spark.createDataFrame(rows, "scope string, factor int, gene string, loading double, mean double"), mixing


def scaling_factor(expr: DataFrame, subset: DataFrame, cells: DataFrame, value: str = "value") -> DataFrame:
    """One row: mean over cells of total / subset total, 1 where the subset total is 0."""
    tot = expr.groupBy("cell_id").agg(F.sum(value).alias("t"))
    sub = expr.join(subset.select("gene"), "gene", "left_semi").groupBy("cell_id").agg(F.sum(value).alias("s"))
    j = cells.select("cell_id").join(tot, "cell_id", "left").join(sub, "cell_id", "left").na.fill(0.0, ["t", "s"])
    return j.agg(F.avg(F.when(F.col("s") == 0, 1.0).otherwise(F.col("t") / F.col("s"))).alias("scaling_factor"))
