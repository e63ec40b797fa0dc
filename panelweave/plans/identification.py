"""How well cell types can be told apart from each panel's genes alone.

One bounded labelled sample serves all panels: at most ``size`` training and
test rows per cell type.  Every panel is one group of that sample, and all
panels are fitted at once.  A greedy tree that stops at depth d is the top of
the tree that grows on, so each panel grows a single deep tree, and a test row
is labelled at every wanted depth on one way down.  The predictions are a
written table; all scores are aggregations over it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.agreement import classification_report, classification_summary
from panelweave.operators.metrics import competition_rank, inverse_freq_f1
from panelweave.operators.sampling import split_ratio, uniform_samples
from panelweave.schema import ExprData, group_sizes
from panelweave.session import pin

#: Sampled rows per cell type and role, and the depths tried; 30 stands for unlimited.
SAMPLE_SIZE = 500
DEPTHS = (30, 5, 10, 15, 20)
_WIDTH = 64


@dataclass(frozen=True)
class Identification:
    """predictions(dataset, depth, slot, cell_id, celltype, predicted), importances(dataset, depth, gene, importance), and the cells per type."""

    predictions: DataFrame
    importances: DataFrame
    sizes: DataFrame


def _best_split(x: np.ndarray, y: np.ndarray, k: int) -> tuple[float, int, float]:
    """Largest drop of the Gini impurity times rows: gain, column, threshold; the first column and smallest threshold on ties."""
    n, whole = len(y), np.bincount(y, minlength=k).astype(float)
    base, best = n - (whole @ whole) / n, (1e-9, -1, 0.0)
    for lo in range(0, x.shape[1], _WIDTH):
        part = x[:, lo : lo + _WIDTH]
        order = np.argsort(part, axis=0, kind="stable")
        v = np.take_along_axis(part, order, axis=0)
        left = np.cumsum(np.eye(k)[y[order]], axis=0)[:-1]
        m = np.arange(1, n)[:, None]
        impurity = n - (left * left).sum(2) / m - ((whole - left) ** 2).sum(2) / (n - m)
        gain = np.where(v[1:] > v[:-1], base - impurity, -1.0)
        gain = np.round(gain, 9)
        at = gain.argmax(axis=0)
        top = gain[at, np.arange(gain.shape[1])]
        c = int(top.argmax())
        if top[c] > best[0]:
            a, b = v[at[c], c], v[at[c] + 1, c]
            mid = (a + b) / 2
            best = (float(top[c]), lo + c, float(mid if mid < b else a))
    return best


def grow(x: np.ndarray, y: np.ndarray, k: int, depth: int) -> dict[str, np.ndarray]:
    """A tree as arrays by node: column (-1: leaf), threshold, left child, label (most frequent, first on ties), depth, gain."""
    nodes: list[list[float]] = []
    todo = [(np.arange(len(y)), 0, -1, 0)]
    while todo:
        rows, d, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        gain, column, cut = _best_split(x[rows], y[rows], k) if d < depth and len(rows) > 1 and (y[rows] != y[rows[0]]).any() else (0.0, -1, 0.0)
        nodes.append([column, cut, -1, -1, int(np.bincount(y[rows], minlength=k).argmax()), d, gain])
        if column >= 0:
            low = x[rows, column] <= cut
            todo += [(rows[~low], d + 1, me, 1), (rows[low], d + 1, me, 0)]
    a = np.array(nodes)
    whole = ("column", "left", "right", "label", "depth")
    return {name: a[:, i].astype(int) if name in whole else a[:, i] for i, name in enumerate(("column", "cut", "left", "right", "label", "depth", "gain"))}


def labels_at(tree: dict[str, np.ndarray], x: np.ndarray, depths: Sequence[int]) -> dict[int, np.ndarray]:
    """The label of every row at each of the depths."""
    at, out = np.zeros(len(x), int), {}
    for d in range(max(depths) + 1):
        if d in depths:
            out[d] = tree["label"][at]
        inner = tree["column"][at] >= 0
        low = x[np.arange(len(x)), tree["column"][at]] <= tree["cut"][at]
        at = np.where(inner, np.where(low, tree["left"][at], tree["right"][at]), at)
    return out


def identify(data: ExprData, panels: DataFrame, group: str = "celltype", size: int = SAMPLE_SIZE, depths: Sequence[int] = DEPTHS, seed: int = 2020) -> Identification:
    """Fit and apply one tree per panel of ``panels(panel, gene)``.

    4:1 split within types, ``size`` rows per type from either side (with replacement where a type has fewer cells); only
    types with cells on both sides take part.  A panel's task holds its share of the sample: types x 2 x ``size`` rows of
    its genes.  Genes the data lack count as absent; a panel without any gives no row.
    """
    depths = sorted(set(depths))
    roles = pin(split_ratio(data.cells, 4, group, seed))
    both = roles.groupBy(group).agg(F.count_distinct("role").alias("_r")).filter("_r = 2").select(group)
    roles = roles.join(both, group, "left_semi")
    sample = None
    for role in ("train", "test"):
        part = uniform_samples(roles.filter(F.col("role") == role), size, group, seed).withColumn("role", F.lit(role))
        sample = part if sample is None else sample.unionByName(part)
    sample = pin(sample.select("cell_id", F.col(group).cast("string").alias("celltype"), "role", "slot"))
    known = panels.select("panel", "gene").distinct().join(data.genes.select("gene").distinct(), "gene", "left_semi")
    lists = pin(known.groupBy("panel").agg(F.array_sort(F.collect_set("gene")).alias("genes")))
    place = lists.select("panel", F.posexplode("genes").alias("pos", "gene"))
    used = data.expr.join(sample.select("cell_id").distinct(), "cell_id", "left_semi").filter("value <> 0")
    found = used.join(pin(place), "gene").groupBy("panel", "cell_id").agg(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("v"))).alias("x"))
    found = found.select("panel", "cell_id", F.col("x.pos").alias("idx"), F.col("x.v").alias("val"))
    every = sample.withColumn("panel", F.explode(lists.agg(F.collect_list("panel")).scalar()))
    rows = every.join(found, ["panel", "cell_id"], "left").join(lists, "panel")
    ct = data.cells.schema["cell_id"].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        genes = list(pdf["genes"].iloc[0])
        pdf = pdf.sort_values(["role", "celltype", "slot"])
        names = sorted(pdf["celltype"].unique())
        code = {c: i for i, c in enumerate(names)}
        x = np.zeros((len(pdf), len(genes)))
        for i, (idx, val) in enumerate(zip(pdf["idx"], pdf["val"])):
            if idx is not None:
                x[i, np.asarray(idx, int)] = val
        y, train = pdf["celltype"].map(code).to_numpy(), (pdf["role"] == "train").to_numpy()
        tree = grow(x[train], y[train], len(names), max(depths))
        test = pdf[~train]
        out = [pd.DataFrame({"dataset": pdf["panel"].iloc[0], "depth": d, "slot": test["slot"], "cell_id": test["cell_id"], "celltype": test["celltype"],
                             "predicted": [names[i] for i in got], "gene": None, "importance": np.nan}) for d, got in labels_at(tree, x[~train], depths).items()]
        for d in depths:
            inner = (tree["column"] >= 0) & (tree["depth"] < d)
            gain = np.bincount(tree["column"][inner], weights=tree["gain"][inner], minlength=len(genes))
            out.append(pd.DataFrame({"dataset": pdf["panel"].iloc[0], "depth": d, "slot": 0, "cell_id": pdf["cell_id"].iloc[0], "celltype": None, "predicted": None,
                                     "gene": genes, "importance": gain / gain.sum() if gain.sum() > 0 else gain}))
        return pd.concat(out)

    schema = f"dataset string, depth int, slot int, cell_id {ct}, celltype string, predicted string, gene string, importance double"
    done = pin(rows.groupBy("panel").applyInPandas(fit, schema))
    return Identification(done.filter("gene is null").drop("gene", "importance"), done.filter("gene is not null").select("dataset", "depth", "gene", "importance"),
                          group_sizes(data.cells, group).select(F.col(group).cast("string").alias("label"), "n_cells"))


def depth_scores(ident: Identification) -> DataFrame:
    """Scores of every panel at every depth; ``best`` marks the depth of highest macro F1, the first of ``DEPTHS``' order (unlimited first) on ties."""
    by = ["dataset", "depth"]
    report = classification_report(ident.predictions, "celltype", "predicted", by)
    rare = inverse_freq_f1(report.join(ident.sizes, "label"), by)
    order = F.when(F.col("depth") == max(DEPTHS), 0).otherwise(F.col("depth"))
    first = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc(F.round("macro_f1", 12)), order)) == 1
    return classification_summary(ident.predictions, "celltype", "predicted", by).join(rare, by).withColumn("best", first)


def dataset_scores(ident: Identification) -> DataFrame:
    """One row per panel at its best depth, with mean importance and ranks."""
    best = pin(depth_scores(ident).filter("best").drop("best"))
    imp = ident.importances.groupBy("dataset", "depth").agg(F.avg("importance").alias("avg_feature_importance"), F.count(F.lit(1)).alias("n_genes"))
    return competition_rank(best.join(imp, ["dataset", "depth"]).withColumnRenamed("depth", "best_max_depth"), ["accuracy", "macro_f1", "weighted_f1", "avg_feature_importance"])


def label_scores(ident: Identification) -> DataFrame:
    """Precision, recall, F1 and support per panel and cell type at the panel's best depth."""
    best = pin(depth_scores(ident).filter("best").select("dataset", "depth", "macro_f1"))
    rows = ident.predictions.join(best.select("dataset", "depth"), ["dataset", "depth"], "left_semi")
    rep = classification_report(rows, "celltype", "predicted", ["dataset"])
    return rep.join(best.select("dataset", F.col("depth").alias("best_max_depth"), "macro_f1"), "dataset").withColumnRenamed("label", "celltype").drop("tp")


def gene_importances(ident: Identification) -> DataFrame:
    """Importance and rank of every panel gene at the panel's best depth."""
    best = pin(depth_scores(ident).filter("best").select("dataset", "depth"))
    place = Window.partitionBy("dataset").orderBy(F.desc("importance"), "gene")
    return ident.importances.join(best, ["dataset", "depth"], "left_semi").withColumn("rank", F.row_number().over(place)).select("dataset", "gene", "importance", "rank")
