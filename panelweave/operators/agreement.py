"""Classification reports and agreement between two labelings, all from one contingency table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import safe_div


def contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (by, a, b).  Everything below works on this small table."""
    return df.groupBy(*by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return contingency(df, truth, pred).select(F.col("a").alias("truth"), F.col("b").alias("pred"), "n")


def classification_report(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label; zero denominators give 0."""
    c = contingency(df, truth, pred, by)
    hit = F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0))
    true = c.groupBy(*by, F.col("a").alias("label")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    said = c.groupBy(*by, F.col("b").alias("label")).agg(F.sum("n").alias("said"))
    j = true.join(said, [*by, "label"], "full_outer").na.fill(0, ["support", "tp", "said"])
    p, r = safe_div(F.col("tp"), F.col("said")), safe_div(F.col("tp"), F.col("support"))
    return j.select(*by, "label", p.alias("precision"), r.alias("recall"),
                    safe_div(2.0 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support", "tp")


def classification_summary(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro and support-weighted scores."""
    rep = classification_report(df, truth, pred, by)
    s = F.sum("support")

    def w(c):
        return safe_div(F.sum(F.col(c) * F.col("support")), s)

    return rep.groupBy(*by).agg(
        safe_div(F.sum("tp"), s).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"), w("f1").alias("weighted_f1"), w("precision").alias("weighted_precision"),
        w("recall").alias("weighted_recall"),
    )


def _pairs(n):
    return n * (n - 1) / 2.0


def ari(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index."""
    return _ari(contingency(df, a, b, by), by)


def _ari(c: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.col("n").cast("double")
    cells = c.groupBy(*by).agg(F.sum(_pairs(n)).alias("ij"), F.sum(n).alias("t"))
    rows = c.groupBy(*by, "a").agg(F.sum(n).alias("n")).groupBy(*by).agg(F.sum(_pairs(n)).alias("ai"))
    cols = c.groupBy(*by, "b").agg(F.sum(n).alias("n")).groupBy(*by).agg(F.sum(_pairs(n)).alias("bj"))
    j = _attach(_attach(cells, rows, by), cols, by)
    exp = safe_div(F.col("ai") * F.col("bj"), _pairs(F.col("t")))
    top = (F.col("ai") + F.col("bj")) / 2
    return j.select(*by, F.when(top == exp, 1.0).otherwise((F.col("ij") - exp) / (top - exp)).alias("ari"))


def nmi(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Mutual information over the arithmetic mean of the entropies."""
    return _nmi(contingency(df, a, b, by), by)


def _nmi(c: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.col("n").cast("double")
    tot = c.groupBy(*by).agg(F.sum(n).alias("t"))

    def entropy(g, out):
        parts = _attach(c.groupBy(*by, g).agg(F.sum(n).alias("n")), tot, by) if g else _attach(c, tot, by)
        p = F.col("n") / F.col("t")
        return parts.groupBy(*by).agg((-F.sum(p * F.log(p))).alias(out))

    j = _attach(_attach(entropy("a", "ha"), entropy("b", "hb"), by), entropy(None, "hab"), by)
    mi = F.greatest(F.col("ha") + F.col("hb") - F.col("hab"), F.lit(0.0))
    mean = (F.col("ha") + F.col("hb")) / 2
    return j.select(*by, F.when(mean <= 0, 1.0).otherwise(mi / mean).alias("nmi"))


def _attach(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join on ``by``; with no keys ``right`` is one row and its values come as one-value subqueries."""
    if by:
        return left.join(right, list(by))
    return left.withColumns({c: right.select(c).scalar() for c in right.columns})


def celltype_cluster_jaccard(df: DataFrame, celltype: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """For each cell type the cluster of largest overlap, its Jaccard index and purity."""
    return _jaccard(contingency(df, celltype, cluster, by), by)


def _jaccard(c: DataFrame, by: Sequence[str]) -> DataFrame:
    ct = c.groupBy(*by, "a").agg(F.sum("n").alias("n_ct"))
    cl = c.groupBy(*by, "b").agg(F.sum("n").alias("n_cl"))
    j = c.join(ct, [*by, "a"]).join(cl, [*by, "b"])
    # Largest overlap, first cluster name on ties.
    best = F.min(F.struct((-F.col("n")).alias("m"), "b", "n", "n_ct", "n_cl")).alias("x")
    x = j.groupBy(*by, "a").agg(best)
    n = F.col("x.n")
    return x.select(
        *by, F.col("a").alias("celltype"), F.col("x.b").alias("best_cluster"), F.col("x.n_ct").alias("n_cells"),
        (n / (F.col("x.n_ct") + F.col("x.n_cl") - n)).alias("jaccard"), (n / F.col("x.n_cl")).alias("purity"),
    )


def clustering_quality(labels: DataFrame, truth: str = "celltype") -> DataFrame:
    """ARI and NMI for every (dataset, representation, n_clusters) of a long label table.

    ``labels(dataset, representation, n_clusters, cluster, <truth>)``: one row per cell and clustering.
    """
    by = ["dataset", "representation", "n_clusters"]
    c = contingency(labels, truth, "cluster", by)
    return _ari(c, by).join(_nmi(c, by), by)


def clustering_jaccard(labels: DataFrame, truth: str = "celltype") -> DataFrame:
    """Cell-type overlap rows for the finest clustering of each (dataset, representation)."""
    by = ["dataset", "representation"]
    c = contingency(labels, truth, "cluster", [*by, "n_clusters"])
    finest = c.groupBy(*by).agg(F.max("n_clusters").alias("n_clusters"))
    return _jaccard(c.join(finest, [*by, "n_clusters"], "left_semi"), [*by, "n_clusters"])
