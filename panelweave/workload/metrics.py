"""Queries over error metrics, correlations, agreement and averaging operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import agreement as ag
from panelweave.operators import metrics as me
from panelweave.schema import ExprData
from panelweave.workload.standins import EVENT_METRICS, LIN, Query, event_metrics, lin, r6, table


def prediction(expr):
    """A wrong copy of the matrix: values halved, a quarter of the cells shifted by one."""
    cid = F.when(F.pmod("cell_id", F.lit(4)) == 0, F.col("cell_id") + 1).otherwise(F.col("cell_id"))
    return expr.groupBy(cid.alias("cell_id"), "gene").agg(F.sum(F.floor(F.col("value") / 2) + 1).cast("double").alias("value"))


PRED = """
pred AS (SELECT CASE WHEN cell_id % 4 = 0 THEN cell_id + 1 ELSE cell_id END AS cell_id, gene, CAST(SUM(floor(value / 2) + 1) AS DOUBLE) AS value FROM expr GROUP BY 1, 2)
"""
DENSE = f"""
WITH {LIN}, {PRED},
dense AS (SELECT c.cell_id, c.celltype, g.gene, coalesce(e.value, 0) AS x, coalesce(p.value, 0) AS y FROM cells c CROSS JOIN genes g
  LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene LEFT JOIN pred p ON p.cell_id = c.cell_id AND p.gene = g.gene)
"""
_M = """COUNT(*) AS n, round(AVG((x - y) * (x - y)), 6) AS mse, round(AVG(abs(x - y)), 6) AS mae, round(sqrt(AVG((x - y) * (x - y))), 6) AS rmse,
  round(1 - var_pop(x - y) / var_pop(x), 6) AS explained_variance, round(1 - AVG((x - y) * (x - y)) / var_pop(x), 6) AS explained_variance_v2,
  round(1 - SUM((x - y) * (x - y)) / SUM((x - mx) * (x - mx)), 6) AS r2, round(corr(x, y), 6) AS pearson,
  round(SUM(x * y) / (sqrt(SUM(x * x)) * sqrt(SUM(y * y))), 6) AS cosine, round(var_pop(x - y), 6) AS residual_var, round(var_pop(x), 6) AS total_var"""
_COLS = ["mse", "mae", "rmse", "explained_variance", "explained_variance_v2", "r2", "pearson", "cosine", "residual_var", "total_var"]


def _rounded(df, keep):
    return df.select(*keep, "n", *[r6(c).alias(c) for c in _COLS])


def _inside(d):
    """Drop predictions for cells that do not exist."""
    return prediction(d.expr).join(d.cells, "cell_id", "left_semi")


def metrics_per_gene(spark, sf):
    d = lin(spark, sf)
    return _rounded(me.metrics_per_gene(d.expr, _inside(d), d.cells), ["gene"])


PER_GENE = DENSE + f", m AS (SELECT *, AVG(x) OVER (PARTITION BY gene) AS mx FROM dense) SELECT gene, {_M} FROM m GROUP BY gene"


def reconstruction_metrics(spark, sf):
    d = lin(spark, sf)
    return _rounded(me.reconstruction_metrics(d.expr, _inside(d), d.cells, d.genes), ["n_cells", "n_genes"])


RECON = DENSE + f""", m AS (SELECT *, AVG(x) OVER () AS mx FROM dense)
SELECT {_M}, COUNT(DISTINCT cell_id) AS n_cells, COUNT(DISTINCT gene) AS n_genes FROM m"""


def reconstruction_metrics_by_celltype(spark, sf):
    d = lin(spark, sf)
    return _rounded(me.reconstruction_metrics(d.expr, _inside(d), d.cells, d.genes, "celltype"), ["celltype", "n_cells", "n_genes"])


RECON_CT = DENSE + f""", m AS (SELECT *, AVG(x) OVER (PARTITION BY celltype) AS mx FROM dense)
SELECT celltype, {_M}, COUNT(DISTINCT cell_id) AS n_cells, COUNT(DISTINCT gene) AS n_genes FROM m GROUP BY celltype"""


def vector_metrics(spark, sf):
    t = table(spark, sf, "lineitem")
    p = t.select("l_shipdate", "l_returnflag", F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 1500).alias("y"))
    d = me.pair_metrics_flat(p, ["l_returnflag"])
    return d.select("l_returnflag", "n", *[r6(c, 4).alias(c) for c in ("mae", "rmse", "explained_variance", "r2", "pearson", "cosine")])


VECTOR = """
WITH p AS (SELECT l_returnflag, l_extendedprice AS x, l_quantity * 1500 AS y, AVG(l_extendedprice) OVER (PARTITION BY l_returnflag) AS mx FROM lineitem)
SELECT l_returnflag, COUNT(*) AS n, round(AVG(abs(x - y)), 4) AS mae, round(sqrt(AVG((x - y) ** 2)), 4) AS rmse, round(1 - var_pop(x - y) / var_pop(x), 4) AS explained_variance,
 round(1 - SUM((x - y) ** 2) / SUM((x - mx) ** 2), 4) AS r2, round(corr(x, y), 4) AS pearson, round(SUM(x * y) / (sqrt(SUM(x * x)) * sqrt(SUM(y * y))), 4) AS cosine
FROM p GROUP BY l_returnflag
"""


def spearman_per_gene(spark, sf):
    d = lin(spark, sf)
    n = d.cells.agg(F.count(F.lit(1))).scalar()
    return me.spearman(d.expr, _inside(d), n).select("gene", r6("spearman").alias("spearman"))


def _spearman_sql(by):
    return DENSE + f""", r AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY x) + (COUNT(*) OVER (PARTITION BY {by}, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY {by} ORDER BY y) + (COUNT(*) OVER (PARTITION BY {by}, y) - 1) / 2 AS ry FROM dense)
"""


SPEARMAN = _spearman_sql("gene") + "SELECT gene, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY gene"


def spearman_per_cell(spark, sf):
    d = lin(spark, sf)
    n = d.genes.agg(F.count(F.lit(1))).scalar()
    return me.spearman(d.expr, _inside(d), n, "cell_id").filter(F.col("spearman").isNotNull()).select("cell_id", r6("spearman").alias("spearman"))


SPEARMAN_CELL = _spearman_sql("cell_id") + """, s AS (SELECT cell_id, corr(rx, ry) AS c FROM r GROUP BY cell_id)
SELECT cell_id, round(c, 6) AS spearman FROM s WHERE c IS NOT NULL AND NOT isnan(c)"""


def profile_quality(spark, sf):
    d = lin(spark, sf)
    q = me.celltype_profile_quality(d, _inside(d))
    return q.select("celltype", "n_cells", *[r6(c).alias(c) for c in ("pearson", "mse", "explained_variance", "score")])


PROFILE = DENSE + """, p AS (SELECT celltype, gene, AVG(x) AS x, AVG(y) AS y, COUNT(*) AS n_cells FROM dense GROUP BY 1, 2),
m AS (SELECT celltype, n_cells, corr(x, y) AS pearson, AVG((x - y) ** 2) AS mse, 1 - var_pop(x - y) / var_pop(x) AS explained_variance FROM p GROUP BY 1, 2)
SELECT celltype, n_cells, round(pearson, 6) AS pearson, round(mse, 6) AS mse, round(explained_variance, 6) AS explained_variance,
 round(1 - mse / (SELECT MAX(mse) FROM m), 6) AS score FROM m
"""


def macro_mean(spark, sf):
    d = me.macro_mean(event_metrics(spark, sf), ["mse", "expvar"], ["dataset", "fold"])
    return d.select("dataset", "fold", r6("macro_mse").alias("macro_mse"), r6("macro_expvar").alias("macro_expvar"))


MACRO = f"WITH {EVENT_METRICS} SELECT dataset, fold, round(AVG(mse) FILTER (NOT skipped), 6) AS macro_mse, round(AVG(expvar) FILTER (NOT skipped), 6) AS macro_expvar FROM metrics GROUP BY 1, 2"


def weighted_mean(spark, sf):
    d = me.weighted_mean(event_metrics(spark, sf), ["mse", "expvar"], ["dataset"])
    return d.select("dataset", r6("weighted_mse").alias("weighted_mse"), r6("weighted_expvar").alias("weighted_expvar"))


WEIGHTED = f"WITH {EVENT_METRICS} SELECT dataset, round(SUM(mse * n_cells) / SUM(n_cells), 6) AS weighted_mse, round(SUM(expvar * n_cells) / SUM(n_cells), 6) AS weighted_expvar FROM metrics WHERE NOT skipped GROUP BY 1"


def inverse_freq_f1(spark, sf):
    m = event_metrics(spark, sf)
    a = me.inverse_freq_f1(m, ["dataset"], f1="expvar").withColumn("weighting", F.lit("inverse"))
    b = me.inverse_freq_f1(m, ["dataset"], f1="expvar", weighting="log").withColumn("weighting", F.lit("log"))
    return a.unionByName(b).withColumn("inverse_freq_f1", r6("inverse_freq_f1"))


INVF = f"""WITH {EVENT_METRICS}, t AS (SELECT *, SUM(n_cells) OVER (PARTITION BY dataset) AS t FROM metrics)
SELECT dataset, round(SUM(expvar / n_cells) / SUM(1 / n_cells), 6) AS inverse_freq_f1, 'inverse' AS weighting FROM t GROUP BY 1
UNION ALL SELECT dataset, round(SUM(expvar * ln(t / n_cells)) / SUM(ln(t / n_cells)), 6), 'log' FROM t GROUP BY 1"""


def standardized_score(spark, sf):
    d = me.standardized_score(event_metrics(spark, sf), ["dataset", "fold"], ["mse", "expvar", "absent"])
    return d.select("dataset", "fold", "celltype", r6("standardized_score").alias("standardized_score"))


STD_SCORE = f"""WITH {EVENT_METRICS} SELECT dataset, fold, celltype, round((-(mse - AVG(mse) OVER w) / stddev_samp(mse) OVER w + (expvar - AVG(expvar) OVER w) / stddev_samp(expvar) OVER w) / 2, 6) AS standardized_score
FROM metrics WINDOW w AS (PARTITION BY dataset, fold)"""


def fold_aggregate(spark, sf):
    m = event_metrics(spark, sf).withColumn("celltype", F.when(F.col("celltype") != "ct3", F.col("celltype")))
    d = me.fold_aggregate(m, ["mse", "expvar"], ["dataset", "celltype"])
    return d.select("dataset", "celltype", *[r6(c).alias(c) for c in ("mse_mean", "mse_std", "expvar_mean", "expvar_std")])


FOLD = f"""WITH {EVENT_METRICS} SELECT dataset, nullif(celltype, 'ct3') AS celltype, round(AVG(mse), 6) AS mse_mean, round(stddev_samp(mse), 6) AS mse_std,
 round(AVG(expvar), 6) AS expvar_mean, round(stddev_samp(expvar), 6) AS expvar_std FROM metrics GROUP BY 1, 2"""


def mapping_fold_aggregate(spark, sf):
    d = me.mapping_fold_aggregate(event_metrics(spark, sf), ["mse"], ["dataset", "celltype"])
    return d.select("dataset", "celltype", "n_folds", r6("mse_mean").alias("mse_mean"), r6("mse_std").alias("mse_std"))


MAP_FOLD = f"""WITH {EVENT_METRICS} SELECT dataset, celltype, COUNT(*) AS n_folds, round(AVG(mse), 6) AS mse_mean, round(stddev_pop(mse), 6) AS mse_std
FROM metrics WHERE NOT skipped GROUP BY 1, 2"""


def competition_rank(spark, sf):
    d = event_metrics(spark, sf).groupBy("celltype").agg(
        F.round(F.avg("mse"), 1).alias("accuracy"), F.round(F.avg("expvar"), 2).alias("macro_f1"), F.max("n_cells").alias("weighted_f1"),
        F.count_if("skipped").alias("avg_feature_importance"))
    out = me.competition_rank(d, ["accuracy", "macro_f1", "weighted_f1", "avg_feature_importance"])
    return out.select("celltype", *[c for c in out.columns if c.endswith("_rank")])


COMP = f"""WITH {EVENT_METRICS}, d AS (SELECT celltype, round(AVG(mse), 1) AS a, round(AVG(expvar), 2) AS b, MAX(n_cells) AS c, COUNT(*) FILTER (skipped) AS f FROM metrics GROUP BY 1),
r AS (SELECT celltype, rank() OVER (ORDER BY a DESC) AS accuracy_rank, rank() OVER (ORDER BY b DESC) AS macro_f1_rank, rank() OVER (ORDER BY c DESC) AS weighted_f1_rank, rank() OVER (ORDER BY f DESC) AS avg_feature_importance_rank FROM d)
SELECT *, (accuracy_rank + macro_f1_rank + weighted_f1_rank + avg_feature_importance_rank) / 4 AS average_rank FROM r"""


def variability_ratios(spark, sf):
    m = event_metrics(spark, sf)
    n = F.col("n_cells")
    d = m.select("dataset", "celltype", "fold", F.col("mse").alias("mse_train_probe"), (F.when(n % 5 == 0, 0.0).otherwise(F.col("mse") / n)).alias("mse_train_baseline"),
                 (F.col("mse") * 2).alias("mse_test_probe"), (F.col("mse") + n).alias("mse_test_baseline"),
                 F.col("expvar").alias("expvar_train_probe"), (F.col("expvar") - 0.8).alias("expvar_train_baseline"),
                 (F.col("expvar") / 2).alias("expvar_test_probe"), (F.col("expvar") * n / 20).alias("expvar_test_baseline"))
    out = me.variability_ratios(d)
    return out.select("dataset", "celltype", "fold", *[r6(c, 4).alias(c) for c in ("mse_ratio_train", "mse_ratio_test", "expvar_ratio_train", "expvar_ratio_test", "generalization_gap")])


VARRATIO = f"""WITH {EVENT_METRICS}, r AS (SELECT dataset, celltype, fold, CASE WHEN n_cells % 5 = 0 THEN CAST('inf' AS DOUBLE) ELSE mse / (mse / n_cells) END AS a, mse * 2 / (mse + n_cells) AS b,
 CASE WHEN expvar - 0.8 <= 0 THEN 0 ELSE expvar / (expvar - 0.8) END AS c, (expvar / 2) / (expvar * n_cells / 20) AS d FROM metrics)
SELECT dataset, celltype, fold, round(a, 4) AS mse_ratio_train, round(b, 4) AS mse_ratio_test, round(c, 4) AS expvar_ratio_train, round(d, 4) AS expvar_ratio_test, round(b - a, 4) AS generalization_gap FROM r"""


# --- labels ----------------------------------------------------------------------------------

def _labeled(spark, sf):
    t = table(spark, sf, "events")
    kinds = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "spam")])
    other = F.element_at(kinds, (F.pmod("user_id", F.lit(5)) + 1).cast("int"))
    return t.select(
        F.col("event_id").alias("cell_id"), F.col("event_type").alias("truth"), F.concat(F.lit("fold"), F.pmod("event_id", F.lit(3))).alias("fold"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, F.col("event_type")).otherwise(other).alias("pred"))


LABELED = """
lab AS (SELECT event_id AS cell_id, event_type AS truth, 'fold' || (event_id % 3) AS fold, CASE WHEN event_id % 3 = 0 THEN event_type ELSE
 CASE user_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'spam' END END AS pred FROM events)
"""
_REP = """, t AS (SELECT truth AS label, COUNT(*) AS support, COUNT(*) FILTER (truth = pred) AS tp FROM lab GROUP BY 1),
s AS (SELECT pred AS label, COUNT(*) AS said FROM lab GROUP BY 1),
j AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(said, 0) AS said FROM t FULL JOIN s USING (label)),
rep AS (SELECT label, coalesce(tp / nullif(said, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r, 2 * tp / (said + support) AS f1, support, tp FROM j)
"""


def confusion(spark, sf):
    return ag.confusion_matrix(_labeled(spark, sf), "truth", "pred")


def report(spark, sf):
    d = ag.classification_report(_labeled(spark, sf), "truth", "pred")
    return d.select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


def report_summary(spark, sf):
    d = ag.classification_summary(_labeled(spark, sf), "truth", "pred")
    return d.select(*[r6(c).alias(c) for c in d.columns])


def toxic_report(spark, sf):
    lab = table(spark, sf, "labels").withColumn("g", F.pmod("doc_id", F.lit(4)))
    d = ag.classification_summary(lab, "quality", "toxic", ["g"])
    return d.select("g", *[r6(c).alias(c) for c in d.columns if c != "g"])


_SUMM = """round(CAST(SUM(tp) AS DOUBLE) / SUM(support), 6) AS accuracy, round(AVG(f1), 6) AS macro_f1, round(AVG(p), 6) AS macro_precision, round(AVG(r), 6) AS macro_recall,
 round(SUM(f1 * support) / SUM(support), 6) AS weighted_f1, round(SUM(p * support) / SUM(support), 6) AS weighted_precision, round(SUM(r * support) / SUM(support), 6) AS weighted_recall"""
_REP_G = _REP.replace("truth AS label", "g, truth AS label").replace("pred AS label", "g, pred AS label").replace("GROUP BY 1)", "GROUP BY 1, 2)").replace(
    "SELECT label,", "SELECT g, label,").replace("USING (label)", "USING (g, label)")


def ari(spark, sf):
    return ag.ari(_labeled(spark, sf), "truth", "pred", ["fold"]).withColumn("ari", r6("ari"))


ARI = f"""WITH {LABELED}, c AS (SELECT fold, truth, pred, COUNT(*) AS n FROM lab GROUP BY 1, 2, 3),
i AS (SELECT fold, SUM(n * (n - 1) / 2) AS ij, SUM(n) AS t FROM c GROUP BY 1),
a AS (SELECT fold, SUM(n * (n - 1) / 2) AS ai FROM (SELECT fold, truth, SUM(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT fold, SUM(n * (n - 1) / 2) AS bj FROM (SELECT fold, pred, SUM(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT fold, round(CASE WHEN (ai + bj) / 2 = ai * bj / (t * (t - 1) / 2) THEN 1 ELSE (ij - ai * bj / (t * (t - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (t * (t - 1) / 2)) END, 6) AS ari
FROM i JOIN a USING (fold) JOIN b USING (fold)"""


def nmi(spark, sf):
    return ag.nmi(_labeled(spark, sf), "truth", "pred", ["fold"]).withColumn("nmi", r6("nmi"))


NMI = f"""WITH {LABELED}, c AS (SELECT fold, truth, pred, COUNT(*) AS n FROM lab GROUP BY 1, 2, 3),
w AS (SELECT *, SUM(n) OVER (PARTITION BY fold) AS t, SUM(n) OVER (PARTITION BY fold, truth) AS ra, SUM(n) OVER (PARTITION BY fold, pred) AS rb FROM c),
mi AS (SELECT fold, SUM(n / t * ln(n * t / (ra * rb))) AS mi FROM w GROUP BY 1),
ha AS (SELECT fold, -SUM(ra / t * ln(ra / t)) AS h FROM (SELECT DISTINCT fold, truth, ra, t FROM w) GROUP BY 1),
hb AS (SELECT fold, -SUM(rb / t * ln(rb / t)) AS h FROM (SELECT DISTINCT fold, pred, rb, t FROM w) GROUP BY 1)
SELECT fold, round(mi / ((ha.h + hb.h) / 2), 6) AS nmi FROM mi JOIN ha USING (fold) JOIN hb USING (fold)"""


def jaccard(spark, sf):
    d = ag.celltype_cluster_jaccard(_labeled(spark, sf), "truth", "pred")
    return d.select("celltype", "best_cluster", "n_cells", r6("jaccard").alias("jaccard"), r6("purity").alias("purity"))


JACCARD = f"""WITH {LABELED}, c AS (SELECT truth, pred, COUNT(*) AS n FROM lab GROUP BY 1, 2),
w AS (SELECT *, SUM(n) OVER (PARTITION BY truth) AS a, SUM(n) OVER (PARTITION BY pred) AS b, row_number() OVER (PARTITION BY truth ORDER BY n DESC, pred) AS i FROM c)
SELECT truth AS celltype, pred AS best_cluster, CAST(a AS BIGINT) AS n_cells, round(CAST(n / (a + b - n) AS DOUBLE), 6) AS jaccard, round(CAST(n / b AS DOUBLE), 6) AS purity FROM w WHERE i = 1"""


def _clusterings(spark, sf):
    t = table(spark, sf, "events")
    ks = F.explode(F.array(F.lit(3), F.lit(7), F.lit(12))).alias("n_clusters")
    t = t.select("event_id", "user_id", F.col("event_type").alias("celltype"), F.round(F.col("value")).cast("long").alias("v"), ks)
    return t.select(
        F.concat(F.lit("p"), F.pmod("event_id", F.lit(2))).alias("dataset"), F.lit("X_pca").alias("representation"), "n_clusters",
        F.pmod(F.col("user_id") + F.length("celltype") * F.pmod("v", F.lit(4)), F.col("n_clusters")).cast("string").alias("cluster"), "celltype")


CLUSTERINGS = """
cl AS (SELECT 'p' || (event_id % 2) AS dataset, 'X_pca' AS representation, n_clusters,
 CAST((user_id + length(event_type) * (CAST(round(value) AS BIGINT) % 4)) % n_clusters AS VARCHAR) AS cluster, event_type AS celltype
 FROM events, (SELECT unnest([3, 7, 12]) AS n_clusters)),
c AS (SELECT dataset, representation, n_clusters, celltype AS truth, cluster AS pred, COUNT(*) AS n FROM cl GROUP BY 1, 2, 3, 4, 5)
"""


def clustering_quality(spark, sf):
    d = ag.clustering_quality(_clusterings(spark, sf))
    return d.withColumns({"ari": r6("ari"), "nmi": r6("nmi")})


CQ = f"""WITH {CLUSTERINGS},
w AS (SELECT *, SUM(n) OVER k AS t, SUM(n) OVER (PARTITION BY dataset, n_clusters, truth) AS ra, SUM(n) OVER (PARTITION BY dataset, n_clusters, pred) AS rb FROM c WINDOW k AS (PARTITION BY dataset, n_clusters)),
mi AS (SELECT dataset, representation, n_clusters, SUM(n / t * ln(n * t / (ra * rb))) AS mi, SUM(n * (n - 1) / 2) AS ij, MAX(t) AS t FROM w GROUP BY 1, 2, 3),
ha AS (SELECT dataset, n_clusters, -SUM(ra / t * ln(ra / t)) AS h, SUM(ra * (ra - 1) / 2) AS ai FROM (SELECT DISTINCT dataset, n_clusters, truth, ra, t FROM w) GROUP BY 1, 2),
hb AS (SELECT dataset, n_clusters, -SUM(rb / t * ln(rb / t)) AS h, SUM(rb * (rb - 1) / 2) AS bj FROM (SELECT DISTINCT dataset, n_clusters, pred, rb, t FROM w) GROUP BY 1, 2)
SELECT dataset, representation, n_clusters, round(mi / ((ha.h + hb.h) / 2), 6) AS nmi,
 round((ij - ai * bj / (t * (t - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (t * (t - 1) / 2)), 6) AS ari
FROM mi JOIN ha USING (dataset, n_clusters) JOIN hb USING (dataset, n_clusters)"""


def clustering_jaccard(spark, sf):
    d = ag.clustering_jaccard(_clusterings(spark, sf))
    return d.withColumns({"jaccard": r6("jaccard"), "purity": r6("purity")})


CJ = f"""WITH {CLUSTERINGS}, w AS (SELECT *, SUM(n) OVER (PARTITION BY dataset, truth) AS a, SUM(n) OVER (PARTITION BY dataset, pred) AS b,
 row_number() OVER (PARTITION BY dataset, truth ORDER BY n DESC, pred) AS i FROM c WHERE n_clusters = 12)
SELECT dataset, representation, n_clusters, truth AS celltype, pred AS best_cluster, CAST(a AS BIGINT) AS n_cells, round(CAST(n / (a + b - n) AS DOUBLE), 6) AS jaccard,
 round(CAST(n / b AS DOUBLE), 6) AS purity FROM w WHERE i = 1"""

QUERIES = [
    Query("metrics_per_gene", metrics_per_gene, PER_GENE),
    Query("reconstruction_metrics", reconstruction_metrics, RECON),
    Query("reconstruction_metrics_by_celltype", reconstruction_metrics_by_celltype, RECON_CT),
    Query("vector_metrics", vector_metrics, VECTOR),
    Query("spearman_per_gene", spearman_per_gene, SPEARMAN),
    Query("spearman_per_cell", spearman_per_cell, SPEARMAN_CELL),
    Query("celltype_profile_quality", profile_quality, PROFILE),
    Query("macro_mean", macro_mean, MACRO),
    Query("weighted_mean", weighted_mean, WEIGHTED),
    Query("inverse_freq_f1", inverse_freq_f1, INVF),
    Query("standardized_score", standardized_score, STD_SCORE),
    Query("fold_aggregate", fold_aggregate, FOLD),
    Query("mapping_fold_aggregate", mapping_fold_aggregate, MAP_FOLD),
    Query("competition_rank", competition_rank, COMP),
    Query("variability_ratios", variability_ratios, VARRATIO),
    Query("confusion_matrix", confusion, f"WITH {LABELED} SELECT truth, pred, COUNT(*) AS n FROM lab GROUP BY 1, 2"),
    Query("classification_report", report, f"WITH {LABELED}{_REP} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM rep"),
    Query("classification_summary", report_summary, f"WITH {LABELED}{_REP} SELECT {_SUMM} FROM rep"),
    Query("classification_by_group", toxic_report, f"WITH lab AS (SELECT doc_id % 4 AS g, quality AS truth, toxic AS pred FROM labels){_REP_G} SELECT g, {_SUMM} FROM rep GROUP BY g"),
    Query("ari", ari, ARI),
    Query("nmi", nmi, NMI),
    Query("celltype_cluster_jaccard", jaccard, JACCARD),
    Query("clustering_quality", clustering_quality, CQ),
    Query("clustering_jaccard", clustering_jaccard, CJ),
]
