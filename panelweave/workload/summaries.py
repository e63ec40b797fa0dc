"""Queries over summary tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import summaries as su
from panelweave.workload.standins import EVENT_METRICS, PART_PANEL, Query, event_metrics, part_panel, r6, table


def _counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.concat(F.lit("P"), "l_partkey").alias("gene")).agg(
        F.count_distinct(F.pmod("l_orderkey", F.lit(20))).alias("n_selected"),
        F.count_distinct(F.when(F.col("l_returnflag") == "A", F.pmod("l_orderkey", F.lit(20)))).alias("n_rf_pool"),
        F.count_distinct(F.when(F.col("l_returnflag") == "R", F.pmod("l_orderkey", F.lit(20)))).alias("n_nmf_pool"))


_COUNTS = """c AS (SELECT 'P' || l_partkey AS gene, COUNT(DISTINCT l_orderkey % 20) AS n_selected, COUNT(DISTINCT l_orderkey % 20) FILTER (l_returnflag = 'A') AS n_rf_pool,
 COUNT(DISTINCT l_orderkey % 20) FILTER (l_returnflag = 'R') AS n_nmf_pool FROM lineitem GROUP BY 1)"""


def frequency(spark, sf):
    return su.gene_frequency(_counts(spark, sf), 30).select("gene", "n_selected")


def distribution(spark, sf):
    return su.stability_distribution(_counts(spark, sf), 20).withColumn("percent", r6("percent"))


DISTRIBUTION = f"""WITH {_COUNTS}, l AS (SELECT 'n_rf_pool' AS pool, n_rf_pool AS f FROM c UNION ALL SELECT 'n_nmf_pool', n_nmf_pool FROM c), g AS (SELECT pool, f, COUNT(*) AS n FROM l WHERE f > 0 GROUP BY 1, 2),
t AS (SELECT pool, SUM(n) AS t FROM g GROUP BY 1) SELECT t.pool, CAST(k AS INTEGER) AS frequency, coalesce(n, 0) AS n_genes, round(CAST(coalesce(n, 0) AS DOUBLE) / t * 100, 6) AS percent FROM t CROSS JOIN (SELECT unnest(range(1, 21)) AS k) LEFT JOIN g ON g.pool = t.pool AND g.f = k"""


def overlap(spark, sf):
    p = table(spark, sf, "lineitem").select(F.pmod("l_suppkey", F.lit(3)).alias("k_value"), F.col("l_returnflag").alias("method"), F.pmod("l_orderkey", F.lit(6)).alias("iteration"),
                                            F.concat(F.lit("P"), "l_partkey").alias("gene"))
    d = su.selection_overlap(p)
    return d.withColumns({"pairwise_jaccard": r6("pairwise_jaccard"), "intersection_pct": r6("intersection_pct")})


OVERLAP = """WITH p AS (SELECT DISTINCT l_suppkey % 3 AS k_value, l_returnflag AS method, l_orderkey % 6 AS r, l_partkey AS gene FROM lineitem), s AS (SELECT k_value, method, r, COUNT(*) AS n FROM p GROUP BY 1, 2, 3),
x AS (SELECT a.k_value, a.method, a.r AS i, b.r AS j, COUNT(*) AS c FROM p a JOIN p b ON a.k_value = b.k_value AND a.method = b.method AND a.gene = b.gene AND a.r < b.r GROUP BY 1, 2, 3, 4)
SELECT a.k_value, a.method, a.r AS i, b.r AS j, round(coalesce(c, 0) / (a.n + b.n - coalesce(c, 0)), 6) AS pairwise_jaccard, round(coalesce(c, 0) / least(a.n, b.n) * 100, 6) AS intersection_pct
FROM s a JOIN s b ON a.k_value = b.k_value AND a.method = b.method AND a.r < b.r LEFT JOIN x ON x.k_value = a.k_value AND x.method = a.method AND x.i = a.r AND x.j = b.r"""


def k_varying(spark, sf):
    m = event_metrics(spark, sf).select(F.col("fold").alias("k_value"), F.col("dataset").alias("selection_method"), (F.when(F.col("n_cells") % 2 == 0, "nmf").otherwise("cnmf")).alias("eval_method"), "mse", "expvar")
    d = su.k_varying_aggregate(m, ["mse", "expvar"], [("click", "nmf"), ("view", "cnmf"), ("view", "nmf")])
    return d.select("k_value", "selection_method", "eval_method", "n_runs", *[r6(c).alias(c) for c in ("mse_mean", "mse_std", "expvar_mean", "expvar_std")])


K_VARYING = f"""WITH {EVENT_METRICS} SELECT fold AS k_value, dataset AS selection_method, CASE WHEN n_cells % 2 = 0 THEN 'nmf' ELSE 'cnmf' END AS eval_method, COUNT(*) AS n_runs, round(AVG(mse), 6) AS mse_mean,
 round(stddev_samp(mse), 6) AS mse_std, round(AVG(expvar), 6) AS expvar_mean, round(stddev_samp(expvar), 6) AS expvar_std FROM metrics WHERE dataset = 'view' OR (dataset = 'click' AND n_cells % 2 = 0) GROUP BY 1, 2, 3"""


def valid(spark, sf):
    return su.valid_celltypes(event_metrics(spark, sf), 30).withColumn("mean_cells", r6("mean_cells"))


VALID = f"WITH {EVENT_METRICS} SELECT celltype, round(AVG(n_cells), 6) AS mean_cells FROM metrics WHERE NOT skipped AND n_cells >= 30 GROUP BY 1"


def outliers(spark, sf):
    return su.drop_outliers(event_metrics(spark, sf), ["mse", "expvar"], 0.7).select("dataset", "celltype", "fold")


OUTLIERS = f"""WITH {EVENT_METRICS}, a AS (SELECT quantile_cont(mse, 0.25) AS q1, quantile_cont(mse, 0.75) AS q3 FROM metrics), m AS (SELECT metrics.* FROM metrics, a WHERE mse BETWEEN q1 - 0.7 * (q3 - q1) AND q3 + 0.7 * (q3 - q1)),
b AS (SELECT quantile_cont(expvar, 0.25) AS q1, quantile_cont(expvar, 0.75) AS q3 FROM m) SELECT dataset, celltype, fold FROM m, b WHERE expvar BETWEEN q1 - 0.7 * (q3 - q1) AND q3 + 0.7 * (q3 - q1)"""


def improvement(spark, sf):
    m = event_metrics(spark, sf)
    base = m.filter("fold = 0 and celltype = 'ct0'")
    d = su.improvement_summary(m, base, ["dataset"])
    return d.select("dataset", r6("mse_improvement").alias("mse_improvement"), r6("expvar_improvement").alias("expvar_improvement"))


IMPROVEMENT = f"""WITH {EVENT_METRICS}, b AS (SELECT dataset, mse AS bm, expvar AS be FROM metrics WHERE fold = 0 AND celltype = 'ct0')
SELECT dataset, round(AVG((bm - mse) / bm * 100), 6) AS mse_improvement, round(AVG((expvar - be) / abs(be) * 100), 6) AS expvar_improvement FROM metrics JOIN b USING (dataset) GROUP BY 1"""


def _shared(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("gene"), F.when(F.col("l_quantity") > 45, F.col("l_returnflag")).otherwise(F.lit("none")).alias("celltype"))


_SHARED = "s AS (SELECT 'P' || l_partkey AS gene, COUNT(DISTINCT CASE WHEN l_quantity > 45 THEN l_returnflag ELSE 'none' END) AS n FROM lineitem GROUP BY 1)"


def sharing(spark, sf):
    return su.gene_sharing(_shared(spark, sf))


def sharing_summary(spark, sf):
    return su.gene_sharing_summary(_shared(spark, sf)).withColumn("avg_celltypes", r6("avg_celltypes"))


SHARING_SUM = f"WITH {_SHARED} SELECT COUNT(*) AS total, COUNT(*) FILTER (n > 1) AS shared, COUNT(*) FILTER (n = 1) AS \"unique\", MAX(n) AS max_celltypes, round(AVG(n), 6) AS avg_celltypes FROM s"
DATASETS = ["click", "error", "purchase", "signup", "view"]


def f1(spark, sf):
    m = event_metrics(spark, sf).select("celltype", "dataset", "fold", F.col("expvar").alias("f1"))
    d = su.f1_matrix(m, DATASETS, "fold")
    return d.select("celltype", *[r6(c).alias(c) for c in [*DATASETS, "row_mean"]])


F1 = f"WITH {EVENT_METRICS}, f AS (SELECT celltype, dataset, arg_min(expvar, fold) AS f1 FROM metrics WHERE expvar IS NOT NULL GROUP BY 1, 2) SELECT celltype, " + ", ".join(f"round(MAX(f1) FILTER (dataset = '{d}'), 6) AS {d}" for d in DATASETS) + ", round(AVG(f1), 6) AS row_mean FROM f GROUP BY 1"


def preservation(spark, sf):
    m = event_metrics(spark, sf).select("dataset", "celltype", F.col("fold").alias("k"), F.col("expvar").alias("preservation_score"))
    d = su.preservation_matrix(m, [0, 1, 2, 3, 4], "celltype")
    return d.select("dataset", *[r6(F.col(f"`{k}`")).alias(f"k{k}") for k in range(5)])


PRESERVATION = f"WITH {EVENT_METRICS} SELECT dataset, " + ", ".join(f"round(arg_min(expvar, celltype) FILTER (fold = {k} AND expvar IS NOT NULL), 6) AS k{k}" for k in range(5)) + " FROM metrics GROUP BY 1"


def _typed(spark, sf):
    g = F.when(F.col("celltype") == "ct0", "global").otherwise("per_celltype")
    return event_metrics(spark, sf).withColumn("analysis_type", g)


def reshape(spark, sf):
    d = su.results_reshape(_typed(spark, sf), ["mse", "expvar"])
    return d.groupBy("dataset", "analysis_type", "celltype", "metric").agg(r6(F.sum("value")).alias("value"), F.count(F.lit(1)).alias("n"))


RESHAPE = f"""WITH {EVENT_METRICS}, l AS (SELECT *, 'mse' AS metric, mse AS value FROM metrics UNION ALL SELECT *, 'expvar', expvar FROM metrics)
SELECT dataset, CASE WHEN celltype = 'ct0' THEN 'global' ELSE 'per_celltype' END AS analysis_type, celltype, metric, round(SUM(value), 6) AS value, COUNT(*) AS n FROM l WHERE NOT skipped GROUP BY 1, 2, 3, 4"""


def results(spark, sf):
    d = su.results_summary(su.results_reshape(_typed(spark, sf), ["mse", "expvar"]))
    return d.select("dataset", "metric", r6("global_value").alias("global_value"), r6("macro_value").alias("macro_value"), "n_celltypes")


RESULTS = RESHAPE.split("SELECT dataset, CASE")[0] + "SELECT dataset, metric, round(AVG(value) FILTER (celltype = 'ct0'), 6) AS global_value, round(AVG(value) FILTER (celltype <> 'ct0'), 6) AS macro_value, COUNT(*) FILTER (celltype <> 'ct0') AS n_celltypes FROM l WHERE NOT skipped GROUP BY 1, 2"


def lookup(spark, sf):
    m = event_metrics(spark, sf).withColumn("iteration", F.when(F.col("fold") == 0, "summary_mean").when((F.col("fold") == 1) & (F.col("celltype") != "ct4"), "summary_std").otherwise("x"))
    out = None
    for ds in DATASETS:
        d = su.mean_std_lookup(m.filter(F.col("dataset") == ds), "mse").select(F.lit(ds).alias("dataset"), "celltype", r6("mean").alias("mean"), r6("std").alias("std"))
        out = d if out is None else out.unionByName(d)
    return out


LOOKUP = f"WITH {EVENT_METRICS}, v AS (SELECT * FROM metrics) SELECT m.dataset, m.celltype, round(m.mse, 6) AS mean, round(coalesce(s.mse, 0), 6) AS std FROM v m LEFT JOIN v s ON s.dataset = m.dataset AND s.celltype = m.celltype AND s.fold = 1 AND s.celltype <> 'ct4' WHERE m.fold = 0"


def methods(spark, sf):
    m = event_metrics(spark, sf).withColumn("dataset", F.concat_ws("_", "dataset", F.when(F.col("fold") < 2, "100").when(F.col("fold") < 4, "200").otherwise("50"), F.col("fold").cast("string")))
    d = su.method_results(m)
    return d.select("dataset", "n_genes", *[r6(c).alias(c) for c in ("macro_mse", "macro_expvar", "weighted_mse", "weighted_expvar")])


METHODS = f"""WITH {EVENT_METRICS} SELECT dataset || '_' || CASE WHEN fold < 2 THEN '100' WHEN fold < 4 THEN '200' ELSE '50' END || '_' || fold AS dataset, CASE WHEN fold < 2 THEN 100 WHEN fold < 4 THEN 200 END AS n_genes,
 round(AVG(mse), 6) AS macro_mse, round(AVG(expvar), 6) AS macro_expvar, round(SUM(mse * n_cells) / SUM(n_cells), 6) AS weighted_mse, round(SUM(expvar * n_cells) / SUM(n_cells), 6) AS weighted_expvar FROM metrics GROUP BY 1, 2"""

QUERIES = [
    Query("gene_frequency", frequency, f"WITH {_COUNTS} SELECT gene, n_selected FROM c WHERE n_selected > 1 ORDER BY n_selected DESC, gene LIMIT 30"),
    Query("stability_distribution", distribution, DISTRIBUTION), Query("selection_overlap", overlap, OVERLAP), Query("k_varying_aggregate", k_varying, K_VARYING),
    Query("valid_celltypes", valid, VALID), Query("drop_outliers", outliers, OUTLIERS), Query("improvement_pct", improvement, IMPROVEMENT),
    Query("gene_sharing", sharing, f"WITH {_SHARED} SELECT n AS n_celltypes, COUNT(*) AS n_genes FROM s GROUP BY 1"), Query("gene_sharing_summary", sharing_summary, SHARING_SUM),
    Query("f1_matrix", f1, F1), Query("preservation_matrix", preservation, PRESERVATION), Query("results_reshape", reshape, RESHAPE), Query("results_summary", results, RESULTS),
    Query("mean_std_lookup", lookup, LOOKUP), Query("collect_method_results", methods, METHODS),
]
