"""Queries over factorisation and prediction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelweave.operators import consensus as co
from panelweave.operators import factor as fa
from panelweave.operators import predict as pr
from panelweave.plans import evaluation as ev
from panelweave.schema import ExprData
from panelweave.session import pin
from panelweave.workload.standins import EMB, LIN, Query, emb, event_metrics, EVENT_METRICS, lin, part_loadings, loadings_sql, r6, rounded, table



def _fixed_h(genes):
    """A fixed gene factor: h[f](gene) = ((position * (f + 2)) mod 7) + 1."""
    return np.array([[float((i * (f + 2)) % 7 + 1) for f in range(3)] for i in range(len(genes))])


def _small(spark, sf):
    d = lin(spark, sf, "p_type")
    return d, fa.pack(d.expr, d.cells, d.genes)


def nmf_transform(spark, sf):
    _d, p = _small(spark, sf)
    u = fa.nmf_transform(p, {("0", "global"): _fixed_h(p.genes)}, iters=2)
    return u.select("cell_id", *[r6(F.get("weights", F.lit(f))).alias(f"w{f}") for f in range(3)])


_H = f"""g AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS i FROM genes),
h AS (SELECT gene, (i * 2) % 7 + 1 AS h0, (i * 3) % 7 + 1 AS h1, (i * 4) % 7 + 1 AS h2 FROM g),
hh AS (SELECT SUM(h0*h0) AS a00, SUM(h0*h1) AS a01, SUM(h0*h2) AS a02, SUM(h1*h1) AS a11, SUM(h1*h2) AS a12, SUM(h2*h2) AS a22 FROM h),
n AS (SELECT cell_id, SUM(value*h0) AS n0, SUM(value*h1) AS n1, SUM(value*h2) AS n2 FROM expr JOIN h USING (gene) GROUP BY 1),
w1 AS (SELECT n.*, hh.*, n0/(a00+a01+a02+1e-8) AS u0, n1/(a01+a11+a12+1e-8) AS u1, n2/(a02+a12+a22+1e-8) AS u2 FROM n, hh)"""
from panelweave.workload.standins import lin_sql  # noqa: E402

TRANSFORM = f"""WITH {lin_sql('p_type')}, {_H} SELECT cell_id, round(u0*n0/(u0*a00+u1*a01+u2*a02+1e-8), 6) AS w0, round(u1*n1/(u0*a01+u1*a11+u2*a12+1e-8), 6) AS w1,
 round(u2*n2/(u0*a02+u1*a12+u2*a22+1e-8), 6) AS w2 FROM w1"""


def nmf_transform_kl(spark, sf):
    _d, p = _small(spark, sf)
    u = fa.nmf_transform(p, {("0", "global"): _fixed_h(p.genes)}, iters=1, loss="kullback-leibler")
    return u.select("cell_id", *[r6(F.get("weights", F.lit(f))).alias(f"w{f}") for f in range(3)])


TRANSFORM_KL = f"""WITH {lin_sql('p_type')}, g AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS i FROM genes), h AS (SELECT gene, (i * 2) % 7 + 1 AS h0, (i * 3) % 7 + 1 AS h1, (i * 4) % 7 + 1 AS h2 FROM g),
s AS (SELECT SUM(h0) AS s0, SUM(h1) AS s1, SUM(h2) AS s2 FROM h)
SELECT cell_id, round(SUM(value/(h0+h1+h2)*h0)/(s0+1e-8), 6) AS w0, round(SUM(value/(h0+h1+h2)*h1)/(s1+1e-8), 6) AS w1, round(SUM(value/(h0+h1+h2)*h2)/(s2+1e-8), 6) AS w2
FROM expr JOIN h USING (gene), s GROUP BY cell_id, s0, s1, s2"""


def nmf_global(spark, sf):
    d = lin(spark, sf)
    fit = fa.nmf(fa.pack(d.expr, d.cells, d.genes), 4, iters=8, loss="kullback-leibler", inner=10)
    return fit.loadings(spark)


def nmf_per_celltype(spark, sf):
    d = lin(spark, sf)
    return fa.nmf(fa.pack(d.expr, d.cells, d.genes, "celltype", min_cells=10), 3, iters=6).metrics(spark)


def nmf_init(spark, sf):
    from panelweave.operators.markers import rank_genes_ttest
    from panelweave.operators.quality import mean_expr_by_celltype
    from panelweave.schema import group_sizes

    d = lin(spark, sf)
    deg = rank_genes_ttest(d)
    means = mean_expr_by_celltype(d).withColumnRenamed("celltype", "group")
    sizes = group_sizes(d.cells).withColumnRenamed("celltype", "group").withColumn("n_cells", F.when(F.col("group") == "2-HIGH", 3).otherwise(F.col("n_cells")))
    return fa.init_spectra(deg, means, sizes).withColumn("h", r6("h"))


INIT = f"""WITH {LIN}, dense AS (SELECT c.celltype, g.gene, coalesce(e.value, 0) AS v FROM cells c CROSS JOIN genes g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene),
k AS (SELECT DISTINCT celltype AS grp FROM cells),
s AS (SELECT grp, gene, AVG(v) FILTER (celltype = grp) AS m1, AVG(v) FILTER (celltype <> grp) AS m2, var_samp(v) FILTER (celltype = grp) / COUNT(*) FILTER (celltype = grp) AS a,
 var_samp(v) FILTER (celltype <> grp) / COUNT(*) FILTER (celltype <> grp) AS b FROM dense, k GROUP BY 1, 2)
SELECT grp AS "group", gene, round(CASE WHEN grp = '2-HIGH' THEN m1 WHEN m1 < m2 THEN 0.1 ELSE (m1 - m2) / sqrt(a + b) END + 0.01, 6) AS h FROM s"""


def pca_global(spark, sf):
    d = emb(spark, sf)
    return fa.pca(fa.pack(d.expr, d.cells, d.genes), 5)


def pca_per_celltype(spark, sf):
    d = lin(spark, sf)
    l = fa.pca(fa.pack(d.expr, d.cells, d.genes, "celltype", min_cells=10), 3)
    return l.select("scope", "factor", "gene", "loading", "ratio")


def variability_summary(spark, sf):
    t = event_metrics(spark, sf)
    n = F.col("n_cells")
    rows = t.select("dataset", "celltype", "fold", F.col("mse").alias("mse_test_probe"), (F.col("mse") / 2).alias("mse_test_baseline"), F.col("expvar").alias("expvar_test_probe"),
                    (F.col("expvar") * n / 50).alias("expvar_test_baseline"), "n_cells", "skipped")
    d = ev.variability_summary(rows)
    return d.select("dataset", "fold", "total_cells", "n_celltypes_processed", "n_celltypes_skipped", *[r6(c).alias(c) for c in sorted(d.columns) if c.startswith(("weighted", "macro"))])


_V = {"mse_test_probe": "mse", "mse_test_baseline": "mse / 2", "expvar_test_probe": "expvar", "expvar_test_baseline": "expvar * n_cells / 50"}
VAR_SUMMARY = f"WITH {EVENT_METRICS} SELECT dataset, fold, CAST(SUM(n_cells) FILTER (NOT skipped) AS BIGINT) AS total_cells, COUNT(*) FILTER (NOT skipped) AS n_celltypes_processed, COUNT(*) FILTER (skipped) AS n_celltypes_skipped, " + ", ".join(
    f"round(SUM({e} * n_cells) FILTER (NOT skipped) / SUM(n_cells) FILTER (NOT skipped), 6) AS weighted_{n}, round(AVG({e}) FILTER (NOT skipped), 6) AS macro_{n}" for n, e in _V.items()) + " FROM metrics GROUP BY 1, 2"


def pca_variance(spark, sf):
    """Properties of a full decomposition that SQL can state: total variance and unit lengths."""
    d = emb(spark, sf)
    l = fa.pca(fa.pack(d.expr, d.cells, d.genes, "celltype"), 64)
    per = l.groupBy("scope", "factor").agg(F.max("explained_variance").alias("ev"), F.sum(F.col("loading") * F.col("loading")).alias("len"))
    return per.groupBy("scope").agg(r6(F.sum("ev"), 5).alias("total_variance"), r6(F.min("len"), 5).alias("min_length"), r6(F.max("len"), 5).alias("max_length"))


PCA_VAR = f"""WITH {EMB}, v AS (SELECT celltype, gene, var_samp(value) AS v FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2)
SELECT celltype AS scope, round(SUM(v), 5) AS total_variance, 1.0::DOUBLE AS min_length, 1.0::DOUBLE AS max_length FROM v GROUP BY 1"""


def _given_loadings(spark, sf, d):
    """Loadings derived from the data: factor f of a gene is a fixed function of its position."""
    mean = d.expr.groupBy("gene").agg(F.avg("value").alias("mean"))
    pos = F.substring("gene", 2, 3).cast("int")
    l = mean.withColumn("factor", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return l.select("factor", "gene", ((pos * (F.col("factor") + 3) % 11) / 10.0 - 0.5).alias("loading"), "mean")


def pca_predict(spark, sf):
    d = emb(spark, sf)
    l = _given_loadings(spark, sf, d)
    s = fa.project(d.expr.filter("gene < 'g050'"), d.cells, l.filter("gene < 'g050'"))
    return fa.linear_reconstruct(s, l, d.genes.filter("gene >= 'g060'")).withColumn("value", r6("value"))


PCA_PREDICT = f"""WITH {EMB}, mu AS (SELECT gene, AVG(value) AS mean FROM expr GROUP BY gene),
l AS (SELECT f, gene, mean, (CAST(substr(gene, 2) AS INTEGER) * (f + 3) % 11) / 10.0 - 0.5 AS loading FROM mu, (SELECT unnest([0, 1, 2]) AS f)),
s AS (SELECT cell_id, f, SUM((value - mean) * loading) AS s FROM expr JOIN l USING (gene) WHERE gene < 'g050' GROUP BY 1, 2)
SELECT cell_id, gene, round(MAX(mean) + SUM(s * loading), 6) AS value FROM s JOIN l USING (f) WHERE gene >= 'g060' GROUP BY 1, 2"""


def fastica(spark, sf):
    d = emb(spark, sf)
    l, _m = fa.fastica(fa.pack(d.expr, d.cells, d.genes), 3, iters=15)
    return l


def scaling_factor(spark, sf):
    d = lin(spark, sf)
    return fa.scaling_factor(d.expr, d.genes.filter("gene like 'Brand#1%'"), d.cells).withColumn("scaling_factor", r6("scaling_factor"))


SCALING = f"""WITH {LIN}, t AS (SELECT c.cell_id, coalesce(SUM(value), 0) AS t, coalesce(SUM(value) FILTER (gene LIKE 'Brand#1%'), 0) AS s FROM cells c LEFT JOIN expr USING (cell_id) GROUP BY 1)
SELECT round(AVG(CASE WHEN s = 0 THEN 1 ELSE t / s END), 6) AS scaling_factor FROM t"""


def feature_map(spark, sf):
    t = table(spark, sf, "part")
    m = t.select(F.concat(F.lit("P"), "p_partkey").alias("gene_fit"), F.concat(F.lit("q"), F.pmod("p_partkey", F.lit(1500))).alias("gene_query"))
    fit = t.filter("p_partkey % 10 > 0").select(F.concat(F.lit("P"), "p_partkey").alias("gene"))
    qg = t.select(F.concat(F.lit("q"), F.col("p_partkey") * 2).alias("gene"))
    return pr.validate_feature_map(m, fit, qg)


FEATURE_MAP = """WITH m AS (SELECT 'P' || p_partkey AS f, 'q' || (p_partkey % 1500) AS q, p_partkey FROM part)
SELECT COUNT(*) AS n, COUNT(DISTINCT f) AS n_fit, COUNT(DISTINCT q) AS n_query, COUNT(*) FILTER (p_partkey % 10 = 0) AS n_unknown,
 (SELECT COUNT(*) FROM part WHERE 'q' || (p_partkey * 2) NOT IN (SELECT q FROM m)) AS n_unmapped, false AS valid FROM m"""


def _halves(spark, sf):
    d = emb(spark, sf)
    t = table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"))
    a, b = t.filter("cell_id % 2 = 0"), t.filter("cell_id % 2 = 1")
    dens = b.select("cell_id", ((F.pmod("cell_id", F.lit(5)) + 1) / 10.0).alias("density"))
    return d, a, b, dens


def mapping_weights(spark, sf):
    _d, a, b, dens = _halves(spark, sf)
    return pr.mapping_weights(a, b, dens).withColumn("weight", rounded("weight", 8))


_MAP = """a AS (SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id AS spot_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % 2 = 1),
s AS (SELECT cell_id, spot_id, exp(list_cosine_similarity(a.vec, b.vec)) * ((spot_id % 5 + 1) / 10.0) AS e FROM a CROSS JOIN b),
w AS (SELECT cell_id, spot_id, e / SUM(e) OVER (PARTITION BY cell_id) AS weight FROM s)"""


def project_mapping(spark, sf):
    d, a, b, dens = _halves(spark, sf)
    return pr.softmax_projection(a, b, d.expr, dens, training=d.genes.filter("gene < 'g010'")).withColumn("value", r6("value"))


def project_mapping_weights(spark, sf):
    """The same from a given weight matrix, held as its factors."""
    d, a, b, dens = _halves(spark, sf)
    return pr.project_mapping(pr.mapping(a, b, dens), d.expr, d.genes.filter("gene < 'g010'")).withColumn("value", r6("value"))


PROJECT = f"WITH {EMB}, {_MAP} SELECT spot_id, gene, round(SUM(weight * value), 6) AS value, gene < 'g010' AS is_training FROM w JOIN expr USING (cell_id) GROUP BY 1, 2"


def mapping_scores(spark, sf):
    d, a, b, dens = _halves(spark, sf)
    p = pr.softmax_projection(a, b, d.expr, dens)
    sp = ExprData(d.expr.filter("cell_id % 2 = 1"), d.cells.filter("cell_id % 2 = 1"), d.genes)
    sc = ExprData(d.expr.filter("cell_id % 2 = 0").withColumn("value", F.when(F.col("value") > 0, F.col("value")).otherwise(0.0)), d.cells.filter("cell_id % 2 = 0"), d.genes)
    m = pr.mapping_gene_scores(p, sp, sc)
    return m.select("gene", *[r6(c).alias(c) for c in m.columns[1:]])


MAP_SCORES = f"""WITH {EMB}, {_MAP}, p AS (SELECT spot_id, gene, SUM(weight * value) AS y FROM w JOIN expr USING (cell_id) GROUP BY 1, 2),
c AS (SELECT p.gene, SUM(value * y) / sqrt(SUM(value * value) * SUM(y * y)) AS s FROM p JOIN expr e ON e.cell_id = spot_id AND e.gene = p.gene GROUP BY 1),
z AS (SELECT gene, 1 - COUNT(*) FILTER (cell_id % 2 = 0 AND value > 0) / COUNT(*) FILTER (cell_id % 2 = 0) AS sc, 1 - COUNT(*) FILTER (cell_id % 2 = 1 AND value <> 0) / COUNT(*) FILTER (cell_id % 2 = 1) AS sp FROM expr GROUP BY 1)
SELECT gene, round(s, 6) AS train_score, round(sc, 6) AS sparsity_sc, round(sp, 6) AS sparsity_sp, round(sp - sc, 6) AS sparsity_diff FROM c JOIN z USING (gene)"""


def density_priors(spark, sf):
    d = lin(spark, sf)
    p = pr.density_priors(d.cells, d.expr)
    return p.select("cell_id", r6("uniform_density", 10).alias("uniform_density"), r6("rna_count_density", 10).alias("rna_count_density"))


PRIORS = f"WITH {LIN}, t AS (SELECT c.cell_id, coalesce(SUM(value), 0) AS t FROM cells c LEFT JOIN expr USING (cell_id) GROUP BY 1) SELECT cell_id, round(1 / COUNT(*) OVER (), 10) AS uniform_density, round(t / SUM(t) OVER (), 10) AS rna_count_density FROM t"


def holdout(spark, sf):
    d = lin(spark, sf)
    q = ExprData(d.expr.filter("cell_id % 2 = 0"), d.cells.filter("cell_id % 2 = 0"), d.genes)
    r = ExprData(d.expr.filter("cell_id % 2 = 1"), d.cells.filter("cell_id % 2 = 1"), d.genes)
    out = pr.holdout_gene_experiment(q, r)
    return pr.correlation_medians(pin(out), ("cluster",))


def predictors(spark, sf):
    d = emb(spark, sf)
    e = d.expr.withColumn("value", F.abs("value"))
    train = ExprData(e.filter("cell_id % 5 > 0"), d.cells.filter("cell_id % 5 > 0"), d.genes)
    qe, qc = e.filter("cell_id % 5 = 0"), d.cells.filter("cell_id % 5 = 0")
    seen, hidden = d.genes.filter("gene < 'g060'"), d.genes.filter("gene >= 'g060'")
    out = None
    for name, m in (("pca", pr.PcaPredictor(3)), ("nmf", pr.NmfPredictor(3, iters=5)), ("fastica", pr.FastIcaPredictor(3, iters=10))):
        _s, pred = m.fit(train).predict(qe, qc, seen, hidden)
        pred = pred.select(F.lit(name).alias("model"), "cell_id", "gene", "value")
        out = pred if out is None else out.unionByName(pred)
    return out


# --- consensus -------------------------------------------------------------------------------


def _spectra(spark, sf):
    l = part_loadings(spark, sf).withColumn("loading", F.abs("loading") + 1)
    return l.select(F.col("scope").alias("run"), "factor", "gene", "loading")


def density(spark, sf):
    t = table(spark, sf, "embeddings").select((F.col("vec_id") % 10).cast("string").alias("run"), F.floor(F.col("vec_id") / 10).cast("int").alias("factor"), F.posexplode("embedding").alias("g", "v"))
    l = t.select("run", "factor", F.concat(F.lit("g"), F.lpad(F.col("g").cast("string"), 3, "0")).alias("gene"), F.col("v").cast("double").alias("loading"))
    d = co.local_density(co.unit_spectra(l), 50)
    return co.keep_dense(d, 5, 0.6).select("spectrum", r6("density").alias("density"), r6("scaled").alias("scaled"))


DENSITY = """WITH s AS (SELECT (vec_id % 10) || '/' || (vec_id // 10) AS spectrum, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT spectrum, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM s),
d AS (SELECT a.spectrum, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.spectrum ORDER BY list_distance(a.v, b.v)) AS i FROM u a CROSS JOIN u b QUALIFY i <= 15),
m AS (SELECT spectrum, AVG(d) AS density FROM d GROUP BY 1), z AS (SELECT *, (density - MIN(density) OVER ()) / (MAX(density) OVER () - MIN(density) OVER () + 1e-10) AS scaled FROM m)
SELECT spectrum, round(density, 6) AS density, round(scaled, 6) AS scaled FROM z WHERE scaled < 0.6 OR (SELECT COUNT(*) FROM z WHERE scaled < 0.6) < 5"""


def median_spectra(spark, sf):
    l = _spectra(spark, sf)
    c = l.select(F.concat_ws("/", "run", F.col("factor").cast("string")).alias("spectrum"), F.pmod(F.length("run") + F.col("factor"), F.lit(3)).alias("cluster")).distinct()
    return co.median_spectra(l, c).withColumn("loading", r6("loading", 8))


MEDIAN = f"""WITH {loadings_sql()}, m AS (SELECT (length(scope) + factor) % 3 AS cluster, gene, quantile_cont(abs(loading) + 1, 0.5) AS m FROM loadings GROUP BY 1, 2)
SELECT cluster, gene, round(m / (SUM(m) OVER (PARTITION BY cluster) + 1e-10), 8) AS loading FROM m"""


def consensus(spark, sf):
    d = lin(spark, sf, "p_type")
    spectra, metrics = co.consensus_nmf(fa.pack(d.expr, d.cells, d.genes), [2, 3], runs=4, iters=3, inner=5)
    return spectra


def k_metrics(spark, sf):
    m = event_metrics(spark, sf).select(F.col("fold").alias("k"), F.col("mse").alias("error"), F.col("expvar").alias("silhouette"))
    d = co.k_selection_metrics(m)
    return d.select("k", "n_runs", *[r6(c).alias(c) for c in ("mean_error", "std_error", "silhouette")])


K_METRICS = f"WITH {EVENT_METRICS} SELECT fold AS k, COUNT(*) AS n_runs, round(AVG(mse), 6) AS mean_error, round(stddev_pop(mse), 6) AS std_error, round(AVG(expvar), 6) AS silhouette FROM metrics GROUP BY 1"


def nmf_reconstruction(spark, sf):
    d = lin(spark, sf)
    panels = d.genes.withColumn("panel", F.explode(F.array(F.lit("odd"), F.lit("low")))).filter("panel = 'low' and gene < 'Brand#20' or panel = 'odd' and substring(gene, -1) in ('1','3','5','7','9')")
    splits = d.cells.select("cell_id", F.when(F.pmod("cell_id", F.lit(5)) == 0, "test").otherwise("train").alias("role"), F.lit(0).alias("fold"))
    return ev.nmf_variability(d, panels, splits, 3, fit_iters=4)


def nmf_reconstruction_by_celltype(spark, sf):
    d = lin(spark, sf)
    panels = d.genes.filter("gene < 'Brand#20'").withColumn("panel", F.lit("low"))
    splits = d.cells.select("cell_id", F.when(F.pmod("cell_id", F.lit(5)) == 0, "test").otherwise("train").alias("role"), F.lit(0).alias("fold"))
    return ev.nmf_variability(d, panels, splits, 3, scope="celltype", fit_iters=3)


QUERIES = [
    Query("nmf_transform", nmf_transform, TRANSFORM), Query("nmf_transform_kl", nmf_transform_kl, TRANSFORM_KL),
    Query("nmf_global", nmf_global), Query("nmf_per_celltype", nmf_per_celltype), Query("nmf_init", nmf_init, INIT),
    Query("pca_global", pca_global), Query("pca_per_celltype_variance", pca_variance, PCA_VAR), Query("pca_predict", pca_predict, PCA_PREDICT),
    Query("pca_per_celltype", pca_per_celltype), Query("variability_summary", variability_summary, VAR_SUMMARY), Query("fastica", fastica), Query("scaling_factor", scaling_factor, SCALING), Query("validate_feature_map", feature_map, FEATURE_MAP),
    Query("mapping_weights", mapping_weights, "WITH " + _MAP + " SELECT cell_id, spot_id, round(weight, 8) AS weight FROM w"), Query("project_mapping", project_mapping, PROJECT), Query("project_mapping_weights", project_mapping_weights, PROJECT),
    Query("mapping_gene_scores", mapping_scores, MAP_SCORES), Query("density_priors", density_priors, PRIORS),
    Query("holdout_gene_experiment", holdout), Query("predictors", predictors),
    Query("consensus_density", density, DENSITY), Query("consensus_median_spectra", median_spectra, MEDIAN), Query("consensus_nmf", consensus),
    Query("k_selection_metrics", k_metrics, K_METRICS),
    Query("nmf_reconstruction", nmf_reconstruction), Query("nmf_reconstruction_by_celltype", nmf_reconstruction_by_celltype),
]
