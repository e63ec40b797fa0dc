"""Queries over neighbours, clustering and label transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import clustering as cl
from panelweave.operators import neighbors as nb
from panelweave.operators import quality as q
from panelweave.session import pin
from panelweave.workload.standins import EMB, EVENT_METRICS, Query, emb, event_metrics, loadings_sql, part_loadings, r6, table


def _vecs(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"))


def _vec_sql(name, src="embeddings", cond="true", dims=None):
    e = "embedding" if dims is None else f"embedding[1:{dims}]"
    return f"{name} AS (SELECT vec_id AS cell_id, CAST({e} AS DOUBLE[]) AS vec, label FROM {src} WHERE {cond})"


def _knn_sql(name, a, b, k, self_ok=False):
    cond = "" if self_ok else "WHERE x.cell_id <> y.cell_id"
    return f"""{name} AS (SELECT x.cell_id, y.cell_id AS neighbor, list_distance(x.vec, y.vec) AS dist, row_number() OVER (PARTITION BY x.cell_id ORDER BY list_distance(x.vec, y.vec), y.cell_id) AS rank
 FROM {a} x CROSS JOIN {b} y {cond} QUALIFY rank <= {k})"""


def knn_graph(spark, sf):
    return nb.knn_graph(_vecs(spark, sf)).withColumn("dist", r6("dist"))


KNN = f"WITH {_vec_sql('v')}, {_knn_sql('e', 'v', 'v', 50)} SELECT cell_id, neighbor, round(dist, 6) AS dist, rank FROM e"


def shuffle(spark, sf):
    d = emb(spark, sf)
    s = nb.shuffle_sources(_vecs(spark, sf), 6)
    return nb.shuffle_by_neighbors(d.expr, s).select("cell_id", "gene", r6("value").alias("value"))


SHUFFLE = f"""WITH {EMB}, {_vec_sql('v')}, {_knn_sql('e', 'v', 'v', 6, True)}, s AS (SELECT cell_id, arg_min(neighbor, md5(cell_id || ':42:' || neighbor)) AS source FROM e GROUP BY 1)
SELECT s.cell_id, gene, round(value, 6) AS value FROM s JOIN expr ON expr.cell_id = source"""


def _two_graphs(spark, sf):
    v = _vecs(spark, sf)
    d = emb(spark, sf)
    small = nb.vectors(d.expr, d.cells, d.genes.filter("gene < 'g016'"))
    return pin(nb.knn_graph(v, 50)), pin(nb.knn_graph(small, 50)), d.cells


def preservation(spark, sf):
    a, b, cells = _two_graphs(spark, sf)
    every = nb.neighborhood_preservation(a, b, cells).withColumn("celltype", F.lit("all"))
    per = nb.neighborhood_preservation(a, b, cells, celltype="celltype")
    return every.unionByName(per).withColumn("preservation_score", r6("preservation_score"))


_PRES = f"""{_vec_sql('v')}, {_vec_sql('w', dims=16)}, {_knn_sql('a', 'v', 'v', 50)}, {_knn_sql('b', 'w', 'w', 50)},
ks AS (SELECT unnest([5, 10, 15, 20, 30, 50]) AS k),
i AS (SELECT a.cell_id, k, COUNT(*) AS n FROM a JOIN b USING (cell_id, neighbor), ks WHERE a.rank <= k AND b.rank <= k GROUP BY 1, 2),
j AS (SELECT v.cell_id, 'c' || label AS celltype, ks.k, coalesce(n, 0) / (2 * ks.k - coalesce(n, 0)) AS jac FROM v CROSS JOIN ks LEFT JOIN i ON i.cell_id = v.cell_id AND i.k = ks.k)"""
PRES = f"WITH {_PRES} SELECT k, round(AVG(jac), 6) AS preservation_score, COUNT(*) AS n_cells, 'all' AS celltype FROM j GROUP BY k UNION ALL SELECT k, round(AVG(jac), 6), COUNT(*), celltype FROM j GROUP BY k, celltype"


def preservation_table(spark, sf):
    a, b, cells = _two_graphs(spark, sf)
    s = pin(nb.neighborhood_preservation(a, b, cells, celltype="celltype"))
    return nb.optimal_k(s, ("celltype",)).withColumn("preservation_score", r6("preservation_score"))


PRES_T = f"""WITH {_PRES}, s AS (SELECT celltype, k, AVG(jac) AS sc FROM j GROUP BY 1, 2), o AS (SELECT celltype, k AS ok, sc AS top FROM s QUALIFY row_number() OVER (PARTITION BY celltype ORDER BY sc DESC, k) = 1)
SELECT celltype, CAST(k AS VARCHAR) AS k, round(sc, 6) AS preservation_score, k = ok AS is_optimal, ok AS optimal_k FROM s JOIN o USING (celltype)
UNION ALL SELECT celltype, 'optimal', round(top, 6), true, ok FROM o"""


def label_transfer(spark, sf):
    t = table(spark, sf, "embeddings")
    v = _vecs(spark, sf)
    labels = t.filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("cell_id"), F.when(F.col("vec_id") % 11 != 0, F.concat(F.lit("c"), "label")).alias("celltype"))
    return nb.label_transfer(v.filter("cell_id % 3 = 0"), v, labels, 15).withColumn("confidence", r6("confidence"))


TRANSFER = f"""WITH {_vec_sql('q', cond='vec_id % 3 = 0')}, {_vec_sql('r', cond='vec_id % 3 <> 0 AND vec_id % 11 <> 0')}, {_knn_sql('e', 'q', 'r', 15)},
vt AS (SELECT e.cell_id, 'c' || label AS l, COUNT(*) AS n FROM e JOIN r ON r.cell_id = e.neighbor GROUP BY 1, 2)
SELECT cell_id, l AS predicted, round(n / 15, 6) AS confidence FROM vt QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, l) = 1"""


def label_centroid(spark, sf):
    t = table(spark, sf, "embeddings")
    v = _vecs(spark, sf)
    labels = t.filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("cell_id"), F.concat(F.lit("c"), "label").alias("celltype"))
    return nb.label_transfer_centroid(v.filter("cell_id % 3 = 0"), v, labels).withColumn("dist", r6("dist"))


CENTROID = f"""WITH {_vec_sql('q', cond='vec_id % 3 = 0')}, {EMB}, m AS (SELECT celltype, gene, AVG(value) AS m FROM expr JOIN cells USING (cell_id) WHERE cell_id % 3 <> 0 GROUP BY 1, 2),
c AS (SELECT celltype, list(m ORDER BY gene) AS vec FROM m GROUP BY 1)
SELECT cell_id, celltype AS predicted, round(list_distance(q.vec, c.vec), 6) AS dist FROM q CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY list_distance(q.vec, c.vec), celltype) = 1"""


def cluster_to_n(spark, sf):
    e = pin(nb.knn_graph(_vecs(spark, sf), 15))
    return cl.cluster_to_n(e, 10)


def kmeans_elbow(spark, sf):
    k, labels = cl.kmeans_elbow(_vecs(spark, sf), 2, 5)
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k))


def _curve(spark, sf):
    return event_metrics(spark, sf).groupBy(F.col("dataset"), F.substring("celltype", 3, 2).cast("int").alias("k")).agg(F.avg("mse").alias("score"))


def knee(spark, sf):
    return cl.chord_knee(_curve(spark, sf), "k", "score", ["dataset"]).withColumn("distance", r6("distance"))


KNEE = f"""WITH {EVENT_METRICS}, c AS (SELECT dataset, CAST(substr(celltype, 3) AS INTEGER) AS k, AVG(mse) AS s FROM metrics GROUP BY 1, 2),
e AS (SELECT dataset, MIN(k) AS x0, MAX(k) AS x1, arg_min(s, k) AS y0, arg_max(s, k) AS y1, MIN(s) AS lo, MAX(s) AS hi FROM c GROUP BY 1),
d AS (SELECT dataset, k, abs((s - lo) / (hi - lo) - ((y0 - lo) / (hi - lo) + (y1 - y0) / (hi - lo) * (k - x0) / (x1 - x0))) / sqrt(1 + ((y1 - y0) / (hi - lo)) ** 2) AS d FROM c JOIN e USING (dataset))
SELECT dataset, k AS best_k, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY d DESC, k) = 1"""


def select_k(spark, sf):
    m = event_metrics(spark, sf).groupBy(F.substring("celltype", 3, 2).cast("int").alias("k")).agg(F.avg("mse").alias("mean_error"), F.avg("expvar").alias("silhouette"))
    return cl.select_k(m, "elbow").withColumn("method", F.lit("elbow")).unionByName(cl.select_k(m, "silhouette").withColumn("method", F.lit("silhouette")))


SELECT_K = f"""WITH {EVENT_METRICS}, c AS (SELECT CAST(substr(celltype, 3) AS INTEGER) AS k, AVG(mse) AS s, AVG(expvar) AS sil FROM metrics GROUP BY 1),
e AS (SELECT MIN(k) AS x0, MAX(k) AS x1, arg_min(s, k) AS y0, arg_max(s, k) AS y1, MIN(s) AS lo, MAX(s) AS hi FROM c),
d AS (SELECT k, abs((s - lo) / (hi - lo) - ((y0 - lo) / (hi - lo) + (y1 - y0) / (hi - lo) * (k - x0) / (x1 - x0))) AS d FROM c, e)
SELECT best_k, method FROM (SELECT k AS best_k, 'elbow' AS method FROM d ORDER BY d DESC, k LIMIT 1) UNION ALL SELECT best_k, method FROM (SELECT k AS best_k, 'silhouette' AS method FROM c ORDER BY sil DESC, k LIMIT 1)"""


def _runs(spark, sf):
    t = table(spark, sf, "events").select("event_id", "user_id", "value", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5))).alias("k"))
    t = t.select("event_id", "user_id", "value", "k", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("run"))
    c = F.when((F.col("event_id") + F.col("run")) % 9 == 0, (F.round("value").cast("long") + F.col("run")) % F.col("k")).otherwise(F.col("user_id") % F.col("k"))
    return t.select("k", "run", F.col("event_id").alias("cell_id"), c.alias("cluster"))


def coclustering(spark, sf):
    return cl.coclustering_stability(_runs(spark, sf)).withColumn("dispersion", r6("dispersion"))


# C(i, j) only depends on the labels the two cells have in all runs: pair the distinct label lists.
COCLUSTER = """WITH l AS (SELECT k, run, event_id AS cell_id, CASE WHEN (event_id + run) % 9 = 0 THEN (CAST(round(value) AS BIGINT) + run) % k ELSE user_id % k END AS cluster
 FROM events, (SELECT unnest([2, 3, 5]) AS k), (SELECT unnest([0, 1, 2, 3]) AS run)),
p AS (SELECT k, cell_id, list(cluster ORDER BY run) AS ls FROM l GROUP BY 1, 2), g AS (SELECT k, ls, COUNT(*) AS c FROM p GROUP BY 1, 2),
cij AS (SELECT a.k, a.c * b.c AS w, len(list_filter(list_zip(a.ls, b.ls), lambda z: z[1] = z[2])) / 4 AS v FROM g a JOIN g b ON a.k = b.k)
SELECT k, CAST(sqrt(SUM(w)) AS BIGINT) AS n_cells, round(SUM(w * 4 * (v - 0.5) ** 2) / SUM(w), 6) AS dispersion FROM cij GROUP BY 1"""


def component_clusters(spark, sf):
    u = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("run"), F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("factor", "weight"))
    return cl.component_clusters(u)


COMPONENT = "SELECT label % 3 AS run, vec_id AS cell_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS cluster FROM embeddings"


def top_genes(spark, sf):
    return cl.top_genes_per_component(part_loadings(spark, sf), 20)


TOP_GENES = f"WITH {loadings_sql()} SELECT *, row_number() OVER (PARTITION BY scope, factor ORDER BY loading DESC, gene) AS rank FROM loadings QUALIFY rank <= 20"

QUERIES = [
    Query("knn_graph", knn_graph, KNN), Query("shuffle_by_neighbors", shuffle, SHUFFLE),
    Query("neighborhood_preservation", preservation, PRES), Query("neighborhood_preservation_table", preservation_table, PRES_T),
    Query("label_transfer", label_transfer, TRANSFER), Query("label_transfer_centroid", label_centroid, CENTROID),
    Query("cluster_to_n", cluster_to_n), Query("kmeans_elbow", kmeans_elbow), Query("chord_knee", knee, KNEE), Query("select_k", select_k, SELECT_K),
    Query("coclustering_stability", coclustering, COCLUSTER), Query("component_clusters", component_clusters, COMPONENT),
    Query("top_genes_per_component", top_genes, TOP_GENES),
]
