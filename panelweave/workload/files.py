"""Queries that write a table derived from the data to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.ranks import row_index
from panelweave.operators import panels as pn
from panelweave.operators.markers import bh_adjust
from panelweave.session import fresh_path, pin
from panelweave.sources import matrix as mx
from panelweave.sources import panels as sp
from panelweave.sources import results as rs
from panelweave.workload.markers import DEG, deg_table
from panelweave.workload.panels import FILL_CTE
from panelweave.workload.summaries import DATASETS
from panelweave.workload.standins import EVENT_METRICS, LIN, PART_PANEL, Query, event_metrics, lin, part_panel, r6, table


def expr_tables(spark, sf):
    path = fresh_path(spark, "expr")
    mx.write_expr(lin(spark, sf), path)
    d = mx.read_expr(spark, path)
    return d.expr.join(d.cells, "cell_id").groupBy("gene", "celltype").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


EXPR_TABLES = f"WITH {LIN} SELECT gene, celltype, COUNT(*) AS n, SUM(value) AS total FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2"


def wide_matrix(spark, sf):
    """The embeddings as a gene-by-cell CSV with dotted cell names."""
    path = fresh_path(spark, "wide")
    e = table(spark, sf, "embeddings")
    names = F.transform(F.array_sort(F.collect_list("vec_id")), lambda i: F.concat(F.lit("c."), i.cast("string")))
    head = e.agg(F.lit(-1).alias("g"), F.concat(F.lit("gene,"), F.array_join(names, ",")).alias("value"))
    v = e.select("vec_id", F.posexplode("embedding").alias("g", "x"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.col("x").cast("double").alias("x")))), lambda s: s["x"].cast("string"))
    body = v.groupBy("g").agg(F.concat(F.lit("g"), F.col("g").cast("string"), F.lit(","), F.array_join(row, ",")).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("g").select("value").write.text(path)
    d = mx.read_wide_matrix(spark, path)
    return d.expr.withColumn("cell_id", F.regexp_extract("cell_id", r"c\.(\d+)", 1).cast("long")).select("cell_id", "gene", r6("value").alias("value"))


WIDE = "SELECT vec_id AS cell_id, 'g' || (i - 1) AS gene, round(CAST(x AS DOUBLE), 6) AS value FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE x <> 0"


def mtx_folder(spark, sf):
    """The lines of orders as coordinates with barcodes and features by line."""
    root = fresh_path(spark, "mtx")
    d = lin(spark, sf)
    b = pin(row_index(d.cells.select("cell_id").distinct(), [], F.col("cell_id"), "ci"))
    g = pin(row_index(d.genes.select("gene").distinct(), [], F.col("gene"), "gi"))
    e = pin(d.expr.join(b, "cell_id").join(g, "gene").select("gi", "ci", "value"))
    size = e.agg(F.lit(1).alias("o"), F.concat_ws(" ", F.lit(g.count()), F.lit(b.count()), F.count(F.lit(1))).alias("value"))
    note = spark.range(1).select(F.lit(0).alias("o"), F.lit("%%MatrixMarket matrix coordinate real general").alias("value"))
    # The two lines of the head are the first part, the coordinates follow in parts of their own.
    head = note.unionByName(size).coalesce(1).sortWithinPartitions("o").select("value")
    head.unionByName(e.select(F.concat_ws(" ", "gi", "ci", "value").alias("value"))).write.text(f"{root}/matrix.mtx.gz")
    b.repartitionByRange("ci").sortWithinPartitions("ci").select(F.col("cell_id").cast("string").alias("value")).write.text(f"{root}/barcodes.tsv.gz")
    g.repartitionByRange("gi").sortWithinPartitions("gi").select(F.concat_ws("\t", "gene", F.lower("gene")).alias("value")).write.text(f"{root}/features.tsv.gz")
    out = mx.read_mtx_folder(spark, root)
    return out.expr.join(out.genes, "gene").select(F.col("cell_id").cast("long").alias("cell_id"), "gene", "symbol", "value")


MTX = f"WITH {LIN} SELECT cell_id, gene, lower(gene) AS symbol, value FROM expr WHERE value <> 0"


def ranked(spark, sf):
    path = fresh_path(spark, "ranked")
    p = pn.single_gap_fill(part_panel(spark, sf), 900)
    rs.write_ranked_list(p, path)
    return spark.read.csv(path, header=True).select("gene", F.col("in_panel").cast("boolean").alias("in_panel"), F.col("rank").cast("long").alias("rank"))


def summary(spark, sf):
    path = fresh_path(spark, "summary")
    p = pin(pn.single_gap_fill(pn.new_panel(part_panel(spark, sf), "deg_only"), 900))
    rs.write_summary_json(p, path, "deg_only", 900)
    return spark.read.json(path).select("strategy", "target_size", "initial_selected", "after_xenium", "final_selected", "xenium_failed")


SUMMARY = f"""WITH {FILL_CTE} SELECT 'deg_only' AS strategy, 900 AS target_size, COUNT(*) FILTER (selected_initial) AS initial_selected, COUNT(*) FILTER (selected_initial AND coalesce(passed_xenium, true)) AS after_xenium,
 COUNT(*) FILTER (final_selection) AS final_selected, COUNT(*) FILTER (NOT passed_xenium) AS xenium_failed FROM done"""


def per_dataset(spark, sf):
    path = fresh_path(spark, "datasets")
    rs.write_per_dataset(event_metrics(spark, sf), path)
    return spark.read.parquet(path).groupBy("dataset", "celltype").agg(r6(F.avg("mse")).alias("mse"), F.count(F.lit(1)).alias("n"))


def reconstruction(spark, sf):
    path = fresh_path(spark, "recon")
    m = event_metrics(spark, sf).withColumn("_private", F.lit(1))
    glob = m.groupBy("dataset").agg(F.avg("mse").alias("mse"))
    rs.write_reconstruction(glob, m.select("dataset", "celltype", "mse", "_private"), glob, path)
    d = spark.read.csv(path + "/per_celltype", header=True)
    return d.select("dataset", "celltype", r6(F.col("mse")).alias("mse"))


RECON = f"WITH {EVENT_METRICS} SELECT dataset, celltype, round(mse, 6) AS mse FROM metrics UNION ALL SELECT dataset, '__summary__', round(AVG(mse), 6) FROM metrics GROUP BY 1"


def deg_results(spark, sf):
    path = fresh_path(spark, "deg")
    rs.write_deg_results(pin(bh_adjust(deg_table(spark, sf))), path, 0.15)
    return spark.read.parquet(path + "/deg_results_filtered").groupBy("group").agg(F.count(F.lit(1)).alias("n"))


def cached(spark, sf):
    root = fresh_path(spark, "cache")
    p = part_panel(spark, sf).filter("rank <= 120").select("gene", "rank")
    sp.save_panel(p, root, "scanpy", True, "hvg", 120)
    assert sp.load_cached_panel(spark, root, "scanpy", False, "hvg", 120) is None
    return sp.load_cached_panel(spark, root, "scanpy", True, "hvg", 120)



def panels_dir(spark, sf):
    """Panels of all parts in a folder tree like the selection writes."""
    root = fresh_path(spark, "panels")
    t = table(spark, sf, "part")
    for strategy, size, name in (("deg_only", 50, "selected_genes"), ("rf_deg", 100, "selected_genes_DEG-based-filling")):
        d = t.filter((F.col("p_size") > 25) == F.lit(size == 50)).select(F.lit(0).alias("rank"), F.concat(F.lit("P"), "p_partkey").alias("gene"), "p_type")
        d.write.csv(f"{root}/Scanpy-Filter/All-Genes/{strategy}/{size}-genes/results/{name}.csv", header=True)
    return sp.read_panels(spark, root, lin_genes(spark, sf)).select("panel", "gene")


def lin_genes(spark, sf):
    return table(spark, sf, "part").filter("p_partkey % 5 > 0").select(F.concat(F.lit("P"), "p_partkey").alias("gene"))


PANELS_DIR = """SELECT 'Scanpy-Filter_All-Genes_deg_only_50' AS panel, 'P' || p_partkey AS gene FROM part WHERE p_size > 25 AND p_partkey % 5 > 0
UNION ALL SELECT 'Scanpy-Filter_All-Genes_rf_deg_100_DEG-based-filling', 'P' || p_partkey FROM part WHERE p_size <= 25 AND p_partkey % 5 > 0"""


def k_varying(spark, sf):
    root = fresh_path(spark, "kvar")
    m = event_metrics(spark, sf).select(F.concat(F.lit("k_"), F.lpad(F.col("fold").cast("string"), 2, "0")).alias("k"), "dataset", "celltype", F.col("mse").alias("macro_mse"), F.col("expvar").alias("macro_expvar"))
    for i, ds in enumerate(DATASETS):
        for k in range(5):
            d = m.filter((F.col("dataset") == ds) & (F.col("k") == f"k_0{k}"))
            d.select(F.lit(ds).alias("selection_method"), F.lit("nmf").alias("eval_method"), "macro_mse", "macro_expvar").write.csv(f"{root}/k_0{k}/iter_{i}/res", header=True)
    d = rs.read_k_varying(spark, root)
    return d.groupBy("k_value", "iteration", "selection_method").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("macro_mse")).alias("mse"))


K_VARYING = f"WITH {EVENT_METRICS} SELECT fold AS k_value, list_position(['click', 'error', 'purchase', 'signup', 'view'], dataset) - 1 AS iteration, dataset AS selection_method, COUNT(*) AS n, round(AVG(mse), 6) AS mse FROM metrics GROUP BY 1, 2, 3"

def gene_lists(spark, sf):
    """Four header styles, written from the part table and read by the same reader."""
    root = fresh_path(spark, "lists")
    t = table(spark, sf, "part")
    g = F.concat(F.lit("P"), "p_partkey")
    t.select(g.alias("gene"), (F.col("p_size") > 20).alias("selected_final")).write.csv(f"{root}/a", header=True)
    t.select("p_size", g.alias("Gene_Symbol")).write.csv(f"{root}/b", header=True)
    t.select(F.concat(F.lit("ENS"), "p_partkey").alias("x")).write.csv(f"{root}/c", header=False)
    t.select(F.concat_ws(", ", g, "p_name").alias("whatever"), "p_size").write.csv(f"{root}/d", header=True)
    out = None
    for name in "abcd":
        o = sp.read_gene_list(spark, f"{root}/{name}").select(F.lit(name).alias("list"), "gene")
        out = o if out is None else out.unionByName(o)
    return out


GENE_LISTS = """SELECT 'a' AS list, 'P' || p_partkey AS gene FROM part WHERE p_size > 20 UNION ALL SELECT 'b', 'P' || p_partkey FROM part
UNION ALL SELECT 'c', 'ENS' || p_partkey FROM part UNION ALL SELECT 'd', 'P' || p_partkey || ', ' || p_name FROM part"""


def vendor_panel(spark, sf):
    path = fresh_path(spark, "vendor")
    table(spark, sf, "part").select(F.col("p_name").alias("symbol"), F.concat(F.lit("P"), "p_partkey").alias("gene_id"), "p_size").write.csv(path, header=True)
    return sp.read_10x_panel(spark, path).select("gene")


def external(spark, sf):
    path = fresh_path(spark, "external")
    table(spark, sf, "part").orderBy("p_partkey").select(F.concat(F.lit("P"), "p_partkey").alias("gene")).write.csv(path, header=True)
    d = sp.read_external_panels(spark, {"vendorA": path, "vendorB": path}, lin_genes(spark, sf), [0, 10_000_000])
    return d.groupBy("panel").agg(F.count(F.lit(1)).alias("n"))


EXTERNAL = "SELECT p AS panel, COUNT(*) AS n FROM part, (SELECT unnest(['vendorA', 'vendorB']) AS p) WHERE p_partkey % 5 > 0 GROUP BY 1"


def stability(spark, sf):
    root = fresh_path(spark, "stability")
    li = table(spark, sf, "lineitem").select(F.pmod("l_orderkey", F.lit(4)).alias("r"), F.concat(F.lit("P"), "l_partkey").alias("gene")).distinct()
    for i in range(4):
        li.filter(F.col("r") == i).select("gene").write.csv(f"{root}/iter_{i}/selected_genes", header=True)
    return rs.read_stability(spark, root)


STABILITY = "SELECT 'P' || l_partkey AS gene, COUNT(DISTINCT l_orderkey % 4) AS n_selected FROM lineitem GROUP BY 1"


def variability(spark, sf):
    root = fresh_path(spark, "variability")
    m = event_metrics(spark, sf)
    for ds in DATASETS:
        m.filter(F.col("dataset") == ds).select(F.lit("per_celltype").alias("analysis_type"), "celltype", "fold", "mse").write.csv(f"{root}/{ds}", header=True)
    return rs.read_variability(spark, root, ["mse"]).select("dataset", "celltype", "fold", r6("mse").alias("mse"))


VARIABILITY = f"WITH {EVENT_METRICS} SELECT dataset, celltype, fold, round(mse, 6) AS mse FROM metrics"


def _baseline_files(spark, sf):
    """Two baseline tables with different headers, and the folders of a run over k."""
    root = fresh_path(spark, "baseline")
    m = event_metrics(spark, sf)
    m.select("dataset", "celltype", F.col("mse").alias("preservation"), "expvar").repartition(3, "dataset").write.csv(f"{root}/neighborhood_preservation_all", header=True)
    m.select(F.col("dataset").alias("dataset_name"), "mse", "celltype").coalesce(1).write.csv(f"{root}/clustering_quality", header=True)
    for k in range(3):
        m.filter(F.col("fold") == k).select("dataset", "mse").coalesce(1).write.csv(f"{root}/k_{k}/iter_0/res", header=True)
    return root


def baseline(spark, sf):
    root = _baseline_files(spark, sf)
    a = rs.read_baseline(spark, root, "preservation", ["preservation", "expvar"]).select(F.lit("preservation").alias("kind"), "dataset", "celltype", F.col("preservation").alias("value"))
    b = rs.read_baseline(spark, root, "clustering", ["mse"]).select(F.lit("clustering").alias("kind"), "dataset", "celltype", F.col("mse").alias("value"))
    return a.unionByName(b).withColumn("value", r6("value"))


BASELINE = f"WITH {EVENT_METRICS} SELECT kind, dataset, celltype, round(mse, 6) AS value FROM metrics, (SELECT unnest(['preservation', 'clustering']) AS kind)"


def detected(spark, sf):
    return rs.detect_results(spark, _baseline_files(spark, sf)).filter("kind <> 'preservation'")


DETECTED = "SELECT 'clustering' AS kind, COUNT(*) * 0 + 1 AS n_files FROM events UNION ALL SELECT 'k_varying', 3"


QUERIES = [
    Query("read_gene_list", gene_lists, GENE_LISTS), Query("read_10x_panel", vendor_panel, "SELECT 'P' || p_partkey AS gene FROM part"), Query("read_external_panels", external, EXTERNAL),
    Query("read_stability", stability, STABILITY), Query("read_baseline", baseline, BASELINE), Query("detect_results", detected, DETECTED), Query("read_variability", variability, VARIABILITY),
    Query("read_write_expr", expr_tables, EXPR_TABLES), Query("read_wide_matrix", wide_matrix, WIDE), Query("read_mtx_folder", mtx_folder, MTX), Query("write_ranked_list", ranked, f"WITH {FILL_CTE} SELECT gene, final_selection AS in_panel, rank FROM done WHERE coalesce(passed_xenium, true)"),
    Query("write_summary_json", summary, SUMMARY),
    Query("write_per_dataset", per_dataset, f"WITH {EVENT_METRICS} SELECT dataset, celltype, round(AVG(mse), 6) AS mse, COUNT(*) AS n FROM metrics GROUP BY 1, 2"),
    Query("write_reconstruction", reconstruction, RECON), Query("write_deg_results", deg_results, f'WITH {DEG} SELECT "group", COUNT(*) AS n FROM adj WHERE pvals_adj <= 0.15 GROUP BY 1'),
    Query("load_cached_panel", cached, f"WITH {PART_PANEL} SELECT gene, rank FROM panel WHERE rank <= 120"),
    Query("read_panels", panels_dir, PANELS_DIR), Query("read_k_varying", k_varying, K_VARYING),
]
