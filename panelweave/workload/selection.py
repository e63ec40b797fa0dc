"""Queries over selection strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators.markers import bh_adjust
from panelweave.operators import quality as q
from panelweave.plans import selection as se
from panelweave.plans import evaluation as ev
from panelweave.plans import identification as ids
from panelweave.plans.preprocess import preprocess
from panelweave.schema import ExprData
from panelweave.session import pin
from panelweave.workload.markers import DEG, deg_table
from panelweave.workload.panels import ACROSS, LD, LDG, MEANS, POOL, PRIMARY_CTE, _LISTS, _SEL, _means, _resolve_sql, _two_lists
from panelweave.workload.quality import HVG_CR
from panelweave.workload.standins import Query, emb, lin, part_loadings, r6, rounded, table


def deg(spark, sf):
    d = pin(bh_adjust(deg_table(spark, sf)))
    return se.select_deg(d, 60, 5, 0.2).select("gene", "tier", "celltype", "selection_score", "selected_initial")


SEL_DEG = f"""WITH {DEG}, t AS (SELECT * FROM adj WHERE pvals_adj <= 0.2 QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY scores DESC, gene) <= 12),
first AS (SELECT gene, 0 AS tier, "group" AS celltype, scores AS selection_score FROM t QUALIFY row_number() OVER (PARTITION BY gene ORDER BY scores DESC, "group" DESC) = 1),
ofr AS (SELECT gene, CASE WHEN pvals_adj <= 0.2 THEN 1 ELSE 2 END AS tier, "group" AS g, scores FROM adj WHERE gene NOT IN (SELECT gene FROM first)),
o AS (SELECT gene, tier, g, scores FROM ofr QUALIFY row_number() OVER (PARTITION BY gene ORDER BY tier, g, scores DESC) = 1),
b AS (SELECT gene, g AS celltype, scores AS selection_score FROM ofr QUALIFY row_number() OVER (PARTITION BY gene ORDER BY scores DESC, g DESC) = 1),
ob AS (SELECT o.gene, tier, celltype, selection_score, row_number() OVER (ORDER BY tier, g, scores DESC, o.gene) AS i FROM o JOIN b USING (gene))
SELECT *, true AS selected_initial FROM first UNION ALL SELECT gene, tier, celltype, selection_score, i <= (SELECT 60 - COUNT(*) FROM first) FROM ob WHERE tier = 1 OR i <= (SELECT 60 - COUNT(*) FROM first)"""


def forest_summary(spark, sf):
    value = F.col("value")
    exact = value.try_cast("decimal(38,12)")
    # Added up as decimals where they hold every value, so that equal users have equal scores in every order of the rows.
    total = F.when(F.count_if(exact.cast("double") == value) == F.count(value), F.try_sum(exact).cast("double"))
    t = table(spark, sf, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("gene"), F.concat(F.lit("seed"), F.col("event_id") % 7).alias("fold")).agg(
        (F.coalesce(total, F.sum(value)) / F.nullif(F.count(value), F.lit(0))).alias("importance"), (F.count(F.lit(1)) / 20).alias("f1_score"))
    s = se.select_rf(t, 40)
    return s.select("gene", *[rounded(c).alias(c) for c in ("avg_importance", "max_importance", "avg_f1_score", "final_score")], "rank", "selected_initial")


FOREST = """WITH t AS (SELECT 'u' || user_id AS gene, event_id % 7 AS fold, AVG(value) AS i, COUNT(*) / 20 AS f FROM events GROUP BY 1, 2),
s AS (SELECT gene, AVG(i) AS a, MAX(i) AS m, AVG(f) AS f, AVG(i * f) AS z FROM t GROUP BY 1)
SELECT gene, round(a, 6) AS avg_importance, round(m, 6) AS max_importance, round(f, 6) AS avg_f1_score, round(z, 6) AS final_score, row_number() OVER (ORDER BY z DESC, gene) AS rank,
 row_number() OVER (ORDER BY z DESC, gene) <= 40 AS selected_initial FROM s"""


def forest_fit(spark, sf):
    d = emb(spark, sf)
    s = se.forest_scores(d, d.genes, seeds=(42,), folds=2, trees=10)
    return se.select_rf(s, 20).select("gene", "rank", "selected_initial")


def hvg(spark, sf):
    flags = q.hvg(lin(spark, sf, "p_partkey"), "cell_ranger", n=100)
    return se.select_hvg(pin(flags), 50).select("gene", r6("selection_score").alias("selection_score"), "rank")


SEL_HVG = HVG_CR.split("top AS")[0].rstrip().rstrip(",") + " SELECT gene, round(dn, 6) AS selection_score, row_number() OVER (ORDER BY dn DESC, gene) AS rank FROM z WHERE dn IS NOT NULL ORDER BY dn DESC, gene LIMIT 50"


def _genes(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("gene"))


def random(spark, sf):
    return se.select_random(_genes(spark, sf), 80).select("gene", "rank")


RANDOM = "SELECT 'P' || p_partkey AS gene, row_number() OVER (ORDER BY md5('P' || p_partkey || ':42')) AS rank FROM part QUALIFY rank <= 80"


def bootstrap(spark, sf):
    return se.select_random_bootstrap(_genes(spark, sf), 80)


BOOT = """WITH r AS (SELECT 'P' || p_partkey AS gene, t, row_number() OVER (PARTITION BY t ORDER BY md5('P' || p_partkey || ':' || (t + 42))) AS i FROM part, (SELECT unnest(range(0, 10)) AS t)),
f AS (SELECT gene, COUNT(*) AS frequency FROM r WHERE i <= 80 GROUP BY 1) SELECT gene, frequency, row_number() OVER (ORDER BY frequency DESC, gene) AS rank FROM f QUALIFY rank <= 80"""


def dimred(spark, sf):
    p = se.select_dimred(part_loadings(spark, sf), _means(spark, sf), 90, 4, True, 100)
    return p.select("gene", "celltype", "component", "n_celltypes", "selection_score", "selected_initial", "rank")


_FPOOL = "raw AS (SELECT *, abs(loading) AS weight, row_number() OVER (PARTITION BY scope, factor ORDER BY abs(loading) DESC, gene) AS pool_rank FROM loadings QUALIFY pool_rank <= 25)"
_FILTERED = f"{MEANS}, {_FPOOL}, pool AS (SELECT raw.* FROM raw LEFT JOIN means ON celltype = scope AND means.gene = raw.gene WHERE scope NOT IN (SELECT celltype FROM means) OR coalesce(mean_expr, 0) BETWEEN 0.1 AND 100)"
SEL_DIMRED = f"""WITH {_resolve_sql(LD, 25, 'greatest(1, np // 4)').replace(POOL.format(n=25), _FILTERED)}, {ACROSS}, {_SEL.format(z=90, per=4)}
SELECT gene, celltype, CAST(factor AS VARCHAR) AS component, n_celltypes, weight AS selection_score, gene IN (SELECT gene FROM kp90) OR gene IN (SELECT gene FROM fl90) AS selected_initial,
 row_number() OVER (ORDER BY n_celltypes DESC, weight DESC, gene) AS rank FROM res"""


def dimred_global(spark, sf):
    p = se.select_dimred(part_loadings(spark, sf, False), None, 90, 4, False, 60)
    return p.filter("selected_initial").select("gene", "component", "selection_score")


SEL_DIMRED_G = f"""WITH {LDG}, {POOL.format(n=60)}, {PRIMARY_CTE}, s AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY weight DESC, gene) AS r FROM prim QUALIFY r <= 23),
c AS (SELECT *, COUNT(*) OVER (PARTITION BY factor) AS c, COUNT(*) OVER () AS n FROM s), t AS (SELECT *, r > c - greatest(0, least(c - 24, c - 1)) AS tail FROM c),
d AS (SELECT gene FROM t WHERE tail QUALIFY row_number() OVER (ORDER BY weight, gene DESC) <= n - 90)
SELECT gene, CAST(factor AS VARCHAR) AS component, weight AS selection_score FROM t WHERE gene NOT IN (SELECT gene FROM d) ORDER BY weight DESC, gene LIMIT 90"""


def combination(spark, sf):
    rf, dim, forced = _two_lists(spark, sf)
    return se.select_combination(rf, dim, 206, forced, 6).select("gene", "gene_source")


COMBINATION = f"""WITH {_LISTS.replace('LIMIT 60', 'LIMIT 50').replace('LIMIT 140', 'LIMIT 150')},
off AS (SELECT 0 AS tier, rank, gene, 'gap_fill_celltype' AS label FROM dm UNION ALL SELECT 1, rank, gene, 'gap_fill_deg' FROM rf),
f AS (SELECT * FROM off WHERE gene NOT IN (SELECT gene FROM cmb) QUALIFY row_number() OVER (PARTITION BY gene ORDER BY tier) = 1)
SELECT gene, gene_source FROM cmb UNION ALL (SELECT gene, label FROM f ORDER BY tier, rank, gene LIMIT (SELECT 206 - COUNT(*) FROM cmb))"""


def _prepared(spark, sf):
    d = lin(spark, sf, "p_size")
    return preprocess(d, "no_filter")


def _final(p):
    return p.filter("final_selection").select("gene", "selection_strategy", "final_selection")


def end_deg(spark, sf):
    return _final(se.select(_prepared(spark, sf), se.SelectionConfig("deg_only", size=15, expression_bounds=(0.01, 100.0))))


def end_hvg(spark, sf):
    return _final(se.select(_prepared(spark, sf), se.SelectionConfig("hvg", size=15, expression_bounds=(0.01, 100.0))))


def end_dimred(spark, sf):
    return _final(se.select(_prepared(spark, sf), se.SelectionConfig("dimred_only", size=15, k=3, factor_iters=3, expression_bounds=(0.01, 100.0))))


def end_combination(spark, sf):
    cfg = se.SelectionConfig("rf_pca", size=16, k=3, expression_bounds=(0.01, 100.0), forest={"seeds": (42,), "folds": 2, "trees": 5}, force_include=("7",))
    return _final(se.select(_prepared(spark, sf), cfg))


def identification(spark, sf):
    d = emb(spark, sf)
    kinds = F.array(F.when(F.col("gene") < "g020", "first"), F.when(F.substring("gene", -1, 1).cast("int") % 2 == 1, "odd"), F.lit("all"))
    panels = d.genes.withColumn("panel", F.explode(kinds)).filter("panel is not null")
    return ev.celltype_identification(d, panels)


def _planted(spark, sf):
    """Genes that tell each, half or none of the labels apart."""
    t = table(spark, sf, "embeddings")
    n = F.col("label").cast("double")
    kinds = F.explode(F.array(*[F.struct(F.lit(g).alias("gene"), v.alias("value")) for g, v in (("each", n), ("half", (n < 5).cast("double")), ("flat", F.lit(1.0)))]))
    expr = t.select(F.col("vec_id").alias("cell_id"), kinds.alias("x")).select("cell_id", "x.*").filter("value <> 0")
    cells = t.select(F.col("vec_id").alias("cell_id"), F.concat(F.lit("c"), F.col("label")).alias("celltype"))
    genes = spark.createDataFrame([("each",), ("half",), ("flat",)], "gene string")
    panels = spark.createDataFrame([("p_each", "each"), ("p_each", "flat"), ("p_half", "half"), ("p_half", "flat"), ("p_half", "unknown"), ("p_flat", "flat")], "panel string, gene string")
    return ids.identify(ExprData(expr, cells, genes), panels)


def identification_depths(spark, sf):
    d = ids.depth_scores(_planted(spark, sf))
    return d.select("dataset", "depth", "best", *[r6(c).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "weighted_precision", "weighted_recall", "inverse_freq_f1")])


#: Equal classes in a row make every cut equally good, so the first one is taken: a tree of depth d names the first d labels.
_PLANTED = """l AS (SELECT label, 'c' || label AS ct, COUNT(*) AS n, row_number() OVER (ORDER BY label) - 1 AS i FROM embeddings GROUP BY label HAVING COUNT(*) >= 5),
k AS (SELECT 'p_each' AS dataset, d AS depth, least(i, d) AS p, l.* FROM l, (SELECT unnest([5, 10, 15, 20, 30]) AS d)
 UNION ALL SELECT 'p_half', d, CASE WHEN label < 5 THEN 0 ELSE (SELECT COUNT(*) FROM l WHERE label < 5) END, l.* FROM l, (SELECT unnest([5, 10, 15, 20, 30]) AS d) UNION ALL SELECT 'p_flat', d, 0, l.* FROM l, (SELECT unnest([5, 10, 15, 20, 30]) AS d)),
c AS (SELECT a.dataset, a.depth, a.ct, a.n, a.i, CASE WHEN a.p = a.i THEN 1 ELSE 0 END AS tp, (SELECT COUNT(*) FROM k b WHERE b.dataset = a.dataset AND b.depth = a.depth AND b.p = a.i) AS said FROM k a),
s AS (SELECT *, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS pr, 2 * tp / (said + 1) AS f1 FROM c)"""
IDENT_DEPTHS = f"""WITH {_PLANTED}, t AS (SELECT dataset, depth, AVG(tp) AS accuracy, AVG(f1) AS f1, AVG(pr) AS pr, SUM(f1 / n) / SUM(1 / n) AS rare FROM s GROUP BY 1, 2)
SELECT dataset, depth, row_number() OVER (PARTITION BY dataset ORDER BY round(f1, 12) DESC, CASE WHEN depth = 30 THEN 0 ELSE depth END) = 1 AS best, round(accuracy, 6) AS accuracy, round(f1, 6) AS macro_f1,
 round(f1, 6) AS weighted_f1, round(pr, 6) AS weighted_precision, round(accuracy, 6) AS weighted_recall, round(rare, 6) AS inverse_freq_f1 FROM t"""


def identification_ranks(spark, sf):
    d = ids.dataset_scores(_planted(spark, sf))
    return d.select("dataset", "best_max_depth", "n_genes", r6("avg_feature_importance").alias("avg_feature_importance"), *[F.col(c).cast("int").alias(c) for c in ("accuracy_rank", "macro_f1_rank", "avg_feature_importance_rank")])


IDENT_RANKS = """SELECT 'p_each' AS dataset, 30 AS best_max_depth, COUNT(*) * 0 + 2 AS n_genes, 0.5::DOUBLE AS avg_feature_importance, 1 AS accuracy_rank, 1 AS macro_f1_rank, 1 AS avg_feature_importance_rank FROM embeddings
UNION ALL SELECT 'p_half', 30, 2, 0.5, 2, 2, 1 UNION ALL SELECT 'p_flat', 30, 1, 0, 3, 3, 3"""


QUERIES = [
    Query("select_deg", deg, SEL_DEG), Query("forest_gene_summary", forest_summary, FOREST), Query("select_rf", forest_fit), Query("select_hvg", hvg, SEL_HVG),
    Query("select_random", random, RANDOM), Query("select_random_bootstrap", bootstrap, BOOT), Query("select_dimred_per_celltype", dimred, SEL_DIMRED),
    Query("select_dimred_global", dimred_global, SEL_DIMRED_G), Query("select_combination", combination, COMBINATION),
    Query("selection_deg_only", end_deg), Query("selection_hvg", end_hvg), Query("selection_dimred_only", end_dimred), Query("selection_rf_pca", end_combination),
    Query("celltype_identification", identification),
    Query("identification_depths", identification_depths, IDENT_DEPTHS), Query("identification_ranks", identification_ranks, IDENT_RANKS),
]
