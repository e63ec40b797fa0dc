"""Queries over differential-expression operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import markers as mk
from panelweave.workload.standins import EMB, LIN, Query, emb, lin, lin_sql, r6, table


def deg_table(spark, sf):
    """deg(group, gene, scores, pvals, logfoldchanges) from events."""
    t = table(spark, sf, "events").groupBy(F.col("event_type").alias("group"), F.concat(F.lit("u"), "user_id").alias("gene")).agg(
        # The mean from an exact number of cents, so that no rounding tie depends on summation order.
        (F.round(F.sum("value") * 100).cast("long").cast("double") / 100.0 / F.count(F.lit(1))).alias("scores"), F.pmod(F.round(F.sum("value") * 100).cast("long"), F.lit(997)).alias("p"),
        F.count(F.lit(1)).alias("n"))
    return t.select("group", "gene", "scores", (F.col("p") / 4000.0).alias("pvals"), (F.col("n") / 8.0).alias("logfoldchanges"))


DEG = """
deg AS (SELECT event_type AS "group", 'u' || user_id AS gene, CAST(CAST(round(SUM(value) * 100) AS BIGINT) AS DOUBLE) / CAST(100 AS DOUBLE) / COUNT(*) AS scores,
  (CAST(round(SUM(value) * 100) AS BIGINT) % 997) / 4000.0 AS pvals, COUNT(*) / 8.0 AS logfoldchanges FROM events GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY pvals, gene) AS rk, COUNT(*) OVER (PARTITION BY "group") AS m FROM deg),
adj AS (SELECT "group", gene, scores, pvals, logfoldchanges,
  least(1.0, MIN(pvals * m / rk) OVER (PARTITION BY "group" ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS pvals_adj FROM rk)
"""


def _wilcoxon_sql(prefix: str, tail: str) -> str:
    return f"""
WITH {prefix},
dense AS (SELECT c.cell_id, c.celltype, g.gene, coalesce(e.value, 0) AS value
  FROM cells c CROSS JOIN genes g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene),
r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (COUNT(*) OVER (PARTITION BY gene, value) - 1) / 2 AS rk FROM dense),
s AS (SELECT celltype, gene, SUM(rk) AS rs, COUNT(*) AS na, SUM(value) AS sv FROM r GROUP BY 1, 2),
a AS (SELECT gene, COUNT(*) AS n, SUM(value) AS sall FROM dense GROUP BY gene),
deg AS (SELECT celltype AS "group", gene, (rs - na * (n + 1) / 2) / sqrt(na * (n - na) * (n + 1) / 12) AS scores,
  log2((exp(sv / na) - 1 + 1e-9) / (exp((sall - sv) / (n - na)) - 1 + 1e-9)) AS logfoldchanges FROM s JOIN a USING (gene))
{tail}
"""


_TAIL = 'SELECT "group", gene, round(scores, 6) AS scores, round(logfoldchanges, 6) AS logfoldchanges FROM deg'


#: erfc by the series of erf with positive terms, exact to 1e-13.
P_VALUES = """pv AS (SELECT "group", gene, scores, logfoldchanges, CASE WHEN x = 0 THEN 1 WHEN x > 6 THEN 0 ELSE greatest(0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 160), lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln(x) + lgamma(n + 1) - lgamma(2 * n + 2) - x * x)))) END AS pvals
 FROM (SELECT *, abs(scores) / sqrt(2) AS x FROM deg)),
rk AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY pvals, gene) AS rk, COUNT(*) OVER (PARTITION BY "group") AS n_tests FROM pv),
adj AS (SELECT "group", gene, scores, logfoldchanges, pvals, least(1.0, MIN(pvals * n_tests / rk) OVER (PARTITION BY "group" ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS pvals_adj FROM rk)"""


def wilcoxon_dense(spark, sf):
    d = mk.rank_genes_wilcoxon(emb(spark, sf), p_values=False)
    # fold change of signed means can be undefined; the score is what is ranked
    return d.select("group", "gene", r6("scores").alias("scores"))


def wilcoxon_sparse(spark, sf):
    d = mk.rank_genes_wilcoxon(lin(spark, sf), p_values=False)
    return d.select("group", "gene", r6("scores").alias("scores"), r6("logfoldchanges").alias("logfoldchanges"))


def wilcoxon_full(spark, sf):
    d = mk.rank_genes_wilcoxon(lin(spark, sf))
    return d.select("group", "gene", *[r6(c).alias(c) for c in ("scores", "logfoldchanges", "pvals", "pvals_adj")])


WILCOXON_P = _wilcoxon_sql(LIN, f', {P_VALUES} SELECT "group", gene, round(scores, 6) AS scores, round(logfoldchanges, 6) AS logfoldchanges, round(pvals, 6) AS pvals, round(pvals_adj, 6) AS pvals_adj FROM adj')


def ttest(spark, sf):
    d = mk.rank_genes_ttest(lin(spark, sf))
    return d.select("group", "gene", r6("scores").alias("scores"), r6("dof", 3).alias("dof"))


TTEST = f"""
WITH {LIN}, dense AS (SELECT c.celltype, g.gene, coalesce(e.value, 0) AS v
  FROM cells c CROSS JOIN genes g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene),
k AS (SELECT DISTINCT celltype AS grp FROM cells),
s AS (SELECT grp, gene, AVG(v) FILTER (celltype = grp) AS m1, AVG(v) FILTER (celltype <> grp) AS m2,
  var_samp(v) FILTER (celltype = grp) / COUNT(*) FILTER (celltype = grp) AS a, var_samp(v) FILTER (celltype <> grp) / COUNT(*) FILTER (celltype <> grp) AS b,
  COUNT(*) FILTER (celltype = grp) AS na, COUNT(*) FILTER (celltype <> grp) AS nr FROM dense, k GROUP BY 1, 2)
SELECT grp AS "group", gene, round((m1 - m2) / sqrt(a + b), 6) AS scores,
  round((a + b) ** 2 / (a * a / (na - 1) + b * b / (nr - 1)), 3) AS dof FROM s
"""


def marker_panel(spark, sf):
    return mk.marker_panel(emb(spark, sf), 5).select("group", "gene", r6("scores").alias("scores"), "rank")


MARKER = _wilcoxon_sql(EMB, """, t AS (SELECT "group", gene, scores, row_number() OVER (PARTITION BY "group" ORDER BY scores DESC, gene) AS rank FROM deg)
SELECT "group", gene, round(scores, 6) AS scores, rank FROM t WHERE rank <= 5""").replace(
    "log2((exp(sv / na) - 1 + 1e-9) / (exp((sall - sv) / (n - na)) - 1 + 1e-9))", "0")


def bh(spark, sf):
    return mk.bh_adjust(deg_table(spark, sf)).select("group", "gene", r6("pvals").alias("pvals"), r6("pvals_adj").alias("pvals_adj"))


BH = f'WITH {DEG} SELECT "group", gene, round(pvals, 6) AS pvals, round(pvals_adj, 6) AS pvals_adj FROM adj'


def deg_filter(spark, sf):
    return mk.deg_filter(mk.bh_adjust(deg_table(spark, sf)), 0.15).select("group", "gene", "scores")


DEG_FILTER = f'WITH {DEG} SELECT "group", gene, scores FROM adj WHERE pvals_adj <= 0.15'


def best_group(spark, sf):
    return mk.best_group_per_gene(mk.bh_adjust(deg_table(spark, sf))).select("gene", "group", r6("pvals_adj").alias("pvals_adj"), "scores")


BEST_GROUP = f"""
WITH {DEG}, b AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY pvals_adj, "group") AS i FROM adj)
SELECT gene, "group", round(pvals_adj, 6) AS pvals_adj, scores FROM b WHERE i = 1
"""


def candidates(spark, sf):
    return mk.deg_candidates(deg_table(spark, sf), 100, 5)


CANDIDATES = f"""
WITH {DEG}, h AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY scores DESC, gene) AS i FROM deg)
SELECT gene, MAX(scores) AS scores FROM h WHERE i <= 60 GROUP BY gene
"""


def group_summary(spark, sf):
    d = mk.deg_group_summary(mk.bh_adjust(deg_table(spark, sf)), 0.15)
    return d.withColumn("mean_abs_lfc", r6("mean_abs_lfc"))


GROUP_SUMMARY = f"""
WITH {DEG} SELECT "group", COUNT(*) AS n_tested, COUNT(*) FILTER (pvals_adj <= 0.15) AS n_significant,
 round(AVG(abs(logfoldchanges)) FILTER (pvals_adj <= 0.15), 6) AS mean_abs_lfc FROM adj GROUP BY 1
"""


def _rare_cells(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("cell_id"),
        F.when(F.pmod("user_id", F.lit(50)) < 2, F.col("event_type")).otherwise("common").alias("celltype"))


_RARE_CELLS = "cells AS (SELECT event_id AS cell_id, CASE WHEN user_id % 50 < 2 THEN event_type ELSE 'common' END AS celltype FROM events)"


def _rare(spark, sf):
    deg = mk.bh_adjust(deg_table(spark, sf))
    panel = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id") * 3).alias("gene"))
    return mk.rare_celltype_coverage(_rare_cells(spark, sf), deg, panel, max_pval=0.2)


def rare_coverage(spark, sf):
    return _rare(spark, sf).withColumn("fraction_cells", r6("fraction_cells"))


_RARE = f"""
WITH {DEG}, {_RARE_CELLS}, sz AS (SELECT celltype, COUNT(*) AS n_cells, SUM(COUNT(*)) OVER () AS n FROM cells GROUP BY celltype),
rare AS (SELECT * FROM sz WHERE n_cells < 50 OR n_cells < n * 0.01),
top AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY scores DESC, gene) AS i FROM adj),
mk AS (SELECT "group" AS celltype, gene FROM top WHERE i <= 50 AND logfoldchanges >= 1 AND pvals_adj < 0.2),
pan AS (SELECT DISTINCT 'u' || (user_id * 3) AS gene FROM events),
c AS (SELECT celltype, COUNT(*) AS tot, COUNT(*) FILTER (gene IN (SELECT gene FROM pan)) AS inp FROM mk GROUP BY celltype),
out AS (SELECT rare.celltype, n_cells, round(CAST(n_cells / n AS DOUBLE), 6) AS fraction_cells, coalesce(tot, 0) AS n_exclusive_markers_total, coalesce(inp, 0) AS n_exclusive_markers_in_panel
  FROM rare LEFT JOIN c USING (celltype))
"""
RARE = _RARE + "SELECT * FROM out"


def rare_summary(spark, sf):
    d = mk.rare_coverage_summary(_rare(spark, sf))
    return d.withColumn("panel_fraction_rare_ct_covered", r6("panel_fraction_rare_ct_covered"))


RARE_SUM = _RARE + """SELECT COUNT(*) AS n_rare_celltypes, COUNT(*) FILTER (n_exclusive_markers_in_panel >= 1) AS panel_n_rare_ct_covered,
 round(CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (n_exclusive_markers_in_panel >= 1) / COUNT(*) ELSE CAST('nan' AS DOUBLE) END, 6) AS panel_fraction_rare_ct_covered FROM out"""

QUERIES = [
    Query("marker_panel", marker_panel, MARKER),
    Query("wilcoxon_dense", wilcoxon_dense, MARKER.split(", t AS")[0] + 'SELECT "group", gene, round(scores, 6) AS scores FROM deg'),
    Query("wilcoxon_sparse", wilcoxon_sparse, _wilcoxon_sql(LIN, _TAIL)),
    Query("wilcoxon_with_p_values", wilcoxon_full, WILCOXON_P),
    Query("ttest", ttest, TTEST),
    Query("bh_adjust", bh, BH),
    Query("deg_filter", deg_filter, DEG_FILTER),
    Query("best_group_per_gene", best_group, BEST_GROUP),
    Query("deg_candidates", candidates, CANDIDATES),
    Query("deg_group_summary", group_summary, GROUP_SUMMARY),
    Query("rare_celltype_coverage", rare_coverage, RARE),
    Query("rare_coverage_summary", rare_summary, RARE_SUM),
]
