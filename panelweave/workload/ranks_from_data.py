"""Queries over eigenpairs and numbers of components found from the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import factor as fa
from panelweave.operators import krylov as kr
from panelweave.schema import ExprData
from panelweave.session import pin
from panelweave.workload.standins import Query, emb, lin, r6, table

_KS = range(2, 10)


def _planted(spark, sf) -> ExprData:
    """Customers by 12 genes whose rank is the number of market segments: a segment has genes of its own and one profile."""
    t = table(spark, sf, "customer")
    segment = F.ascii(F.substring("c_mktsegment", 1, 1)).cast("string")
    gene = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("g")
    rows = t.select(F.col("c_custkey").alias("cell_id"), segment.alias("s"), (F.pmod("c_custkey", F.lit(7)) + 1).cast("double").alias("w"), F.pmod("c_nationkey", F.lit(2)).alias("half"), gene)
    expr = rows.select("cell_id", F.concat_ws("_", "s", F.col("g").cast("string")).alias("gene"), (F.col("w") * (F.pmod("g", F.lit(4)) + 1)).alias("value"))
    cells = t.select(F.col("c_custkey").alias("cell_id"), F.pmod("c_nationkey", F.lit(2)).cast("string").alias("celltype"))
    return ExprData(expr, cells, pin(expr.select("gene").distinct()))


def curve(spark, sf):
    d = _planted(spark, sf)
    return kr.explained_curve(fa.pack(d.expr, d.cells, d.genes, "celltype"), _KS).withColumn("score", r6("score"))


def chosen(spark, sf):
    d = _planted(spark, sf)
    c = kr.explained_curve(fa.pack(d.expr, d.cells, d.genes, "celltype"), _KS)
    return kr.farthest_from_chord(c).select("scope", "best_k", r6("distance").alias("distance"))


#: Segments share no gene, so each one's eigenvalue is its cells' squares times its profile's.
_CURVE = f"""cs AS (SELECT CAST(c_nationkey % 2 AS VARCHAR) AS scope, substr(c_mktsegment, 1, 1) AS s, c_custkey % 7 + 1 AS w FROM customer),
e AS (SELECT scope, s, SUM(w * w) * (SELECT SUM((g % 4 + 1) * (g % 4 + 1)) FROM (SELECT unnest(range(1, 13)) AS g)) AS ev, SUM(w) * (SELECT SUM(g % 4 + 1) FROM (SELECT unnest(range(1, 13)) AS g)) AS total, COUNT(*) AS n FROM cs GROUP BY 1, 2),
t AS (SELECT scope, SUM(ev) AS squares, SUM(ev) - SUM(total) * SUM(total) / (SUM(n) * 12 * (SELECT COUNT(DISTINCT s) FROM cs)) AS variance FROM e GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ev DESC) AS i FROM e),
curve AS (SELECT t.scope, CAST(k AS INTEGER) AS k, 1 - (squares - (SELECT SUM(ev) FROM o WHERE o.scope = t.scope AND i <= k)) / variance AS score FROM t, (SELECT unnest(range({_KS.start}, {_KS.stop})) AS k))"""
CURVE = f"WITH {_CURVE} SELECT scope, k, round(score, 6) AS score FROM curve"
CHOSEN = f"""WITH {_CURVE}, b AS (SELECT scope, MIN(k) AS x0, MAX(k) AS x1, arg_min(score, k) AS y0, arg_max(score, k) AS y1 FROM curve GROUP BY 1),
d AS (SELECT scope, k, abs((x1 - x0) * (score - y0) - (y1 - y0) * (k - x0)) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS d FROM curve JOIN b USING (scope))
SELECT scope, arg_min(k, {{'a': -round(d, 9), 'b': k}}) AS best_k, round(MAX(d), 6) AS distance FROM d GROUP BY scope"""


def _residuals(d: ExprData, l, scope: str | None):
    """Per (scope, factor): distance of Cov v from its multiple of v as a part of the largest eigenvalue, length, and largest product with another vector."""
    l = pin(l)
    cells = d.cells.select("cell_id", (F.col(scope) if scope else F.lit("global")).alias("scope"))
    x = d.expr.join(cells, "cell_id").join(l.select("scope", "factor", "gene", "loading"), ["scope", "gene"])
    score = x.groupBy("scope", "cell_id", "factor").agg(F.sum(F.col("value") * F.col("loading")).alias("s"))
    base = l.groupBy("scope", "factor").agg(F.sum(F.col("mean") * F.col("loading")).alias("b"))
    sizes = cells.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    moved = d.expr.join(score.join(base, ["scope", "factor"]).withColumn("s", F.col("s") - F.col("b")), "cell_id").groupBy("scope", "factor", "gene").agg(F.sum(F.col("value") * F.col("s")).alias("xs"))
    # Cells without a stored value score -b and add nothing to these sums, but the scores' total does not vanish without them; the mean term makes up for it.
    sums = score.join(base, ["scope", "factor"]).groupBy("scope", "factor").agg((F.sum("s") - F.count(F.lit(1)) * F.max("b")).alias("_stored"), F.count(F.lit(1)).alias("_n"), F.max("b").alias("_b"))
    every = l.join(moved, ["scope", "factor", "gene"], "left").na.fill(0.0, ["xs"]).join(sums, ["scope", "factor"]).join(sizes, "scope")
    whole = F.col("_stored") - (F.col("n") - F.col("_n")) * F.col("_b")
    off = (F.col("xs") - F.col("mean") * whole) / (F.col("n") - 1) - F.col("explained_variance") * F.col("loading")
    per = every.groupBy("scope", "factor").agg(F.sqrt(F.sum(off * off)).alias("r"), F.sum(F.col("loading") * F.col("loading")).alias("length"), F.max("n").alias("n_cells"))
    first = l.groupBy("scope").agg(F.max("explained_variance").alias("_top"))
    a, b = l.select("scope", "gene", "factor", "loading"), l.select("scope", "gene", F.col("factor").alias("f2"), F.col("loading").alias("l2"))
    dots = a.join(b, ["scope", "gene"]).filter("factor <> f2").groupBy("scope", "factor", "f2").agg(F.abs(F.sum(F.col("loading") * F.col("l2"))).alias("dot")).groupBy("scope", "factor").agg(F.max("dot").alias("dot"))
    out = per.join(first, "scope").join(dots, ["scope", "factor"])
    # Adding zero turns a rounded minus zero into zero.
    return out.select("scope", "factor", "n_cells", (F.round(F.col("r") / F.col("_top"), 6) + 0.0).alias("residual"), r6("length").alias("length"), (F.round("dot", 6) + 0.0).alias("largest_dot"))


def residuals_global(spark, sf):
    d = emb(spark, sf)
    return _residuals(d, fa.pca(fa.pack(d.expr, d.cells, d.genes), 5), None)


def residuals_per_celltype(spark, sf):
    d = lin(spark, sf)
    return _residuals(d, fa.pca(fa.pack(d.expr, d.cells, d.genes, "celltype", min_cells=10), 3), "celltype")


_ROW = "CAST(f AS INTEGER) AS factor, n AS n_cells, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS length, 0.0::DOUBLE AS largest_dot"
RES_GLOBAL = f"SELECT 'global' AS scope, {_ROW} FROM (SELECT COUNT(*) AS n FROM embeddings), (SELECT unnest(range(5)) AS f)"
RES_CT = f"SELECT o AS scope, {_ROW} FROM (SELECT o_orderpriority AS o, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) >= 10), (SELECT unnest(range(3)) AS f)"

QUERIES = [
    Query("explained_curve", curve, CURVE), Query("select_k_from_data", chosen, CHOSEN),
    Query("pca_residuals_global", residuals_global, RES_GLOBAL), Query("pca_residuals_per_celltype", residuals_per_celltype, RES_CT),
]
