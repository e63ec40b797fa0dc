"""Queries over validation, filtering, normalisation and variable-gene operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import filters as fl
from panelweave.operators import quality as q
from panelweave.plans.preprocess import preprocess
from panelweave.schema import ExprData
from panelweave.workload.standins import EMB, LIN, PART_PANEL, Query, emb, lin, lin_sql, part_panel, r6, table

PATTERNS = {"mt": "^Brand#1", "ribo": "^(Brand#20|Brand#21)", "hb": "^Brand#2[^(1)]"}


def read_expr(spark, sf):
    d = lin(spark, sf)
    return d.expr.groupBy("gene").agg(
        F.count(F.lit(1)).alias("n_stored"), F.sum("value").alias("total"), F.max("value").alias("top")
    )


READ_EXPR = f"WITH {LIN} SELECT gene, COUNT(*) AS n_stored, SUM(value) AS total, MAX(value) AS top FROM expr GROUP BY gene"


def is_raw_counts(spark, sf):
    a = q.is_raw_counts(lin(spark, sf).expr).withColumn("src", F.lit("lines"))
    b = q.is_raw_counts(emb(spark, sf).expr).withColumn("src", F.lit("embeddings"))
    return a.unionByName(b)


_RAW = "coalesce(bool_and(CASE WHEN value <> 0 THEN abs(value - round(value)) <= 1e-8 + 1e-5 * abs(round(value)) END), true)"
IS_RAW = f"""
WITH {LIN}, {EMB.replace('expr AS', 'eexpr AS').replace('cells AS', 'ecells AS').replace('genes AS', 'egenes AS').replace('FROM expr', 'FROM eexpr')}
SELECT {_RAW} AS is_raw_counts, 'lines' AS src FROM expr
UNION ALL SELECT {_RAW}, 'embeddings' FROM eexpr
"""


def _dirty(spark, sf):
    e = lin(spark, sf)
    v = (
        F.when(F.pmod("cell_id", F.lit(97)) == 0, F.lit(float("nan")))
        .when(F.pmod("cell_id", F.lit(101)) == 0, F.lit(float("inf")))
        .when(F.pmod("cell_id", F.lit(103)) == 0, F.lit(float("-inf")))
        .when(F.pmod("cell_id", F.lit(89)) == 0, -F.col("value"))
        .otherwise(F.col("value"))
    )
    return ExprData(e.expr.withColumn("value", v), e.cells, e.genes)


DIRTY = LIN.replace("expr AS", "clean AS") + """,
expr AS (SELECT cell_id, gene, CASE WHEN cell_id % 97 = 0 THEN CAST('nan' AS DOUBLE)
  WHEN cell_id % 101 = 0 THEN CAST('inf' AS DOUBLE) WHEN cell_id % 103 = 0 THEN CAST('-inf' AS DOUBLE)
  WHEN cell_id % 89 = 0 THEN -value ELSE value END AS value FROM clean)
"""


def data_issues(spark, sf):
    d = _dirty(spark, sf)
    return q.data_issues(d.expr, d.cells)


DATA_ISSUES = f"""
WITH {DIRTY}
SELECT COUNT(*) FILTER (isnan(value)) AS n_nan, COUNT(*) FILTER (isinf(value)) AS n_inf,
  COUNT(*) FILTER (value < 0 AND NOT isinf(value) AND NOT isnan(value)) AS n_negative,
  (SELECT COUNT(*) FROM cells WHERE cell_id NOT IN
     (SELECT cell_id FROM expr GROUP BY cell_id HAVING SUM(value) <> 0)) AS n_zero_cells
FROM expr
"""


def sanitize(spark, sf):
    d = _dirty(spark, sf)
    return q.sanitize(d.expr, nan=-1.0, neginf=-2.0).groupBy("gene").agg(
        F.sum("value").alias("total"), F.max("value").alias("top"), F.min("value").alias("low")
    )


SANITIZE = f"""
WITH {DIRTY}, m AS (SELECT MAX(value) AS mx FROM expr WHERE NOT isnan(value) AND NOT isinf(value))
SELECT gene, SUM(v) AS total, MAX(v) AS top, MIN(v) AS low FROM (
  SELECT gene, CASE WHEN isnan(value) THEN -1 WHEN isinf(value) AND value > 0 THEN mx
    WHEN isinf(value) THEN -2 ELSE value END AS v FROM expr, m) GROUP BY gene
"""


def qc_metrics(spark, sf):
    d = lin(spark, sf)
    m = q.qc_metrics(d.expr, d.cells, PATTERNS)
    return m.select("cell_id", "n_genes", "total", *[r6(f"pct_{p}").alias(f"pct_{p}") for p in PATTERNS],
                    r6("log1p_total").alias("log1p_total"), r6("log1p_n_genes").alias("log1p_n_genes"))


def _pct(rx):
    return (f"round(CASE WHEN coalesce(SUM(value),0) <> 0 THEN SUM(CASE WHEN regexp_matches(gene, '{rx}') "
            "THEN value ELSE 0 END) / SUM(value) * 100 ELSE 0 END, 6)")


QC = f"""
WITH {LIN}
SELECT cells.cell_id, COUNT(gene) FILTER (value <> 0) AS n_genes, coalesce(SUM(value), 0) AS total,
  {_pct(PATTERNS['mt'])} AS pct_mt, {_pct(PATTERNS['ribo'])} AS pct_ribo, {_pct(PATTERNS['hb'])} AS pct_hb,
  round(ln(1 + coalesce(SUM(value), 0)), 6) AS log1p_total, round(ln(1 + COUNT(gene)), 6) AS log1p_n_genes
FROM cells LEFT JOIN expr USING (cell_id) GROUP BY cells.cell_id
"""


def filter_cells_genes(spark, sf):
    d = q.filter_genes(q.filter_cells(lin(spark, sf, "p_partkey"), 4), 20)
    return d.expr.groupBy("gene").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("total"))


FILTER_CG = f"""
WITH {lin_sql('p_partkey')},
kept AS (SELECT cell_id FROM expr WHERE value > 0 GROUP BY cell_id HAVING COUNT(*) >= 4)
SELECT gene, COUNT(*) AS n_cells, SUM(value) AS total FROM expr WHERE cell_id IN (SELECT cell_id FROM kept)
GROUP BY gene HAVING COUNT(*) FILTER (value > 0) >= 20
"""


def filter_cells_kept(spark, sf):
    d = q.filter_cells(lin(spark, sf), 4)
    return d.cells.groupBy("celltype").agg(F.count(F.lit(1)).alias("n"))


FILTER_CELLS = f"""
WITH {LIN} SELECT celltype, COUNT(*) AS n FROM cells WHERE cell_id IN
 (SELECT cell_id FROM expr WHERE value > 0 GROUP BY cell_id HAVING COUNT(*) >= 4) GROUP BY celltype
"""


def filter_min_counts(spark, sf):
    d = q.filter_genes_min_counts(lin(spark, sf, "p_partkey"), 800)
    return d.expr.groupBy("gene").agg(F.sum("value").alias("total"))


FILTER_MIN = f"WITH {lin_sql('p_partkey')} SELECT gene, SUM(value) AS total FROM expr GROUP BY gene HAVING SUM(value) >= 800"


def normalize_total(spark, sf):
    d = lin(spark, sf)
    e = q.normalize_total(d.expr, 1e4, out="norm")
    e = q.normalize_total(e, None, out="med")
    return e.select("cell_id", "gene", r6("norm").alias("norm"), r6("med").alias("med"))


NORMALIZE = f"""
WITH {LIN}, t AS (SELECT cell_id, SUM(value) AS t FROM expr GROUP BY cell_id),
m AS (SELECT quantile_cont(t, 0.5) AS med FROM t WHERE t > 0)
SELECT cell_id, gene, round(value / t * 1e4, 6) AS norm, round(value / t * med, 6) AS med FROM expr JOIN t USING (cell_id), m
"""


def log1p(spark, sf):
    e = q.log1p(q.normalize_total(lin(spark, sf).expr), out="lognorm")
    return e.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("lognorm"), 4).alias("s"), r6(F.max("lognorm")).alias("mx"))


LOG1P = f"""
WITH {LIN}, t AS (SELECT cell_id, SUM(value) AS t FROM expr GROUP BY cell_id)
SELECT gene, COUNT(*) AS n, round(SUM(ln(1 + value / t * 1e4)), 4) AS s, round(MAX(ln(1 + value / t * 1e4)), 6) AS mx
FROM expr JOIN t USING (cell_id) GROUP BY gene
"""


def scale(spark, sf):
    d = lin(spark, sf, "p_type")
    z = q.scale(d, 2.0)
    return z.join(d.cells, "cell_id").groupBy("gene", "celltype").agg(
        r6(F.avg("value")).alias("mean_z"), r6(F.min("value")).alias("min_z"), r6(F.max("value")).alias("max_z"),
        F.count(F.lit(1)).alias("n"))


SCALE = f"""
WITH {lin_sql('p_type')},
dense AS (SELECT c.cell_id, c.celltype, g.gene, coalesce(e.value, 0) AS value
  FROM cells c CROSS JOIN genes g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene),
m AS (SELECT gene, AVG(value) AS mu, stddev_samp(value) AS sd FROM dense GROUP BY gene)
SELECT gene, celltype, round(AVG(z), 6) AS mean_z, round(MIN(z), 6) AS min_z, round(MAX(z), 6) AS max_z, COUNT(*) AS n FROM (
  SELECT gene, celltype, greatest(least((value - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 2), -2) AS z
  FROM dense JOIN m USING (gene)) GROUP BY gene, celltype
"""


def variable_genes(spark, sf):
    d = lin(spark, sf, "p_partkey")
    return q.variable_genes(d, 3).select("gene", r6("std").alias("std"))


VARIABLE = f"""
WITH {lin_sql('p_partkey')}, n AS (SELECT COUNT(*) AS n FROM cells),
m AS (SELECT gene, sqrt(SUM(value * value) / n - (SUM(value) / n) ** 2) AS std FROM genes JOIN expr USING (gene), n GROUP BY gene, n)
SELECT gene, round(std, 6) AS std FROM m WHERE std > 0
"""


def preprocess_chain(spark, sf):
    e = preprocess(lin(spark, sf), filter_method="scanpy", min_genes=3, min_cells=10, hvg_flavor=None).expr
    return e.groupBy("gene").agg(F.sum("counts").alias("counts"), r6(F.sum("value"), 4).alias("lognorm"))


PREPROCESS = f"""
WITH {LIN}, kc AS (SELECT cell_id FROM expr WHERE value > 0 GROUP BY cell_id HAVING COUNT(*) >= 3),
e1 AS (SELECT * FROM expr WHERE cell_id IN (SELECT cell_id FROM kc)),
kg AS (SELECT gene FROM e1 WHERE value > 0 GROUP BY gene HAVING COUNT(*) >= 10),
e2 AS (SELECT * FROM e1 WHERE gene IN (SELECT gene FROM kg)),
t AS (SELECT cell_id, SUM(value) AS t FROM e2 GROUP BY cell_id)
SELECT gene, SUM(value) AS counts, round(SUM(ln(1 + value / t * 1e4)), 4) AS lognorm FROM e2 JOIN t USING (cell_id) GROUP BY gene
"""


def transform_values(spark, sf):
    e = q.transform_values(emb(spark, sf).expr, shift=0.1)
    return e.groupBy("gene").agg(r6(F.sum("value")).alias("s"), F.count_if(F.col("value") == 0).alias("n_clipped"))


TRANSFORM = f"""
WITH {EMB} SELECT gene, round(SUM(ln(1 + greatest(value + 0.1, 0))), 6) AS s,
 COUNT(*) FILTER (greatest(value + 0.1, 0) = 0) AS n_clipped FROM expr GROUP BY gene
"""


def robust_limits(spark, sf):
    a = q.robust_limits(emb(spark, sf).expr).select(r6("vmin").alias("vmin"), r6("vmax").alias("vmax"), F.lit("emb").alias("src"))
    b = q.robust_limits(_dirty(spark, sf).expr, low=0.05, high=0.9).select(r6("vmin").alias("vmin"), r6("vmax").alias("vmax"), F.lit("lin").alias("src"))
    return a.unionByName(b)


ROBUST = f"""
WITH {EMB.replace('expr AS', 'ee AS').replace('FROM expr', 'FROM ee').replace('cells AS', 'ec AS').replace('genes AS', 'eg AS')}, {DIRTY}
SELECT round(quantile_cont(value, 0.01), 6) AS vmin, round(quantile_cont(value, 0.99), 6) AS vmax, 'emb' AS src FROM ee
UNION ALL SELECT round(quantile_cont(value, 0.05), 6), round(quantile_cont(value, 0.9), 6), 'lin' FROM expr
WHERE NOT isnan(value) AND NOT isinf(value)
"""


def mean_expr_global(spark, sf):
    return q.mean_expr_global(lin(spark, sf, "p_partkey")).select("gene", r6("mean_expr").alias("mean_expr"))


MEAN_GLOBAL = f"""
WITH {lin_sql('p_partkey')} SELECT gene, round(coalesce(SUM(value), 0) / (SELECT COUNT(*) FROM cells), 6) AS mean_expr
FROM genes LEFT JOIN expr USING (gene) GROUP BY gene
"""


def mean_expr_by_celltype(spark, sf):
    return q.mean_expr_by_celltype(lin(spark, sf, "p_partkey"), dense=True).select("gene", "celltype", r6("mean_expr").alias("mean_expr"))


MEAN_CT = f"""
WITH {lin_sql('p_partkey')}, n AS (SELECT celltype, COUNT(*) AS n FROM cells GROUP BY celltype),
s AS (SELECT celltype, gene, SUM(value) AS s FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2)
SELECT g.gene, n.celltype, round(coalesce(s, 0) / n, 6) AS mean_expr FROM genes g CROSS JOIN n
LEFT JOIN s ON s.gene = g.gene AND s.celltype = n.celltype
"""


def blacklist_filter(spark, sf):
    g = table(spark, sf, "part").select(F.col("p_name").alias("gene")).distinct()
    return fl.blacklist_filter(g, ["RED", "sm"], force_include=["Small RING", "red widget"])


BLACKLIST = """
SELECT gene, CASE WHEN lower(gene) IN ('small ring', 'red widget') THEN 'forced'
  WHEN lower(gene) LIKE 'mt-%' OR lower(gene) LIKE 'hsp%' OR lower(gene) LIKE 'red%' OR lower(gene) LIKE 'sm%' THEN 'removed'
  ELSE 'kept' END AS blacklist_status FROM (SELECT DISTINCT p_name AS gene FROM part)
"""


def _type_panel(spark, sf):
    k = F.col("p_partkey")
    ct = F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "global", "elsewhere")]), (F.pmod(k, F.lit(5)) + 1).cast("int"))
    return table(spark, sf, "part").select(k.cast("string").alias("gene"), ct.alias("celltype"))


_TYPE_PANEL = """panel AS (SELECT CAST(p_partkey AS VARCHAR) AS gene,
 CASE p_partkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN 'global' ELSE 'elsewhere' END AS celltype FROM part)"""


def expression_filter(spark, sf):
    m = q.mean_expr_by_celltype(lin(spark, sf, "p_partkey"))
    return fl.expression_filter(_type_panel(spark, sf), m, 0.045, 0.06)


EXPR_FILTER = f"""
WITH {lin_sql('p_partkey')}, {_TYPE_PANEL}, n AS (SELECT celltype, COUNT(*) AS n FROM cells GROUP BY celltype),
m AS (SELECT celltype, gene, SUM(value) / n AS e FROM expr JOIN cells USING (cell_id) JOIN n USING (celltype) GROUP BY celltype, gene, n),
anyp AS (SELECT gene, bool_or(e BETWEEN 0.045 AND 0.06) AS ok FROM m GROUP BY gene),
r AS (SELECT p.gene, p.celltype, CASE WHEN p.celltype IN (SELECT celltype FROM m) THEN
   CASE WHEN coalesce(e, 0) < 0.045 THEN 'too_low_expression_' || p.celltype WHEN coalesce(e, 0) > 0.06 THEN 'too_high_expression_' || p.celltype END
   WHEN NOT coalesce(ok, false) THEN 'failed_all_celltypes' END AS xenium_failure_reason
  FROM panel p LEFT JOIN m ON m.gene = p.gene AND m.celltype = p.celltype LEFT JOIN anyp ON anyp.gene = p.gene)
SELECT *, xenium_failure_reason IS NULL AS passed_xenium FROM r
"""


def expression_filter_global(spark, sf):
    m = q.mean_expr_global(lin(spark, sf, "p_partkey"))
    return fl.expression_filter_global(_type_panel(spark, sf), m, 0.045, 0.06)


EXPR_FILTER_G = f"""
WITH {lin_sql('p_partkey')}, {_TYPE_PANEL}, m AS (SELECT gene, SUM(value) / (SELECT COUNT(*) FROM cells) AS e FROM expr GROUP BY gene)
SELECT panel.gene, celltype, CASE WHEN coalesce(e, 0) < 0.045 THEN 'too_low_expression_global' WHEN e > 0.06 THEN 'too_high_expression_global' END AS xenium_failure_reason,
 coalesce(e, 0) BETWEEN 0.045 AND 0.06 AS passed_xenium FROM panel LEFT JOIN m USING (gene)
"""


def filter_celltypes(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_nationkey").cast("string")).alias("celltype"))
    return fl.filter_celltypes(c, 60)


FILTER_CT = "SELECT CAST(c_nationkey AS VARCHAR) AS celltype, COUNT(*) AS n_cells, COUNT(*) >= 60 AS valid FROM customer GROUP BY 1"


def top_n_passing(spark, sf):
    p = part_panel(spark, sf)
    a = fl.top_n_passing(p, 50).select("gene", "rank", F.lit("plain").alias("mode"))
    b = fl.top_n_passing(p, 50, per_celltype=True).select("gene", "rank", F.lit("balanced").alias("mode"))
    return a.unionByName(b)


TOP_N = f"""
WITH {PART_PANEL}, pass AS (SELECT * FROM panel WHERE passed_xenium),
q AS (SELECT *, row_number() OVER (PARTITION BY celltype ORDER BY rank) AS i, COUNT(*) OVER (PARTITION BY celltype) AS c, COUNT(*) OVER () AS n FROM pass),
f AS (SELECT gene, rank FROM q WHERE i <= floor(50 * (c / n))),
rest AS (SELECT gene, rank FROM pass WHERE gene NOT IN (SELECT gene FROM f) ORDER BY rank LIMIT (SELECT 50 - COUNT(*) FROM f))
SELECT gene, rank, 'plain' AS mode FROM (SELECT * FROM pass ORDER BY rank LIMIT 50)
UNION ALL SELECT gene, rank, 'balanced' FROM f UNION ALL SELECT gene, rank, 'balanced' FROM rest
"""


def dot_summary(spark, sf):
    d = lin(spark, sf)
    out = q.dot_summary(d, 5.0, expressed_only=True, standard_scale="gene")
    return out.select("celltype", "gene", r6("fraction").alias("fraction"), r6("mean_expr").alias("mean_expr"),
                      r6(q.dot_size(F.col("fraction"))).alias("size"))


DOT = f"""
WITH {LIN}, n AS (SELECT celltype, COUNT(*) AS n FROM cells GROUP BY celltype),
a AS (SELECT celltype, gene, COUNT(*) FILTER (value > 5) AS k, SUM(value) FILTER (value > 5) AS s FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2),
d AS (SELECT n.celltype, g.gene, coalesce(k, 0) / n AS fraction, coalesce(s / nullif(k, 0), 0) AS m
  FROM genes g CROSS JOIN n LEFT JOIN a ON a.gene = g.gene AND a.celltype = n.celltype),
w AS (SELECT *, MIN(m) OVER (PARTITION BY gene) AS lo, MAX(m) OVER (PARTITION BY gene) AS hi FROM d)
SELECT celltype, gene, round(fraction, 6) AS fraction, round((m - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS mean_expr,
  round(200 * fraction ** 1.5, 6) AS size FROM w
"""

_SEURAT_IN = "(SELECT gene, n, SUM(x) / n AS mean, (SUM(x * x) - SUM(x) * SUM(x) / n) / (n - 1) AS var FROM {src}, (SELECT COUNT(*) AS n FROM cells) GROUP BY gene, n)"


def hvg_seurat(spark, sf):
    d = lin(spark, sf, "p_partkey")
    d = ExprData(q.log1p(q.normalize_total(d.expr)), d.cells, d.genes)
    return q.hvg(d, "seurat", n=100).select("gene", r6("means").alias("means"), r6("dispersions").alias("dispersions"),
                                            r6("dispersions_norm").alias("dispersions_norm"), "highly_variable")


HVG_SEURAT = f"""
WITH {lin_sql('p_partkey')}, t AS (SELECT cell_id, SUM(value) AS t FROM expr GROUP BY cell_id),
x AS (SELECT gene, exp(ln(1 + value / t * 1e4)) - 1 AS x FROM expr JOIN t USING (cell_id)),
m0 AS (SELECT g.gene, coalesce(mean, 0) AS mean, coalesce(var, 0) AS var FROM genes g LEFT JOIN {_SEURAT_IN.format(src='x')} USING (gene)),
m AS (SELECT gene, ln(1 + CASE WHEN mean = 0 THEN 1e-12 ELSE mean END) AS means, CASE WHEN var > 0 THEN ln(var / mean) END AS disp FROM m0),
b AS (SELECT *, least(greatest(ceil((means - MIN(means) OVER ()) / ((MAX(means) OVER () - MIN(means) OVER ()) / 20)), 1), 20) AS bin FROM m),
s AS (SELECT bin, AVG(disp) AS mu, stddev_samp(disp) AS sd FROM b GROUP BY bin),
z AS (SELECT gene, means, disp, CASE WHEN sd IS NULL THEN CASE WHEN mu <> 0 THEN disp / mu END WHEN sd <> 0 THEN (disp - mu) / sd END AS dn FROM b JOIN s USING (bin)),
top AS (SELECT gene FROM z WHERE dn IS NOT NULL ORDER BY dn DESC, gene LIMIT 100)
SELECT gene, round(means, 6) AS means, round(disp, 6) AS dispersions, round(dn, 6) AS dispersions_norm, gene IN (SELECT gene FROM top) AS highly_variable FROM z
"""


def hvg_cell_ranger(spark, sf):
    d = lin(spark, sf, "p_partkey")
    return q.hvg(d, "cell_ranger", n=100).select("gene", r6("means").alias("means"), r6("dispersions").alias("dispersions"),
                                                 r6("dispersions_norm").alias("dispersions_norm"), "highly_variable")


_EDGES = ", ".join(f"quantile_cont(mean, {p / 100})" for p in range(10, 105, 5))
HVG_CR = f"""
WITH {lin_sql('p_partkey')}, x AS (SELECT gene, value AS x FROM expr),
m AS (SELECT g.gene, coalesce(mean, 0) AS mean, coalesce(var, 0) / CASE WHEN coalesce(mean, 0) = 0 THEN 1e-12 ELSE mean END AS disp
  FROM genes g LEFT JOIN {_SEURAT_IN.format(src='x')} USING (gene)),
e AS (SELECT [{_EDGES}] AS edges FROM m),
b AS (SELECT gene, mean, disp, len(list_filter(edges, lambda e: e < mean)) AS bin FROM m, e),
md AS (SELECT bin, quantile_cont(disp, 0.5) AS med FROM b GROUP BY bin),
dv AS (SELECT b.*, med, abs(disp - med) AS dev FROM b JOIN md USING (bin)),
ma AS (SELECT bin, quantile_cont(dev, 0.5) AS mad FROM dv GROUP BY bin),
z AS (SELECT gene, mean, disp, CASE WHEN mad <> 0 THEN (disp - med) / (mad / 0.6744897501960817) END AS dn FROM dv JOIN ma USING (bin)),
top AS (SELECT gene FROM z WHERE dn IS NOT NULL ORDER BY dn DESC, gene LIMIT 100)
SELECT gene, round(mean, 6) AS means, round(disp, 6) AS dispersions, round(dn, 6) AS dispersions_norm, gene IN (SELECT gene FROM top) AS highly_variable FROM z
"""


def hvg_seurat_v3(spark, sf):
    d = lin(spark, sf, "p_partkey")
    return q.hvg(d, "seurat_v3", n=100).select("gene", r6("means").alias("means"), r6("variances").alias("variances"),
                                               r6("variances_norm", 4).alias("variances_norm"))


HVG_V3 = f"""
WITH {lin_sql('p_partkey')}, x AS (SELECT gene, value AS x FROM expr),
m AS (SELECT g.gene, (SELECT COUNT(*) FROM cells) AS n, coalesce(mean, 0) AS mean, coalesce(var, 0) AS var
  FROM genes g LEFT JOIN {_SEURAT_IN.format(src='x')} USING (gene)),
p0 AS (SELECT log10(mean) AS x0, log10(var) AS y FROM m WHERE mean > 0 AND var > 0),
p AS (SELECT x0 - (SELECT AVG(x0) FROM p0) AS x, y FROM p0),
s AS (SELECT COUNT(*) AS s0, SUM(x) AS s1, SUM(x*x) AS s2, SUM(x*x*x) AS s3, SUM(x*x*x*x) AS s4, SUM(y) AS t0, SUM(x*y) AS t1, SUM(x*x*y) AS t2 FROM p),
c AS (SELECT s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS d,
  t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2) AS d0,
  s0*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2) AS d1,
  s0*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2) AS d2 FROM s),
f AS (SELECT m.*, log10(CASE WHEN mean > 0 THEN mean END) - (SELECT AVG(x0) FROM p0) AS lx FROM m),
st AS (SELECT f.*, sqrt(10 ** (d0/d + d1/d*lx + d2/d*lx*lx)) AS sd FROM f, c),
cl AS (SELECT e.gene, SUM(least(e.value, st.mean + st.sd*sqrt(st.n))) AS c1, SUM(least(e.value, st.mean + st.sd*sqrt(st.n))**2) AS c2
  FROM expr e JOIN st ON st.gene = e.gene GROUP BY e.gene)
SELECT st.gene, round(mean, 6) AS means, round(var, 6) AS variances,
 round(CASE WHEN sd > 0 THEN (n*mean*mean + coalesce(c2,0) - 2*mean*coalesce(c1,0)) / ((n-1)*sd*sd) ELSE 0 END, 4) AS variances_norm
FROM st LEFT JOIN cl ON cl.gene = st.gene
"""

QUERIES = [
    Query("read_expr", read_expr, READ_EXPR),
    Query("is_raw_counts", is_raw_counts, IS_RAW),
    Query("data_issues", data_issues, DATA_ISSUES),
    Query("sanitize", sanitize, SANITIZE),
    Query("qc_metrics", qc_metrics, QC),
    Query("filter_cells", filter_cells_kept, FILTER_CELLS),
    Query("filter_cells_then_genes", filter_cells_genes, FILTER_CG),
    Query("filter_genes_min_counts", filter_min_counts, FILTER_MIN),
    Query("normalize_total", normalize_total, NORMALIZE),
    Query("log1p", log1p, LOG1P),
    Query("scale", scale, SCALE),
    Query("variable_genes", variable_genes, VARIABLE),
    Query("preprocess", preprocess_chain, PREPROCESS),
    Query("transform_values", transform_values, TRANSFORM),
    Query("robust_limits", robust_limits, ROBUST),
    Query("mean_expr_global", mean_expr_global, MEAN_GLOBAL),
    Query("mean_expr_by_celltype", mean_expr_by_celltype, MEAN_CT),
    Query("blacklist_filter", blacklist_filter, BLACKLIST),
    Query("expression_filter", expression_filter, EXPR_FILTER),
    Query("expression_filter_global", expression_filter_global, EXPR_FILTER_G),
    Query("filter_celltypes", filter_celltypes, FILTER_CT),
    Query("top_n_passing", top_n_passing, TOP_N),
    Query("dot_summary", dot_summary, DOT),
    Query("hvg_seurat", hvg_seurat, HVG_SEURAT),
    Query("hvg_cell_ranger", hvg_cell_ranger, HVG_CR),
    Query("hvg_seurat_v3", hvg_seurat_v3, HVG_V3),
]
