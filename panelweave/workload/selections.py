"""Whole selections by every strategy: each gene's path through the log, recomputed in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.plans import selection as se
from panelweave.plans.selection_log import Learned, select_logged
from panelweave.schema import ExprData
from panelweave.workload.markers import P_VALUES, _wilcoxon_sql
from panelweave.workload.panels import ACROSS, PRIMARY_CTE, _SEL, _resolve_sql
from panelweave.workload.quality import _SEURAT_IN
from panelweave.workload.standins import Query, rounded, table

SIZE, BOUNDS = 90, (0.055, 0.066)
_N = 200


def matrix(spark, sf) -> ExprData:
    """Orders by part group, logs of quantities."""
    gene = lambda c: F.concat(F.lit("P"), F.pmod(c, F.lit(_N)))
    expr = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), gene("l_partkey").alias("gene")).agg(F.log1p(F.sum("l_quantity")).alias("value"))
    cells = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("celltype"))
    return ExprData(expr, cells, table(spark, sf, "part").select(gene("p_partkey").alias("gene")).distinct())


def _learned(spark, sf, per_celltype: bool = True) -> Learned:
    """Fits that SQL can state: sums of quantities by supplier group."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    gene = F.concat(F.lit("P"), F.pmod("l_partkey", F.lit(_N))).alias("gene")
    q, n = F.sum(F.col("l_quantity").cast("long")), F.count(F.lit(1))
    forest = li.groupBy(gene, F.pmod("l_suppkey", F.lit(5)).cast("string").alias("fold")).agg((q % 128 / 128.0).alias("importance"), (n % 16 / 16.0).alias("f1_score"))
    scope = F.col("o_orderpriority") if per_celltype else F.lit("global")
    loadings = li.groupBy(scope.alias("scope"), F.pmod("l_suppkey", F.lit(4)).cast("int").alias("factor"), gene).agg((q - 25 * n).cast("double").alias("loading"))
    return Learned(forest=forest, loadings=loadings)


def _query(strategy: str, analysis_type: str = "per_celltype"):
    per_ct = analysis_type == "per_celltype"

    def run(spark, sf):
        cfg = se.SelectionConfig(strategy, SIZE, analysis_type, k=4, pool=100 if per_ct else 60, expression_bounds=BOUNDS, blacklist=("P17",), force_include=("P171",), max_pval=0.2)
        log = select_logged(matrix(spark, sf), cfg, _learned(spark, sf, per_ct))
        return log.provenance().withColumn("selection_score", rounded("selection_score"))

    return run


# --- the same in SQL -------------------------------------------------------------------------

_BASE = f"""expr0 AS (SELECT l_orderkey AS cell_id, 'P' || (l_partkey % {_N}) AS gene, ln(1 + SUM(l_quantity)) AS value FROM lineitem GROUP BY 1, 2),
cells AS (SELECT o_orderkey AS cell_id, o_orderpriority AS celltype FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING COUNT(*) >= 10)),
bl AS (SELECT gene, CASE WHEN lower(gene) = 'p171' THEN 'forced' WHEN starts_with(lower(gene), 'p17') THEN 'removed' ELSE 'kept' END AS s FROM (SELECT DISTINCT 'P' || (p_partkey % {_N}) AS gene FROM part)),
genes AS (SELECT gene FROM bl WHERE s <> 'removed'),
expr AS (SELECT e.* FROM expr0 e JOIN cells USING (cell_id) WHERE gene IN (SELECT gene FROM genes)),
means AS (SELECT celltype, gene, SUM(value) / any_value(n) AS m FROM expr JOIN cells USING (cell_id) JOIN (SELECT celltype, COUNT(*) AS n FROM cells GROUP BY 1) USING (celltype) GROUP BY 1, 2),
anyok AS (SELECT gene, bool_or(m BETWEEN {BOUNDS[0]} AND {BOUNDS[1]}) AS k FROM means GROUP BY 1)"""

_DEG = _wilcoxon_sql(_BASE, ", " + P_VALUES).strip().removeprefix("WITH ")

_FOREST = f"""li AS (SELECT 'P' || (l_partkey % {_N}) AS gene, l_suppkey, l_quantity, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fs AS (SELECT gene, l_suppkey % 5 AS fold, (SUM(CAST(l_quantity AS BIGINT)) % 128) / 128.0::DOUBLE AS i, (COUNT(*) % 16) / 16.0::DOUBLE AS f FROM li GROUP BY 1, 2)"""
_RANKED = "fz AS (SELECT gene, AVG(i * f) AS score FROM fs WHERE gene IN (SELECT gene FROM cand) GROUP BY 1), fr AS (SELECT *, row_number() OVER (ORDER BY score DESC, gene) AS rank FROM fz)"
_HEADS = "cand AS (SELECT DISTINCT gene FROM (SELECT gene, row_number() OVER (PARTITION BY \"group\" ORDER BY scores DESC, gene) AS i FROM adj) WHERE i <= {n})"


def _loadings(scope: str) -> str:
    return f"loadings AS (SELECT {scope} AS scope, CAST(l_suppkey % 4 AS INTEGER) AS factor, gene, CAST(SUM(CAST(l_quantity AS BIGINT)) - 25 * COUNT(*) AS DOUBLE) AS loading FROM li WHERE gene IN (SELECT gene FROM genes) GROUP BY 1, 2, 3)"


def _raw(n: int) -> str:
    return f"raw AS (SELECT *, abs(loading) AS weight, row_number() OVER (PARTITION BY scope, factor ORDER BY abs(loading) DESC, gene) AS pool_rank FROM loadings QUALIFY pool_rank <= {n})"


def _dimred(size: int, per_celltype: bool) -> str:
    """``dim(gene, celltype, rank, score, sel)`` and the pool before (``raw``) and after (``pool``) the bounds."""
    lo, hi = BOUNDS
    if per_celltype:
        pool = f"pool AS (SELECT raw.* FROM raw LEFT JOIN means ON celltype = scope AND means.gene = raw.gene WHERE scope NOT IN (SELECT celltype FROM means) OR coalesce(m, 0) BETWEEN {lo} AND {hi})"
        head = _resolve_sql(_loadings("o_orderpriority"), 25, "greatest(1, np // 4)")
        a, b = head.index("pool AS ("), head.index(", prim AS (")
        head = head[:a] + _raw(25) + ", " + pool + head[b:]
        return f"""{head}, {ACROSS}, {_SEL.format(z=size, per=5)},
dim AS (SELECT gene, celltype, row_number() OVER (ORDER BY n_celltypes DESC, weight DESC, gene) AS rank, weight AS score, gene IN (SELECT gene FROM kp{size}) OR gene IN (SELECT gene FROM fl{size}) AS sel FROM res)"""
    per = -(-size // 4)
    return f"""{_loadings("'global'")}, {_raw(60)}, gm AS (SELECT gene, SUM(m) / (SELECT COUNT(DISTINCT celltype) FROM means) AS m FROM means GROUP BY gene),
pool AS (SELECT raw.* FROM raw LEFT JOIN gm USING (gene) WHERE coalesce(m, 0) BETWEEN {lo} AND {hi}), {PRIMARY_CTE},
top AS (SELECT gene FROM (SELECT gene, weight, row_number() OVER (PARTITION BY factor ORDER BY weight DESC, gene) AS r FROM prim) WHERE r <= {per} ORDER BY weight DESC, gene LIMIT {size}),
dim AS (SELECT gene, 'global' AS celltype, row_number() OVER (ORDER BY weight DESC, gene) AS rank, weight AS score, gene IN (SELECT gene FROM top) AS sel FROM prim)"""


def _row(step: str, said: str, effect: str, of: str, reason: str = "NULL", known: str = "NULL, NULL, NULL") -> str:
    return f"SELECT {step} AS step, gene, {said} AS said, {effect} AS effect, CAST({reason} AS VARCHAR) AS reason, {known} FROM {of}"


_FIRST = _row("0", "'blacklist:' || s", "CASE s WHEN 'removed' THEN 'out' ELSE 'keep' END", "bl").replace("NULL, NULL, NULL", "CAST(NULL AS VARCHAR) AS celltype, CAST(NULL AS BIGINT) AS rank, CAST(NULL AS DOUBLE) AS score")
_POOLED = [_row("4", "'pool:pooled'", "'offer'", "(SELECT DISTINCT gene FROM raw)"),
           _row("5", "CASE WHEN k THEN 'pool_bounds:passed' ELSE 'pool_bounds:failed' END", "CASE WHEN k THEN 'keep' ELSE 'out' END", "(SELECT DISTINCT gene, gene IN (SELECT gene FROM pool) AS k FROM raw)", "CASE WHEN NOT k THEN 'out_of_range_in_pool' END")]
_FOLD = """f AS (SELECT gene, string_agg(said, ' > ' ORDER BY step) AS path, MAX(step) FILTER (effect = 'in') AS i, MAX(step) FILTER (effect = 'out') AS o, arg_max(said, step) FILTER (effect = 'in') AS what,
 arg_max({'c': celltype, 'r': rank, 's': score}, step) FILTER (effect IN ('in', 'offer')) AS k, arg_max(reason, step) FILTER (reason IS NOT NULL) AS failure_reason FROM ev GROUP BY gene)
SELECT gene, path, coalesce(i > coalesce(o, -1), false) AS final_selection, CASE WHEN i > coalesce(o, -1) THEN CASE WHEN i >= 8 THEN split_part(what, ':', 2) ELSE split_part(what, ':', 1) END END AS gene_source,
 k.c AS celltype, k.r AS rank, round(k.s, 6) AS selection_score, failure_reason FROM f"""


def _single(cte: str, aware: bool = False, bounds: bool = True, pooled: bool = False) -> str:
    """``cte`` ends in ``st(gene, celltype, rank, score, sel)``."""
    lo, hi = BOUNDS
    reason = "CASE WHEN NOT coalesce(k, false) THEN 'failed_all_celltypes' END"
    if aware:
        reason = f"CASE WHEN coalesce(m, 0) < {lo} THEN 'too_low_expression_' || st.celltype WHEN coalesce(m, 0) > {hi} THEN 'too_high_expression_' || st.celltype END"
    judged = f"ok AS (SELECT st.gene, st.celltype, st.rank, st.score, st.sel, {reason if bounds else 'NULL'} AS reason FROM st LEFT JOIN anyok USING (gene) LEFT JOIN means ON means.gene = st.gene AND means.celltype = st.celltype)"
    fill = f"""fc AS (SELECT *, row_number() OVER (ORDER BY score DESC, gene) AS i FROM ok WHERE NOT sel AND reason IS NULL), fill AS (SELECT * FROM fc WHERE i <= {SIZE} - (SELECT COUNT(*) FROM ok WHERE sel AND reason IS NULL))"""
    known = "celltype, rank, score"
    rows = [_FIRST, *(_POOLED if pooled else []), _row("6", "CASE WHEN sel THEN 'strategy:selected' ELSE 'strategy:candidate' END", "CASE WHEN sel THEN 'in' ELSE 'offer' END", "ok", known=known)]
    if bounds:
        rows.append(_row("7", "CASE WHEN reason IS NULL THEN 'bounds:passed' ELSE 'bounds:failed' END", "CASE WHEN reason IS NULL THEN 'keep' ELSE 'out' END", "ok", "reason"))
    rows.append(_row("9", "'gap_fill:filled'", "'in'", "fill", known=known))
    return f"WITH {cte}, {judged}, {fill}, ev AS ({' UNION ALL '.join(rows)}), {_FOLD}"


def _combined(per_celltype: bool) -> str:
    label = "gap_fill_celltype" if per_celltype else "gap_fill_global"
    n_rf = int((SIZE - 1) * 0.25)
    n_dim = SIZE - 1 - n_rf
    cte = f"""{_DEG}, {_FOREST}, {_HEADS.format(n=50)}, {_RANKED}, {_dimred(int(n_dim * 1.5), per_celltype)},
rf AS (SELECT fr.*, coalesce(k, false) AS k FROM fr LEFT JOIN anyok USING (gene)),
tr AS (SELECT * FROM rf WHERE k AND gene <> 'P171' ORDER BY rank, gene LIMIT {n_rf}), td AS (SELECT * FROM dim WHERE gene <> 'P171' ORDER BY rank, gene LIMIT {n_dim}),
cmb AS (SELECT gene, CASE WHEN gene IN (SELECT gene FROM td) THEN 'overlap→rf_deg' ELSE 'rf_deg' END AS src, 'global' AS celltype, rank, score FROM tr
 UNION ALL SELECT gene, 'dimred', celltype, rank, score FROM td WHERE gene NOT IN (SELECT gene FROM tr) UNION ALL SELECT gene, 'force_include', 'global', NULL, NULL FROM genes WHERE gene = 'P171'),
off AS (SELECT 0 AS tier, rank, gene, '{label}' AS src FROM dim UNION ALL SELECT 1, rank, gene, 'gap_fill_deg' FROM rf WHERE k),
fo AS (SELECT * FROM off WHERE gene NOT IN (SELECT gene FROM cmb) QUALIFY row_number() OVER (PARTITION BY gene ORDER BY tier, rank) = 1),
fill AS (SELECT * FROM fo ORDER BY tier, rank, gene LIMIT (SELECT {SIZE} - COUNT(*) FROM cmb))"""
    rows = [_FIRST, _row("1", "'force_include:forced'", "'in'", "(SELECT gene FROM genes WHERE gene = 'P171')"), _row("2", "'forest:candidate'", "'offer'", "rf", known="'global', rank, score"),
            _row("3", "CASE WHEN k THEN 'forest_bounds:passed' ELSE 'forest_bounds:failed' END", "CASE WHEN k THEN 'keep' ELSE 'out' END", "rf", "CASE WHEN NOT k THEN 'failed_all_celltypes' END"),
            *_POOLED, _row("6", "'strategy:candidate'", "'offer'", "dim", known="celltype, rank, score"), _row("8", "'combine:' || src", "'in'", "cmb", known="celltype, rank, score"),
            _row("9", "'gap_fill:' || src", "'in'", "fill", known="'global', NULL, NULL")]
    return f"WITH {cte}, ev AS ({' UNION ALL '.join(rows)}), {_FOLD}"


_PER = SIZE // 5
_DEG_ST = f"""first AS (SELECT gene, "group" AS celltype, scores AS score FROM (SELECT * FROM adj WHERE pvals_adj <= 0.2 QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY scores DESC, gene) <= {_PER}) QUALIFY row_number() OVER (PARTITION BY gene ORDER BY scores DESC, "group" DESC) = 1),
ofr AS (SELECT gene, CASE WHEN pvals_adj <= 0.2 THEN 1 ELSE 2 END AS tier, "group" AS g, scores FROM adj WHERE gene NOT IN (SELECT gene FROM first)),
o1 AS (SELECT gene, tier, g, scores FROM ofr QUALIFY row_number() OVER (PARTITION BY gene ORDER BY tier, g, scores DESC) = 1),
b1 AS (SELECT gene, g AS celltype, scores AS score FROM ofr QUALIFY row_number() OVER (PARTITION BY gene ORDER BY scores DESC, g DESC) = 1),
ob AS (SELECT o1.gene, tier, celltype, score, row_number() OVER (ORDER BY tier, g, scores DESC, o1.gene) AS i FROM o1 JOIN b1 USING (gene)),
un AS (SELECT gene, celltype, score, true AS sel FROM first UNION ALL SELECT gene, celltype, score, i <= {SIZE} - (SELECT COUNT(*) FROM first) FROM ob WHERE tier = 1 OR i <= {SIZE} - (SELECT COUNT(*) FROM first)),
st AS (SELECT gene, celltype, row_number() OVER (ORDER BY score DESC, gene) AS rank, score, sel FROM un)"""
_FOREST_ST = f"st AS (SELECT gene, 'global' AS celltype, rank, score, rank <= {SIZE} AS sel FROM fr)"
_HVG_ST = f"""x AS (SELECT gene, exp(value) - 1 AS x FROM expr),
m0 AS (SELECT g.gene, coalesce(mean, 0) AS mean, coalesce(var, 0) AS var FROM genes g LEFT JOIN {_SEURAT_IN.format(src='x')} USING (gene)),
mv AS (SELECT gene, ln(1 + CASE WHEN mean = 0 THEN 1e-12 ELSE mean END) AS means, CASE WHEN var > 0 THEN ln(var / mean) END AS disp FROM m0),
bb AS (SELECT *, least(greatest(ceil((means - MIN(means) OVER ()) / ((MAX(means) OVER () - MIN(means) OVER ()) / 20)), 1), 20) AS bin FROM mv),
sb AS (SELECT bin, AVG(disp) AS mu, stddev_samp(disp) AS sd FROM bb GROUP BY bin),
z AS (SELECT gene, CASE WHEN sd IS NULL THEN CASE WHEN mu <> 0 THEN disp / mu END WHEN sd <> 0 THEN (disp - mu) / sd END AS dn FROM bb JOIN sb USING (bin)),
st AS (SELECT gene, 'global' AS celltype, row_number() OVER (ORDER BY dn DESC, gene) AS rank, dn AS score, true AS sel FROM z WHERE dn IS NOT NULL ORDER BY dn DESC, gene LIMIT {SIZE})"""
_RANDOM_ST = f"st AS (SELECT gene, 'global' AS celltype, row_number() OVER (ORDER BY md5(gene || ':42'), gene) AS rank, CAST(NULL AS DOUBLE) AS score, true AS sel FROM genes QUALIFY rank <= {SIZE})"
_DIM_ST = "st AS (SELECT * FROM dim)"

QUERIES = [
    Query("selection_log_deg_only", _query("deg_only"), _single(f"{_DEG}, {_DEG_ST}", aware=True)),
    Query("selection_log_rf_simple", _query("rf_simple"), _single(f"{_BASE}, {_FOREST}, cand AS (SELECT gene FROM genes), {_RANKED}, {_FOREST_ST}")),
    Query("selection_log_rf_deg", _query("rf_deg"), _single(f"{_DEG}, {_FOREST}, {_HEADS.format(n=max(50, SIZE // 5 * 3))}, {_RANKED}, {_FOREST_ST}")),
    Query("selection_log_hvg", _query("hvg"), _single(f"{_BASE}, {_HVG_ST}")),
    Query("selection_log_random", _query("random"), _single(f"{_BASE}, {_RANDOM_ST}")),
    Query("selection_log_dimred_only", _query("dimred_only"), _single(f"{_BASE}, {_FOREST}, {_dimred(SIZE, True)}, {_DIM_ST}", bounds=False, pooled=True)),
    Query("selection_log_dimred_global", _query("dimred_only", "global"), _single(f"{_BASE}, {_FOREST}, {_dimred(SIZE, False)}, {_DIM_ST}", bounds=False, pooled=True)),
    Query("selection_log_rf_nmf", _query("rf_nmf"), _combined(True)),
    Query("selection_log_rf_pca", _query("rf_pca", "global"), _combined(False)),
]
