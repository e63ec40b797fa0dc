"""Queries over panel construction: pools, duplicates, gap filling, combination, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import loadings as ld
from panelweave.operators import panels as pn
from panelweave.operators import provenance as pv
from panelweave.workload.markers import DEG, deg_table
from panelweave.operators.markers import bh_adjust
from panelweave.workload.standins import PART_PANEL, Query, loadings_sql, part_loadings, part_panel, r6, table

LD, LDG = loadings_sql(True), loadings_sql(False)

# --- pools and duplicates --------------------------------------------------------------------


def factor_pool(spark, sf):
    return ld.factor_pool(part_loadings(spark, sf), 30).select("scope", "factor", "gene", "weight", "pool_rank")


POOL = """pool AS (SELECT *, abs(loading) AS weight, row_number() OVER (PARTITION BY scope, factor ORDER BY abs(loading) DESC, gene) AS pool_rank FROM loadings QUALIFY pool_rank <= {n})"""


def _means(spark, sf):
    t = table(spark, sf, "part")
    return t.groupBy(F.col("p_type").alias("celltype"), F.concat(F.lit("P"), F.pmod("p_partkey", F.lit(500))).alias("gene")).agg(
        (F.avg("p_size") * 4).alias("mean_expr")).filter("celltype <> 'PROMO'")


MEANS = "means AS (SELECT p_type AS celltype, 'P' || (p_partkey % 500) AS gene, AVG(p_size) * 4 AS mean_expr FROM part WHERE p_type <> 'PROMO' GROUP BY 1, 2)"


def pool_filter(spark, sf):
    m = _means(spark, sf)
    a = ld.pool_expression_filter(ld.factor_pool(part_loadings(spark, sf), 30), m, True).select("scope", "factor", "gene")
    b = ld.pool_expression_filter(ld.factor_pool(part_loadings(spark, sf, False), 100), m, False).select("scope", "factor", "gene")
    return a.unionByName(b)


POOL_FILTER = f"""WITH {LD}, {POOL.format(n=30)}, {MEANS}, {LDG.replace('loadings AS', 'gload AS')}, {POOL.format(n=100).replace('pool AS', 'gpool AS').replace('FROM loadings', 'FROM gload')},
gm AS (SELECT gene, SUM(mean_expr) / (SELECT COUNT(DISTINCT celltype) FROM means) AS m FROM means GROUP BY gene)
SELECT scope, factor, pool.gene FROM pool LEFT JOIN means ON celltype = scope AND means.gene = pool.gene WHERE scope NOT IN (SELECT celltype FROM means) OR coalesce(mean_expr, 0) BETWEEN 0.1 AND 100
UNION ALL SELECT scope, factor, gene FROM gpool LEFT JOIN gm USING (gene) WHERE coalesce(m, 0) BETWEEN 0.1 AND 100"""


def primary(spark, sf):
    return ld.assign_primary_factor(ld.factor_pool(part_loadings(spark, sf), 40)).select("scope", "factor", "gene", "weight")


PRIMARY_CTE = "prim AS (SELECT scope, factor, gene, loading, weight FROM pool QUALIFY row_number() OVER (PARTITION BY scope, gene ORDER BY weight DESC, factor) = 1)"
PRIMARY = f"WITH {LD}, {POOL.format(n=40)}, {PRIMARY_CTE} SELECT scope, factor, gene, weight FROM prim"


def _resolve_sql(load: str, n: int, target: str, k: int = 4) -> str:
    s = f"""{load}, {POOL.format(n=n)}, {PRIMARY_CTE},
gaps AS (SELECT f.scope, f.factor, {target} - coalesce(c, 0) AS gap FROM (SELECT DISTINCT scope, factor FROM loadings) f
  LEFT JOIN (SELECT scope, factor, COUNT(*) AS c FROM prim GROUP BY 1, 2) p ON p.scope = f.scope AND p.factor = f.factor
  JOIN (SELECT scope, COUNT(*) AS np FROM pool GROUP BY 1) g ON g.scope = f.scope),
s0 AS (SELECT scope, factor, gene, loading, weight, 'pool' AS source FROM prim)"""
    for f in range(k):
        s += f""",
s{f + 1} AS (SELECT * FROM s{f} UNION ALL SELECT scope, factor, gene, loading, abs(loading), 'replacement' FROM (
  SELECT l.*, gap, row_number() OVER (PARTITION BY l.scope ORDER BY loading DESC, l.gene) AS i FROM loadings l JOIN gaps g ON g.scope = l.scope AND g.factor = l.factor
  WHERE l.factor = {f} AND gap > 0 AND NOT EXISTS (SELECT 1 FROM s{f} x WHERE x.scope = l.scope AND x.gene = l.gene)) WHERE i <= gap)"""
    return s


def resolve_global(spark, sf):
    l = part_loadings(spark, sf, False)
    return ld.resolve_duplicates(ld.factor_pool(l, 40), l, 4, 40).select("factor", "gene", "loading", "source")


RESOLVE_G = f"WITH {_resolve_sql(LDG, 40, '40')} SELECT factor, gene, loading, source FROM s4"


def resolve_celltypes(spark, sf):
    l = part_loadings(spark, sf)
    p = ld.factor_pool(l, 25)
    return ld.resolve_across_celltypes(ld.resolve_duplicates(p, l, 4), p)


ACROSS = """own AS (SELECT gene, scope AS celltype, factor, loading, weight FROM s4 QUALIFY row_number() OVER (PARTITION BY gene ORDER BY scope DESC, factor DESC) = 1),
ty AS (SELECT gene, COUNT(DISTINCT scope) AS n, string_agg(DISTINCT scope, ', ' ORDER BY scope) AS ct FROM pool GROUP BY gene),
res AS (SELECT own.*, coalesce(n, 1) AS n_celltypes, coalesce(ct, celltype) AS contributing_celltypes FROM own LEFT JOIN ty USING (gene))"""
RESOLVE_CT = f"WITH {_resolve_sql(LD, 25, 'greatest(1, np // 4)')}, {ACROSS} SELECT * FROM res"


def fill_gap(spark, sf):
    l = part_loadings(spark, sf)
    used = l.filter("loading > 40")
    gaps = l.groupBy("scope").agg((F.length("scope") * 3 + 5).alias("gap")).select("scope", "gap")
    return ld.fill_gap_factor_aware(l, used, gaps, 4)


FILL_GAP = f"""WITH {LD}, gaps AS (SELECT DISTINCT scope, length(scope) * 3 + 5 AS gap FROM loadings), u0 AS (SELECT DISTINCT scope, gene FROM loadings WHERE loading > 40)"""
for _f in range(4):
    FILL_GAP += f""", a{_f} AS (SELECT * EXCLUDE (gap, i) FROM (SELECT l.*, gap, row_number() OVER (PARTITION BY l.scope ORDER BY loading DESC, l.gene) AS i FROM loadings l JOIN gaps USING (scope)
 WHERE factor = {_f} AND NOT EXISTS (SELECT 1 FROM u{_f} x WHERE x.scope = l.scope AND x.gene = l.gene)) WHERE i <= gap // 4 + CASE WHEN {_f} < gap % 4 THEN 1 ELSE 0 END),
u{_f + 1} AS (SELECT * FROM u{_f} UNION SELECT scope, gene FROM a{_f})"""
FILL_GAP += " SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3"


def pools_text(spark, sf):
    p = part_panel(spark, sf).withColumn("component", F.pmod("rank", F.lit(9)))
    return ld.replacement_pools(p, ("celltype", "component"))


POOLS_TEXT = f"WITH {PART_PANEL} SELECT celltype, rank % 9 AS component, string_agg(gene, ',' ORDER BY rank) AS genes FROM panel GROUP BY 1, 2"


def balance(spark, sf):
    l = part_loadings(spark, sf, False)
    d = ld.factor_balance_report(ld.assign_primary_factor(ld.factor_pool(l, 60)), 45.0)
    return d.withColumn("deviation", r6("deviation"))


BALANCE = f"WITH {LDG}, {POOL.format(n=60)}, {PRIMARY_CTE}, c AS (SELECT factor, COUNT(*) AS n_genes FROM prim GROUP BY 1) SELECT factor, n_genes, round(abs(n_genes - 45.0) / 45.0, 6) AS deviation, abs(n_genes - 45.0) / 45.0 > 0.1 AS imbalanced, n_genes < 1 AS too_few FROM c"


def select_global(spark, sf):
    l = part_loadings(spark, sf, False)
    return ld.select_from_pool_global(ld.assign_primary_factor(ld.factor_pool(l, 60)), 90, 4).select("factor", "gene", "weight")


SELECT_G = f"""WITH {LDG}, {POOL.format(n=60)}, {PRIMARY_CTE},
s AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY weight DESC, gene) AS r FROM prim QUALIFY r <= 23),
c AS (SELECT *, COUNT(*) OVER (PARTITION BY factor) AS c, COUNT(*) OVER () AS n FROM s),
t AS (SELECT *, r > c - greatest(0, least(c - 24, c - 1)) AS tail FROM c),
d AS (SELECT gene FROM t WHERE tail QUALIFY row_number() OVER (ORDER BY weight, gene DESC) <= n - 90)
SELECT factor, gene, weight FROM t WHERE gene NOT IN (SELECT gene FROM d) ORDER BY weight DESC, gene LIMIT 90"""


def select_celltypes(spark, sf):
    l = part_loadings(spark, sf)
    p = ld.factor_pool(l, 25)
    res = ld.pin(ld.resolve_across_celltypes(ld.resolve_duplicates(p, l, 4), p))
    out = None
    for size in (60, 400):
        o = ld.select_from_pool_per_celltype(res, size, 4, 6).select("gene", "celltype", "factor", "source", F.lit(size).alias("size"))
        out = o if out is None else out.unionByName(o)
    return out


_SEL = """st{z} AS (SELECT *, row_number() OVER (PARTITION BY celltype, factor ORDER BY weight DESC, gene) AS r FROM res QUALIFY r <= {per}),
kp{z} AS (SELECT * FROM st{z} ORDER BY weight DESC, gene LIMIT {z}),
fl{z} AS (SELECT * FROM res WHERE gene NOT IN (SELECT gene FROM st{z}) ORDER BY n_celltypes DESC, weight DESC, gene LIMIT (SELECT {z} - COUNT(*) FROM kp{z}))"""
SELECT_CT = f"""WITH {_resolve_sql(LD, 25, 'greatest(1, np // 4)')}, {ACROSS}, {_SEL.format(z=60, per=3)}, {_SEL.format(z=400, per=17)}
SELECT gene, celltype, factor, 'strict' AS source, 60 AS size FROM kp60 UNION ALL SELECT gene, celltype, factor, 'fill', 60 FROM fl60
UNION ALL SELECT gene, celltype, factor, 'strict', 400 FROM kp400 UNION ALL SELECT gene, celltype, factor, 'fill', 400 FROM fl400"""

# --- combination -----------------------------------------------------------------------------


def _two_lists(spark, sf):
    t = table(spark, sf, "part")
    k = F.col("p_partkey")
    rf = t.select(F.concat(F.lit("P"), k).alias("gene"), (F.pmod(k * 7, F.lit(1999)) + 1).alias("rank"), (1.0 / (k + 1)).alias("selection_score"), F.col("p_type").alias("celltype"))
    dim = t.select(F.concat(F.lit("P"), k).alias("gene"), (F.pmod(k * 14, F.lit(1997)) + 1).alias("rank"), F.col("p_size").cast("double").alias("selection_score"), F.col("p_type").alias("celltype"))
    forced = t.filter("p_partkey % 97 = 0 and p_partkey < 500").select(F.concat(F.lit("P"), k).alias("gene"))
    return rf, dim, forced


_LISTS = """rf AS (SELECT 'P' || p_partkey AS gene, (p_partkey * 7) % 1999 + 1 AS rank FROM part), dm AS (SELECT 'P' || p_partkey AS gene, (p_partkey * 14) % 1997 + 1 AS rank FROM part),
forced AS (SELECT 'P' || p_partkey AS gene FROM part WHERE p_partkey % 97 = 0 AND p_partkey < 500),
tr AS (SELECT * FROM rf WHERE gene NOT IN (SELECT gene FROM forced) ORDER BY rank, gene LIMIT 60), td AS (SELECT * FROM dm WHERE gene NOT IN (SELECT gene FROM forced) ORDER BY rank, gene LIMIT 140),
cmb AS (SELECT gene, rank, CASE WHEN gene IN (SELECT gene FROM td) THEN 'overlap→rf_deg' ELSE 'rf_deg' END AS gene_source FROM tr
 UNION ALL SELECT gene, rank, 'dimred' FROM td WHERE gene NOT IN (SELECT gene FROM tr) UNION ALL SELECT gene, NULL, 'force_include' FROM forced)"""


def combine(spark, sf):
    rf, dim, forced = _two_lists(spark, sf)
    return pn.combine_rf_dimred(rf, dim, 60, 140, forced).select("gene", "rank", "gene_source")


def combine_replace(spark, sf):
    rf, dim, forced = _two_lists(spark, sf)
    return pn.combine_rf_dimred(rf, dim, 60, 140, forced, replace_lost=True).select("gene", "rank", "gene_source")


COMBINE_R = f"""WITH {_LISTS} SELECT * FROM cmb UNION ALL (SELECT gene, rank, 'dimred_replacement' FROM dm WHERE gene NOT IN (SELECT gene FROM cmb)
 ORDER BY rank, gene LIMIT (SELECT COUNT(*) FROM tr WHERE gene IN (SELECT gene FROM td)))"""


def gaps(spark, sf):
    rf, dim, forced = _two_lists(spark, sf)
    c = pn.combine_rf_dimred(rf, dim, 60, 140, forced)
    pool = dim.filter("rank < 150")
    out = pn.gap_fill(c, pn.gap_fill_tiers("per_celltype", pool, None, rf), 230)
    return out.select("gene", "gene_source")


GAPS = f"""WITH {_LISTS}, off AS (SELECT 0 AS tier, rank, gene, 'gap_fill_celltype' AS label FROM dm WHERE rank < 150 UNION ALL SELECT 1, rank, gene, 'gap_fill_deg' FROM rf),
f AS (SELECT * FROM off WHERE gene NOT IN (SELECT gene FROM cmb) QUALIFY row_number() OVER (PARTITION BY gene ORDER BY tier) = 1)
SELECT gene, gene_source FROM cmb UNION ALL (SELECT gene, label FROM f ORDER BY tier, rank, gene LIMIT (SELECT 230 - COUNT(*) FROM cmb))"""


def force(spark, sf):
    g = table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("gene"))
    w = table(spark, sf, "supplier").select(F.concat(F.lit("P"), F.col("s_suppkey") * 29).alias("gene"))
    return pn.force_include(g, w, 1_000_000)


FORCE = "SELECT 'P' || p_partkey AS gene FROM part WHERE p_partkey IN (SELECT s_suppkey * 29 FROM supplier)"

# --- the panel table -------------------------------------------------------------------------


def single_fill(spark, sf):
    return pn.single_gap_fill(part_panel(spark, sf), 900).select("gene", "selected_initial", "final_selection")


FILL_CTE = f"""{PART_PANEL}, have AS (SELECT COUNT(*) AS n FROM panel WHERE selected_initial AND coalesce(passed_xenium, true)),
fill AS (SELECT gene FROM panel WHERE NOT selected_initial AND coalesce(passed_xenium, true) ORDER BY selection_score DESC, gene LIMIT (SELECT greatest(0, 900 - n) FROM have)),
fin AS (SELECT *, gene IN (SELECT gene FROM fill) AS fl FROM panel),
done AS (SELECT gene, rank, selection_score, celltype, passed_xenium, selected_initial OR fl AS selected_initial, (selected_initial AND coalesce(passed_xenium, true)) OR fl AS final_selection FROM fin)"""


def ranked(spark, sf):
    p = pn.single_gap_fill(part_panel(spark, sf), 900)
    return pn.ranked_list(p).select("gene", "in_panel", "rank")


def summary_json(spark, sf):
    p = pn.new_panel(part_panel(spark, sf), "deg_only")
    p = pn.single_gap_fill(p, 900)
    return pn.selection_summary(p, "deg_only", 900, patterns=["mt-"])


SUMMARY = f"""WITH {FILL_CTE} SELECT '{{"strategy":"deg_only","target_size":900,"initial_selected":' || COUNT(*) FILTER (selected_initial) || ',"after_xenium":' || COUNT(*) FILTER (selected_initial AND coalesce(passed_xenium, true)) ||
 ',"final_selected":' || COUNT(*) FILTER (final_selection) || ',"xenium_failed":' || COUNT(*) FILTER (NOT passed_xenium) || ',"replacements":0,"filters_applied":{{"xenium":true,"blacklist_custom_patterns":["mt-"],"blacklist_use_default":true,"blacklist_any_active":true}}}}' AS summary FROM done"""


def panel_table(spark, sf):
    t = part_panel(spark, sf)
    p = pn.new_panel(t.select("gene", "rank", "selection_score", "celltype", "passed_xenium"), "rf_deg")
    more = pn.new_panel(t.filter("rank % 4 = 0").select("gene", "rank", (10007 - F.col("selection_score")).alias("selection_score"), F.lit("late").alias("celltype"), "passed_xenium"), "rf_deg")
    p = pn.mark_selected(pn.add_genes(p, more), t.filter("selected_initial"))
    p = pn.mark_selected(p, t.filter("selected_initial and rank % 2 = 0"), "final")
    pairs = t.filter("rank % 10 = 0").select(F.col("gene").alias("removed"), F.concat(F.lit("P"), "rank").alias("replacement"), F.lit("low").alias("reason"))
    p = pn.record_replacements(p, pairs)
    m = t.select("celltype", "gene", (F.col("rank") / 7).alias("mean_expr"))
    return pn.set_mean_expression(p, m).select("gene", "rank", "selection_score", "celltype", r6("mean_expression").alias("mean_expression"), "selected_initial", "final_selection",
                                               "replaced_by", "replaces_gene", "replacement_reason")


PANEL_TABLE = f"""WITH {PART_PANEL}, b AS (SELECT *, rank % 4 = 0 AND 10007 - selection_score > selection_score AS late FROM panel)
SELECT gene, rank, CASE WHEN late THEN 10007 - selection_score ELSE selection_score END AS selection_score, CASE WHEN late THEN 'late' ELSE celltype END AS celltype,
 CASE WHEN NOT late THEN round(rank / 7, 6) END AS mean_expression, selected_initial, selected_initial AND rank % 2 = 0 AS final_selection,
 CASE WHEN rank % 10 = 0 THEN 'P' || rank END AS replaced_by, CASE WHEN (rank - 1) % 10 = 0 AND rank > 1 THEN 'P' || (rank - 2) END AS replaces_gene,
 CASE WHEN (rank - 1) % 10 = 0 AND rank > 1 THEN 'low' END AS replacement_reason FROM b"""


def stages(spark, sf):
    p = pn.single_gap_fill(part_panel(spark, sf), 900).withColumn("replaces_gene", F.lit(None).cast("string"))
    return pn.panel_stats(p)


STATS = f"""WITH {FILL_CTE} SELECT COUNT(*) AS total, COUNT(*) FILTER (selected_initial) AS initial, COUNT(*) FILTER (selected_initial AND coalesce(passed_xenium, true)) AS post_xenium,
 COUNT(*) FILTER (final_selection) AS final, COUNT(*) FILTER (passed_xenium) AS passed, COUNT(*) FILTER (NOT passed_xenium) AS failed, COUNT(*) FILTER (passed_xenium IS NULL) AS untested, 0 AS replacements FROM done"""


def stage_list(spark, sf):
    return pn.stage_genes(part_panel(spark, sf), "post_xenium").select("gene")


def details(spark, sf):
    final = part_panel(spark, sf).select("gene").unionByName(deg_table(spark, sf).select("gene"))
    t = table(spark, sf, "part")
    cons = t.select(F.concat(F.lit("P"), "p_partkey").alias("gene"), (F.col("p_size") / 10).alias("final_score"), F.col("p_retailprice").alias("avg_importance"),
                    (F.col("p_retailprice") * 2).alias("max_importance"), (F.col("p_size") / 50).alias("avg_f1_score"))
    d = pn.gene_details(final, part_loadings(spark, sf, False), cons, bh_adjust(deg_table(spark, sf)))
    return d.withColumns({c: r6(c) for c in ("final_score", "avg_importance", "max_importance", "avg_f1_score", "pval_adj")})


DETAILS = f"""WITH {PART_PANEL}, {DEG}, {LDG}, fin AS (SELECT gene FROM panel UNION SELECT gene FROM deg),
l AS (SELECT gene, factor, loading FROM loadings QUALIFY row_number() OVER (PARTITION BY gene ORDER BY abs(loading) DESC, factor) = 1),
g AS (SELECT * FROM adj QUALIFY row_number() OVER (PARTITION BY gene ORDER BY pvals_adj, "group") = 1)
SELECT fin.gene, factor AS best_component, loading AS best_weight, round(p_size / 10, 6) AS final_score, round(p_retailprice, 6) AS avg_importance, round(p_retailprice * 2, 6) AS max_importance,
 round(p_size / 50, 6) AS avg_f1_score, "group" AS best_group, logfoldchanges AS logfoldchange, round(pvals_adj, 6) AS pval_adj, scores AS deg_score
FROM fin LEFT JOIN l ON l.gene = fin.gene LEFT JOIN part ON 'P' || p_partkey = fin.gene LEFT JOIN g ON g.gene = fin.gene"""

# --- provenance ------------------------------------------------------------------------------


def _events(spark, sf):
    k = F.col("p_partkey")
    t = table(spark, sf, "part")
    none = F.lit(None).cast("string")

    def ev(cond, stage, it, action, gene, replaces=none, source=none, rank=F.lit(None).cast("bigint")):
        return t.filter(cond).select(F.lit(stage).alias("stage"), F.lit(it).cast("int").alias("iteration"), F.lit(action).alias("action"), gene.alias("gene"),
                                     replaces.alias("replaces"), source.alias("source"), rank.alias("rank"))

    p = F.concat(F.lit("P"), k)

    def r(x):
        return F.concat(F.lit(x), k)

    src = F.element_at(F.array(*[F.lit(s) for s in ("DT", "dimred", "both DT", "cell-type gap-filling", "global gap-filling", "other")]), (F.pmod("p_size", F.lit(6)) + 1).cast("int"))
    parts = [
        ev(F.lit(True), "initial", None, "add", p, source=src, rank=k + 1),
        ev(k % 10 == 1, "blacklist", None, "remove", p), ev(k % 20 == 1, "blacklist", None, "add", r("B"), p, F.lit("DT")),
        ev(k % 10 == 2, "force", None, "remove", p), ev(k % 20 == 2, "force", None, "add", r("F")), ev(k % 30 == 5, "force", None, "add", p),
        ev(k % 10 == 3, "xenium", 1, "remove", p), ev(k % 20 == 3, "xenium", 1, "add", r("X"), p),
        ev(k % 40 == 1, "xenium", 1, "remove", r("B")), ev(k % 80 == 1, "xenium", 1, "add", r("XB"), r("B")),
        ev(k % 10 == 4, "odt", 2, "remove", p), ev(k % 20 == 4, "odt", 2, "add", r("O"), p), ev(k % 60 == 3, "odt", 2, "remove", r("X")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _prov(spark, sf):
    return pv.provenance(_events(spark, sf), "rf_nmf")


def provenance(spark, sf):
    ct = table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("gene"), F.col("p_type").alias("celltype"))
    return pv.inherit_celltype(_prov(spark, sf), ct)


_SRC = "(['DT', 'dimred', 'both DT', 'cell-type gap-filling', 'global gap-filling', 'other'])[1 + p_size % 6]"


def _pcase(prefix, cond, cols):
    return f"SELECT '{prefix}' || k AS gene, {cols} FROM q WHERE {cond}"


PROV = f"""q AS (SELECT p_partkey AS k, {_SRC} AS src, p_type AS celltype FROM part),
prov AS (
SELECT 'P' || k AS gene, k + 1 AS selection_rank, CASE WHEN k % 30 = 5 THEN 'force_include' ELSE 'initial_selection' END AS initial_source, src AS source_details,
 CASE WHEN k % 10 = 1 THEN 'failed' ELSE 'passed' END AS blacklist_status, CAST(NULL AS VARCHAR) AS blacklist_replacement_for,
 CASE WHEN k % 10 IN (1, 2) THEN 'not_tested' WHEN k % 10 = 3 THEN 'failed' ELSE 'passed' END AS xenium_status, CAST(NULL AS VARCHAR) AS xenium_replacement_for,
 CASE WHEN k % 10 IN (1, 2, 3) THEN 'not_tested' WHEN k % 10 = 4 THEN 'failed' ELSE 'passed' END AS odt_status, CAST(NULL AS VARCHAR) AS odt_replacement_for,
 CASE WHEN k % 10 BETWEEN 1 AND 4 THEN 'removed' ELSE 'selected' END AS final_status,
 CASE k % 10 WHEN 1 THEN 'blacklist_filter' WHEN 2 THEN 'replaced_by_force_include' WHEN 3 THEN 'xenium_expression_filter' WHEN 4 THEN 'odt_designability_filter' END AS removal_reason,
 CAST(NULL AS INTEGER) AS replacement_iteration, celltype FROM q
UNION ALL SELECT 'B' || k, NULL, 'blacklist_replacement', 'DT', 'passed', 'P' || k, CASE WHEN k % 40 = 1 THEN 'failed' ELSE 'passed' END, NULL, CASE WHEN k % 40 = 1 THEN 'not_tested' ELSE 'passed' END, NULL,
 CASE WHEN k % 40 = 1 THEN 'removed' ELSE 'selected' END, CASE WHEN k % 40 = 1 THEN 'xenium_expression_filter' END, NULL, celltype FROM q WHERE k % 20 = 1
UNION ALL SELECT 'F' || k, NULL, 'force_include', 'user_specified', 'exempt', NULL, 'passed', NULL, 'passed', NULL, 'selected', NULL, NULL, NULL FROM q WHERE k % 20 = 2
UNION ALL SELECT 'X' || k, NULL, 'xenium_replacement', 'expression_filtered', 'not_tested', NULL, 'passed', 'P' || k, CASE WHEN k % 60 = 3 THEN 'failed' ELSE 'passed' END, NULL,
 CASE WHEN k % 60 = 3 THEN 'removed' ELSE 'selected' END, CASE WHEN k % 60 = 3 THEN 'odt_designability_filter' END, 1, celltype FROM q WHERE k % 20 = 3
UNION ALL SELECT 'XB' || k, NULL, 'xenium_replacement', 'expression_filtered', 'not_tested', NULL, 'passed', 'B' || k, 'passed', NULL, 'selected', NULL, 1, celltype FROM q WHERE k % 80 = 1
UNION ALL SELECT 'O' || k, NULL, 'odt_replacement', 'designability_filtered', 'not_tested', NULL, 'not_tested', NULL, 'passed', 'P' || k, 'selected', NULL, 2, celltype FROM q WHERE k % 20 = 4)"""


def provenance_summary(spark, sf):
    return pv.provenance_summary(_prov(spark, sf))


PROV_SUM = f"""WITH {PROV} SELECT COUNT(*) FILTER (initial_source = 'initial_selection') AS initial_genes, COUNT(*) FILTER (final_status = 'selected') AS final_genes,
 COUNT(*) FILTER (blacklist_status = 'failed') AS blacklist_removed, COUNT(*) FILTER (initial_source = 'blacklist_replacement') AS blacklist_replacements,
 COUNT(*) FILTER (xenium_status = 'failed') AS xenium_removed, COUNT(*) FILTER (initial_source = 'xenium_replacement') AS xenium_replacements,
 COUNT(*) FILTER (odt_status = 'failed') AS odt_removed, COUNT(*) FILTER (initial_source = 'odt_replacement') AS odt_replacements,
 COUNT(*) FILTER (initial_source = 'force_include') AS force_included, COUNT(*) FILTER (removal_reason = 'replaced_by_force_include') AS removed_by_force_include FROM prov"""


def final_panel(spark, sf):
    return pv.final_panel(_prov(spark, sf)).select("gene", "initial_source")


def categories(spark, sf):
    return pv.source_categories(pv.final_panel(_prov(spark, sf)))


CATEGORIES = f"""WITH {PROV}, c AS (SELECT CASE initial_source WHEN 'force_include' THEN 'User-defined Markers' WHEN 'blacklist_replacement' THEN 'Blacklist Replacement' WHEN 'xenium_replacement' THEN 'Xenium Replacement'
 WHEN 'odt_replacement' THEN 'ODT Replacement' ELSE CASE source_details WHEN 'DT' THEN 'DT-unique' WHEN 'dimred' THEN 'NMF-unique' WHEN 'both DT' THEN 'Both (DT & NMF)' WHEN 'cell-type gap-filling' THEN 'Gap-filling: Cell-type'
 WHEN 'global gap-filling' THEN 'Gap-filling: Global' ELSE 'Other' END END AS category FROM prov WHERE final_status = 'selected')
SELECT category, COUNT(*) AS n_genes, list_position(['User-defined Markers', 'DT-unique', 'NMF-unique', 'Both (DT & NMF)', 'Gap-filling: Cell-type', 'Gap-filling: Global', 'Gap-filling: DEG', 'Gap-filling: Other',
 'Blacklist Replacement', 'Xenium Replacement', 'ODT Replacement', 'Other Replacement', 'Other'], category) AS position FROM c GROUP BY 1"""

QUERIES = [
    Query("factor_pool", factor_pool, f"WITH {LD}, {POOL.format(n=30)} SELECT scope, factor, gene, weight, pool_rank FROM pool"),
    Query("pool_expression_filter", pool_filter, POOL_FILTER), Query("assign_primary_factor", primary, PRIMARY),
    Query("resolve_duplicates_global", resolve_global, RESOLVE_G), Query("resolve_duplicates_per_celltype", resolve_celltypes, RESOLVE_CT),
    Query("fill_gap_factor_aware", fill_gap, FILL_GAP), Query("replacement_pools", pools_text, POOLS_TEXT), Query("factor_balance_report", balance, BALANCE),
    Query("select_from_pool_global", select_global, SELECT_G), Query("select_from_pool_per_celltype", select_celltypes, SELECT_CT),
    Query("combine_rf_dimred", combine, f"WITH {_LISTS} SELECT * FROM cmb"), Query("combine_rf_dimred_replacing", combine_replace, COMBINE_R),
    Query("gap_fill", gaps, GAPS), Query("force_include", force, FORCE),
    Query("single_gap_fill", single_fill, f"WITH {FILL_CTE} SELECT gene, selected_initial, final_selection FROM done"),
    Query("ranked_list", ranked, f"WITH {FILL_CTE} SELECT gene, final_selection AS in_panel, rank FROM done WHERE coalesce(passed_xenium, true)"),
    Query("selection_summary_json", summary_json, SUMMARY), Query("panel_table", panel_table, PANEL_TABLE), Query("panel_stats", stages, STATS),
    Query("stage_genes", stage_list, f"WITH {PART_PANEL} SELECT gene FROM panel WHERE selected_initial AND coalesce(passed_xenium, true)"),
    Query("gene_details", details, DETAILS), Query("provenance", provenance, f"WITH {PROV} SELECT * FROM prov"),
    Query("provenance_summary", provenance_summary, PROV_SUM),
    Query("provenance_final_panel", final_panel, f"WITH {PROV} SELECT gene, initial_source FROM prov WHERE final_status = 'selected'"),
    Query("source_categories", categories, CATEGORIES),
]
