"""Queries over panel names, paths and name filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions import names as nm
from panelweave.workload.standins import Query, table

FILTERS = ["Scanpy-Filter", "Xenium-Filter", "No-Filter"]
BASE = ["All-Genes", "HVG-Subset"]
STRAT = ["deg_only", "rf_deg", "nmf_per_celltype_method_a", "dt_pca_DT0.5_Dimred0.5_global_method_a",
         "rf_nmf_RF0.25_Dimred0.75_per_celltype_method_b", "Random", "Spapros", "5k", "mMulti_v1", "custom_thing"]
FACT = ["", "_5factors", "", "_12factors"]
SIZES = ["50", "100", "200"]
FILL = ["", "_DEG-based-filling", "", "_cell-type-specific-filling", "_global-gene-filling"]
ADD = ["", "_5k-addon", "", "_mMulti-addon", "_odd-addon", "_no-addon", ""]
PARTS = [(FILTERS, 1), (["_"], 1), (BASE, 3), (["_"], 1), (STRAT, 2), (FACT, 7), (["_"], 1), (SIZES, 5), (FILL, 11), (ADD, 13)]


def names(spark, sf):
    k = F.col("p_partkey")
    cols = [F.element_at(F.array(*[F.lit(v) for v in vals]), (F.pmod(F.floor(k / div).cast("long"), F.lit(len(vals))) + 1).cast("int")) for vals, div in PARTS]
    return table(spark, sf, "part").select(F.concat(*cols).alias("name")).distinct()


def _list(vals):
    return "[" + ", ".join(f"'{v}'" for v in vals) + "]"


NAMES = "nm AS (SELECT DISTINCT " + " || ".join(f"({_list(v)})[1 + (p_partkey // {d}) % {len(v)}]" for v, d in PARTS) + " AS name FROM part)"

PARSE = f"""
{NAMES}, a AS (SELECT name, regexp_extract(name, '_([0-9]+)factors_', 1) AS nf, regexp_replace(name, '_[0-9]+factors_', '_', 'g') AS c0 FROM nm),
b AS (SELECT *, CASE WHEN contains(c0, 'cell-type-specific-filling') THEN 'cell-type-specific-filling' WHEN contains(c0, 'global-gene-filling') THEN 'global-gene-filling'
  WHEN contains(c0, 'DEG-based-filling') THEN 'DEG-based-filling' END AS fill FROM a),
c AS (SELECT *, CASE WHEN fill IS NULL THEN c0 ELSE replace(c0, '_' || fill, '') END AS core FROM b),
d AS (SELECT *, string_split(core, '_') AS tok, string_split(name, '_') AS parts FROM c),
e AS (SELECT *, CASE WHEN list_contains(tok, 'Spapros') AND NOT ends_with(core, 'Spapros-addon') THEN 'Spapros'
  WHEN (list_contains(tok, 'mMulti') OR contains(core, 'mMulti_v1')) AND NOT ends_with(core, 'mMulti-addon') THEN 'mMulti_v1'
  WHEN list_contains(tok, '5k') AND NOT contains(core, '5k-addon') THEN '5k'
  WHEN contains(core, '_deg_only_') THEN 'deg_only' WHEN contains(core, '_rf_deg_') THEN 'rf_deg'
  WHEN list_position(tok, 'Random') > 2 THEN 'Random'
  WHEN regexp_matches(core, '(pca|nmf)_(global|per_celltype)_method_[ab]') THEN regexp_extract(core, '(pca|nmf)_(global|per_celltype)_method_[ab]')
  WHEN regexp_matches(core, '(dt|rf)_(pca|nmf)_(DT|RF)[0-9.]+_Dimred') THEN regexp_extract(core, '(dt|rf)_(pca|nmf)_(DT|RF)[0-9.]+_Dimred[0-9.]+_(global|per_celltype)_method_[ab]')
  ELSE core END AS strategy FROM d),
p AS (SELECT name, strategy, fill AS filling_method, CAST(nullif(nf, '') AS INTEGER) AS n_factors, parts[1] AS filter,
  CASE WHEN contains(parts[2], 'All-Genes') OR contains(parts[2], 'HVG') THEN parts[2] ELSE 'All-Genes' END AS baseline,
  list_filter(parts, lambda x: regexp_full_match(x, '[0-9]+'))[1] AS panel_size,
  CASE WHEN contains(name, '5k-addon') THEN '5k-addon' WHEN contains(name, 'mMulti-addon') THEN 'mMulti-addon' WHEN contains(name, 'odd-addon') THEN 'addon'
    WHEN strategy = '5k' THEN '5k-reference' WHEN strategy = 'mMulti_v1' THEN 'mMulti-reference' ELSE 'no-addon' END AS addon_type FROM e)
"""


def parse(spark, sf):
    return nm.parse_panel_name(names(spark, sf))


def group(spark, sf):
    return nm.group_panels(names(spark, sf))


GROUP = f"""WITH {PARSE}, own AS (SELECT name, concat_ws('_', filter, baseline, coalesce(panel_size, 'unknown-size'), addon_type) AS group_key FROM p WHERE strategy NOT IN ('5k', 'mMulti_v1')),
k AS (SELECT DISTINCT group_key FROM own)
SELECT * FROM own UNION ALL SELECT p.name, k.group_key FROM k JOIN p ON (contains(k.group_key, '5k-addon') AND strategy = '5k') OR (contains(k.group_key, 'mMulti-addon') AND strategy = 'mMulti_v1')"""


def by_keyword(spark, sf):
    return nm.filter_by_keywords(names(spark, sf), ["PCA", "xdeg_onlyx"])


KEYWORD = f"WITH {PARSE} SELECT name FROM p WHERE contains(lower(strategy), 'pca') OR contains('xdeg_onlyx', lower(strategy))"


def by_args(spark, sf):
    return nm.filter_panels(names(spark, sf), strategies=["nmf", "PCA"], sizes=[50, 100, 200], filter_methods=["scanpy", "no_filter"], hvg_subset=["false", "true"],
                            analysis_types=["per_celltype"], dimred_methods=["method_b"], rf_percentages=[0.25], dimred_percentages=[0.75], deg_filling=False)


ARGS = f"""WITH {PARSE} SELECT name FROM p WHERE (contains(lower(strategy), 'nmf') OR contains(lower(strategy), 'pca')) AND panel_size IN ('50', '100', '200')
AND (contains(filter, 'Scanpy') OR contains(filter, 'No-Filter')) AND contains(strategy, 'per_celltype') AND contains(strategy, 'method_b')
AND contains(strategy, 'RF0.25_') AND contains(strategy, 'Dimred0.75_') AND coalesce(filling_method, '') <> 'DEG-based-filling'"""


def like(spark, sf):
    return nm.find_panels_like(names(spark, sf), "rf_nmf")


LIKE = f"WITH {NAMES} SELECT name FROM nm WHERE contains(name, 'rf_nmf') OR contains(name, 'rf-nmf') OR contains(name, 'Rf_nmf') OR contains(name, 'RF_NMF')"

FILES = ["selected_genes.csv", "selected_genes_DEG-based-filling.csv", "selected_hvg_75genes.csv", "selected_random_30genes.csv", "other.csv"]


def paths(spark, sf):
    k = F.col("p_partkey")

    def pick(v, d):
        return F.element_at(F.array(*[F.lit(x) for x in v]), (F.pmod(F.floor(k / d).cast("long"), F.lit(len(v))) + 1).cast("int"))

    p = F.when(k % 13 == 0, F.concat(F.lit("/plain/"), pick(FILES, 1))).otherwise(F.concat(
        F.lit("/data/run/"), pick(FILTERS, 1), F.lit("/"), pick(BASE, 2), F.lit("/"), pick(STRAT, 3), F.lit("/"),
        F.when(k % 4 == 0, "8_factors/").otherwise(""), pick(SIZES, 5), F.lit("-genes/results/"), pick(FILES, 7)))
    return table(spark, sf, "part").select("p_partkey", nm.panel_name_from_path(p).alias("panel"))


def _pick(v, d):
    return f"({_list(v)})[1 + (p_partkey // {d}) % {len(v)}]"


PATHS = f"""
WITH a AS (SELECT p_partkey, {_pick(FILTERS, 1)} AS f, {_pick(BASE, 2)} AS b, {_pick(STRAT, 3)} AS s, {_pick(SIZES, 5)} AS z, {_pick(FILES, 7)} AS fn, {_pick(FILES, 1)} AS pf FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN replace(pf, '.csv', '') ELSE f || '_' || b || '_' || s || CASE WHEN p_partkey % 4 = 0 THEN '_8factors' ELSE '' END || '_' ||
 CASE fn WHEN 'selected_hvg_75genes.csv' THEN '75' WHEN 'selected_random_30genes.csv' THEN '30' ELSE z END ||
 CASE fn WHEN 'selected_genes_DEG-based-filling.csv' THEN '_DEG-based-filling' WHEN 'other.csv' THEN '_other' ELSE '' END END AS panel FROM a
"""

QUERIES = [
    Query("parse_panel_name", parse, f"WITH {PARSE} SELECT * FROM p"),
    Query("group_panels", group, GROUP),
    Query("filter_panels_by_keyword", by_keyword, KEYWORD),
    Query("filter_panels_by_args", by_args, ARGS),
    Query("find_panels_like", like, LIKE),
    Query("panel_name_from_path", paths, PATHS),
]
