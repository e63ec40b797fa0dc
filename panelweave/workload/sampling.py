"""Queries over splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import sampling as sa
from panelweave.workload.standins import Query, lin, table

CELLS = "cells AS (SELECT o_orderkey AS cell_id, o_orderpriority AS celltype FROM orders)"


def _cells(spark, sf):
    return lin(spark, sf).cells


def simple(spark, sf):
    return sa.split_simple(_cells(spark, sf), 0.3)


SIMPLE = f"""WITH {CELLS}, r AS (SELECT *, row_number() OVER (ORDER BY md5(cell_id || ':42'), cell_id) AS i, COUNT(*) OVER () AS n FROM cells)
SELECT cell_id, celltype, CASE WHEN i <= ceil(n * 0.3) THEN 'test' ELSE 'train' END AS role FROM r"""

FOLD = f"{CELLS}, r AS (SELECT *, CAST((row_number() OVER (PARTITION BY celltype ORDER BY md5(cell_id || ':42'), cell_id) - 1) % 5 AS INTEGER) AS f FROM cells)"


def kfold(spark, sf):
    return sa.split_kfold(_cells(spark, sf))


KFOLD = f"WITH {FOLD} SELECT cell_id, celltype, CAST(k AS INTEGER) AS fold, CASE WHEN f = k THEN 'test' ELSE 'train' END AS role FROM r, (SELECT unnest(range(0, 5)) AS k)"


def per_ct(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").cast("string").alias("celltype"))
    return sa.per_celltype_splits(sa.split_kfold(c, 5), 12)


PER_CT = """WITH cells AS (SELECT c_custkey AS cell_id, CAST(c_nationkey AS VARCHAR) AS celltype FROM customer),
r AS (SELECT *, (row_number() OVER (PARTITION BY celltype ORDER BY md5(cell_id || ':42'), cell_id) - 1) % 5 AS f FROM cells)
SELECT CAST(k AS INTEGER) AS fold, celltype, COUNT(*) FILTER (f <> k) AS n_train, COUNT(*) FILTER (f = k) AS n_test FROM r, (SELECT unnest(range(0, 5)) AS k)
GROUP BY 1, 2 HAVING COUNT(*) FILTER (f <> k) >= 12 AND COUNT(*) FILTER (f = k) >= 12"""


def ratio(spark, sf):
    a = sa.split_ratio(_cells(spark, sf), 4, "celltype").withColumn("scheme", F.lit("by"))
    return a.unionByName(sa.split_ratio(_cells(spark, sf), 4).withColumn("scheme", F.lit("all")))


RATIO = f"""WITH {CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY celltype ORDER BY md5(cell_id || ':2020'), cell_id) AS i, COUNT(*) OVER (PARTITION BY celltype) AS n,
 row_number() OVER (ORDER BY md5(cell_id || ':2020'), cell_id) AS j, COUNT(*) OVER () AS m FROM cells)
SELECT cell_id, celltype, CASE WHEN i <= n // 5 * 4 THEN 'train' ELSE 'test' END AS role, 'by' AS scheme FROM r
UNION ALL SELECT cell_id, celltype, CASE WHEN j <= m // 5 * 4 THEN 'train' ELSE 'test' END, 'all' FROM r"""


def uniform(spark, sf):
    c = table(spark, sf, "events").select(
        F.col("event_id").alias("cell_id"), F.when(F.pmod("user_id", F.lit(50)) < 2, F.col("event_type")).otherwise("common").alias("celltype"))
    return sa.one_vs_other(sa.uniform_samples(c, 200), "click")


UNIFORM = """WITH cells AS (SELECT event_id AS cell_id, CASE WHEN user_id % 50 < 2 THEN event_type ELSE 'common' END AS celltype FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY celltype ORDER BY md5(cell_id || ':2020'), cell_id) AS i, COUNT(*) OVER (PARTITION BY celltype) AS n FROM cells),
s AS (SELECT celltype, n, k AS slot, CASE WHEN n > 200 THEN k ELSE CAST('0x' || substr(md5(k || ':' || celltype || ':2020'), 1, 8) AS BIGINT) % n + 1 END AS i
 FROM (SELECT DISTINCT celltype, n FROM r), (SELECT unnest(range(1, 201)) AS k))
SELECT CAST(slot AS INTEGER) AS slot, r.cell_id, celltype, CASE WHEN celltype = 'click' THEN celltype ELSE 'other' END AS label FROM s JOIN r USING (celltype, i)"""

GENES = "genes AS (SELECT DISTINCT 'P' || p_partkey AS gene FROM part)"


def _genes(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("gene"))


def holdout(spark, sf):
    return sa.gene_holdout(_genes(spark, sf), 20, 10)


HOLDOUT = f"""WITH {GENES}, r AS (SELECT gene, t, row_number() OVER (PARTITION BY t ORDER BY md5(gene || ':' || (t + 42)), gene) AS i FROM genes, (SELECT unnest(range(0, 10)) AS t))
SELECT gene, CAST(t AS INTEGER) AS trial, CASE WHEN i <= 20 THEN 'test' ELSE 'train' END AS role FROM r"""


def draws(spark, sf):
    return sa.bootstrap_draws(_genes(spark, sf), 50, 10)


DRAWS = HOLDOUT.split("SELECT gene, CAST")[0] + "SELECT gene, CAST(t AS INTEGER) AS draw FROM r WHERE i <= 50"

QUERIES = [
    Query("split_simple", simple, SIMPLE), Query("split_kfold", kfold, KFOLD), Query("per_celltype_splits", per_ct, PER_CT),
    Query("split_ratio", ratio, RATIO), Query("uniform_samples", uniform, UNIFORM), Query("gene_holdout", holdout, HOLDOUT),
    Query("bootstrap_draws", draws, DRAWS),
]
