"""Expression-shaped views of the driver tables, and the same views in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.schema import ExprData


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def rounded(c: Column | str, digits: int = 6) -> Column:
    """``r6`` on the scaled double, as the SQL's own round does, so that halves such as 0.0640625 go the same way."""
    c = F.col(c) if isinstance(c, str) else c
    y = c.cast("double") * 10.0**digits
    # ``rint`` needs no decimals; it takes halves to the even number, the SQL away from zero.
    even, off = F.rint(y), y - F.rint(y)
    return F.when((off == 0.5) & (y > 0), even + 1).when((off == -0.5) & (y < 0), even - 1).otherwise(even) / 10.0**digits


# --- dense signed matrix: embeddings ---------------------------------------------------------

def emb(spark: SparkSession, sf: str) -> ExprData:
    t = table(spark, sf, "embeddings")
    pos = t.select("vec_id", F.posexplode("embedding").alias("g", "v"))
    gene = F.concat(F.lit("g"), F.lpad(F.col("g").cast("string"), 3, "0"))
    expr = pos.select(F.col("vec_id").alias("cell_id"), gene.alias("gene"), F.col("v").cast("double").alias("value"))
    cells = t.select(F.col("vec_id").alias("cell_id"), F.concat(F.lit("c"), F.col("label")).alias("celltype"))
    genes = expr.select("gene").distinct()
    return ExprData(expr, cells, genes)


EMB = """
expr AS (
  SELECT vec_id AS cell_id, 'g' || lpad(CAST(g AS VARCHAR), 3, '0') AS gene, v AS value
  FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS g, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
),
cells AS (SELECT vec_id AS cell_id, 'c' || label AS celltype FROM embeddings),
genes AS (SELECT DISTINCT gene FROM expr)
"""

# --- sparse counts: order x brand ------------------------------------------------------------

def lin(spark: SparkSession, sf: str, gene: str = "p_brand") -> ExprData:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", gene)
    expr = (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy(F.col("l_orderkey").alias("cell_id"), F.col(gene).cast("string").alias("gene"))
        .agg(F.sum("l_quantity").alias("value"))
    )
    cells = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("celltype")
    )
    genes = part.select(F.col(gene).cast("string").alias("gene")).distinct()
    return ExprData(expr, cells, genes)


def lin_sql(gene: str = "p_brand") -> str:
    return f"""
expr AS (
  SELECT l_orderkey AS cell_id, CAST({gene} AS VARCHAR) AS gene, SUM(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
),
cells AS (SELECT o_orderkey AS cell_id, o_orderpriority AS celltype FROM orders),
genes AS (SELECT DISTINCT CAST({gene} AS VARCHAR) AS gene FROM part)
"""


LIN = lin_sql()

# --- one row per part as a ranked gene list --------------------------------------------------

def part_panel(spark: SparkSession, sf: str) -> DataFrame:
    """panel(gene, rank, selection_score, celltype, selected_initial, passed_xenium)."""
    t = table(spark, sf, "part")
    k = F.col("p_partkey")
    return t.select(
        F.concat(F.lit("P"), k).alias("gene"),
        (k + 1).alias("rank"),
        F.pmod(k * 7919, F.lit(10007)).cast("double").alias("selection_score"),
        F.col("p_type").alias("celltype"),
        (F.pmod(k, F.lit(3)) == 0).alias("selected_initial"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.lit(None)).otherwise(F.pmod(k, F.lit(5)) != 0).cast("boolean").alias("passed_xenium"),
    )


PART_PANEL = """
panel AS (
  SELECT 'P' || p_partkey AS gene, p_partkey + 1 AS rank,
         CAST((p_partkey * 7919) % 10007 AS DOUBLE) AS selection_score, p_type AS celltype,
         p_partkey % 3 = 0 AS selected_initial,
         CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 5 <> 0 END AS passed_xenium
  FROM part
)
"""


def part_loadings(spark: SparkSession, sf: str, scope: bool = True) -> DataFrame:
    """loadings(scope, factor, gene, loading): a gene may sit in several factors and scopes."""
    t = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select("p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey")
    )
    sc = F.col("p_type") if scope else F.lit("global")
    g = F.concat(F.lit("P"), F.pmod(F.col("l_partkey"), F.lit(500)))
    agg = t.groupBy(
        sc.alias("scope"), F.pmod(F.col("l_suppkey"), F.lit(4)).cast("int").alias("factor"), g.alias("gene")
    ).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    return agg.select("scope", "factor", "gene", (F.col("q") - 25 * F.col("n")).alias("loading"))


def loadings_sql(scope: bool = True) -> str:
    sc = "p_type" if scope else "'global'"
    return f"""
loadings AS (
  SELECT {sc} AS scope, CAST(l_suppkey % 4 AS INTEGER) AS factor, 'P' || (l_partkey % 500) AS gene,
         SUM(l_quantity) - 25 * COUNT(*) AS loading
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3
)
"""


# --- metric rows -----------------------------------------------------------------------------

def event_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (dataset, celltype, fold) with two metrics and flags."""
    t = table(spark, sf, "events")
    return t.groupBy(
        F.col("event_type").alias("dataset"),
        F.concat(F.lit("ct"), F.pmod(F.col("user_id"), F.lit(11))).alias("celltype"),
        F.pmod(F.col("event_id"), F.lit(5)).cast("int").alias("fold"),
    ).agg(
        # A divisor with a long fraction keeps averages off rounding ties.
        (F.avg("value") / 0.7310585786).alias("mse"),
        (F.max("value") / (F.max("value") + F.avg("value"))).alias("expvar"),
        F.count(F.lit(1)).alias("n_cells"),
        (F.count(F.lit(1)) % 7 == 0).alias("skipped"),
    )


EVENT_METRICS = """
metrics AS (
  SELECT event_type AS dataset, 'ct' || (user_id % 11) AS celltype, CAST(event_id % 5 AS INTEGER) AS fold,
         AVG(value) / CAST(0.7310585786 AS DOUBLE) AS mse, MAX(value) / (MAX(value) + AVG(value)) AS expvar, COUNT(*) AS n_cells,
         COUNT(*) % 7 = 0 AS skipped
  FROM events GROUP BY 1, 2, 3
)
"""
