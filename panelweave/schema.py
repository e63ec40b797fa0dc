"""The tables operators exchange, and helpers for implicit zeros."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPR = "cell_id BIGINT, gene STRING, value DOUBLE"
CELLS = "cell_id BIGINT, celltype STRING"
PANEL = (
    "gene STRING, rank BIGINT, selection_score DOUBLE, selection_strategy STRING, analysis_type STRING, "
    "celltype STRING, mean_expression DOUBLE, selected_initial BOOLEAN, passed_xenium BOOLEAN, "
    "final_selection BOOLEAN, xenium_failure_reason STRING, replaced_by STRING, replaces_gene STRING, "
    "replacement_reason STRING"
)
LABEL_LIMIT = 100_000


@dataclass(frozen=True)
class ExprData:
    """A measured matrix: long values, the row dimension and the column dimension."""

    expr: DataFrame
    cells: DataFrame
    genes: DataFrame


def total_cells(cells: DataFrame) -> Column:
    """Number of cells as a one-value subquery, evaluated once per query."""
    return cells.agg(F.count(F.lit(1)).alias("n")).scalar()


def group_sizes(cells: DataFrame, group: str = "celltype") -> DataFrame:
    return cells.groupBy(group).agg(F.count(F.lit(1)).alias("n_cells"))


def every_label(cells: DataFrame, group: str = "celltype") -> Column:
    """All labels as one array.

    Labels are a vocabulary; a column with more than ``LABEL_LIMIT`` distinct
    values is not one, and the query fails instead of building a huge array.
    """
    labels = cells.select(group).distinct().limit(LABEL_LIMIT + 1)
    arr = F.array_sort(F.collect_set(group))
    checked = F.when(F.count(F.lit(1)) > LABEL_LIMIT, F.raise_error(F.lit(f"{group}: too many labels"))).otherwise(arr)
    return labels.agg(checked.alias("labels")).scalar()


def grid(genes: DataFrame, cells: DataFrame, group: str = "celltype") -> DataFrame:
    """One row per (label, gene): the shape of any dense per-group result."""
    return genes.select("gene").distinct().withColumn(group, F.explode(every_label(cells, group)))


def with_celltype(expr: DataFrame, cells: DataFrame, group: str = "celltype") -> DataFrame:
    return expr.join(cells.select("cell_id", group), "cell_id")


def group_moments(expr: DataFrame, cells: DataFrame, group: str = "celltype", value: str = "value") -> DataFrame:
    """Per (group, gene): stored rows, sum and sum of squares."""
    return (
        with_celltype(expr, cells, group)
        .groupBy(group, "gene")
        .agg(
            F.count(F.lit(1)).alias("nnz"),
            F.sum(value).alias("s1"),
            F.sum(F.col(value) * F.col(value)).alias("s2"),
        )
    )


def gene_moments(expr: DataFrame, cells: DataFrame, genes: DataFrame | None = None, value: str = "value") -> DataFrame:
    """Per gene: mean, population and sample variance over all cells, zeros included."""
    n = total_cells(cells)
    m = expr.groupBy("gene").agg(
        F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2")
    )
    if genes is not None:
        m = genes.select("gene").join(m, "gene", "left").na.fill(0.0, ["s1", "s2"])
    m = m.withColumn("n", n)
    mean = F.col("s1") / F.col("n")
    ss = F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0))
    return m.select(
        "gene", "n", mean.alias("mean"), (ss / F.col("n")).alias("var_pop"),
        F.when(F.col("n") > 1, ss / (F.col("n") - 1)).alias("var_samp"),
    )
