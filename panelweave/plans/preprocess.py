"""Composed preprocessing of a count matrix."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators import quality as q
from panelweave.schema import ExprData

Step = Callable[[DataFrame], DataFrame]


def compose_steps(*steps: Step | None) -> Step:
    """Left-to-right composition; ``None`` stands for the identity."""
    return lambda df: reduce(lambda d, s: d.transform(s), [s for s in steps if s is not None], df)


def preprocess(
    data: ExprData, filter_method: str = "scanpy", hvg_flavor: str | None = None, n_hvg: int = 8000,
    min_genes: int = q.MIN_GENES_PER_CELL, min_cells: int = q.MIN_CELLS_PER_GENE, target: float | None = q.TARGET_SUM,
) -> ExprData:
    """Filter, keep counts, normalise, log and optionally restrict to variable genes.

    The result's ``expr`` has ``counts`` and the log-normalised ``value``.
    """
    if filter_method == "scanpy":
        data = q.filter_genes(q.filter_cells(data, min_genes), min_cells)
    elif filter_method != "no_filter":
        raise ValueError(f"unknown filter method {filter_method}")
    expr = data.expr.withColumn("counts", F.col("value"))
    expr = expr.transform(compose_steps(lambda d: q.normalize_total(d, target), q.log1p))
    out = ExprData(expr, data.cells, data.genes)
    if hvg_flavor:
        flags = q.hvg(out, hvg_flavor, n_hvg, value="counts" if hvg_flavor == "seurat_v3" else "value")
        out = q.keep_genes(out, flags.filter("highly_variable"))
    return out


def preprocess_metadata(data: ExprData, filter_method: str, hvg_flavor: str | None) -> DataFrame:
    """One row describing a preprocessed matrix."""
    n_genes = data.expr.select("gene").distinct().agg(F.count(F.lit(1))).scalar()
    return data.cells.agg(F.count(F.lit(1)).alias("n_cells")).select(
        F.lit(filter_method).alias("filter_method"), F.lit(hvg_flavor or "all").alias("gene_subset"),
        "n_cells", n_genes.alias("n_genes"),
    )
