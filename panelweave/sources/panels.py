"""Gene lists and panels in files."""

from __future__ import annotations

import logging
import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.functions.names import panel_name_from_path
from panelweave.sources.text import csv_fields, line_numbers, raw_lines

log = logging.getLogger(__name__)

# Header names that mark the gene column.
GENE_HEADERS = ["gene", "genes", "gene_name", "gene_id", "symbol", "gene_symbol", "feature", "id", "name", "sp_genes"]
VENDOR_HEADERS = ["gene", "genes", "gene_name", "gene_id", "symbol", "gene_symbol"]


def _genes(lines: DataFrame, headers: Sequence[str] = GENE_HEADERS, first_in_file: bool = True) -> DataFrame:
    """(path, gene, position) of raw lines, each file read by its own header.

    Order of rules: a final-selection flag next to 'gene'; a known header; no
    header at all when the first one looks like an accession; the first column.
    """
    n = line_numbers(lines).filter("trim(line) <> ''").withColumn("f", csv_fields(F.col("line")))
    h = n.filter("line_no = 0").select("path", F.col("f").alias("h"))
    low = F.transform("h", lambda x: F.lower(x)) if first_in_file else F.col("h")
    known = F.array(*[F.lit(x) for x in headers])
    hit = F.filter(low, lambda x: F.array_contains(known, x)) if first_in_file else F.filter(known, lambda x: F.array_contains(F.col("h"), x))
    final = F.array_position("h", "selected_final")
    gene = F.array_position("h", "gene")
    flagged = (final > 0) & (gene > 0) if first_in_file else F.lit(False)
    at = F.when(flagged, gene).when(F.size(hit) > 0, F.array_position(low, F.get(hit, F.lit(0)))).otherwise(F.lit(1))
    bare = ~flagged & (F.size(hit) == 0) & F.get("h", F.lit(0)).startswith("ENS") if first_in_file else F.lit(False)
    h = h.select("path", at.cast("int").alias("_at"), F.when(flagged, final.cast("int")).alias("_final"), bare.alias("_bare"))
    j = n.join(h, "path").filter((F.col("line_no") > 0) | F.col("_bare"))
    j = j.filter(F.col("_final").isNull() | (F.lower(F.get("f", F.col("_final") - 1)) == "true"))
    g = F.get("f", F.col("_at") - 1)
    return j.select("path", F.when(g != "", g).alias("gene"), F.col("line_no").alias("position")).filter(F.col("gene").isNotNull())


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(gene, position) of one CSV file."""
    return _genes(raw_lines(spark, path)).select("gene", "position")


def read_10x_panel(spark: SparkSession, path: str) -> DataFrame:
    """(gene, position) of a vendor panel: first known header by preference, else the first column."""
    return _genes(raw_lines(spark, path), VENDOR_HEADERS, first_in_file=False).select("gene", "position")


def read_panels(spark: SparkSession, root: str, genes: DataFrame | None = None) -> DataFrame:
    """panel(panel, gene, position) of every result list below ``root``, in one job.

    Paths look like filter/subset/strategy/[N_factors/]SIZE-genes/results/selected_*.csv.
    Intermediate and bootstrap files are left out; ``genes`` restricts to genes in the data.
    """
    # A list may be one file or a folder of part files as Spark writes it.
    lines = raw_lines(spark, root, "*.csv", recursive=True)
    listed = F.regexp_replace("path", r"/part-[^/]*$", "")
    shape = r"/[^/]+/[^/]+/[^/]+/([^/]*_factors/)?[^/]*-genes/results/selected_(genes|hvg_|random_)[^/]*\.csv$"
    name = F.element_at(F.split(listed, "/"), -1)
    lines = lines.filter(listed.rlike(shape) & ~name.startswith("intermediate_") & ~name.contains("_bootstrap"))
    p = _genes(lines).select("path", panel_name_from_path(listed).alias("panel"), "gene", "position")
    sizes = p.groupBy("panel", "path").agg(F.max("position").alias("_n"))
    before = Window.partitionBy("panel").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("panel", "path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    p = p.join(offs, ["panel", "path"]).select("panel", "gene", (F.col("position") + F.col("_off")).alias("position"))
    return p if genes is None else p.join(genes.select("gene"), "gene", "left_semi").select("panel", "gene", "position")


def first_n(panel: DataFrame, name: str, n: int | None) -> DataFrame:
    """A named list cut to its first n genes when it has more; the name then ends in the size."""
    if not n or n < 0:
        return panel.select(F.lit(name).alias("panel"), "gene", "position")
    size = panel.agg(F.count(F.lit(1))).scalar()
    label = F.when(size > n, f"{name}_{n}").otherwise(name)
    return panel.orderBy("position", "gene").limit(n).select(label.alias("panel"), "gene", "position")


def read_external_panels(spark: SparkSession, files: dict[str, str], genes: DataFrame, sizes: Sequence[int] | None = None) -> DataFrame:
    """External lists by name, restricted to genes in the data and optionally cut to sizes."""
    out = None
    for i, (name, path) in enumerate(files.items()):
        p = read_gene_list(spark, path).join(genes.select("gene"), "gene", "left_semi")
        q = first_n(p, name, sizes[i] if sizes and i < len(sizes) else None)
        out = q if out is None else out.unionByName(q)
    return out


def _cache_path(root: str, filter_method: str, hvg: bool, strategy: str, size: int) -> str:
    return os.path.join(root, f"filter={filter_method}", f"hvg={str(hvg).lower()}", f"strategy={strategy}", f"size={size}")


def save_panel(panel: DataFrame, root: str, filter_method: str, hvg: bool, strategy: str, size: int) -> str:
    path = _cache_path(root, filter_method, hvg, strategy, size)
    panel.write.mode("overwrite").parquet(path)
    return path


def load_cached_panel(spark: SparkSession, root: str, filter_method: str, hvg: bool, strategy: str, size: int) -> DataFrame | None:
    """A stored panel of the same parameters, or None when missing or of another size."""
    try:
        p = spark.read.parquet(_cache_path(root, filter_method, hvg, strategy, size))
    except AnalysisException:
        return None
    if p.count() != size:
        log.warning("cached panel has another size than %d", size)
        return None
    return p
