"""Expression matrices: parquet tables, 10x folders, wide CSV."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.schema import ExprData
from panelweave.session import pin
from panelweave.sources.text import csv_fields, line_numbers, raw_lines


def read_expr(spark: SparkSession, path: str, value: str = "value") -> ExprData:
    """The three parquet tables expr, cells and genes below ``path``."""
    expr = spark.read.parquet(os.path.join(path, "expr"))
    if value != "value":
        expr = expr.withColumn("value", F.col(value))
    return ExprData(expr, spark.read.parquet(os.path.join(path, "cells")), spark.read.parquet(os.path.join(path, "genes")))


def write_expr(data: ExprData, path: str) -> None:
    """Write the three tables; facts are clustered by gene so that a panel reads few row groups."""
    data.expr.repartitionByRange("gene", "cell_id").sortWithinPartitions("gene", "cell_id").write.mode("overwrite").parquet(os.path.join(path, "expr"))
    data.cells.write.mode("overwrite").parquet(os.path.join(path, "cells"))
    data.genes.write.mode("overwrite").parquet(os.path.join(path, "genes"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    n = line_numbers(raw_lines(spark, path), per_file=False).filter("trim(line) <> ''")
    return n.select((F.col("line_no") + 1).alias("i"), F.split("line", "\t").alias("f"))


def read_mtx_folder(spark: SparkSession, folder: str, matrix: str = "matrix.mtx.gz", barcodes: str = "barcodes.tsv.gz", features: str = "features.tsv.gz") -> ExprData:
    """A 10x folder: gene-by-cell coordinates with barcodes and features by line.

    A features file with one column uses the id as the name.  Each of the three may be a folder of
    parts, which follow each other by name.
    """
    m = raw_lines(spark, os.path.join(folder, matrix)).filter(~F.col("line").startswith("%") & (F.trim("line") != ""))
    # The size line is the first line that is no comment: smallest position in the first block of the first part that has one.
    place = F.struct("path", "block", "seq")
    first = m.agg(F.min(place)).scalar()
    m = m.withColumn("_first", first).filter(place != F.col("_first"))
    f = F.split(F.trim("line"), r"\s+")
    entries = m.select(F.get(f, F.lit(0)).cast("long").alias("gi"), F.get(f, F.lit(1)).cast("long").alias("ci"), F.get(f, F.lit(2)).cast("double").alias("value"))
    b = _numbered(spark, os.path.join(folder, barcodes)).select(F.col("i").alias("ci"), F.get("f", F.lit(0)).alias("cell_id"))
    # Gene-sized: written first so that its size is known when it meets the facts.
    g = pin(_numbered(spark, os.path.join(folder, features)).select(
        F.col("i").alias("gi"), F.get("f", F.lit(0)).alias("gene"), F.coalesce(F.get("f", F.lit(1)), F.get("f", F.lit(0))).alias("symbol")))
    expr = entries.filter("value <> 0").join(b, "ci").join(g.select("gi", "gene"), "gi").select("cell_id", "gene", "value")
    return ExprData(expr, b.select("cell_id"), g.select("gene", "symbol"))


def read_wide_matrix(spark: SparkSession, matrix: str, coordinates: str | None = None) -> ExprData:
    """A gene-by-cell CSV, transposed; coordinates (columns 1 and 2) belong to the cells in column order."""
    lines = line_numbers(raw_lines(spark, matrix)).filter("trim(line) <> ''").withColumn("f", csv_fields(F.col("line")))
    rest = F.slice("f", F.lit(2), F.greatest(F.size("f") - 1, F.lit(0)))
    # One row per cell and per stored value: neither the number of columns nor their names matter to the plan.
    names = pin(lines.filter("line_no = 0").select(F.posexplode(rest).alias("i", "cell_id")))
    body = lines.filter("line_no > 0")
    values = body.select(F.element_at("f", 1).alias("gene"), F.posexplode(rest).alias("i", "v")).select("gene", "i", F.col("v").try_cast("double").alias("value"))
    long = values.filter("value <> 0").join(names, "i").select("cell_id", "gene", "value")
    if coordinates:
        n = line_numbers(raw_lines(spark, coordinates)).filter("line_no > 0 and trim(line) <> ''").withColumn("f", csv_fields(F.col("line")))
        xy = n.select((F.col("line_no") - 1).alias("i"), F.get("f", F.lit(1)).cast("double").alias("x"), F.get("f", F.lit(2)).cast("double").alias("y"))
        names = names.join(xy, "i", "left")
    return ExprData(long, names.drop("i"), body.select(F.element_at("f", 1).alias("gene")))
