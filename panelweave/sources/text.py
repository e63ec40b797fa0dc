"""Line-numbered text and header-aware CSV rows, without loading a file anywhere as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A field with the comma before it: quoted parts and others, in one pass over the line.
_FIELD = ',((?:"[^"]*"|[^",])*+)'


def raw_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, block, seq, line): ``block`` is the byte offset of the file split, ``seq`` ascends within it."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        F.regexp_replace(F.url_decode("_metadata.file_path"), "^file:/+", "/").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def line_numbers(lines: DataFrame, per_file: bool = True) -> DataFrame:
    """Add ``line_no`` to all lines of :func:`raw_lines`, from 0 per file, or from 0 over all files by their paths.

    Lines are numbered within their file split and shifted by the lines of the
    splits before it, so one big file still spreads over many tasks.  ``seq``
    runs without gaps inside a split, so no line has to be moved for its number.
    """
    files, order = (["path"], ["block"]) if per_file else ([], ["path", "block"])
    counts = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first"))
    before = Window.partitionBy(*files).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per split.
    offs = counts.select("path", "block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    return lines.join(offs, ["path", "block"]).withColumn("line_no", F.col("seq") + F.col("_off")).drop("_off")


def csv_fields(line: Column) -> Column:
    plain = F.split(line, ",", -1)
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), 1)
    return F.transform(F.when(line.contains('"'), quoted).otherwise(plain), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))


def csv_rows(spark: SparkSession, path: str | list[str], glob: str = "*.csv", recursive: bool = True) -> DataFrame:
    """(path, line_no, row MAP<STRING,STRING>) of CSV files that may each have their own header."""
    lines = line_numbers(raw_lines(spark, path, glob, recursive)).withColumn("f", csv_fields(F.col("line")))
    head = lines.filter("line_no = 0").select("path", F.col("f").alias("h"))
    body = lines.filter("line_no > 0 and trim(line) <> ''").join(head, "path")
    pairs = F.arrays_zip("h", F.slice(F.concat("f", F.array_repeat(F.lit(""), F.size("h"))), F.lit(1), F.size("h")).alias("v"))
    return body.select("path", "line_no", F.map_from_entries(F.transform(pairs, lambda z: F.struct(z["h"], z["v"]))).alias("row"))


def field(name: str, *aliases: str) -> Column:
    """A column of :func:`csv_rows`, by the first of its names that the file has; empty text is null."""
    value = F.coalesce(*[F.col("row").getItem(n) for n in (name, *aliases)])
    return F.when(value != "", value)
