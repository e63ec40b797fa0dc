"""Result tables: writing them in the layout reports expect, and collecting them again."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.markers import deg_filter, deg_group_summary
from panelweave.operators.panels import ranked_list, selection_summary
from panelweave.sources.text import csv_rows, field, raw_lines


def write_ranked_list(panel: DataFrame, path: str, filtered: bool = True) -> None:
    """Ranked list as CSV, panel genes first; the sort is a range partitioning, so part files are in order."""
    ranked_list(panel, filtered).write.mode("overwrite").csv(path, header=True)


def write_summary_json(panel: DataFrame, path: str, strategy: str, target: int, **kw) -> None:
    selection_summary(panel, strategy, target, **kw).select(F.col("summary").alias("value")).write.mode("overwrite").text(path)


def write_per_dataset(df: DataFrame, path: str) -> None:
    """One folder per dataset, with its own row and its cell-type rows."""
    df.write.mode("overwrite").partitionBy("dataset").parquet(path)


def write_reconstruction(global_rows: DataFrame, celltype_rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Global CSV, and per-cell-type CSV closed by a '__summary__' row; private columns are dropped."""

    def public(df):
        return df.select(*[c for c in df.columns if not c.startswith("_")])

    public(global_rows).write.mode("overwrite").csv(os.path.join(path, "global"), header=True)
    s = public(summary).withColumn("celltype", F.lit("__summary__"))
    public(celltype_rows).unionByName(s, allowMissingColumns=True).write.mode("overwrite").csv(os.path.join(path, "per_celltype"), header=True)


def write_deg_results(deg: DataFrame, path: str, max_pval: float = 0.05) -> None:
    """All tests, the significant ones, and the per-group summary."""
    deg.write.mode("overwrite").parquet(os.path.join(path, "deg_results_all"))
    deg_filter(deg, max_pval).write.mode("overwrite").parquet(os.path.join(path, "deg_results_filtered"))
    deg_group_summary(deg, max_pval).write.mode("overwrite").parquet(os.path.join(path, "deg_summary"))


# --- collecting ------------------------------------------------------------------------------

def _num(*names: str):
    return field(*names).try_cast("double")


def read_k_varying(spark: SparkSession, root: str, metrics: Sequence[str] = ("macro_mse", "weighted_mse", "macro_expvar", "weighted_expvar")) -> DataFrame:
    """Rows of every k_XX/iter_Y result below ``root``."""
    r = csv_rows(spark, root)
    k, it = (F.regexp_extract("path", p, 1) for p in (r"/k_0*(\d+)/", r"/iter_0*(\d+)/"))
    return r.filter(k != "").select(
        k.cast("int").alias("k_value"), F.when(it != "", it.cast("int")).alias("iteration"), field("selection_method").alias("selection_method"),
        field("eval_method").alias("eval_method"), *[_num(m).alias(m) for m in metrics])


def read_stability(spark: SparkSession, root: str) -> DataFrame:
    """(gene, n_selected): in how many iter_Y folders a gene was selected."""
    r = csv_rows(spark, root).filter(F.col("path").rlike(r"/selected_genes[^/]*(/part-[^/]*)?$"))
    it = F.regexp_extract("path", r"/iter_0*(\d+)/", 1)
    return r.filter(it != "").select(it.alias("i"), field("gene").alias("gene")).filter("gene is not null").groupBy("gene").agg(F.count_distinct("i").alias("n_selected"))


# File name prefixes of the baseline evaluation.
BASELINE_PREFIXES = {"preservation": "neighborhood_preservation", "clustering": "clustering_quality", "identification": "celltype_identification"}


def _named(prefix: str) -> Column:
    """Files whose own or whose folder's name starts so."""
    return F.col("path").rlike(f"/{prefix}[^/]*(/[^/]+)?$")


def read_baseline(spark: SparkSession, root: str, kind: str, metrics: Sequence[str]) -> DataFrame:
    """Rows of one baseline table, a file or a written folder of that name; ``dataset_name`` is accepted for ``dataset``."""
    r = csv_rows(spark, root).filter(_named(BASELINE_PREFIXES[kind]))
    return r.select(field("dataset", "dataset_name").alias("dataset"), field("celltype").alias("celltype"), *[_num(m).alias(m) for m in metrics])


def read_variability(spark: SparkSession, root: str, metrics: Sequence[str]) -> DataFrame:
    """Rows of per-panel sub-folders; the folder names the dataset where the file does not."""
    r = csv_rows(spark, root)
    folder = F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2)
    return r.select(F.coalesce(field("dataset", "dataset_name"), folder).alias("dataset"), field("analysis_type").alias("analysis_type"), field("celltype").alias("celltype"),
                    field("fold").try_cast("int").alias("fold"), *[_num(m).alias(m) for m in metrics])


def detect_results(spark: SparkSession, root: str) -> DataFrame:
    """Which kinds of result files exist: (kind, n_files)."""
    p = raw_lines(spark, root, "*.csv", recursive=True).select("path").distinct()
    kind = F.when(F.col("path").rlike(r"/k_\d+/iter_\d+/"), "k_varying").when(F.col("path").rlike(r"/iter_\d+/"), "stability")
    for label, prefix in BASELINE_PREFIXES.items():
        kind = kind.when(_named(prefix), label)
    return p.groupBy(kind.otherwise("variability").alias("kind")).agg(F.count(F.lit(1)).alias("n_files"))


def collect_method_results(spark: SparkSession, root: str) -> DataFrame:
    """One CSV per dataset folder -> its macro and weighted row."""
    from panelweave.operators.summaries import method_results

    r = csv_rows(spark, root)
    folder = F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2)
    return method_results(r.select(folder.alias("dataset"), *[_num(m).alias(m) for m in ("mse", "expvar", "n_cells")]))
