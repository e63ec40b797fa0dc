"""Set operations and joins between gene lists, panels and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.schema import ExprData, every_label
from panelweave.session import pin


def annotate_cells(cells: DataFrame, annotation: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells present in both tables, with the annotation columns."""
    return cells.join(annotation, key)


def common_cells(a: DataFrame, b: DataFrame, key: str = "cell_id") -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def shared_genes(a: DataFrame, b: DataFrame, required: bool = False) -> DataFrame:
    """Genes of both tables; ``required`` raises when there are none."""
    out = a.select("gene").distinct().join(b.select("gene"), "gene", "left_semi")
    if required and not out.head(1):
        raise ValueError("no shared genes")
    return out


def shared_genes_ci(ref: DataFrame, query: DataFrame, order: str = "position") -> DataFrame:
    """Case-insensitive gene match; the first of several spellings wins on each side."""

    def first(df, name):
        return df.groupBy(F.lower("gene").alias("key")).agg(F.min_by("gene", F.struct(order, "gene")).alias(name))

    return first(ref, "gene_ref").join(first(query, "gene_query"), "key")


def restrict_panel_to_data(panels: DataFrame, genes: DataFrame) -> DataFrame:
    """Panel rows whose gene is in the data."""
    return panels.join(genes.select("gene"), "gene", "left_semi")


def panel_coverage(panels: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes found and missing per panel; a panel with none found is empty."""
    known = genes.select("gene").distinct().withColumn("_in", F.lit(1))
    return panels.join(known, "gene", "left").groupBy("panel").agg(
        F.count("_in").alias("n_found"), (F.count(F.lit(1)) - F.count("_in")).alias("n_missing")
    ).withColumn("is_empty", F.col("n_found") == 0)


def exclude_selected(candidates: DataFrame, selected: DataFrame, n: int, order: str = "rank") -> DataFrame:
    """First ``n`` candidates that are not selected yet."""
    return candidates.join(selected.select("gene"), "gene", "left_anti").orderBy(order, "gene").limit(n)


# Vendor lists and the suffix their union gets.
ADDON_SUFFIX = {"mMulti_v1": "mMulti-addon", "5k": "5k-addon"}
ADDON_MODES = {"both": ["mMulti_v1", "5k"], "all": ["mMulti_v1", "5k"], "mMulti": ["mMulti_v1"], "5k": ["5k"], "no-10x-panel": []}


def combine_with_10x(panels: DataFrame, tenx: DataFrame, mode: str = "both", vendor_start: int | None = None) -> DataFrame:
    """Union of each panel with the vendor lists, own genes first, first occurrence kept.

    ``panels(panel, gene, position)``, ``tenx(tenx, gene, position)``.  With ``vendor_start`` both count
    places of one numbering, in which the vendor lists begin there, and own genes beyond it follow theirs.
    """
    if mode not in ADDON_MODES:
        raise ValueError(f"unknown mode {mode}")
    cols = ["panel", "gene", "position"]
    if mode == "no-10x-panel":
        return panels.select(*cols)
    vendor = F.lower("panel").contains("10x") | F.col("panel").isin(list(ADDON_SUFFIX))
    own = panels.filter(~vendor)
    wanted = ADDON_MODES[mode]
    lists = tenx.filter(F.col("tenx").isin(wanted))
    suffix = F.create_map(*[F.lit(x) for kv in ADDON_SUFFIX.items() for x in kv])
    present = every_label(lists, "tenx")
    mine = own.withColumn("tenx", F.explode(present)).select("panel", "tenx", "gene", F.lit(0).alias("src"), "position")
    theirs = lists.withColumn("panel", F.explode(every_label(own, "panel")))
    if vendor_start is None:
        theirs = theirs.select("panel", "tenx", "gene", F.lit(1).alias("src"), "position")
    else:
        theirs = theirs.select("panel", "tenx", "gene", F.lit(0).alias("src"), (F.col("position") + vendor_start).alias("position"))
    both = mine.unionByName(theirs).groupBy("panel", "tenx", "gene").agg(F.min(F.struct("src", "position")).alias("o"))
    w = Window.partitionBy("panel", "tenx").orderBy("o", "gene")
    combined = both.select(
        F.concat_ws("_", "panel", suffix[F.col("tenx")]).alias("panel"), "gene", (F.row_number().over(w) - 1).cast("long").alias("position")
    )
    keep = panels if mode == "all" else panels.filter(vendor)
    return combined.unionByName(keep.select("panel", "gene", F.col("position").cast("long").alias("position")))


def align_features(first: ExprData, second: ExprData) -> DataFrame:
    """Union of two gene sets: (gene, in_first, in_second)."""
    a = first.genes.select("gene").distinct().withColumn("in_first", F.lit(True))
    b = second.genes.select("gene").distinct().withColumn("in_second", F.lit(True))
    return a.join(b, "gene", "full_outer").na.fill(False, ["in_first", "in_second"])


def align_expr(data: ExprData, all_genes: DataFrame, value: str = "value") -> DataFrame:
    """Stored values plus NaN for every (cell, gene) whose gene this matrix never measured.

    Absent and zero stay apart: a measured zero has no row, an unmeasured gene has NaN rows.
    """
    absent = all_genes.select("gene").distinct().join(data.genes.select("gene"), "gene", "left_anti")
    names = absent.agg(F.array_sort(F.collect_list("gene"))).scalar()
    holes = data.cells.select("cell_id").withColumn("gene", F.explode(names)).withColumn(value, F.lit(float("nan")))
    return data.expr.select("cell_id", "gene", value).unionByName(holes)


def map_symbols(genes: DataFrame, mapping: DataFrame, keep_if_missing: bool = True, duplicates: str = "keep_first") -> DataFrame:
    """Rename genes through ``mapping(gene, symbol)``; ``genes(gene, position)``.

    Duplicate symbols: 'keep_first' suffixes the second and later ones with the
    original id, 'append_ensembl' suffixes all, 'make_unique' numbers them.
    """
    first = mapping.filter(F.col("symbol").isNotNull()).groupBy("gene").agg(F.min("symbol").alias("symbol"))
    g = genes.join(first, "gene", "left")
    g = g.withColumn("symbol", F.coalesce("symbol", "gene")) if keep_if_missing else g.filter(F.col("symbol").isNotNull())
    stats = g.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("position", "gene")).alias("_first"))
    g = g.join(stats, "symbol")
    tagged = F.concat_ws("_", "symbol", "gene")
    if duplicates == "keep_first":
        name = F.when(F.struct("position", "gene") == F.col("_first"), F.col("symbol")).otherwise(tagged)
    elif duplicates == "append_ensembl":
        name = F.when(F.col("_n") > 1, tagged).otherwise(F.col("symbol"))
    elif duplicates == "make_unique":
        i = F.row_number().over(Window.partitionBy("symbol").orderBy("position", "gene"))
        name = F.when(i > 1, F.concat_ws(".", "symbol", (i - 1).cast("string"))).otherwise(F.col("symbol"))
    else:
        raise ValueError(f"unknown duplicates option {duplicates}")
    return g.select("gene", "position", "symbol", name.alias("name"))


def subset_to_panels(expr: DataFrame, panels: DataFrame, normalize: bool = False, value: str = "value") -> DataFrame:
    """Every panel's sub-matrix at once: (panel, cell_id, gene, value)."""
    # Written first so that its size is known and the facts need no shuffle when it is small.
    members = pin(panels.select("panel", "gene").distinct())
    out = expr.join(members, "gene").select("panel", "cell_id", "gene", value)
    if normalize:
        total = F.sum(value).over(Window.partitionBy("panel", "cell_id"))
        out = out.withColumn("_t", total).withColumn(value, F.when(F.col("_t") == 0, F.col(value)).otherwise(F.col(value) / F.col("_t") * 1e4))
        out = out.withColumn(value, F.log1p(value)).drop("_t")
    return out


def compare_result_families(a: DataFrame, b: DataFrame, metric: str, by: list[str], names: tuple[str, str]) -> DataFrame:
    """Fold mean and sample std of one metric from two evaluations, side by side."""

    def agg(df, n):
        return df.groupBy(*by).agg(F.avg(metric).alias(f"{n}_mean"), F.stddev_samp(metric).alias(f"{n}_std"))

    return agg(a, names[0]).join(agg(b, names[1]), by)


def overlap_sets(panel: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Panel genes found in A only, B only, or both."""
    fa = a.select("gene").distinct().withColumn("_a", F.lit(True))
    fb = b.select("gene").distinct().withColumn("_b", F.lit(True))
    j = panel.select("gene").distinct().join(fa, "gene", "left").join(fb, "gene", "left").na.fill(False, ["_a", "_b"])
    where = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "a_only").when(F.col("_b"), "b_only")
    return j.withColumn("overlap", where).filter(F.col("overlap").isNotNull()).select("gene", "overlap")
