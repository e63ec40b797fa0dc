"""Reproducible splits and samples ordered by an md5 of (id, seed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import md5_key, md5_number
from panelweave.functions.ranks import SAMPLE_RATE, row_index


def _order(seed: int, key: str = "cell_id"):
    # The id follows the hash so that the order is total even if two hashes met.
    return F.struct(md5_key(F.col(key), seed).alias("h"), F.col(key).alias("k"))


def _by_hash(order):
    """4096 even ranges of the hash: nothing has to be looked up for a row."""
    return F.conv(F.substring(order["h"], 1, 3), 16, 10).cast("int")


def split_simple(cells: DataFrame, test: float = 0.2, seed: int = 42, sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """Random train / test roles; ceil(n * test) cells are test."""
    n = cells.agg(F.count(F.lit(1))).scalar()
    r = row_index(cells, [], _order(seed), "_i", sample_rate, _by_hash).withColumn("_n", n)
    return r.withColumn("role", F.when(F.col("_i") <= F.ceil(F.col("_n") * F.lit(test)), "test").otherwise("train")).drop("_i", "_n")


def fold_of_cell(cells: DataFrame, n_folds: int = 5, seed: int = 42, group: str = "celltype", sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """Stratified fold number per cell: position within its type modulo the folds."""
    r = row_index(cells, [group], _order(seed), "_i", sample_rate, _by_hash)
    return r.withColumn("fold", ((F.col("_i") - 1) % n_folds).cast("int")).drop("_i")


def split_kfold(cells: DataFrame, n_folds: int = 5, seed: int = 42, group: str = "celltype") -> DataFrame:
    """splits(fold, cell_id, celltype, role): every cell once per fold."""
    f = fold_of_cell(cells, n_folds, seed, group).withColumnRenamed("fold", "_own")
    f = f.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    return f.withColumn("role", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train")).drop("_own")


def per_celltype_splits(splits: DataFrame, min_cells: int = 10, group: str = "celltype") -> DataFrame:
    """Cell types per fold with enough train and test cells."""
    c = splits.groupBy("fold", group).agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test")
    )
    return c.filter((F.col("n_train") >= min_cells) & (F.col("n_test") >= min_cells))


def split_ratio(cells: DataFrame, ratio: int = 4, by: str | None = None, seed: int = 2020, sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """ratio:1 train/test, optionally within each ``by`` group: n // (ratio+1) * ratio train cells."""
    keys = [by] if by else []
    r = row_index(cells, keys, _order(seed), "_i", sample_rate, _by_hash)
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        r = r.join(sizes.withColumnRenamed(by, "_g"), F.col(by).eqNullSafe(F.col("_g"))).drop("_g")
    else:
        r = r.withColumn("_n", sizes.scalar())
    n_train = F.floor(F.col("_n") / (ratio + 1)) * ratio
    return r.withColumn("role", F.when(F.col("_i") <= n_train, "train").otherwise("test")).drop("_i", "_n")


def uniform_samples(cells: DataFrame, size: int = 500, group: str = "celltype", seed: int = 2020, sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """``size`` rows per type: without replacement when it has more cells, else drawn with replacement.

    Returns (slot, cell_id, celltype).
    """
    # No slot asks for a place beyond ``size``, so only the head of each type is numbered.
    head = Window.partitionBy(group).orderBy(_order(seed))
    r = cells.select("cell_id", group).withColumn("_i", F.row_number().over(head).cast("long")).filter(F.col("_i") <= size)
    sizes = cells.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    slots = sizes.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(size))))
    pick = md5_number(F.md5(F.concat_ws(":", F.col("slot").cast("string"), F.col(group), F.lit(str(seed))).cast("binary")))
    slots = slots.withColumn("_i", F.when(F.col("_n") > size, F.col("slot").cast("long")).otherwise(pick % F.col("_n") + 1)).drop("_n")
    return slots.join(r, [group, "_i"]).select("slot", "cell_id", group)


def one_vs_other(df: DataFrame, target: str, group: str = "celltype", out: str = "label") -> DataFrame:
    return df.withColumn(out, F.when(F.col(group) == target, F.col(group)).otherwise("other"))


def gene_holdout(genes: DataFrame, n_test: int = 20, trials: int = 10, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, trial, gene, role): ``n_test`` random held-out genes per trial, drawn from all genes."""
    g = genes.select(*by, "gene").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    h = F.md5(F.concat_ws(":", "gene", (F.col("trial") + seed).cast("string")).cast("binary"))
    w = Window.partitionBy(*by, "trial").orderBy(h, "gene")
    keys = [*by, "trial", "gene"]
    test = g.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n_test).select(*keys, F.lit("test").alias("role"))
    return g.join(test, keys, "left").na.fill("train", ["role"])


def bootstrap_draws(genes: DataFrame, n: int, draws: int = 10, seed: int = 42) -> DataFrame:
    """(draw, gene): ``n`` distinct genes per seeded draw."""
    g = genes.select("gene").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    h = F.md5(F.concat_ws(":", "gene", (F.col("draw") + seed).cast("string")).cast("binary"))
    w = Window.partitionBy("draw").orderBy(h, "gene")
    return g.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n).drop("_i")
