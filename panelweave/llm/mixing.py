"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target is its share of all words, at most ``max_repeats`` times its
own words; what exceeds that is shared again by weight.  The whole part of target
/ source size are certain copies of every document.  For the words still missing,
a document's inclusion probability grows with its length,

    p = theta * bits(size),     bits: binary digits of the number of words,

where theta makes the expected words, sum of p * size, equal the missing ones; classes
of lengths that would get 1 or more are settled with one more certain copy.  For
the sample every other document gets the key

    Q = (u / (1 - u)) / (p / (1 - p)),     u from a hash of id and text,

and the smallest keys of a source are taken until the words still missing are
reached: the sample's size is fixed in words, as the targets are.  The document on
the edge is in if at least half of it fits.  The edge is found from word sums of key
ranges and one look inside a single range per source, so no source is ever gathered
or sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.ranks import row_index, weight_before
from panelweave.session import pin

#: Documents of a source in one key range, on average.
RANGE_ROWS = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A hash of seed, id and text; rows that share it are the same row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit("null"))))


def _bits(size: Column) -> Column:
    return F.length(F.bin(size)).cast("long")


def _pareto(key: Column, p: Column) -> Column:
    u = (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") * 2 + 1) / float(1 << 53)
    return (u / (1 - u)) / (p / F.greatest(1 - p, F.lit(1e-12)))


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """``source, docs, source_size, target`` from ``source, docs, source_size``.

    Weights go round the sources by code point, null last.  The targets are the water level of the caps: sources are taken
    by cap per weight, and the first one that would not fill up gives the level of all that follow.
    """
    place = F.struct(F.col("source").isNull().alias("a"), F.coalesce("source", F.lit("")).alias("b"))
    placed = row_index(sizes, [], place, "_place")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    caps = pin(placed.withColumn("_w", weight).withColumn("_cap", max_repeats * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w")))
    all_words, all_weight = caps.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    order = F.struct("_ratio", "_place")
    summed = weight_before(weight_before(caps, [], order, F.col("_cap"), "_caps_before"), [], order, F.col("_w"), "_w_before")
    left = F.lit(all_weight) - F.col("_w_before")
    filled = F.col("_caps_before") + F.col("_ratio") * left
    level = summed.filter(filled >= F.lit(all_words)).agg(
        F.min_by((F.lit(all_words) - F.col("_caps_before")) / left, order)
    ).first()[0]
    target = F.least(F.col("_cap").cast("double"), F.lit(float(level or 0.0)) * F.col("_w"))
    return caps.select("source", "docs", "source_size", target.alias("target"))


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _plan(slim: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """One row per source: what a document needs to know to tell how often it is taken."""
    # At most 64 rows a source.
    classes = pin(slim.groupBy("source", _bits(F.col("size")).alias("_bits")).agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("_words")))
    sizes = classes.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("_words").alias("source_size"))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = pin(
        source_targets(pin(sizes), weights, max_repeats).withColumn("_times", times)
        .withColumn("_certain", F.floor("_times")).withColumn("_all_missing", F.col("target") - F.col("_certain") * F.col("source_size"))
        .withColumn("_ranges", F.ceil(F.col("docs") / RANGE_ROWS))
        .withColumnRenamed("source", "_source")
    )
    # Classes from the longest texts down: the first whose share is below one copy gives theta, those before it are settled.
    longer = Window.partitionBy("source").orderBy(F.desc("_bits")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy(F.desc("_bits")).rowsBetween(0, Window.unboundedFollowing)
    theta = (
        classes.withColumn("_settled_words", F.coalesce(F.sum("_words").over(longer), F.lit(0)))
        .withColumn("_weighted", F.sum(F.col("_words") * F.col("_bits")).over(rest)).withColumn("_free_words", F.sum("_words").over(rest))
        .join(plan.select("_source", "_all_missing"), _same_source("source", "_source")).drop("_source")
        .withColumn("_missing", F.col("_all_missing") - F.col("_settled_words"))
        .filter(F.col("_missing") * F.col("_bits") < F.col("_weighted"))
        .groupBy(F.col("source").alias("_s0")).agg(F.max_by(F.struct("_bits", "_missing", "_weighted", "_free_words"), "_bits").alias("_c"))
        .select("_s0", F.col("_c._bits").alias("_top"), F.col("_c._missing").alias("_missing"),
                (F.col("_c._missing") / F.col("_c._weighted")).alias("_theta"), (F.col("_c._missing") / F.col("_c._free_words")).alias("_p"))
    )
    plan = pin(plan.join(theta, _same_source("_source", "_s0"), "left").drop("_s0"))
    keyed = _keyed(slim, plan)
    ranges = keyed.groupBy("_source", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .join(plan.select(F.col("_source").alias("_s"), "_missing"), _same_source("_source", "_s")).drop("_s")
        .filter(F.col("_before") + F.col("_sum") > F.col("_missing"))
        .groupBy("_source").agg(F.min("_range").alias("_edge"), F.min_by("_before", "_range").alias("_edge_before"))
    )
    edge = pin(edge.select(F.col("_source").alias("_s"), "_edge", "_edge_before"))
    inside = keyed.join(edge, _same_source("_source", "_s") & (F.col("_range") == F.col("_edge")))
    # Rows that are the same row are taken or left together.
    inside = inside.groupBy("_source", "_missing", "_edge_before", "_q", "_key").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("_source").orderBy("_q", "_key").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        inside.withColumn("_start", F.col("_edge_before") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
        .filter(F.col("_start") + F.col("size") / 2 <= F.col("_missing"))
        .groupBy(F.col("_source").alias("_s2")).agg(F.max(F.struct("_q", "_key")).alias("_cut"))
    )
    return pin(
        plan.join(edge.drop("_edge_before"), _same_source("_source", "_s"), "left").drop("_s")
        .join(cut, _same_source("_source", "_s2"), "left").drop("_s2")
    )


def _with_key(both: DataFrame) -> DataFrame:
    """Adds the Pareto key and its range; both are null for documents that are not sampled."""
    free = (F.col("_missing") > 0) & (_bits(F.col("size")) <= F.col("_top"))
    keyed = both.withColumn("_q", F.when(free, _pareto(F.col("_key"), F.col("_theta") * _bits(F.col("size")))))
    # The source's mean probability spreads the keys about evenly over its ranges.
    z = F.col("_q") * F.col("_p") / F.greatest(1 - F.col("_p"), F.lit(1e-12))
    return keyed.withColumn("_range", F.floor(F.col("_ranges") * (1 - 1 / (1 + z))))


def _keyed(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents that take part in the sampling, with Pareto key and key range."""
    return _with_key(slim.join(plan, _same_source("source", "_source"))).filter("_q is not null")


def _times_taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``_copies`` to rows with ``source, size, _key``."""
    both = _with_key(rows.join(plan, _same_source("source", "_source"), "left"))
    # Without an edge everything fits; in the edge's range the cut decides.
    sampled = (
        F.when(F.col("_edge").isNull() | (F.col("_range") < F.col("_edge")), True)
        .when(F.col("_range") == F.col("_edge"), F.coalesce(F.struct("_q", "_key") <= F.col("_cut"), F.lit(False))).otherwise(False)
    )
    settled = (F.col("_all_missing") > 0) & (F.col("_top").isNull() | (_bits(F.col("size")) > F.col("_top")))
    more = F.when(F.col("_q").isNotNull(), sampled).otherwise(settled)
    return both.withColumn("_copies", (F.col("_certain") + more.cast("long")).cast("long"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for every row of ``docs(doc_id, text, source)``.

    Null text has size 0 and null sources are one source of their own; documents of size 0 take no words.  Rows with equal
    id and text count each, and are taken or left together; null ids are told apart by their texts.  If there are no words
    all targets are 0, and a source without words is not taken; an empty table gives no rows.  The result does not depend on the order or split of the rows.
    """
    slim = pin(docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        sampling_key(F.col("doc_id"), F.col("text"), seed).alias("_key"),
    ))
    taken = _times_taken(slim, _plan(slim, weights, max_repeats))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("_copies") * F.col("size")).alias("taken"), F.col("_copies").alias("copies"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, with their own columns.

    Documents of size 0 take no words; they stay as often as their own draw says, those of a source without words do not.
    """
    key = sampling_key(F.col("doc_id"), F.col("text"), seed)
    slim = pin(docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("_key")))
    plan = _plan(slim, weights, max_repeats)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"), key.alias("_key"))
    taken = _times_taken(rows, plan).filter("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
