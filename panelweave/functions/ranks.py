"""Ranks and running sums that never put a whole hot key into one task.

A plain window partitioned by ``key`` sends every row of a key to one task.
Here each key's rows are first cut into value ranges.  The cut points are a
hash sample of the key's own values, so they follow its distribution, do not
depend on task order, and are the same however often Spark recomputes them.
Windows then run per (key, range) and the small table of range totals supplies
the offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.session import pin

SAMPLE_RATE = 32_768
MAX_RANGES = 256
_RANGE = "_range"
_ORDER = "_order"


def add_ranges(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    sample_rate: int = SAMPLE_RATE,
) -> DataFrame:
    """Add ``_order`` and ``_range``; ranges ascend with ``order`` within a key."""
    keys = list(keys)
    df = df.withColumn(_ORDER, order)
    sampled = F.when(F.pmod(F.xxhash64(_ORDER), F.lit(sample_rate)) == 0, F.col(_ORDER))
    pool = F.sort_array(F.collect_set(sampled))
    cuts = df.groupBy(*keys).agg(pool.alias("_pool"))
    step = F.ceil(F.size("_pool") / F.lit(MAX_RANGES)).cast("int")
    cuts = cuts.select(
        *keys,
        F.filter("_pool", lambda _v, i: F.pmod(i, F.greatest(step, F.lit(1))) == 0).alias("_cuts"),
    ).filter(F.size("_cuts") > 0)
    if keys:
        slim = cuts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_cuts")
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        joined = df.join(slim, cond, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    else:
        joined = df.withColumn("_cuts", cuts.select("_cuts").scalar())
    # Binary search: the number of cuts up to the row's value, in a fixed number of steps.
    steps = [1 << b for b in reversed(range(MAX_RANGES.bit_length()))]
    position = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get("_cuts", at + s - 1) <= F.col(_ORDER), at + s).otherwise(at))
    return joined.withColumn(
        _RANGE, F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(position)
    ).drop("_cuts")


def _with_offsets(
    ranged: DataFrame, keys: Sequence[str], weight: Column, name: str, total: str | None = None
) -> DataFrame:
    keys = list(keys)
    totals = ranged.groupBy(*keys, _RANGE).agg(F.sum(weight).alias("_t"))
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(_RANGE).alias("_r"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias(name),
        *([F.sum("_t").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    cond = F.col(_RANGE) == F.col("_r")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranged.join(offsets, cond).drop("_r", *[f"_k{i}" for i in range(len(keys))])


def weight_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    weight: Column,
    out: str,
    sample_rate: int = SAMPLE_RATE,
    total: str | None = None,
    ranges: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``out`` = total weight of the key's rows strictly before this one.

    ``order`` must be distinct within a key.  ``total`` names an optional
    column for the weight of the whole key.  ``ranges`` gives a range number
    that ascends with the order, where the order itself tells one (a hash).
    """
    keys = list(keys)
    if ranges is None:
        ranged = add_ranges(df, keys, order, sample_rate)
    else:
        ranged = df.withColumn(_ORDER, order).withColumn(_RANGE, ranges(F.col(_ORDER)))
    inside = Window.partitionBy(*keys, _RANGE).orderBy(_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    with_off = _with_offsets(ranged, keys, weight, "_off", total)
    local = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return with_off.withColumn(out, F.col("_off") + local).drop("_off", _RANGE, _ORDER)


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    out: str,
    sample_rate: int = SAMPLE_RATE,
    ranges: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``out`` = 1-based position by ``order`` (distinct within a key)."""
    return weight_before(df, keys, order, F.lit(1), "_before", sample_rate, ranges=ranges).withColumn(
        out, (F.col("_before") + 1).cast("long")
    ).drop("_before")


def running_min_from_end(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    value: Column,
    out: str,
    sample_rate: int = SAMPLE_RATE,
) -> DataFrame:
    """``out`` = smallest ``value`` among this row and all later rows of its key."""
    keys = list(keys)
    ranged = add_ranges(df, keys, order, sample_rate)
    totals = ranged.groupBy(*keys, _RANGE).agg(F.min(value).alias("_m"))
    later = Window.partitionBy(*keys).orderBy(F.desc(_RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(_RANGE).alias("_r"),
        F.min("_m").over(later).alias("_later"),
    )
    cond = F.col(_RANGE) == F.col("_r")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # From the end, because a frame that shrinks towards the end is computed anew for every row.
    inside = Window.partitionBy(*keys, _RANGE).orderBy(F.desc(_ORDER)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(offsets, cond)
        .withColumn(out, F.least(F.min(value).over(inside), F.col("_later")))
        .drop("_r", "_later", _RANGE, _ORDER, *[f"_k{i}" for i in range(len(keys))])
    )


def tie_ranks(
    weighted: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    out: str,
    sample_rate: int = SAMPLE_RATE,
) -> DataFrame:
    """Average ranks of distinct values that stand for ``weight`` equal rows each.

    ``weighted`` holds one row per (keys, value).
    """
    return weight_before(
        weighted, keys, F.col(value), F.col(weight), "_before", sample_rate
    ).withColumn(out, F.col("_before") + (F.col(weight) + 1) / 2.0).drop("_before")


def row_tie_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    out: str,
    sample_rate: int = SAMPLE_RATE,
) -> DataFrame:
    """Average ranks on the rows themselves, which stand for ``weight`` equal rows each; values may repeat.

    The rows carry all their other columns along, so nothing is joined back by value.
    """
    keys = list(keys)
    ranged = _with_offsets(add_ranges(df, keys, F.col(value), sample_rate), keys, F.col(weight), "_off")
    # Equal values lie in one range, and the ordered window counts all peers of a row.
    upto = F.sum(weight).over(Window.partitionBy(*keys, _RANGE).orderBy(_ORDER))
    tied = F.sum(weight).over(Window.partitionBy(*keys, _RANGE, _ORDER))
    return ranged.withColumn(out, F.col("_off") + upto - tied + (tied + 1) / 2.0).drop("_off", _RANGE, _ORDER)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    sample_rate: int = SAMPLE_RATE,
) -> DataFrame:
    """Linear-interpolated quantiles per key, one column per entry of ``probs``.

    Unlike ``percentile`` this keeps no per-key buffer of all distinct values.
    """
    keys = list(keys)
    # Distinct values with counts, written once: the input is read a single time.
    counted = pin(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_w")
    ))
    placed = weight_before(counted, keys, F.col("_v"), F.col("_w"), "_b", sample_rate, total="_n")

    def at(pos: Column) -> Column:
        return F.max(F.when((F.col("_b") <= pos) & (pos < F.col("_b") + F.col("_w")), F.col("_v")))

    aggs = [F.max("_n").alias("_n")]
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
    found = placed.groupBy(*keys).agg(*aggs)
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.select(*keys, *out)
