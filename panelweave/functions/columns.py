"""Scalar column expressions used across operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label columns looked for, in this order.
CLUSTER_COLUMNS = ["leiden", "louvain", "clusters", "cluster"]
ANNOTATION_COLUMNS = ["annot", "cell_type", "celltype", "cluster", "celltypes_v2"]


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den`` with ``default`` where the denominator is zero or null."""
    return F.when((den == 0) | den.isNull(), F.lit(default).cast("double")).otherwise(num / den)


def is_finite(c: Column) -> Column:
    return ~(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


def md5_key(c: Column, seed: int | Column) -> Column:
    """Reproducible pseudo-random sort key of an id."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", c.cast("string"), s.cast("string")).cast("binary"))


def md5_number(c: Column) -> Column:
    """First 8 hex digits of an md5 as a number."""
    return F.conv(F.substring(c, 1, 8), 16, 10).cast("long")


def shifted_log(value: Column, shift: float = 0.0) -> Column:
    """``log1p(max(value + shift, 0))``."""
    return F.log1p(F.greatest(value + F.lit(float(shift)), F.lit(0.0)))


def resolve_column(df: DataFrame, requested: str | None, candidates: Sequence[str] = CLUSTER_COLUMNS) -> str:
    """The requested column, which must be present; without a request the first candidate that is."""
    names = df.columns
    if requested is not None:
        if requested not in names:
            raise ValueError(f"no column {requested} among {names}")
        return requested
    for c in candidates:
        if c in names:
            return c
    raise ValueError(f"none of {list(candidates)} among {names}")


@F.pandas_udf(T.DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided p value of a standard normal score."""
    x = np.abs(z.to_numpy(dtype=float)) / math.sqrt(2.0)
    return pd.Series(np.fromiter(map(math.erfc, x), dtype=float, count=len(x)))
