"""Distributed ranks must not depend on how values are cut into ranges."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelweave.functions.ranks import add_ranges, exact_quantiles, row_index, row_tie_ranks, running_min_from_end, tie_ranks


def _skewed(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcde"), n))
    return pd.DataFrame({"k": key, "id": np.arange(n), "v": np.round(rng.standard_normal(n), 2)})


@pytest.mark.parametrize("rate", [1, 3, 32768])
def test_row_index(spark, rate):
    pdf = _skewed(spark)
    got = row_index(spark.createDataFrame(pdf), ["k"], F.struct("v", "id"), "i", rate).toPandas().sort_values("id")
    want = pdf.sort_values(["v", "id"]).groupby("k").cumcount() + 1
    assert (got["i"].to_numpy() == want.sort_index().to_numpy()).all()


@pytest.mark.parametrize("rate", [1, 5, 32768])
def test_row_index_without_key(spark, rate):
    pdf = _skewed(spark, 500)
    got = row_index(spark.createDataFrame(pdf), [], F.struct("v", "id"), "i", rate).toPandas().sort_values(["v", "id"])
    assert list(got["i"]) == list(range(1, 501))


@pytest.mark.parametrize("rate", [1, 4])
def test_tie_ranks_and_quantiles(spark, rate):
    pdf = _skewed(spark)
    df = spark.createDataFrame(pdf)
    w = df.groupBy("k", "v").agg(F.count("*").alias("w"))
    r = tie_ranks(w, ["k"], "v", "w", "r", rate).toPandas().set_index(["k", "v"])["r"]
    want = pdf.assign(r=pdf.groupby("k")["v"].rank()).groupby(["k", "v"])["r"].first()
    assert np.allclose(r.sort_index(), want.sort_index())
    q = exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.9}, rate).toPandas().set_index("k").sort_index()
    assert np.allclose(q["a"], pdf.groupby("k")["v"].quantile(0.25))
    assert np.allclose(q["b"], pdf.groupby("k")["v"].quantile(0.9))


def test_running_min(spark):
    pdf = _skewed(spark)
    got = running_min_from_end(spark.createDataFrame(pdf), ["k"], F.col("id"), F.col("v"), "m", 2).toPandas().sort_values("id")
    want = pdf.iloc[::-1].groupby("k")["v"].cummin().sort_index()
    assert np.allclose(got["m"], want)


def test_null_key_is_a_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, v int")
    got = {(r.k, r.v): r.i for r in row_index(df, ["k"], F.col("v"), "i", 1).collect()}
    assert got == {(None, 1): 1, (None, 3): 2, ("a", 2): 1}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=30))
def test_quantile_property(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    q = exact_quantiles(df, [], "v", {"m": 0.5}, 2).first()["m"]
    assert q == pytest.approx(float(np.median(values)))


@pytest.mark.parametrize("rate", [1, 7, 1_000_000])
def test_ranks_on_rows_with_ties(spark, rate):
    rng = random.Random(9)
    rows = [(k, rng.randrange(12), rng.randrange(5), rng.randrange(1, 4)) for k in "ab" for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, v int, other int, c long")
    for r in row_tie_ranks(df, ["k"], "v", "c", "r", rate).collect():
        low = sum(c for k, v, _, c in rows if k == r.k and v < r.v)
        same = sum(c for k, v, _, c in rows if k == r.k and v == r.v)
        assert r.r == low + (same + 1) / 2


def test_running_min_frames_grow_from_a_fixed_end(spark):
    # A frame that ends at the last row is computed anew for every row, with the square of the range.
    df = spark.createDataFrame([("a", i, float(-i)) for i in range(50)], "k string, id int, v double")
    out = running_min_from_end(df, ["k"], F.col("id"), F.col("v"), "m", 5)
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert all(r.m == -49.0 for r in out.collect())


def test_ranges_take_few_comparisons(spark):
    df = spark.range(3000).withColumn("v", (F.col("id") * 37) % 3001)
    out = add_ranges(df, [], F.col("v"), 2)
    rows = out.toPandas()
    cuts = sorted(rows[rows["_range"] > 0].groupby("_range")["v"].min())
    assert 200 < len(cuts) <= 256
    assert (np.searchsorted(np.array(cuts), rows["v"], side="right") == rows["_range"]).all()
    assert "filter(_cuts" not in out._jdf.queryExecution().analyzed().toString() and "aggregate(array" in out._jdf.queryExecution().analyzed().toString()
