"""Queries against their SQL, or operators by hand, on the inputs on which reviews found them wrong."""

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelweave.operators import neighbors as nb
from panelweave.operators import predict as pr
from panelweave.operators import sets as st
from panelweave.plans import selection as se
from panelweave.schema import ExprData
from tests.oracle import compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def _against_sql(spark, folder, name, **tables):
    """``tables``: name -> (schema, rows), written to ``folder``; the query there has to give what its SQL gives."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    ok, message = compare(QUERIES[name](spark, str(folder)), con, SQL[name])
    assert ok, message


def test_10x_lists_merge_by_place_beyond_a_million(spark, tmp_path):
    parts = [(k, f"Brand#{k % 5}", 1 + k % 14) for k in (*range(0, 60, 3), *range(999_990, 1_000_040))]
    supplier = [(k,) for k in (*range(40), 99_999, 100_002)]
    _against_sql(spark, tmp_path, "combine_with_10x", part=("p_partkey long, p_brand string, p_size int", parts), supplier=("s_suppkey long", supplier))


def test_10x_lists_follow_own_genes_without_a_start(spark):
    own = spark.createDataFrame([("p", "A", 2_000_000), ("p", "B", 7)], "panel string, gene string, position long")
    vendor = spark.createDataFrame([("5k", "C", 0), ("5k", "A", 1)], "tenx string, gene string, position long")
    order = lambda *a: [r.gene for r in st.combine_with_10x(own, vendor, "5k", *a).orderBy("position").collect()]
    assert order() == ["B", "A", "C"] and order(1_000_000) == ["B", "C", "A"]


def test_forest_summary_with_missing_values(spark, tmp_path):
    """A missing value is not in a mean, a user without any value ranks last, and more digits than cents count."""
    draw = random.Random(3)
    rows = [(e, e % 13, None if e % 5 == 0 or e % 13 == 12 else draw.randrange(1, 9000) / 1024) for e in range(900)]
    _against_sql(spark, tmp_path, "forest_gene_summary", events=("event_id long, user_id long, value double", rows))


def test_holdout_runs_every_trial_of_the_reference(spark, monkeypatch):
    sizes, hold = [], pr.gene_holdout
    monkeypatch.setattr(pr, "gene_holdout", lambda genes, n_test, trials, *a: sizes.append((n_test, trials)) or hold(genes, n_test, trials, *a))
    monkeypatch.setattr(pr, "correlation_medians", lambda corr, by: corr)
    corr = QUERIES["holdout_gene_experiment"](spark, "/root/testdata/sf0.001")
    assert sizes == [(20, 10)] and {r.trial for r in corr.select("trial").distinct().collect()} == set(range(10))


def test_knn_graph_has_the_largest_neighbourhood(spark):
    ranks = QUERIES["knn_graph"](spark, "/root/testdata/sf0.001").groupBy("cell_id").agg(F.max("rank").alias("most")).select("most").distinct().collect()
    assert [r.most for r in ranks] == [max(nb.GRAPH_KS)]


def test_mapping_weights_round_without_decimals(spark):
    # Rounding by decimals took seven times as long as everything else.
    plan = QUERIES["mapping_weights"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rint(" in plan and " round(" not in plan


def test_forest_matrix_is_kept_on_disk(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    held, fit = [], RandomForestClassifier.fit

    def watched(self, df, *a):
        info = list(spark.sparkContext._jsc.sc().getRDDStorageInfo())
        held.append((sum(r.memSize() for r in info), sum(r.diskSize() for r in info)))
        return fit(self, df, *a)

    monkeypatch.setattr(RandomForestClassifier, "fit", watched)
    rows = [(c, f"g{g}", float((c * (g + 3)) % 7)) for c in range(200) for g in range(6)]
    cells = spark.createDataFrame([(c, "ab"[c % 2]) for c in range(200)], "cell_id long, celltype string")
    expr = spark.createDataFrame(rows, "cell_id long, gene string, value double")
    genes = expr.select("gene").distinct()
    scores = se.forest_scores(ExprData(expr, cells, genes), genes, seeds=(42, 43), folds=2, trees=3).collect()
    assert {r.fold for r in scores} == {f"seed{s}_fold{f}" for s in (42, 43) for f in (0, 1)} and len(scores) == 24
    assert len(held) == 4 and all(mem == 0 and disk > 0 for mem, disk in held)
