"""Readers and writers on small files."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from panelweave.sources import matrix as mx
from panelweave.sources import panels as sp
from panelweave.sources import results as rs
from panelweave.sources.text import line_numbers, raw_lines


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if str(path).endswith(".gz"):
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        with open(path, "w") as f:
            f.write(text)


@pytest.mark.parametrize("columns", [1, 3])
def test_mtx_folder(spark, tmp_path, columns):
    d = str(tmp_path)
    # The second entry looks exactly like the size line.
    _write(f"{d}/matrix.mtx.gz", "%%MatrixMarket\n% note\n3 2 4\n1 1 5\n3 2 4\n2 1 0\n1 2 7\n")
    _write(f"{d}/barcodes.tsv.gz", "AAA\nBBB\n")
    _write(f"{d}/features.tsv.gz", "".join(f"ENS{i}\tS{i}\tGene\n" if columns == 3 else f"ENS{i}\n" for i in (1, 2, 3)))
    got = mx.read_mtx_folder(spark, d)
    assert {tuple(r) for r in got.expr.collect()} == {("AAA", "ENS1", 5.0), ("BBB", "ENS3", 4.0), ("BBB", "ENS1", 7.0)}
    assert {r.symbol for r in got.genes.collect()} == ({"S1", "S2", "S3"} if columns == 3 else {"ENS1", "ENS2", "ENS3"})
    assert got.cells.count() == 2


def test_line_numbers_of_a_split_file(spark, tmp_path):
    path = f"{tmp_path}/x.txt"
    _write(path, "".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        n = line_numbers(raw_lines(spark, path))
        assert n.filter(F.col("line").cast("long") != F.col("line_no")).count() == 0
        assert n.select("block").distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_wide_matrix(spark, tmp_path):
    _write(f"{tmp_path}/m.csv", "gene,c1,c2\nA,1,0\nB,2.5,3\n")
    _write(f"{tmp_path}/xy.csv", "i,x,y\n0,10,20\n1,30,40\n")
    d = mx.read_wide_matrix(spark, f"{tmp_path}/m.csv", f"{tmp_path}/xy.csv")
    assert {tuple(r) for r in d.expr.collect()} == {("c1", "A", 1.0), ("c1", "B", 2.5), ("c2", "B", 3.0)}
    assert {tuple(r) for r in d.cells.select("cell_id", "x", "y").collect()} == {("c1", 10.0, 20.0), ("c2", 30.0, 40.0)}


@pytest.mark.parametrize("text,want", [
    ("gene,selected_final\nA,True\nB,False\nC,True\n", ["A", "C"]),
    ("x,Gene_Name,gene_id\n1,A,E1\n2,,E2\n", ["A"]),
    ("ENSG01\nENSG02\n", ["ENSG01", "ENSG02"]),
    ("whatever,other\nA,1\nB,2\n", ["A", "B"]),
    ('note,gene\n"a, b",A\n', ["A"]),
])
def test_gene_list_headers(spark, tmp_path, text, want):
    _write(f"{tmp_path}/g.csv", text)
    got = sp.read_gene_list(spark, f"{tmp_path}/g.csv").orderBy("position")
    assert [r.gene for r in got.collect()] == want


def test_vendor_header_preference(spark, tmp_path):
    _write(f"{tmp_path}/v.csv", "symbol,gene_id,z\nS1,E1,1\n")
    assert sp.read_10x_panel(spark, f"{tmp_path}/v.csv").first()["gene"] == "E1"


def test_panel_tree(spark, tmp_path):
    r = f"{tmp_path}/run"
    _write(f"{r}/F/All-Genes/deg_only/50-genes/results/selected_genes.csv", "gene\nA\nB\nZ\n")
    _write(f"{r}/F/All-Genes/nmf/5_factors/50-genes/results/selected_genes_DEG-based-filling.csv", "gene\nB\n")
    _write(f"{r}/F/All-Genes/HVG/50-genes/results/selected_hvg_7genes.csv", "gene\nC\n")
    _write(f"{r}/F/All-Genes/HVG/50-genes/results/selected_random_7genes_bootstrap.csv", "gene\nC\n")
    _write(f"{r}/F/All-Genes/HVG/50-genes/results/intermediate_x.csv", "gene\nC\n")
    _write(f"{r}/F/elsewhere/selected_genes.csv", "gene\nC\n")
    genes = spark.createDataFrame([(g,) for g in "ABC"], "gene string")
    got = {(x.panel, x.gene) for x in sp.read_panels(spark, r, genes).collect()}
    assert got == {("F_All-Genes_deg_only_50", "A"), ("F_All-Genes_deg_only_50", "B"), ("F_All-Genes_nmf_5factors_50_DEG-based-filling", "B"), ("F_All-Genes_HVG_7", "C")}


def test_external_panels(spark, tmp_path):
    _write(f"{tmp_path}/e.csv", "gene\nA\nQ\nB\nC\n")
    genes = spark.createDataFrame([(g,) for g in "ABC"], "gene string")
    path = f"{tmp_path}/e.csv"
    cut = sp.read_external_panels(spark, {"ext": path}, genes, [2]).collect()
    assert {(r.panel, r.gene) for r in cut} == {("ext_2", "A"), ("ext_2", "B")}
    assert {r.panel for r in sp.read_external_panels(spark, {"ext": path}, genes, [9]).collect()} == {"ext"}


def test_panel_cache(spark, tmp_path):
    p = spark.createDataFrame([("A",), ("B",)], "gene string")
    sp.save_panel(p, str(tmp_path), "scanpy", False, "deg_only", 3)
    assert sp.load_cached_panel(spark, str(tmp_path), "scanpy", False, "deg_only", 3) is None
    assert sp.load_cached_panel(spark, str(tmp_path), "scanpy", True, "deg_only", 3) is None
    sp.save_panel(p, str(tmp_path), "scanpy", False, "deg_only", 2)
    assert sp.load_cached_panel(spark, str(tmp_path), "scanpy", False, "deg_only", 2).count() == 2


def test_result_trees(spark, tmp_path):
    r = str(tmp_path)
    _write(f"{r}/k_05/iter_1/a.csv", "selection_method,eval_method,macro_mse\nnmf,cnmf,0.5\n")
    _write(f"{r}/k_05/iter_2/a.csv", "macro_mse,macro_expvar,selection_method,eval_method\n0.7,0.9,nmf,cnmf\n")
    k = {(x.k_value, x.iteration, x.macro_mse, x.macro_expvar) for x in rs.read_k_varying(spark, r).collect()}
    assert k == {(5, 1, 0.5, None), (5, 2, 0.7, 0.9)}
    s = f"{r}/st"
    _write(f"{s}/iter_1/selected_genes.csv", "gene\nA\nB\n")
    _write(f"{s}/iter_2/selected_genes.csv", "gene\nA\n")
    assert {(x.gene, x.n_selected) for x in rs.read_stability(spark, s).collect()} == {("A", 2), ("B", 1)}
    b = f"{r}/base"
    _write(f"{b}/clustering_quality_x.csv", "dataset_name,celltype,ARI\np,,0.4\n")
    got = rs.read_baseline(spark, b, "clustering", ["ARI"]).first()
    assert (got.dataset, got.celltype, got.ARI) == ("p", None, 0.4)
    v = f"{r}/var"
    _write(f"{v}/panelA/m.csv", "analysis_type,celltype,fold,mse\nglobal,,0,0.1\n")
    assert rs.read_variability(spark, v, ["mse"]).first()["dataset"] == "panelA"
    kinds = {x.kind: x.n_files for x in rs.detect_results(spark, r).collect()}
    assert kinds == {"k_varying": 2, "stability": 2, "clustering": 1, "variability": 1}
    m = f"{r}/meth"
    _write(f"{m}/nmf_100/m.csv", "mse,expvar,n_cells\n1,0.5,10\n3,0.7,30\n")
    x = rs.collect_method_results(spark, m).first()
    assert (x.n_genes, x.macro_mse, x.weighted_mse) == (100, 2.0, 2.5)


def test_wide_matrix_takes_any_names_and_many_columns(spark, tmp_path):
    n = 30_000
    path = tmp_path / "wide.csv"
    path.write_text("gene," + ",".join(f"c.{i}-1" for i in range(n)) + "\n" + "g1," + ",".join("1" if i % 1000 == 7 else "0" for i in range(n)) + '\n"g,2",' + ",".join("2.5" if i == n - 1 else "" for i in range(n)) + "\n")
    d = mx.read_wide_matrix(spark, str(path))
    assert d.cells.count() == n and sorted(r.gene for r in d.genes.collect()) == ["g,2", "g1"]
    rows = {(r.cell_id, r.gene): r.value for r in d.expr.collect()}
    assert rows == {(f"c.{i}-1", "g1"): 1.0 for i in range(7, n, 1000)} | {(f"c.{n - 1}-1", "g,2"): 2.5}


def test_mtx_folder_of_parts(spark, tmp_path):
    """Matrix, barcodes and features as folders of parts that follow each other by name."""
    d = str(tmp_path)
    _write(f"{d}/matrix.mtx.gz/part-00000.txt", "%%MatrixMarket\n3 3 4\n")
    _write(f"{d}/matrix.mtx.gz/part-00001.txt", "1 1 5\n3 3 4\n")
    _write(f"{d}/matrix.mtx.gz/part-00002.txt", "3 3 4\n2 2 9\n")
    _write(f"{d}/barcodes.tsv.gz/part-00000.txt", "AAA\nBBB\n")
    _write(f"{d}/barcodes.tsv.gz/part-00001.txt", "CCC\n")
    _write(f"{d}/features.tsv.gz/part-00000.txt", "ENS1\tS1\n")
    _write(f"{d}/features.tsv.gz/part-00001.txt", "ENS2\tS2\nENS3\tS3\n")
    got = mx.read_mtx_folder(spark, d)
    assert sorted(tuple(r) for r in got.expr.collect()) == [("AAA", "ENS1", 5.0), ("BBB", "ENS2", 9.0), ("CCC", "ENS3", 4.0), ("CCC", "ENS3", 4.0)]
    assert [r.cell_id for r in got.cells.orderBy("cell_id").collect()] == ["AAA", "BBB", "CCC"]
