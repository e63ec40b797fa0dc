from pyspark.sql import functions as F

from panelweave.llm.mixing import mix, mixed_documents, source_targets
from tests.llm.data import empty_docs, odd_docs, odd_rows


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by filling up step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets(spark):
    sizes = {"a": 10, "b": 5000, "c": 40, "B": 900, None: 3, "": 77, "z": 0}
    df = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, docs long, source_size long")
    got = {r.source: r.target for r in source_targets(df, (5, 2, 1), 3).collect()}
    want = plain_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix_is_near_its_targets_and_repeats(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + pmod(id * 7919, 50) as int)) AS text", "CASE WHEN id < 3000 THEN 'hot' ELSE concat('s', pmod(id, 7)) END AS source")
    out = mix(docs).cache()
    by = out.withColumn("s", F.col("source_size")).groupBy("s").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 50 for r in by)
    assert out.filter("taken > 3 * size or taken < 0 or taken <> copies * size").count() == 0
    again = mix(docs.repartition(13))
    assert out.exceptAll(again).count() == 0 and again.count() == 6000
    copies = {r.doc_id: r.copies for r in out.collect() if r.copies}
    rows = mixed_documents(docs)
    assert rows.columns == docs.columns and {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()} == copies


def test_odd_rows(spark):
    out = mix(odd_docs(spark)).collect()
    assert len(out) == len(odd_rows()) and all(r.taken <= 3 * r.size for r in out)
    assert {r.size for r in out if r.doc_id in (0, 1, 2)} == {0}
    assert len({r.taken for r in out if r.doc_id == 8}) == 1
    kept = mixed_documents(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == sum(r.copies for r in out)
    assert mix(empty_docs(spark)).count() == 0 and mixed_documents(empty_docs(spark)).count() == 0
    blank = odd_docs(spark).filter("doc_id in (0, 1, 2)")
    assert {(r.taken, r.target) for r in mix(blank).collect()} == {(0, 0.0)} and mixed_documents(blank).count() == 0


def test_inclusion_frequencies(spark):
    # Every source is an independent draw from documents of the same sizes; theta from the definition.
    sizes = [1 + 7 * i % 90 for i in range(90)] + [700, 900]
    rows = [(s * 1000 + i, "w " * n, f"s{s:03d}") for s in range(300) for i, n in enumerate(sizes)]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8), (5, 3, 1), 3).collect()
    for times in (1.0, 1 / 3):  # 3 / 3 words a word: nothing to sample; 1 / 3: sampled only
        of = [r for r in out if abs(r.target / r.source_size - times) < 1e-9]
        assert len(of) == 100 * len(sizes)
        if times == 1.0:
            assert all(r.copies == 1 for r in of)
            continue
        missing, bits = times * sum(sizes), {n: n.bit_length() for n in sizes}
        settled = set()
        while True:
            theta = (missing - sum(n for n in sizes if n in settled)) / sum(n * bits[n] for n in sizes if n not in settled)
            more = {n for n in sizes if n not in settled and theta * bits[n] >= 1}
            if not more:
                break
            settled |= more
        for b in set(bits.values()):
            got = [r.copies for r in of if r.size.bit_length() == b]
            p = 1.0 if any(bits[n] == b for n in settled) else theta * b
            # Stopping at a number of words moves the frequencies a little.
            assert abs(sum(got) / len(got) - p) < 0.02 + 4 * (p * (1 - p) / len(got)) ** 0.5, (b, sum(got) / len(got), p)
