import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from panelweave.llm import toxicity
from panelweave.llm.common import table
from panelweave.llm.decontam import find_items
from panelweave.llm.mixing import mix
from tests.llm.test_near_dedup import plain

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_steps(spark):
    docs = table(spark, SF, "documents")
    steps = [docs]
    for _, stage in cp.STAGES[:-1]:
        df = stage(spark, steps[-1], SF)
        assert df.columns == docs.columns
        steps.append(spark.createDataFrame(df.collect(), docs.schema))
    raw, clean, single, fresh, mixed = steps
    scores = toxicity.score_toxicity(raw, toxicity.learn(raw, table(spark, SF, "labels")))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in scores.filter("predicted = 0").collect())
    want = plain([(r.doc_id, r.text) for r in clean.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, _, c in want if d == c)
    leaks = {r.doc_id for r in find_items(single, table(spark, SF, "benchmark")).collect()}
    assert sorted(r.doc_id for r in fresh.collect()) == sorted(r.doc_id for r in single.collect() if r.doc_id not in leaks)
    copies = {r.doc_id: r.copies for r in mix(fresh).filter("copies > 0 and size > 0").collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    out = cp.STAGES[-1][1](spark, mixed, SF)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect()}
    assert out.count() == mixed.count() and all(r.n_tokens == n[r.doc_id] for r in out.collect())
    assert cp.run(spark, SF).agg(F.sum("n_tokens")).first()[0] == sum(n[r.doc_id] for r in mixed.collect())
