import random

from panelweave.llm.decontam import drop_contaminated, find_items
from tests.llm.data import WORDS, empty_docs, odd_docs, odd_rows
from tests.llm.test_near_dedup import shingle_set


def test_against_plain_containment(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([5, 7, 12, 30, 60, 130, 400])))) for i in range(60)]
    items += [(60, "too short"), (61, None), (62, ""), (None, items[3][1]), (5, items[5][1])]
    docs = []
    for i in range(200):
        host = [rng.choice(WORDS) for _ in range(rng.choice([0, 20, 400, 3000]))]
        words = rng.choice(items)[1]
        if i % 2 and words:
            w = words.split()
            cut = rng.randrange(1 + len(w) // 3)
            w = [x.upper() for x in (w[cut:] if rng.random() < 0.5 else w[: len(w) - cut])]
            at = rng.randrange(len(host) + 1)
            host[at:at] = w
        docs.append((i, " ".join(host)))
    got = sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    want = []
    sets = [(i, shingle_set(t)) for i, t in items if t and len(t.split()) >= 5]
    for d, t in docs:
        own = shingle_set(t) if len(t.split()) >= 5 else set()
        want += [(d, i, len(own & s), len(s)) for i, s in sets if 100 * len(own & s) >= 75 * len(s)]
    assert len(want) > 50 and got == sorted(want, key=str)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, "same text in two rows of one id here", "x"), (None, None, "y")], "item_id long, text string, doc_id string")
    assert [(r.doc_id, r.item_id, r.containment, r.contaminated) for r in find_items(docs, items).collect()] == [(8, 1, 1.0, True)] * 3
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows()) - 3
    assert find_items(empty_docs(spark), items).count() == 0 and find_items(docs, items.limit(0)).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == len(odd_rows())


def test_several_blocks(spark, monkeypatch):
    from panelweave.llm import decontam

    rng = random.Random(9)
    items = spark.createDataFrame([(i, " ".join(rng.choice(WORDS) for _ in range(9))) for i in range(30)], "item_id long, text string")
    docs = items.selectExpr("item_id AS doc_id", "concat('before it ', text, ' after it') AS text").union(odd_docs(spark).select("doc_id", "text"))
    want = sorted((r.doc_id, r.item_id) for r in find_items(docs, items).collect())
    kept = drop_contaminated(docs, items).count()
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 8)
    assert len(list(decontam.item_blocks(items))) == 4
    assert sorted((r.doc_id, r.item_id) for r in find_items(docs, items).collect()) == want == [(i, i) for i in range(30)]
    assert drop_contaminated(docs, items).count() == kept == len(odd_rows())
