import math
import random
import re
from collections import Counter

import numpy as np

from panelweave.llm import lexical_search as ls
from panelweave.llm.lexical_search import Shard, lexical_search
from tests.llm.data import WORDS, empty_docs, odd_docs, odd_rows


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """All scores of all documents."""
    bags = [(i, terms_of(t)) for i, t in docs]
    bags = [(i, Counter(t), len(t)) for i, t in bags if t]
    total, length, df = len(bags), sum(n for _, _, n in bags), Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, bag, n in bags:
            m = 25 + 75 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms_of(text) if t in bag)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=10, parts=7):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search(d, spark.createDataFrame(items, "item_id long, text string"), k).collect()), key=str)


def corpus(rng, n):
    draw = lambda: WORDS[int(300 * rng.random() ** 3)]
    return [(i, " ".join(rng.choice([str.upper, str])(draw()) for _ in range(rng.choice([1, 5, 30, 200])))) for i in range(n)]


def test_against_all_scores(spark, monkeypatch):
    rng = random.Random(12)
    docs = corpus(rng, 900)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 8, 40])))) for i in range(40)] + [(50, "w1 w1 w2 unheard-of"), (50, "w3"), (51, "unheard"), (52, ""), (53, None), (None, "w5 w9"), (54, "w7"), (54, "w7")]
    want = plain(docs, items)
    assert run(spark, docs, items) == want
    # Tiny shards, short reads and blocks of single items change nothing.
    for name, value in (("SHARD", 64), ("READ", 1), ("BLOCK_BYTES", 60), ("SALTS", 2)):
        monkeypatch.setattr(ls, name, value)
    assert run(spark, docs, items[-14:]) == plain(docs, items[-14:])


def test_ties_across_tasks(spark):
    docs = [(i, "alpha beta") for i in range(60)] + [(100 + i, "alpha beta") for i in range(40)] + [(-1, "gamma delta"), (7, "alpha beta"), (None, "alpha beta")]
    random.Random(1).shuffle(docs)
    assert run(spark, docs, [(1, "alpha"), (2, "gamma beta")]) == plain(docs, [(1, "alpha"), (2, "gamma beta")])


def test_stops_early_and_exactly():
    rng = np.random.default_rng(3)
    docs, terms = 4000, 12
    has = rng.random((docs, terms)) < 0.5
    has[:12] = True
    owner, codes = np.nonzero(has)
    tf = rng.integers(1, 4, len(owner))
    tf[owner < 12] = 400
    n = np.full(docs, 50)
    shard = Shard(n, owner, codes, tf, rng.integers(100, 5000, terms), docs, int(n.sum()))
    dense = np.zeros((docs, terms), np.int64)
    for t, a, b in zip(shard.terms, shard.start, shard.end):
        dense[shard.docs[a:b], t] = shard.impact[a:b]
    asked, times = np.array([0, 3, 5, 11, 99]), np.array([1, 2, 1, 1, 1])
    total = dense[:, asked[:4]] @ times[:4]
    want = np.lexsort((np.arange(docs), -total))[:5]
    got, scores = shard.best(asked, times, 5, np.zeros(0, np.int64))
    assert got.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert shard.accesses < docs  # most documents are never looked up
    assert len(shard.best(asked, times, 5, np.full(5, total.max() * 10))[0]) == 0


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "same text é don", 5), (2, "id", 6), (3, None, 7)], "item_id long, text string, doc_id int")
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search(odd_docs(spark), items).collect()), key=str)
    assert got == plain(rows, [(1, "same text é don"), (2, "id")])
    for d, i in ((empty_docs(spark), items), (odd_docs(spark), items.limit(0)), (odd_docs(spark), items.filter("text is null"))):
        found = lexical_search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0
    texts = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y")], "doc_id string, text string")
    assert [r.doc_id for r in lexical_search(texts, spark.createDataFrame([("q", "x")], "item_id string, text string")).orderBy("rank").collect()] == ["a", "b", None]
