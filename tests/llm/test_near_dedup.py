import random
import re

import numpy as np
import pytest

from panelweave.llm import near_dedup as nd
from tests.llm.data import WORDS, empty_docs, odd_docs, odd_rows

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t):
    w = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def plain(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in lists[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(root(i), doc) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return " ".join(out)


def corpus():
    """Groups of near copies of all sizes, a passage in many texts, one large group, short and empty texts."""
    rng = random.Random(3)
    texts = ["", None, " \n", "a b", "a B", "A b c d", "a b c d e", "a b c d e f"]
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.choice([5, 8, 12, 20, 60, 150, 400]))]
        texts += [changed(rng, base, rng.choice([0, 0, 1, 2, max(1, len(base) // 50), max(1, len(base) // 30)])) for _ in range(rng.choice([1, 2, 4, 9]))]
    passage = [rng.choice(WORDS) for _ in range(80)]
    for _ in range(80):
        own = [rng.choice(WORDS) for _ in range(rng.choice([10, 30, 60, 100]))]
        texts.append(" ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]))
    base = [rng.choice(WORDS) for _ in range(200)]
    texts += [changed(rng, base, rng.randrange(7)) for _ in range(60)]
    return list(enumerate(texts))


@pytest.mark.parametrize("list_pairs", [128, 4])
def test_against_all_pairs(spark, monkeypatch, list_pairs):
    """Few pairs per list allowed: the exact way for long lists has to find the rest."""
    monkeypatch.setattr(nd, "LIST_PAIRS", list_pairs)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = nd.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == plain(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    if list_pairs == 128:
        assert sorted(r.doc_id for r in nd.one_per_group(docs).collect()) == sorted(r.doc_id for r in out if r.kept)


@pytest.mark.parametrize("size, more", [(13, 3), (7, 1)])
def test_small_base_with_many_variants(spark, size, more):
    """Variants are linked to their base only, and many keep few of its lists, all of them long."""
    rng = random.Random(7)
    base = [rng.choice(WORDS) for _ in range(size)]
    rows = list(enumerate([" ".join(base + [f"x{i}y{j}" for j in range(more)]) for i in range(200)] + [" ".join(base)]))
    out = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == plain(rows)


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 1000)
    rows = [(i, g, b, n) for g, b, n, m in ((1, 9, 20, 300), (1, 16, 150, 40), (2, 27, 5000, 5)) for i, n in enumerate([n] * m, 1000 * b)]
    blocks = {}
    for r in nd._in_blocks(spark.createDataFrame(rows, "nid long, group long, _band int, n long")).collect():
        blocks.setdefault((r.group, r._band, r._i), []).append(r.n)
    assert sum(map(len, blocks.values())) == len(rows)
    assert all(len(x) <= nd.BLOCK and sum(x[:-1]) < 1000 for x in blocks.values()) and [len(x) for k, x in blocks.items() if k[0] == 2] == [1] * 5


def test_ranges_of_a_block_add_up(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 500, np.uint64)
    sets = [np.unique(np.concatenate([base[: 500 - 9 * i], rng.integers(0, 2**64, 7 * i, np.uint64)])) for i in range(12)]
    n = len(sets)
    rows = nd.pa.table({"nid": list(range(n)), "comp": list(range(n)), "low": [True] * n, "high": [True] * n, "set": [x.tobytes() for x in sets]})
    whole, seen = nd._compare_blocks(rows), []
    monkeypatch.setattr(nd, "SORTED", 700)
    add = nd._add_shared
    monkeypatch.setattr(nd, "_add_shared", lambda shared, parts, *a: (seen.append(sum(map(len, parts))), add(shared, parts, *a)))
    assert nd._compare_blocks(rows) == whole and whole.num_rows and len(seen) > 5 and max(seen) < 1400


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 200) if i % 40 != 39] + [(1000, 500), (500, 700), (3, 3)]
    got = {r.nid: r.comp for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 40 * 40 for i in range(200)} | {1000: 500, 500: 500, 700: 500}
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimates_are_exact_for_small_sets():
    a, b = np.arange(10, dtype=np.uint64), np.arange(4, 12, dtype=np.uint64)
    assert nd.union_estimates([a.tobytes()], [b.tobytes()], np.array([10]), np.array([8]))[0] == 0.5


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = nd.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == plain([r[:2] for r in odd_rows()])
    kept = nd.one_per_group(docs)
    assert kept.columns == docs.columns
    # The three rows of id 8 and the two equal texts without id leave one each; so do rows that are equal as a whole.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, range(10)), "None", "None"])
    assert nd.near_duplicates(empty_docs(spark)).count() == 0 and nd.one_per_group(empty_docs(spark)).count() == 0


def test_a_column_named_like_the_key_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other", "z")], "doc_id long, text string, _key string")
    got = nd.one_per_group(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r._key) for r in got.collect()) == [(1, "x"), (3, "z")]
