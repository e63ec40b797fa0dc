import random
import re

from panelweave.llm.license_scan import Notice, find_notices, license_digest
from panelweave.llm.queries import LICENSES, MORE_LICENSES, op11_license_scan
from tests.llm.data import WORDS, empty_docs, odd_docs, odd_rows

LETTERS = "abcdefghij é"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def places(text, phrase):
    w, p = words_of(text), phrase.split()
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def distance(a, b, most):
    if abs(len(a) - len(b)) > most:
        return 99
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return 99
    return row[-1]


def fewest_edits(text, n):
    """The fewest edits of any stretch of words, by trying all; exact words split both sides."""
    w, parts = words_of(text), []
    for x in n.phrase.split():
        if x in n.exact:
            parts.append((True, x))
        elif parts and not parts[-1][0]:
            parts[-1] = (False, parts[-1][1] + " " + x)
        else:
            parts.append((False, x))
    best = {i: 0 for i in range(len(w) + 1)}  # word reached -> edits
    for fixed, x in parts:
        after = {}
        for i, e in best.items():
            ends = [i + 1] if fixed else range(i + 1, min(len(w), i + len(x.split()) + n.edits + 1) + 1)
            for j in ends:
                if j > len(w) or (fixed and w[i] != x):
                    continue
                d = e + (0 if fixed else distance(" ".join(w[i:j]), x, n.edits))
                if d <= n.edits and d < after.get(j, 99):
                    after[j] = d
        best = after
    return min(best.values(), default=None)


def broken(rng, phrase, edits):
    s = list(phrase)
    for _ in range(edits):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        s[i : i + (kind > 0)] = [] if kind == 1 else [rng.choice(LETTERS)]
    return "".join(s)


def test_against_all_stretches(spark):
    rng, both = random.Random(11), [*LICENSES, *MORE_LICENSES]
    docs = []
    for i in range(240):
        n = both[i % len(both)]
        near = broken(rng, n.phrase, rng.randrange(n.edits + 2))
        host = [rng.choice(WORDS) for _ in range(rng.randrange(6))]
        docs.append((i, " ".join(host) + " " + (near.upper() if i % 5 == 0 else near.replace(" ", rng.choice([" ", "\n", " - "]))) + rng.choice(["", ". ", " x y"])))
    got = {r.doc_id: r for r in find_notices(spark.createDataFrame(docs, "doc_id long, text string"), both).collect()}
    hits = 0
    for i, text in docs:
        for k, n in enumerate(both):
            found = [m for m in got[i].matches if m.notice == k]
            want = fewest_edits(text, n)
            assert (min((m.edits for m in found), default=None)) == want, (text, n)
            hits += want is not None and want > 0
            for m in found:
                assert words_of(text[m.start : m.end]) == words_of(text)[m.first_word : m.last_word + 1] and m.label == n.label
    assert hits > 80


def test_base_places_and_digest(spark):
    rng = random.Random(12)
    docs = []
    for i in range(200):
        parts = [rng.choice([*WORDS[:20], "CC  BY-NC", "cc by nc", "cc by", "nc", "Under the MIT License", "under the mit", "license", "Apache License, Version 2.0", "apache licence version 2"]) for _ in range(rng.randrange(40))]
        docs.append((i, " ".join(parts)))
    docs += [(1000, "cc by nc " * 30_000), (1001, "license " * 30_000)]
    got = {r.doc_id: r for r in license_digest(spark.createDataFrame(docs, "doc_id long, text string"), LICENSES, MORE_LICENSES).collect()}
    for i, text in docs:
        at = sorted((p, n.label) for n in LICENSES for p in places(text, n.phrase))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words_of(text)), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert r.score == (1.0 if at else r.score) and (r.score > 0) == (r.labels != "")


def test_versions_and_names_are_exact(spark):
    docs = [(0, "Apache License, Version 1"), (1, "cc by nd"), (2, "under the bit license"), (3, "apache license version 20"), (4, "the Apache Licence, Verson 2.0!")]
    got = {r.doc_id: r.labels for r in license_digest(spark.createDataFrame(docs, "doc_id long, text string"), LICENSES, MORE_LICENSES).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "", 4: "apache-2"}


def test_odd_rows(spark):
    rows = license_digest(odd_docs(spark), LICENSES, MORE_LICENSES).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in rows) == sorted((str(r[0]), len(words_of(r[1]))) for r in odd_rows())
    assert all((r.n_base, r.first_word, r.labels, r.score) == (0, None, "", 0.0) for r in rows)
    assert license_digest(empty_docs(spark), LICENSES, []).count() == 0
    assert [r.matches for r in find_notices(odd_docs(spark), []).collect()] == [[]] * len(odd_rows())


def test_query_reads_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op11_license_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        at = [p for n in LICENSES for p in places(texts[r.doc_id], n.phrase)]
        assert (r.n_words, r.n_base, r.first_word) == (len(words_of(texts[r.doc_id])), len(at), min(at, default=None))
