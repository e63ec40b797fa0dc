import random

import numpy as np
import pyarrow as pa

from panelweave.llm import toxicity as tx
from tests.llm.data import WORDS, empty_docs, labels, odd_docs, odd_rows


def levenshtein(a, b):
    table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return table[-1][-1]


def test_automaton_against_plain_distances():
    rng = random.Random(4)
    terms = [("idiot", False, 1.0), ("moron", False, 1.0), ("disgusting", False, 1.0), ("lowei", True, 1.0), ("scum", False, 1.0), ("worthless", True, 1.0)]
    lex = tx.Lexicon(terms)
    words = []
    for _ in range(3000):
        w = list(rng.choice(terms)[0])
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            op = rng.choice("ids")
            if op == "i":
                w.insert(k, rng.choice("idotscuml"))
            elif k < len(w):
                w[k : k + 1] = [] if op == "d" else [rng.choice("idotscuml")]
        words.append("".join(w) + rng.choice(["", "", "schaft"]))
    for w in words:
        best = None
        for t, (text, stem, _) in enumerate(terms):
            most = tx.allowed_edits(text)
            ends = range(len(w) + 1) if stem else [len(w)]
            d = min(levenshtein(w[:e], text) for e in ends)
            if d <= most and (best is None or (d, t) < best):
                best = (d, t)
        assert lex.match(w) == best, w


def test_short_terms_and_swaps():
    lex = tx.Lexicon([("idiot", False, 1.0), ("scum", False, 1.0), ("stupid", True, 1.0), ("vex", False, 1.0)], True, frozenset(["slum"]))
    for w, t in (("scvm", 1), ("sc*m", 1), ("scuum", 1), ("csum", 1), ("scmu", 1), ("idoit", 0), ("diiot", 0), ("stuipdity", 2)):
        assert lex.match(w) == (1, t), w
    assert lex.match("vex") == (0, 3) and not any(map(lex.match, ["slum", "vexe", "evx", "mucs", "idtoi"]))


def test_abuse_by_short_or_misspelled_words_only(spark):
    rng = random.Random(10)
    rows, truth = [], []
    for i in range(900):
        words = [rng.choice([*WORDS, "slum"]) for _ in range(rng.randint(20, 60))]
        for _ in range(3 if i % 6 == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["scum", "zud", "vilebeast"]))
        rows.append((i, " ".join(words)))
        truth.append((i, 1, int(i % 6 == 0)))
    model = tx.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, truth))
    assert {"scum", "zud"} <= {t for t, _, _ in model.lexicon.terms}
    assert model.lexicon.match("scvm")[0] == 1 and model.lexicon.match("slum") is None and model.lexicon.match("zud")[0] == 0


def test_quotation_is_told_from_abuse():
    lex = tx.Lexicon([("idiot", False, 2.0)])
    names = tx.FEATURES
    row = lambda t: dict(zip(names, tx.features(lex, pa.array([t]))[0]))
    assert row("you are an idiot. really")["exact"] > 0 and row("you are an idi0t")["fuzzy"] > 0
    assert row('he used "idiot" there')["quoted_exact"] > 0 and row('he used "idiot" there')["exact"] == 0
    assert row("she called him idiot once")["quoted_exact"] > 0
    assert not any(v for v in row(None).values())


def corpus(spark, n=900):
    rng = random.Random(9)
    rows, truth = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 120))]
        bad = i % 6 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vilebeast", "grubface", "slimo"]))
        rows.append((i, " ".join(words)))
        truth.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, truth), {i: y for i, _, y in truth}


def test_held_out_accuracy(spark):
    docs, truth, y = corpus(spark)
    out = tx.score_toxicity(docs, tx.learn(docs, truth)).collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 100 and np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_odd_rows(spark):
    docs, truth, _ = corpus(spark)
    model = tx.learn(docs, truth)
    odd = odd_docs(spark)
    assert tx.score_toxicity(odd, model).count() == len(odd_rows()) and tx.score_toxicity(empty_docs(spark), model).count() == 0
    kept = tx.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows())
    none = tx.learn(odd, labels(spark))
    assert {round(r.score, 9) for r in tx.score_toxicity(odd, none).collect()} == {0.5}
