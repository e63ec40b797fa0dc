import random
import re
from math import comb

import pyarrow as pa
import pytest

from panelweave.llm import quality_rules as q
from tests.llm.data import empty_docs, labels, odd_docs, odd_rows

W = re.compile(r"[^\x20\x09-\x0D]+")


def plain(t):
    t = t or ""
    w = W.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    marked = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 2000 else None
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, marked if marked is None else len(marked)


@pytest.mark.parametrize("t", ["", None, "a b c a b c", "a a a a a", "# x | y\nx\nx \nx\n\n\n", "\u00e9\u00e9 \u4e2d \U0001f600\x0bz", "a b c d a b", "a\x85b\xa0c d"])
def test_counts(t):
    got = [int(x[0]) for x in q.text_metrics(pa.array([t], pa.string()))[:5]]
    assert got == list(plain(t))


def test_odd_rows(spark):
    out = q.quality_rules(odd_docs(spark), labels(spark)).collect()
    assert len(out) == len(odd_rows())
    for r, (_, t, *_) in zip(sorted((r for r in out if r.doc_id is not None), key=lambda r: r.doc_id), sorted((x for x in odd_rows() if x[0] is not None), key=lambda x: x[0])):
        want = plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[:4]
        if want[4] is not None:
            assert r.n_repeat_words == want[4]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    assert q.quality_rules(empty_docs(spark), labels(spark)).count() == 0


def test_binomial_tail():
    assert q.binomial_tail(3, 20, 0.1) == pytest.approx(sum(comb(20, i) * 0.1**i * 0.9 ** (20 - i) for i in range(4)))


def plain_verdicts(rows, good_ids, risk, delta):
    """``kept`` of every row, by loops over whole settings."""
    names = [x.split()[0] for x in q.METRICS.split(", ")]
    counts = {i: dict(zip(names, (int(c[0]) for c in q.text_metrics(pa.array([t], pa.string()))))) for i, t in rows}
    ratio = {
        i: {
            "symbol_ratio": m["n_symbols"] / max(m["n_words"], 1), "dup_line_ratio": m["n_dup_lines"] / max(m["n_lines"], 1), "repeat_ratio": m["n_repeat_words"] / max(m["n_words"], 1),
            "upper_ratio": m["n_upper"] / max(m["word_chars"], 1), "mark_ratio": m["n_marks"] / max(m["n_words"], 1), "long_word": m["word_chars"] / max(m["n_words"], 1),
        }
        for i, m in counts.items()
    }
    stratum = {i: sum(m["n_words"] >= b for b in q.STRATA) for i, m in counts.items()}
    base = {i: m["n_words"] < 50 or 2 * m["n_repeat_words"] > m["n_words"] for i, m in counts.items()}
    half = {}
    for i, t in rows:
        if i in good_ids and not base[i]:
            half.setdefault((stratum[i], t), i)
    kept = {i: not b for i, b in base.items()}
    for s in set(stratum.values()):
        yours = {t: i for (k, t), i in half.items() if k == s}
        one, two = ([i for t, i in yours.items() if HALF[t] == h] for h in (0, 1))
        chosen = {}
        for part in q.LADDER:
            setting = {}
            for name, cuts in q.CUTOFFS.items():
                fit = [c for c in cuts if sum(ratio[i][name] > c for i in one) <= part * risk * len(one) / 6]
                if one and fit:
                    setting[name] = min(fit)
            rejected = sum(any(ratio[i][name] > c for name, c in setting.items()) for i in two)
            tail = sum(comb(len(two), k) * risk**k * (1 - risk) ** (len(two) - k) for k in range(rejected + 1))
            if rejected >= risk * len(two) or tail > delta / 5:
                break
            chosen = setting
        for i in kept:
            if stratum[i] == s and any(ratio[i][name] > c for name, c in chosen.items()):
                kept[i] = False
    return kept


HALF = {}


def test_whole_query_against_loops_and_its_promise(spark):
    rng = random.Random(5)
    good = [(i, " ".join(f"w{rng.randrange(9973)}x{j}" for j in range(rng.choice([60, 60, 120]))) + " #" * (rng.random() < 0.3) + " WORD!" * rng.choice([0, 0, 1, 8])) for i in range(3000)]
    good += [(5000 + i, good[0][1]) for i in range(300)]  # copies are one trial
    bad = [(10_000 + i, " ".join(f"v{j}###" for j in range(rng.choice([60, 120, 300])))) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    truth = labels(spark, [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad])
    HALF.update({r.text: r.half for r in docs.selectExpr("text", "pmod(xxhash64(xxhash64(text)), 2) as half").distinct().collect()})
    out = q.quality_rules(docs, truth).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert kept == plain_verdicts(good + bad, {i for i, _ in good}, 0.01, 0.05)
    assert sum(not kept[i] for i, _ in good) < 0.01 * len(good)
    assert not any(r.kept for r in out if r.doc_id >= 10_000 and r.n_words < 250)
    # No good text is that long, so nothing is certified there, and the rows say so.
    assert all(r.kept and r.n_cutoffs == 0 for r in out if r.doc_id >= 10_000 and r.n_words >= 250)
