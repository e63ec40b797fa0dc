import random

import numpy as np
import pyarrow as pa
import pytest

from panelweave.llm import quality_cnn as q
from tests.llm.data import WORDS, empty_docs, labels, odd_docs, odd_rows


def network():
    rng = np.random.default_rng(1)
    return q.Network(rng.normal(size=(257, q.DIMS)).astype(np.float32), rng.normal(size=(q.WIDTH * q.DIMS, q.FILTERS)).astype(np.float32),
                     rng.normal(size=q.FILTERS).astype(np.float32), rng.normal(size=3 * q.FILTERS + 1))


def plain_score(net, text):
    raw = list((text or "").encode())
    chunks, start = [], 0
    while True:
        part = raw[start : start + q.CHUNK]
        part += [256] * (q.CHUNK - len(part))
        chunks.append([[max(0.0, float(np.concatenate([net.bytes_[b] for b in part[i : i + q.WIDTH]]) @ net.filters[:, f] + net.bias[f])) for i in range(0, q.CHUNK - q.WIDTH + 1, q.STRIDE)] for f in range(q.FILTERS)])
        if start + q.CHUNK >= len(raw):
            break
        start += q.HOP
    top = np.array(chunks).max(axis=2)
    z = np.concatenate([top.mean(axis=0), top.max(axis=0), top.min(axis=0), [1]]) @ net.out
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@pytest.mark.parametrize("text", ["", None, "short", "x" * 256, "abé " * 60, "word " * 150])
def test_scores_against_plain_loops(text):
    net = network()
    net.out *= 0.01
    assert q.score_texts(net, pa.array([text, "other"], pa.string()))[0] == pytest.approx(plain_score(net, text), abs=1e-4)


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    net = network()
    net = q.Network(*(x.astype(np.float64) * 0.1 for x in (net.bytes_, net.filters, net.bias, net.out)))
    chunks, owner, y = rng.integers(0, 257, (7, q.CHUNK)).astype(np.int16), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        f = np.maximum(net.activations(chunks).max(axis=1) + net.bias, 0)
        p = 1 / (1 + np.exp(-(q._pooled(f, owner, 3) @ net.out)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for g, x in zip(q._gradients(net, chunks, owner, y), (net.bytes_, net.filters, net.bias, net.out)):
        flat, got = x.reshape(-1), g.reshape(-1)
        for i in rng.integers(0, len(flat), 6):
            old, eps = flat[i], 1e-6
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert got[i] == pytest.approx((up - down) / (2 * eps), abs=1e-6)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS) if i % 3 else rng.choice(WORDS).upper() + "!!" for _ in range(rng.randint(20, 200)))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = q.classify(docs, labels(spark, [(i, int(i % 3 > 0), 0) for i, _ in rows])).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 500 and np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in out)
    odd = q.classify(odd_docs(spark), labels(spark)).collect()
    assert len(odd) == len(odd_rows()) and {round(r.score, 9) for r in odd} == {0.5}
    assert q.classify(empty_docs(spark), labels(spark)).count() == 0
