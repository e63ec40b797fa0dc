"""Quality scores from a small convolutional network over bytes, in numpy.

The bytes of a text are cut into overlapping chunks that cover all of it.  Every
byte has a learned vector; learned filters slide over the chunk, and each
filter's largest activation is the chunk's feature.  A text's features are the
mean, the largest and the smallest of its chunks'; a logistic unit combines them
into one probability.  Training runs on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import held_out, slices, strings, training_rows

CHUNK, HOP = 256, 240
WIDTH, STRIDE, DIMS, FILTERS = 8, 2, 6, 16
#: Labelled texts used for training, each with all of its chunks.
TRAIN_ROWS = 4000
EPOCHS, BATCH, RATE, DECAY = 10, 64, 0.01, 1e-4
_POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
#: Chunks whose activations are held at a time, however long a text is.
PART = 128


@dataclass
class Network:
    bytes_: np.ndarray  # 257 x DIMS; the last row pads short chunks
    filters: np.ndarray  # WIDTH * DIMS x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 3 * FILTERS + 1 weights and a constant
    shift: float = 0.0

    def chunk_features(self, chunks: np.ndarray) -> np.ndarray:
        """Largest activation of every filter for rows of ``CHUNK`` byte codes (256 pads)."""
        return np.maximum(self.activations(chunks).max(axis=1) + self.bias, 0)

    def activations(self, chunks: np.ndarray) -> np.ndarray:
        """Every filter at every place: one product of strides and filter parts, then the parts' shifted sum."""
        parts = WIDTH // STRIDE
        kernel = self.filters.reshape(parts, STRIDE * DIMS, FILTERS).transpose(1, 0, 2).reshape(STRIDE * DIMS, parts * FILTERS)
        each = (self.bytes_[chunks].reshape(-1, STRIDE * DIMS) @ kernel).reshape(len(chunks), CHUNK // STRIDE, parts, FILTERS)
        out = each[:, :_POSITIONS, 0].copy()
        for j in range(1, parts):
            out += each[:, j : j + _POSITIONS, j]
        return out


def chunk_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and start of the overlapping chunks that cover texts of these sizes; an empty text has one chunk of padding."""
    n = 1 + np.maximum(0, -(-(sizes - CHUNK) // HOP))
    owner = np.repeat(np.arange(len(sizes)), n)
    return owner, (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * HOP


def cut(blob: np.ndarray, first: np.ndarray, sizes: np.ndarray, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Byte codes of the chunks; 256 beyond a text's end."""
    at = start[:, None] + np.arange(CHUNK)
    inside = at < sizes[owner][:, None]
    codes = blob[np.where(inside, first[owner][:, None] + at, 0)].astype(np.int16)
    return np.where(inside, codes, np.int16(256))


def _pooled(features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    edges = np.searchsorted(owner, np.arange(n))
    count = np.diff(np.append(edges, len(owner)))[:, None]
    mean = np.add.reduceat(features, edges, axis=0) / count
    return np.concatenate([mean, np.maximum.reduceat(features, edges, axis=0), np.minimum.reduceat(features, edges, axis=0), np.ones((n, 1), features.dtype)], axis=1)


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 for whole texts; null counts as empty."""
    texts = strings(texts)
    out = np.empty(len(texts))
    for lo, hi in slices(texts, 1 << 21):
        raw = [x.encode() for x in texts.slice(lo, hi - lo).to_pylist()]
        sizes = np.array([len(x) for x in raw], np.int64)
        blob = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        first = np.cumsum(sizes) - sizes
        owner, start = chunk_starts(sizes)
        features = np.concatenate([
            net.chunk_features(cut(blob, first, sizes, owner[i : i + 128], start[i : i + 128])) for i in range(0, len(owner), 128)
        ])
        z = _pooled(features, owner, hi - lo).astype(np.float64) @ net.out
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def training_texts(rows: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Whole training texts as bytes, and labels, in an order that does not depend on the split."""
    found = sorted((bytes(r.raw), r.y) for r in rows.select(F.encode("text", "UTF-8").alias("raw"), "y").collect())
    return [raw for raw, _ in found], np.array([y for _, y in found], np.float64)


def _chunks(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of these texts and the text each belongs to."""
    sizes = np.array([len(x) for x in raw], np.int64)
    owner, start = chunk_starts(sizes)
    return cut(np.frombuffer(b"".join(raw) + b"\0", np.uint8), np.cumsum(sizes) - sizes, sizes, owner, start), owner


def train(texts: list[bytes], y: np.ndarray, seed: int = 11) -> Network:
    """Fit by Adam on the log loss; without both labels the score is the labels' mean."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (257, DIMS)).astype(np.float32), rng.normal(0, 1 / np.sqrt(WIDTH * DIMS), (WIDTH * DIMS, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS + 1),
    )
    base = (y.sum() + 1) / (len(y) + 2)
    net.out[-1] = np.log(base / (1 - base))
    if len(y) == 0 or y.min() == y.max():
        return net
    net.out[:-1] = rng.normal(0, 0.1, 3 * FILTERS)
    values = [net.bytes_, net.filters, net.bias, net.out]
    m, v = [np.zeros(x.shape) for x in values], [np.zeros(x.shape) for x in values]
    step, rounds = 0, max(EPOCHS, min(60, 20_000 // max(1, len(y))))
    for epoch in range(rounds):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            chunks, owner = _chunks([texts[i] for i in pick])
            grads = _gradients(net, chunks, owner, y[pick])
            step += 1
            rate = RATE * (0.5 + 0.5 * np.cos(np.pi * (epoch + lo / len(order)) / rounds))
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                change = rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                values[k] -= (change + rate * DECAY * values[k]).astype(values[k].dtype)
    return net


def _gradients(net: Network, chunks: np.ndarray, owner: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n, c = len(y), len(chunks)
    best, top = np.empty((c, FILTERS), np.int64), np.empty((c, FILTERS), net.filters.dtype)
    for lo in range(0, c, PART):
        act = net.activations(chunks[lo : lo + PART])
        best[lo : lo + PART] = act.argmax(axis=1)
        top[lo : lo + PART] = act.max(axis=1)
    top += net.bias
    features = np.maximum(top, 0)
    pooled = _pooled(features, owner, n)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out, -30, 30)))
    dz = (p - y) / n
    d_out = pooled.T @ dz
    count = np.bincount(owner, minlength=n)[:, None]
    d = (dz[:, None] * net.out[:FILTERS] / count)[owner]
    for at in (1, 2):  # the chunks that gave the largest and the smallest value
        d += np.where(features == pooled[:, at * FILTERS : (at + 1) * FILTERS][owner], (dz[:, None] * net.out[at * FILTERS : (at + 1) * FILTERS])[owner], 0)
    d *= top > 0
    d_bytes, d_filters = np.zeros((257, DIMS)), np.zeros((WIDTH * DIMS, FILTERS))
    for lo in range(0, c, PART):
        part, change = chunks[lo : lo + PART], d[lo : lo + PART]
        rows = np.arange(len(part))[:, None]
        codes = part[rows[:, :, None], (best[lo : lo + PART] * STRIDE)[:, :, None] + np.arange(WIDTH)]
        used = net.bytes_[codes].reshape(len(part), FILTERS, WIDTH * DIMS)
        d_filters += np.einsum("cfw,cf->wf", used, change, optimize=True)
        d_used = (change[:, :, None] * net.filters.T[None]).reshape(len(part), FILTERS, WIDTH, DIMS)
        d_bytes += np.stack([np.bincount(codes.ravel(), d_used[..., k].ravel(), 257) for k in range(DIMS)], axis=1)
    return [d_bytes, d_filters, d.sum(axis=0), d_out]


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    The network is fitted on the whole texts of at most ``TRAIN_ROWS`` labelled rows outside the held-out fold; scoring
    reads whole texts.  Null and empty texts get the score of one chunk of padding; null ids are
    not held out; repeated rows score alike.  With no labelled rows, or only one label, every score is the labels' mean.
    """
    net = train(*training_texts(training_rows(docs, labels, label, TRAIN_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(net, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    slim = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
