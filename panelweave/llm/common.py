"""Helpers shared by the text operators: columns, word splitting, shingles, folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at a time inside a task; one longer text is handled alone.
BLOCK_BYTES = 8 << 20
#: The documents' word separators, code points 32 and 9 to 13, are the white space of Arrow's ASCII split.
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows ``text, y`` outside the held-out fold, picked by a hash of the id.

    Rows without id, text or label, and ids with contradicting labels, are not used.
    """
    y = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .filter("_id is not null and y is not null")
        .groupBy("_id").agg(F.min("y").alias("y"), F.max("y").alias("_y2")).filter("y = _y2").drop("_y2")
    )
    picked = y.filter(~held_out(F.col("_id"))).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(limit)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("text")).filter("text is not null")
    return texts.join(picked, "_id").select("text", "y")


def slices(texts: pa.Array, limit: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    out, start, base = [], 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        out.append((start, stop))
        start, base = stop, int(ends[stop - 1])
    return out


def release() -> None:
    """Give back what Arrow keeps of freed memory: a worker lives on through the stages, and what it keeps adds to theirs."""
    pa.default_memory_pool().release_unused()


def strings(texts: pa.Array) -> pa.Array:
    """Plain strings; null is empty."""
    return pc.fill_null(texts.cast(pa.string()) if texts.type != pa.string() else texts, "")


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Texts with every byte replaced by ``table``, which keeps bytes from 128 on; null is empty."""
    texts = strings(texts)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    raw = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if data is not None else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(raw.translate(table)))


def word_table(kept: str) -> bytes:
    """For ``translated``: A-Z become a-z, then ASCII characters that are not in ``kept`` become blanks."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b).lower()
        table[b] = ord(c) if c in kept else 32
    return bytes(table)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word codes of all texts one after another, each text's first position (and the end), and the words by code."""
    lists = pc.ascii_split_whitespace(strings(texts))
    coded = lists.flatten().dictionary_encode()
    at = lists.offsets.to_numpy().astype(np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    keep = pc.not_equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    if keep.all():
        return codes, at - at[0], coded.dictionary
    mask = keep[codes]
    before = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return codes[mask], before[at - at[0]], coded.dictionary


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    return h ^ (h >> np.uint64(32))


def word_hashes(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def shingles(texts: pa.Array, width: int = 5, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of lower-cased (A-Z) words, text after text, and each text's first position.

    A text with fewer words gives its whole sequence as one shingle if ``whole``, else none.
    """
    codes, at, words = split_words(pc.ascii_lower(strings(texts)))
    h = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(at)
    many = np.maximum(n - width + 1, 0)
    short = (n > 0) & (n < width)
    count = many + short if whole else many
    out_at = np.concatenate([[0], np.cumsum(count)])
    rolled = h[: max(0, len(h) - width + 1)].copy()
    for j in range(1, width):
        rolled = rolled * _GOLDEN + h[j : j + len(rolled)]
    left = np.arange(len(rolled)) + width <= np.repeat(at[1:], n)[: len(rolled)]
    full = mixed(rolled[left])
    if not whole or not short.any():
        return full, out_at
    out = np.empty(out_at[-1], np.uint64)
    place = np.ones(len(out), bool)
    for i in np.flatnonzero(short):
        place[out_at[i]] = False
        x = np.uint64(0)
        with np.errstate(over="ignore"):
            for v in h[at[i] : at[i + 1]]:
                x = x * _GOLDEN + v + np.uint64(1)
            out[out_at[i]] = mixed(np.array([x + np.uint64(n[i])]))[0]
    out[place] = full
    return out, out_at
