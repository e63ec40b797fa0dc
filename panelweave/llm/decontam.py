"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact containment.

Items are partitioned by the size of their shingle set, each partition up to
twice its smallest size.  A document is laid out in overlapping windows that fit
the partition: one and a half times its largest size, a third apart, so that a
passage as long as an item lies in one window whole.  Against such a window a
contained item has a Jaccard similarity of at least 0.23, however long the
document is, and at least one of ``FUNCTIONS`` minima agrees with a probability
above 1 - 1e-6.  Windows of a partition are joined from those of the one below.
Agreeing pairs are verified on the whole document.

The items are the stated query set: they go to the tasks in blocks of bounded
size, every block against all documents.  A block travels as plain texts and each
worker builds its tables; the driver holds one block at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import release, shingles, slices, strings
from panelweave.session import pin

WIDTH = 5
PERCENT = 75
FUNCTIONS = 64
#: Bounds of one block of items, by count and by characters.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32_000_000
_rng = np.random.default_rng(20_011)
_FACTORS = _rng.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)


def _values(h: np.ndarray, k: int) -> np.ndarray:
    return ((h * _FACTORS[k] + _OFFSETS[k]) >> np.uint64(32)).astype(np.uint32)


class Items:
    """One block of items with their sets, partitions and minima."""

    def __init__(self, items: list[tuple[int | None, str]]):
        flat, at = shingles(pa.array([t for _, t in items], pa.string()), WIDTH, whole=False)
        self.ids, self.sets = [], []
        for (item_id, _), lo, hi in zip(items, at[:-1], at[1:]):
            if hi > lo:
                self.ids.append(item_id)
                self.sets.append(np.unique(flat[lo:hi]))
        sizes = np.array([len(s) for s in self.sets], np.int64)
        #: A partition's largest size is a power of two, at least 2.
        self.largest = np.maximum(2, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        self.partitions: dict[int, np.ndarray] = {int(u): np.flatnonzero(self.largest == u) for u in np.unique(self.largest)}
        # Per partition and function: the minima, sorted, their items, and a table of low bits that says "maybe".
        self.minima: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for u, members in self.partitions.items():
            together = np.concatenate([self.sets[i] for i in members])
            starts = np.cumsum(sizes[members]) - sizes[members]
            for k in range(FUNCTIONS):
                low = np.minimum.reduceat(_values(together, k), starts)
                order = np.argsort(low, kind="stable")
                maybe = np.zeros(1 << 16, bool)
                maybe[low & np.uint32(0xFFFF)] = True
                self.minima[u, k] = (low[order], members[order], maybe)

    def candidates(self, flat: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs of which some window and the item agree in a minimum."""
        found: set[tuple[int, int]] = set()
        sizes = np.diff(at)
        full = np.flatnonzero(sizes)
        if not len(full) or not self.partitions:
            return found
        smallest, largest = min(self.partitions), max(self.partitions)
        levels, step = [], smallest // 2
        n = -(-sizes[full] // step)
        first = np.cumsum(n) - n
        starts = np.repeat(at[:-1][full], n) + (np.arange(int(n.sum())) - np.repeat(first, n)) * step
        owner = np.repeat(full, n)
        while 2 * step <= largest:
            follows = (owner[1:] == owner[:-1], owner[2:] == owner[:-2])
            levels.append((2 * step, owner, follows))
            n = -(-n // 2)
            below, first = first, np.cumsum(n) - n
            pair = np.repeat(below, n) + (np.arange(int(n.sum())) - np.repeat(first, n)) * 2
            levels[-1] += (pair,)
            owner, step = owner[pair], 2 * step
        for k in range(FUNCTIONS):
            strides = np.minimum.reduceat(_values(flat, k), starts)
            for u, owners, (one, two), pair in levels:
                if u in self.partitions:
                    window = strides.copy()
                    np.minimum(window[:-1], strides[1:], out=window[:-1], where=one)
                    np.minimum(window[:-2], strides[2:], out=window[:-2], where=two)
                    low, members, maybe = self.minima[u, k]
                    for w in np.flatnonzero(maybe[window & np.uint32(0xFFFF)]).tolist():
                        lo, hi = np.searchsorted(low, window[w], "left"), np.searchsorted(low, window[w], "right")
                        for i in members[lo:hi].tolist():
                            found.add((int(owners[w]), i))
                strides = np.minimum.reduceat(strides, pair)
        return found

    def contained(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) where the document holds enough of the item's set."""
        out = []
        texts = strings(texts)
        for lo, hi in slices(texts):
            flat, at = shingles(texts.slice(lo, hi - lo), WIDTH, whole=False)
            last, own = -1, np.zeros(0, np.uint64)
            for doc, i in sorted(self.candidates(flat, at)):
                if doc != last:
                    last, own = doc, np.unique(flat[at[doc] : at[doc + 1]])
                where = np.minimum(np.searchsorted(own, self.sets[i]), len(own) - 1)
                shared = int((own[where] == self.sets[i]).sum())
                if 100 * shared >= PERCENT * len(self.sets[i]):
                    out.append((lo + doc, i, shared))
        return out


@dataclass(frozen=True)
class ItemBlock:
    """Ids and texts of one block, and a name by which a worker knows the tables it built of it."""

    name: str
    rows: list[tuple[int | None, str]]
    alone: bool

    def items(self) -> Items:
        if _built.get("name") != self.name:
            _built.update(name=self.name, items=Items(self.rows))
        return _built["items"]


#: The block a worker used last.
_built: dict = {}


def item_blocks(benchmark: DataFrame) -> Iterator[ItemBlock]:
    """The items in blocks of bounded size, one after another; null texts and items below five words match nothing."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    count, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    placed = items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        rows = sorted(((r.item_id, r.text) for r in placed.filter(F.col("_block") == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield ItemBlock(uuid.uuid4().hex, rows, blocks == 1)


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment, contaminated``: one row per document row and item it holds.

    An item is held if ``100 * shared >= 75 * size`` of its distinct five-word shingles (A-Z lower-cased) stand anywhere in
    the document.  Null and empty texts, and items below five words, match nothing; null ids stay; repeated rows and items
    give a row each; clean documents give none.  Other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out: DataFrame | None = None
    for block in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block: ItemBlock = block) -> Iterator[pa.RecordBatch]:
            items = block.items()
            for batch in batches:
                found = items.contained(batch.column(1))
                size = [len(items.sets[i]) for _, i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([d for d, _, _ in found], pa.int64())), pa.array([items.ids[i] for _, i, _ in found], pa.int64()),
                     pa.array([s for _, _, s in found], pa.int64()), pa.array(size, pa.int64()),
                     pa.array([s / n for (_, _, s), n in zip(found, size)], pa.float64()), pa.array([True] * len(found), pa.bool_())],
                    names=["doc_id", "item_id", "n_shared", "n_item", "containment", "contaminated"],
                )

        rows = slim.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long, containment double, contaminated boolean")
        # Of several blocks, each is done before the next one is collected.
        rows = rows if block.alone else pin(rows)
        out = rows if out is None else out.unionByName(rows)
    return out


def _clean_of(block: ItemBlock):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        out[[d for d, _, _ in block.items().contained(texts)]] = False
        release()
        return pa.array(out)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Null and empty texts hold none and stay, as do null ids; repeated rows stay or go together; without items all rows stay.
    """
    for block in item_blocks(benchmark):
        docs = docs.filter(_clean_of(block)(F.col("text").cast("string")))
        docs = docs if block.alone else pin(docs)
    return docs
