"""Hard negatives by tiled inner products, multiplied by Strassen's recursion.

Rows are dealt to tiles by a hash of their id and every anchor goes to every
tile.  A task gets a tile's rows first and holds them as one integer matrix; the
anchors then stream past in blocks.  A block's products with the tile come from
Strassen's recursion on 64-bit integers: odd sides get zero rows or columns, and
sums and differences are exact, so the products are as well.

The first pass keeps, per anchor and tile, the best rows of the anchor's label;
these heaps merge into each anchor's positives.  The second pass keeps, per
anchor, positive and tile, the best rows of other labels inside the positive's
window of scores, and those heaps merge in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.session import pin

#: Side below which products are made directly.
LEAF = 16
#: Bytes of a tile's integer matrix, and anchors multiplied with it at a time.
TILE_BYTES, ANCHORS = 4 << 20, 256


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of 64-bit integers; exact wherever the result fits into 64 bits, since all sums are exact modulo 2**64."""
    m, d = a.shape
    n = b.shape[1]
    if min(m, d, n) <= LEAF:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, d % 2))) if m % 2 or d % 2 else a
    b = np.pad(b, ((0, d % 2), (0, n % 2))) if d % 2 or n % 2 else b
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _matrix(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Rows of ``floor(scale * x)``; shorter vectors end in zeros, and values stay within 62 bits."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = np.clip(values, -(2.0**62), 2.0**62).astype(np.int64)
    return out


class Tile:
    """A tile's distinct rows, sorted by label and then by id."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int, scale: int):
        rows = pa.Table.from_batches(parts)
        matrix = _matrix(rows["vector"].combine_chunks(), dim, scale)
        ids, labels, row = (rows[c].to_numpy() for c in ("id", "label", "row"))
        order = np.lexsort((row, ids, labels))
        ids, labels, row = ids[order], labels[order], row[order]
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == ids[:-1]) & (labels[1:] == labels[:-1]) & (row[1:] == row[:-1])
        self.ids, self.labels, self.row = ids[~again], labels[~again], row[~again]
        self.across = np.ascontiguousarray(matrix[order[~again]].T)

    def positives(self, anchors: pa.RecordBatch, scores: np.ndarray, k: int) -> list[tuple]:
        """The ``k`` best other rows of each anchor's label: anchor, its row, positive, its row, score."""
        out = []
        for a, own, label, s in zip(anchors["id"].to_pylist(), anchors["row"].to_pylist(), anchors["label"].to_pylist(), scores):
            lo, hi = np.searchsorted(self.labels, [label, label + 1])
            at = lo + np.flatnonzero(self.ids[lo:hi] != a)
            at = self._top(at, s[at], k)
            out += [(a, own, int(self.ids[i]), int(self.row[i]), int(s[i])) for i in at]
        return out

    def negatives(self, anchors: pa.RecordBatch, scores: np.ndarray, k: int, low: int, high: int) -> list[tuple]:
        """The ``k`` best rows of other labels in each positive's window: anchor, its row, the positive's rank, negative, its row, score."""
        out = []
        for a, own, label, positives, s in zip(anchors["id"].to_pylist(), anchors["row"].to_pylist(), anchors["label"].to_pylist(), anchors["positives"].to_pylist(), scores):
            t = 100 * s
            lowest, highest = min(low * p["score"] for p in positives), max(high * p["score"] for p in positives)
            near = np.flatnonzero((t >= lowest) & (t <= highest) & (self.labels != label) & (self.ids != a))
            for p in positives:
                at = near[(t[near] >= low * p["score"]) & (t[near] <= high * p["score"])]
                out += [(a, own, p["rank"], int(self.ids[i]), int(self.row[i]), int(s[i])) for i in self._top(at, s[at], k)]
        return out

    def _top(self, at: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
        if len(at) > k:
            keep = s >= np.partition(s, len(s) - k)[len(s) - k]
            at, s = at[keep], s[keep]
        return at[np.lexsort((self.row[at], self.ids[at], -s))[:k]]


def _tiles(rows: DataFrame, anchors: DataFrame, tiles: int, dim: int, scale: int, work, schema: str) -> DataFrame:
    """``work(tile, anchors, scores)`` for every tile and block of anchors."""
    each = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    right = anchors.withColumn("kind", F.lit(1)).withColumn("tile", each)
    left = rows.withColumn("kind", F.lit(0)).withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
    both = left.unionByName(right, allowMissingColumns=True).repartition(tiles, "tile").sortWithinPartitions("tile", "kind")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        tile, number = None, None
        for batch in batches:
            which = batch["tile"].to_numpy() * 2 + batch["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
            for lo, hi in zip(cuts, cuts[1:]):
                if which[lo] // 2 != number:
                    number, parts, tile = which[lo] // 2, [], None
                if which[lo] % 2 == 0:
                    parts.append(batch.slice(lo, hi - lo))
                    continue
                if not parts and tile is None:
                    continue
                if tile is None:
                    tile, parts = Tile(parts, dim, scale), []
                for at in range(lo, hi, ANCHORS):
                    block = batch.slice(at, min(ANCHORS, hi - at))
                    got = work(tile, block, strassen(_matrix(block["vector"], dim, scale), tile.across))
                    yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(len(names))], names=names)

    return both.mapInArrow(run, schema)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vectors(id, label, vector)``.

    Scores are inner products of ``floor(scale * component)``; higher ones come first, ties by smaller id.  An anchor's
    positives are its first other rows of its label, a positive's negatives the first rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.  ``id`` and ``label`` are whole numbers,
    ``anchor`` is a condition on the columns.

    Rows with a null id, label or vector or with a null or non-finite component take no part.  Equal rows count once;
    rows that share only their id are rows of their own, but none is the other's positive or negative.  Shorter vectors
    end in zeros, empty ones score 0.  Scores are exact within 64 bits.  An anchor without positives or a positive
    without negatives gives no row, and so does an empty table.  Other columns are ignored.
    """
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    clean = vectors.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine)
    marked = clean.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector", F.xxhash64("id", "label", "vector").alias("row"), F.coalesce(anchor, F.lit(False)).alias("_anchor"))
    count, dim = marked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    dim = max(1, dim)
    tiles = max(1, -(-count * dim * 8 // TILE_BYTES))
    rows = marked.drop("_anchor")
    anchors = pin(marked.filter("_anchor").drop("_anchor").dropDuplicates(["id", "label", "row"]))

    heaps = _tiles(rows, anchors, tiles, dim, scale, lambda tile, block, s: tile.positives(block, s, positives), "id long, row long, positive long, p_row long, score long")
    place = Window.partitionBy("id", "row").orderBy(F.desc("score"), "positive", "p_row")
    first = heaps.withColumn("rank", F.row_number().over(place).cast("long")).filter(F.col("rank") <= positives)
    chosen = pin(first.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("rank", "positive", "score"))).alias("positives")))

    with_windows = anchors.join(chosen, ["id", "row"])
    heaps = _tiles(rows, with_windows, tiles, dim, scale, lambda tile, block, s: tile.negatives(block, s, negatives, low, high), "id long, row long, p long, negative long, n_row long, score long")
    place = Window.partitionBy("id", "row", "p").orderBy(F.desc("score"), "negative", "n_row")
    best = heaps.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= negatives)
    pairs = chosen.select("id", "row", F.explode("positives").alias("_p")).select("id", "row", F.col("_p.rank").alias("p"), F.col("_p.positive").alias("positive_id"), F.col("_p.score").alias("positive_score"))
    return best.join(pairs, ["id", "row", "p"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
