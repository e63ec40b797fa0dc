"""Ranked lexical search by the Best Position Algorithm.

Items are handled in blocks of bounded text, one block after another; a block's
terms are the only ones its pass over the documents keeps.

1. One pass turns every document into its length and the counts of the block's
   terms, and writes them.  Document frequencies and the corpus sums come from
   that table.
2. A task cuts its documents into shards and sorts each term's impacts in a
   shard into a list.  For an item all its lists are read side by side from the
   top (sorted accesses).  Every document met is looked up in all other lists at
   once (direct accesses), and the position it has in each list is marked.
3. A list's best position ends the marked run at its top.  A document not met
   yet has at most the impact found there, in every list.  When the sum of these
   impacts is strictly below the k-th score so far, no other document can come
   in, not even by a tie, and the shard is done for the item.
4. The k best of a task so far carry over to its next shard, so that later
   shards stop earlier.  The tasks' bests are merged, first in salted groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelweave.functions.ranks import weight_before
from panelweave.llm.common import slices, split_words, strings, translated, word_table
from panelweave.session import pin

_TABLE = word_table("0123456789abcdefghijklmnopqrstuvwxyz")
#: Bytes of item texts searched for at a time; a longer item is a block of its own.
BLOCK_BYTES = 1 << 20
#: Cells of a shard's table of positions (terms by documents), and most documents of a shard.
CELLS, SHARD = 1 << 25, 8192
#: Entries read from every list before the first test of the threshold; doubled after each test.
READ = 16
SALTS = 64


def _codes(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``terms`` of all terms of the texts (-1: none of them), and each text's first position."""
    codes, at, words = split_words(translated(texts, _TABLE))
    known = pc.fill_null(pc.index_in(words, terms), -1).to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int32)
    return known[codes], at


def _postings(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """``doc_id, n, codes, tfs`` of every document with a term: its length and the counts of ``terms`` in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, len(terms))
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                known, at = _codes(batch.column(1).slice(lo, hi - lo), terms)
                n = np.diff(at)
                owner = np.repeat(np.arange(hi - lo), n)
                held, tf = np.unique((owner * width + known)[known >= 0], return_counts=True)
                cut = np.searchsorted(held, np.arange(hi - lo + 1) * width)
                codes, tf = (held % width).astype(np.int32), tf.astype(np.int64)
                rows = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array([codes[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array([tf[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                    names=["doc_id", "n", "codes", "tfs"],
                )
                yield rows.filter(pa.array(n > 0))

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n long, codes binary, tfs binary")


def _frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total[np.frombuffer(raw, np.int32)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["code", "df"])

    found = postings.select("codes").mapInArrow(run, "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["code"].to_numpy()] = found["df"].to_numpy()
    return out


class Shard:
    """Impact lists of some documents.  Documents are numbered in ascending order of their ids."""

    def __init__(self, n: np.ndarray, owner: np.ndarray, codes: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, length: int):
        m = 25 + (75 * n * documents) // length
        impact = weights[codes] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        order = np.lexsort((owner, -impact, codes))
        self.size = len(n)
        self.docs, self.impact = owner[order], np.append(impact[order], 0)
        self.terms, self.start = np.unique(codes[order], return_index=True)
        self.end = np.append(self.start[1:], len(codes))
        row = np.searchsorted(self.terms, codes[order])
        self.place = np.full((len(self.terms), self.size), -1, np.int32)
        self.place[row, self.docs] = np.arange(len(codes)) - self.start[row]
        self.accesses = 0

    def best(self, terms: np.ndarray, counts: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the documents that can be among the ``k`` best, given the best scores ``known`` elsewhere."""
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) if len(self.terms) else np.zeros(len(terms), bool)
        rows, times = at[here], counts[here]
        none = np.zeros(0, np.int64)
        if not len(rows):
            return none, none
        start, size = self.start[rows], (self.end - self.start)[rows]
        offset = np.concatenate([[0], np.cumsum(size)])
        marked = np.zeros(offset[-1] + 1, bool)  # the last one stays unmarked
        flat = np.arange(len(marked))
        met = np.zeros(self.size, bool)
        docs, scores = none, none
        depth, step = 0, READ
        kth = known[k - 1] if len(known) >= k else 0
        # No document has more than the sum of the lists' tops.
        while depth == 0 or depth < size.max():
            if depth:
                run = np.minimum(np.minimum.reduceat(np.where(marked[:-1], len(marked), flat[:-1]), offset[:-1]), offset[1:]) - offset[:-1]
                bound = np.where(run < size, self.impact[start + run - 1], 0)
            else:
                bound = self.impact[start]
            limit = int((times * bound).sum())
            if limit < kth or limit == 0:
                break
            got = np.concatenate([self.docs[s + depth : s + min(depth + step, z)] for s, z in zip(start.tolist(), size.tolist()) if depth < z])
            got = np.unique(got)
            fresh = got[~met[got]]
            met[fresh] = True
            if len(fresh):
                place = self.place[rows[:, None], fresh]
                held = place >= 0
                value = np.where(held, self.impact[np.where(held, start[:, None] + place, -1)], 0)
                total = (times[:, None] * value).sum(axis=0)
                marked[(offset[:-1, None] + place)[held]] = True
                self.accesses += place.size
                docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, total])
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
                every = np.sort(np.concatenate([known, scores]))[::-1]
                kth = int(every[k - 1]) if len(every) >= k else 0
            depth += step
            step *= 2
        keep = scores > 0
        return docs[keep], scores[keep]


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            part = batch.slice(lo, most)
            if rows + part.num_rows > most:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _search(postings: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``qid, score, doc_id``: the ``k`` best of every task for every item."""
    kind = postings.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)
    most = max(64, min(SHARD, CELLS // max(1, len(weights))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        for table in _shards(batches, most):
            table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
            codes = [np.frombuffer(x, np.int32) for x in table["codes"].to_pylist()]
            owner = np.repeat(np.arange(len(codes)), [len(x) for x in codes])
            tfs = np.frombuffer(b"".join(table["tfs"].to_pylist()), np.int64)
            shard = Shard(table["n"].to_numpy(), owner, np.concatenate(codes).astype(np.int64), tfs, weights, documents, length)
            ids = table["doc_id"].to_pylist()
            for qid, terms, counts in asked:
                before = best.get(qid, [])
                docs, scores = shard.best(terms, counts, k, np.array([-x[0] for x in before], np.int64))
                if len(docs):
                    merged = before + [(-s, ids[d] is None, 0 if ids[d] is None else ids[d]) for d, s in zip(docs.tolist(), scores.tolist())]
                    best[qid] = sorted(merged, key=lambda x: x[:2] + ((x[2],) if not x[1] else ()))[:k]
        rows = [(q, -s, None if null else i) for q, found in best.items() for s, null, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], arrow_kind)], names=["qid", "score", "doc_id"])

    return postings.mapInArrow(run, f"qid long, score long, doc_id {kind.simpleString()}")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of ``docs(doc_id, text)`` for every row of ``items(item_id, text)``.

    Only scores above 0 count; equal scores rank by ascending doc_id, nulls last.  Repeated rows of ``docs`` are documents
    of their own; equal rows of ``items`` are one item, rows that share only their id are ranked one by one.  Null, empty
    and termless texts are found by nothing and find nothing.  An empty table on either side gives no row.  Other columns
    are ignored.
    """
    texts = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    order = F.md5(F.to_json(F.struct("item_id", "text")))
    placed = pin(weight_before(texts, [], order, F.octet_length("text") + 1, "qid").withColumn("block", F.floor(F.col("qid") / BLOCK_BYTES)))
    blocks = placed.agg(F.max("block")).first()[0]
    found = None
    for block in range(0 if blocks is None else blocks + 1):
        rows = placed.filter(F.col("block") == block).select("qid", "text").toArrow()  # at most BLOCK_BYTES and one item
        whole = strings(rows["text"].combine_chunks())
        codes, at, words = split_words(translated(whole, _TABLE))
        held = np.unique(codes)
        terms = words.take(pa.array(held))
        if not len(terms):
            continue
        codes = np.searchsorted(held, codes)
        asked = [(q, *np.unique(codes[a:b], return_counts=True)) for q, a, b in zip(rows["qid"].to_pylist(), at, at[1:]) if b > a]
        postings = pin(_postings(docs, terms))
        documents, length = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = _frequencies(postings, len(terms))
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        part = _search(postings, asked, weights, documents, length, k)
        part = pin(_first(_first(part.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), ["qid", "_salt"], k), ["qid"], k).select("qid", "rank", "doc_id", "score"))
        found = part if found is None else found.union(part)
    if found is None:
        return docs.join(items.select("item_id"), F.lit(False)).select("item_id", F.lit(1).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return placed.select("item_id", "qid").join(found, "qid").select("item_id", "rank", "doc_id", "score")
