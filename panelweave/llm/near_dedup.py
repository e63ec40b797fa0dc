"""Near duplicates by bottom-k sketches of one hash function.

1. A text's set is its distinct five-word shingles, hashed to 64 bits.  Texts
   with equal sets form a class; from here on classes are compared.
2. A class's sketch is its ``K`` smallest hashes.  Inverted lists map retained
   values to classes.  A list belongs to three values that follow each other in
   a sketch: similar sets agree on long stretches, and a passage that many texts
   share rarely fills a stretch of otherwise different sets.
3. First every class is held against one member of its lists, the one it shares
   most lists with, so that a group of n copies costs n comparisons.  Components
   of the confirmed links are found.  Then only pairs of different components
   are left in the lists.
4. Lists beyond ``LIST_PAIRS`` members that still mix components are replaced, for
   the classes that meet mainly there, by lists of their rarest shingles: sets
   with similarity s share one of their ``(1 - s) n + 1`` rarest.  Classes that
   meet even there in long lists form groups; a group is compared in blocks of
   bounded size on full sets, and a block returns only what joins components.
5. The sketch of a pair's union estimates the similarity; pairs far below the
   threshold go.  The others are confirmed on their full sets.

A pair at exactly 0.75 misses every list with a probability of 1.5e-8 (64 places); pairs of
sets up to ``K`` shingles always meet.  Links are only sought where they can join
two components; what is returned are the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.ranks import weight_before
from panelweave.llm.common import mixed, shingles, slices, strings
from panelweave.session import pin

WIDTH = 5
PERCENT = 75
K, RUN = 64, 3
#: Sets so small that a run of three need not exist also list their single values.
SMALL_SET = 8
#: The union's sketch of a linked pair shows at least this similarity (more than five standard deviations below 0.75).
LEAST_ESTIMATE = 0.45
LIST_PAIRS = 128
#: Linked sets beyond ``K`` shingles share fewer stretches than this with a probability below 2e-7 (64 places, each shared
#: with odds of 0.75); smaller ones may share a single list by construction and are never left out.
LEAST_SHARED = 2
#: Classes in one block of a group, values looked at together there, shingles of a block (a larger set is alone), and
#: shingles of two blocks sorted at a time.
BLOCK, BLOCK_VALUES, BLOCK_SHINGLES, SORTED = 256, 4096, 2_000_000, 1 << 20
#: A filter of keys has at most this many 64-bit words (16 MiB), with ``KEYS_A_WORD`` keys or fewer in each on average.
FILTER_WORDS, KEYS_A_WORD = 1 << 21, 6
#: Pairs of one class that meet one copy of its text.
HEAD_PAIRS = 256


def row_key(doc_id: Column, text: Column) -> Column:
    """A digest of id and text."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))))


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in slices(texts):
        flat, at = shingles(texts.slice(lo, hi - lo), WIDTH)
        for i in range(hi - lo):
            yield np.unique(flat[at[i] : at[i + 1]])


def sketch_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, key, cls, n, sketch`` for every row; ``cls`` is null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, sketch = [], [], []
            for s in _sets(strings(batch.column(2))):
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketch.append(s[:K].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(sketch, pa.binary())],
                names=["doc_id", "key", "cls", "n", "sketch"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, key binary, cls binary, n long, sketch binary")


def _list_rows(classes: DataFrame) -> DataFrame:
    """``list, nid``: the inverted lists' entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nids, sizes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            keys, owners = [], []
            for nid, n, raw in zip(nids.tolist(), sizes.tolist(), batch.column(2).to_pylist()):
                v = np.frombuffer(raw, np.uint64)
                runs = mixed(v[:-2] * np.uint64(3) + mixed(v[1:-1]) * np.uint64(5) + v[2:] * np.uint64(7)) if len(v) >= RUN else v[:0]
                got = np.concatenate([runs, v]) if n <= SMALL_SET else runs
                keys.append(got)
                owners.append(np.full(len(got), nid, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["list", "nid"])

    return classes.select("nid", "n", "sketch").mapInArrow(run, "list long, nid long")


def _can_link(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def union_estimates(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of pairs as the sketches of their unions show it; exact if both sketches are whole sets."""
    m = len(a)
    both = np.empty((m, 2 * K), np.uint64)
    for at, raws in ((0, a), (K, b)):
        for i, raw in enumerate(raws):
            v = np.frombuffer(raw, np.uint64)
            both[i, at : at + len(v)] = v
            both[i, at + len(v) : at + K] = np.uint64(0xFFFFFFFFFFFFFFFF)
    real = np.minimum(na, K) + np.minimum(nb, K)
    both.sort(axis=1)
    inside = np.arange(2 * K) < real[:, None]
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & inside[:, 1:]
    place = np.cumsum(inside & ~again, axis=1)
    known = np.where((na > K) | (nb > K), K, 2 * K)[:, None]
    shared = (again & (place <= known)).sum(axis=1)
    union = np.minimum(place[:, -1], known[:, 0])
    return shared / np.maximum(union, 1)


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose sizes and sketches do not rule a link out."""
    slim = classes.select("nid", "n", "sketch")
    left = slim.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = slim.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                na, nb = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
                shown = union_estimates(part.column(3).to_pylist(), part.column(5).to_pylist(), na, nb)
                # Small sets are their own sketches: what they show is exact.
                keep = shown >= np.where((na <= K) & (nb <= K), PERCENT / 100 - 1e-9, LEAST_ESTIMATE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(left, "a").join(right, "b").filter(_can_link("na", "nb"))
    return joined.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def _key_filter(wanted: DataFrame) -> np.ndarray | None:
    """Words of bits that show which rows cannot be ``wanted(key)``; None where they would exceed ``FILTER_WORDS``.

    A hash of the key picks a word by its low bits and four bits of it by its high ones.
    """
    n = wanted.count()
    size = 1 << max(0, (-(-n // KEYS_A_WORD) - 1).bit_length()) if n else 1
    if size > FILTER_WORDS:
        return None
    h = F.xxhash64("key")
    mask = F.lit(0).cast("long")
    for at in (40, 46, 52, 58):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h, {at}) & 63 as int))"))
    words = wanted.select(h.alias("_h")).groupBy(F.col("_h").bitwiseAND(F.lit(size - 1)).alias("word")).agg(F.bit_or(mask).alias("bits")).toPandas()
    bits = np.zeros(size, np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _maybe_wanted(bits: np.ndarray):
    """A condition on the key's hash that holds for every wanted key and for few others."""

    @F.pandas_udf("boolean")
    def run(hashes: pd.Series) -> pd.Series:
        h = hashes.to_numpy(np.int64).view(np.uint64)
        mask = np.zeros(len(h), np.uint64)
        for at in (40, 46, 52, 58):
            mask |= np.uint64(1) << (h >> np.uint64(at) & np.uint64(63))
        return pd.Series(bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] & mask == mask)

    return run


def _texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``nid, text``: one text for each of ``nodes(nid)``.

    Texts that cannot be wanted go where they are read, so that only the others are shuffled, equal rows once a task.  For
    more keys than a filter of bounded size tells apart, all texts are shuffled to the keys; the result is the same.
    """
    wanted = pin(classes.join(nodes, "nid", "left_semi").select("nid", "key"))
    texts = docs.select(row_key(F.col("doc_id"), F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    bits = _key_filter(wanted)
    if bits is not None:
        texts = texts.filter(_maybe_wanted(bits)(F.xxhash64("key")))
    return texts.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key").select("nid", "text")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            last_a = last_set = None
            for lo, hi in slices(batch.column(2), 2 << 20):
                first = batch.column(2).slice(lo, hi - lo).to_pylist()
                for i, (ta, sb) in enumerate(zip(first, _sets(strings(batch.column(3).slice(lo, hi - lo))))):
                    if ta != last_a:
                        last_a, last_set = ta, next(_sets(pa.array([ta], pa.string())))
                    union = len(last_set) + len(sb)
                    shared = union - len(np.unique(np.concatenate([last_set, sb])))
                    keep[lo + i] = 100 * shared >= PERCENT * (union - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
    texts = pin(_texts_of(nodes, classes, docs))
    # A class of many pairs has its text copied, so that no task gets all of them.
    copies = pin(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HEAD_PAIRS).cast("int").alias("_copies")))
    dealt = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), "_copies").cast("int").alias("_copy"))
    heads = texts.join(copies, F.col("nid") == F.col("a")).select("a", F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"))
    both = dealt.join(texts.select(F.col("nid").alias("b"), F.col("text").alias("tb")), "b").join(heads, ["a", "_copy"])
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``nid, comp``: the smallest node reachable, for every node of ``edges(a, b)``.

    Labels spread to neighbours and then jump to their label's label until nothing changes; every round is a written table.
    """
    both = pin(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = pin(both.groupBy(F.col("a").alias("nid")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("nid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("nid")).agg(F.min("comp").alias("_near"))
        spread = pin(labels.join(near, "nid").select("nid", F.col("comp").alias("_was"), F.least("comp", "_near").alias("comp")))
        jump = spread.select(F.col("nid").alias("comp"), F.col("comp").alias("_up"))
        labels = pin(spread.join(jump, "comp").select("nid", F.least("comp", "_up").alias("comp"), "_was"))
        changed = labels.filter("comp <> _was").limit(1).count()
        labels = labels.drop("_was")
        if not changed:
            return labels


def _with_comp(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))


def _pairs_in(lists: DataFrame) -> DataFrame:
    """Pairs of different components within lists, but for pairs within a group.

    ``lists`` has ``list, nid, comp, n, group``; the group is null where a class is in none.
    """
    left = lists.select("list", F.col("nid").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("group").alias("ga"))
    right = lists.select("list", F.col("nid").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("group").alias("gb"))
    apart = ~F.coalesce(F.col("ga") == F.col("gb"), F.lit(False))
    near = left.join(right, "list").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _can_link("na", "nb") & apart)
    return near.select("a", "b").distinct()


def _mixed_lists(lists: DataFrame) -> DataFrame:
    """The entries of lists that hold more than one component, with the number of entries ``size``."""
    lists = lists.repartition("list")  # shuffled once for both uses
    kinds = lists.groupBy("list").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("size")).filter("_lo < _hi")
    return lists.join(kinds.select("list", "size"), "list")


def _rarest_lists(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``list, nid`` of the rarest shingles of each of ``nodes(nid)``: as many as a linked set must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nid, s in zip(batch.column(0).to_pylist(), _sets(strings(batch.column(1)))):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), nid, np.int64)), pa.array(np.full(len(s), len(s), np.int64))], names=["list", "nid", "n"])

    entries = pin(_texts_of(nodes, classes, docs).select("nid", "text").mapInArrow(run, "list long, nid long, n long"))
    held = pin(entries.groupBy("list").agg(F.count(F.lit(1)).alias("_df"), F.min("nid").alias("_only")))
    ranked = entries.join(held.filter("_df > 1").select("list", "_df"), "list")
    # Shingles of one set only can't be shared; they still take their places among the rarest.
    alone = held.filter("_df = 1").groupBy(F.col("_only").alias("nid")).agg(F.count(F.lit(1)).alias("_alone"))
    place = F.row_number().over(Window.partitionBy("nid").orderBy("_df", "list")) + F.coalesce("_alone", F.lit(0))
    return ranked.join(alone, "nid", "left").withColumn("_place", place).filter(F.col("_place") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).select("list", "nid")


def _block_links(groups: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``a, b`` between components within ``groups(nid, group)``.

    Classes are dealt to bands of size, so that only a band and its neighbour can hold linked sets, and bands to blocks.
    Every pair of blocks is one task's work on full sets.
    """
    members = _with_comp(groups.join(classes.select("nid", "n"), "nid"), comps)
    members = members.withColumn("_band", F.floor(F.log("n") / float(np.log(100 / PERCENT))).cast("int"))
    members = pin(_in_blocks(members))
    sizes = members.groupBy("group", "_band").agg((F.max("_i") + 1).alias("_blocks"))
    sizes = pin(sizes.select(F.col("group").alias("_g"), F.col("_band").alias("_b"), "_blocks"))
    near = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), (F.col("_band") + d).alias("b")) for d in (-1, 0, 1)]))
    own = members.join(sizes, (F.col("group") == F.col("_g")) & (F.col("_band") == F.col("_b")))
    own = own.select("nid", "group", "comp", "_band", "_i", near.alias("_near"))
    dealt = own.join(sizes, (F.col("group") == F.col("_g")) & (F.col("_near.b") == F.col("_b"))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    lower = (F.col("_near.d") == 1) | ((F.col("_near.d") == 0) & (F.col("_i") <= F.col("_j")))
    side = F.struct(F.col("_band").alias("b"), F.col("_i").alias("i"))
    other = F.struct(F.col("_near.b").alias("b"), F.col("_j").alias("i"))
    keyed = dealt.select("nid", "comp", "group", F.when(lower, side).otherwise(other).alias("_lo"), F.when(lower, other).otherwise(side).alias("_hi"), side.alias("_own"))
    keyed = keyed.select("nid", "comp", F.to_json(F.struct("group", "_lo", "_hi")).alias("task"), (F.col("_own") == F.col("_lo")).alias("low"), (F.col("_own") == F.col("_hi")).alias("high"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                found = pa.array([s.tobytes() for s in _sets(strings(batch.column(1).slice(lo, hi - lo)))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), found], names=["nid", "set"])

    whole = pin(_texts_of(groups.select("nid"), classes, docs).select("nid", "text").mapInArrow(sets, "nid long, set binary"))
    return keyed.join(whole, "nid").groupBy("task").applyInArrow(_compare_blocks, "a long, b long")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Adds the block ``_i`` to ``members(group, _band, nid, n)``: at most ``BLOCK`` classes, and ``BLOCK_SHINGLES`` but for its last set."""
    weight = F.greatest(F.col("n"), F.lit(-(-BLOCK_SHINGLES // BLOCK)))
    placed = weight_before(members, ["group", "_band"], F.col("nid"), weight, "_before")
    return placed.withColumn("_i", F.floor(F.col("_before") / BLOCK_SHINGLES).cast("int")).drop("_before")


def _compare_blocks(rows: pa.Table) -> pa.Table:
    """Links of different components between the two blocks, as many as it takes to join them."""
    nid, comp = rows["nid"].to_numpy(), rows["comp"].to_numpy()
    low, high = np.flatnonzero(rows["low"].to_numpy()), np.flatnonzero(rows["high"].to_numpy())
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["set"]]  # not copied
    size = np.array([len(x) for x in sets], np.int64)
    shared = np.zeros((len(low), len(high)), np.float32)
    # Hashes are even, so that equal ranges of values hold about as many.
    parts = 1 + int(size.sum()) // SORTED
    edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in sets]
    for k in range(parts):
        _add_shared(shared, [x[c[k] : c[k + 1]] for x, c in zip(sets, cuts)], low, high)
    shared = shared.astype(np.float64)
    linked = (100 * shared >= PERCENT * (size[low][:, None] + size[high][None, :] - shared)) & (comp[low][:, None] != comp[high][None, :])
    i, j = np.nonzero(linked)
    i, j = low[i], high[j]
    pairs = np.stack([np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])], axis=1)
    first = np.unique(pairs, axis=0, return_index=True)[1] if len(pairs) else np.zeros(0, np.int64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in first.tolist():
        x, y = root(int(comp[i[k]])), root(int(comp[j[k]]))
        if x != y:
            parent[x] = y
            out.append(k)
    return pa.table({"a": pa.array(nid[i[out]], pa.int64()), "b": pa.array(nid[j[out]], pa.int64())})


def _add_shared(shared: np.ndarray, sets: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> None:
    """Adds the numbers of common values of the sets ``low`` and ``high``."""
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, kept = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), count[code] > 1
    place = np.cumsum(count > 1) - 1
    code, owner = place[code[kept]], owner[kept]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for lo in range(0, int((count > 1).sum()), BLOCK_VALUES):
        a, b = np.searchsorted(code, [lo, lo + BLOCK_VALUES])
        has = np.zeros((len(sets), BLOCK_VALUES), np.float32)
        has[owner[a:b], code[a:b] - lo] = 1
        shared += has[low] @ has[high].T


def _linked_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``nid, comp`` of every class that is linked to another."""
    entries = _list_rows(classes).repartition("list")  # shuffled once for both uses
    heads = entries.groupBy("list").agg(F.min("nid").alias("head"), F.count(F.lit(1)).alias("_size")).filter("_size > 1").drop("_size")
    lists = pin(entries.join(heads, "list"))
    # One comparison per class: the list head it shares most lists with.
    shared = lists.filter("nid <> head").groupBy("head", "nid").agg(F.count(F.lit(1)).alias("_n"))
    star = shared.groupBy(F.col("nid").alias("b")).agg(F.max_by("head", F.struct("_n", -F.col("head"))).alias("a")).select("a", "b")
    tested = pin(_promising(star, classes))
    links = pin(_confirmed(tested, classes, docs))
    comps = components(links)

    sized = lists.select("list", "nid").join(classes.select("nid", "n"), "nid")
    rest = pin(_mixed_lists(_with_comp(sized, comps)))
    short = rest.filter(F.col("size") <= LIST_PAIRS).drop("size")
    hot = rest.filter(F.col("size") > LIST_PAIRS).groupBy("nid").agg(F.count(F.lit(1)).alias("_n"), F.first("n").alias("n"))
    hot = hot.filter((F.col("n") <= K) | (F.col("_n") >= LEAST_SHARED)).select("nid")
    hot = pin(hot)
    by_blocks = None
    if hot.limit(1).count():
        rare = pin(_mixed_lists(_with_comp(_rarest_lists(hot, classes, docs).join(classes.select("nid", "n"), "nid"), comps)))
        long = rare.filter(F.col("size") > LIST_PAIRS)
        heads = long.groupBy("list").agg(F.min("nid").alias("a"))
        groups = components(pin(long.select("list", F.col("nid").alias("b")).join(heads, "list").select("a", "b").distinct())).withColumnRenamed("comp", "group")
        by_blocks = pin(_block_links(groups, comps, classes, docs))
        # What the blocks compare needs no pair.
        few = rare.filter(F.col("size") <= LIST_PAIRS).drop("size")
        pairs = _pairs_in(short.join(groups, "nid", "left")).union(_pairs_in(few.join(groups, "nid", "left"))).distinct()
    else:
        pairs = _pairs_in(short.withColumn("group", F.lit(None).cast("long")))
    fresh = pin(_promising(pairs.join(tested, ["a", "b"], "left_anti"), classes))
    more = _confirmed(fresh, classes, docs)
    more = pin(more if by_blocks is None else more.union(by_blocks))
    # The new links join components; those are few and small against the classes.
    a = _with_comp(more.select(F.col("a").alias("nid"), "b"), comps).select(F.col("comp").alias("ca"), F.col("b").alias("nid"))
    joined = _with_comp(a, comps).select(F.col("ca").alias("a"), F.col("comp").alias("b")).filter("a <> b").distinct()
    upper = components(pin(joined)).select(F.col("nid").alias("comp"), F.col("comp").alias("_top"))
    every = comps.union(more.select(F.explode(F.array("a", "b")).alias("nid"), F.lit(None).cast("long").alias("comp")).select("nid", F.coalesce("comp", "nid").alias("comp")).distinct().join(comps, "nid", "left_anti"))
    return every.join(upper, "comp", "left").select("nid", F.coalesce("_top", "comp").alias("comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, key`` for every row of ``docs(doc_id, text)``.

    Linked are texts whose shingle sets have ``100 * intersection >= 75 * union``; a component's id is its smallest doc_id.
    Texts with fewer than five words are one shingle; null and empty texts and those without words have none and are
    linked with nothing.  Equal rows and equal sets are one class.  A null id never is the smallest; a component of null
    ids only has the id null and its rows count as kept.  Other columns are ignored.
    """
    base = pin(sketch_rows(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "key"))
    classes = pin(
        base.filter("cls is not null").groupBy("cls").agg(first.alias("_first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .select(F.monotonically_increasing_id().alias("nid"), "cls", F.col("_first.doc_id").alias("label"), F.col("_first.key").alias("key"), "n", "sketch")
    )
    linked = pin(_linked_classes(classes, docs))
    of_class = _with_comp(classes.select("nid", "cls", "label"), linked)
    smallest = of_class.groupBy("comp").agg(F.min("label").alias("component"))
    named = of_class.join(smallest, "comp").select("cls", "component")
    rows = base.select("doc_id", "key", "cls", "n").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "key")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, one per component: that of the smallest id, equal rows once.

    Rows without words are kept, equal ones once.
    """
    judged = near_duplicates(docs).filter("kept")
    group = F.when(F.col("n_shingles") > 0, F.col("component_id").cast("string")).otherwise(F.hex("key"))
    group = F.when((F.col("n_shingles") > 0) & F.col("component_id").isNull(), F.hex("key")).otherwise(group)
    own = "_key"
    while own in docs.columns:
        own += "_"
    keys = judged.groupBy(group.alias("_g")).agg(F.min("key").alias(own)).select(own)
    marked = docs.withColumn(own, row_key(F.col("doc_id"), F.col("text").cast("string")))
    return marked.join(pin(keys), own, "left_semi").dropDuplicates([own]).drop(own)
