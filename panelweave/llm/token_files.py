"""Token files: ids of documents in id order, compressed by a grammar per block.

A shard is one range of document ids; it holds blocks of about a million ids.
In a block the most frequent neighbouring pairs are replaced by new symbols,
again and again, until none pays for its rule or all symbols are used (Re-Pair).
A block stores the rules, the number of ids each of them stands for, the remaining symbols and the
documents' ends, so any range of ids can be decoded by itself.  Blocks are
binary cells of Parquet files, which any Spark store can hold.
"""

from __future__ import annotations

import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from panelweave.llm.common import release, slices, split_words, strings
from panelweave.session import fresh_path, pin

BLOCK_IDS = 1 << 20
#: Words whose ids a worker remembers; beyond it the rarer ones are forgotten.
KEEP_WORDS = 900_000
#: Bytes of such words; beyond it they are forgotten likewise.
KEEP_BYTES = 32 << 20
#: Marks after a word that never join with its letters.
STOPS = string.punctuation
#: Letters below this one are letters to every version of the rules.
LATIN_END = "\u0250"
MAGIC = b"RPB2"
#: Symbols are stored in 16 bits; rules take what the vocabulary leaves.
SYMBOLS = 1 << 16
#: A rule takes five bytes and each place it replaces saves two, so rarer pairs would lengthen the block.
LEAST = 3
#: A round takes the pairs that are at least this part as frequent as the most frequent one.
NARROW = 8
_BUCKETS = 18
#: Ids that are copied at a time, so that their places stay small beside all ids.
COPIED = 1 << 18


class WordEncoder:
    """Ids of texts, word by word.

    The vocabulary's rules drop white space and never join across it, so the library encodes each distinct word once.  A
    word of letters with stops after it is two pieces to these rules, and the letters' case does not matter.  Pieces of
    letters only are one token group each, closed by a token that ends a word: many of them go to the library as one text,
    and their ids are told apart at those tokens.  All other words go to it one by one.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        # The same model without the splitting rules, which leave words of letters whole: for a-z, and for Latin letters.
        self.bare, self.latin = Tokenizer(self.library.model), Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.latin.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.library.get_vocab_size()
        self.closes = np.zeros(self.size, bool)
        for token, i in self.library.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([""], pa.string())
        self.first, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.hits = np.zeros(1 << 12, np.int64)  # blocks of texts that held the piece
        self.flat, self.used = np.zeros(1 << 14, np.uint16 if self.size <= SYMBOLS else np.uint32), 0

    def _forget(self) -> None:
        """Drop the pieces that only one block of texts held, and the rarer half beyond that."""
        words, hits = self.known, self.hits[: len(self.known)]
        keep = np.flatnonzero(hits > 1)
        keep = keep[np.argsort(-hits[keep], kind="stable")[: KEEP_WORDS // 2]]
        size = pc.binary_length(words).to_numpy(zero_copy_only=False)[keep]
        keep = np.sort(keep[np.cumsum(size, dtype=np.int64) <= KEEP_BYTES // 2])
        keep = keep[keep > 0]
        lengths, hits = self.length[keep], hits[keep] // 2
        ids = self.flat[_spread(self.first[keep], lengths)]
        self._clear()
        self._store(words.take(pa.array(keep)), ids, lengths)
        self.hits[1 : 1 + len(keep)] = hits

    def _store(self, pieces: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, at = len(pieces), len(self.known)
        while at + n > len(self.first):
            self.first, self.length = np.resize(self.first, 2 * len(self.first)), np.resize(self.length, 2 * len(self.length))
            self.hits = np.resize(self.hits, 2 * len(self.hits))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.first[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.length[at : at + n] = lengths
        self.hits[at : at + n] = 0
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known = pa.concat_arrays([self.known, pieces])

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not known yet."""
        letters = [p for p in pieces if p.isalpha()]
        plain = [p for p in letters if p.isascii()]
        other = [p for p in letters if not p.isascii() and unicodedata.normalize("NFC", p).lower().isalpha()]
        latin = [p for p in other if max(p) < LATIN_END]
        names: list[str] = []
        ids, lengths = [np.zeros(0, self.flat.dtype)], [np.zeros(0, np.int64)]
        for library, joined in ((self.bare, plain), (self.latin, latin), (self.library, [p for p in other if max(p) >= LATIN_END])):
            for lo in range(0, len(joined), 2000):
                part = joined[lo : lo + 2000]
                got = np.array(library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.flat.dtype)
                ends = np.flatnonzero(self.closes[got]) + 1
                if len(ends) == len(part):
                    names += part
                    ids.append(got), lengths.append(np.diff(ends, prepend=0))
        done = set(names)
        rest = [p for p in pieces if p not in done]
        for lo in range(0, len(rest), 2000):
            part = rest[lo : lo + 2000]
            each = [e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
            names += part
            ids.append(np.array([i for e in each for i in e], self.flat.dtype)), lengths.append(np.array([len(e) for e in each], np.int64))
        self._store(pa.array(names, pa.string()), np.concatenate(ids), np.concatenate(lengths))

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where each of the pieces, all different, is remembered; those not known yet are encoded first."""
        place = self._found(pieces, self.known)
        new = pieces.filter(pa.array(place < 0))
        if len(self.known) + len(new) > KEEP_WORDS or self._bytes(self.known) + self._bytes(new) > KEEP_BYTES:
            self._forget()
            place = self._found(pieces, self.known)
            new = pieces.filter(pa.array(place < 0))
        before = len(self.known)
        self._learn(new.to_pylist())
        place[place < 0] = before + self._found(new, self.known.slice(before))
        return place

    @staticmethod
    def _bytes(pieces: pa.Array) -> int:
        return pc.sum(pc.binary_length(pieces), min_count=0).as_py()

    @staticmethod
    def _found(pieces: pa.Array, among: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(pieces, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by ``end``, and the number of ids of each text."""
        codes, at, words = split_words(texts)
        head_of, heads, tail_of, tails = _parts(words)
        names = pa.concat_arrays([heads, tails]).dictionary_encode()
        place = self._places(names.dictionary)[names.indices.to_numpy(zero_copy_only=False)]
        pieces = np.empty(2 * len(words), np.int64)
        pieces[::2] = place[: len(heads)][head_of]
        pieces[1::2] = place[len(heads) :][tail_of]
        used = np.zeros(len(self.known), bool)
        used[pieces] = True
        self.hits[: len(used)] += used
        n = self.length[pieces]
        table = np.append(self.flat[_spread(self.first[pieces], n)], end).astype(self.flat.dtype)
        length = np.append(n[::2] + n[1::2], 1)
        first = np.cumsum(length) - length
        # The end id is one more word after each text.
        closed = np.insert(codes, at[1:], len(words))
        ids, word_ends = _gathered(table, first, length, closed)
        stops = word_ends[at[1:] + np.arange(1, len(at))]
        return ids, np.diff(np.concatenate([[0], stops]))


def _parts(words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """The two pieces of every word as places in a list of first and one of second pieces; the second is mostly empty."""
    heads = pc.ascii_rtrim(words, characters=STOPS)
    plain = pc.string_is_ascii(heads)
    letters = pc.and_(plain, pc.ascii_is_alpha(heads)).to_numpy(zero_copy_only=False).copy()
    other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    letters[other] = [h.isalpha() for h in heads.take(pa.array(other)).to_pylist()]
    first = pc.if_else(pa.array(letters), pc.if_else(plain, pc.ascii_lower(heads), heads), words).dictionary_encode()
    stops = np.where(letters, pc.subtract(pc.binary_length(words), pc.binary_length(heads)).to_numpy(zero_copy_only=False), 0)
    tails, seen, tail_of = [pa.array([""], pa.string())], 1, np.zeros(len(words), np.int64)
    for n in np.unique(stops[stops > 0]).tolist():  # stops are one byte each
        cut = np.flatnonzero(stops == n)
        ends = pc.utf8_slice_codeunits(words.take(pa.array(cut)), start=-n).dictionary_encode()
        tail_of[cut] = seen + ends.indices.to_numpy(zero_copy_only=False)
        tails.append(ends.dictionary)
        seen += len(ends.dictionary)
    return first.indices.to_numpy(zero_copy_only=False), first.dictionary, tail_of, pa.concat_arrays(tails)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of every run of n."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _gathered(table: np.ndarray, first: np.ndarray, length: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``table`` that the codes stand for, one after another, and where each begins (and the end)."""
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(length[codes], out=ends[1:])
    out = np.empty(int(ends[-1]), table.dtype)
    lo = 0
    while lo < len(codes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + COPIED, "right")) - 1)
        part = codes[lo:hi]
        out[ends[lo] : ends[hi]] = table[_spread(first[part], length[part])]
        lo = hi
    return out, ends


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def compress(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs of symbols, in order of their symbols from ``vocabulary`` on) and the remaining symbols.

    A round replaces, for all pairs not much rarer than the most frequent one, the leftmost of overlapping places first.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    used, shift = 0, np.uint32(32 - _BUCKETS)
    while len(seq) > 1 and used < SYMBOLS - vocabulary:
        code = seq[:-1] << np.uint32(16) | seq[1:]
        bucket = (code * np.uint32(2654435761) >> shift).astype(np.intp)
        heap = np.bincount(bucket, minlength=1 << _BUCKETS)
        least = max(LEAST, int(heap.max()) // NARROW)
        place = np.flatnonzero((heap >= least)[bucket])
        near = code[place]
        found, n = np.unique(near, return_counts=True)
        found, n = found[n >= least], n[n >= least]
        if not len(found):
            # Only buckets shared by several pairs were that full.
            if least == LEAST:
                break
            place, near = np.arange(len(code)), code
            found, n = np.unique(code, return_counts=True)
            least = max(LEAST, int(n.max()) // NARROW)
            found, n = found[n >= least], n[n >= least]
            if not len(found):
                break
        order = np.lexsort((found, -n))[: SYMBOLS - vocabulary - used]
        found = found[order]
        at = found * np.uint32(2654435761) >> shift
        _, first = np.unique(at, return_index=True)  # of pairs that share a bucket the most frequent
        first.sort()
        found, at = found[first], at[first]
        pair_of = np.zeros(1 << _BUCKETS, np.uint32)
        rule_of = np.full(1 << _BUCKETS, -1, np.int32)
        pair_of[at], rule_of[at] = found, np.arange(len(found))
        bucket = bucket[place]
        rule = rule_of[bucket]
        hit = np.flatnonzero((rule >= 0) & (pair_of[bucket] == near))
        hit, rule = place[hit], rule[hit]
        run = np.concatenate([[True], np.diff(hit) > 1])
        start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        first_of_two = (np.arange(len(hit)) - start) % 2 == 0
        hit = hit[first_of_two]
        seq[hit] = vocabulary + used + rule[first_of_two]
        stay = np.ones(len(seq), bool)
        stay[hit + 1] = False
        seq = seq[stay]
        rules.append(found)
        used += len(found)
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint32)
    return np.stack([flat >> np.uint32(16), flat & np.uint32(0xFFFF)], axis=1), seq


def rule_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Number of ids each rule stands for."""
    out = np.ones(vocabulary + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[vocabulary + i] = out[a] + out[b]
    return out[vocabulary:]


def pack(ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> bytes:
    """One block."""
    if vocabulary > SYMBOLS or (len(ids) and int(ids.max()) >= vocabulary):
        raise ValueError("ids must lie below the vocabulary's size, which must fit 16 bits")
    rules, seq = compress(ids, vocabulary)
    lengths = rule_lengths(rules, vocabulary)
    head = struct.pack("<4sIIQQ", MAGIC, vocabulary, len(rules), len(seq), len(counts))
    long = lengths[lengths > 255]
    return head + rules.astype("<u2").tobytes() + np.where(lengths > 255, 0, lengths).astype("u1").tobytes() + long.astype("<u4").tobytes() + np.cumsum(counts).astype("<u8").tobytes() + seq.astype("<u2").tobytes()


class Block:
    """Reads a packed block."""

    def __init__(self, data: bytes):
        magic, self.vocabulary, n_rules, n_seq, n_docs = struct.unpack_from("<4sIIQQ", data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = struct.calcsize("<4sIIQQ")
        self.rules = np.frombuffer(data, "<u2", 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
        at += 4 * n_rules
        # One byte a rule; 0 refers to the next of the longer ones, which follow in four bytes each.
        lengths = np.frombuffer(data, "u1", n_rules, at).astype(np.int64)
        at += n_rules
        long = lengths == 0
        lengths[long] = np.frombuffer(data, "<u4", int(long.sum()), at)
        at += 4 * int(long.sum())
        self.lengths = np.concatenate([np.ones(self.vocabulary, np.int64), lengths])
        self.ends = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
        self.symbols = np.frombuffer(data, "<u2", n_seq, at + 8 * n_docs)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self._texts: np.ndarray | None = None
        self._places: np.ndarray | None = None

    def _spelled(self) -> np.ndarray:
        """The ids of every symbol, one after another."""
        if self._texts is None:
            out = np.empty(int(self.first[-1]), np.uint32)
            out[: self.vocabulary] = np.arange(self.vocabulary)
            first, size = self.first.tolist(), self.lengths.tolist()
            for i, (a, b) in enumerate(self.rules.tolist(), self.vocabulary):
                to = first[i]
                out[to : to + size[a]] = out[first[a] : first[a] + size[a]]
                out[to + size[a] : to + size[i]] = out[first[b] : first[b] + size[b]]
            self._texts = out
        return self._texts

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from ``start`` to before ``stop``, decoding only the symbols that cover them."""
        if self._places is None:
            self._places = np.concatenate([[0], np.cumsum(self.lengths[self.symbols])])
        stop = int(self._places[-1]) if stop is None else min(stop, int(self._places[-1]))
        if stop <= start:
            return np.zeros(0, np.uint32)
        lo, hi = int(np.searchsorted(self._places, start, "right")) - 1, int(np.searchsorted(self._places, stop, "left"))
        ids, _ = _gathered(self._spelled(), self.first, self.lengths, self.symbols[lo:hi])
        return ids[start - int(self._places[lo]) : stop - int(self._places[lo])]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = 2) -> None:
    """Write the ids of ``docs(doc_id, text)`` below ``path`` in ascending id order, null ids first.

    Null texts are empty: their ids are just the end id.  Rows with equal ids stand in the order of a hash of their texts;
    equal rows are stored each.  Other columns are ignored.  Ties spread over shards, so that no id is a hot one.  A shard
    is cut into blocks; a block holds whole documents and ends with the one that brings it to ``BLOCK_IDS``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        coder, shard, block, before = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        ids, counts, owners, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held
            all_ids, n = np.concatenate(ids), np.concatenate(counts)
            keys = pa.concat_arrays(owners)
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([len(all_ids)], pa.int64()),
                 pa.array([keys.to_pylist()], pa.list_(pa.int64())), pa.array([pack(all_ids, n, coder.size)], pa.binary())],
                names=["shard", "block", "before", "n_tokens", "doc_ids", "payload"],
            )
            block, before, held = block + 1, before + len(all_ids), 0
            ids.clear(), counts.clear(), owners.clear()
            return row

        for batch in batches:
            texts = strings(batch.column(1))
            for lo, hi in slices(texts):
                got, n = coder.encode(texts.slice(lo, hi - lo), end)
                ends = np.concatenate([[0], np.cumsum(n)])
                a = 0
                while a < len(n):
                    b = min(len(n), int(np.searchsorted(ends, ends[a] + BLOCK_IDS - held)))
                    ids.append(got[ends[a] : ends[b]]), counts.append(n[a:b]), owners.append(batch.column(0).slice(lo + a, b - a))
                    held += int(ends[b] - ends[a])
                    if held >= BLOCK_IDS:
                        yield flush()
                    a = b
                release()
        if held:
            yield flush()
        release()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("tie")]
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    placed.mapInArrow(run, "shard int, block int, before long, n_tokens long, doc_ids array<long>, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of the files, decoded block by block."""
    blocks = spark.read.parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    # One row per shard: as many as the files have parts.
    starts = pin(shards.select(F.col("shard").alias("_shard"), (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_start")))
    slim = blocks.join(starts, F.col("shard") == F.col("_shard")).select((F.col("_start") + F.col("before")).alias("start"), "doc_ids", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch.column(2)[i].as_py())
                raw = b.ids().astype("<u4")
                ends = b.ends.tolist()
                begins = [0, *ends[:-1]]
                crc = [zlib.crc32(raw[lo:hi]) for lo, hi in zip(begins, ends)]
                first = np.array(begins, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, 1).flatten(), pa.array(first + batch.column(0)[i].as_py()), pa.array(b.ends - first), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )
        release()

    return slim.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, vocabulary: str, end: int = 2) -> DataFrame:
    """Write the token files to the shared folder and read them back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end)
    return read_tokens(docs.sparkSession, path)
