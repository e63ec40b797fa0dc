import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelweave.llm import token_files as tf
from panelweave.session import fresh_path
from tests.llm.data import empty_docs, odd_docs, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("ids", [[], [5], [7] * 1001, list(range(100)) * 50, [1, 1, 2, 1, 1, 2, 1, 1] * 40])
def test_blocks_round_trip(ids):
    x = np.array(ids, np.uint32)
    b = tf.Block(tf.pack(x, np.array([len(x)]), 49408))
    assert (b.ids() == x).all() and len(b.symbols) <= max(1, len(x))
    for lo, hi in ((0, 3), (1, 2), (len(x) // 2, len(x)), (len(x), len(x) + 5)):
        assert b.ids(lo, hi).tolist() == ids[lo:hi]


def test_rules_shorten_repeats():
    x = np.tile(np.arange(40, dtype=np.uint32), 5000)
    data = tf.pack(x, np.array([len(x)]), 49408)
    assert len(data) < len(x) // 10 and (tf.Block(data).ids() == x).all()


def expected():
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in odd_rows()))
    out, start = [], 0
    for has, i, t in rows:
        raw = np.array([*LIBRARY.encode(t, add_special_tokens=False).ids, 2], "<u4")
        out.append((i if has else None, len(raw), zlib.crc32(raw.tobytes())))
        start += len(raw)
    return out, start


def test_odd_rows(spark):
    got = sorted(tf.token_digests(odd_docs(spark), PATH).collect(), key=lambda r: r.start)
    want, total = expected()
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, want))
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1]) and got[-1].start + got[-1].n_tokens == total
    assert tf.token_digests(empty_docs(spark), PATH).count() == 0


def test_many_blocks(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 40), x -> concat('word', pmod(x * id, 97)))) AS text")
    path = fresh_path(spark, "tokens")
    tf.write_tokens(docs.repartition(7), path, PATH)
    got = sorted(tf.read_tokens(spark, path).collect(), key=lambda r: r.doc_id)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])


def test_words_as_the_library_encodes_them():
    import pyarrow as pa

    texts = ["Hello, WORLD... it's ok!? e.g. x1 1x", "\u00c9t\u00e9. \u00c9T\u00c9! \u0130stanbul; a\u0301b. \u4e2d\u6587, \ufb01n\u00aa. stra\u00dfe: \u0391\u03a3. \u01c5 \u24d0.", "don't.we'll ... ? . ,;:", "a\u00a0b \u2003c. d\x1fe f\u0085g",
             "abc*** d&&& e's f'' g't. '' h<|endoftext|> <|endoftext|>. i<|endoftext|>*** <|startoftext|> j_k__ l<> m\u0338= n<\u0338", "RE\u00c7! \u00b5\u00ba \u0149a. \u017fs \u01c4. \u0130a# \u00ff\u00df\u00c5\u212b",
             "", "word" * 400 + ". .word word. WoRd", "naive na\u00efve. \U0001f600. \U0001d4d0b! \u0e01\u0e33. \u0915\u094d\u0937."]
    coder = tf.WordEncoder(PATH)
    for _ in range(2):
        ids, n = coder.encode(pa.array(texts), 2)
        at = np.concatenate([[0], np.cumsum(n)])
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*LIBRARY.encode(t, add_special_tokens=False).ids, 2]


def test_long_rules_and_all_symbols(monkeypatch):
    rng = np.random.default_rng(4)
    phrases = [rng.integers(0, 65_000, 700) for _ in range(40)]
    x = np.concatenate([phrases[i] for i in rng.integers(0, 40, 300)]).astype(np.uint32)
    b = tf.Block(tf.pack(x, np.array([len(x)]), 65_000))
    assert len(b.rules) == 536 and (b.ids() == x).all()
    b = tf.Block(tf.pack(np.tile(np.arange(1000, dtype=np.uint32), 50), np.array([50_000]), 2000))
    assert b.lengths.max() > 255 and (b.ids() == np.tile(np.arange(1000), 50)).all() and b.ids(700, 1300).tolist() == [*range(700, 1000), *range(300)]


def test_blocks_end_with_the_document_that_fills_them(spark, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_IDS", 500)
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', cast(pmod(id * 7, 60) AS int)) AS text")
    path = fresh_path(spark, "tokens")
    tf.write_tokens(docs, path, PATH)
    shards = {}
    for r in spark.read.parquet(path).orderBy("shard", "block").collect():
        shards.setdefault(r.shard, []).append(r)
    for blocks in shards.values():
        assert all(500 <= r.n_tokens < 500 + 60 for r in blocks[:-1]) and blocks[-1].n_tokens < 500 + 60
        assert [r.before for r in blocks] == [sum(x.n_tokens for x in blocks[:i]) for i in range(len(blocks))]
    got = sorted(tf.read_tokens(spark, path).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_tokens) for r in got] == [(i, i * 7 % 60 + 1) for i in range(400)]


def test_what_encoding_and_decoding_hold_beside_the_ids():
    import tracemalloc

    import pyarrow as pa

    coder = tf.WordEncoder(PATH)
    texts = pa.array([" ".join(f"unforeseeable{i % 50}x{i % 7}" for i in range(j, j + 500)) for j in range(500)])
    coder.encode(texts.slice(0, 2), 2)
    for once in (lambda: coder.encode(texts, 2)[0], lambda b=tf.Block(tf.pack(coder.encode(texts, 2)[0], np.array([1]), coder.size)): b.ids()):
        tracemalloc.start()
        ids = once()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(ids) > 1_500_000 and peak < 16 * len(ids)


@pytest.mark.parametrize("limit, value", [("KEEP_WORDS", 60), ("KEEP_BYTES", 300)])
def test_forgotten_words_are_encoded_again(monkeypatch, limit, value):
    import pyarrow as pa

    monkeypatch.setattr(tf, limit, value)
    coder = tf.WordEncoder(PATH)
    for lo in (0, 30, 60, 0, 90, 30):
        texts = [" ".join(f"w{'a' * (i % 5)}{i}. Common" for i in range(lo, lo + 45)), "", f"only{lo}"]
        ids, n = coder.encode(pa.array(texts), 2)
        at = np.concatenate([[0], np.cumsum(n)])
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(3)] == [[*LIBRARY.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert len(coder.known) < 110
