import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from panelweave.llm import token_counts as tc
from tests.llm.data import empty_docs, odd_docs, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plain(texts):
    return [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_against_the_library():
    rng = random.Random(2)
    texts = ["", " ", "\n\n x", "don't we'll I'd 're 'x ''s", "a<|endoftext|>b <|endoftext|>", "aaaa" * 30, "x'", "'re", " \n a", "0123456789" * 5]
    texts += ["".join(rng.choice("ab'stre ll\n\t.d1\u00e9\u3000v-") for _ in range(rng.randint(0, 70))) for _ in range(1500)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 126), rng.randint(0xA0, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(25)) for _ in range(300)]
    assert tc.machine(PATH).text_counts(texts).tolist() == plain(texts)


def test_scan_of_chunks():
    """Chunk maps give the same pieces as one run from the start."""
    points = np.frombuffer(("it's  a\n\n test'll 12 " * 200).encode("utf-32-le"), np.uint32)
    reset = np.zeros(len(points), bool)
    symbols, state, want = tc._symbols(points, reset), tc.FRESH, []
    for i, s in enumerate(symbols.tolist()):
        if tc._MARK[s * 8 + state]:
            want.append(i)
        state = tc._GO[s * 8 + state]
    assert tc.piece_starts(points, reset).tolist() == want


def test_odd_rows(spark):
    out = tc.token_counts(odd_docs(spark), PATH, limit=20).collect()
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), n, n > 20) for r, n in zip(odd_rows(), plain([r[1] for r in odd_rows()])))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == want
    assert tc.token_counts(empty_docs(spark), PATH).count() == 0
