"""Token counts of a byte-level BPE from compiled deterministic transducers.

Two transducers run one after the other.

*Split.*  The pre-tokenizer is a machine with eight states over ten symbol
classes (a class also tells what the next characters are, as far as the rules
look ahead).  A transition is annotated with whether a piece starts.  Texts are
laid end to end and cut into chunks; each chunk's map from entry state to exit
state is found for all states at once, an associative scan composes the maps,
and the chunks are then run once from their now known entry states.

*Count.*  Within a piece a second machine reads bytes.  Its state is all that
can still matter: for every suffix of the bytes read that begins some token,
the last token of the encoding before that suffix.  A transition is annotated
with the change of the token count, which may be negative when a merge swallows
earlier tokens.  A token may end at a position only if it and the last token
before it do not merge otherwise; the pairs are tested with the merge rules
themselves.  States are compiled when first reached and kept while a worker
lives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import slices, strings

LETTER, DIGIT, OTHER, QUOTE2, QUOTE3, SPACE_RUN, LAST_BLANK, LAST_SPACE, RESET = range(9)
FRESH, IN_LETTER, IN_DIGIT, IN_OTHER, IN_SPACE, JOIN, ONE_MORE, TWO_MORE = range(8)
#: The endings that an apostrophe keeps with it, by length.
ENDINGS_1, ENDINGS_2 = "stmd", ["re", "ve", "ll"]
CHUNK = 512
#: States, pairs and pieces kept by a worker; beyond it the table is started afresh.
KEEP = 300_000
_NEVER = 1 << 60
_RUN_OF = {LETTER: IN_LETTER, DIGIT: IN_DIGIT, OTHER: IN_OTHER}


def _split_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start mark, by symbol * 8 + state."""
    go, mark = np.zeros((9, 8), np.uint8), np.zeros((9, 8), bool)
    for symbol in range(9):
        for state in range(8):
            if symbol == RESET:
                go[symbol, state] = FRESH
                continue
            if state in (ONE_MORE, TWO_MORE):  # inside an apostrophe's ending
                go[symbol, state] = FRESH if state == ONE_MORE else ONE_MORE
                continue
            plain = OTHER if symbol in (QUOTE2, QUOTE3) else symbol
            if plain in _RUN_OF:
                joins = state in (JOIN, _RUN_OF[plain])
                mark[symbol, state] = not joins
                go[symbol, state] = _RUN_OF[plain] if joins or symbol == plain else ONE_MORE if symbol == QUOTE2 else TWO_MORE
            elif symbol == SPACE_RUN:
                mark[symbol, state], go[symbol, state] = state != IN_SPACE, IN_SPACE
            else:
                mark[symbol, state], go[symbol, state] = True, JOIN if symbol == LAST_SPACE else FRESH
    return go.ravel(), mark.ravel()


_GO, _MARK = _split_machine()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Letter, digit, white space or other for every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = DIGIT
    #: Code points of the property White_Space.
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE_RUN
    return out


def _symbols(points: np.ndarray, reset: np.ndarray) -> np.ndarray:
    out = _classes()[points]
    out[reset] = RESET
    space = out == SPACE_RUN
    text_next = np.zeros(len(out), bool)
    text_next[:-1] = ~space[1:] & ~reset[1:]
    out[space & text_next] = LAST_BLANK
    out[space & text_next & (points == 32)] = LAST_SPACE
    q = np.flatnonzero((points == ord("'")) & ~reset)
    q = q[q + 1 < len(out)]
    if len(q):
        a = points[q + 1]
        b = points[np.minimum(q + 2, len(out) - 1)]
        out[q[np.isin(a, [ord(c) for c in ENDINGS_1]) & ~reset[q + 1]]] = QUOTE2
        pair = np.zeros(len(q), bool)
        for e in ENDINGS_2:
            pair |= (a == ord(e[0])) & (b == ord(e[1]))
        out[q[pair & (q + 2 < len(out)) & ~reset[q + 1] & ~reset[np.minimum(q + 2, len(out) - 1)]]] = QUOTE3
    return out


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of state maps (rows: chunks) under composition, in log2 steps."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        # row i: first what came before, then itself
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return maps


def piece_starts(points: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """Where pieces start in texts laid end to end; ``reset`` marks the separators between texts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    symbols = np.full(-(-n // CHUNK) * CHUNK, RESET, np.uint8)
    symbols[:n] = _symbols(points, reset)
    by_step = np.ascontiguousarray(symbols.reshape(-1, CHUNK).T).astype(np.intp) * 8
    state = np.tile(np.arange(8, dtype=np.uint8)[:, None], (1, by_step.shape[1]))
    for row in by_step:  # all entry states of all chunks at once, until no chunk still tells them apart
        state = _GO[row + state]
    scanned = compose_scan(state.T)
    now = np.full(by_step.shape[1], FRESH, np.uint8)
    now[1:] = scanned[:-1, FRESH]
    marks = np.empty(by_step.shape, bool)
    for i, row in enumerate(by_step):
        at = row + now
        marks[i] = _MARK[at]
        now = _GO[at]
    return np.flatnonzero(marks.T.ravel()[:n])


class CountMachine:
    """The byte transducer of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The vocabulary writes the 94 + 12 + 82 bytes that print as themselves, the others as code points from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
        self.ids = {b: i for i, b in self.bytes_of.items()}
        vocab = spec["model"]["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> its two parts and their merge's rank
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[vocab[a], vocab[b]] = r
            self.made.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.prefixes = {b[:k] for b in self.ids for k in range(1, len(b))}
        self.counts: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        #: Per state: for each suffix that a token could still cover, longest first, its length, the last token before it
        #: and the token count there less the count at the end.
        self.states: list[tuple] = [((0, None, 0),)]
        self.suffix: list[bytes] = [b""]
        self.index: dict[tuple, int] = {(b"", self.states[0]): 0}
        self.moves: dict[int, int] = {}  # state and byte -> next state and change of the count
        self.pairs: dict[tuple[int, int], bool] = {}

    def _fits(self, before: int | None, token: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two.

        Only the last parts of the first and the first parts of the second can meet.  They grow in the order of their
        merges' ranks; the two stay apart if at no time their current neighbours merge first.
        """
        if before is None:
            return True
        key = (before, token)
        found = self.pairs.get(key)
        if found is None:
            left, right = self.spine(before, 1), self.spine(token, 0)
            i, j, found = len(left) - 1, len(right) - 1, True
            while True:
                across = self.rank.get((left[i], right[j]))
                ahead_l = self.made[left[i - 1]][2] if i else _NEVER
                ahead_r = self.made[right[j - 1]][2] if j else _NEVER
                # On equal ranks the leftmost pair goes first.
                if across is not None and across < ahead_l and across <= ahead_r:
                    found = False
                    break
                if not i and not j:
                    break
                if ahead_l <= ahead_r:
                    i -= 1
                else:
                    j -= 1
            self.pairs[key] = found
        return found

    def spine(self, token: int, side: int) -> list[int]:
        """The token, its part on one side, that part's part, and so on down to a byte."""
        out = [token]
        while out[-1] in self.made:
            out.append(self.made[out[-1]][side])
        return out

    def _compile(self, state: int, byte: int) -> int:
        suffix, entries = self.suffix[state] + bytes([byte]), self.states[state]
        last, delta, kept = None, 0, []
        for length, before, behind in entries:
            piece = suffix[len(suffix) - length - 1 :]
            if last is None:
                token = self.ids.get(piece)
                if token is not None and self._fits(before, token):
                    last, delta = token, behind + 1
            if piece in self.prefixes:
                kept.append((length + 1, before, behind))
        if last is None:
            raise ValueError("a byte is not in the vocabulary")
        # Counts are relative to the new end, so that states with equal futures are one state.
        new = tuple((n, b, c - delta) for n, b, c in kept) + ((0, last, 0),)
        tail = suffix[len(suffix) - kept[0][0] :] if kept else b""
        at = self.index.setdefault((tail, new), len(self.states))
        if at == len(self.states):
            self.states.append(new)
            self.suffix.append(tail)
        move = at << 16 | delta + 32768
        self.moves[state << 8 | byte] = move
        return move

    def count(self, piece: str) -> int:
        """Tokens of one piece."""
        if len(self.states) > KEEP or len(self.pairs) > 3 * KEEP:
            self._clear()
        if len(self.counts) > 2 * KEEP:
            self.counts.clear()
        state = total = 0
        get = self.moves.get
        for b in piece.encode():
            move = get(state << 8 | b)
            if move is None:
                move = self._compile(state, b)
            state = move >> 16
            total += (move & 65535) - 32768
        if len(piece) <= 64:
            self.counts[piece] = total
        return total

    def text_counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of whole texts; special strings inside them are one token each and end what stands before."""
        cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        parts, owner, out = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if cut is not None and any(s in t for s in self.special):
                out[i] += len(cut.findall(t))
                pieces = cut.split(t)
            else:
                pieces = [t]
            parts += pieces
            owner += [i] * len(pieces)
        flat = "\0".join(parts) + "\0"
        points = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts])
        reset = np.zeros(len(points), bool)
        reset[ends - 1] = True
        starts = piece_starts(points, reset)
        part_of = np.searchsorted(ends, starts, side="right")
        stops = np.minimum(np.append(starts[1:], len(points)), ends[part_of] - 1)
        counts, count = self.counts, self.count
        each = np.fromiter((counts[p] if (p := flat[a:b]) in counts else count(p) for a, b in zip(starts.tolist(), stops.tolist())), np.int64, len(starts))
        np.add.at(out, np.array(owner, np.int64)[part_of], each)
        return out


@lru_cache(maxsize=4)
def machine(path: str) -> CountMachine:
    return CountMachine(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    ``vocabulary`` is the path of a byte-level BPE file, readable on every machine.  Null and empty texts have no bytes and
    no tokens; null ids stay; repeated rows are counted alike; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(vocabulary)
        for batch in batches:
            texts = strings(batch.column(1))
            n = np.zeros(len(texts), np.int64)
            for lo, hi in slices(texts, 2 << 20):
                n[lo:hi] = m.text_counts(texts.slice(lo, hi - lo).to_pylist())
            size = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
