"""Toxicity scores: fuzzy matching against a learned lexicon, then a judgement of each hit's surroundings.

*Lexicon.*  Words and word beginnings whose share of toxic training texts is far
above their share of the others.  A term of four letters may be missed by one
edit, one of nine by two, shorter ones by none; a swap of neighbours is one edit.
Words of clean training texts that are one edit from a term of four letters are
ordinary words and no misspellings.

*Matching.*  The terms form a trie.  A Levenshtein automaton per term would run
over each word; here their intersection with the trie is run at once: a state
holds the trie nodes reached with the edits spent, and is compiled when first
met.  Most words die after a few letters.

*Context.*  A hit counts as quoted when it stands between quotation marks or
closely after a word of reporting.  Direct and quoted hits, exact and fuzzy
ones, their density and their clustering are separate features of a logistic
model, so that quoting earns its own, usually small, weight.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import held_out, release, slices, split_words, strings, training_rows
from panelweave.session import pin

#: Labelled texts used to learn the lexicon and the weights.
TRAIN_ROWS = 8000
#: Least log-likelihood ratio of a term: chance gives one such term among some thousand.
MIN_GAIN = 6.0
#: Least log odds of a term.
MIN_ODDS = 2.5
#: What a toxic text still counts for each time that a chosen term explains it.
EXPLAINED = 0.6
STEM_LENGTHS = range(4, 13)
#: Terms below this length have so many ordinary neighbours that those are learned.
SHORT = 5
WINDOW = 6
THRESHOLD = 0.5
#: Compiled states a worker keeps.
KEEP_STATES = 100_000
#: Marks around words; a hit's word is taken without them.
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
OPENING, CLOSING = "\"'“”„«‘‹>", "\"'”“»’›"
#: Words of reporting in the corpus' languages.
REPORTING = frozenset(
    "said says say wrote writes called calls quoted quote quotes word term slur dijo dice escribió llamó palabra cita término "
    "dit écrit appelé mot terme citation sagte sagt schrieb nannte wort begriff zitat".split()
)
FEATURES = ["exact", "fuzzy", "quoted_exact", "quoted_fuzzy", "density", "strongest", "clustered", "kinds"]


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """Terms with their log odds; a stem also matches words that go on after it."""

    terms: list[tuple[str, bool, float]]
    #: Whether a swap of two neighbouring letters is one edit.
    swaps: bool = False
    #: Words that are no misspelling of a term below ``SHORT`` letters.
    ordinary: frozenset[str] = frozenset()
    _trie: list[dict[str, int]] = field(default_factory=list, repr=False)

    def __post_init__(self) -> None:
        self._build()

    def __getstate__(self) -> tuple:
        return self.terms, self.swaps, self.ordinary

    def __setstate__(self, state: tuple) -> None:
        self.terms, self.swaps, self.ordinary = state
        self._build()

    def _build(self) -> None:
        self._trie, self._ends, self._most = [{}], {}, [0]
        for t, (text, stem, _) in enumerate(self.terms):
            node, path = 0, [0]
            for c in text:
                if c not in self._trie[node]:
                    self._trie[node][c] = len(self._trie)
                    self._trie.append({})
                    self._most.append(0)
                node = self._trie[node][c]
                path.append(node)
            self._ends.setdefault(node, []).append((t, stem, allowed_edits(text)))
            for n in path:
                self._most[n] = max(self._most[n], allowed_edits(text))
        self._clear()

    def _clear(self) -> None:
        self._ids: dict[tuple, int] = {(): 0}
        self._states: list[tuple] = [()]
        # For ordinary words the second list holds.
        self._early: tuple[list[tuple[int, int] | None], ...] = ([None], [None])  # best stem met here: edits, term
        self._late: tuple[list[tuple[int, int] | None], ...] = ([None], [None])  # best term if the word ends here
        self._next: dict[int, int] = {}
        self._first = self._add({0: 0})
        self.found: dict[str, tuple[int, int] | None] = {}

    def _add(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:  # letters of the term that the word leaves out
            n, e = todo.pop()
            if n >= 0 and e < self._most[n]:
                for child in self._trie[n].values():
                    if e + 1 <= self._most[child] and e + 1 < nodes.get(child, 99):
                        nodes[child] = e + 1
                        todo.append((child, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self._ids:
            self._ids[key] = len(self._states)
            self._states.append(key)
            ends = [(e, t, stem) for n, e in key for t, stem, most in self._ends.get(n, ()) if e <= most]
            for k, held in enumerate((ends, [x for x in ends if not x[0] or len(self.terms[x[1]][0]) >= SHORT])):
                self._early[k].append(min(((e, t) for e, t, stem in held if stem), default=None))
                self._late[k].append(min(((e, t) for e, t, _ in held), default=None))
        return self._ids[key]

    def _step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}

        def put(n: int, e: int) -> None:
            if e <= self._most[n] and e < nodes.get(n, 99):
                nodes[n] = e

        for n, e in self._states[state]:
            if n < 0:  # the second half of a swap
                if -n & 0x1FFFFF == ord(c):
                    put(-n >> 21, e)
                continue
            if self.swaps and e < self._most[n]:
                for x, middle in self._trie[n].items():
                    after = self._trie[middle].get(c)
                    if x != c and after is not None and e < self._most[after]:
                        half = -(after << 21 | ord(x))
                        nodes[half] = min(e + 1, nodes.get(half, 99))
            child = self._trie[n].get(c)
            if child is not None:
                put(child, e)
            if e < self._most[n]:
                put(n, e + 1)
                for other in self._trie[n].values():
                    put(other, e + 1)
        return self._add(nodes)

    def match(self, word: str) -> tuple[int, int] | None:
        """Edits and number of the closest term, or None."""
        if word in self.found:
            return self.found[word]
        if len(self._states) > KEEP_STATES or len(self.found) > 4 * KEEP_STATES:
            self._clear()
        state, best, k = self._first, None, int(word in self.ordinary)
        for c in word:
            key = state << 21 | ord(c)
            after = self._next.get(key)
            if after is None:
                after = self._next[key] = self._step(state, c)
            state = after
            early = self._early[k][state]
            if early is not None and (best is None or early < best):
                best = early
            if not state:
                break
        late = self._late[k][state]
        if late is not None and (best is None or late < best):
            best = late
        self.found[word] = best
        return best


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # FEATURES and a constant

    def score(self, texts: pa.Array) -> np.ndarray:
        z = features(self.lexicon, texts) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(lexicon: Lexicon, texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` and a one per whole text; null counts as empty."""
    texts = strings(texts)
    out = np.zeros((len(texts), len(FEATURES) + 1))
    out[:, -1] = 1
    for lo, hi in slices(texts):
        codes, at, words = split_words(texts.slice(lo, hi - lo))
        raw = words.to_pylist()
        bare = [_EDGES.sub("", w.lower()) for w in raw]
        hits = [lexicon.match(w) if w else None for w in bare]
        is_hit = np.array([h is not None for h in hits] or [False])
        where = np.flatnonzero(is_hit[codes]) if len(codes) else np.zeros(0, np.int64)
        owner = np.searchsorted(at, where, side="right") - 1
        for doc in np.unique(owner):
            places = where[owner == doc] if len(where) < 1000 else where[np.searchsorted(owner, doc) : np.searchsorted(owner, doc, "right")]
            out[lo + doc, :-1] = _document(lexicon, codes, raw, bare, hits, places, int(at[doc]), int(at[doc + 1]))
    return out


def _quoted(words: list[str], bare: list[str], i: int) -> bool:
    """Whether word ``i`` of the window stands in quotation marks or after a word of reporting."""
    if any(w in REPORTING for w in bare[max(0, i - 3) : i]):
        return True
    opened = next((j for j in range(i, -1, -1) if words[j][:1] and words[j][0] in OPENING), None)
    closed = next((j for j in range(i, len(words)) if words[j].rstrip(".,;:!?")[-1:] and words[j].rstrip(".,;:!?")[-1] in CLOSING), None)
    return opened is not None and closed is not None


def _document(lexicon: Lexicon, codes, raw, bare, hits, places: np.ndarray, first: int, end: int) -> list[float]:
    counts, strongest, near, last, kinds = [0, 0, 0, 0], 0.0, 0, None, set()
    for p in places.tolist():
        lo, hi = max(first, p - WINDOW), min(end, p + WINDOW + 1)
        window = codes[lo:hi].tolist()
        edits, term = hits[codes[p]]
        quoted = _quoted([raw[c] for c in window], [bare[c] for c in window], p - lo)
        counts[2 * quoted + (edits > 0)] += 1
        if not quoted:
            strongest = max(strongest, lexicon.terms[term][2] * (1.0 if not edits else 0.5 if edits == 1 else 0.25))
            near += last is not None and p - last <= WINDOW
            last = p
            kinds.add(term)
    return [*map(math.log1p, counts), math.log1p(100 * (counts[0] + counts[1]) / (end - first)), strongest, math.log1p(near), math.log1p(len(kinds))]


def _term_counts(rows: DataFrame) -> DataFrame:
    """``term, pos, neg``: training texts of either label that hold a word (marked by a blank after it) or a beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, neg = Counter(), Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (pos if y else neg).update(_document_terms(text))
            names = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([pos[t] for t in names], pa.int64()), pa.array([neg[t] for t in names], pa.int64())],
                names=["term", "pos", "neg"],
            )

    return rows.mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Terms by log-likelihood ratio, each at least e^2.5 times likelier in toxic texts."""
    totals = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    n_pos, n_neg = int(totals[0]), int(totals[1] - totals[0])
    if not n_pos or not n_neg:
        return Lexicon([])
    odds = F.log((F.col("pos") + 0.1) / n_pos) - F.log((F.col("neg") + 0.1) / n_neg)
    share = F.lit(n_pos / (n_pos + n_neg))
    both = F.col("pos") + F.col("neg")

    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    gain = part(F.col("pos"), both * share) + part(F.col("neg"), both * (1 - share))
    ranked = (
        _term_counts(rows).filter((F.col("pos") >= max(2, n_pos // 400)) & (odds > MIN_ODDS) & (gain > MIN_GAIN))
        .select("term", F.round(odds, 9).alias("odds"), F.round(gain, 9).alias("gain"))
        .orderBy(F.desc("gain"), F.desc(F.length("term")), "term").collect()
    )
    terms = sorted(_cover(rows, [r.term for r in ranked], [float(r.odds) for r in ranked], n_pos, n_neg))
    return Lexicon(terms, True, _ordinary(rows, Lexicon(terms, True), n_pos, n_neg))


def _ordinary(rows: DataFrame, lexicon: Lexicon, n_pos: int, n_neg: int) -> frozenset[str]:
    """Words that miss a short term by an edit and stand in clean training texts, with too low odds for a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, labels = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in {_EDGES.sub("", w) for w in _SPACE.split(text.lower())}:
                    hit = lexicon.match(w) if w else None
                    if hit is not None and hit[0] and len(lexicon.terms[hit[1]][0]) < SHORT:
                        words.append(w), labels.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32())], names=["word", "y"])

    counts = rows.mapInArrow(run, "word string, y int").groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    odds = F.log((F.col("pos") + 0.1) / n_pos) - F.log((F.col("neg") + 0.1) / n_neg)
    return frozenset(r.word for r in counts.filter((F.col("neg") > 0) & (odds <= MIN_ODDS)).select("word").collect())


def _document_terms(text: str) -> set[str]:
    """Words, each with a blank after it, and beginnings of words."""
    seen = {_EDGES.sub("", w) for w in text.lower().split()}
    return {w + " " for w in seen if w} | {w[:n] for w in seen for n in STEM_LENGTHS if len(w) >= n}


def _cover(rows: DataFrame, terms: list[str], odds: list[float], n_pos: int, n_neg: int) -> list[tuple[str, bool, float]]:
    """Terms by what they explain; explained texts count less, so that words that merely share a text with a term stay out."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(number[t] for t in _document_terms(text) if t in number) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32())), batch.column(1)], names=["held", "y"])

    found = sorted((tuple(r.held), r.y) for r in rows.mapInArrow(run, "held array<int>, y int").collect())
    pos, neg = np.zeros(len(terms)), np.zeros(len(terms))
    texts_of: dict[int, list[int]] = {}
    for d, (held, y) in enumerate(found):
        (pos if y else neg)[list(held)] += 1
        for t in held if y else ():
            texts_of.setdefault(t, []).append(d)
    left = np.ones(len(found))
    chosen, share = [], n_pos / (n_pos + n_neg)
    while len(terms):
        both = np.maximum(pos + neg, 1e-9)
        gain = np.where(pos > both * share, pos * np.log(np.maximum(pos, 1e-9) / (both * share)) + neg * np.log(np.maximum(neg, 1e-9) / (both * (1 - share))), 0)
        best = int(np.argmax(np.round(gain, 6)))
        if gain[best] < MIN_GAIN:
            break
        chosen.append((terms[best].rstrip(" "), not terms[best].endswith(" "), odds[best]))
        for d in texts_of[best]:
            pos[list(found[d][0])] -= left[d] * (1 - EXPLAINED)
            left[d] *= EXPLAINED
        text = chosen[-1][0]
        pos[best] = 0
        # A word too short for a stem says nothing of the words that begin with it.
        least = STEM_LENGTHS.start
        pos[[i for i, t in enumerate(terms) if min(len(text), len(t.rstrip(" "))) >= least and (t.startswith(text) or text.startswith(t.rstrip(" ")))]] = 0
    return chosen


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        base = (y.sum() + 1) / (len(y) + 2)
        w[-1] = math.log(base / (1 - base))
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        change = np.linalg.solve(h, g)
        w -= change
        if np.abs(change).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from at most ``TRAIN_ROWS`` labelled rows outside the held-out fold; without both labels it scores their mean."""
    # Written, so that the documents are searched for them once.
    rows = pin(training_rows(docs, labels, label, TRAIN_ROWS))
    lexicon = learn_lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(lexicon, batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    found = sorted((tuple(r.x), r.y) for r in rows.mapInArrow(run, "x array<double>, y int").collect())
    x = np.array([r[0] for r in found]).reshape(len(found), len(FEATURES) + 1)
    return Model(lexicon, fit_weights(x, np.array([r[1] for r in found], np.float64)))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Null and empty texts score like any text without hits; null ids are not held out; repeated rows score alike; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    slim = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out = pa.array(model.score(texts) < THRESHOLD)
        release()
        return out

    return docs.filter(clean(F.col("text").cast("string")))
