"""Short licence notices, found in spite of small errors.

1. A text becomes its words (A-Z lower-cased) with one blank between them.
2. A notice of ``k`` allowed edits is cut into ``k + 1`` pieces.  Edits touch at
   most ``k`` of them, so one piece stands unchanged in every match; all pieces
   of all notices are looked for in one pass of an Aho-Corasick automaton.
3. Around every piece the regex library's bounded-error matching looks for the
   best match that starts and ends with a word and takes at most ``k`` edits.
   A notice's ``exact`` words (a licence's name, a version) must stand unchanged
   as words of their own, so that version 1 never passes for version 2.
4. Matches are mapped back to the words and code points of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import slices, strings, translated, word_table

_TABLE = word_table("0123456789abcdefghijklmnopqrstuvwxyz")
#: Fixed value: what a word is, after A-Z were lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Characters of a notice for one allowed edit, and the most edits.
PER_EDIT, MOST_EDITS = 8, 3
#: Results of windows that are remembered; the oldest go first.
REMEMBERED = 1 << 15
MATCH = "struct<label string, notice int, first_word long, last_word long, start long, end long, edits int>"


@dataclass(frozen=True)
class Notice:
    """Words in lower case with one blank between them; ``exact`` words allow no edit."""

    label: str
    phrase: str
    exact: frozenset[str] = frozenset()

    @property
    def edits(self) -> int:
        free = len(" ".join(w for w in self.phrase.split() if w not in self.exact))
        return min(MOST_EDITS, free // PER_EDIT)


class Searcher:
    def __init__(self, notices: Sequence[Notice]):
        self.notices = list(notices)
        self.patterns = [[self._pattern(n, p) for p in range(n.edits + 1)] for n in self.notices]
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            cuts = [len(n.phrase) * j // (n.edits + 1) for j in range(n.edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                owners.setdefault(n.phrase[a:b], []).append((i, a))
        self.seeds = ahocorasick.Automaton()
        for piece, of in owners.items():
            self.seeds.add_word(piece, (len(piece), of))
        self.seeds.make_automaton()
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    @staticmethod
    def _pattern(n: Notice, before: int):
        """A pattern for ``before`` extra characters ahead of the notice, which the library does not count at a match's start."""
        runs: list[tuple[bool, list[str]]] = []  # words that must stand as they are, and words between them
        for w in n.phrase.split():
            if runs and runs[-1][0] == (w in n.exact):
                runs[-1][1].append(w)
            else:
                runs.append((w in n.exact, [w]))
        if before and runs[0][0]:
            return None
        left = n.edits - before
        parts = [re.escape(" ".join(words)) if fixed or not left else f"(?:{re.escape(' '.join(words))}){{e<={left}}}" for fixed, words in runs]
        return regex.compile("(?b)(?<= )" + "[^ ]" * before + " ".join(parts) + "(?= )")

    def _near(self, i: int, window: str) -> tuple[int, int, int] | None:
        """The best match of a notice in a window that has a blank on both sides: start, end, edits."""
        key = (i, window)
        if key in self.known:
            return self.known[key]
        n, best = self.notices[i], None
        for before, pattern in enumerate(self.patterns[i]):
            if pattern is None or (best and best[2] <= before):
                break
            m = pattern.search(window)
            if m:
                edits = before + sum(m.fuzzy_counts)
                if edits <= n.edits and (best is None or edits < best[2]):
                    best = (m.start(), m.end(), edits)
        if len(self.known) >= REMEMBERED:
            del self.known[next(iter(self.known))]
        self.known[key] = best
        return best

    def find(self, words: str) -> list[tuple[int, int, int, int]]:
        """``notice, start, end, edits`` in words joined by blanks: all exact places, and the best ones that overlap no better one of their notice."""
        text = f" {words} "
        exact: set[tuple[int, int]] = set()
        near: set[tuple[int, int, int, int]] = set()
        for last, (size, of) in self.seeds.iter(text):
            for i, offset in of:
                n = self.notices[i]
                at, k = last + 1 - size - offset, n.edits
                if at > 0 and text.startswith(n.phrase, at) and text[at - 1] == " " and text[at + len(n.phrase)] == " ":
                    exact.add((i, at))
                elif k:
                    lo = max(0, at - k - 1)
                    got = self._near(i, text[lo : at + len(n.phrase) + k + 1])
                    if got:
                        near.add((i, lo + got[0], lo + got[1], got[2]))
        out = [(i, at - 1, at - 1 + len(self.notices[i].phrase), 0) for i, at in exact]
        taken: dict[int, list[tuple[int, int]]] = {}
        for i, a, b, _ in out:
            taken.setdefault(i, []).append((a, b))
        for i, a, b, edits in sorted(near, key=lambda x: (x[3], x[1], x[2], x[0])):
            spans = taken.setdefault(i, [])
            if not any(a - 1 < d and c < b - 1 for c, d in spans):
                spans.append((a - 1, b - 1))
                out.append((i, a - 1, b - 1, edits))
        return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def find_notices(docs: DataFrame, notices: Sequence[Notice]) -> DataFrame:
    """``doc_id, n_words, matches`` for every row of ``docs(doc_id, text)``.

    ``matches`` lists label, the notice's number, first and last word (from 0), start and end in code points (end
    exclusive) and edits of every match in the whole text, by place.  Null, empty and wordless texts have 0 words and
    no match.  Repeated rows and null ids stay as they are; other columns are ignored.  With no notices nothing matches.
    """
    notices = list(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(notices) if notices else None
        for batch in batches:
            texts = strings(batch.column(1))
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo)
                words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(translated(part, _TABLE)))
                plain = pc.binary_join(words, " ").to_pylist()
                counts = np.where([bool(w) for w in plain], pc.list_value_length(words).to_numpy(zero_copy_only=False), 0)
                rows = [self_matches(searcher, w, part[i].as_py) if w and searcher else [] for i, w in enumerate(plain)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(rows, _MATCHES)], names=["doc_id", "n_words", "matches"]
                )

    def self_matches(searcher: Searcher, words: str, text) -> list[dict]:
        got = searcher.find(words)
        if not got:
            return []
        starts = np.array([0, *(m.end() for m in re.finditer(" ", words))])
        spans = [m.span() for m in _WORD.finditer(text().translate(_LOWER))]
        out = []
        for i, a, b, edits in got:
            first, last = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b - 1, "right")) - 1
            out.append({"label": notices[i].label, "notice": i, "first_word": first, "last_word": last, "start": spans[first][0], "end": spans[last][1], "edits": edits})
        return out

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_words long, matches array<{MATCH}>")


_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))


def license_digest(docs: DataFrame, base: Sequence[Notice], more: Sequence[Notice]) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches`` for every row of ``docs``.

    ``n_base``, the smallest and largest first word and ``base_labels`` tell where the ``base`` notices stand without an
    edit; ``labels`` has those of all matches.  ``score`` is the best match's share of unedited characters, 0 without one.
    Odd rows are treated as ``find_notices`` says: no match, empty labels, null words, score 0.
    """
    both = [*base, *more]
    found = find_notices(docs, both)
    plain = F.filter("matches", lambda m: (m["edits"] == 0) & (m["notice"] < len(base)))
    first = F.transform(plain, lambda m: m["first_word"])
    size = F.array(*[F.lit(len(n.phrase)) for n in both])
    share = F.transform("matches", lambda m: 1 - m["edits"] / F.element_at(size, m["notice"] + 1))

    def joined(matches) -> object:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(plain).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        joined(plain).alias("base_labels"), joined(F.col("matches")).alias("labels"), F.coalesce(F.array_max(share), F.lit(0.0)).alias("score"), "matches",
    )
