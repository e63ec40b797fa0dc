"""URL rules as one bit-parallel wildcard automaton.

Every rule is a pair of globs (host, path).  A rule fits its host and all its
subdomains where the path starts with the rule's path; ``*`` stands for any run
of characters and ``?`` for one, neither crosses from host to path.  All rules
are packed side by side into 64-bit words and simulated together, one symbol of
every URL of the batch at a time (Shift-And with self-loops for ``*``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_START, _SPLIT, _SYMBOLS = 256, 257, 258
_ONE = np.uint64(1)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Automaton:
    """Masks of all rules; ``matches`` gives a URL-by-rule table."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        self.finals: list[int] = []
        steps: list[tuple[object, object]] = []  # (symbols that enter the state, symbols that stay in it)
        byte, any_symbol = range(256), range(_SYMBOLS)
        for r in self.rules:
            steps.append(((_START,), byte))  # subdomains before the rule's own host
            for part, text in ((0, "." + r.host), (1, r.path)):
                if part:
                    steps.append(((_SPLIT,), ()))
                for c in text.encode():
                    if c == ord("*"):
                        enter, stay = steps[-1]
                        steps[-1] = (enter, byte)
                    else:
                        steps.append((byte if c == ord("?") else (c,), ()))
            steps[-1] = (steps[-1][0], any_symbol)
            self.finals.append(len(steps) - 1)
        self.words = max(1, -(-len(steps) // 64))
        self.enter = np.zeros((_SYMBOLS, self.words), np.uint64)
        self.stay = np.zeros((_SYMBOLS, self.words), np.uint64)
        for i, (enter, stay) in enumerate(steps):
            bit = _ONE << np.uint64(i % 64)
            self.enter[list(enter), i // 64] |= bit
            self.stay[list(stay), i // 64] |= bit

    def matches(self, urls: Sequence[tuple[bytes, bytes]]) -> np.ndarray:
        """``urls`` are canonical (host, path) pairs; the order of the rows is theirs."""
        sizes = np.array([len(h) + len(p) + 3 for h, p in urls], np.int64)
        order = np.argsort(-sizes, kind="stable")
        at = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.empty(int(at[-1]), np.int16)
        for i, (h, p) in enumerate(urls):
            b = at[i]
            flat[b], flat[b + 1] = _START, ord(".")
            flat[b + 2 : b + 2 + len(h)] = np.frombuffer(h, np.uint8)
            flat[b + 2 + len(h)] = _SPLIT
            flat[b + 3 + len(h) : at[i + 1]] = np.frombuffer(p, np.uint8)
        state = np.zeros((len(urls), self.words), np.uint64)
        begin, ordered = at[:-1][order], sizes[order]
        for step in range(int(ordered[0]) if len(urls) else 0):
            live = int(np.searchsorted(-ordered, -step, side="left"))
            c = flat[begin[:live] + step]
            d = state[:live]
            moved = d << _ONE
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            if step == 0:
                moved = np.full_like(d, np.uint64(0xFFFFFFFFFFFFFFFF))  # only first states accept the start symbol
            state[:live] = (moved & self.enter[c]) | (d & self.stay[c])
        out = np.zeros((len(urls), len(self.rules)), bool)
        f = np.array(self.finals, np.int64)
        out[order] = (state[:, f // 64] >> (f % 64).astype(np.uint64)) & _ONE == _ONE
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    pattern = r"://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], method_rules: Sequence[Rule], default: str = "allow", hostless: str = "block") -> DataFrame:
    """``page_id, host, path, rule, verdict, method_rule`` of every row of ``pages(page_id, url)``.

    The longest fitting rule of ``rules`` decides (ties: the first listed); where none fits, the longest fitting one of
    ``method_rules``, else ``hostless`` for an empty host and ``default`` for the others.  Null and empty URLs, and those
    without ``://``, have an empty host and path.  Repeated rows and null ids stay as they are; other columns are ignored.
    """
    both = [*rules, *method_rules]
    automaton = Automaton(both)
    size = np.array([len(r.name) for r in both], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            fits = automaton.matches([(h.encode(), p.encode()) for h, p in zip(hosts, paths)])
            best = []
            for lo, hi in ((0, len(rules)), (len(rules), len(both))):
                if lo == hi:
                    best.append(np.full(len(hosts), -1))
                    continue
                rank = np.where(fits[:, lo:hi], size[lo:hi] + 1, 0)
                best.append(np.where(rank.max(axis=1) > 0, rank.argmax(axis=1) + lo, -1))
            rule = [both[i].name if i >= 0 else None for i in best[0]]
            extra = [both[i].name if i >= 0 else None for i in best[1]]
            verdict = [both[i].verdict if i >= 0 else both[j].verdict if j >= 0 else default if h else hostless for i, j, h in zip(best[0], best[1], hosts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(extra, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict", "method_rule"],
            )

    host, path = host_and_path(F.col("url"))
    slim = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    kind = dict(slim.dtypes)["page_id"]
    return slim.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, method_rule string")
