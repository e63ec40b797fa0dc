"""Quality rules whose verdict carries a risk guarantee.

Per text a few counts are taken; a text is rejected when any ratio lies above
its cutoff of the text's stratum.  Labelled good texts, equal ones once, are
dealt to two halves.  One half proposes, per stratum, a ladder of settings: all
cutoffs together, each step at least as strict as the one before.  The other half
tests what a whole setting rejects, by any ratio, with an exact binomial test at
the level ``delta`` divided by the number of strata (Bonferroni).  A stratum climbs
its ladder until a test fails (a fixed sequence, which needs no further
correction) and takes the last setting that passed.  So with probability
``1 - delta`` every stratum's verdict rejects less than ``risk`` of its good texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import slices, split_words, strings
from panelweave.session import pin

#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Rules of the method: the ratio looked at, and the cutoffs tried, from lenient to strict.
RATIOS = ["symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio", "long_word"]
CUTOFFS = {
    "symbol_ratio": np.geomspace(2.0, 0.02, 20),
    "dup_line_ratio": np.linspace(0.95, 0.05, 19),
    "repeat_ratio": np.linspace(0.5, 0.02, 25),
    "upper_ratio": np.linspace(0.9, 0.05, 18),
    "mark_ratio": np.geomspace(2.0, 0.02, 20),
    "long_word": np.geomspace(40.0, 6.0, 20),
}
STRATA = [100, 250, 600, 1500]
#: Steps of the ladder: parts of the risk that the ratios' own rejections may add up to in the proposing half.
LADDER = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"


def _tables() -> np.ndarray:
    t = np.zeros((4, 256), np.int64)
    t[0] = 1
    t[0, 0x80:0xC0] = 0  # continuation bytes
    t[0, [32, *range(9, 14)]] = 0
    t[1, [ord(c) for c in SYMBOLS]] = 1
    t[2, ord("A") : ord("Z") + 1] = 1
    t[3, [ord(c) for c in "!?"]] = 1
    return t


_BYTES = _tables()


def text_metrics(texts: pa.Array) -> list[np.ndarray]:
    """One array per column of ``METRICS``; null counts as empty."""
    texts = strings(texts)
    n = len(texts)
    out = [np.zeros(n, np.int64) for _ in range(8)]
    for lo, hi in slices(texts):
        part = texts.slice(lo, hi - lo)
        codes, at, words = split_words(part)
        out[0][lo:hi] = np.diff(at)
        raw = part.to_pylist()
        blob = np.frombuffer("".join(raw).encode(), np.uint8)
        sizes = np.array([len(x) for x in map(str.encode, raw)], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for k, column in ((0, 1), (1, 2), (2, 6), (3, 7)):
            total = np.concatenate([[0], np.cumsum(_BYTES[k][blob])])
            out[column][lo:hi] = total[ends[1:]] - total[ends[:-1]]
        v = np.int64(max(len(words), 1))
        three = np.zeros(0, np.int64)
        if len(codes) > 2:
            c = codes.astype(np.int64)
            two = c[:-1] * v + c[1:]
            if v >= 1 << 20:
                two = np.unique(two, return_inverse=True)[1].astype(np.int64)
            three = two[: len(c) - 2] * v + c[2:]
        for i in range(hi - lo):
            lines = [x for x in raw[i].split("\n") if x.strip(" \t\x0b\x0c\r")]
            out[5][lo + i] = len(lines)
            out[3][lo + i] = len(lines) - len(set(lines))
            b, e = at[i], at[i + 1]
            if e - b > 3:
                window = three[b : e - 2]
                order = np.argsort(window, kind="stable")
                same = window[order[1:]] == window[order[:-1]]
                if same.any():
                    again = np.zeros(len(window), bool)
                    again[order[1:][same]] = True
                    again[order[:-1][same]] = True
                    cover = np.zeros(e - b, bool)
                    for j in range(3):
                        cover[j : j + len(window)] |= again
                    out[4][lo + i] = int(cover.sum())
    return out


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` and the counts of ``METRICS`` for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in METRICS.split(", ")]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, text_metrics(batch.column(1)))], names=["doc_id", "text_hash", *names])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, text_hash long, {METRICS}")


def _ratios() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / words, "dup_line_ratio": F.col("n_dup_lines") / lines, "repeat_ratio": F.col("n_repeat_words") / words,
        "upper_ratio": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), "mark_ratio": F.col("n_marks") / words, "long_word": F.col("word_chars") / words,
    }


def stratum_of(n_words: Column) -> Column:
    out = F.lit(0)
    for b in STRATA:
        out = out + (n_words >= b).cast("int")
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial(n, p), summed from its terms, the last one first, until the rest is below double precision."""
    total, i, top = 0.0, min(k, n), None
    while i >= 0:
        x = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        top = x if top is None else max(top, x)
        if i < n * p and x < top - 60:
            break
        total += math.exp(x)
        i -= 1
    return min(1.0, total)


def _ladders(good: DataFrame, risk: float) -> dict[int, list[dict[str, float]]]:
    """Per stratum the settings to test: the strictest cutoff per ratio that keeps within the step's share of rejections."""
    found: dict[int, dict[str, np.ndarray]] = {}
    marks = F.array(*[
        F.struct(F.lit(k).alias("ratio"), sum(((v > float(c)).cast("int") for c in CUTOFFS[k]), F.lit(0)).alias("fails"))
        for k, v in _ratios().items()
    ])
    counts = good.select("stratum", F.explode(marks).alias("m")).groupBy("stratum", "m.ratio", "m.fails").agg(F.count(F.lit(1)).alias("n"))
    for r in counts.collect():
        # A row that fails j cutoffs fails the j strictest ones, as they descend.
        found.setdefault(r.stratum, {}).setdefault(r.ratio, np.zeros(len(CUTOFFS[r.ratio]) + 1, np.int64))[r.fails] += r.n
    out: dict[int, list[dict[str, float]]] = {}
    for stratum, ratios in found.items():
        for part in LADDER:
            step = {}
            for ratio, by_fails in ratios.items():
                cuts, allowed = CUTOFFS[ratio], part * risk * int(by_fails.sum()) / len(RATIOS)
                within = [float(c) for j, c in enumerate(cuts) if int(by_fails[len(cuts) - j :].sum()) <= allowed]
                if within:
                    step[ratio] = within[-1]
            out.setdefault(stratum, []).append(step)
    return out


def certified_cutoffs(good: DataFrame, risk: float = 0.01, delta: float = 0.05) -> dict[tuple[int, str], float]:
    """The cutoffs per (stratum, ratio) of the strictest setting that each stratum certifies; none where no setting is.

    ``good`` holds the counts, ``text_hash`` and ``stratum`` of labelled good texts that pass the base rule; rows of equal
    texts are one trial.  Only tables of strata x ratios x cutoffs and strata x steps counts reach the driver.
    """
    good = pin(good.dropDuplicates(["text_hash"]))
    half = F.pmod(F.xxhash64("text_hash"), F.lit(2))
    ladders, ratios = _ladders(good.filter(half == 0), risk), _ratios()
    # The first step of its stratum's ladder that rejects a row; later ones do as well, as cutoffs descend.
    steps_passed = []
    for ratio, value in ratios.items():
        cuts = F.array(*[
            F.array(*[F.lit(float(step.get(ratio, math.inf))) for step in ladders.get(stratum, [{}] * len(LADDER))]) for stratum in range(len(STRATA) + 1)
        ])
        steps_passed.append(F.size(F.filter(F.element_at(cuts, F.col("stratum") + 1), lambda cut, v=value: v <= cut)))
    first = F.least(*steps_passed)
    counts: dict[int, np.ndarray] = {}
    for r in good.filter(half == 1).groupBy("stratum", first.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r.stratum, np.zeros(len(LADDER) + 1, np.int64))[r.step] += r.n
    out = {}
    for stratum, by_step in counts.items():
        n, passed = int(by_step.sum()), None
        for i, step in enumerate(ladders.get(stratum, [])):
            rejected = int(by_step[: i + 1].sum())
            if rejected >= risk * n or binomial_tail(rejected, n, risk) > delta / (len(STRATA) + 1):
                break
            passed = step
        out |= {(stratum, ratio): cut for ratio, cut in (passed or {}).items()}
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """Counts, base verdict and risk-controlled verdict of every row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality)``: rows with quality 1 are the holdout of good texts.  ``kept`` is false where the base rule
    fails or a certified cutoff is exceeded; ``reasons`` lists the ratios above theirs, ``n_cutoffs`` tells how many cutoffs the
    row's stratum has (0: nothing could be certified there, so only the base rule judges).  Null text counts as empty and fails
    the base rule; null ids stay; repeated rows are judged alike; ids repeated in ``labels`` count once, as good only if all
    say so.  With no or too few labelled rows no cutoff is certified and only the base rule rejects.
    """
    counts = pin(measure(docs).withColumn("stratum", stratum_of(F.col("n_words"))))
    good = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.col("quality").cast("int")).alias("_q")).filter("_q = 1")
    cutoffs = certified_cutoffs(counts.filter(~base_failed()).join(good, F.col("doc_id") == F.col("_id"), "left_semi"), risk, delta)
    ratios = _ratios()
    over = [F.when((F.col("stratum") == s) & (ratios[k] > c), F.lit(k)) for (s, k), c in sorted(cutoffs.items())]
    n_cutoffs = F.lit(0)
    for s in range(len(STRATA) + 1):
        n_cutoffs = F.when(F.col("stratum") == s, sum(key[0] == s for key in cutoffs)).otherwise(n_cutoffs)
    reasons = F.array_compact(F.array(*over)) if over else F.array().cast("array<string>")
    return (
        counts.withColumn("reasons", reasons).withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "reasons", n_cutoffs.alias("n_cutoffs"))
    )
