"""Small tables with every awkward case."""

import random

WORDS = [f"w{i}" for i in range(300)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, key string, n int, target int"


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    """Null ids and texts, empty and blank texts, one-word and very long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(5)
    long = "\n".join(text(rng, 60) for _ in range(300)) + " " + "x" * 50_000
    texts = ["", None, "  \n\t ", "one", "A b\nA b\n\nA b", long, text(rng, 80), text(rng, 80), "same text in two rows of one id here", "\u00e9 \u4e2d\u6587 \U0001f600 don't  we'll"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "a text without an id", None, None), (None, None, None, "s1"), (None, "a text without an id", None, None)]
    return [(i, t, lang, s, None, 0.5, "x", None, 7, None) for i, t, lang, s in rows]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


def empty_docs(spark):
    return spark.createDataFrame([], COLUMNS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
