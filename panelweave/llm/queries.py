"""One registered query per corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import table
from panelweave.llm.decontam import find_items
from panelweave.llm.hard_negatives import hard_negatives
from panelweave.llm.lexical_search import lexical_search
from panelweave.llm.license_scan import Notice, license_digest
from panelweave.llm.mixing import mix
from panelweave.llm.near_dedup import near_duplicates
from panelweave.llm import quality_cnn, toxicity
from panelweave.llm.quality_rules import quality_rules
from panelweave.llm.secret_scan import scan_secrets
from panelweave.llm.token_counts import token_counts
from panelweave.llm.token_files import token_digests
from panelweave.llm.url_filter import Rule, judge_urls

#: The rules every page is held against.
URL_RULES = [
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"),
]
#: What decides where none of them fits: shops, trackers, log-in pages and downloads.
URL_GLOBS = [
    Rule("*", "/*login*", "block"), Rule("*", "/*checkout*", "block"), Rule("*", "/*.exe", "block"), Rule("*", "/*.zip", "block"),
    Rule("ads.*", "", "block"), Rule("track??.*", "", "block"), Rule("*casino*", "", "block"),
]

#: The phrases whose places are counted.
LICENSES = [
    Notice("mit", "under the mit license", frozenset({"mit"})),
    Notice("apache-2", "apache license version 2", frozenset({"2"})),
    Notice("cc-by-nc", "cc by nc", frozenset({"cc", "by", "nc"})),
]
#: Other notices as they stand in common licences.
MORE_LICENSES = [
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("gpl", "gnu general public license"),
    Notice("lgpl", "gnu lesser general public license"),
    Notice("agpl", "gnu affero general public license"),
    Notice("mpl", "mozilla public license"),
    Notice("unlicense", "free and unencumbered software released into the public domain"),
    Notice("cc-by-nc", "creative commons attribution noncommercial"),
    Notice("all-rights-reserved", "all rights reserved"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), (5, 2, 1), 3)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 0.3)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"), LICENSES, MORE_LICENSES)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)


def _glob_sql(rule: Rule) -> str:
    """A glob rule as a regular expression over host, tab and path."""
    def part(text: str) -> str:
        return "".join({"*": "[^\t]*", "?": "[^\t]"}.get(c, c if c.isalnum() or c == "/" else "\\" + c) for c in text)
    return f"regexp_matches(host || chr(9) || path, '^([^\t]*\\.)?{part(rule.host)}\t{part(rule.path)}')"


def _op10_sql() -> str:
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in URL_RULES]
    fits.sort(key=lambda x: -len(x[1].name))
    globs = [(_glob_sql(r), r) for r in sorted(URL_GLOBS, key=lambda r: -len(r.name))]
    rule = " ".join(f"WHEN {c} THEN '{r.name}'" for c, r in fits)
    verdict = " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in fits + globs)
    method = " ".join(f"WHEN {c} THEN '{r.name}'" for c, r in globs)
    return f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN host <> '' THEN 'allow' ELSE 'block' END AS verdict, CASE {method} END AS method_rule FROM u"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_files": op2_token_files,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_cnn": op7_quality_cnn,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_url_rules": op10_url_rules,
    "op11_license_scan": op11_license_scan,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Source targets by filling up sources in order of cap per weight, certain copies, then Pareto order of unequal odds within each source.
_OP3_SQL = r"""WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
 md5(concat_ws('|', '7', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(md5(text), 'null'))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((place - 1) % 3 + 1 AS INT)] AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, (SELECT sum(source_size) FROM w) AS words, (SELECT sum(weight) FROM w) AS weights FROM w),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
 weights - coalesce(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w FROM r),
l AS (SELECT CAST(words - caps_before AS DOUBLE) / CAST(left_w AS DOUBLE) AS level FROM o WHERE CAST(caps_before AS DOUBLE) + ratio * CAST(left_w AS DOUBLE) >= words ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM l) * weight) AS target FROM w),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS times FROM t),
n AS (SELECT *, floor(times) AS certain, target - floor(times) * source_size AS missing FROM e),
b AS (SELECT source, len(bin(size)) AS bits, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
y AS (SELECT source, bits, coalesce(sum(words) OVER (PARTITION BY source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS settled,
 sum(words * bits) OVER (PARTITION BY source ORDER BY bits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weighted FROM b),
x AS (SELECT n.*, y.bits AS top, n.missing - CAST(y.settled AS DOUBLE) AS free, CAST(y.weighted AS DOUBLE) AS weighted FROM n LEFT JOIN y
 ON n.source IS NOT DISTINCT FROM y.source AND (n.missing - CAST(y.settled AS DOUBLE)) * y.bits < CAST(y.weighted AS DOUBLE)
 QUALIFY row_number() OVER (PARTITION BY n.source ORDER BY y.bits DESC NULLS LAST) = 1),
q AS (SELECT d.doc_id, d.size, d.k, x.* EXCLUDE (source), d.source, CASE WHEN len(bin(d.size)) <= x.top AND x.free > 0 THEN x.free / x.weighted * len(bin(d.size)) END AS p,
 (CAST(CAST('0x' || substr(k, 1, 13) AS BIGINT) AS DOUBLE) * 2 + 1) / 9007199254740992 AS u FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
c AS (SELECT *, (u / (1 - u)) / (p / greatest(1 - p, 1e-12)) AS q FROM q),
g AS (SELECT source, q, k, sum(size) AS size FROM c WHERE p IS NOT NULL GROUP BY source, q, k),
h AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM g),
z AS (SELECT c.*, CAST(c.certain AS BIGINT) + CASE WHEN c.p IS NULL THEN CASE WHEN c.missing > 0 AND (c.top IS NULL OR len(bin(c.size)) > c.top) THEN 1 ELSE 0 END
 WHEN h.start + h.size / 2 <= c.free THEN 1 ELSE 0 END AS copies FROM c LEFT JOIN h ON c.source IS NOT DISTINCT FROM h.source AND c.k = h.k)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM z"""

#: Exact containment of every item in every document by its shingles.
_OP9_SQL = r"""WITH w AS (SELECT 0 AS kind, row_number() OVER () AS row, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
UNION ALL SELECT 1, row_number() OVER (), item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (SELECT kind, row, id, unnest(list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])) AS s FROM w WHERE len(w) >= 5),
n AS (SELECT row, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY row),
p AS (SELECT d.row AS d_row, i.row AS i_row, any_value(d.id) AS doc_id, any_value(i.id) AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.s = i.s AND d.kind = 0 AND i.kind = 1 GROUP BY d.row, i.row)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment, true AS contaminated FROM p JOIN n ON p.i_row = n.row WHERE 100 * n_shared >= 75 * n_item"""

#: All scores from plain term counts.
_OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
g AS (SELECT count(*) AS nd, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
qt AS (SELECT q, term, count(*) AS c FROM (SELECT q, unnest(t) AS term FROM q) GROUP BY q, term),
dt AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY row, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM dt, g GROUP BY term),
m AS (SELECT row, doc_id, 25 + ((75 * len(t) * nd) // l) AS m FROM d, g WHERE len(t) > 0),
i AS (SELECT dt.row, dt.term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS impact FROM dt JOIN w ON dt.term = w.term JOIN m ON dt.row = m.row),
s AS (SELECT q, row, CAST(sum(c * impact) AS BIGINT) AS score FROM qt JOIN i ON qt.term = i.term GROUP BY q, row),
r AS (SELECT q.item_id, m.doc_id, score, row_number() OVER (PARTITION BY s.q ORDER BY score DESC, m.doc_id NULLS LAST) AS rank FROM s JOIN m ON s.row = m.row JOIN q ON s.q = q.q WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10"""

#: All products of anchors and rows.
_OP13_SQL = """WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
t AS (SELECT anchor_id, other AS positive_id, s AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5),
n AS (SELECT t.*, p.other AS negative_id, p.s AS negative_score, row_number() OVER (PARTITION BY t.anchor_id, t.positive_id ORDER BY p.s DESC, p.other) AS rank
FROM t JOIN p ON t.anchor_id = p.anchor_id AND NOT p.same AND 80 * t.positive_score <= 100 * p.s AND 100 * p.s <= 100 * t.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

SQL: dict[str, str] = {"op12_lexical_search": _OP12_SQL, "op13_hard_negatives": _OP13_SQL, "op9_decontamination": _OP9_SQL, "op3_mixing": _OP3_SQL, "op10_url_rules": _op10_sql()}
