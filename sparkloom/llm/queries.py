"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, chat, jaccard, leaks, lexical, licences, packing, pii, quality, secrets, suffixes, topk, trie


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(_table(spark, folder, "documents"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_report(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(_table(spark, folder, "embeddings"), "vec_id % 50 = 0", k=5, scale=256)


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_report(_table(spark, folder, "documents"))


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.components(_table(spark, folder, "documents"), n=3, percent=90)


def op7_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.report(_table(spark, folder, "documents"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeat_report(_table(spark, folder, "documents"))


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(_table(spark, folder, "conversations"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    kept = quality.quality_verdicts(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=10)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, folder, "conversations"))


def op13_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), window=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_best_fit_packing, op3_byte_bpe, op4_top_k, op5_personal_data,
        op6_ngram_jaccard, op7_licence_scan, op8_suffix_dedup, op9_chat_format, op10_quality_rules,
        op11_lexical_search, op12_prefix_trie, op13_decontaminate,
    )
}

WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o AS g FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""

_RULES_SQL = " UNION ALL ".join(
    f"SELECT doc_id, lang, base_failed, '{r}' AS rule, CASE WHEN {a} > 0 AND {b} > 0 THEN least((1000 * {a} - 1) // ({b}), {quality.STEPS}) ELSE -1 END AS level FROM m" for r, (a, b) in quality.RULES.items()
)

QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM d WHERE len(w) >= 5),
g AS (SELECT doc_id, i, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o AS g FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, range(5) AS x(k) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
f AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
m AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
v AS ({_RULES_SQL}),
tail AS (SELECT lang, rule, level, sum(count(*)) OVER (PARTITION BY lang, rule ORDER BY level DESC) AS tail FROM v WHERE NOT base_failed AND level >= 0 GROUP BY lang, rule, level),
total AS (SELECT lang, count(*) AS n FROM m WHERE NOT base_failed GROUP BY 1),
share AS (SELECT tail.lang, rule, level, CAST({quality.MILLION} * tail AS BIGINT) // n AS share FROM tail JOIN total ON tail.lang = total.lang),
s AS (SELECT doc_id, v.lang, v.base_failed, min(coalesce(share, {quality.MILLION})) AS rarity FROM v LEFT JOIN share ON v.lang = share.lang AND v.rule = share.rule AND v.level = share.level GROUP BY 1, 2, 3),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END) = 1),
hold AS (SELECT lang, rarity FROM s JOIN good USING (doc_id) WHERE NOT base_failed),
size AS (SELECT lang, count(*) AS n, (SELECT greatest(1, count(DISTINCT lang)) FROM hold) AS strata FROM hold GROUP BY ALL),
k AS (SELECT lang, n, strata, unnest(range(0, CAST(floor(n * {quality.ALPHA}) AS BIGINT) + 1)) AS k FROM size),
prob AS (SELECT *, sum(exp(lgamma(n + 1) - (CASE WHEN k > 0 THEN lgamma(k + 1) ELSE 0 END) - (CASE WHEN n > k THEN lgamma(n - k + 1) ELSE 0 END) + k * ln({quality.ALPHA}) + (n - k) * ln(1 - {quality.ALPHA}))) OVER (PARTITION BY lang ORDER BY k) AS p FROM k),
most AS (SELECT lang, max(k) AS most FROM prob WHERE p <= {quality.DELTA} / strata GROUP BY 1),
rej AS (SELECT lang, rarity, sum(count(*)) OVER (PARTITION BY lang ORDER BY rarity) - count(*) AS below FROM hold GROUP BY lang, rarity),
cut AS (SELECT rej.lang, max(rarity) AS cutoff FROM rej JOIN most ON rej.lang = most.lang WHERE below <= most GROUP BY 1)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, m.base_failed, NOT m.base_failed AND coalesce(rarity >= cutoff, true) AS kept FROM m JOIN s USING (doc_id) LEFT JOIN cut ON m.lang = cut.lang
"""

ORACLE_SQL: dict[str, str] = {"op4_top_k": topk.ORACLE, "op6_ngram_jaccard": JACCARD_SQL, "op9_chat_format": chat.ORACLE, "op10_quality_rules": QUALITY_SQL, "op11_lexical_search": lexical.ORACLE, "op12_prefix_trie": trie.ORACLE, "op13_decontaminate": leaks.ORACLE}
