"""Queries of the llm operators and their SQL twins."""

from __future__ import annotations

import os
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.byte_bpe import encode_texts
from orderloom.llm.canonical import items_of_lines
from orderloom.llm.leakage import find_leaks
from orderloom.llm.lookalike import _LATIN_OF, lookalike_classes, lookalike_pairs, one_form
from orderloom.llm.percentiles import from_parts, multi_select, part_summary, weigh, wide
from orderloom.llm.topn import top_n
from orderloom.operators.asof import items_by_buyer_code
from orderloom.session import table

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "order_lines_holdout")
    by_code = items_by_buyer_code(lines, table(spark, sf_dir, "customer_sku_map"))
    return items_of_lines(lines, table(spark, sf_dir, "order_line_label"), table(spark, sf_dir, "catalogue_item"), by_code)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(table(spark, sf_dir, "match_event"), "line_id", "item_code", "score", "rank")


def _latencies(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Measured latencies; a row that is copied in every column counts once."""
    return table(spark, sf_dir, "match_event").where("latency_ms >= 0").select("event_id", "tenant_id", "latency_ms", *more).distinct()


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of latency per tenant (error 0)."""
    weighted = weigh(_latencies(spark, sf_dir), "tenant_id", "latency_ms")
    return wide(multi_select(weighted, list(QUANTILES.values())), "tenant_id", QUANTILES, "long")


def p7_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from summaries of days that are joined, within 0.5 %."""
    days = part_summary(_latencies(spark, sf_dir, "created_at"), "tenant_id", F.substring("created_at", 1, 10), "latency_ms")
    return from_parts(days, "tenant_id", QUANTILES).select("tenant_id", "n", *(F.round(c, 6).alias(c) for c in QUANTILES))


def p7_day_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries of days themselves, as they are kept and joined later."""
    return part_summary(_latencies(spark, sf_dir, "created_at"), "tenant_id", F.substring("created_at", 1, 10), "latency_ms")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The folder is the parameter ORDERLOOM_TOKENIZERS; unset, the one of this image."""
    return os.path.join(os.environ.get("ORDERLOOM_TOKENIZERS", "/opt/tokenizers"), name)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), vocabulary_path())


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "documents"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the class of texts that look the same, and how many of its documents are of another text."""
    return lookalike_classes(table(spark, sf_dir, "documents"))


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its one form, letters in the script that the search chose (no SQL)."""
    return one_form(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found, "p4_found": p4_found, "p7_percentiles": p7_percentiles, "p7_from_days": p7_from_days, "p7_day_parts": p7_day_parts, "p8_ids": p8_ids,
    "p9_found": p9_found, "p10_found": p10_found, "p10_classes": p10_classes, "p10_forms": p10_forms,
}



def _looks_sql(c: str) -> str:
    """The look of a text where no joiner stands between joining letters: unseen characters out, then letter by letter."""
    pairs = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {chr(m): latin for m, latin in _LATIN_OF.items()} | dict.fromkeys("\u2010\u2011\ufe63", "-") | {"\u212a": "K"}
    pairs |= {unicodedata.normalize("NFC", chr(m) + mark): unicodedata.normalize("NFC", latin + mark) for m, latin in _LATIN_OF.items() for mark in "\u0308\u0300\u0301"}
    pairs = {a: b for a, b in pairs.items() if len(a) == 1 and len(b) == 1}
    quote = lambda t: t.replace("'", "''")
    out = f"regexp_replace(regexp_replace({c}, '[\\p{{Cf}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g'), '\\p{{Zs}}', ' ', 'g')"
    for ch, to in (("\ufb01", "fi"), ("\ufb02", "fl"), ("\u2167", "VIII")):
        out = f"replace({out}, '{ch}', '{to}')"
    return f"nfc_normalize(translate(nfc_normalize({out}), '{quote(''.join(pairs))}', '{quote(''.join(pairs.values()))}'))"


SQL = {
    "p10_classes": f"""
WITH k AS (SELECT doc_id, text, {_looks_sql("text")} AS look FROM documents WHERE text IS NOT NULL),
l AS (SELECT * FROM k WHERE trim(look, chr(9) || chr(10) || chr(13) || ' ') <> '')
SELECT doc_id, min(doc_id) OVER (PARTITION BY look) AS class_id, count(*) OVER (PARTITION BY look) - count(*) OVER (PARTITION BY look, text) AS links FROM l""",
    "p10_found": f"""
WITH k AS (SELECT doc_id, text, {_looks_sql("text")} AS look FROM documents WHERE text IS NOT NULL),
l AS (SELECT * FROM k WHERE trim(look, chr(9) || chr(10) || chr(13) || ' ') <> '')
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM l a JOIN l b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p4_found": """
WITH e AS (
    SELECT line_id, item_code, score, rank, row_number() OVER (PARTITION BY line_id, item_code ORDER BY score DESC, rank ASC NULLS LAST) AS k
    FROM match_event WHERE score >= 0 AND score <= 1 AND NOT isnan(score) AND line_id IS NOT NULL AND item_code IS NOT NULL),
r AS (SELECT line_id, item_code, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, rank ASC NULLS LAST, item_code) AS place FROM e WHERE k = 1)
SELECT line_id, item_code, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""",
    "p7_day_parts": """
WITH e AS (SELECT DISTINCT event_id, tenant_id, latency_ms::DOUBLE AS v, substr(created_at, 1, 10) AS part FROM match_event WHERE latency_ms >= 0)
SELECT tenant_id, part, CASE WHEN v > 0 THEN ceil(ln(v) / ln(1.005e0 / 0.995e0))::INTEGER ELSE (-2147483648)::INTEGER END AS bucket, count(*) AS n FROM e GROUP BY 1, 2, 3""",
    "p7_from_days": """
WITH e AS (SELECT DISTINCT event_id, tenant_id, latency_ms::DOUBLE AS v FROM match_event WHERE latency_ms >= 0),
b AS (SELECT tenant_id, CASE WHEN v > 0 THEN ceil(ln(v) / ln(1.005e0 / 0.995e0)) ELSE -2147483648 END AS bucket, count(*) AS n FROM e GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY tenant_id ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY tenant_id) AS total,
    CASE WHEN bucket = -2147483648 THEN 0 ELSE 2 * pow(1.005e0 / 0.995e0, bucket) / (1.005e0 / 0.995e0 + 1) END AS m FROM b)
SELECT tenant_id, any_value(total)::BIGINT AS n, round(min(m) FILTER (run >= greatest(1, ceil(0.5e0 * total))), 6) AS p50, round(min(m) FILTER (run >= greatest(1, ceil(0.95e0 * total))), 6) AS p95,
    round(min(m) FILTER (run >= greatest(1, ceil(0.99e0 * total))), 6) AS p99 FROM r GROUP BY 1""",
    "p7_percentiles": """
SELECT tenant_id, quantile_disc(latency_ms, 0.5)::BIGINT AS p50, quantile_disc(latency_ms, 0.95)::BIGINT AS p95, quantile_disc(latency_ms, 0.99)::BIGINT AS p99
FROM (SELECT DISTINCT event_id, tenant_id, latency_ms FROM match_event WHERE latency_ms >= 0) GROUP BY tenant_id""",
}
