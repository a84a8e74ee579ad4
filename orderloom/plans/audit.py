"""Audit queries over labels, catalogue and retrieval, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions import text as T
from orderloom.operators import lanes, quality
from orderloom.plans import matching_sql as M
from orderloom.session import cut, table

PREFIXES = {"acme": "ACM-", "nordic": "NRD-"}


def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of several codes, of unknown lines or items, of another tenant, of dead or placeholder items."""
    label = table(spark, sf_dir, "order_line_label").distinct()
    lines = table(spark, sf_dir, "order_lines_holdout").select("line_id", "tenant").distinct()
    items = lanes.catalogue(table(spark, sf_dir, "catalogue_item")).select("item_code", F.col("tenant").alias("owner"), "enabled", "misc").distinct()
    both = label.join(lines, "line_id").join(items, "item_code")
    key = F.col("line_id")
    return quality.union_all([
        quality.duplicate_keys("several_codes", label, ["line_id"]),
        quality.violations("unknown_line", label.join(lines, "line_id", "left_anti"), key, F.col("item_code")),
        quality.violations("unknown_item", label.join(items, "item_code", "left_anti"), key, F.col("item_code")),
        quality.violations("other_tenant", both.where("owner <> tenant"), key, F.col("item_code")),
        quality.violations("disabled_item", both.where("NOT enabled"), key, F.col("item_code")),
        quality.violations("misc_item", both.where("misc"), key, F.col("item_code")),
    ])


def catalogue_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by tenant and kind: live, disabled, placeholder, without barcode; and codes without their tenant's prefix."""
    cat = lanes.catalogue(table(spark, sf_dir, "catalogue_item"))
    n = lambda c: F.sum(c.cast("long"))
    odd = quality.prefix_owner(table(spark, sf_dir, "catalogue_item"), PREFIXES).groupBy(F.col("detail").alias("tenant")).agg(F.count(F.lit(1)).alias("wrong_prefix"))
    out = cat.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("items"), n(~F.col("enabled")).alias("disabled"), n(F.col("misc")).alias("misc"), n(F.col("enabled") & ~F.col("misc")).alias("live"),
        n(F.col("barcode_key") == "").alias("without_barcode"), n(F.col("part_key") == "").alias("without_part"),
    )
    return out.join(odd, "tenant", "left").withColumn("wrong_prefix", F.coalesce("wrong_prefix", F.lit(0)).cast("long"))


def uom_map_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live twins (one base name) whose unit maps differ, unit by unit."""
    cat = cut(lanes.catalogue(table(spark, sf_dir, "catalogue_item")).where("enabled AND NOT misc").select("tenant", "base", "item_code"), "twins")
    units = quality.unit_rows(table(spark, sf_dir, "catalogue_item")).groupBy("tenant", "item_code").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "unit", F.format_number("factor", 4)))), "|").alias("units"))
    both = cat.join(units, ["tenant", "item_code"], "left").select("tenant", "base", "item_code", F.coalesce("units", F.lit("")).alias("units"))
    groups = both.groupBy("tenant", "base").agg(F.count_distinct("units").alias("maps"), F.count_distinct("item_code").alias("codes"))
    return groups.where("codes > 1").select("tenant", "base", "codes", (F.col("maps") == 1).alias("equal"))


def token_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, fits): lines all of whose words are words of several live entries of the tenant.

    Words meet by an index; an entry fits if it shares as many words as the line
    has, so no line meets an entry it shares nothing with.
    """
    live = lanes.catalogue(table(spark, sf_dir, "catalogue_item")).where("enabled AND NOT misc")
    postings = cut(live.select("tenant", "item_code", F.explode(T.token_set(F.col("name_text"))).alias("word")).distinct(), "postings")
    lines = table(spark, sf_dir, "order_lines_holdout").select("line_id", "tenant", T.token_set(T.normalise_order_text(F.col("raw_text"))).alias("words")).distinct()
    lines = cut(lines, "words").where("size(words) > 0")
    shared = lines.select("line_id", "tenant", F.size("words").alias("n"), F.explode("words").alias("word")).join(postings, ["tenant", "word"]).groupBy("line_id", "item_code", "n").agg(F.count(F.lit(1)).alias("k"))
    return shared.where("k = n").groupBy("line_id").agg(F.count(F.lit(1)).alias("fits")).where("fits > 1")


QUERIES = {f.__name__: f for f in (label_audit, catalogue_audit, uom_map_equality, token_containment)}

_B = f"d AS (SELECT DISTINCT * FROM order_line_label), ln AS (SELECT DISTINCT line_id, tenant FROM order_lines_holdout), it AS (SELECT DISTINCT item_code, tenant AS owner, enabled, misc FROM cat), b AS (SELECT d.line_id, d.item_code, tenant, owner, enabled, misc FROM d JOIN ln USING (line_id) JOIN it USING (item_code))"

SQL = {
    "label_audit": f"""
WITH {M._CAT}, {_B}
SELECT 'several_codes' AS "check", line_id AS key, count(*)::VARCHAR AS detail FROM d GROUP BY line_id HAVING count(*) > 1
UNION ALL SELECT 'unknown_line', line_id, item_code FROM d WHERE line_id NOT IN (SELECT line_id FROM ln)
UNION ALL SELECT 'unknown_item', line_id, item_code FROM d WHERE item_code NOT IN (SELECT item_code FROM it)
UNION ALL SELECT 'other_tenant', line_id, item_code FROM b WHERE owner <> tenant
UNION ALL SELECT 'disabled_item', line_id, item_code FROM b WHERE NOT enabled
UNION ALL SELECT 'misc_item', line_id, item_code FROM b WHERE misc""",
    "catalogue_audit": f"""
WITH {M._CAT}
SELECT tenant, count(*) AS items, count(*) FILTER (NOT enabled) AS disabled, count(*) FILTER (misc) AS misc, count(*) FILTER (enabled AND NOT misc) AS live, count(*) FILTER (barcode_key = '') AS without_barcode,
    count(*) FILTER (part_key = '') AS without_part, count(*) FILTER (NOT starts_with(item_code, CASE tenant WHEN 'acme' THEN 'ACM-' ELSE 'NRD-' END)) AS wrong_prefix FROM cat GROUP BY tenant""",
    "uom_map_equality": f"""
WITH {M._CAT}, {M._CONV}, m AS (SELECT tenant, item_code, string_agg(x, '|' ORDER BY x) AS units FROM (SELECT DISTINCT tenant, item_code, unit || '=' || printf('%.4f', factor) AS x FROM u) GROUP BY 1, 2)
SELECT live.tenant, base, count(DISTINCT live.item_code) AS codes, count(DISTINCT coalesce(units, '')) = 1 AS equal FROM live LEFT JOIN m ON m.tenant = live.tenant AND m.item_code = live.item_code GROUP BY 1, 2 HAVING count(DISTINCT live.item_code) > 1""",
    "token_containment": f"""
WITH {M._L}, {M._CAT}, p AS (SELECT DISTINCT tenant, item_code, list_distinct({M._words("name_text")}) AS iw FROM live),
x AS (SELECT DISTINCT line_id, tenant, list_distinct({M._words(M._order(M._text("raw_text")))}) AS w FROM l)
SELECT line_id, count(*) AS fits FROM x JOIN p USING (tenant) WHERE len(w) > 0 AND list_has_all(iw, w) GROUP BY line_id HAVING count(*) > 1""",
}
