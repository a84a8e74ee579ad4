"""Queries of the core data problems and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.operators import units
from orderloom.operators.asof import items_by_buyer_code
from orderloom.operators.cow_table import BucketedTable
from orderloom.operators.timestamps import CANONICAL, normalise_timestamps
from orderloom.operators.units import quantities_in_stock_unit
from orderloom.session import new_path, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities_in_stock_unit(
        table(spark, sf_dir, "order_lines_holdout"), table(spark, sf_dir, "order_line_label"), table(spark, sf_dir, "catalogue_item")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_by_buyer_code(table(spark, sf_dir, "order_lines_holdout"), table(spark, sf_dir, "customer_sku_map"))


#: Batches in which the whole feed is applied: the first loads the base, the others are merged into it.
FEED_BATCHES = 3


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as many buckets as tasks, so that a bucket stays the size of a task's share
    state = BucketedTable(spark, new_path(spark, "state"), max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    state.apply_in_batches(table(spark, sf_dir, "change_feed"), FEED_BATCHES)
    return state.read().select("external_id", "version", "change_id")


#: The clock of each site.
SITE_ZONES = {"SIN": "Asia/Singapore", "OSL": "Europe/Oslo", "CHI": "America/Chicago"}


def _clock() -> Column:
    home = F.lit(None).cast("string")
    for site, zone in SITE_ZONES.items():
        home = F.when(F.upper(F.trim("site")) == site, F.lit(zone)).otherwise(home)
    return home


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps already written as yyyy-MM-ddTHH:mm:ssZ have one reading and need none of this.

    The records of a site are the chain of its clock; local records have no order, so each is by itself.
    """
    none = F.lit(None).cast("string")

    def part(name: str, key: str, order: str, value: str, zone: Column, chain: Column) -> DataFrame:
        rows = table(spark, sf_dir, name).where(~F.col(value).rlike(CANONICAL) & F.col(key).isNotNull())
        order_key = F.col(order).cast("long") if order == key else F.lit(0).cast("long")
        return rows.select(
            F.lit(name).alias("src"), F.col(key).cast("string").alias("row_key"), order_key.alias("ord"), F.col(value).alias("value"), zone.alias("home"), F.concat_ws("|", F.lit(name), chain).alias("chain")
        )

    feed = part("change_feed", "change_id", "change_id", "updated_at", _clock(), F.upper(F.trim("site")))
    local = part("local_record", "external_id", "", "updated_at_utc", none, F.col("external_id"))
    events = part("match_event", "event_id", "event_id", "created_at", none, none)
    return normalise_timestamps(feed.unionByName(local).unionByName(events)).distinct()


def p6_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stamp of change_feed read without the declared conventions (no SQL: a search over the order of records).

    Day or month may come first, a stamp without zone may be the site's clock or
    UTC, CST American or Chinese; the order of each site's records, with every
    unambiguous stamp in it, decides.
    """
    rows = table(spark, sf_dir, "change_feed").where("change_id IS NOT NULL")
    site = F.upper(F.trim("site"))
    every = rows.select(F.lit("change_feed").alias("src"), F.col("change_id").cast("string").alias("row_key"), F.col("change_id").alias("ord"), F.col("updated_at").alias("value"), _clock().alias("home"), site.alias("chain"))
    return normalise_timestamps(every, declared=False).distinct()


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p6_undeclared": p6_undeclared}

_DAY = """CASE
    WHEN regexp_full_match(trim(order_date), '\\d{4}-\\d{2}-\\d{2}(T.*)?') THEN try_cast(substr(trim(order_date), 1, 10) AS DATE)
    WHEN regexp_full_match(trim(order_date), '\\d{4}/\\d{2}/\\d{2}') THEN try_cast(replace(trim(order_date), '/', '-') AS DATE)
    WHEN regexp_full_match(trim(order_date), '\\d{8}') THEN try_cast(substr(trim(order_date), 1, 4) || '-' || substr(trim(order_date), 5, 2) || '-' || substr(trim(order_date), 7, 2) AS DATE)
    WHEN regexp_full_match(trim(order_date), '\\d{1,2} [A-Za-z]{3} \\d{4}') THEN try_strptime(trim(order_date), '%d %b %Y')::DATE
    END"""

_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f", "%d.%m.%Y %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%d %b %Y %H:%M:%S", "%Y%m%dT%H%M%S"]
_TAIL = " ?(Z|[A-Z]{3,4}|[+-]\\d{2}:?\\d{2})$"
_NAMED = "MAP {'Z': 0, 'UTC': 0, 'GMT': 0, 'SGT': 28800, 'CET': 3600, 'CEST': 7200, 'CST': -21600, 'CDT': -18000}"

#: Fixed value: the p2 query's known spellings as a map of DuckDB.
_UNIT_MAP = "MAP {" + ", ".join(f"'{s}': '{u}'" for u, words in units.UNIT_SPELLINGS.items() for s in words) + "}"
_WORD_MAP = "MAP {" + ", ".join(f"'{w}': {v}::DOUBLE" for w, v in units.NUMBER_WORDS.items()) + "}"
_DEC = units._DEC


def _decimal(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?') THEN replace({c}, ',', '') ELSE replace({c}, ',', '.') END::DOUBLE"


def _number(c: str) -> str:
    part = lambda p, k: f"regexp_extract({c}, '{p}', {k})"
    product, mixed, vulgar = rf"^({_DEC})\s*[x*×]\s*({_DEC})$", r"^(?:(\d+)\s+)?(\d+)/(\d+)$", "^(\\d*)\\s*([½¼¾])$"
    whole = lambda x: f"coalesce(try_cast({x} AS DOUBLE), 0)"
    return f"""CASE WHEN regexp_matches({c}, '{product}') THEN ({_decimal(part(product, 1))}) * ({_decimal(part(product, 2))})
        WHEN regexp_matches({c}, '{mixed}') THEN {whole(part(mixed, 1))} + try_cast({part(mixed, 2)} AS DOUBLE) / nullif(try_cast({part(mixed, 3)} AS DOUBLE), 0)
        WHEN regexp_matches({c}, '{vulgar}') THEN {whole(part(vulgar, 1))} + MAP {{'½': 0.5::DOUBLE, '¼': 0.25::DOUBLE, '¾': 0.75::DOUBLE}}[{part(vulgar, 2)}]
        WHEN regexp_matches({c}, '^(?:{_DEC})$') THEN {_decimal(c)} ELSE {_WORD_MAP}[{c}] END"""


def _free() -> str:
    rows = []
    for k, p in enumerate(units._IN_TEXT):
        p = p.replace(r"(?=\S)", r"\S")
        rows.append(f"SELECT *, {k} AS place, regexp_extract(t, '{p}', 1) AS n, regexp_extract(t, '{p}', 2) AS un, regexp_extract(t, '{p}', 3) AS pk, false AS unread, true AS free FROM w WHERE q IS NULL AND u IS NULL")
    return " UNION ALL ".join(rows)


_PIECES = ", ".join(f"'{x}'" for x in units.UNIT_SPELLINGS["piece"])
_MEASURE_CASE = " ".join(f"WHEN '{u}' THEN {{f}}('{b}') * {m}" for u, (b, m) in units.MEASURES.items())
_RUNS = "list_transform(regexp_extract_all(lower({c}), '(\\d+(?:[.,]\\d+)?\\s*[a-z]+)', 1), lambda r: regexp_replace(r, '\\s+', '', 'g'))"
_P2 = f"""
WITH lb AS (SELECT line_id, min(item_code) AS item_code FROM order_line_label WHERE line_id IS NOT NULL AND item_code IS NOT NULL GROUP BY 1),
w AS (SELECT DISTINCT line_id, tenant, nullif(lower(trim(qty)), '') AS q, nullif(lower(trim(uom_text)), '') AS u, nullif(lower(trim(raw_text)), '') AS t, item_code FROM order_lines_holdout JOIN lb USING (line_id)),
c AS (SELECT *, regexp_extract(coalesce(q, u), '{units._CELL}', 1) AS n, regexp_extract(coalesce(q, u), '{units._CELL}', 2) AS un0, regexp_extract(coalesce(q, u), '{units._CELL}', 3) AS pk0 FROM w WHERE q IS NOT NULL OR u IS NOT NULL),
f AS (SELECT line_id, tenant, q, u, t, item_code, 0 AS place, n, CASE WHEN q IS NULL OR un0 <> '' THEN un0 ELSE coalesce(regexp_extract(u, '{units._LABEL}', 1), '') END AS un,
        CASE WHEN q IS NULL OR un0 <> '' THEN pk0 ELSE coalesce(regexp_extract(u, '{units._LABEL}', 2), '') END AS pk,
        coalesce(q IS NOT NULL AND un0 = '' AND NOT regexp_matches(u, '{units._LABEL}'), false) AS unread, false AS free FROM c
    UNION ALL {_free()}),
g AS (SELECT line_id, tenant, t, item_code, place, unread, {_number("n")} AS num, nullif(regexp_replace(lower(un), '[^a-z]', '', 'g'), '') AS sp,
        try_cast(regexp_extract(pk, '(\\d+)', 1) AS DOUBLE) AS pn, regexp_replace(regexp_extract(pk, '\\d+\\s*([a-z]+)', 1), '[^a-z]', '', 'g') AS pw,
        CASE WHEN free THEN regexp_replace(n || un, '\\s+', '', 'g') ELSE '' END AS run FROM f WHERE n <> ''),
i AS (SELECT tenant, item_code, any_value(item_name) AS item_name, any_value({_UNIT_MAP}[regexp_replace(lower(stock_uom), '[^a-z]', '', 'g')]) AS stock,
        any_value(CASE WHEN json_valid(uom_conversions) THEN from_json(uom_conversions, '[{{"uom":"VARCHAR","conversion_factor":"DOUBLE"}}]') END) AS cv FROM catalogue_item GROUP BY 1, 2),
j AS (SELECT g.*, item_name, stock, {_UNIT_MAP}[sp] AS unit, list_transform(coalesce(cv, []), lambda x: {{'k': {_UNIT_MAP}[regexp_replace(lower(x.uom), '[^a-z]', '', 'g')], 'f': x.conversion_factor}}) AS cs FROM g JOIN i USING (tenant, item_code)),
k AS (SELECT *, CASE WHEN pn > 0 AND (pw = '' OR pw IN ({_PIECES})) THEN pn END AS pack FROM j),
m AS (SELECT *, CASE WHEN pack IS NOT NULL AND unit IS NOT NULL AND unit NOT IN ('piece', {", ".join(f"'{u}'" for u in units.MEASURES)})
            THEN coalesce(pack * {{f}}('piece'), CASE WHEN unit = stock THEN 1 END)
        WHEN sp IS NULL AND NOT unread THEN 1 ELSE coalesce({{f}}(unit), CASE unit {_MEASURE_CASE} END) END AS factor,
        run <> '' AND list_contains({_RUNS.format(c="item_name")}, run) AND len(list_filter({_RUNS.format(c="t")}, lambda r: r = run)) < 2 AS size_only FROM k),
r AS (SELECT line_id, arg_min(num * factor * 1000, place) FILTER (num IS NOT NULL AND NOT size_only AND NOT (unit IS NULL AND regexp_matches(run, '[a-z]'))) AS milli,
        min(place) FILTER (num IS NOT NULL AND NOT size_only AND NOT (unit IS NULL AND regexp_matches(run, '[a-z]'))) AS first_place FROM m GROUP BY 1),
v AS (SELECT r.line_id, num * factor * 1000 AS milli FROM r JOIN m ON m.line_id = r.line_id AND m.place = r.first_place)
SELECT line_id, floor(round(milli, 6) + 0.5)::BIGINT AS qty_milli FROM v WHERE milli IS NOT NULL"""


def _p2_sql() -> str:
    import re

    # the stock units in one unit, by the item itself
    per = lambda m: f"(CASE WHEN {m[1]} = stock THEN 1 ELSE list_max(list_transform(list_filter(cs, lambda x: x.k = {m[1]} AND x.f > 0), lambda x: x.f)) END)"
    return re.sub(r"\{f\}\(([^)]*)\)", per, _P2)


SQL = {
    "p2_found": _p2_sql(),
    "p6_found": f"""
WITH s AS (
    SELECT 'change_feed' AS src, change_id::VARCHAR AS row_key, updated_at AS v, MAP {{'SIN': 'Asia/Singapore', 'OSL': 'Europe/Oslo', 'CHI': 'America/Chicago'}}[upper(trim(site))] AS home FROM change_feed
    UNION ALL SELECT 'local_record', external_id, updated_at_utc, NULL FROM local_record
    UNION ALL SELECT 'match_event', event_id::VARCHAR, created_at, NULL FROM match_event),
a AS (SELECT DISTINCT src, row_key, home, trim(v) AS v FROM s WHERE row_key IS NOT NULL AND NOT regexp_full_match(v, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ')),
b AS (SELECT *, CASE WHEN regexp_matches(v, ':\\d\\d.*{_TAIL}') OR regexp_full_match(v, '\\d{{8}}T\\d{{6}}Z') THEN regexp_extract(v, '{_TAIL}', 1) ELSE '' END AS z FROM a),
c AS (SELECT *, try_strptime(replace(regexp_replace(CASE WHEN z <> '' THEN regexp_replace(v, '{_TAIL}', '') ELSE v END, '^[A-Z][a-z]{{2}}, ', ''), ',', '.'), {_FORMATS}) AS ts,
    CASE WHEN regexp_matches(z, '^[+-]') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (regexp_replace(z, '[^0-9]', '', 'g')[1:2]::INT * 3600 + regexp_replace(z, '[^0-9]', '', 'g')[3:4]::INT * 60) ELSE {_NAMED}[z] END AS off FROM b),
d AS (SELECT *, timezone(home, ts) AS u FROM c),
e AS (SELECT src, row_key, CASE
    WHEN regexp_full_match(v, '\\d{{9,11}}') THEN v::BIGINT * 1000000 WHEN regexp_full_match(v, '\\d{{12,14}}') THEN v::BIGINT * 1000 WHEN regexp_full_match(v, '\\d{{15,17}}') THEN v::BIGINT
    WHEN z <> '' THEN epoch_us(ts) - off * 1000000::BIGINT
    WHEN home IS NULL THEN epoch_us(ts)
    WHEN timezone(home, u - INTERVAL 1 HOUR) = ts THEN epoch_us(u - INTERVAL 1 HOUR) ELSE epoch_us(u) END AS utc_us FROM d)
SELECT DISTINCT src, row_key, utc_us FROM e WHERE utc_us IS NOT NULL""",
    "p3_found": f"""
WITH l AS (
    SELECT DISTINCT line_id, tenant, customer_id, upper(regexp_replace(buyer_sku, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS code, {_DAY} AS d
    FROM order_lines_holdout),
m AS (
    SELECT DISTINCT tenant, customer_id, upper(regexp_replace(customer_sku, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS code, item_code, source, confidence,
        coalesce(try_cast(nullif(trim(valid_from), '') AS DATE), DATE '0001-01-01') AS f, coalesce(try_cast(nullif(trim(valid_to), '') AS DATE), DATE '9999-12-31') AS t
    FROM customer_sku_map),
j AS (
    SELECT l.line_id, m.item_code, row_number() OVER (PARTITION BY l.line_id ORDER BY m.f DESC, coalesce(m.confidence, 0) DESC, coalesce(m.source, '') DESC, m.item_code DESC) AS k
    FROM l JOIN m ON l.tenant = m.tenant AND l.customer_id = m.customer_id AND l.code = m.code AND l.code <> '' AND l.d BETWEEN m.f AND m.t)
SELECT line_id, item_code FROM j WHERE k = 1""",
    "p5_found": """
WITH c AS (
    SELECT upper(trim(external_id)) AS external_id, version, change_id, lower(trim(op)) AS op FROM change_feed
    WHERE trim(coalesce(external_id, '')) <> '' AND version IS NOT NULL AND change_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY version DESC, change_id) AS k FROM c)
SELECT external_id, version, change_id FROM r
WHERE k = 1 AND coalesce(op, '') NOT IN ('d', 'del', 'delete', 'deleted', 'remove', 'removed', 'rm')""",
}
