"""SQL twins of the matcher's queries."""

from __future__ import annotations

from orderloom.functions.text import AUDIT_PREFIXES, ERROR_TOKENS, NON_ITEM_LINES, NON_ITEM_PHRASES, ORDER_WORDS, REPLACEMENTS, UNIT_NAMES
from orderloom.operators.cow_table import DELETES
from orderloom.operators.lanes import MISC_NAMES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return ", ".join(_q(v) for v in values)


def _ascii(c: str) -> str:
    out = f"strip_accents(coalesce({c}, ''))"
    for ch, to in (("½", "12"), ("¼", "14"), ("¾", "34"), ("²", "2"), ("³", "3"), ("¹", "1"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        out = f"replace({out}, '{ch}', '{to}')"
    return f"regexp_replace({out}, '[^\\x00-\\x7F]', '', 'g')"


def _text(c: str) -> str:
    # no lookbehind here: the same replacement twice finds neighbours that share a character
    x = f"lower({_ascii(c)})"
    for _ in range(2):
        x = f"regexp_replace({x}, '([a-z0-9])x([0-9])', '\\1 x \\2', 'g')"
    x = f"array_to_string(regexp_extract_all({x}, '[a-z]+|\\d+(?:\\.\\d+)?'), ' ')"
    for word, to in REPLACEMENTS:
        x = f"regexp_replace({x}, '\\b{word}\\b', '{to}', 'g')"
    return x


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _order(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w NOT IN ({_list(ORDER_WORDS)}) AND w <> ''), ' ')"


def _key(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')"


def _unit(c: str) -> str:
    pairs = ", ".join(f"{_q(a)}: {_q(b)}" for a, b in UNIT_NAMES.items())
    return f"coalesce(MAP {{{pairs}}}[{_text(c)}], {_text(c)})"


_NON_ITEM = f"(t = '' OR regexp_matches(t, '{'|'.join(NON_ITEM_PHRASES)}') OR t IN ({_list(NON_ITEM_LINES)}))"
_MISC = f"(upper(trim(coalesce(item_name, ''))) IN ({_list(MISC_NAMES)}) OR trim(coalesce(brand, '')) = '' OR ends_with(lower(trim(coalesce(item_group, ''))), '> misc'))"
_BULK = "regexp_replace(coalesce(item_name, ''), '\\s*\\(Bulk\\)\\s*$', '')"
_SEARCH = "concat_ws(' ', item_name, description, brand, item_group)"
_L = "l AS (SELECT DISTINCT * FROM order_lines_holdout)"
_CAT = f"""cat AS (SELECT tenant, item_code, disabled <> '1' AS enabled, {_MISC} AS misc, {_key("item_code")} AS code_key, {_key("barcode")} AS barcode_key, {_key("manufacturer_part_no")} AS part_key,
    {_text(_BULK)} AS base, {_text("item_name")} AS name_text, {_text(_SEARCH)} AS search_text FROM (SELECT DISTINCT * FROM catalogue_item)),
live AS (SELECT * FROM cat WHERE enabled AND NOT misc)"""
_LANES = f"""
k AS (SELECT DISTINCT line_id, tenant, key FROM (SELECT line_id, tenant, unnest([{_key("buyer_sku")}, {_key("raw_barcode")}, {_key("raw_text")}] || regexp_extract_all(coalesce(raw_text, ''), '\\b\\d{{8,14}}\\b')) AS key FROM l) WHERE key <> ''),
lanes AS (
    SELECT DISTINCT line_id, item_code, 'item_code' AS lane FROM l JOIN live USING (tenant) WHERE live.code_key <> '' AND contains({_key("raw_text")}, live.code_key)
    UNION SELECT line_id, item_code, 'item_code' FROM k JOIN live ON k.tenant = live.tenant AND k.key = live.code_key
    UNION SELECT line_id, item_code, 'barcode' FROM k JOIN live ON k.tenant = live.tenant AND k.key = live.barcode_key
    UNION SELECT line_id, item_code, 'part_number' FROM k JOIN live ON k.tenant = live.tenant AND k.key = live.part_key)"""
_DAY = """CASE
    WHEN regexp_full_match(trim(order_date), '\\d{4}-\\d{2}-\\d{2}(T.*)?') THEN try_cast(substr(trim(order_date), 1, 10) AS DATE)
    WHEN regexp_full_match(trim(order_date), '\\d{4}/\\d{2}/\\d{2}') THEN try_cast(replace(trim(order_date), '/', '-') AS DATE)
    WHEN regexp_full_match(trim(order_date), '\\d{8}') THEN try_cast(substr(trim(order_date), 1, 4) || '-' || substr(trim(order_date), 5, 2) || '-' || substr(trim(order_date), 7, 2) AS DATE)
    WHEN regexp_full_match(trim(order_date), '\\d{1,2} [A-Za-z]{3} \\d{4}') THEN try_strptime(trim(order_date), '%d %b %Y')::DATE
    END"""
_ALIAS = f"""
tgt AS (SELECT item_code, max(enabled AND NOT misc) AS alive FROM cat GROUP BY 1),
ar AS (SELECT DISTINCT tenant, customer_id, {_key("customer_sku")} AS key, item_code, try_cast(nullif(trim(valid_from), '') AS DATE) AS vf, try_cast(nullif(trim(valid_to), '') AS DATE) AS vt, confidence, source FROM customer_sku_map),
al AS (SELECT line_id, ar.item_code, alive AS live, max((confidence, source)) AS b
    FROM (SELECT line_id, tenant, customer_id, {_key("buyer_sku")} AS key, {_DAY} AS d FROM l) x JOIN ar USING (tenant, customer_id, key) JOIN tgt ON tgt.item_code = ar.item_code
    WHERE x.key <> '' AND (vf IS NULL OR vf <= d) AND (vt IS NULL OR d <= vt) AND d IS NOT NULL GROUP BY ALL)"""


def _tfidf(grams: str) -> str:
    return f"""
docs AS (SELECT DISTINCT tenant, item_code AS id, search_text AS text FROM live),
asked AS (SELECT DISTINCT tenant, {_order(_text("concat_ws(' ', raw_text, notes)"))} AS id FROM l),
dt AS (SELECT tenant, id, gram, 1e0 + ln(count(*)) AS tf FROM (SELECT tenant, id, unnest({grams.format(x="text")}) AS gram FROM docs) GROUP BY ALL),
qt AS (SELECT tenant, id, gram, 1e0 + ln(count(*)) AS tf FROM (SELECT tenant, id, unnest({grams.format(x="id")}) AS gram FROM asked WHERE id <> '') GROUP BY ALL),
tot AS (SELECT tenant, count(DISTINCT id) AS total FROM docs GROUP BY 1),
idf AS (SELECT tenant, gram, ln((1e0 + any_value(total)) / (1e0 + count(*))) + 1 AS idf FROM dt JOIN tot USING (tenant) GROUP BY 1, 2),
dw AS (SELECT tenant, id, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY tenant, id)) AS w FROM dt JOIN idf USING (tenant, gram)),
qw AS (SELECT tenant, id, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY tenant, id)) AS w FROM qt JOIN idf USING (tenant, gram)),
sc AS (SELECT qw.tenant, qw.id AS q, dw.id AS item_code, round(sum(qw.w * dw.w), 8) AS score FROM qw JOIN dw ON qw.tenant = dw.tenant AND qw.gram = dw.gram GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY tenant, q ORDER BY score DESC, item_code)::INT AS place FROM sc WHERE score > 0)"""


_W = "list_filter(string_split({x}, ' '), lambda w: length(w) >= 2)"
_WORD = f"({_W} || list_transform(list_zip({_W}[:-2], {_W}[2:]), lambda p: p[1] || ' ' || p[2]))"
_CHAR = (
    "flatten(list_transform(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: ' ' || w || ' '), lambda w: "
    + " || ".join(f"(CASE WHEN length(w) > {k} THEN list_transform(range(1, length(w) - {k} + 2), lambda i: substr(w, i, {k})) ELSE [] END)" for k in (3, 4, 5))
    + " || (CASE WHEN length(w) <= 5 THEN [w] ELSE [] END)))"
)
_WORD_TOP, _CHAR_TOP = _tfidf(_WORD), _tfidf(_CHAR)
_LATEST = f"""
c AS (SELECT upper(trim(external_id)) AS external_id, version, change_id, payload, coalesce(lower(trim(op)) IN ({_list(DELETES)}), false) AS deleted FROM change_feed
    WHERE trim(coalesce(external_id, '')) <> '' AND version IS NOT NULL AND change_id IS NOT NULL),
latest AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY version DESC, change_id) = 1),
mine AS (SELECT upper(trim(external_id)) AS external_id, max(remote_version) AS known, bool_or(dirty) AS dirty FROM local_record GROUP BY 1)"""
_CONV = f"""
i AS (SELECT DISTINCT * FROM catalogue_item),
p AS (SELECT tenant, item_code, {_unit("stock_uom")} AS stock, unnest(from_json(uom_conversions, '[{{"uom":"VARCHAR","conversion_factor":"DOUBLE"}}]')) AS c FROM i WHERE trim(coalesce(uom_conversions, '')) <> ''),
u AS (SELECT tenant, item_code, stock, {_unit("c.uom")} AS unit, c.conversion_factor AS factor FROM p)"""


def _profile(columns: dict[str, dict[str, bool]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {_q(t)} AS \"table\", {_q(c)} AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, {f'''count(*) FILTER (trim({c}) = '')''' if text else '0::BIGINT'} AS blanks FROM {t}"
        for t, cs in columns.items()
        for c, text in cs.items()
    )


_COLUMNS = {
    "catalogue_item": {c: c not in ("available_qty", "list_price") for c in "tenant item_code item_name description brand item_group stock_uom uom_conversions barcode manufacturer_part_no disabled available_qty list_price".split()},
    "customer_sku_map": {c: c != "confidence" for c in "tenant customer_id customer_sku item_code customer_description valid_from valid_to source confidence".split()},
    "order_lines_holdout": dict.fromkeys("line_id tenant customer_id channel order_date raw_text qty uom_text unit_price buyer_sku raw_barcode notes".split(), True),
    "order_line": dict.fromkeys("line_id tenant_id customer_id channel created_at raw_text".split(), True),
    "match_event": {c: c in ("tenant_id", "line_id", "item_code", "stage", "created_at") for c in "event_id tenant_id line_id item_code stage score rank accepted latency_ms created_at".split()},
    "item": {c: c != "disabled" for c in "tenant_id item_code item_name item_group disabled".split()},
    "change_feed": {c: c not in ("change_id", "version") for c in "change_id external_id op payload version updated_at site".split()},
    "local_record": {c: c not in ("remote_version", "dirty") for c in "external_id payload remote_version updated_at_utc dirty".split()},
}


def _lost(name: str, rows: str, key: str, target: str) -> str:
    return f"SELECT '{name}' AS \"check\", {key} AS key, count(*)::VARCHAR AS detail FROM {rows} WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM {target} WHERE {key} IS NOT NULL) GROUP BY {key}"


def _drift(c: str) -> str:
    share = lambda t: f"SELECT coalesce({c}, '') AS value, count(*) * 100::DOUBLE / (SELECT count(*) FROM {t}) AS s FROM {t} GROUP BY 1"
    return f"SELECT coalesce(a.value, b.value) AS value, coalesce(a.s, 0) AS share_a, coalesce(b.s, 0) AS share_b, abs(coalesce(a.s, 0) - coalesce(b.s, 0)) >= 5 AS moved, '{c}' AS \"column\" FROM ({share('la')}) a FULL JOIN ({share('lb')}) b ON a.value = b.value"


def _errors(table: str, key: str, columns: list[str]) -> str:
    test = lambda c: " OR ".join(f"contains(upper(coalesce({c}, '')), {_q(t)})" for t in ERROR_TOKENS)
    return " UNION ALL ".join(f"SELECT 'error_token' AS \"check\", {key} AS key, '{c}' AS detail FROM (SELECT DISTINCT * FROM {table}) WHERE {test(c)}" for c in columns if c != key)


SQL = {
    "text_normalise": f"""
WITH {_L}, x AS (SELECT line_id, {_text("raw_text")} AS text, array_to_string(regexp_extract_all(lower({_ascii("raw_text")}), '[a-z0-9]+'), ' ') AS a FROM l)
SELECT line_id, text, {_order("text")} AS order_text, regexp_replace(a, '^(?:{"|".join(AUDIT_PREFIXES)})', '') AS audit_text FROM x""",
    "identifier_normalise": f"""
SELECT item_code, {_key("item_code")} AS item_code_key, {_key("barcode")} AS barcode_key, {_key("manufacturer_part_no")} AS manufacturer_part_no_key, {_unit("stock_uom")} AS unit FROM (SELECT DISTINCT * FROM catalogue_item)""",
    "token_sets": f"""
WITH {_CAT}, s AS (SELECT item_code, string_split(name_text, ' ') AS w FROM cat)
SELECT item_code, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x <> ''))), '|') AS tokens,
    array_to_string(list_sort(list_distinct(flatten(list_transform(list_filter(range(1, len(w) + 1), lambda i: regexp_matches(w[i], '[0-9]')),
        lambda i: CASE WHEN w[i + 1] IN ('mm', 'cm', 'm', 'kilogram', 'g', 'ml', 'l') THEN [w[i], w[i] || w[i + 1]] ELSE [w[i]] END)))), '|') AS numbers FROM s""",
    "non_item_filter": f"WITH {_L}, x AS (SELECT line_id, {_text('raw_text')} AS t FROM l) SELECT line_id FROM x WHERE {_NON_ITEM}",
    "error_token_scan": _errors("order_lines_holdout", "line_id", list(_COLUMNS["order_lines_holdout"])) + " UNION ALL " + _errors("catalogue_item", "item_code", [c for c, text in _COLUMNS["catalogue_item"].items() if text]),
    "segment_case": f"""
WITH {_L}, x AS (SELECT *, {_text("raw_text")} AS t FROM l), y AS (SELECT *, {_words("t")} AS w FROM x)
SELECT tenant, channel, CASE WHEN trim(coalesce(buyer_sku, '')) <> '' OR trim(coalesce(raw_barcode, '')) <> '' THEN 'identifier_present' WHEN {_NON_ITEM} THEN 'non_item_like'
    WHEN trim(coalesce(uom_text, '')) <> '' OR list_has_any(w, ['box', 'carton', 'packet', 'pack', 'outer', 'dozen']) THEN 'pack_or_uom' WHEN len(w) <= 3 THEN 'sparse_text'
    WHEN regexp_matches(coalesce(raw_text, ''), '[/#_]|  ') THEN 'noisy_text' ELSE 'plain_text' END AS segment, count(*) AS lines FROM y GROUP BY ALL""",
    "exact_lanes": f"WITH {_L}, {_CAT}, {_LANES} SELECT * FROM lanes",
    "alias_interval_join": f"WITH {_L}, {_CAT}, {_ALIAS} SELECT line_id, item_code, live, b[1] AS confidence, b[2] AS source FROM al",
    "identifier_conflict": f"""
WITH {_L}, {_CAT}, {_LANES}, {_ALIAS}
SELECT line_id, count(DISTINCT item_code) AS targets FROM (SELECT line_id, item_code FROM lanes UNION SELECT line_id, item_code FROM al WHERE live) GROUP BY 1 HAVING count(DISTINCT item_code) > 1""",
    "active_twins": f"WITH {_CAT}, d AS (SELECT DISTINCT tenant, base, item_code FROM live) SELECT *, count(*) OVER (PARTITION BY tenant, base) AS twins FROM d QUALIFY count(*) OVER (PARTITION BY tenant, base) > 1",
    "alias_collisions": f"""
SELECT tenant, customer_id, {_key("customer_sku")} AS key, count(DISTINCT item_code) AS codes,
    count(DISTINCT CASE WHEN coalesce(trim(valid_from), '') <= '2026-08-31' AND (coalesce(trim(valid_to), '') = '' OR trim(valid_to) >= '2026-08-31') THEN item_code END) AS current_codes
FROM customer_sku_map GROUP BY 1, 2, 3 HAVING count(DISTINCT item_code) > 1""",
    "lane_quality": f"""
WITH {_L}, {_CAT}, {_LANES}, one AS (SELECT lane, line_id, min(item_code) AS item_code FROM lanes GROUP BY 1, 2 HAVING count(DISTINCT item_code) = 1),
t AS (SELECT line_id, min(item_code) AS truth FROM order_line_label GROUP BY 1)
SELECT lane, count(*) AS answered, count(*) FILTER (item_code = truth) AS "right", count(*) FILTER (item_code = truth)::DOUBLE / count(*) AS precision FROM one JOIN t USING (line_id) GROUP BY 1""",
    "tfidf_word_topk": f"WITH {_L}, {_CAT}, {_WORD_TOP} SELECT tenant, q, item_code, score, place FROM rk WHERE place <= 20",
    "tfidf_char_topk": f"WITH {_L}, {_CAT}, {_CHAR_TOP} SELECT tenant, q, item_code, score, place FROM rk WHERE place <= 20",
    "recall_at_k": f"""
WITH {_L}, {_CAT}, {_WORD_TOP}, t AS (SELECT line_id, min(item_code) AS item_code FROM order_line_label GROUP BY 1),
x AS (SELECT line_id, tenant, {_order(_text("concat_ws(' ', raw_text, notes)"))} AS q, t.item_code FROM l JOIN t USING (line_id))
SELECT x.tenant, count(*) AS lines, count(*) FILTER (place <= 1) AS top1, count(*) FILTER (place <= 3) AS top3, count(*) FILTER (place <= 20) AS top20
FROM x LEFT JOIN rk ON rk.tenant = x.tenant AND rk.q = x.q AND rk.item_code = x.item_code GROUP BY 1""",
    "fk_violations": " UNION ALL ".join([
        _lost("alias_item", "customer_sku_map", "item_code", "catalogue_item"), _lost("label_item", "order_line_label", "item_code", "catalogue_item"), _lost("label_line", "order_line_label", "line_id", "order_lines_holdout"),
        _lost("event_line", "match_event", "line_id", "order_line"), _lost("event_item", "match_event", "item_code", "item"),
    ]),
    "duplicate_groups": f"""
WITH {_CAT}
SELECT 'catalogue_code' AS "check", concat_ws('|', tenant, item_code) AS key, count(*)::VARCHAR AS detail FROM (SELECT DISTINCT * FROM catalogue_item) GROUP BY tenant, item_code HAVING count(*) > 1
UNION ALL SELECT 'live_barcode', concat_ws('|', tenant, barcode_key), count(*)::VARCHAR FROM (SELECT DISTINCT tenant, barcode_key, item_code FROM live WHERE barcode_key <> '') GROUP BY tenant, barcode_key HAVING count(*) > 1
UNION ALL SELECT 'live_name', concat_ws('|', tenant, name_text), count(*)::VARCHAR FROM (SELECT DISTINCT tenant, name_text, item_code FROM live) GROUP BY tenant, name_text HAVING count(*) > 1
UNION ALL SELECT 'order_line', line_id, count(*)::VARCHAR FROM (SELECT DISTINCT * FROM order_lines_holdout) GROUP BY line_id HAVING count(*) > 1""",
    "count_of_counts": f"WITH {_CONV} SELECT units, count(*) AS items FROM (SELECT item_code, count(*) AS units FROM u GROUP BY 1) GROUP BY 1",
    "unit_checks": f"""
WITH {_CONV}
SELECT 'no_conversions' AS "check", item_code AS key, '' AS detail FROM i WHERE trim(coalesce(uom_conversions, '')) = ''
UNION ALL SELECT 'unreadable_conversions', item_code, '' FROM i WHERE trim(coalesce(uom_conversions, '')) <> '' AND NOT json_valid(uom_conversions)
UNION ALL SELECT 'factor_not_positive', item_code, unit FROM u WHERE factor IS NULL OR factor <= 0
UNION ALL SELECT 'stock_unit_count', item_code, count(*) FILTER (unit = stock AND factor = 1)::VARCHAR FROM u GROUP BY item_code HAVING count(*) FILTER (unit = stock AND factor = 1) <> 1""",
    "schema_profile": _profile(_COLUMNS),
    "distinct_profile": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(DISTINCT {c}) AS values FROM {t} HAVING count({c}) > 0" for t in ("order_lines_holdout", "item", "customer_sku_map") for c in _COLUMNS[t]),
    "category_drift": f"WITH {_L}, la AS (SELECT * FROM l WHERE line_id IN (SELECT line_id FROM order_line_label)), lb AS (SELECT * FROM l WHERE line_id NOT IN (SELECT line_id FROM order_line_label)) " + " UNION ALL ".join(_drift(c) for c in ("tenant", "channel", "uom_text")),
    "median_profile": f"""
WITH {_L}, x AS (SELECT tenant, {_text("raw_text")} AS t, order_date, qty FROM l), y AS (SELECT *, length(t) AS size, len({_words("t")}) AS words FROM x)
SELECT tenant, sum(size)::DOUBLE / count(*) AS mean_length, quantile_disc(size, 0.5)::BIGINT AS median_length, sum(words)::DOUBLE / count(*) AS mean_words, quantile_disc(words, 0.5)::BIGINT AS median_words,
    min(order_date) FILTER (trim(order_date) <> '') AS first_date, max(order_date) AS last_date, count(*) FILTER (trim(qty) <> '') AS with_qty FROM y GROUP BY 1""",
    "value_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", coalesce({c}, '') AS value, count(*) AS n FROM {t} GROUP BY 3" for t, c in [("customer_sku_map", "source"), ("customer_sku_map", "tenant"), ("order_lines_holdout", "channel"), ("catalogue_item", "stock_uom"), ("match_event", "stage")]),
    "feed_page_with_ties": """
WITH e AS (SELECT DISTINCT event_id, created_at FROM match_event WHERE regexp_full_match(created_at, '\\d{4}-\\d{2}-\\d{2}T[0-9:]{8}Z') AND created_at > '2026-05-01T00:00:00Z')
SELECT event_id, created_at FROM e WHERE created_at <= (SELECT max(created_at) FROM (SELECT created_at FROM e ORDER BY created_at LIMIT 100))""",
    "feed_conflicts": f"""
WITH {_LATEST}, lo AS (SELECT DISTINCT upper(trim(external_id)) AS external_id, remote_version AS local_version, dirty FROM local_record)
SELECT external_id, local_version, version AS remote_version, 'remote_changed_while_local_dirty' AS reason FROM lo JOIN latest USING (external_id) WHERE lo.dirty AND version > coalesce(local_version, -1)""",
    "feed_pull": f"""
WITH {_LATEST} SELECT external_id, CASE WHEN known IS NOT NULL AND version <= known THEN 'replay' WHEN coalesce(dirty, false) THEN 'conflict' ELSE 'upsert' END AS action, version FROM latest LEFT JOIN mine USING (external_id)""",
    "feed_invariants": f"""
WITH {_LATEST}, alive AS (SELECT * FROM latest WHERE NOT deleted)
SELECT 'missing' AS "check", external_id AS key, version::VARCHAR AS detail FROM alive WHERE external_id NOT IN (SELECT external_id FROM mine)
UNION ALL SELECT 'drift', external_id, known || '<' || version FROM alive JOIN mine USING (external_id) WHERE known < version AND NOT coalesce(dirty, false)""",
    "push_decisions": f"""
WITH {_LATEST}, r AS (SELECT * FROM latest WHERE NOT deleted), lo AS (SELECT upper(trim(external_id)) AS external_id, payload AS lp, coalesce(remote_version, 0) AS base, coalesce(dirty, false) AS d FROM local_record)
SELECT DISTINCT external_id, CASE WHEN NOT d THEN 'skip' WHEN version IS NULL THEN 'create' WHEN version > base AND lp IS NOT DISTINCT FROM payload THEN 'acknowledged' WHEN version > base THEN 'conflict' ELSE 'write' END AS decision
FROM lo LEFT JOIN r USING (external_id)""",
    "idempotency_key": """
SELECT external_id, substr(sha256('{"base_version":' || coalesce(remote_version, 0)::VARCHAR || ',"id":"' || external_id || '","payload":' || coalesce(payload, 'null') || '}'), 1, 32) AS key
FROM (SELECT DISTINCT external_id, payload, remote_version FROM local_record WHERE dirty)""",
    "utc_shift": """
WITH x AS (SELECT DISTINCT external_id, try_strptime(updated_at_utc, '%Y-%m-%d %H:%M:%S') AS t FROM local_record WHERE regexp_full_match(updated_at_utc, '\\d{4}-\\d{2}-\\d{2} [0-9:]{8}'))
SELECT external_id, strftime(t - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS utc, strftime(t - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS before FROM x WHERE t IS NOT NULL""",
}
