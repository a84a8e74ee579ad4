"""Queries over the match ledger: reports, percentiles, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.operators import evaluate, report
from orderloom.session import table


def _events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each event once, with the columns asked for (``day`` is that of created_at).

    Copies are equal in every column, so the key and the columns that are needed
    tell rows apart as well as all columns, and only these are shuffled.
    """
    e = table(spark, sf_dir, "match_event").withColumn("day", report.day_of("created_at"))
    return report.distinct_rows(e.select("event_id", *columns), "event_id")


def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.health_report(*(table(spark, sf_dir, t) for t in ("order_line", "match_event", "item")))


def prev_day_repeat_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "match_event").select("tenant_id", "item_code", report.day_of("created_at").alias("day"))
    return report.repeat_items(e)


def p95_cume_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "tenant_id", "day", "latency_ms").where("latency_ms >= 0")
    return report.p95(e, ["tenant_id", "day"], "latency_ms", "p95_latency_ms")


def p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "tenant_id", "stage", "latency_ms").where("latency_ms >= 0")
    return e.groupBy("tenant_id", "stage").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").cast("int").alias("p95_latency_ms"))


def conditional_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "tenant_id", "day", "line_id", "accepted")
    # a row per line first: no row is multiplied for a second distinct count
    per_line = e.groupBy("tenant_id", "day", "line_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("accepted") == 1).cast("int")).alias("hit"))
    known = F.col("line_id").isNotNull()
    return per_line.groupBy("tenant_id", "day").agg(
        F.count(F.when(known & (F.col("hit") == 1), 1)).alias("lines_accepted"), F.count(F.when(known, 1)).alias("lines_seen"), F.sum("n").alias("events")
    )


def accepted_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.accepted_disabled(_events(spark, sf_dir, "tenant_id", "day", "item_code", "accepted"), table(spark, sf_dir, "item"))


def _tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best item of each line, its lead, and whether any event of it was accepted."""
    e = table(spark, sf_dir, "match_event").where("score BETWEEN 0 AND 1 AND NOT isnan(score) AND line_id IS NOT NULL AND item_code IS NOT NULL")
    best = e.groupBy("line_id", "item_code").agg(F.max("score").alias("confidence"), F.max("accepted").alias("accepted"))
    return evaluate.top_two(best, "line_id", "confidence", "item_code", "accepted")


def margin_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tops(spark, sf_dir).select("line_id", "item_code", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"))


def operating_point_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _tops(spark, sf_dir).select(F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), (F.col("accepted") == 1).alias("correct"))
    return evaluate.sweep(d)


def select_operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_point(operating_point_sweep(spark, sf_dir), 0.5)


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _tops(spark, sf_dir).select(F.round("confidence", 4).alias("confidence"), F.col("accepted").alias("correct"))
    return evaluate.calibration(spark, d)


def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets: by tenant, by stage, over all."""
    e = _events(spark, sf_dir, "tenant_id", "stage", "accepted")
    n, k = F.col("events"), F.col("accepted")
    tenant, stage = F.col("tenant_id"), F.col("stage")
    sets = e.groupingSets([["tenant_id"], ["stage"], []], "tenant_id", "stage").agg(
        F.grouping_id().cast("int").alias("grain"), F.count(F.lit(1)).alias("events"), F.sum(F.when(F.col("accepted") == 1, 1).otherwise(0)).alias("accepted")
    )
    out = sets.select(F.coalesce(tenant, F.lit("")).alias("tenant_id"), F.coalesce(stage, F.lit("")).alias("stage"), "grain", "events", "accepted")
    return out.withColumn("share", evaluate.safe_divide(k, n)).withColumn("wilson_lower", F.round(evaluate.wilson_lower(k, n), 8))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the accepted share, tenants drawn as wholes."""
    per = _events(spark, sf_dir, "tenant_id", "accepted").where("tenant_id IS NOT NULL").groupBy("tenant_id").agg(F.sum(F.when(F.col("accepted") == 1, 1).otherwise(0)).alias("hits"), F.count(F.lit(1)).alias("total"))
    # one row per tenant: the number of groups, not of rows, goes through one task
    from pyspark.sql import Window

    slots = per.withColumn("slot", (F.row_number().over(Window.orderBy("tenant_id")) - 1).cast("long"))
    return evaluate.bootstrap(slots.select("slot", "hits", "total"))


QUERIES = {
    f.__name__: f
    for f in (
        health_report, prev_day_repeat_items, p95_cume_dist, p95_nearest_rank, conditional_distinct, accepted_disabled, margin_rank,
        operating_point_sweep, select_operating_point, calibration_bins, metrics_by_group, bootstrap_ci,
    )
}

_EV = "(SELECT DISTINCT *, substr(created_at, 1, 10) AS day FROM match_event)"
_TOP = """
b AS (SELECT line_id, item_code, max(score) AS confidence, max(accepted) AS accepted FROM match_event
      WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) AND line_id IS NOT NULL AND item_code IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY confidence DESC, item_code) AS k,
      lead(confidence) OVER (PARTITION BY line_id ORDER BY confidence DESC, item_code) AS nxt FROM b),
t AS (SELECT line_id, item_code, round(confidence, 6) AS confidence, round(confidence - coalesce(nxt, 0), 6) AS margin, accepted FROM r WHERE k = 1)"""
_GRID = f"""
g AS (SELECT c AS confidence_limit, m AS margin_limit FROM unnest({evaluate.CONFIDENCES}::DOUBLE[]) AS x(c), unnest({evaluate.MARGINS}::DOUBLE[]) AS y(m)),
p AS (SELECT confidence_limit, margin_limit, count(line_id) AS passed, coalesce(sum(CASE WHEN accepted = 1 THEN 1 ELSE 0 END) FILTER (line_id IS NOT NULL), 0)::BIGINT AS correct
      FROM g LEFT JOIN t ON t.confidence >= confidence_limit AND t.margin >= margin_limit GROUP BY ALL),
s AS (SELECT *, CASE WHEN passed > 0 THEN correct::DOUBLE / passed ELSE 0 END AS precision FROM p)"""
_BEFORE = "strftime(try_cast(a.day AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d')"

SQL = {
    "health_report": f"""
WITH l AS (SELECT DISTINCT line_id, tenant_id, customer_id, channel, substr(created_at, 1, 10) AS day FROM order_line WHERE line_id IS NOT NULL),
e AS {_EV},
g AS (SELECT tenant_id, channel, day, count(DISTINCT line_id) AS lines_total, count(DISTINCT customer_id) AS distinct_customers FROM l GROUP BY ALL),
s AS (SELECT e.*, l.channel, CASE WHEN latency_ms >= 0 THEN latency_ms END AS latency FROM e JOIN l USING (line_id)),
c AS (SELECT tenant_id, channel, day, count(DISTINCT CASE WHEN accepted = 1 THEN line_id END) AS lines_accepted, count(*) AS candidates_considered FROM s GROUP BY ALL),
d AS (SELECT tenant_id, day, sum(CASE WHEN accepted = 1 AND score BETWEEN 0 AND 1 AND NOT isnan(score) THEN round(score * 10000)::BIGINT END)::DOUBLE
        / nullif(count(*) FILTER (accepted = 1 AND score BETWEEN 0 AND 1 AND NOT isnan(score)), 0) / 10000 AS avg_accept_score,
        max(latency)::DOUBLE AS max_latency_ms, sum(latency)::DOUBLE / nullif(count(latency), 0) AS avg_latency_ms FROM s GROUP BY ALL),
q AS (SELECT tenant_id, day, quantile_disc(latency, 0.95)::DOUBLE AS p95_latency_ms FROM s WHERE latency IS NOT NULL GROUP BY ALL),
x AS (SELECT tenant_id, day, count(*) AS accepted_disabled FROM s WHERE accepted = 1 AND EXISTS (SELECT 1 FROM item i WHERE i.tenant_id = s.tenant_id AND i.item_code = s.item_code AND i.disabled = 1) GROUP BY ALL),
di AS (SELECT DISTINCT tenant_id, day, item_code FROM e),
rp AS (SELECT a.tenant_id, a.day, count(*) AS repeat_items_prev_day FROM di a JOIN di b ON a.tenant_id = b.tenant_id AND a.item_code = b.item_code AND b.day = {_BEFORE} GROUP BY ALL)
SELECT g.tenant_id, g.channel, g.day, lines_total, coalesce(lines_accepted, 0) AS lines_accepted, coalesce(candidates_considered, 0) AS candidates_considered, avg_accept_score,
    max_latency_ms, p95_latency_ms, avg_latency_ms, distinct_customers, coalesce(repeat_items_prev_day, 0) AS repeat_items_prev_day, coalesce(accepted_disabled, 0) AS accepted_disabled
FROM g LEFT JOIN c USING (tenant_id, channel, day) LEFT JOIN d USING (tenant_id, day) LEFT JOIN q USING (tenant_id, day) LEFT JOIN x USING (tenant_id, day) LEFT JOIN rp USING (tenant_id, day)""",
    "prev_day_repeat_items": f"""
WITH di AS (SELECT DISTINCT tenant_id, substr(created_at, 1, 10) AS day, item_code FROM match_event)
SELECT a.tenant_id, a.day, count(*) AS repeat_items_prev_day FROM di a JOIN di b ON a.tenant_id = b.tenant_id AND a.item_code = b.item_code AND b.day = {_BEFORE} GROUP BY ALL""",
    "p95_cume_dist": f"""
WITH r AS (SELECT tenant_id, day, latency_ms, cume_dist() OVER (PARTITION BY tenant_id, day ORDER BY latency_ms) AS f FROM {_EV} WHERE latency_ms >= 0)
SELECT tenant_id, day, min(latency_ms) AS p95_latency_ms FROM r WHERE f >= 0.95 GROUP BY ALL""",
    "p95_nearest_rank": f"SELECT tenant_id, stage, quantile_disc(latency_ms, 0.95) AS p95_latency_ms FROM {_EV} WHERE latency_ms >= 0 GROUP BY ALL",
    "conditional_distinct": f"""
SELECT tenant_id, day, count(DISTINCT CASE WHEN accepted = 1 THEN line_id END) AS lines_accepted, count(DISTINCT line_id) AS lines_seen, count(*) AS events FROM {_EV} GROUP BY ALL""",
    "accepted_disabled": f"""
SELECT tenant_id, day, count(*) AS accepted_disabled FROM {_EV} s
WHERE accepted = 1 AND EXISTS (SELECT 1 FROM item i WHERE i.tenant_id = s.tenant_id AND i.item_code = s.item_code AND i.disabled = 1) GROUP BY ALL""",
    "margin_rank": f"WITH {_TOP} SELECT line_id, item_code, confidence, margin FROM t",
    "operating_point_sweep": f"WITH {_TOP}, {_GRID} SELECT * FROM s",
    "select_operating_point": f"""
WITH {_TOP}, {_GRID} SELECT * FROM s
ORDER BY precision >= 0.5 DESC, CASE WHEN precision >= 0.5 THEN passed ELSE 0 END DESC, precision DESC, passed DESC, confidence_limit DESC, margin_limit LIMIT 1""",
    "calibration_bins": f"""
WITH {_TOP},
u AS (SELECT round(confidence, 4) AS confidence, accepted FROM t),
e AS (SELECT unnest({evaluate.BINS}::DOUBLE[]) AS low, unnest({[*evaluate.BINS[1:], 1.0]}::DOUBLE[]) AS high)
SELECT low, high, count(confidence) AS n, coalesce(sum(round(confidence * 10000)::BIGINT)::DOUBLE / nullif(count(confidence), 0) / 10000, 0) AS mean_confidence,
    coalesce(sum(accepted)::DOUBLE / nullif(count(confidence), 0), 0) AS share_correct
FROM e LEFT JOIN u ON confidence >= low AND (confidence < high OR (high = 1.0 AND confidence <= 1.0)) GROUP BY low, high""",
    "metrics_by_group": f"""
WITH c AS (SELECT coalesce(tenant_id, '') AS tenant_id, coalesce(stage, '') AS stage, grouping_id(tenant_id, stage)::INT AS grain, count(*) AS events, sum(CASE WHEN accepted = 1 THEN 1 ELSE 0 END)::BIGINT AS accepted
    FROM {_EV} GROUP BY GROUPING SETS ((tenant_id), (stage), ())),
p AS (SELECT *, accepted::DOUBLE / events AS share, events::DOUBLE AS n FROM c)
SELECT tenant_id, stage, grain, events, accepted, share,
    round((share + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((share * (1 - share) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n), 8) AS wilson_lower FROM p""",
    "bootstrap_ci": f"""
WITH per AS (SELECT row_number() OVER (ORDER BY tenant_id) - 1 AS slot, sum(CASE WHEN accepted = 1 THEN 1 ELSE 0 END) AS hits, count(*) AS total FROM {_EV} WHERE tenant_id IS NOT NULL GROUP BY tenant_id),
g AS (SELECT count(*) AS g FROM per),
d AS (SELECT s, d, g FROM range(2000) AS a(s), g, range(100000) AS b(d) WHERE d < g),
m AS (SELECT s, sum(hits)::DOUBLE / sum(total) AS r FROM d JOIN per ON slot = (s * 7919 + d * 104729 + s * d * 31 + 1729) % g GROUP BY s),
k AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS k FROM m)
SELECT max(CASE WHEN k = 49 THEN r END) AS low, max(CASE WHEN k = 1949 THEN r END) AS high FROM k""",
}
