"""The health report of a match ledger, at two grains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.session import cut


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows that are copied in every column, once; rows without key are dropped.

    A distinct over all columns aggregates by hash, where one row per key picked
    from structs would sort.
    """
    return df.where(F.col(key).isNotNull()).distinct()


def day_of(stamp: Column | str) -> Column:
    """The day bucket of an ISO stamp, as text: impossible days stay what they are."""
    return F.substring(stamp, 1, 10)


def previous_day(day: Column | str) -> Column:
    """The day before a text day; null if there is no such day."""
    return F.date_format(F.date_sub(F.col(day).try_cast("date") if isinstance(day, str) else day.try_cast("date"), 1), "yyyy-MM-dd")


def repeat_items(events: DataFrame) -> DataFrame:
    """(tenant_id, day, n): items that a tenant's events also named the day before.

    Distinct (tenant, day, item) first, so the semi-join sees each once.
    """
    items = events.select("tenant_id", "day", "item_code").where("tenant_id IS NOT NULL AND item_code IS NOT NULL").distinct()
    before = items.select("tenant_id", "item_code", F.col("day").alias("prev"))
    hit = items.withColumn("prev", previous_day("day")).join(before, ["tenant_id", "item_code", "prev"], "left_semi")
    return hit.groupBy("tenant_id", "day").agg(F.count(F.lit(1)).alias("repeat_items_prev_day"))


def accepted_disabled(events: DataFrame, items: DataFrame) -> DataFrame:
    """(tenant_id, day, n): accepted events on disabled items; both sides filtered before the join."""
    off = items.where("disabled = 1").select("tenant_id", "item_code").distinct()
    hit = events.where("accepted = 1").join(off, ["tenant_id", "item_code"], "left_semi")
    return hit.groupBy("tenant_id", "day").agg(F.count(F.lit(1)).alias("accepted_disabled"))


def p95(events: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Nearest-rank 95th percentile per group, from counts of each value.

    The smallest value at which the cumulative distribution reaches 0.95. Equal
    values are counted before they are ordered, so a huge group orders its
    distinct values only.
    """
    counts = events.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("run", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w))
    return run.where(F.col("run") * 100 >= F.col("all") * 95).groupBy(*keys).agg(F.min(value).alias(name))


def health_report(lines: DataFrame, events: DataFrame, items: DataFrame, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """One row per tenant, channel and day of the lines; measures of both grains.

    Lines count by their own day, events by theirs, and only events whose line
    is reported. Lines without tenant, channel or day are reported, but no event
    is theirs, since null equals nothing. Copied rows count once. Latencies that are null or negative and
    scores outside 0 to 1 are no measurements. first_day and last_day, both
    included, bound the report; unset, all days are in it. The day before the
    first is read for the comparison with the previous day.
    """
    line = distinct_rows(lines.select("line_id", "tenant_id", "customer_id", "channel", day_of("created_at").alias("day")), "line_id")
    event = distinct_rows(events.select("event_id", "tenant_id", "line_id", "item_code", "score", "accepted", "latency_ms", day_of("created_at").alias("day")), "event_id")
    inside = lambda c: (F.lit(True) if first_day is None else F.col(c) >= first_day) & (F.lit(True) if last_day is None else F.col(c) <= last_day)
    line = line.where(inside("day"))
    groups = line.groupBy("tenant_id", "channel", "day").agg(F.count_distinct("line_id").alias("lines_total"), F.count_distinct("customer_id").alias("distinct_customers"))

    # written once, narrow, with the channel of the reported line; all measures read it
    known = line.select("line_id", "channel", F.lit(True).alias("reported"))
    event = cut(event.join(known, "line_id", "left"), "events")
    seen = event.where("reported")
    score = F.when((F.col("accepted") == 1) & F.col("score").between(0, 1) & ~F.isnan("score"), F.round(F.col("score") * 10000).cast("long"))
    latency = F.when(F.col("latency_ms") >= 0, F.col("latency_ms").cast("long"))
    measured = seen.withColumn("latency", latency)
    # one pass over the events: a row per line and day, from which both grains are summed;
    # whole numbers are summed and divided once, so the mean doesn't depend on the order of rows
    per_line = measured.groupBy("tenant_id", "channel", "day", "line_id").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("accepted") == 1).cast("int")).alias("accepted"), F.sum(score).alias("score"), F.count(score).alias("scores"),
        F.max("latency").alias("longest"), F.sum("latency").alias("latency"), F.count("latency").alias("latencies"),
    )
    per_channel = cut(per_line.groupBy("tenant_id", "channel", "day").agg(
        F.sum("accepted").alias("lines_accepted"), F.sum("n").alias("candidates_considered"), *(F.sum(c).alias(c) for c in ("score", "scores", "latency", "latencies")), F.max("longest").alias("longest")
    ), "channels")
    by_channel = per_channel.select("tenant_id", "channel", "day", "lines_accepted", "candidates_considered")
    by_day = per_channel.groupBy("tenant_id", "day").agg(
        (F.sum("score") / F.sum("scores") / 10000).alias("avg_accept_score"), F.max("longest").alias("max_latency_ms"), (F.sum("latency") / F.sum("latencies")).alias("avg_latency_ms")
    )
    out = (
        groups.join(by_channel, ["tenant_id", "channel", "day"], "left")
        .join(by_day, ["tenant_id", "day"], "left")
        .join(p95(measured, ["tenant_id", "day"], "latency", "p95_latency_ms"), ["tenant_id", "day"], "left")
        .join(accepted_disabled(seen, items), ["tenant_id", "day"], "left")
        .join(repeat_items(event), ["tenant_id", "day"], "left")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "tenant_id", "channel", "day", "lines_total", zero("lines_accepted"), zero("candidates_considered"), "avg_accept_score", F.col("max_latency_ms").cast("double"),
        F.col("p95_latency_ms").cast("double"), "avg_latency_ms", "distinct_customers", zero("repeat_items_prev_day"), zero("accepted_disabled"),
    )
