"""Attributes as known at event time, by snapshots and change logs.

Validity rows are cut at the start of each period (a month) into a snapshot of
what held at that instant, and a log of what began within the period. Both are
written, partitioned by period. An event reads the snapshot that precedes it and
replays only the log of its own period up to its day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.session import cut


def real_date(col: Column) -> Column:
    """A date from the forms order feeds use; null where there is no real date.

    Accepted: yyyy-MM-dd and yyyy/MM/dd (alone or with a time after T or a
    space), yyyyMMdd, d MMM yyyy, dd.MM.yyyy. Impossible dates are null.
    """
    t = F.trim(col)
    iso = F.regexp_extract(t, r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})(?:[T ].*)?$", 0)
    y, m, d = (F.regexp_extract(t, r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})(?:[T ].*)?$", k) for k in (1, 3, 4))
    join = lambda a, b, c: F.concat_ws("-", a, F.lpad(b, 2, "0"), F.lpad(c, 2, "0"))
    compact = r"^(\d{4})(\d{2})(\d{2})$"
    words = r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*\.?[ -](\d{4})$"
    dots = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    month = F.array_position(F.array(*(F.lit(n) for n in names)), F.lower(F.regexp_extract(t, words, 2))).cast("string")
    text = (
        F.when(iso != "", join(y, m, d))
        .when(t.rlike(compact), F.regexp_replace(t, compact, "$1-$2-$3"))
        .when(t.rlike(words), join(F.regexp_extract(t, words, 3), month, F.regexp_extract(t, words, 1)))
        .when(t.rlike(dots), join(F.regexp_extract(t, dots, 3), F.regexp_extract(t, dots, 2), F.regexp_extract(t, dots, 1)))
    )
    return text.try_cast("date")


def loose_code(col: Column) -> Column:
    """Letters and digits of a code, without case; null if it has none."""
    code = F.upper(F.regexp_replace(col, r"[^\p{L}\p{Nd}]", ""))
    return F.when(code != "", code)


def snapshots_and_log(rows: DataFrame, keys: list[str], first: object, last: object) -> tuple[DataFrame, DataFrame]:
    """Snapshots of the periods from ``first`` to ``last`` (first days of months), and the log of those periods.

    rows: keys, _from, _to, _tie, _value. A snapshot has what held at the start
    of its period and began before it. Of rows that end on one day only the best
    can ever be the answer, so they fold into one in a map-side combine; and a
    row that begins earlier than another and doesn't outlast it is left out.
    What a key has in one period is therefore bounded by the days rows can end
    on, however many versions the key has, and a hot key is no hot task.
    """
    best = F.max(F.struct("_from", "_tie", "_value")).alias("_best")
    start = F.greatest(F.add_months(F.trunc("_from", "month"), 1), F.lit(first))
    end = F.least(F.trunc("_to", "month"), F.lit(last))
    held = rows.where(start <= end).select(*keys, "_from", "_to", "_tie", "_value", F.explode(F.sequence(start, end, F.expr("INTERVAL 1 MONTH"))).alias("_period"))
    folded = held.groupBy(*keys, "_period", "_to").agg(best)
    longer = Window.partitionBy(*keys, "_period").orderBy(F.desc("_best")).rowsBetween(Window.unboundedPreceding, -1)
    stairs = folded.withColumn("_outlasts", F.max("_to").over(longer)).where(F.col("_outlasts").isNull() | (F.col("_to") > F.col("_outlasts")))
    log = rows.withColumn("_period", F.trunc("_from", "month")).where(F.col("_period").between(F.lit(first), F.lit(last)))
    log = log.groupBy(*keys, "_period", "_from", "_to").agg(best)
    return stairs.select(*keys, "_period", "_to", "_best"), log.select(*keys, "_period", "_to", "_best")


def asof_join(
    events: DataFrame,
    validity: DataFrame,
    keys: list[str],
    day: str,
    valid_from: str,
    valid_to: str,
    value: str,
    tie: list[Column] | None = None,
) -> DataFrame:
    """(keys, day, value): what each key had on each day that an event asks for.

    Both ends are included; a null start or end is open. Of several valid rows
    the one with the latest start holds, then the highest ``tie``, then the
    highest value, so the result doesn't depend on row order. Rows that end
    before they start are never valid. Events with a null key or day, and days
    on which nothing is valid, give no row. Each (key, day) is answered once,
    however many events ask, so a hot key costs no more than its days.

    Snapshots and the log are made for the months between the first and the last
    event, and written to the shared folder.
    """
    tie_cols = [*(tie or []), F.col(value)]
    has = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    start = F.coalesce(F.col(valid_from), F.lit("0001-01-01").cast("date"))
    end = F.coalesce(F.col(valid_to), F.lit("9999-12-31").cast("date"))
    rows = (
        validity.where(has & F.col(value).isNotNull())
        .select(*keys, start.alias("_from"), end.alias("_to"), F.struct(*tie_cols).alias("_tie"), F.col(value).alias("_value"))
        .where("_from <= _to")
    )
    asked = events.where(has & F.col(day).isNotNull()).select(*keys, F.col(day).alias("_day")).distinct()
    asked = cut(asked.withColumn("_period", F.trunc("_day", "month")), "asked")
    first, last = asked.agg(F.min("_period"), F.max("_period")).first()
    if first is None:
        return asked.select(*keys, F.col("_day").alias(day), F.lit(None).cast(validity.schema[value].dataType).alias(value))
    snapshots, log = (cut(x, name, ["_period"], rebalance=True) for x, name in zip(snapshots_and_log(rows, keys, first, last), ("snapshots", "log"), strict=True))
    known = snapshots.unionByName(log)
    hit = asked.join(known, [*keys, "_period"]).where("_best._from <= _day AND _to >= _day")
    return hit.groupBy(*keys, "_day").agg(F.max("_best").alias("_best")).select(*keys, F.col("_day").alias(day), F.col("_best._value").alias(value))


def items_by_buyer_code(lines: DataFrame, sku_map: DataFrame) -> DataFrame:
    """(line_id, item_code): the item the buyer's code meant on the order date."""
    keys = ["tenant", "customer_id", "code"]
    events = lines.select("line_id", "tenant", "customer_id", loose_code(F.col("buyer_sku")).alias("code"), real_date(F.col("order_date")).alias("day"))
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    rows = sku_map.select(
        "tenant", "customer_id", loose_code(F.col("customer_sku")).alias("code"),
        blank("valid_from").alias("f"), blank("valid_to").alias("t"), blank("item_code").alias("item_code"),
        F.col("confidence"), F.col("source"),
    )
    # a bound that is written but is no date can't be trusted either way
    rows = rows.select("*", real_date(F.col("f")).alias("vf"), real_date(F.col("t")).alias("vt")).where(
        "(f IS NULL OR vf IS NOT NULL) AND (t IS NULL OR vt IS NOT NULL)"
    )
    tie = [F.coalesce("confidence", F.lit(0.0)), F.coalesce("source", F.lit(""))]
    found = asof_join(events, rows, keys, "day", "vf", "vt", "item_code", tie)
    return events.join(found, [*keys, "day"]).select("line_id", "item_code").where("line_id IS NOT NULL").distinct()
