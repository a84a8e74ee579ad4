"""Reading side of a two-way sync: pages, overlap, conflicts, keys of logical writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.operators.cow_table import latest_changes, record_key


def local_to_utc(stamp: Column | str, offset: str = "+08:00") -> Column:
    """Stamp text of a fixed offset to stamp text in UTC; null if it is no stamp."""
    local = F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.date_format(F.to_utc_timestamp(local, offset), "yyyy-MM-dd HH:mm:ss")


def previous_second(stamp: Column | str) -> Column:
    """A cursor one second back, so rows that came late in the same second are read again."""
    return F.date_format(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")) - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd HH:mm:ss")


def page_with_ties(feed: DataFrame, order: str, size: int, since: str | None = None) -> DataFrame:
    """The first ``size`` rows after ``since`` in order of ``order``, and every further row of the last one's stamp.

    The driver sees one value, the boundary.
    """
    rows = feed.where(F.col(order).isNotNull() & (F.lit(True) if since is None else F.col(order) > since))
    last = rows.select(order).orderBy(order).limit(size).agg(F.max(order)).first()[0]
    return rows.where(F.col(order) <= last) if last is not None else rows


def conflicts(feed: DataFrame, local: DataFrame) -> DataFrame:
    """(external_id, local_version, remote_version, reason): changes that meet an edit made here.

    Versions not above the local one are replays and no conflict. Copied local
    rows count once.
    """
    remote = latest_changes(feed).select("external_id", F.col("version").alias("remote_version"))
    mine = local.select(record_key(F.col("external_id")).alias("external_id"), F.col("remote_version").alias("local_version"), "dirty").distinct()
    hit = mine.join(remote, "external_id").where("dirty AND remote_version > coalesce(local_version, -1)")
    return hit.select("external_id", "local_version", "remote_version", F.lit("remote_changed_while_local_dirty").alias("reason"))


def pull(feed: DataFrame, local: DataFrame) -> DataFrame:
    """(external_id, action, version): what a pull does with each remote record.

    upsert: newer here than known; replay: known already; conflict: edited here.
    """
    remote = latest_changes(feed)
    mine = local.groupBy(record_key(F.col("external_id")).alias("external_id")).agg(F.max("remote_version").alias("known"), F.max("dirty").alias("dirty"))
    both = remote.join(mine, "external_id", "left")
    action = F.when(F.col("known").isNotNull() & (F.col("version") <= F.col("known")), "replay").when(F.coalesce("dirty", F.lit(False)), "conflict").otherwise("upsert")
    return both.select("external_id", action.alias("action"), "version")


def push_decisions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(external_id, decision) of local edits against the remote state, before anything is sent.

    skip: nothing to send; create: unknown there; acknowledged: the write landed
    already (newer there, equal payload); conflict: changed there; write: send with
    the version known here.
    """
    r = remote.select(record_key(F.col("external_id")).alias("external_id"), F.col("version").alias("rv"), F.col("payload").alias("rp"), F.lit(True).alias("there"))
    both = local.withColumn("external_id", record_key(F.col("external_id"))).join(r, "external_id", "left")
    base = F.coalesce(F.col("remote_version"), F.lit(0))
    decision = (
        F.when(~F.coalesce("dirty", F.lit(False)), "skip")
        .when(F.col("there").isNull(), "create")
        .when((F.col("rv") > base) & F.col("payload").eqNullSafe(F.col("rp")), "acknowledged")
        .when(F.col("rv") > base, "conflict")
        .otherwise("write")
    )
    return both.select("external_id", decision.alias("decision")).distinct()


def idempotency_key(external_id: Column, payload: Column, base_version: Column) -> Column:
    """A stable key of one logical write: 32 hex digits of a hash over its canonical JSON (fields in order of name)."""
    body = F.concat(F.lit('{"base_version":'), base_version.cast("string"), F.lit(',"id":"'), external_id, F.lit('","payload":'), F.coalesce(payload, F.lit("null")), F.lit("}"))
    return F.substring(F.sha2(body, 256), 1, 32)


def invariants(feed: DataFrame, local: DataFrame) -> DataFrame:
    """(check, key, detail): records missing here, and records older here without a conflict."""
    remote = latest_changes(feed).where("NOT deleted")
    mine = local.groupBy(record_key(F.col("external_id")).alias("external_id")).agg(F.max("remote_version").alias("known"), F.max("dirty").alias("dirty"))
    missing = remote.join(mine, "external_id", "left_anti").select(F.lit("missing").alias("check"), F.col("external_id").alias("key"), F.col("version").cast("string").alias("detail"))
    old = remote.join(mine, "external_id").where("known < version AND NOT coalesce(dirty, false)")
    return missing.unionByName(old.select(F.lit("drift").alias("check"), F.col("external_id").alias("key"), F.concat_ws("<", "known", "version").alias("detail")))
