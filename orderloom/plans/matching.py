"""Queries of the record matcher: normalised texts, lanes, retrieval, checks, sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions import text as T
from orderloom.operators import evaluate, feed, fuzzy, lanes, quality, tfidf
from orderloom.operators.cow_table import latest_changes
from orderloom.session import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "order_lines_holdout").distinct()


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.catalogue(table(spark, sf_dir, "catalogue_item"))


# texts ---------------------------------------------------------------------


def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir)
    return d.select("line_id", T.normalise_text(F.col("raw_text")).alias("text"), T.normalise_order_text(F.col("raw_text")).alias("order_text"), T.audit_text(F.col("raw_text")).alias("audit_text"))


def identifier_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "catalogue_item").distinct()
    return d.select("item_code", *(T.normalise_identifier(F.col(c)).alias(f"{c}_key") for c in ("item_code", "barcode", "manufacturer_part_no")), T.normalise_unit(F.col("stock_uom")).alias("unit"))


def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _items(spark, sf_dir)
    join = lambda c: F.array_join(c, "|")
    return d.select("item_code", join(T.token_set(F.col("name_text"))).alias("tokens"), join(T.numeric_tokens(F.col("name_text"))).alias("numbers"))


def non_item_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).select("line_id", T.normalise_text(F.col("raw_text")).alias("t"))
    return d.where(T.is_non_item(F.col("t"))).select("line_id")


def error_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.error_cells(_lines(spark, sf_dir), "line_id").unionByName(quality.error_cells(table(spark, sf_dir, "catalogue_item").distinct(), "item_code"))


def segment_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).withColumn("t", T.normalise_text(F.col("raw_text")))
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    kind = T.segment(F.col("raw_text"), F.col("t"), given("buyer_sku") | given("raw_barcode"), F.col("uom_text"), F.lit(False))
    return d.groupBy("tenant", "channel", kind.alias("segment")).agg(F.count(F.lit(1)).alias("lines"))


# lanes ---------------------------------------------------------------------


def exact_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.identifier_lanes(_lines(spark, sf_dir), _items(spark, sf_dir))


def alias_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.alias_lane(_lines(spark, sf_dir), table(spark, sf_dir, "customer_sku_map"), _items(spark, sf_dir))


def identifier_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, items = _lines(spark, sf_dir), _items(spark, sf_dir)
    return lanes.identifier_conflicts(lanes.identifier_lanes(lines, items), lanes.alias_lane(lines, table(spark, sf_dir, "customer_sku_map"), items))


def active_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.active_twins(_items(spark, sf_dir))


def alias_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.alias_collisions(table(spark, sf_dir, "customer_sku_map"), F.lit("2026-08-31"))


def lane_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each exact lane: labelled lines it answers with one item, and how many rightly."""
    hits = exact_lanes(spark, sf_dir)
    one = hits.groupBy("lane", "line_id").agg(F.count_distinct("item_code").alias("n"), F.min("item_code").alias("item_code")).where("n = 1")
    label = table(spark, sf_dir, "order_line_label").groupBy("line_id").agg(F.min("item_code").alias("truth"))
    joined = one.join(label, "line_id").groupBy("lane").agg(F.count(F.lit(1)).alias("answered"), F.sum((F.col("item_code") == F.col("truth")).cast("long")).alias("right"))
    return joined.withColumn("precision", evaluate.safe_divide(F.col("right"), F.col("answered")))


# retrieval -------------------------------------------------------------------


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Query texts of the lines, and the live entries they are looked up in."""
    docs = _items(spark, sf_dir).where("enabled AND NOT misc").select("tenant", "item_code", F.col("search_text").alias("text"))
    queries = _lines(spark, sf_dir).select("tenant", T.normalise_order_text(F.concat_ws(" ", "raw_text", "notes")).alias("q"))
    return queries, docs


def _retrieved(spark: SparkSession, sf_dir: str, grams, k: int) -> DataFrame:
    return tfidf.top_k(*_asked(spark, sf_dir), grams, k)


def tfidf_word_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, tfidf.word_grams, 20)


def tfidf_char_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, tfidf.char_grams, 20)


def fuzzy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: neither engine has the ratio."""
    return fuzzy.top_k(*_asked(spark, sf_dir), 20)


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines whose item is among the first 1, 3 and 20 of the word lane."""
    hits = tfidf_word_topk(spark, sf_dir)
    label = table(spark, sf_dir, "order_line_label").groupBy("line_id").agg(F.min("item_code").alias("item_code"))
    lines = _lines(spark, sf_dir).select("line_id", "tenant", T.normalise_order_text(F.concat_ws(" ", "raw_text", "notes")).alias("q")).join(label, "line_id")
    place = lines.join(hits, ["tenant", "q", "item_code"], "left")
    top = lambda k: F.count(F.when(F.col("place") <= k, 1)).alias(f"top{k}")
    return place.groupBy("tenant").agg(F.count(F.lit(1)).alias("lines"), top(1), top(3), top(20))


# checks ------------------------------------------------------------------------


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, sku, label = (table(spark, sf_dir, t) for t in ("catalogue_item", "customer_sku_map", "order_line_label"))
    lines, ledger, events, items = (table(spark, sf_dir, t) for t in ("order_lines_holdout", "order_line", "match_event", "item"))
    miss = quality.missing_references
    return quality.union_all([
        miss("alias_item", sku, "item_code", cat, "item_code"), miss("label_item", label, "item_code", cat, "item_code"), miss("label_line", label, "line_id", lines, "line_id"),
        miss("event_line", events, "line_id", ledger, "line_id"), miss("event_item", events, "item_code", items, "item_code"),
    ])


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = _items(spark, sf_dir)
    live = cat.where("enabled AND NOT misc")
    return quality.union_all([
        quality.duplicate_keys("catalogue_code", table(spark, sf_dir, "catalogue_item"), ["tenant", "item_code"]),
        quality.duplicate_keys("live_barcode", live.where("barcode_key <> ''").select("tenant", "barcode_key", "item_code"), ["tenant", "barcode_key"]),
        quality.duplicate_keys("live_name", live.select("tenant", "name_text", "item_code"), ["tenant", "name_text"]),
        quality.duplicate_keys("order_line", table(spark, sf_dir, "order_lines_holdout"), ["line_id"]),
    ])


def count_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = quality.unit_rows(table(spark, sf_dir, "catalogue_item")).groupBy("tenant", "item_code").agg(F.count(F.lit(1)).alias("units"))
    return per.groupBy("units").agg(F.count(F.lit(1)).alias("items"))


def unit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unit_checks(table(spark, sf_dir, "catalogue_item"))


_PROFILED = ["catalogue_item", "customer_sku_map", "order_lines_holdout", "order_line", "match_event", "item", "change_feed", "local_record"]


def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_profile({t: table(spark, sf_dir, t) for t in _PROFILED})


def distinct_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.union_all([quality.distinct_profile(table(spark, sf_dir, t), t) for t in ("order_lines_holdout", "item", "customer_sku_map")])


def category_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    label = table(spark, sf_dir, "order_line_label").select("line_id").distinct()
    labelled, rest = lines.join(label, "line_id", "left_semi"), lines.join(label, "line_id", "left_anti")
    return quality.union_all([quality.drift(labelled, rest, c).withColumn("column", F.lit(c)) for c in ("tenant", "channel", "uom_text")])


def median_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).select("tenant", T.normalise_text(F.col("raw_text")).alias("t"), "order_date", "qty")
    size, words = F.length("t"), F.size(F.filter(F.split("t", " "), lambda w: w != ""))
    median = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").cast("long")
    d = d.select("tenant", size.cast("long").alias("size"), words.cast("long").alias("words"), "order_date", "qty")
    return d.groupBy("tenant").agg(
        (F.sum("size") / F.count(F.lit(1))).alias("mean_length"), median("size").alias("median_length"), (F.sum("words") / F.count(F.lit(1))).alias("mean_words"), median("words").alias("median_words"),
        F.min(F.when(F.trim("order_date") != "", F.col("order_date"))).alias("first_date"), F.max("order_date").alias("last_date"), F.count(F.when(F.trim("qty") != "", 1)).alias("with_qty"),
    )


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("customer_sku_map", "source"), ("customer_sku_map", "tenant"), ("order_lines_holdout", "channel"), ("catalogue_item", "stock_uom"), ("match_event", "stage")]
    return quality.union_all([
        table(spark, sf_dir, t).groupBy(F.coalesce(c, F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), F.lit(c).alias("column"), "value", "n") for t, c in parts
    ])


# sync --------------------------------------------------------------------------


def feed_page_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a hundred ledger events and all that share the last one's second (the page size is the feature)."""
    e = table(spark, sf_dir, "match_event").where("created_at RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z$'").select("event_id", "created_at").distinct()
    return feed.page_with_ties(e, "created_at", 100, "2026-05-01T00:00:00Z")


def feed_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.conflicts(table(spark, sf_dir, "change_feed"), table(spark, sf_dir, "local_record"))


def feed_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.pull(table(spark, sf_dir, "change_feed"), table(spark, sf_dir, "local_record"))


def feed_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.invariants(table(spark, sf_dir, "change_feed"), table(spark, sf_dir, "local_record"))


def push_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.push_decisions(table(spark, sf_dir, "local_record"), latest_changes(table(spark, sf_dir, "change_feed")).where("NOT deleted"))


def idempotency_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "local_record").where("dirty").select("external_id", "payload", "remote_version").distinct()
    return d.select("external_id", feed.idempotency_key(F.col("external_id"), F.col("payload"), F.coalesce("remote_version", F.lit(0))).alias("key"))


def utc_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "local_record").select("external_id", "updated_at_utc").distinct()
    return d.select("external_id", feed.local_to_utc("updated_at_utc").alias("utc"), feed.previous_second("updated_at_utc").alias("before")).where("utc IS NOT NULL")


def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).where("tenant IS NOT NULL AND customer_id IS NOT NULL")
    return evaluate.folds(d.select(F.concat_ws("|", F.lower("tenant"), "customer_id").alias("group_key")), "group_key")


QUERIES = {
    f.__name__: f
    for f in (
        text_normalise, identifier_normalise, token_sets, non_item_filter, error_token_scan, segment_case, exact_lanes, alias_interval_join, identifier_conflict,
        active_twins, alias_collisions, lane_quality, tfidf_word_topk, tfidf_char_topk, fuzzy_topk, recall_at_k, fk_violations, duplicate_groups, count_of_counts, unit_checks,
        schema_profile, distinct_profile, category_drift, median_profile, value_counts, feed_page_with_ties, feed_conflicts, feed_pull, feed_invariants, push_decisions,
        idempotency_key, utc_shift, grouped_folds,
    )
}
