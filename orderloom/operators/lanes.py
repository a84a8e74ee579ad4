"""Candidate lanes of a record matcher: exact identifiers, aliases, conflicts, twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.text import normalise_identifier, normalise_text
from orderloom.operators.asof import real_date

#: Names of placeholder entries.
MISC_NAMES = ["HANDLING SURCHARGE", "PALLET DEPOSIT", "ROUNDING LINE", "SAMPLE NOT FOR SALE"]


def is_misc(name: str = "item_name", brand: str = "brand", group: str = "item_group") -> Column:
    """Placeholder entries: by name, without brand, or in a group that ends in '> misc'."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.upper(text(name)).isin(MISC_NAMES) | (text(brand) == "") | F.lower(text(group)).endswith("> misc")


def base_name(name: Column) -> Column:
    """Normalised name without a '(Bulk)' ending."""
    return normalise_text(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s*\(Bulk\)\s*$", ""))


def catalogue(items: DataFrame) -> DataFrame:
    """Catalogue rows, once each, with what the lanes need of them."""
    return items.distinct().select(
        "tenant", "item_code", "item_name", "description", "brand", "item_group", "stock_uom", "uom_conversions",
        (F.col("disabled") != "1").alias("enabled"), is_misc().alias("misc"),
        normalise_identifier(F.col("item_code")).alias("code_key"), normalise_identifier(F.col("barcode")).alias("barcode_key"),
        normalise_identifier(F.col("manufacturer_part_no")).alias("part_key"), base_name(F.col("item_name")).alias("base"),
        normalise_text(F.col("item_name")).alias("name_text"),
        normalise_text(F.concat_ws(" ", "item_name", "description", "brand", "item_group")).alias("search_text"),
    )


def line_identifiers(lines: DataFrame) -> DataFrame:
    """(line_id, tenant, key): what may be an identifier of a line: its code, barcode, whole text, and numbers of 8 to 14 digits in it."""
    embedded = F.regexp_extract_all(F.coalesce("raw_text", F.lit("")), F.lit(r"\b\d{8,14}\b"), 0)
    keys = F.concat(F.array(*(normalise_identifier(F.col(c)) for c in ("buyer_sku", "raw_barcode", "raw_text"))), embedded)
    return lines.select("line_id", "tenant", F.explode(keys).alias("key")).where("key <> ''").distinct()


def identifier_lanes(lines: DataFrame, items: DataFrame) -> DataFrame:
    """(line_id, item_code, lane) of exact identifier hits among live entries of the line's tenant.

    Lanes: item_code, barcode, part_number by equality, and item_code also where
    the line's text contains the code. For that, the text's windows of the
    lengths that codes have are looked up by equality, so no pair is tried that
    doesn't hit.
    """
    keys = line_identifiers(lines)
    live = items.where("enabled AND NOT misc")
    hits = [
        keys.join(live.select("tenant", "item_code", F.col(c).alias("key")).where("key <> ''"), ["tenant", "key"]).select("line_id", "item_code", F.lit(lane).alias("lane"))
        for lane, c in (("item_code", "code_key"), ("barcode", "barcode_key"), ("part_number", "part_key"))
    ]
    codes = live.select("tenant", "item_code", F.col("code_key").alias("key")).where("key <> ''")
    lengths = codes.select("tenant", F.length("key").alias("n")).groupBy("tenant").agg(F.collect_set("n").alias("lengths"))
    text = lines.select("line_id", "tenant", normalise_identifier(F.col("raw_text")).alias("text")).where("text RLIKE '[0-9]'").distinct()
    sized = text.join(lengths, "tenant").select("line_id", "tenant", "text", F.explode("lengths").alias("n")).where("length(text) >= n")
    windows = sized.select("line_id", "tenant", F.explode(F.expr("transform(sequence(1, length(text) - n + 1), i -> substring(text, i, n))")).alias("key"))
    hits.append(windows.join(codes, ["tenant", "key"]).select("line_id", "item_code", F.lit("item_code").alias("lane")))
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.distinct()


def alias_lane(lines: DataFrame, aliases: DataFrame, items: DataFrame) -> DataFrame:
    """(line_id, item_code, live, confidence, source) of alias records valid on the line's date.

    live: the target can be matched, by the tenant's own entry. Of an item's
    records the highest (confidence, source) counts. A bound that is written but
    is no date can't be trusted either way, so its record is never valid. Lines
    without a real date have no aliases.
    """
    day = lines.select("line_id", "tenant", "customer_id", normalise_identifier(F.col("buyer_sku")).alias("key"), real_date(F.col("order_date")).alias("day")).where("key <> '' AND day IS NOT NULL")
    written = lambda c: F.when(F.trim(c) != "", F.trim(c))
    records = aliases.distinct().select(
        "tenant", "customer_id", normalise_identifier(F.col("customer_sku")).alias("key"), F.col("item_code"), written("valid_from").alias("wf"), written("valid_to").alias("wt"), "confidence", "source"
    ).select("*", real_date(F.col("wf")).alias("vf"), real_date(F.col("wt")).alias("vt")).where("(wf IS NULL OR vf IS NOT NULL) AND (wt IS NULL OR vt IS NOT NULL)")
    target = items.groupBy("tenant", "item_code").agg(F.max(F.col("enabled") & ~F.col("misc")).alias("live"))
    hit = day.join(records, ["tenant", "customer_id", "key"]).where("(vf IS NULL OR vf <= day) AND (vt IS NULL OR day <= vt)").join(target, ["tenant", "item_code"])
    best = F.max(F.struct("confidence", "source")).alias("b")
    return hit.groupBy("line_id", "item_code", "live").agg(best).select("line_id", "item_code", "live", "b.confidence", "b.source")


def identifier_conflicts(lanes: DataFrame, alias: DataFrame) -> DataFrame:
    """(line_id, targets) of lines whose identifiers name more than one item, lanes and live aliases together."""
    every = lanes.select("line_id", "item_code").unionByName(alias.where("live").select("line_id", "item_code"))
    return every.groupBy("line_id").agg(F.count_distinct("item_code").alias("targets")).where("targets > 1")


def active_twins(items: DataFrame) -> DataFrame:
    """(tenant, base, item_code, twins): live entries that share their base name with others."""
    w = Window.partitionBy("tenant", "base")
    return items.where("enabled AND NOT misc").select("tenant", "base", "item_code").distinct().withColumn("twins", F.count(F.lit(1)).over(w)).where("twins > 1")


def alias_collisions(aliases: DataFrame, today: Column) -> DataFrame:
    """(tenant, customer_id, key, codes, current_codes): codes that mean several items, ever and on a day."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    valid = (text("valid_from") <= today) & ((text("valid_to") == "") | (text("valid_to") >= today))
    rows = aliases.select("tenant", "customer_id", normalise_identifier(F.col("customer_sku")).alias("key"), "item_code", valid.alias("valid"))
    out = rows.groupBy("tenant", "customer_id", "key").agg(F.count_distinct("item_code").alias("codes"), F.count_distinct(F.when(F.col("valid"), F.col("item_code"))).alias("current_codes"))
    return out.where("codes > 1")


def unique_target(keys: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """keys joined to targets whose key has exactly one item."""
    one = targets.groupBy(*on).agg(F.min("item_code").alias("item_code"), F.count_distinct("item_code").alias("n")).where("n = 1").drop("n")
    return keys.join(one, on)
