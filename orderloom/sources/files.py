"""File sources and sinks with declared schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.operators.quality import error_cells

#: Columns a file must have, by kind of file; all are read as text.
REQUIRED = {
    "catalogue": ["item_code", "item_name", "description", "brand", "item_group", "stock_uom", "uom_conversions", "barcode", "manufacturer_part_no", "disabled", "list_price"],
    "aliases": ["tenant", "customer_id", "customer_sku", "item_code", "customer_description", "valid_from", "valid_to", "source", "confidence"],
    "units": ["tenant", "item_code", "uom", "conversion_factor", "is_stock_uom"],
    "orders": ["line_id", "tenant", "customer_id", "channel", "order_date", "raw_text", "qty", "uom_text", "unit_price", "buyer_sku", "raw_barcode", "notes"],
}


class MissingColumns(ValueError):
    """A file lacks columns it must have."""


class BadCells(ValueError):
    """Cells hold spreadsheet errors."""


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """A CSV with header as text columns; blank cells are ''.

    A byte-order mark before the first name is dropped, further columns are
    kept, missing ones raise MissingColumns with their names. Quoted cells may
    hold line breaks. The schema is the header's: nothing is inferred from data.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", inferSchema=False, nullValue=None, emptyValue="")
    df = df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})
    lost = sorted(set(required or []) - set(df.columns))
    if lost:
        raise MissingColumns(f"{path} lacks {', '.join(lost)}")
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def read_by_tenant(spark: SparkSession, folder: str, stem: str, required: list[str], tenants: list[str] | None = None) -> DataFrame:
    """All files '<stem>_<tenant>.csv' of a folder in one scan, the tenant taken from the file's name.

    tenants: those that may occur; others raise.
    """
    df = read_csv(spark, f"{folder.rstrip('/')}/{stem}_*.csv", required)
    df = df.withColumn("tenant", F.lower(F.regexp_extract(F.input_file_name(), rf"{stem}_([^/]+)\.csv$", 1)))
    if tenants is not None:
        odd = [r["tenant"] for r in df.where(~F.col("tenant").isin(tenants)).select("tenant").distinct().limit(10).collect()]
        if odd:
            raise ValueError(f"unknown tenants: {', '.join(sorted(odd))}")
    return df


def require_clean(df: DataFrame, key: str) -> DataFrame:
    """df, after no cell of it was found to hold a spreadsheet error; else BadCells names the first few."""
    bad = error_cells(df, key).limit(5).collect()
    if bad:
        raise BadCells("; ".join(f"{r['detail']} of {r['key']}" for r in bad))
    return df


def read_orders(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    """Order lines: every line has a tenant and an id of its own; violations raise."""
    df = read_csv(spark, path, [*REQUIRED["orders"], *(["gt_item_code"] if labelled else [])])
    if df.where(F.trim("tenant") == "").limit(1).count():
        raise ValueError(f"{path} has lines without tenant")
    twice = df.groupBy(F.trim("line_id").alias("line_id")).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"{path} repeats {', '.join(r['line_id'] for r in twice)}")
    return df


def unit_map(col: str = "uom_conversions"):
    """A JSON list of units as a map of normalised unit to factor; of equal units the last counts."""
    from orderloom.functions.text import normalise_unit

    rows = F.from_json(col, "array<struct<uom:string,conversion_factor:double>>")
    named = F.transform(rows, lambda c: F.struct(normalise_unit(c["uom"]).alias("key"), c["conversion_factor"].alias("value")))
    at = F.transform(named, lambda x, i: F.struct(x["key"].alias("key"), x["value"].alias("value"), i.alias("i")))
    last = F.filter(at, lambda x: ~F.exists(at, lambda y: (y["key"] == x["key"]) & (y["i"] > x["i"])))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["value"])))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON document or list, compressed or not."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash): SHA-256 of each file, computed where the files are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("hash"))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = False) -> None:
    """CSV with header and the columns named, in that order; single: one file, for small results."""
    out = df.select(*(columns or df.columns))
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(value: dict, path: str) -> None:
    """A small result as indented JSON with sorted keys."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, indent=2, ensure_ascii=False)
        f.write("\n")


def write_ledger(events: DataFrame, path: str) -> None:
    """Events partitioned by day, so that reports of some days read only those."""
    events.withColumn("day", F.substring("created_at", 1, 10)).repartition("day", F.pmod(F.xxhash64("tenant_id", "item_code"), F.lit(8))).write.mode("overwrite").partitionBy("day").parquet(path)
