"""Checks and profiles of tables; every check gives rows of violations, so an empty result passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.text import has_error_token, normalise_unit


def violations(name: str, rows: DataFrame, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def missing_references(name: str, rows: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Keys that occur in rows and not in the target, with how many rows have them."""
    keys = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    lost = keys.join(target.select(F.col(target_key).alias("_k")).distinct(), "_k", "left_anti")
    return violations(name, lost, F.col("_k"), F.col("n"))


def duplicate_keys(name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand for several different rows; copies of a whole row are one."""
    several = rows.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violations(name, several, F.concat_ws("|", *keys), F.col("n"))


def error_cells(rows: DataFrame, key: str) -> DataFrame:
    """Text cells that hold a spreadsheet error."""
    parts = [
        violations("error_token", rows.where(has_error_token(F.col(f.name))), F.col(key), F.lit(f.name)) for f in rows.schema.fields if isinstance(f.dataType, T.StringType) and f.name != key
    ]
    return union_all(parts)


def prefix_owner(items: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Entries whose code doesn't start with their tenant's prefix."""
    want = F.create_map(*(F.lit(x) for pair in prefixes.items() for x in pair))
    odd = items.distinct().where(~F.coalesce(F.startswith(F.col("item_code"), F.try_element_at(want, F.col("tenant"))), F.lit(False)))
    return violations("wrong_prefix", odd, F.col("item_code"), F.col("tenant"))


def unit_rows(items: DataFrame) -> DataFrame:
    """(tenant, item_code, stock, unit, factor): the conversions of each entry, one row each."""
    conv = F.from_json("uom_conversions", "array<struct<uom:string,conversion_factor:double>>")
    return items.distinct().select("tenant", "item_code", normalise_unit(F.col("stock_uom")).alias("stock"), F.explode(conv).alias("c")).select(
        "tenant", "item_code", "stock", normalise_unit(F.col("c.uom")).alias("unit"), F.col("c.conversion_factor").alias("factor")
    )


def unit_checks(items: DataFrame) -> DataFrame:
    """Entries without conversions or with unreadable ones, factors not above 0, and not exactly one stock unit of factor 1."""
    once = items.distinct().withColumn("parsed", F.from_json("uom_conversions", "array<struct<uom:string,conversion_factor:double>>"))
    code = F.col("item_code")
    none = once.where((F.trim(F.coalesce("uom_conversions", F.lit(""))) == ""))
    broken = once.where((F.trim(F.coalesce("uom_conversions", F.lit(""))) != "") & F.col("parsed").isNull())
    units = unit_rows(items)
    bad = units.where(F.col("factor").isNull() | (F.col("factor") <= 0))
    stock = units.groupBy("tenant", "item_code").agg(F.sum(((F.col("unit") == F.col("stock")) & (F.col("factor") == 1)).cast("int")).alias("n")).where("n <> 1")
    return union_all([
        violations("no_conversions", none, code, F.lit("")), violations("unreadable_conversions", broken, code, F.lit("")),
        violations("factor_not_positive", bad, code, F.col("unit")), violations("stock_unit_count", stock, code, F.col("n")),
    ])


def null_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, rows, nulls, blanks, values): one pass over each table."""
    parts = []
    for name, df in tables.items():
        text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
        stats = [
            F.struct(
                F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"),
                (F.sum((F.trim(c) == "").cast("long")) if c in text else F.lit(0).cast("long")).alias("blanks"),
            )
            for c in df.columns
        ]
        parts.append(df.agg(F.array(*stats).alias("s")).select(F.lit(name).alias("table"), F.inline("s")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return union_all(parts).select("table", "column", "rows", zero("nulls"), zero("blanks"))


def distinct_profile(df: DataFrame, name: str) -> DataFrame:
    """(table, column, values): exact numbers of different values."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns))
    long = df.select(F.inline(pairs)).where("v IS NOT NULL").distinct()
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("values")).select(F.lit(name).alias("table"), "column", "values")


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share in per cent) of a column's values, null as ''."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("value", "n", (F.col("n") * 100 / F.lit(df.count())).alias("share"))


def drift(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(value, share_a, share_b, moved) over the values of both; moved: 5 points or more."""
    x = shares(a, column).select("value", F.col("share").alias("share_a"))
    y = shares(b, column).select("value", F.col("share").alias("share_b"))
    both = x.join(y, "value", "full").select("value", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("share_a", "share_b")))
    return both.withColumn("moved", F.abs(F.col("share_a") - F.col("share_b")) >= 5)


def same_rows(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """(side, row...) of rows that only one side has, floats rounded; empty if both hold the same rows."""
    def plain(df: DataFrame) -> DataFrame:
        kind = {f.name: f.dataType for f in df.schema.fields}
        return df.select(*(F.round(c, digits).alias(c) if isinstance(kind[c], T.DoubleType | T.FloatType) else F.col(c) for c in sorted(df.columns)))

    x, y = plain(a), plain(b)
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))


def prediction_checks(predictions: DataFrame, live: DataFrame, lines: DataFrame) -> DataFrame:
    """What a predictions table must hold: a row per line and no other, a known decision, a
    code only where it is automatic, at most three candidates, confidence from 0 to 1, targets that are live."""
    p, key = predictions, F.col("line_id")
    several = p.groupBy("line_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return union_all([
        violations("duplicate_line", several, key, F.col("n")),
        violations("missing_line", lines.select("line_id").distinct().join(p.select("line_id"), "line_id", "left_anti"), key, F.lit("")),
        violations("extra_line", p.join(lines.select("line_id").distinct(), "line_id", "left_anti"), key, F.lit("")),
        violations("unknown_decision", p.where(~F.coalesce(F.col("decision").isin("auto", "review", "reject"), F.lit(False))), key, F.col("decision")),
        violations("code_and_decision", p.where((F.col("decision") == "auto") != (F.coalesce("item_code", F.lit("")) != "")), key, F.col("item_code")),
        violations("confidence_range", p.where(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))), key, F.col("confidence")),
        violations("too_many_candidates", p.where(F.size(F.split(F.coalesce("candidates", F.lit("")), r"\|")) > 3), key, F.col("candidates")),
        violations("target_not_live", p.where("decision = 'auto'").join(live.select("item_code").distinct(), "item_code", "left_anti"), key, F.col("item_code")),
    ])
