from datetime import date

from orderloom.operators.asof import items_by_buyer_code, loose_code, real_date, snapshots_and_log
from pyspark.sql import functions as F

LINES = "line_id string, tenant string, customer_id string, order_date string, buyer_sku string, code string, _from string"
MAP = "tenant string, customer_id string, customer_sku string, item_code string, valid_from string, valid_to string, source string, confidence double, _period string"


def run(spark, lines, rows):
    a = spark.createDataFrame([(*x, "c", "f") for x in lines], LINES)
    b = spark.createDataFrame([(*x, "p") for x in rows], MAP)
    return {(r.line_id, r.item_code) for r in items_by_buyer_code(a, b).collect()}


def test_both_ends_count_and_the_latest_start_holds(spark):
    rows = [
        ("t", "c", "AB-1", "old", "2026-01-01", "2026-03-31", "s", 1.0), ("t", "c", "ab 1", "new", "2026-03-15", None, "s", 1.0),
        ("t", "c", "AB1", "never", "2026-05-02", "2026-05-01", "s", 1.0), ("t", "d", "AB1", "other", None, "", "s", 1.0),
    ]
    lines = [
        ("1", "t", "c", "2026-01-01", "ab/1"), ("2", "t", "c", "2026-03-14", "AB1"), ("3", "t", "c", "2026-03-15", "AB1"), ("4", "t", "c", "2026-03-31", "AB1"),
        ("5", "t", "c", "2025-12-31", "AB1"), ("6", "t", "c", "2026-05-02T10:00:00", "AB1"), ("7", "t", "d", "1990/01/01", "ab1"), ("8", "t", "c", "next week", "AB1"),
        ("9", "t", "c", "2026-02-30", "AB1"), ("10", "t", "c", "2026-03-15", None), (None, "t", "c", "2026-03-15", "AB1"), ("1", "t", "c", "2026-01-01", "ab/1"),
    ]
    assert run(spark, lines, rows) == {("1", "old"), ("2", "old"), ("3", "new"), ("4", "new"), ("6", "new"), ("7", "other")}


def test_a_later_start_that_ended_gives_way_to_an_earlier_open_one(spark):
    rows = [("t", "c", "X", "long", "2026-01-10", None, "s", 1.0), ("t", "c", "X", "short", "2026-02-01", "2026-02-05", "s", 1.0)]
    assert run(spark, [("1", "t", "c", "2026-02-05", "x"), ("2", "t", "c", "2026-02-06", "x"), ("3", "t", "c", "2026-04-01", "x")], rows) == {("1", "short"), ("2", "long"), ("3", "long")}


def test_against_brute_force(spark):
    import random

    rng = random.Random(5)
    day = lambda: f"2026-{rng.randrange(1, 7):02d}-{rng.randrange(1, 29):02d}"
    rows = [("t", "c", f"K{rng.randrange(6)}", f"i{n}", rng.choice([None, day(), day()]), rng.choice([None, "", day(), "9999-12-31"]), "s", 1.0) for n in range(80)]
    lines = [(str(n), "t", "c", day(), f"k-{rng.randrange(7)}") for n in range(200)]
    want = set()
    for line, _, _, d, sku in lines:
        ok = [((f or "0001-01-01"), i) for _, _, k, i, f, t, _, _ in rows if k == sku.replace("-", "").upper() and (f or "0001-01-01") <= d <= (t or "9999-12-31")]
        if ok:
            want.add((line, max(ok)[1]))
    assert run(spark, lines, rows) == want


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [("1", "t", "c", "2026-01-01", "x")], []) == set()


def test_dates(spark):
    cases = {
        "2026-04-05": date(2026, 4, 5), "2026/04/05": date(2026, 4, 5), "20260405": date(2026, 4, 5), "5 Apr 2026": date(2026, 4, 5), "05.04.2026": date(2026, 4, 5),
        "2026-04-05T09:00:00": date(2026, 4, 5), "0000-00-00": None, "2026-04-31": None, "": None, "next week": None, None: None, "20261301": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", real_date(F.col("v")).alias("d"), loose_code(F.col("v")).alias("c")).collect()
    assert {r.v: r.d for r in got} == cases


def test_snapshots_hold_what_can_still_be_the_answer(spark):
    rows = [("k", "2026-01-10", "2026-12-31", "long"), ("k", "2026-01-20", "2026-03-15", "short"), ("k", "2026-01-05", "2026-03-10", "beaten"), ("k", "2026-02-03", "9999-12-31", "later"), ("k", "2026-02-03", "9999-12-31", "alike")]
    df = spark.createDataFrame(rows, "k string, f string, t string, v string").selectExpr("k", "CAST(f AS date) AS _from", "CAST(t AS date) AS _to", "struct(v) AS _tie", "v AS _value")
    snapshots, log = snapshots_and_log(df, ["k"], date(2026, 2, 1), date(2026, 3, 1))
    got = {(r._period, r._best._value) for r in snapshots.collect()}
    assert got == {(date(2026, 2, 1), "short"), (date(2026, 2, 1), "long"), (date(2026, 3, 1), "later")}
    assert {(r._period, r._best._value) for r in log.collect()} == {(date(2026, 2, 1), "later")}


def test_a_snapshot_alone_answers_and_the_log_replays_what_came_after_it(spark):
    rows = [("t", "c", "X", "before", "2025-05-01", None, "s", 1.0), ("t", "c", "X", "during", "2026-02-10", "2026-02-12", "s", 1.0)]
    lines = [(str(d), "t", "c", f"2026-02-{d:02d}", "x") for d in (1, 9, 10, 12, 13)]
    assert run(spark, lines, rows) == {("1", "before"), ("9", "before"), ("10", "during"), ("12", "during"), ("13", "before")}
