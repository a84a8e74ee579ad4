from orderloom.operators import feed as S
from orderloom.operators import quality as Q
from pyspark.sql import functions as F


def test_references_duplicates_and_rows(spark):
    a = spark.createDataFrame([("x", 1.0000001), ("y", 2.0), ("y", 2.0), (None, 3.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0)], "k string, v double")
    assert [tuple(r) for r in Q.missing_references("m", a, "k", b, "k").collect()] == [("m", "y", "2")]
    assert Q.duplicate_keys("d", a, ["k"]).count() == 0
    assert [r.key for r in Q.duplicate_keys("d", a.union(b), ["k"]).collect()] == ["x"]
    assert sorted((r.side, r.k) for r in Q.same_rows(a, b).collect() if r.k) == [("a", "y"), ("a", "y")]
    assert Q.missing_columns(a, ["k", "z", "b"]) == ["b", "z"]


def test_profiles(spark):
    a = spark.createDataFrame([("x", 1), ("", None), (None, 1)], "k string, v int")
    assert {tuple(r) for r in Q.null_profile({"t": a}).collect()} == {("t", "k", 3, 1, 1), ("t", "v", 3, 1, 0)}
    assert {tuple(r) for r in Q.distinct_profile(a, "t").collect()} == {("t", "k", 2), ("t", "v", 1)}
    b = spark.createDataFrame([("x", 1)], "k string, v int")
    moved = {r.value: (round(r.share_a), r.share_b, r.moved) for r in Q.drift(a, b, "k").collect()}
    assert moved == {"x": (33, 100.0, True), "": (67, 0.0, True)}


def test_unit_checks(spark):
    good = '[{"uom":"Pcs","conversion_factor":1.0},{"uom":"ctn","conversion_factor":5.0}]'
    rows = [("t", "OK", "Pcs", good), ("t", "NONE", "Pcs", ""), ("t", "BAD", "Pcs", "[{"), ("t", "ZERO", "Pcs", '[{"uom":"Pcs","conversion_factor":1},{"uom":"ctn","conversion_factor":0}]'), ("t", "LOST", "Kg", good)]
    got = {(r.check, r.key) for r in Q.unit_checks(spark.createDataFrame(rows, "tenant string, item_code string, stock_uom string, uom_conversions string")).collect()}
    assert got == {("no_conversions", "NONE"), ("unreadable_conversions", "BAD"), ("factor_not_positive", "ZERO"), ("stock_unit_count", "LOST")}
    odd = Q.prefix_owner(spark.createDataFrame([("acme", "ACM-1"), ("acme", "NRD-1"), (None, "X")], "tenant string, item_code string"), {"acme": "ACM-", "nordic": "NRD-"})
    assert {r.key for r in odd.collect()} == {"NRD-1", "X"}


def test_predictions(spark):
    rows = [("1", "A", "auto", 0.9, "A:1|B:2"), ("2", "", "review", 0.5, ""), ("2", "", "review", 0.5, ""), ("3", "A", "review", 1.5, "a|b|c|d"), ("4", "GONE", "auto", 0.1, ""), ("9", "", "maybe", 0.1, "")]
    p = spark.createDataFrame(rows, "line_id string, item_code string, decision string, confidence double, candidates string")
    live, lines = spark.createDataFrame([("A",)], "item_code string"), spark.createDataFrame([(str(i),) for i in range(1, 6)], "line_id string")
    got = {(r.check, r.key) for r in Q.prediction_checks(p, live, lines).collect()}
    assert got == {("duplicate_line", "2"), ("missing_line", "5"), ("extra_line", "9"), ("unknown_decision", "9"), ("code_and_decision", "3"), ("confidence_range", "3"), ("too_many_candidates", "3"), ("target_not_live", "4")}


FEED = "change_id long, external_id string, op string, payload string, version int"
LOCAL = "external_id string, payload string, remote_version int, updated_at_utc string, dirty boolean"


def test_sync_tables(spark):
    feed = spark.createDataFrame([(1, "a", "u", "p2", 2), (2, "b", "u", "p3", 3), (3, "c", "c", "new", 1), (4, "d", "u", "p1", 1), (5, "e", "u", "mine", 4), (6, "f", "u", "z", 9)], FEED)
    local = spark.createDataFrame([("A", "p1", 1, "", False), ("B", "p", 2, "", True), ("D", "p1", 1, "", True), ("E", "mine", 3, "", True), ("G", "x", None, "", True), ("B", "p", 2, "", True)], LOCAL)
    assert {tuple(r) for r in S.pull(feed, local).collect()} == {("A", "upsert", 2), ("B", "conflict", 3), ("C", "upsert", 1), ("D", "replay", 1), ("E", "conflict", 4), ("F", "upsert", 9)}
    assert {r.external_id for r in S.conflicts(feed, local).collect()} == {"B", "E"}
    remote = feed.select("external_id", "version", "payload")
    assert {tuple(r) for r in S.push_decisions(local, remote).collect()} == {("A", "skip"), ("B", "conflict"), ("D", "write"), ("E", "acknowledged"), ("G", "create")}
    assert {tuple(r) for r in S.invariants(feed, local).collect()} == {("missing", "C", "1"), ("missing", "F", "9"), ("drift", "A", "1<2")}


def test_pages_and_stamps(spark):
    feed = spark.createDataFrame([(i, "2026-08-01 00:00:00" if i < 25 else f"2026-08-01 00:00:{i - 20:02d}") for i in range(40)], "id int, at string")
    assert S.page_with_ties(feed, "at", 10).count() == 25
    assert S.page_with_ties(feed, "at", 10, "2026-08-01 00:00:00").count() == 10
    assert S.page_with_ties(feed.limit(0), "at", 10).count() == 0
    row = spark.range(1).select(S.local_to_utc(F.lit("2026-08-01 00:00:00")), S.previous_second(F.lit("2026-03-01 00:00:00")), S.local_to_utc(F.lit("x"))).first()
    assert tuple(row) == ("2026-07-31 16:00:00", "2026-02-28 23:59:59", None)
    key = lambda i, p, v: spark.range(1).select(S.idempotency_key(F.lit(i), F.lit(p), F.lit(v))).first()[0]
    assert key("a", "{}", 1) == key("a", "{}", 1) != key("a", "{}", 2) and len(key("a", "{}", 1)) == 32
