import gzip
import json

import pytest
from orderloom.sources import files as S
from orderloom.sources.feed_source import ChangeFeed
from orderloom.streaming.feed_stream import apply_stream
from pyspark.sql import functions as F


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_csv_with_mark_breaks_and_blanks(spark, tmp_path):
    p = write(tmp_path / "a.csv", '﻿a,b,c\n1,"x\ny",\n,"say ""hi""",z\n')
    assert [tuple(r) for r in S.read_csv(spark, p, ["a", "c"]).collect()] == [("1", "x\ny", ""), ("", 'say "hi"', "z")]
    with pytest.raises(S.MissingColumns, match="d, e"):
        S.read_csv(spark, p, ["a", "e", "d"])


def test_tenant_from_file_name(spark, tmp_path):
    write(tmp_path / "cat_Acme.csv", "item_code\nA\n")
    write(tmp_path / "cat_nordic.csv", "item_code\nB\n")
    got = S.read_by_tenant(spark, str(tmp_path), "cat", ["item_code"])
    assert {tuple(r) for r in got.select("tenant", "item_code").collect()} == {("acme", "A"), ("nordic", "B")}
    with pytest.raises(ValueError, match="nordic"):
        S.read_by_tenant(spark, str(tmp_path), "cat", ["item_code"], ["acme"])


def test_error_cells_raise(spark):
    df = spark.createDataFrame([("1", "fine"), ("2", "a #n/a b")], "k string, v string")
    with pytest.raises(S.BadCells, match="v of 2"):
        S.require_clean(df, "k")
    assert S.require_clean(df.where("k = '1'"), "k").count() == 1


def test_orders(spark, tmp_path):
    head = ",".join(S.REQUIRED["orders"])
    row = lambda i, t: f"{i},{t}" + "," * 10
    assert S.read_orders(spark, write(tmp_path / "o.csv", "\n".join([head, row(1, "t"), row(2, "t")]))).count() == 2
    for rows in ([row(1, "t"), row(1, "t")], [row(1, " ")]):
        with pytest.raises(ValueError):
            S.read_orders(spark, write(tmp_path / "p.csv", "\n".join([head, *rows])))


def test_unit_map_takes_the_last_of_equal_units(spark):
    df = spark.createDataFrame([('[{"uom":"Pcs","conversion_factor":1},{"uom":"Nos","conversion_factor":2},{"uom":"CTN","conversion_factor":24}]',), ("",), (None,)], "uom_conversions string")
    assert [r[0] for r in df.select(S.unit_map()).collect()] == [{"piece": 2.0, "carton": 24.0}, None, None]


def test_json_hash_and_sinks(spark, tmp_path):
    p = tmp_path / "a.json.gz"
    p.write_bytes(gzip.compress(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]).encode()))
    assert S.read_json(spark, str(p)).count() == 2
    import hashlib

    assert S.content_hash(spark, str(p)).first()["hash"] == hashlib.sha256(p.read_bytes()).hexdigest()
    df = spark.createDataFrame([(1, "a,b", "2026-05-01T10:00:00Z", "t", "i")], "x int, y string, created_at string, tenant_id string, item_code string")
    S.write_csv(df, str(tmp_path / "out"), ["y", "x"], single=True)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == [("a,b", "1")]
    S.write_ledger(df, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).where("day = DATE'2026-05-01'").count() == 1
    S.write_json({"b": 1, "a": 2}, str(tmp_path / "r.json"))
    assert list(json.loads((tmp_path / "r.json").read_text())) == ["a", "b"]


def test_feed_stream_keeps_seconds_whole_and_survives_late_ties_and_replays(spark, tmp_path):
    spark.dataSource.register(ChangeFeed)
    folder = tmp_path / "feed"
    folder.mkdir()
    line = lambda i, v, t, p="x": json.dumps({"external_id": i, "payload": {"p": p}, "version": v, "updated_at": t}) + "\n"
    (folder / "1.jsonl").write_text("".join(line(f"E{i}", 1, "2026-08-01 00:00:00") for i in range(25)))
    state, checkpoint = str(tmp_path / "state"), str(tmp_path / "cp")
    seen = []

    def run():
        stream = spark.readStream.format("orderloom_feed").option("path", str(folder)).load()
        changes = stream.select("*", F.xxhash64("external_id", "version", "updated_at").alias("change_id"), F.lit("u").alias("op"))
        apply_stream(changes, state, checkpoint, 8, lambda b, n: seen.append(b.count())).awaitTermination()

    run()
    assert seen == [25]
    # late in the same second, and newer
    (folder / "2.jsonl").write_text(line("LATE", 1, "2026-08-01 00:00:00") + line("E3", 2, "2026-08-01 00:00:05", "new"))
    run()
    from orderloom.operators.cow_table import BucketedTable

    got = {r.external_id: r.version for r in BucketedTable(spark, state).read().collect()}
    assert got == {**{f"E{i}": 1 for i in range(25)}, "LATE": 1, "E3": 2}
    run()  # nothing new
    assert len(got) == BucketedTable(spark, state).read().count()
