from orderloom.streaming import feed_stream as S

SCHEMA = "change_id long, external_id string, version int, payload string, at timestamp"


def source(spark, tmp_path, batches):
    folder = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, "change_id long, external_id string, version int, payload string, at string").selectExpr("change_id", "external_id", "version", "payload", "CAST(at AS timestamp) AS at").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(spark, df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


BATCHES = [
    [(1, "A", 1, "a", "2026-05-01 10:00:00"), (2, "B", 3, "b", "2026-05-01 10:00:01")],
    [(3, "A", 2, "c", "2026-05-01 10:30:00"), (4, "B", 3, "late copy", "2026-05-01 10:30:00"), (5, None, 1, "x", "2026-05-01 10:30:00")],
    [(6, "A", 1, "old", "2026-05-01 13:00:00")],
]


def test_latest_versions(spark, tmp_path):
    out = drain(spark, S.latest_versions(source(spark, tmp_path, BATCHES)), "complete", "latest", tmp_path)
    assert {(r.external_id, r.version, r.change_id, r.payload) for r in out} == {("A", 2, 3, "c"), ("B", 3, 2, "b")}


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    rows = [[(1, "A", 1, "x", "2026-05-01 10:00:00"), (2, "A", 1, "x", "2026-05-01 10:00:01"), (3, "A", 2, "y", "2026-05-01 10:00:01")]]
    out = drain(spark, S.new_versions(source(spark, tmp_path, rows), "at", "5 seconds"), "append", "fresh", tmp_path)
    assert sorted((r.external_id, r.version) for r in out) == [("A", 1), ("A", 2)]


def test_windows(spark, tmp_path):
    out = drain(spark, S.windowed_counts(source(spark, tmp_path, BATCHES), "at", "external_id"), "complete", "windows", tmp_path)
    assert {(r.start.hour, r.external_id, r.events) for r in out} == {(10, "A", 2), (10, "B", 2), (10, None, 1), (13, "A", 1)}
