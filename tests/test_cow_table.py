import random

from orderloom.operators.cow_table import BucketedTable, latest_changes
from orderloom.session import new_path

SCHEMA = "change_id long, external_id string, op string, payload string, version int, updated_at string, site string, version_ string"


def feed(spark, rows):
    return spark.createDataFrame([(*r, None, None, "extra") for r in rows], SCHEMA)


def by_hand(rows):
    best = {}
    for cid, eid, op, payload, version in rows:
        key = (eid or "").strip().upper()
        if not key or version is None:
            continue
        if key not in best or (version, -cid) > (best[key][0], -best[key][1]):
            best[key] = (version, cid, (op or "").strip().lower() in ("d", "delete"), payload)
    return {(k, v[0], v[1]) for k, v in best.items() if not v[2]}


def test_batches_in_any_order_give_the_same_state(spark):
    rng = random.Random(3)
    rows = [(i, f" ext-{rng.randrange(40)}" if i % 3 else f"EXT-{rng.randrange(40)}", rng.choice(["u", "INSERT", "c", "D", "delete", None]), rng.choice([None, "{}", str(i)]), rng.randrange(12)) for i in range(600)]
    want = by_hand(rows)
    for cut_at in ([600], [200, 600], [10, 300, 301, 600]):
        shuffled = rows[:]
        rng.shuffle(shuffled)
        state = BucketedTable(spark, new_path(spark, "t"), buckets=8)
        start = 0
        for end in cut_at:
            state.apply(feed(spark, shuffled[start:end]))
            start = end
        assert {(r.external_id, r.version, r.change_id) for r in state.read().collect()} == want


def test_repeated_batch_changes_nothing_and_only_touched_buckets_are_rewritten(spark):
    state = BucketedTable(spark, new_path(spark, "t"), buckets=16)
    rows = [(i, f"E{i}", "c", "x", 1) for i in range(50)]
    state.apply(feed(spark, rows))
    before = state._manifest()["files"]
    touched = state.apply(feed(spark, [(99, "e7", "u", "y", 2)]))
    after = state._manifest()["files"]
    assert len(touched) == 1
    assert [b for b in after if after[b] != before.get(b)] == [str(touched[0])]
    once = sorted(map(tuple, state.read().collect()))
    state.apply(feed(spark, [(99, "e7", "u", "y", 2)]))
    assert sorted(map(tuple, state.read().collect())) == once


def test_a_delete_stays_against_a_late_older_change(spark):
    state = BucketedTable(spark, new_path(spark, "t"), buckets=4)
    state.apply(feed(spark, [(1, "A", "d", None, 5)]))
    state.apply(feed(spark, [(2, "A", "u", "late", 4)]))
    assert state.read().count() == 0
    assert state.apply(feed(spark, [(3, "A", "c", "new", 6)]))
    assert [(r.version, r.payload) for r in state.read().collect()] == [(6, "new")]


def test_rows_without_id_or_version_and_an_empty_feed(spark):
    state = BucketedTable(spark, new_path(spark, "t"))
    assert state.apply(feed(spark, [])) == []
    assert state.read().count() == 0
    assert latest_changes(feed(spark, [(1, None, "c", "x", 1), (2, "  ", "c", "x", 1), (3, "A", "c", "x", None)])).count() == 0


def test_a_second_writer_of_one_manifest_fails(spark):
    import pytest

    path = new_path(spark, "t")
    a = BucketedTable(spark, path)
    a.apply(feed(spark, [(1, "A", "c", "x", 1)]))
    with pytest.raises(RuntimeError):
        a._commit({"number": 1, "buckets": 64, "files": {}})


def test_the_loser_of_two_writers_leaves_the_winners_rows(spark):
    import pytest

    path = new_path(spark, "t")
    BucketedTable(spark, path, 4).apply(feed(spark, [(1, "A", "c", "base", 1), (2, "B", "c", "base", 1)]))
    first, second = BucketedTable(spark, path, 4), BucketedTable(spark, path, 4)
    stale = second._manifest()
    reader = first.read()  # between the writers
    first.apply(feed(spark, [(3, "A", "u", "winner", 2), (5, "C", "c", "winner", 1)]))
    second._manifest = lambda: stale  # reads what the first writer read
    with pytest.raises(RuntimeError, match="another writer"):
        second.apply(feed(spark, [(4, "A", "u", "loser", 3), (6, "B", "d", None, 2)]))
    rows = lambda df: {(r.external_id, r.version, r.payload) for r in df.collect()}
    assert rows(BucketedTable(spark, path).read()) == {("A", 2, "winner"), ("B", 1, "base"), ("C", 1, "winner")}
    assert rows(reader) == {("A", 1, "base"), ("B", 1, "base")}
    # the loser tries again on what holds now
    BucketedTable(spark, path).apply(feed(spark, [(4, "A", "u", "loser", 3), (6, "B", "d", None, 2)]))
    assert rows(BucketedTable(spark, path).read()) == {("A", 3, "loser"), ("C", 1, "winner")}


def test_a_manifest_that_is_half_written_is_not_read(spark):
    path = new_path(spark, "t")
    state = BucketedTable(spark, path)
    state.apply(feed(spark, [(1, "A", "c", "x", 1)]))
    state._write(state._hpath(f"{path}/manifests/2.json"), '{"number": 2, "fil')
    assert BucketedTable(spark, path).read().count() == 1


def test_a_feed_in_batches_is_merged_into_its_base(spark, monkeypatch):
    merged = []
    inner = BucketedTable._merge
    monkeypatch.setattr(BucketedTable, "_merge", staticmethod(lambda base, new: merged.append(1) or inner(base, new)))
    rows = [(i, f"E{i * 7 % 23}", "d" if i % 11 == 0 else "u", str(i), i * 5 % 9) for i in range(200)]
    for batches in (1, 3, 7):
        state = BucketedTable(spark, new_path(spark, "t"), buckets=8)
        state.apply_in_batches(feed(spark, rows), batches)
        assert {(r.external_id, r.version, r.change_id) for r in state.read().collect()} == by_hand(rows)
    assert len(merged) == 2 + 6
    state = BucketedTable(spark, new_path(spark, "t"))
    state.apply_in_batches(feed(spark, [(None, "A", "c", "x", 1)]), 3)
    assert state.read().count() == 0
