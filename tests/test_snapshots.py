import pathlib
from datetime import datetime

import pytest

from quillmesh.operators.snapshots import old_rows, snapshot_changes

SCHEMA = "snap_id int, snap_date date, layer string, topic string, ref string, hash string, loaded_at timestamp, change string, alive int"


def h(c):
    return "sha256:" + c * 64


def table(spark, rows):
    # Columns named like those of the operator must not disturb it.
    return spark.createDataFrame([(s, None, l, t, r, x, datetime(2026, 1, d), "own", 7) for s, l, t, r, x, d in rows], SCHEMA)


def test_added_removed_changed_and_spelling(spark, rows):
    m = table(spark, [
        (1, "g", "t", "t/a/x", h("a"), 1), (1, "g", "t", "t/a/y", h("b"), 1), (1, "g", "t", "t/a/z", h("c"), 1),
        (2, "g", "t", " T/a/X ", h("a").upper(), 2), (2, "g", "t", "t/a/y", h("d"), 2), (2, "g", "t", "t/a/new", "e" * 64, 2),
    ])
    got = snapshot_changes(m)
    assert rows(got, "snap_id", "ref", "change") == [(2, "t/a/new", "added"), (2, "t/a/y", "changed"), (2, "t/a/z", "removed")]
    ch = {r["ref"]: r for r in old_rows(got, m).collect()}
    assert ch["t/a/y"]["old_hash"] == "b" * 64 and ch["t/a/y"]["new_hash"] == "d" * 64 and ch["t/a/y"]["old_snap_id"] == 1
    assert ch["t/a/new"]["old_hash"] is None and ch["t/a/z"]["new_hash"] is None


def test_latest_loaded_holds_and_ties_are_fixed(spark, rows):
    m = table(spark, [(1, "g", "t", "t/a/x", h("a"), 1), (2, "g", "t", "t/a/x", h("b"), 2), (2, "g", "t", "t/a/x", h("a"), 3), (3, "g", "t", "t/a/x", h("a"), 3), (3, "g", "t", "t/a/x", h("c"), 3)])
    assert rows(snapshot_changes(m), "snap_id", "change", "new_hash") == [(3, "changed", "c" * 64)]


def test_missing_delivery_is_compared_with_the_last_one(spark, rows):
    m = table(spark, [(1, "g", "t", "t/a/x", h("a"), 1), (1, "g", "u", "u/a/x", h("a"), 1), (2, "g", "u", "u/a/x", h("b"), 2), (3, "g", "t", "t/a/w", h("a"), 3), (3, "p", "t", "t/a/x", h("a"), 3)])
    assert rows(snapshot_changes(m), "snap_id", "layer", "ref", "change") == [(2, "g", "u/a/x", "changed"), (3, "g", "t/a/w", "added"), (3, "g", "t/a/x", "removed")]


def test_nulls_repeats_and_empty_tables(spark, rows):
    m = table(spark, [(1, None, None, "t/a/x", None, 1)] * 3 + [(2, None, None, "t/a/x", None, 1), (2, None, None, "t/a/y", None, 1), (None, "g", "t", "t/a/q", h("a"), 1), (2, "g", "t", None, h("a"), 1), (3, None, None, "t/a/x", h("a"), 1), (3, None, None, "t/a/y", None, 1)])
    assert rows(snapshot_changes(m), "snap_id", "layer", "topic", "ref", "change") == [(2, None, None, "t/a/y", "added"), (3, None, None, "t/a/x", "changed")]
    assert snapshot_changes(m.limit(0)).count() == 0


def test_hot_key_gives_one_row(spark, rows):
    m = table(spark, [(s, "g", "t", "t/a/x", h("a"), 1) for s in (1, 2)] * 500 + [(2, "g", "t", "t/a/x", h("b"), 2)])
    assert rows(snapshot_changes(m), "ref", "change") == [("t/a/x", "changed")]


def test_index_is_found_again_and_old_versions_go(spark, rows):
    from quillmesh.operators.snapshots import SnapshotIndex
    from quillmesh.session import workspace

    home = workspace(spark, "test")

    def step(name, *r, fail_at=None):
        # Another object each time, as in a new process.
        return SnapshotIndex(spark, ["k"], ["part"], home, 3).step(name, spark.createDataFrame([(*x, name) for x in r], "k string, part string, h binary, at string"), fail_at)

    assert step("one", ("a", "p", b"1"), ("b", "p", b"1")).count() == 0
    with pytest.raises(RuntimeError):
        step("two", ("a", "p", b"9"), fail_at="written")
    got = step("two", ("a", "p", b"2"))
    assert rows(got, "k", "change", "old_at") == [("a", "changed", "one"), ("b", "removed", "one")]
    assert rows(step("two", ("a", "p", b"7"))) == rows(got)
    assert rows(step("three", ("b", "p", b"1")), "k", "change", "old_at") == [("a", "removed", "two"), ("b", "added", None)]
    assert len(list((pathlib.Path(home.removeprefix("file://")) / "index").iterdir())) == 2
