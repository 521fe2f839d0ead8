import pathlib
from datetime import datetime, timedelta

import pytest

from quillmesh.operators import incremental as I
from quillmesh.session import workspace

T0 = datetime(2026, 1, 1)


def feed(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(hours=t), "g", "t", r, x, None) for i, t, r, x in rows], "feed_id long, arrived_at timestamp, layer string, topic string, ref string, hash string, updated date")


def runs(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(hours=t) if t is not None else None, None, s, None) for i, t, s in rows], "run_id int, started_at timestamp, finished_at timestamp, status string, tool_version string")


def test_each_ok_run_sees_what_changed(spark, rows):
    f = feed(spark, [(1, 1, "t/a/x", "aa"), (1, 1, "t/a/x", "aa"), (2, 2, "t/a/y", "bb"), (3, 5, "t/a/x", "SHA256:AA"), (4, 6, "t/a/y", "cc"), (5, 6, "t/a/y", "bb"), (6, 7, "t/a/z", "dd"), (7, 7, "t/a/z", None), (8, 99, "t/a/late", "ee"), (9, 10, "t/a/z", "d1"), (10, 10, " T/A/Z ", "d2")])
    r = runs(spark, [(1, 3, "ok"), (1, 3, "ok"), (2, 6, "failed"), (3, 7, " OK"), (4, 10, "ok"), (5, 11, "ok"), (6, None, "ok")])
    got = rows(I.feed_runs(f, r), "run_id", "layer", "ref")
    # At hour 6 two versions of y arrive; feed_id 5 is the later one, and equals the state before.
    assert got == [(1, "g", "t/a/x"), (1, "g", "t/a/y"), (3, "g", "t/a/z"), (4, "g", "t/a/z")]


def test_empty_tables(spark):
    assert I.feed_runs(feed(spark, []), runs(spark, [(1, 1, "ok")])).count() == 0
    assert I.feed_runs(feed(spark, [(1, 1, "t/a/x", "aa")]), runs(spark, [])).count() == 0


def job(spark, home):
    return I.IncrementalRun(spark, f"{home}/in", f"{home}/job", ["k"], "v", ["o"])


def put(spark, home, name, data):
    spark.createDataFrame(data, "k string, v string, o int").coalesce(1).write.parquet(f"{home}/in/{name}")


@pytest.mark.parametrize("where", ["staged", "listed", "written", "committing"])
def test_failure_neither_skips_nor_repeats(spark, rows, where):
    home = workspace(spark, "test")
    put(spark, home, "a", [("x", "1", 1), ("y", "1", 1)])
    assert rows(job(spark, home).run("b1"), "k", "changed") == [("x", True), ("y", True)]
    put(spark, home, "b", [("x", "2", 2), ("y", "1", 2)])
    with pytest.raises(RuntimeError):
        job(spark, home).run("b2", fail_at=where)
    put(spark, home, "c", [("z", "9", 3)])
    got = job(spark, home).run("b2")
    assert rows(got, "k", "v", "changed") == [("x", "2", True), ("y", "1", False), ("z", "9", True)]
    # Committed once: running the batch again returns it, and the next one has nothing to do.
    assert rows(job(spark, home).run("b2"), "k", "changed") == rows(got, "k", "changed")
    assert job(spark, home).run("b3") is None
    assert [e.batch for e in job(spark, home).entries()] == ["b1", "b2"]


def test_same_content_under_another_name_and_late_versions(spark, rows):
    home = workspace(spark, "test")
    put(spark, home, "a", [("x", "5", 5)])
    job(spark, home).run("b1")
    put(spark, home, "copy", [("x", "5", 5)])
    assert rows(job(spark, home).run("b2")) == []
    assert job(spark, home).run("b3") is None
    put(spark, home, "old", [("x", "3", 3), (None, "n", 1)])
    got = job(spark, home).run("b4")
    assert ("x", "5", False) in rows(got, "k", "v", "changed")


@pytest.mark.parametrize("name", ["at 10%3A00 %20 [1]", "a b {2,3}* w?v ü#ö back\\slash"])
def test_any_sign_in_names(spark, rows, name):
    home = workspace(spark, "test")
    put(spark, home, "first", [("x", "1", 1)])
    (part,) = (pathlib.Path(home.removeprefix("file://")) / "in" / "first").glob("*.parquet")
    for k in range(2):
        at = pathlib.Path(home.removeprefix("file://")) / "in" / f"{name} {k}"
        at.mkdir()
        if k == 0:
            part.rename(at / f"{name} part.parquet")
            assert rows(job(spark, home).run("b0"), "k", "v", "changed") == [("x", "1", True)]
        else:
            put(spark, home, "second", [("x", "2", 2)])
            (other,) = (pathlib.Path(home.removeprefix("file://")) / "in" / "second").glob("*.parquet")
            other.rename(at / f"{name} part.parquet")
            assert rows(job(spark, home).run("b1"), "k", "v", "changed") == [("x", "2", True)]
    known = job(spark, home).manifest(job(spark, home).entries()).collect()
    assert len({r["checksum"] for r in known}) == 2 and all(r["checksum"].startswith("1:") for r in known)


def test_equal_names_below_other_folders(spark, rows):
    """Files of one name, size and row count below other folders are told apart, whichever comes first; empty files are no copies of each other."""
    home = workspace(spark, "test")
    for year, v in (("y=2028", "1"), ("y=2029", "2")):
        put(spark, home, f"{year}/d=1", [("x", v, int(v))])
        (part,) = (pathlib.Path(home.removeprefix("file://")) / "in" / year / "d=1").glob("*.parquet")
        part.rename(part.with_name("part.parquet"))
        assert rows(job(spark, home).run(f"b{v}"), "k", "v", "changed") == [("x", v, True)]
    for k in range(2):
        spark.createDataFrame([], "k string, v string, o int").coalesce(1).write.parquet(f"{home}/in/y=2030/d={k}")
    assert rows(job(spark, home).run("b3")) == []
    known = job(spark, home).manifest(job(spark, home).entries())
    assert known.where("checksum is null").count() == 2 and known.where("checksum is not null").select("checksum").distinct().count() == 2


def test_copies_within_one_batch_and_columns_that_come_later(spark, rows):
    home = workspace(spark, "test")
    put(spark, home, "a", [("x", "1", 1)])
    put(spark, home, "b", [("x", "1", 1)])
    j = I.IncrementalRun(spark, f"{home}/in", f"{home}/job", ["k"], "v", ["o"], lambda d: d.withColumn("v", d["v2"] if "v2" in d.columns else d["v"]))
    assert rows(j.run("b1"), "k", "v") == [("x", "1")]
    spark.createDataFrame([("y", "1", 2, "new")], "k string, v string, o int, v2 string").coalesce(1).write.parquet(f"{home}/in/c")
    assert rows(j.run("b2"), "k", "v", "changed") == [("y", "new", True)]


def test_compaction_keeps_the_state(spark, rows):
    home = workspace(spark, "test")
    j = job(spark, home)
    for i in range(I.COMPACT_EVERY + 2):
        put(spark, home, f"f{i}", [("x", str(i), i), (f"k{i}", "1", i)])
        j.run(f"b{i}")
    again = job(spark, home)
    assert any(e.base for e in again.entries())
    assert len(again.state(again.entries())) == 1 + 2
    state = again.latest()
    assert rows(state.select("k", "v")) == sorted([("x", str(I.COMPACT_EVERY + 1)), *[(f"k{i}", "1") for i in range(I.COMPACT_EVERY + 2)]])
    assert state.count() == state.select("k").distinct().count() == I.COMPACT_EVERY + 3
    base = again.state(again.entries())[0]
    assert base.count() == base.select("k").distinct().count() == I.COMPACT_EVERY + 1
