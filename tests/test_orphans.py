from datetime import datetime

import pytest

from quillmesh.operators import orphans as O
from quillmesh.session import workspace

PAGES = "page_id long, layer string, ref string, relations array<struct<rel:string,to:string>>, body string, ingested_at timestamp, target string, field string"


def pages(spark, rows):
    return spark.createDataFrame([(i, l, r, rel, b, datetime(2026, m, d) if m else None, "own", "own") for i, l, r, rel, b, m, d in rows], PAGES)


def log(spark, rows):
    return spark.createDataFrame([(i, datetime(2026, 1, 1).date(), op, t, None) for i, (op, t) in enumerate(rows)], "op_id long, date date, op string, target string, detail string")


def test_reasons(spark, rows):
    body = "see [[t/a/late#part]], [[ T/a/Gone |name]], [[t/a/none]] and [[no ref]]\n```\n[[t/a/code]]\n```\n`[[t/a/inline]]` [[t/a/ok]]\n~~~\n[[t/a/open]]"
    p = pages(spark, [
        (1, "g", "t/a/ok", None, None, 1, 1), (2, "g", "t/a/x", [("uses", "t/a/late"), ("uses", None), (None, "t/a/none"), ("uses", "")], body, 2, 1), (2, "g", "t/a/x", [("uses", "t/a/late")], body, 3, 1),
        (3, "g", "t/a/late", None, "", 4, 1), (4, "p", "t/a/late", None, None, 2, 2), (5, "g", "t/a/nodate", [("uses", "t/a/none")], None, None, 1), (6, "g", "t/a/y", [("uses", "t/a/back")], None, 1, 1), (7, "g", "t/a/back", None, None, 1, 1),
    ])
    o = log(spark, [(" Delete", "T/a/gone "), ("move", "t/a/back"), ("log", "t/a/none"), (None, None)])
    got, state = O.orphan_references(p, o)
    assert rows(got, "page_id", "field", "target", "reason", "month") == sorted([
        (2, "body", "t/a/gone", "deleted", "2026-02"), (2, "body", "t/a/late", "late", "2026-02"), (2, "body", "t/a/none", "missing", "2026-02"),
        (2, "relations", "", "missing", "2026-02"), (2, "relations", "t/a/late", "late", "2026-02"), (2, "relations", "t/a/none", "missing", "2026-02"),
    ], key=repr)
    assert {r["reason"]: r["refs"] for r in O.orphan_report(got).where("field = 'body'").collect()} == {"deleted": 1, "late": 1, "missing": 1}
    # Open at the end of each period; in January the page whose deletion the log has, until it is seen again.
    open_ = rows(state.counts().where("refs > 0"), "period", "field", "lost", "refs")
    assert open_ == [("2026-01", "relations", True, 1), ("2026-02", "body", False, 1), ("2026-02", "body", True, 1), ("2026-02", "relations", False, 2)]


def test_empty(spark):
    got, _ = O.orphan_references(pages(spark, [(1, "g", "t/a/x", None, None, 1, 1)]).limit(0), log(spark, []))
    assert got.count() == 0


def test_state_resolves_reopens_and_is_found_again(spark, rows):
    home = workspace(spark, "test")
    d = lambda n: datetime(2026, 1, n)
    every = []

    def step(period, refs=(), events=(), fail_at=None):
        # Another object each time, as in a new process.
        s = O.OrphanState(spark, home, ("f",), 3)
        s.step(period, spark.createDataFrame(list(refs), O.REF_SCHEMA), spark.createDataFrame(list(events), "target string, at timestamp, dead boolean"), fail_at)
        every.extend(refs)
        known = spark.createDataFrame(every, O.REF_SCHEMA)
        return rows(s.orphans(known), "page_id", "target", "reason")

    assert step("1", [(1, "f", "a", d(1)), (1, "f", "b", d(1))], [("b", d(1), False)]) == [(1, "a", "missing")]
    with pytest.raises(RuntimeError):
        step("2", [], [("a", d(9), False)], "written")
    assert step("2", [], [("a", d(2), False), ("a", d(3), False)]) == [(1, "a", "late")]
    assert step("3", [(2, "f", "b", d(3))], [("b", d(3), True)]) == [(1, "a", "late"), (1, "b", "deleted"), (2, "b", "deleted")]
    assert step("3", [], [("b", d(3), False)]) == [(1, "a", "late"), (1, "b", "deleted"), (2, "b", "deleted")]
    assert step("4", [], [("b", d(4), False)]) == [(1, "a", "late")]
    for n in range(5, 10):
        assert step(str(n), [(n, "f", f"t{n}", d(n))], [(f"t{n - 1}", d(n), False)])[-1] == (n, f"t{n}", "missing")
    s = O.OrphanState(spark, home)
    assert any(p["base"] for p in s.periods) and s.targets().count() == s.targets().select("target").distinct().count() == 8
    open_ = {(r["period"], r["lost"]): r["refs"] for r in O.OrphanState(spark, home).counts().collect()}
    assert [open_[str(k), False] for k in (1, 2, 3, 4, 5, 9)] == [1, 0, 0, 0, 1, 1] and [open_[str(k), True] for k in (2, 3, 4)] == [0, 2, 0]
