import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import mixing as X


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 500)), min_size=1, max_size=80), st.integers(0, 9))
def test_flight_keeps_both_totals(units, seed):
    p, x = np.array([u[0] for u in units]), np.array([float(u[1]) for u in units])
    q = X.flight(p, x, np.random.default_rng(seed))
    assert ((q >= 0) & (q <= 1)).all() and ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= max(2, 0)
    assert abs(q.sum() - p.sum()) < 1e-5 and abs((q * x).sum() - (p * x).sum()) < 1e-3 * max(1, (p * x).sum())


def test_inclusion_probabilities():
    p, x = np.array([0.2, 0.5, 0.7, 0.9, 0.4, 0.3]), np.array([10.0, 20, 30, 15, 5, 8])
    n = 4000
    mean = sum(X.flight(p, x, np.random.default_rng(s)) for s in range(n)) / n
    assert np.abs(mean - p).max() < 0.04


def tables(spark, docs, targets):
    return (
        spark.createDataFrame(docs, "doc_id long, source string, n long, p double, base string"),
        spark.createDataFrame(targets, "mix_id int, source string, target_share double, max_repeats int"),
    )


def test_shares_caps_and_levels(spark):
    rng = np.random.default_rng(3)
    docs = [(i, ("big", "mid", "tiny")[min(2, i // 300)], int(rng.integers(20, 200)), 0.5, "own") for i in range(640)]
    s, t = tables(spark, docs, [(1, " Big", 0.5, 1), (1, "MID ", 0.3, 2), (1, "tiny", 0.2, 3), (1, "tiny", 0.2, 3), (1, "absent", 0.0, 1)])
    for block in (50, 20_000):
        m = X.mix(s, t, block=block)
        got = {r["source"]: r for r in X.shares(m, t).collect()}
        for name, share, cap in (("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 3)):
            assert abs(got[name]["actual_share"] - share) < 0.004 and 1 <= got[name]["most_copies"] <= cap
        assert m.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    assert got["absent"]["tokens"] == 0


def test_source_without_texts_nulls_and_empty(spark):
    s, t = tables(spark, [(1, "a", 10, None, None), (2, "a", 30, None, None), (3, None, 5, None, None), (4, "other", 5, None, None)], [(1, "a", 0.5, 1), (1, "none", 0.5, 4), (2, None, 1.0, 1), (None, "a", 1.0, 1)])
    m = X.mix(s, t)
    assert {(r["doc_id"], r["copies"]) for r in m.collect()} == {(1, 1), (2, 1)}
    assert {r["source"]: r["actual_share"] for r in X.shares(m, t).collect()} == {"a": 1.0, "none": 0.0}
    assert X.mix(s.limit(0), t).count() == 0 and X.mix(s, t.limit(0)).count() == 0


def test_a_wanted_total_is_a_bound(spark):
    s, t = tables(spark, [(i, "ab"[i % 2], 10, None, None) for i in range(200)], [(1, "a", 0.5, 1), (1, "b", 0.5, 1)])
    m = X.mix(s, t, total=400).selectExpr("sum(tokens * copies) t").first()[0]
    assert m == 400


def test_distinct_texts(spark):
    d = spark.createDataFrame([(2, "b", "x", 5), (1, "a", "x", 5), (3, "a", "y", 6)], "doc_id long, source string, digest string, n long")
    assert sorted(tuple(r) for r in X.distinct_texts(d).collect()) == [(1, "a", 5), (3, "a", 6)]
