import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import packing as P

LIMITS = [{"limit_id": 1, "capacity": 100}, {"limit_id": 2, "capacity": 37}]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 6), st.integers(2500, 5000))
def test_every_constraint_holds(sizes, docs, cost):
    x = np.array(sizes, int)
    bins = P.vector_best_fit(x, 50, docs, cost)
    for b in set(bins.tolist()):
        own = x[bins == b]
        assert own.sum() <= 50 and len(own) <= docs and (own**2).sum() <= cost
    if len(x):
        assert set(bins.tolist()) == set(range(bins.max() + 1))


def test_fill_is_near_the_bound():
    x = np.random.default_rng(1).integers(1, 300, 8000)
    bins = P.vector_best_fit(x, 512, 128, 512.0**2)
    assert x.sum() / ((bins.max() + 1) * 512) > 0.995


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, n long, tokens string, bin string")


@pytest.mark.parametrize("shard", [5, 1000])
def test_pack_places_every_token_once(spark, shard):
    rng = np.random.default_rng(2)
    data = [(i, int(n), "own", "own") for i, n in enumerate(rng.integers(1, 90, 60))] + [(900, 250, "own", "own"), (901, 100, "own", "own"), (902, 0, None, None), (903, None, None, None)]
    got = P.pack(sizes(spark, data), LIMITS, shard=shard).toPandas()
    for limit, cap in ((1, 100), (2, 37)):
        own = got[got.limit_id == limit]
        assert own.groupby("bin_id").tokens.sum().max() <= cap
        per = own.groupby("doc_id").tokens.sum().to_dict()
        assert per == {i: n for i, n, *_ in data if n}
        whole = own[own.doc_id.isin([i for i, n, *_ in data if n and n <= cap])]
        assert (whole.groupby("doc_id").size() == 1).all()
        assert not own.duplicated(["doc_id", "piece"]).any()
        long = own[own.doc_id == 900].sort_values("piece")
        assert long.first_token.tolist() == [cap * k for k in range(len(long))]


def test_empty_and_no_limits(spark):
    d = sizes(spark, [(1, 5, None, None)])
    assert P.pack(d.limit(0), LIMITS).count() == 0 and P.pack(d, []).count() == 0
    r = P.fill_report(P.pack(d, LIMITS), LIMITS).where("limit_id = 1").first()
    assert (r["containers"], r["tokens"], r["fill"]) == (1, 5, 0.05)
