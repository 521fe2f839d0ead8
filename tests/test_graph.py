import random
from collections import deque

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.operators import community as C
from quillmesh.operators import graph as G


def brute_bfs(adj, start, hops):
    seen, out, q = {start}, [], deque([(start, 0)])
    while q:
        n, h = q.popleft()
        if h == hops:
            continue
        for d, r, o in sorted(x[1:] for x in adj if x[0] == n):
            if o not in seen:
                seen.add(o)
                out.append((o, h + 1, n, r, ("out", "in")[d]))
                q.append((o, h + 1))
    return sorted(out)


def brute_paths(adj, a, b, most):
    level, k = [[]], 0
    while k <= 6:
        done = [p for p in level if (p[-1][0] if p else a) == b]
        if done:
            return sorted(done)[:most]
        level = [[*p, (o, r, d)] for p in level for n, d, r, o in adj if n == (p[-1][0] if p else a)]
        k += 1
    return []


@pytest.mark.parametrize("seed", [1, 2])
def test_traverse_and_paths_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    e = {(f"t/a/n{rng.randrange(12)}", rng.choice("uv"), f"t/a/n{rng.randrange(12)}") for _ in range(16)}
    df = spark.createDataFrame([("g", "t", a, r, b, "body") for a, r, b in e], "layer string, topic string, src_ref string, rel string, dst_ref string, src string")
    adj = G.adjacency(df)
    plain = [tuple(r) for r in adj.select("node", "dir", "rel", "other").collect()]
    nodes = sorted({x[0] for x in plain})
    index = spark.createDataFrame([(n,) for n in nodes], "ref string")
    got = [(r["ref"], r["hop"], r["parent"], r["rel"], r["direction"]) for r in G.traverse(adj, index, nodes[0], 3).collect()]
    assert sorted(got) == brute_bfs(plain, nodes[0], 3)
    goal = max(got, key=lambda r: (r[1], r[0]))[0]
    p = G.shortest_paths(adj, nodes[0], goal, 4)
    assert [[(s["ref"], s["rel"], s["dir"]) for s in r["steps"]] for r in p.orderBy("path_no").collect()] == brute_paths(plain, nodes[0], goal, 4)


def test_guards_and_unreachable(spark):
    df = spark.createDataFrame([("g", "t", "t/a/x", "r", "t/a/y", "body"), ("g", "t", "t/a/p", "r", "t/a/q", "body")], "layer string, topic string, src_ref string, rel string, dst_ref string, src string")
    adj, index = G.adjacency(df), spark.createDataFrame([("t/a/x",)], "ref string")
    assert G.shortest_paths(adj, "t/a/x", "t/a/q").count() == 0
    assert [(r["len"], r["steps"]) for r in G.shortest_paths(adj, "t/a/x", "t/a/x").collect()] == [(0, [])]
    assert [r["ref"] for r in G.traverse(adj, index, "t/a/x", 2, direction="out").collect()] == ["t/a/y"]
    assert G.traverse(adj, index, "t/a/x", 2, rels=["other"]).count() == 0
    for bad in (lambda: G.traverse(adj, index, "t/a/x", 7), lambda: G.neighbours(adj, direction="up"), lambda: G.shortest_paths(adj, "a", "b", 0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        G.traverse(adj, index, "t/a/none")


def brute_greedy(pairs):
    m = sum(w for *_, w in pairs)
    groups = [{n} for n in sorted({x for a, b, _ in pairs for x in (a, b)})]
    while True:
        best = None
        for i, g in enumerate(groups):
            for h in groups[i + 1 :]:
                w = sum(x for a, b, x in pairs if (a in g and b in h) or (a in h and b in g))
                if not w:
                    continue
                kg, kh = (sum(x for a, b, x in pairs for n in (a, b) if n in s) for s in (g, h))
                key = (-(2 * m * w - kg * kh), *sorted((min(g), min(h))))
                if key[0] < 0 and (best is None or key < best[0]):
                    best = (key, g, h)
        if best is None:
            return sorted(sorted(g) for g in groups)
        groups.remove(best[2])
        best[1].update(best[2])


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")).filter(lambda p: p[0] < p[1]), st.integers(1, 4), min_size=1, max_size=14))
def test_greedy_against_rescanning(d):
    pairs = [(a, b, w) for (a, b), w in d.items()]
    assert C.greedy(pairs) == brute_greedy(pairs)


def test_greedy_known_cases():
    assert C.greedy([("A", "B", 2), ("A", "C", 1), ("C", "D", 1)]) == [["A", "B"], ["C", "D"]]
    assert C.greedy([("a", "b", 1), ("c", "d", 1)]) == [["a", "b"], ["c", "d"]]


def test_components_do_not_change_the_result(spark):
    pairs = [("a", "b", 2), ("b", "c", 1), ("x", "y", 1), ("y", "z", 3), ("p", "q", 1)]
    w = spark.createDataFrame([("g", "t", a, b, k) for a, b, k in pairs], "layer string, topic string, a string, b string, w long")
    got = {}
    for r in C.communities(w).collect():
        got.setdefault(r["cid"], []).append(r["ref"])
    assert sorted(sorted(v) for v in got.values()) == C.greedy(pairs)
    assert set(got) == {C.community_id(g) for g in C.greedy(pairs)}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("abcdefghijklmnop"), st.sampled_from("abcdefghijklmnop")).filter(lambda p: p[0] < p[1]), st.sampled_from([1, 1, 2, 9]), min_size=10, max_size=40))
def test_greedy_against_rescanning_of_more_nodes(d):
    # Names in no order with the weights, so that communities are often moved into one with another name.
    pairs = [(a, b, w) for (a, b), w in d.items()]
    assert C.greedy(pairs) == brute_greedy(pairs)


def test_greedy_looks_at_few_pairs(monkeypatch):
    pushes = []
    push = C.heapq.heappush
    monkeypatch.setattr(C.heapq, "heappush", lambda h, x: (pushes.append(1), push(h, x)))
    # A page that all others name, and one that names every tenth of them.
    pairs = [("hub", f"n{i:04}", 1) for i in range(1500)] + [("far", f"n{i:04}", 1) for i in range(0, 1500, 10)]
    got = C.greedy(pairs)
    assert sorted(x for g in got for x in g) == sorted({x for a, b, _ in pairs for x in (a, b)})
    assert len(pushes) < 20 * len(pairs)


def test_detect_hashes_each_community_once(monkeypatch):
    calls = []
    real = C.community_id
    monkeypatch.setattr(C, "community_id", lambda g: (calls.append(len(g)), real(g))[1])
    d = pd.DataFrame([("g", "t", a, b, 1, 4, None) for a, b in ("ab", "bc", "xy", "yz")], columns=["layer", "topic", "a", "b", "w", "m", "comp"])
    got = C._detect(d)
    assert sorted(got["ref"]) == sorted("abcxyz") and sorted(calls) == sorted(got.groupby("cid").size())


def test_topics_are_split_only_if_large(spark, rows, monkeypatch):
    pairs = [("t", "a", "b", 2), ("t", "b", "c", 1), ("t", "x", "y", 1), ("t", "y", "z", 3), ("t", "p", "q", 1), ("u", "a", "b", 1)]
    w = spark.createDataFrame([("g", *p) for p in pairs], "layer string, topic string, a string, b string, w long")
    real, split = C.components, []
    monkeypatch.setattr(C, "components", lambda x: (split.append(rows(x.select("topic").distinct())), real(x))[1])
    whole = rows(C.communities(w))
    assert not split
    monkeypatch.setattr(C, "WHOLE_PAIRS", 2)
    assert rows(C.communities(w)) == whole and split == [[("t",)]]


def test_inheritance(spark):
    s = "layer string, topic string, cid string, ref string"
    t = lambda d: spark.createDataFrame([("g", "t", c, r) for c, rs in d.items() for r in rs], s)
    old = t({"c-old": "abcd", "c-gone": "xy"})
    # A split gives the old id to the half with the smaller first member; half in common is enough.
    got = {r["ref"]: r["cid"] for r in C.inherit_ids(old, t({"n1": "ab", "n2": "cd", "n3": "q"})).collect()}
    assert got == {"a": "c-old", "b": "c-old", "c": "n2", "d": "n2", "q": "n3"}
