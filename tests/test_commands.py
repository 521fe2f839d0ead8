from datetime import date

import pytest

from quillmesh.operators import build, community, documents, graph, move, overlay, pack, search, validate
from quillmesh.operators.incremental import _fs, read_text
from quillmesh.plans import core_queries, derived
from quillmesh.session import workspace
from quillmesh.sources import roots


def corpus(spark, rows):
    schema = "layer string, topic string, type string, slug string, ref string, title string, summary string, keywords array<string>, relations array<struct<rel:string,to:string>>, sources array<struct<url:string,title:string,accessed:date>>, updated date, body string, hash string"
    return spark.createDataFrame([(l, *r.split("/"), r, t, None, ["k"], rel, None, date(2026, 1, 1), body, h) for l, r, t, rel, body, h in rows], schema)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_asked_for(spark, data):
    for name in ("overlay_index", "set_hash", "overlay_shadow", "normalize_text"):
        plan = plan_of(core_queries.QUERIES[name](spark, data))
        assert "body:string" not in plan.split("ReadSchema:")[1].split("\n")[0], name
    plan = plan_of(core_queries.QUERIES["search_topic"](spark, data))
    assert "EqualTo(topic,retrieval)" in plan and "Python" not in plan
    assert "EqualTo(topic,retrieval)" in plan_of(derived.pages(spark, data, "title", topic="retrieval"))


def test_derived_tables_are_made_once(spark, data):
    one = derived.Derived.of(spark, data)
    assert one is derived.Derived.of(spark, data) and one.edges() is one.edges()
    assert one.adjacency().groupBy("node").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_documents(spark, rows):
    p = corpus(spark, [("global", "t/concepts/a", "A", [("uses", "t/concepts/b")], "", "1"), ("global", "t/concepts/b", "B", None, "", "2"), ("project", "t/concepts/b", "B", None, "", "3"), ("global", "u/concepts/c", "C", None, "", "4")])
    a = spark.createDataFrame([("global", "t", "c-1", "t/concepts/a"), ("global", "t", "c-1", "t/concepts/b"), ("project", "t", "c-2", "t/concepts/b")], "layer string, topic string, cid string, ref string")
    old = spark.createDataFrame([("global", "t", "c-1", "by hand\nin lines")], "layer string, topic string, cid string, summary string")
    texts = documents.document_text(community.documents(a, p, graph.edges(p), old))
    assert documents.format_issues(texts).count() == 0
    assert rows(documents.kept_summaries(texts), "cid", "summary") == [("c-1", "by hand\nin lines")]
    one = {r["cid"]: r["text"] for r in texts.collect()}
    assert "| uses | 1 |" in one["c-1"] and "(no relations inside)" in one["c-2"]
    for bad, message in ((one["c-1"].replace("c-1", "c-9"), "community is not that of the file"), (one["c-1"] + documents.MARKS[0], f"{documents.MARKS[0]} stands 2 times"), ("no marks", "no front matter"), (one["c-1"].replace("topic: t", "x: y"), "topic is missing"), (one["c-1"].replace("sha256:", "md5:"), "built_from is no hash")):
        d = spark.createDataFrame([("global", "t", "c-1", bad)], "layer string, topic string, cid string, text string")
        assert message in {r["message"] for r in documents.format_issues(d).collect()}, message
    swapped = one["c-1"].replace(documents.MARKS[0], "@").replace(documents.MARKS[2], documents.MARKS[0]).replace("@", documents.MARKS[2])
    d = spark.createDataFrame([("global", "t", "c-1", swapped)], "layer string, topic string, cid string, text string")
    assert {r["message"] for r in documents.format_issues(d).collect()} == {"the marks are out of order"} and documents.kept_summaries(d).count() == 0
    assert rows(documents.of_ref("t/concepts/b", a, texts, p), "layer", "cid", "stale") == [("project", "c-2", False)]
    assert documents.of_ref("t/concepts/a", a, texts.where("cid <> 'c-1'"), p).first()["stale"]
    for ref, topics, error in (("t/concepts/z", None, LookupError), ("u/concepts/c", None, LookupError), ("t/concepts/a", ["u"], ValueError)):
        with pytest.raises(error):
            documents.of_ref(ref, a, texts, p, topics)


def test_hook(spark, data):
    i = derived.Derived.of(spark, data).search_index(False)
    ask = '{"prompt": "glossary token"}'
    assert search.hook_context(i, ask, deadline=None)[0] == search.BANNER
    for request, more in (("not json", {}), ("[1]", {}), ('{"prompt": 5}', {}), ('{"prompt": "zzzzqqqq"}', {"deadline": None}), (ask, {"enabled": False}), (ask, {"deadline": 0.0})):
        assert search.hook_context(i, request, **more) == []


def test_pack_modes():
    assert pack.is_refs(["a/b/c", "a/b/d"]) and not pack.is_refs(["a/b/c", "words"]) and not pack.is_refs([])


def test_layers_topics_and_notes(spark, rows):
    p = corpus(spark, [("global", "t/concepts/a", "A", [("uses", "u/concepts/c")], "", "1"), ("project", "t/concepts/a", "A2", None, "", "1"), ("global", "u/concepts/c", "C", [("uses", "t/concepts/d")], "", "1")])
    assert rows(overlay.merge_index(overlay.index_records(overlay.of_layer(p, "global"))), "ref", "title") == [("t/concepts/a", "A"), ("u/concepts/c", "C")]
    with pytest.raises(ValueError):
        overlay.of_layer(p, "both of them")
    e = graph.edges(overlay.of_layer(p, "global"))
    ix = overlay.index_records(p)
    got = graph.traverse(graph.adjacency(e, ["t"]), ix, "t/concepts/a", 3)
    assert rows(got, "ref") == [("u/concepts/c",)]
    every = graph.traverse(graph.adjacency(e), ix, "t/concepts/a", 3)
    assert graph.cut_note(every, 1) == "1 of 2 rows; the rest has hops [2]" and graph.cut_note(every, 2) is None


def test_large_levels_give_the_same(spark, rows, monkeypatch):
    e = spark.createDataFrame([(f"n{i}", "r", f"n{j}") for i in range(12) for j in ((i * 7) % 12, (i * 5 + 1) % 12)], "src_ref string, rel string, dst_ref string")
    adj, ix = graph.adjacency(e), spark.createDataFrame([("n1",)], "ref string")
    want = [rows(graph.traverse(adj, ix, "n1", 4)), rows(graph.reach(adj, ix.withColumnRenamed("ref", "node"), 4)), rows(graph.shortest_paths(adj, "n1", "n6", 3))]
    monkeypatch.setattr(graph, "SMALL", 1)
    assert [rows(graph.traverse(adj, ix, "n1", 4)), rows(graph.reach(adj, ix.withColumnRenamed("ref", "node"), 4)), rows(graph.shortest_paths(adj, "n1", "n6", 3))] == want


def test_roots_and_locks(spark):
    home = workspace(spark, "roots")
    assert set(roots.init(spark, f"{home}/a/.pages", ["t", "empty"])) == {"config.yaml", "topics/t", "topics/empty"} and roots.init(spark, f"{home}/a/.pages", ["t", "empty"]) == []
    assert roots.resolve_layers(spark, "/g", None, f"{home}/a/b/c", {}) == [("global", "/g"), ("project", f"{home}/a/.pages".replace("file:///", "file:/"))]
    assert roots.resolve_layers(spark, None, None, None, {"QUILLMESH_ROOT": "/r", "QUILLMESH_PROJECT": "/p"}) == [("global", "/r"), ("project", "/p")]
    with roots.locked(spark, [f"{home}/x"]):
        with pytest.raises(BlockingIOError), roots.locked(spark, [f"{home}/y", f"{home}/x"]):
            pass
        with roots.locked(spark, [f"{home}/y"]):
            pass
    with roots.locked(spark, [f"{home}/x"]):
        pass
    root = f"{home}/a/.pages"
    c = roots.load_layer_config(spark, root, ["t"])
    assert c.topics == ["t"]
    at = roots.new_page(spark, root, "t/concepts/new-one", "A: title", "2026-01-01", ["t"], c.types)
    d = build.parse(build.scan(spark, root, "project"), c).first()
    assert d["title"] == "A: title" and d["issues"] == [] and at.endswith("new-one.md") and build.scan_topics(spark, root) == ["empty", "t"]
    for ref, error in (("t/concepts/new-one", FileExistsError), ("x/concepts/y", ValueError), ("t/nothing/y", ValueError), ("t/concepts/No", ValueError)):
        with pytest.raises(error):
            roots.new_page(spark, root, ref, "T", "2026-01-01", ["t"], c.types)
    with pytest.raises(ValueError):
        roots.load_layer_config(spark, root, ["nope"])
    with pytest.raises(FileNotFoundError):
        roots.load_layer_config(spark, f"{home}/none")
    with pytest.raises(roots.FeatureDisabled):
        roots.vectors_or_disabled(spark, f"{home}/none.parquet")


@pytest.mark.parametrize("text", ["topics: x", "topics:\n  - name: t\n  - name: t", "types: 5", "types:\n  - [a]", "relations:\n  - Up Per", "version: one", "vector: 3", "other: 1", "topics:\n  - name: t\n    colour: red", "relations:\n  - mentions"])
def test_config_is_a_closed_schema(text):
    assert build.load_config(text)[1]


def test_issues_from_elsewhere(spark, rows):
    t = spark.createDataFrame([("a", True, False, [], True), ("b", True, True, ["pages"], False), ("c", False, False, [], True)], "topic string, pages boolean, built boolean, present array<string>, current boolean")
    assert rows(validate.stale_derived(t, ["pages", "edges"]), "target", "message") == [("a", "not built yet"), ("b", "built by another version"), ("b", "missing: edges")]
    none = spark.createDataFrame([], "layer string, topic string")
    got = validate.config_issues(spark, {"global": ["unknown key x"]}, none, spark.createDataFrame([("global", "t")], "layer string, topic string"))
    assert rows(got, "code", "target") == [("config-schema", "global"), ("config-schema", "global/t")]


def test_a_move_as_a_whole(spark, rows):
    home = workspace(spark, "store")
    p = corpus(spark, [("global", "t/concepts/a", "A", [("uses", "t/concepts/b")], "see [[t/concepts/b]]", "1"), ("global", "t/concepts/b", "B", None, "", "2")])
    e = graph.edges(p)
    s = build.Store(spark, f"{home}/store")
    s.commit(s.next_version(), {"pages": p, "edges": e, "communities": community.communities(community.pair_weights(e, p))})
    m = {"t/concepts/b": "t/papers/n"}
    with pytest.raises(ValueError):
        move.commit_move(s, {"t/concepts/b": "x/papers/n"}, "2026-01-01", ["t"], build.TYPES, f"{home}/log")
    assert move.commit_move(s, m, "2026-01-01", ["t"], build.TYPES, f"{home}/log") == "moved"
    now = build.Store(spark, f"{home}/store")
    assert rows(now.table("pages", now.current()), "ref", "body") == [("t/concepts/a", "see [[t/papers/n]]"), ("t/papers/n", "")]
    assert move.commit_move(now, m, "2026-01-01", ["t"], build.TYPES, f"{home}/log") == "resumed"
    assert rows(spark.read.text(f"{home}/log")) == [("- 2026-01-01 [move] t/concepts/b — to t/papers/n",)]
    assert move.commit_move(now, {"t/papers/n": "t/papers/n2"}, "2026-01-02", ["t"], build.TYPES, f"{home}/log", "global", "project") == "moved"
    assert ("project", "t/papers/n2") in rows(now.table("pages", now.current()), "layer", "ref")
    fs, pointer = _fs(spark, f"{home}/store/_CURRENT.json")
    assert fs.exists(pointer) and "version" in read_text(spark, pointer.toString())


def test_adjacency_and_assignment_files(spark, rows, tmp_path):
    (tmp_path / "a.json").write_text('{"in": {"b": [["r", "a"]]}, "nodes": ["a", "b", "c"], "out": {\n "a": [["r", "b"]]}, "schema_version": 1}')
    want = [("a", 0, "r", "b"), ("b", 1, "r", "a")]
    assert rows(build.read_adjacency(spark, str(tmp_path / "a.json"))) == want
    adj = spark.createDataFrame(want, "node string, dir int, rel string, other string")
    build.export_adjacency_jsonl(adj, spark.createDataFrame([("a",), ("b",), ("c",)], "node string")).write.text(str(tmp_path / "l"))
    assert rows(build.read_adjacency(spark, str(tmp_path / "l"))) == want and spark.read.text(str(tmp_path / "l")).count() == 3
    (tmp_path / "bad.json").write_text("not json")
    assert build.read_adjacency(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "s.json").write_text('{"communities": {"c-1": ["a", "b"]},\n "other": 1}')
    a = build.read_assignment(spark, str(tmp_path / "s.json"), "global", "t")
    assert rows(a, "cid", "ref") == [("c-1", "a"), ("c-1", "b")] and build.read_assignment(spark, str(tmp_path / "bad.json"), "g", "t").count() == 0
    assert build.export_assignment(a).first()["value"] == '{"community":"c-1","members":["a","b"]}'
