from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import build, move, overlay, pack, validate, vector
from quillmesh.operators.incremental import read_text
from quillmesh.session import workspace
from quillmesh.streaming import feed

PAGES = "page_id long, layer string, topic string, type string, slug string, ref string, title string, summary string, keywords array<string>, relations array<struct<rel:string,to:string>>, sources array<struct<url:string,title:string,accessed:date>>, updated date, body string, hash string, ingested_at timestamp, rank int"


def pages(spark, rows):
    out = []
    for i, (layer, ref, title, rel, body) in enumerate(rows):
        t, y, s = ref.strip().lower().split("/")
        out.append((i, layer, t, y, s, ref, title, None, ["k"], rel, None, None, body, "ab", datetime(2026, 1, 1), 5))
    return spark.createDataFrame(out, PAGES)


@pytest.fixture(scope="module")
def wiki(spark):
    return pages(spark, [
        ("global", " T/concepts/A ", "A", [("uses", "t/concepts/b"), ("uses", None)], "[[t/concepts/b]]"), ("global", "t/concepts/b", "B", None, None), ("project", "t/concepts/a", "A2", [("is_a", "t/concepts/zz")], ""), ("global", "t/concepts/c", None, [], "# One"),
    ])


def test_overlay(spark, wiki, rows):
    c = overlay.corpus(wiki.union(wiki))
    assert c.count() == 4
    i = overlay.merge_index(overlay.index_records(c))
    assert rows(i, "ref", "layer", "title") == [("t/concepts/a", "project", "A2"), ("t/concepts/b", "global", "B"), ("t/concepts/c", "global", "")]
    assert rows(overlay.shadowed(c)) == [("t/concepts/a",)]
    assert overlay.merge_index(overlay.index_records(c.limit(0))).count() == 0


def test_validation(spark, wiki, rows):
    from quillmesh.operators import graph
    c = overlay.corpus(wiki)
    merged = overlay.merge_edges(graph.edges(c), overlay.shadowed(c))
    got = validate.validate(c, overlay.merge_index(overlay.index_records(c)), merged, build.RELATIONS, build.TYPES)
    codes = {(r["code"], r["target"]) for r in got.collect()}
    assert {("link-broken-fm", "t/concepts/a"), ("shadow", "t/concepts/a"), ("page-orphan", "t/concepts/b"), ("page-orphan", "t/concepts/c"), ("body-h1", "t/concepts/c"), ("fm-schema", "t/concepts/c")} <= codes
    assert [r["severity"] for r in got.collect()][0] == "error"


def test_move(spark, wiki, rows):
    c = overlay.corpus(wiki)
    assert rows(move.plan(c, {"t/concepts/b": "u/papers/n"})) == [("global", "t/concepts/a", 2)]
    n = {(r["layer"], r["ref"]): r for r in move.relabel(c, {"t/concepts/b": "u/papers/n"}).collect()}
    assert n["global", "u/papers/n"]["topic"] == "u" and n["global", "t/concepts/a"]["body"] == "[[u/papers/n]]"
    assert n["global", "t/concepts/a"]["relations"][0]["to"] == "u/papers/n" and n["global", "t/concepts/a"]["relations"][1]["to"] is None
    assert move.check(c, {"t/concepts/b": "t/concepts/c", "t/concepts/no": "u/x/y"}, "global", ["t"], build.TYPES) == [("topic-undefined", "u/x/y", "no topic u"), ("ref-missing", "t/concepts/no", "no such page"), ("ref-exists", "t/concepts/c", "the new name is taken")]
    assert rows(move.rename_topic(c, "t", "v").select("ref").distinct()) == [("v/concepts/a",), ("v/concepts/b",), ("v/concepts/c",)]
    with pytest.raises(LookupError):
        move.log_rows(spark, "2026-01-01", "ingest", ["t/concepts/b", "t/x/none"], "", c)
    log = move.log_rows(spark, "2026-01-01", "ingest", ["t/concepts/b"], "batch", c)
    assert rows(move.log_lines(log)) == [("- 2026-01-01 [ingest] t/concepts/b — batch",)]


def test_topic_rename_rewrites_bodies(spark, rows):
    body = "[[t/concepts/b]] `[[t/concepts/b]]` [[tt/concepts/b]] [[t/concepts/gone]] [[t/x]]\r\n~~~\n[[t/concepts/b]]\n~~~\n[[t/concepts/b|b]]"
    c = overlay.corpus(pages(spark, [("global", "t/concepts/b", "B", None, None), ("global", "u/concepts/a", "A", [("uses", "t/concepts/b")], body), ("project", "u/concepts/c", "C", None, "")]))
    n = {r["ref"]: r["body"] for r in move.rename_topic(c, "t", "v").collect()}
    assert n["u/concepts/a"] == "[[v/concepts/b]] `[[t/concepts/b]]` [[tt/concepts/b]] [[v/concepts/gone]] [[t/x]]\r\n~~~\n[[t/concepts/b]]\n~~~\n[[t/concepts/b|b]]"
    assert n["v/concepts/b"] is None and n["u/concepts/c"] == ""


def test_pack(spark, wiki):
    c = overlay.merge_index(overlay.corpus(wiki).drop("page_id", "ingested_at"))
    sizes = {r["ref"]: r["size"] for r in pack.sizes(c).collect()}
    text, warnings = pack.assemble(c)
    assert warnings == []
    assert len(text.encode()) == pack.fixed_bytes(sorted(sizes)) + sum(sizes.values())
    budget = pack.fixed_bytes(sorted(sizes)) + len(pack.OMIT) + 1 + sizes["t/concepts/a"] + 25
    kept = {r["ref"]: r["kept"] for r in pack.greedy(pack.sizes(c), budget).collect()}
    assert kept == {r["ref"]: r["kept"] for r in pack.greedy(pack.sizes(c), budget, pack.fixed_bytes(sorted(sizes))).collect()}
    assert kept["t/concepts/a"] and not all(kept.values())
    small, warnings = pack.assemble(c, budget)
    assert pack.OMIT in small and "A2" in small and len(warnings) == (len(small.encode()) > budget)
    at = workspace(c.sparkSession, "pack") + "/p.md"
    assert len(pack.write_pack(c, at, 10)) == 1 and read_text(c.sparkSession, at).startswith(pack.BANNER[0])
    with pytest.raises(LookupError):
        pack.assemble(c.limit(0))


def test_vectors(spark, rows):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [2.0, 0.0])], "id long, e array<float>")
    assert [(r["id"], r["score"]) for r in vector.top_k(v, "id", "e", [1.0, 0.0], 3).collect()] == [(1, 1.0), (6, 1.0), (2, 0.707107)]
    h = spark.createDataFrame([("global", "/w/topics/t/pages/a/x.md", 0.5, 2), ("global", "/w/topics/t/pages/a/x.md", 0.9, 5), ("project", "/p/topics/t/pages/a/x.md", 0.7, 1), ("global", "/w/other/x.md", 1.0, 1), ("global", "/w/topics/t/pages/a/Bad.md", 1.0, 1), (None, None, 1.0, 1)], "layer string, path string, score double, rank int")
    assert rows(vector.chunk_hits_to_refs(h, {"global": "/w", "project": "/p"}), "ref", "score", "layer") == [("t/a/x", 0.9, "project")]


def test_vectors_in_batch(spark, rows):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [2.0, 0.0]), (7, [0.0, 1.0]), (8, [None, 1.0])], "id long, e array<float>").repartition(3)
    got = rows(vector.top_k_batch(v, "id", "e", v, 3))
    assert got == rows(vector.top_k_batch(v, "id", "e", v, 3, block=2)) and {r[0] for r in got} == {1, 2, 5, 6, 7}
    for q, e in [(r["id"], r["e"]) for r in v.where("id in (1, 2, 5, 6, 7)").collect()]:
        assert [r[1:] for r in sorted(got, key=lambda r: (-r[2], r[1])) if r[0] == q] == [tuple(r) for r in vector.top_k(v, "id", "e", e, 3).collect()]
    assert vector.top_k_batch(v, "id", "e", v.limit(0), 3).count() == 0


def test_diff_and_quick(spark, rows):
    t = lambda d: spark.createDataFrame(d, "topic string, ref string, hash string")
    ch = build.diff(t([("t", "a", "1"), ("t", "b", "1"), ("t", "n", None)]), t([("t", "b", "2"), ("t", "c", "1"), ("t", "n", None)]), ["topic", "ref"])
    assert rows(ch, "ref", "change") == [("a", "removed"), ("b", "changed"), ("c", "added"), ("n", "same")]
    p = spark.createDataFrame([("g", "a")], "layer string, ref string")
    assert rows(validate.quick(p, ch)) == [(1, 1, "stale")] and rows(validate.quick(p, ch.where("change = 'same'"))) == [(1, 1, "fresh")]


def test_export_and_import(spark, wiki, rows, tmp_path):
    i = overlay.merge_index(overlay.index_records(overlay.corpus(wiki)))
    build.export_index_jsonl(i).write.text(str(tmp_path / "x"))
    (tmp_path / "x" / "bad.json").write_text('{"title": "no ref"}\nnot json\n')
    assert rows(build.read_index_jsonl(spark, str(tmp_path / "x")), "ref", "title") == rows(i, "ref", "title")
    (tmp_path / "g.tsv").write_text("a\tr\tb\tbody\nshort\tline\n")
    assert rows(build.read_graph_tsv(spark, str(tmp_path / "g.tsv"))) == [("a", "r", "b", "body")]


def test_stream_of_states(spark, rows, tmp_path):
    s = "feed_id long, arrived_at timestamp, layer string, topic string, ref string, hash string, updated date"
    spark.createDataFrame([(1, datetime(2026, 1, 1), "g", "t", "T/a/x", "aa", date(2026, 1, 1)), (2, datetime(2026, 1, 2), "g", "t", "t/a/x", "bb", None), (3, datetime(2026, 1, 3), "g", "t", "t/a/x", None, None)], s).write.parquet(str(tmp_path / "in"))
    q = feed.latest_states(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).select("ref", F.decode("h", "UTF-8").alias("h"))
    assert rows(got) == [("t/a/x", "bb")]
    assert feed.changes_per_window(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema).isStreaming
