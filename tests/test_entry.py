import os

import duckdb
import pytest

import __spark_entry__ as entry

QUICK = ["search_body", "search_bigram", "overlay_index", "edges_extract", "adjacency", "delta_q_rank", "set_hash", "build_counters", "validate_superseded", "body_link_list", "pack_sizes", "vector_topk", "move_plan_counts", "export_graph_tsv", "trade_weights", "p2_found", "p3_found", "p5_found"]


def cell(v):
    if v is None or v != v:
        return ""
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("QUILLMESH_ALL") else QUICK)
def test_query_equals_its_sql(spark, data, name):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    got = entry.queries()[name](spark, data)
    want = c.sql(entry.oracle_sql()[name])
    assert table(got.columns, got.collect()) == table(want.columns, want.fetchall())


def test_contract(spark, data):
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and {"p2_found", "p3_found", "p4_found", "p5_found"} <= set(q)
    assert entry.entry(spark).columns == ["ref", "score"]


def test_found_columns(spark, data):
    want = {"p2_found": ["snap_id", "layer", "ref", "change"], "p3_found": ["ref", "root_ref", "depth"], "p5_found": ["page_id", "field", "target", "reason"]}
    for name, cols in want.items():
        df = entry.queries()[name](spark, data)
        assert df.columns == cols and df.count() == df.distinct().count()


def test_nothing_else_needs_the_text_package():
    import pathlib

    for p in (pathlib.Path(entry.__file__).parent / "quillmesh").rglob("*.py"):
        assert "llm" in p.parts or "quillmesh.llm" not in p.read_text(), p
