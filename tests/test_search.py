import pytest

from quillmesh.operators import search as S

SCHEMA = "ref string, layer string, topic string, title string, summary string, keywords array<string>, body string, score string"


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("t/a/one", "Graph", "about graphs", ["Graph", "index"], "graph\nno\nGraph graph\ngraph\nx\ngraph\ngraph\ngraph"),
        ("t/a/two", "Notes", "graph index notes", [], "nothing"),
        ("t/a/three", "知識グラフの話", "検索", ["知識グラフ"], ""),
        ("t/a/four", "Cafe\u0301 ÀB", "", None, None),
    ]
    d = spark.createDataFrame([(r, "g", "t", t, s, k or [], b, "own") for r, t, s, k, b in rows], SCHEMA)
    return S.with_search_fields(d, bodies=True).drop("score")


def found(df):
    return {r["ref"]: round(r["score"], 2) for r in df.collect()}


def test_exact_field_doubling_and_body(index):
    # Title equal to the term: 3 x 2; all terms found: x 2; six lines hold it, five count.
    assert found(S.search(index, "GRAPH", 10, False)) == {"t/a/one": 12.0, "t/a/two": 2.0}
    assert found(S.search(index, "graph", 10, True))["t/a/one"] == 14.5


def test_terms_add_and_repeat(index):
    assert found(S.search(index, "graph missing", 10, False)) == {"t/a/one": 6.0, "t/a/two": 1.0}
    assert found(S.search(index, "graph graph", 10, False))["t/a/two"] == 4.0


def test_bigrams(index):
    # Keyword equal: 2 x 2; title by bigrams 4/4: 3; doubled.
    assert found(S.search(index, "知識グラフ", 10, False)) == {"t/a/three": 8.0}
    # Two of four bigrams in the title.
    assert found(S.search(index, "知識グリフ", 10, False)) == {"t/a/three": 3.0}


def test_normal_form(index):
    assert "t/a/four" in found(S.search(index, "café", 10, False))
    # Only A-Z change case.
    assert found(S.search(index, "àb", 10, False)) == {}


def test_empty_query_and_limits(index):
    assert S.search(index, " \u3000 ", 10).count() == 0
    assert [r["ref"] for r in S.search(index, "graph", 1).collect()] == ["t/a/one"]
    with pytest.raises(ValueError):
        S.search(index, "x", 0)


def test_no_python_in_the_scan(index, spark):
    plan = S.search(spark.createDataFrame([], index.schema), "graph 知識グラフ", 5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "TakeOrderedAndProject" in plan
