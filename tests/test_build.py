import datetime
import os

import pytest

from quillmesh.functions import frontmatter as FM
from quillmesh.functions import text as TX
from quillmesh.operators import build as B
from quillmesh.session import workspace


@pytest.mark.parametrize(("text", "value"), [
    ("a: true", True), ("a: -07", -7), ("a: 2026-02-03", datetime.date(2026, 2, 3)), ("a: 2026-02-30", "2026-02-30"), ("a: x y  ", "x y"), ('a: "q\\"\\\\"', 'q"\\'), ("a: 'it''s'", "it's"),
    ("a: [x, 'y, z', 3]", ["x", "y, z", 3]), ("a: []", []), ("a:", None), ("a:\n  - x\n  - k: v\n    l: 2", ["x", {"k": "v", "l": 2}]), ("a:\n  b:\n    c: d", {"b": {"c": "d"}}), ("# c\n\na: b", "b"),
])
def test_front_matter_values(text, value):
    data, issues = FM.parse_lines(text.split("\n"))
    assert data == {"a": value} and not issues


@pytest.mark.parametrize("text", ["a: x: y", "a: x #c", "a: *x", "a:x", "a:  x", "a: [x, [y]]", "a: [x,]", "a: [x", 'a: "x', 'a: "x" y', "a: 'x\\", "x", "a: b\na: c", " a: b", "\ta: b", "a:\n    b: c", "- x", "a:\n  -", "a: |"])
def test_front_matter_errors_are_reported_and_passed_over(text):
    data, issues = FM.parse_lines((text + "\nz: 1").split("\n"))
    assert issues and data.get("z") == 1


def test_scalars_round_trip():
    for v in ["plain", "true", "2026-01-01", "a: b", "", "x #y", " lead", 'q"\\', "12", "- x", "[a]"]:
        assert FM.scalar(FM.dump_scalar(v), lists=True) == v
    with pytest.raises(ValueError):
        FM.dump_scalar("a\nb")


def test_text_functions(spark):
    body = "# Head\n> quote\n- item\n<!-- one\ntwo -->\n***\n  First line of text.  \nmore\n```\n# code\n[[a/b/c]]\n~~~\n```\n`[[a/b/d]]` [[a/b/e]] [[no]]"
    got = spark.createDataFrame([(body,), ("",), ("## x\n\n```\nopen\n# y",), ("x" * 200,)], "body string").select(
        TX.summary_of(TX.F.col("body")).alias("s"), TX.has_h1(TX.F.col("body")).alias("h"), TX.body_links(TX.F.col("body")).alias("l"), TX.canonical_links(TX.F.col("body")).alias("c")
    ).collect()
    assert (got[0]["s"], got[0]["h"], got[0]["l"], got[0]["c"]) == ("First line of text.", True, ["a/b/e", "no"], ["a/b/e"])
    assert (got[1]["s"], got[2]["s"], got[2]["h"], len(got[3]["s"])) == ("", "", False, 120)
    assert TX.rewrite_py("[[a/b/c]] `[[a/b/c]]`\n~~~\n[[a/b/c]]\n~~~\n[[a/b/c|x]] [[a/b/c]]", {"a/b/c": "n/n/n"}) == ("[[n/n/n]] `[[a/b/c]]`\n~~~\n[[a/b/c]]\n~~~\n[[a/b/c|x]] [[n/n/n]]", 2)


def page(title, type_="concepts", slug=None, rel=(), body="Some text.", **kw):
    rels = "".join(f"\n  - rel: {r}\n    to: {t}" for r, t in rel)
    return f"---\ntitle: {title}\ntype: {type_}\nslug: {slug or title.lower()}\nupdated: 2026-01-02\n" + (f"relations:{rels}\n" if rels else "") + "".join(f"{k}: {v}\n" for k, v in kw.items()) + f"---\n{body}\n"


class Wiki:
    def __init__(self, root):
        self.root = root

    def put(self, ref, text):
        t, y, s = ref.split("/")
        p = f"{self.root}/topics/{t}/pages/{y}/{s}.md"
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
        return p


def tables(spark, home):
    s = B.Store(spark, home)
    v = s.current()
    cut = {"pages": ["layer", "topic", "ref", "hash", "title", "summary"], "edges": ["layer", "topic", "src_ref", "rel", "dst_ref", "src"], "communities": ["layer", "topic", "cid", "ref"]}
    return {k: sorted(tuple(r) for r in s.table(k, v).select(*c).collect()) for k, c in cut.items()}


def test_incremental_build_equals_a_full_one(spark, tmp_path):
    w = Wiki(str(tmp_path))
    w.put("llm/concepts/a", page("A", rel=[("uses", "llm/concepts/b")]))
    w.put("llm/concepts/b", page("B", body="see [[llm/concepts/a]] and [[llm/concepts/c]]").replace("\n", "\r\n"))
    gone = w.put("llm/concepts/c", page("C"))
    w.put("ops/concepts/x", page("X", keywords="[one, two]"))
    inc, full = workspace(spark, "inc"), workspace(spark, "full")
    c1, i1 = B.build(spark, str(tmp_path), "global", inc)
    assert i1.count() == 0 and {r["topic"]: (r["pages"], r["added"]) for r in c1.collect()} == {"llm": (3, 3), "ops": (1, 1)}
    w.put("llm/concepts/a", page("A", rel=[("uses", "llm/concepts/d")], body="changed"))
    w.put("llm/concepts/d", page("D", body="[[llm/concepts/b]]"))
    os.remove(gone)
    c2, _ = B.build(spark, str(tmp_path), "global", inc)
    assert {r["topic"]: (r["pages"], r["added"], r["changed"], r["removed"]) for r in c2.collect()} == {"llm": (3, 1, 1, 1), "ops": (1, 0, 0, 0)}
    B.build(spark, str(tmp_path), "global", full, full=True)
    a, b = tables(spark, inc), tables(spark, full)
    assert a["pages"] == b["pages"] and a["edges"] == b["edges"] and [r[3] for r in a["communities"]] == [r[3] for r in b["communities"]]
    assert ("global", "llm", "llm/concepts/b", "mentions", "llm/concepts/a", "body") in a["edges"]


def test_a_topic_with_a_halting_issue_keeps_its_last_version(spark, tmp_path):
    w = Wiki(str(tmp_path))
    w.put("llm/concepts/a", page("A"))
    w.put("ops/concepts/x", page("X"))
    home = workspace(spark, "halt")
    B.build(spark, str(tmp_path), "global", home)
    w.put("llm/concepts/bad", page("Bad", rel=[("invented", "llm/concepts/a")]))
    w.put("ops/concepts/y", page("Y"))
    _, issues = B.build(spark, str(tmp_path), "global", home)
    assert {r["code"] for r in issues.collect()} == {"rel-undefined"}
    assert [r[2] for r in tables(spark, home)["pages"]] == ["llm/concepts/a", "ops/concepts/x", "ops/concepts/y"]


@pytest.mark.parametrize(("ref", "text", "codes"), [
    ("t/concepts/a", "no front matter", {"fm-parse"}), ("t/concepts/a", "---\ntitle: x", {"fm-parse"}), ("t/concepts/a", page("A", rel=[("uses", "T/x/y")]), {"ref-format"}),
    ("t/concepts/a", page("A", rel=[("uses", "t/concepts/a")]), {"rel-self"}), ("t/concepts/a", page("A", rel=[("mentions", "t/concepts/b")]), {"rel-undefined"}), ("t/concepts/a", page("A", rel=[("uses", "t/a/b")] * 2), {"rel-duplicate"}),
    ("t/concepts/b", page("A"), {"slug-mismatch"}), ("t/papers/a", page("A"), {"type-mismatch"}), ("t/concepts/a", page("A", extra="1"), {"fm-schema"}), ("t/concepts/a", page("A", keywords="[x, x]"), {"keywords-duplicate"}),
    ("t/concepts/2024", page("2024", slug="2024"), set()), ("t/concepts/a", page("A").replace("updated: 2026-01-02\n", ""), {"fm-schema"}),
])
def test_issue_codes(ref, text, codes):
    assert {i[1] for i in B.parse_page(text, ref, B.TYPES, B.RELATIONS)["issues"]} == codes


def test_config():
    c, wrong = B.load_config("version: 1\ntopics:\n  - name: llm\n    description: x\n  - name: Bad Name\ntypes: [concepts]\nrelations: [uses, mentions]\nother: 1")
    assert c.topics == ["llm"] and c.types == ["concepts"] and len(wrong) == 3
