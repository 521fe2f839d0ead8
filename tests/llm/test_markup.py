from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.llm import markup as M

CASES = [
    ("plain words, a < b and c > d, R&D, Q&A, C# and F#, 2.0_beta, load_page_index", set()),
    ("costs between $5 and $12; see #42, item [3] and [sic] :-)", set()),
    ("from List<Page> to Map<Ref, Page>; C:\\work\\notes; *.md below ~/notes; 20 degrees & 60%, if possible*.", set()),
    ("a -> b <- a, n^2 pairs, {a, b, c}, 2 * 3 * 4 cells, ~24, x >= y", set()),
    ("1990. was a year\nand 5 more", set()),
    ("<p>text</p>", {"html"}), ("a<br>b", {"html"}), ("x &amp; y", {"html"}), ("&#8217;", {"html"}), ("<!-- note -->", {"html"}), ("AT&T; &unknown;", set()),
    ("**bold**", {"markdown"}), ("`<b>$x$</b>`", {"markdown"}), ("~~~\n== no ==\n[[no]]\n~~~", {"markdown"}), ("# Head", {"markdown"}), ("Head\n====", {"markdown"}),
    ("- item", {"markdown"}), ("> quote", {"markdown"}), ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}), ("![x](y.png)", {"markdown"}), ("word[^1]", {"markdown"}), ("~~gone~~ _so_", {"markdown"}),
    ("[[a/b/c]]", {"wiki"}), ("{{stub}}", {"wiki"}), ("''it''", {"wiki"}), ("== Head ==", {"wiki"}), ("{| class=\"x\"\n|-\n| a\n! b\n|}", {"wiki"}), ("[https://a.example text]", {"wiki"}),
    ("$x_1$ grows", {"latex"}), ("\\textbf{x}", {"latex"}), ("\\( n \\)", {"latex"}), ("$$\na\n$$", {"latex"}), ("O(n \\log n)", {"latex"}),
    ("```\nopen to the end\n<b>", {"markdown"}), ("", set()), (None, set()),
]


@pytest.mark.parametrize(("text", "families"), CASES)
def test_families(text, families):
    assert M.Parse(text).families == families


def test_clean_text_keeps_structure():
    text = "## Head\r\n\r\n<p>A <b>bold</b> &amp; [[a/b/c|name]] word</p>\n- one\n  - two\n\n```py\nx = a_b_c\n```\n$n^2$ and \\section{Part}\n\n| a | b |\n|---|---|\n| 1 | 2 |"
    clean = M.render(M.Parse(text).root, frozenset())
    assert clean.split("\n") == ["§§ Head", "A bold & name word", "• one", "  • two", "『", "x = a_b_c", "』", "⟦n^2⟧ and", "§§ Part", "a | b", "1 | 2"]


KEPT = [
    ("<ul><li><p>one</p><p>two</p></li></ul>", "• one\ntwo"),
    ("<ul><li>a<ul><li>b</li></ul>c</li><li>d</li></ul>", "• a\n  • b\nc\n• d"),
    ("<ul><li>a<li>b<ul><li>c<li>d</ul><li><p>e</ul>after", "• a\n• b\n  • c\n  • d\n• e\nafter"),
    ("<h2><div>Head</div></h2><h3>Open<p>text", "§§ Head\n§§§ Open\ntext"),
    ("a \\cite{k1,\n  k2} b \\label{x_{1}} c", "a  b  c"),
    ("a \\cite{key and more\nnext line\n\nlast } end", "a key and more\nnext line\nlast } end"),
    ("a \\ref{open \\textbf{x} b", "a open x b"),
    ("\\section{Open head\nrest", "§§ Open head\nrest"),
]


@pytest.mark.parametrize(("text", "clean"), KEPT)
def test_no_text_is_lost(text, clean):
    assert M.render(M.Parse(text).root, frozenset()) == clean


def test_template_inside_an_item_is_deleted():
    root = M.Parse("<ul><li>own <p>shared</p></li><li><p>shared</p></li></ul>").root
    assert M.render(root, {M.Parse("<p>shared</p>").root.children[0].digest}) == "• own"


def test_very_long_and_nested_texts_end():
    for t in ("*" * 50_000, "[" * 20_000, "<div>" * 2_000, "{{" * 5_000, "`" * 9_999, "$a " * 9_000, "== " * 9_000, "word " * 60_000):
        M.render(M.Parse(t).root, frozenset())


def pages(spark, rows):
    return spark.createDataFrame([(i, h, b, s, "own", datetime(2026, 1, 1)) for i, h, b, s in rows], "page_id long, site string, body string, summary string, family string, key timestamp")


def test_found(spark, rows):
    p = pages(spark, [(1, "s", "<b>x</b>", None), (1, "s", "<b>x</b>", None), (2, None, None, ""), (3, "s", "**a** [[x]]", "$x$"), (None, "s", "<i>a</i>", "b")])
    assert rows(M.markup_found(p, "page_id", ["body", "summary"], F.col("site"))) == [(1, "body", "html"), (3, "body", "markdown"), (3, "body", "wiki"), (3, "summary", "latex")]
    assert M.markup_found(p.limit(0), "page_id", ["body"], F.col("site")).count() == 0


def test_open_commands_end_in_time():
    for t in ("\\cite{" * 20_000 + "}", "\\emph{" * 20_000 + "\n\n}", "<li>" * 9_000):
        M.render(M.Parse(t).root, frozenset())


def test_site_template_is_deleted(spark):
    nav = "<div><ul><li>Home</li><li>Login</li></ul></div>\n"
    p = pages(spark, [(i, "s", nav + f"<p>text {i}</p>\n## Same", None) for i in range(20)] + [(100, None, nav + "alone", None)])
    got = {r["page_id"]: r["clean"] for r in M.clean_text(p, "page_id", ["body", "summary"], F.col("site"), min_pages=8, min_share=0.9).collect()}
    assert got[3] == "text 3" and "Home" in got[100] and "alone" in got[100]
    # A template's markup is the text's too, and is found by way of the same rows.
    every = M.clean_pages(p, "page_id", ["body", "summary"], F.col("site"), min_pages=8, min_share=0.9)
    assert {(r["removed"] > 0, "html" in r["families"]) for r in every.where("host = 's'").collect()} == {(True, True)}
    found = M.markup_found(p, "page_id", ["body"], F.col("site"), min_pages=8, min_share=0.9)
    assert found.where("family = 'html'").count() == 21


def test_repeated_pages_hold_their_first_text(spark):
    p = pages(spark, [(1, "s", "later", None), (1, "s", "first", None), (1, "s", "undated", None)]).withColumn("at", F.expr("case body when 'later' then 2 when 'first' then 1 end"))
    assert [r["clean"] for r in M.clean_text(p, "page_id", ["body", "summary"], F.col("site"), F.col("at")).collect()] == ["first"]


PIECES = [chr(0xE000 + k) for k in range(7)] + (
    "0 1 { } {{ }} | [[ ]] [ ] ( ) <li> <ul> </ul> </li> <h1> </h1> <p> <script> </script> <pre> </pre> <td> <!-- --> &#xE000; &#xE003; &amp; ` ``` ~~~ $ $$ \\ \\frac{ "
    "\\textbf{ \\section{ \\cite{ \\item \\[ \\] * ** _ __ ~~ '' == # > {| |} |- word https://a.b [^1]:"
).split() + [" ", "\n", "\n\n", "- "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_any_text_ends_without_error(pieces):
    p = M.Parse("".join(pieces))
    assert isinstance(M.render(p.root), str) and p.families <= set(M.FAMILIES)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from([chr(0xE000 + k) for k in range(7)] + ["a"]), min_size=1, max_size=12))
def test_private_signs_of_the_text_stay(text):
    assert M.render(M.Parse(text).root) == text


def test_any_depth_of_nesting():
    assert M.render(M.Parse("<div>" * 3_000 + "x" + "</div>" * 3_000).root) == "x"
    assert M.render(M.Parse("{{a|" * 3_000 + "}}" * 3_000 + "k").root) == "k"
    assert M.render(M.Parse("\\emph{" * 3_000 + "x" + "}" * 3_000).root) == "x"
    deep = M.render(M.Parse("<ul><li>a" * 400 + "</li></ul>" * 400).root).split("\n")
    assert len(deep) == 400 and deep[399] == "  " * 399 + "• a"


def test_template_of_a_part_of_a_host_is_deleted(spark):
    nav = "<ul><li>Home</li><li>Index</li><li>Login</li></ul>\n<footer>(c) us</footer>\n"
    note = "This page is kept by the group that runs the service.\n\n"
    usual = "## See also\n\n- index\n\n```\nrun the whole job with all of its usual options\n```\n\n$a_1 + a_2 + a_3 + a_4 + a_5 + a_6 + a_7 + a_8 + a_9$\n\n"
    p = pages(spark, [(i, "s", (nav + note if i < 25 else nav * (i < 32)) + (usual if i % 3 == 0 else "") + f"text {i}", None) for i in range(100)])
    got = {r["page_id"]: r["clean"] for r in M.clean_text(p, "page_id", ["body", "summary"], F.col("site")).collect()}
    assert got[1] == "text 1" and got[31] == "text 31"
    assert got[0] == got[99].replace("99", "0") and got[99].startswith("§§ See also\n• index\n『\nrun the whole job")
    # On fewer than eight pages nothing is template.
    few = M.clean_text(p.where("page_id < 7"), "page_id", ["body"], F.col("site")).collect()
    assert all("Home" in r["clean"] for r in few)
