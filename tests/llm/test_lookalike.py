import unicodedata

import pytest

from quillmesh.llm import lookalike as L

ODD = ["ｓumme", "\uff76\uff85", "cafe\u0301", "a\u200bb", "a\u00a0b", "a\u3000b", "non\u2011break", "\ufb01ne", "\u0441ache", "\u0420\u0421\u0410 model", "so\u00adft", "\ufeffx", "\u0399ngest", "x\uff0c y", "\u304b\u3099"]
PLAIN = ["summe", "カナ", "café", "Łódź", "граф знаний", "μέθοδος", "λ = 2", "π and Δ", "β version", "評価（検索）、はい。", "São index", "naïve – “quote” …", "", "これは！"]


@pytest.mark.parametrize("text", ODD)
def test_odd(text):
    assert L.written_form(text) != text and L.written_form(L.written_form(text)) == L.written_form(text)


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert L.written_form(text) == text


def test_canonical_makes_equal_and_keeps_apart():
    same = ["Résumé cache", "RE\u0301SUME\u0301  CACHE", "r\u00e9sum\u00e9\u00a0\u0441ache", "ｒésumé\u200b cache"]
    assert len({L.canonical(s) for s in same}) == 1
    apart = ["resume cache", "résumé cache", "граф", "rpaф", "straße 1", "strase 1"]
    assert len({L.canonical(s) for s in apart}) == len(apart)
    assert L.canonical("STRASSE") == L.canonical("straße")
    for i in range(0x110000):
        if unicodedata.category(chr(i)) == "Cf" and i < 0x2070 and chr(i) not in "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2":
            assert L.canonical(f"a{chr(i)}b") == "ab", hex(i)


def test_found(spark, rows):
    s = "page_id long, title string, summary string, keywords array<string>, value string, field string"
    p = spark.createDataFrame([(1, "ｘ", None, ["a", None, "b\u200b"], "own", "own"), (1, "ｘ", None, ["a"], "own", "own"), (2, "x", "é", None, None, None), (3, None, "e\u0301", [], None, None), (None, "ｘ", None, None, None, None)], s)
    assert rows(L.lookalike_found(p, "page_id", ["title", "summary"], ["keywords"])) == [(1, "keywords"), (1, "title"), (3, "summary")]
    assert L.lookalike_found(p.limit(0), "page_id", ["title"], ["keywords"]).count() == 0
    c = L.canonical_columns(p.where("page_id = 1"), ["title"], ["keywords"]).first()
    assert c["title_canonical"] == "x" and L.canonical_columns(p.where("page_id = 3"), ["title"], ["keywords"]).first()["title_canonical"] is None


REAL = ["ухо роса сор хор", "АВТОР", "нос", "нос и ухо", "книга АВТОР", "λόγος", "π", "σ and α", "μέθοδος νου", "Հայաստան", "ᏣᎳᎩ", "/ɡoʊ/ is go", "see библиотека АВТОР here", "Москва", "на практике"]
SPOOFED = [("օption", "option"), ("Ꭺpple", "Apple"), ("ɡood", "good"), ("the ТОС of it", "the TOC of it"), ("РСА and МСР", "PCA and MCP"), ("саche", "cache"), ("ベクトル索引 ТОС", "ベクトル索引 TOC"), ("5 − 3", "5 - 3"), ("mеthоd", "method"), ("библиoтекa", "библиотека")]


def test_words_of_other_scripts_stay(spark):
    table = L.confusable_letters(spark)
    assert len(table) > 120 and table["օ"] == "o" and table["Ꭺ"] == "A" and table["І"] == "I"
    for t in REAL:
        assert L.written_form(t, table) == t


def test_letters_of_another_script_are_read_in_the_script_of_their_word(spark):
    table = L.confusable_letters(spark)
    for t, want in SPOOFED:
        assert L.written_form(t, table) == want
