"""Queries of the text problems 1, 6, 7, 8 and 9, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import lookalike, markup, mixing, packing, quality, tokens
from quillmesh.session import spread, written


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _site() -> F.Column:
    """Pages of one layer and topic are one site: they share their template."""
    return F.concat_ws("/", "layer", "topic")


def _p1_pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(_t(spark, d, "pages").select("page_id", "layer", "topic", "body", "summary", "ingested_at"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_found(_p1_pages(spark, d), "page_id", ["body", "summary"], _site())


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_text(_p1_pages(spark, d), "page_id", ["body", "summary"], _site(), F.col("ingested_at"))


#: Texts with the clean form that they must have.
CASES = [
    ("<script>var a = 1 < 2;</script>hello <b>world</b>", "hello world"),
    ("<style>p{color:red}</style>hi", "hi"),
    ("<ul><li><p>alpha one</p></li><li>beta<ul><li>gamma</li></ul></li></ul>", "\u2022 alpha one\n\u2022 beta\n  \u2022 gamma"),
    ("<h2><div>Title</div></h2>text &amp; more", "\u00a7\u00a7 Title\ntext & more"),
    ("# Head\n\n- one\n- two\n\n```\nx = [[a]]\n```", "\u00a7 Head\n\u2022 one\n\u2022 two\n\u300e\nx = [[a]]\n\u300f"),
    ("a {{b|{{c|{{d|{{e|{{f|{{g|{{h|{{i|{{j}}}}}}}}}}}}}}}}}} k", "a  k"),
    (r"\section{One} see $\frac{\sqrt{a}}{b}$ and \frac{\sqrt{a}}{b}", "\u00a7\u00a7 One\nsee \u27e6\\frac{\\sqrt{a}}{b}\u27e7 and \u27e6\\frac{\\sqrt{a}}{b}\u27e7"),
    (r"\textbf{very \emph{deep} word} end", "very deep word end"),
    ("== Wiki ==\n'''bold''' and [[a/b/c|label]]", "\u00a7\u00a7 Wiki\nbold and label"),
    ("plain text, 3 < 4 and 5 * 6", "plain text, 3 < 4 and 5 * 6"),
    ("sign &#xE000; and \ue005 and \ue003x\ue003", "sign \ue000 and \ue005 and \ue003x\ue003"),
]


def p1_cases(spark: SparkSession, d: str) -> DataFrame:
    """The clean form of texts of a fixed table."""
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "case_id int, text string")
    return markup.clean_text(rows, "case_id", ["text"], F.lit("cases")).select("case_id", "clean")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_found(_t(spark, d, "pages"), "page_id", ["title", "summary"], ["keywords"])


def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    p = lookalike.canonical_columns(_t(spark, d, "pages").select("page_id", "title", "summary", "keywords"), ["title", "summary"], ["keywords"])
    return p.select("page_id", "title_canonical", "summary_canonical", F.array_join("keywords_canonical", "|").alias("keywords_canonical")).distinct()


def _limits(spark: SparkSession, d: str) -> list[dict]:
    rows = _t(spark, d, "pack_limits").where("limit_id is not null and capacity_tokens is not null").distinct().collect()
    return [{"limit_id": r["limit_id"], "capacity": r["capacity_tokens"]} for r in rows]


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.sized(_t(spark, d, "documents")), _limits(spark, d))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d), _limits(spark, d))


def p7_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Fill where the other two constraints bind as well: at most 12 texts a container, and half of the attention cost of a full one."""
    limits = [x | {"max_docs": 12, "max_cost": x["capacity"] ** 2 / 2} for x in _limits(spark, d)]
    return packing.fill_report(packing.pack(tokens.sized(_t(spark, d, "documents")), limits), limits)


def _sized_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").where("source is not null")
    return tokens.sized(docs, {"source": mixing.norm_source(F.col("source")), "digest": F.md5("text")})


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.distinct_texts(_sized_sources(spark, d)), _t(spark, d, "mix_targets"))


def p8_requested(spark: SparkSession, d: str) -> DataFrame:
    """Mixtures of half of all tokens each: scarce sources at their cap, with what they lack."""
    sizes = mixing.distinct_texts(_sized_sources(spark, d))
    total = (sizes.agg(F.sum("n")).first()[0] or 0) // 2
    return mixing.shares(written(mixing.mix(sizes, _t(spark, d, "mix_targets"), total or None), "mixed"), _t(spark, d, "mix_targets"), total or None)


def p8_stock(spark: SparkSession, d: str) -> DataFrame:
    """What each source counts with: its distinct texts, copies left out, and texts that count with another source."""
    return mixing.stock(_sized_sources(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(written(_mixed(spark, d), "mixed"), _t(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    got = quality.only_kinds(spread(_t(spark, d, "documents").select("doc_id", "text")), _t(spark, d, "quality_labels"))
    return got.where("kind <> 'prose'")


def p9_figures(spark: SparkSession, d: str) -> DataFrame:
    got = quality.kinds(spread(_t(spark, d, "documents").select("doc_id", "text")), _t(spark, d, "quality_labels"))
    return got.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    """The figures that every reader of quality statistics expects, by definitions that plain SQL shares."""
    f = quality.with_figures(_t(spark, d, "documents"))
    return f.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_chars", "n_words", "n_lines")], *[F.round(c, 6).alias(c) for c in ("mean_word", "symbol_ratio", "digit_ratio", "punct_lines")])


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p1_cases, p6_found, p6_canonical, p7_pack, p7_fill, p7_bounded, p8_mix, p8_shares, p8_requested, p8_stock, p9_found, p9_figures, p9_stats)}

_quoted = lambda t: "'" + t.replace("'", "''") + "'"

ORACLE = {
    "p8_stock": """with t as (select doc_id, lower(trim(source)) source, text from documents where source is not null and doc_id is not null and text is not null and text <> ''),
      o as (select text, arg_min(source, doc_id) own from t group by 1), k as (select source, text, count(*) n from t group by 1, 2)
      select source, count(*) filter (own = source) texts, coalesce(sum(n - 1) filter (own = source), 0)::bigint copies, count(*) filter (own <> source) elsewhere from k join o using (text) group by 1""",
    "p1_cases": "select * from (values " + ", ".join(f"({i}, {_quoted(c)})" for i, (_, c) in enumerate(CASES)) + ") t(case_id, clean)",
    "p9_stats": r"""with d as (select doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') t from documents where regexp_matches(text, '\S')),
      e as (select doc_id, t, length(regexp_replace(t, '\s+', '', 'g'))::double n, len(regexp_extract_all(t, '\S+'))::bigint n_words,
              list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '\S')) ls from d)
      select doc_id, length(t) n_chars, n_words, len(ls)::bigint n_lines, round(n / n_words, 6) mean_word,
        round((n - length(regexp_replace(regexp_replace(t, '\s+', '', 'g'), '[^\p{L}\p{N}\s]+', '', 'g'))) / n, 6) symbol_ratio,
        round(length(regexp_replace(t, '[^\p{N}]+', '', 'g')) / n, 6) digit_ratio,
        round(len(list_filter(ls, lambda l: regexp_matches(l, '[.!?。！？…]["''”’」』)）\]]*\s*$'))) / len(ls), 6) punct_lines from e where n > 0""",
}
