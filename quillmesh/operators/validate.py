"""Integrity checks: one query per issue code, all with the columns severity, code, target, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.refs import is_ref, norm_ref
from quillmesh.functions.text import body_links, has_h1
from quillmesh.operators import overlay
from quillmesh.operators.documents import format_issues

#: Order of severities in a report.
SEVERITY = {"error": 0, "warn": 1, "info": 2}


def _issue(df: DataFrame, severity: str, code: str, target: Column, message: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), target.alias("target"), message.alias("message"))


def _rel(pages: DataFrame) -> DataFrame:
    r = pages.select("layer", "topic", "ref", F.posexplode("relations").alias("pos", "r")).where("r.rel is not null and r.to is not null")
    return r.select("layer", "topic", "ref", "pos", F.col("r.rel").alias("rel"), F.col("r.to").alias("to_raw"), norm_ref(F.col("r.to")).alias("to"))


def _links(pages: DataFrame) -> DataFrame:
    return pages.where(F.contains("body", F.lit("[["))).select("layer", "ref", F.explode(body_links(F.col("body"))).alias("link")).distinct()


def broken_relations(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """Relation targets that no layer has."""
    r = _rel(pages).where(is_ref(F.col("to"))).select("ref", "rel", "to").distinct()
    return _issue(r.join(refs.select(F.col("ref").alias("to")).distinct(), "to", "left_anti"), "error", "link-broken-fm", F.col("ref"), F.concat("rel", F.lit(" -> "), "to"))


def broken_links(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """Canonical body links that no layer has; once a page and link."""
    l = _links(pages).where(is_ref(F.col("link"))).select("ref", "link").distinct()
    return _issue(l.join(refs.select(F.col("ref").alias("link")).distinct(), "link", "left_anti"), "warn", "link-broken-body", F.col("ref"), F.col("link"))


def malformed_links(pages: DataFrame) -> DataFrame:
    """Body links that are no ref in canonical form."""
    return _issue(_links(pages).where(~is_ref(F.col("link"))).select("ref", "link").distinct(), "error", "ref-format", F.col("ref"), F.col("link"))


def undefined_relations(pages: DataFrame, vocabulary: list[str]) -> DataFrame:
    return _issue(_rel(pages).where(~F.col("rel").isin(vocabulary)).select("ref", "rel").distinct(), "error", "rel-undefined", F.col("ref"), F.col("rel"))


def self_relations(pages: DataFrame) -> DataFrame:
    return _issue(_rel(pages).where(F.col("to") == F.col("ref")).select("ref", "rel").distinct(), "error", "rel-self", F.col("ref"), F.col("rel"))


def _repeats(d: DataFrame, code: str, what: Column) -> DataFrame:
    """One warning for each time but the first (column n: how often)."""
    again = d.where("n > 1").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    return _issue(again, "warn", code, F.col("ref"), F.concat(what, F.lit(" #"), F.col("k").cast("string")))


def duplicate_relations(pages: DataFrame) -> DataFrame:
    """A row for each time but the first that a page gives a pair of relation and target."""
    return _repeats(_rel(pages).groupBy("layer", "ref", "rel", "to").agg(F.count("*").alias("n")), "rel-duplicate", F.concat("rel", F.lit(" -> "), "to"))


def duplicate_keywords(pages: DataFrame) -> DataFrame:
    d = pages.select("layer", "ref", F.explode("keywords").alias("k")).where("k is not null").groupBy("layer", "ref", F.col("k").alias("w")).agg(F.count("*").alias("n"))
    return _repeats(d, "keywords-duplicate", F.col("w"))


def malformed_relations(pages: DataFrame) -> DataFrame:
    """Relation targets that are no ref in canonical form as they are written."""
    return _issue(_rel(pages).where(~is_ref(F.col("to_raw"))).select("ref", "to_raw").distinct(), "error", "ref-format", F.col("ref"), F.col("to_raw"))


def type_mismatch(pages: DataFrame, types: list[str]) -> DataFrame:
    """The type is not in the vocabulary, or not that of the ref."""
    part = F.element_at(F.split("ref", "/"), 2)
    return _issue(pages.where(~F.coalesce(F.col("type").isin(types) & (F.col("type") == part), F.lit(False))), "error", "type-mismatch", F.col("ref"), F.coalesce("type", F.lit("")))


def slug_mismatch(pages: DataFrame) -> DataFrame:
    part = F.element_at(F.split("ref", "/"), 3)
    return _issue(pages.where(~F.coalesce(F.lower(F.trim("slug")) == part, F.lit(False))), "error", "slug-mismatch", F.col("ref"), F.coalesce("slug", F.lit("")))


def missing_fields(pages: DataFrame) -> DataFrame:
    """Pages without title or date of update."""
    f = F.explode(F.array_compact(F.array(F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "title"), F.when(F.col("updated").isNull(), "updated"))))
    return _issue(pages.select("ref", f.alias("f")), "error", "fm-schema", F.col("ref"), F.concat(F.col("f"), F.lit(" is missing")))


def body_heading(pages: DataFrame) -> DataFrame:
    """First-level headings in bodies."""
    return _issue(pages.where(has_h1(F.col("body"))), "warn", "body-h1", F.col("ref"), F.col("layer"))


def shadow(pages: DataFrame) -> DataFrame:
    return _issue(overlay.shadowed(pages), "warn", "shadow", F.col("ref"), F.lit("project stands for global"))


def orphans(index: DataFrame, merged: DataFrame) -> DataFrame:
    """Pages of the merged graph without any edge."""
    ends = merged.select(F.col("src_ref").alias("ref")).union(merged.select(F.col("dst_ref").alias("ref"))).distinct()
    return _issue(index.join(ends, "ref", "left_anti"), "warn", "page-orphan", F.col("ref"), F.lit("no edges"))


def degrees(index: DataFrame, merged: DataFrame) -> DataFrame:
    """ref, degree of every page: each merged edge counts at both ends that are pages."""
    d = merged.select(F.explode(F.array("src_ref", "dst_ref")).alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))
    return index.select("ref").join(d, "ref", "left").select("ref", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def contradictions(merged: DataFrame) -> DataFrame:
    e = merged.where("rel = 'contradicts'").select("src_ref", "dst_ref").distinct()
    return _issue(e, "info", "contradicts-pair", F.col("src_ref"), F.col("dst_ref"))


def superseded(merged: DataFrame) -> DataFrame:
    """Edges to a superseded page, other than those of its superseder; of several superseders the last in order counts."""
    s = merged.where("rel = 'supersedes'").groupBy("dst_ref").agg(F.max("src_ref").alias("by"))
    e = merged.join(s, "dst_ref").where(F.col("src_ref") != F.col("by")).select("src_ref", "rel", "dst_ref", "by").distinct()
    return _issue(e, "info", "superseded-ref", F.col("src_ref"), F.concat("rel", F.lit(" -> "), "dst_ref", F.lit(" (superseded by "), "by", F.lit(")")))


def empty_topics(pages: DataFrame, topics: list[str]) -> DataFrame:
    spark = pages.sparkSession
    t = spark.createDataFrame([(x,) for x in topics], "topic string")
    return _issue(t.join(pages.select("topic").distinct(), "topic", "left_anti"), "info", "topic-empty", F.col("topic"), F.lit("no pages"))


def stale_topics(changes: DataFrame) -> DataFrame:
    """Topics whose pages differ from the manifest (changes: topic, ref, change)."""
    c = changes.where("change <> 'same'").groupBy("topic").agg(F.count("*").alias("n"))
    return _issue(c, "warn", "derived-stale", F.col("topic"), F.concat(F.col("n").cast("string"), F.lit(" pages differ")))


def stale_derived(topics: DataFrame, tables: list[str]) -> DataFrame:
    """Why derived tables of a topic are stale: topics has topic, pages (any now), built (in the manifest), present (array of its derived tables), current (written by this version)."""
    missing = F.array_except(F.array(*[F.lit(t) for t in tables]), F.col("present"))
    why = F.when(~F.col("built"), F.when(F.col("pages") | (F.size("present") > 0), F.array(F.lit("not built yet")))).otherwise(F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))), F.when(~F.col("current"), F.lit("built by another version")),
    )))
    return _issue(topics.select("topic", F.explode(why).alias("m")), "warn", "derived-stale", F.col("topic"), F.col("m"))


def config_issues(spark, wrong: dict[str, list[str]], declared: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Faults of the configurations by layer, and topics (layer, topic) that have pages but are not declared."""
    rows = [(layer, m) for layer, ms in wrong.items() for m in ms]
    out = _issue(spark.createDataFrame(rows, "layer string, m string"), "error", "config-schema", F.col("layer"), F.col("m"))
    if declared is not None and found is not None:
        extra = found.select("layer", "topic").distinct().join(declared, ["layer", "topic"], "left_anti")
        out = out.unionByName(_issue(extra, "error", "config-schema", F.concat_ws("/", "layer", "topic"), F.lit("the topic is not declared")))
    return out


def parse_issues(parsed: DataFrame) -> DataFrame:
    """What parsing the files reported (column issues, see ``build.parse``)."""
    return parsed.select(F.explode("issues").alias("i")).select("i.severity", "i.code", "i.target", "i.message")


def stale_documents(stale: DataFrame) -> DataFrame:
    return _issue(stale, "warn", "community-stale", F.concat_ws("/", "topic", "cid"), F.col("reason"))


def report(parts: list[DataFrame]) -> DataFrame:
    """All issues, by severity, code, target and message."""
    every = reduce(DataFrame.unionByName, parts)
    rank = reduce(lambda a, kv: F.when(F.col("severity") == kv[0], kv[1]).otherwise(a), SEVERITY.items(), F.lit(9))
    return every.orderBy(rank, "code", "target", "message")


def validate(
    pages: DataFrame, index: DataFrame, merged: DataFrame, vocabulary: list[str], types: list[str], topics: list[str] | None = None, changes: DataFrame | None = None,
    stale: DataFrame | None = None, documents: DataFrame | None = None, more: tuple[DataFrame, ...] = (),
) -> DataFrame:
    """Every check on the pages of both layers and the merged graph.

    topics: declared names, for topics without pages; changes: pages against
    the manifest; stale: community documents to renew; documents: their texts;
    more: issues found elsewhere (configuration, parsing, derived tables).
    """
    refs = pages.select("ref")
    parts = [
        broken_relations(pages, refs), broken_links(pages, refs), malformed_links(pages), malformed_relations(pages), undefined_relations(pages, vocabulary), self_relations(pages),
        duplicate_relations(pages), duplicate_keywords(pages), type_mismatch(pages, types), slug_mismatch(pages), missing_fields(pages), body_heading(pages),
        shadow(pages), orphans(index, merged), contradictions(merged), superseded(merged),
    ]
    parts += [empty_topics(pages, topics)] if topics is not None else []
    parts += [stale_topics(changes)] if changes is not None else []
    parts += [stale_documents(stale)] if stale is not None else []
    parts += [format_issues(documents)] if documents is not None else []
    return report([*parts, *more])


def quick(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """layers, pages, derived (fresh or stale) in one row."""
    p = pages.agg(F.count_distinct("layer").alias("layers"), F.count("*").alias("pages"))
    s = changes.agg(F.coalesce(F.bool_or(F.col("change") != "same"), F.lit(False)).alias("s"))
    return p.join(s).select("layers", "pages", F.when(F.col("s"), "stale").otherwise("fresh").alias("derived"))
