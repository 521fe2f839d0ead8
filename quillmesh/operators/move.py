"""Moving pages and renaming topics: a relabelling of refs in identity, relations and bodies; and the operation log."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.refs import norm_ref
from quillmesh.functions.text import rewrite_links, rewrite_topic_links
from quillmesh.operators.incremental import _fs

_REF = re.compile(r"[a-z0-9-]+/[a-z0-9-]+/[a-z0-9-]+")


def _map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def plan(pages: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """layer, ref, links: how many relation targets and body links each page would have rewritten; pages without any are left out.

    Only pages that name a moved ref at all reach Python.
    """
    olds = F.array(*[F.lit(k) for k in mapping])
    rel = F.size(F.filter(F.coalesce("relations", F.array()), lambda r: F.coalesce(F.array_contains(olds, norm_ref(r["to"])), F.lit(False))))
    some = F.col("body").rlike(r"\[\[(?:" + "|".join(re.escape(k) for k in mapping) + r")\]\]")
    p = pages.withColumn("has", F.coalesce(some, F.lit(False)))
    plain = p.where(~F.col("has")).select("layer", "ref", rel.alias("links"))
    body = p.where("has").withColumn("w", rewrite_links(F.col("body"), mapping)).select("layer", "ref", (rel + F.col("w.count")).alias("links"))
    return plain.unionByName(body).where("links > 0").select("layer", "ref", F.col("links").cast("long").alias("links"))


def relabel(pages: DataFrame, mapping: dict[str, str], layer: str | None = None, to_layer: str | None = None) -> DataFrame:
    """The pages with every moved ref under its new name: identity, relations and links of bodies outside code.

    With ``layer`` only pages of that layer change their name; references are
    rewritten in all layers.  ``to_layer`` moves them to another layer too.
    Relations and links of other pages stay as they are written.
    """
    m = _map(mapping)
    mine = F.array_contains(F.array(*[F.lit(k) for k in mapping]), F.col("ref"))
    if layer:
        mine = mine & (F.col("layer") == layer)
    new = F.when(mine, F.element_at(m, F.col("ref"))).otherwise(F.col("ref"))
    part = lambda i: F.when(mine, F.element_at(F.split(F.element_at(m, F.col("ref")), "/"), i))
    relations = F.transform("relations", lambda r: F.struct(r["rel"].alias("rel"), F.coalesce(F.try_element_at(m, norm_ref(r["to"])), r["to"]).alias("to")))
    out = pages.withColumns({
        "relations": relations, "body": rewrite_links(F.col("body"), mapping)["text"],
        "topic": F.coalesce(part(1), "topic"), "type": F.coalesce(part(2), "type"), "slug": F.coalesce(part(3), "slug"), "ref": new,
        **({"layer": F.when(mine, to_layer).otherwise(F.col("layer"))} if to_layer else {}),
    })
    return out.select(*pages.columns)


def check(pages: DataFrame, mapping: dict[str, str], layer: str, topics: list[str], types: list[str]) -> list[tuple[str, str, str]]:
    """(code, target, message) of what forbids the move. At most one row a moved ref reaches the driver."""
    bad = []
    for old, new in mapping.items():
        t = new.split("/")
        if not _REF.fullmatch(new):
            bad.append(("ref-format", new, "the new name is no ref"))
        elif t[0] not in topics:
            bad.append(("topic-undefined", new, f"no topic {t[0]}"))
        elif t[1] not in types:
            bad.append(("type-undefined", new, f"no type {t[1]}"))
    have = {r[0] for r in pages.where((F.col("layer") == layer) & F.col("ref").isin([*mapping, *mapping.values()])).select("ref").distinct().collect()}
    bad += [("ref-missing", o, "no such page") for o in mapping if o not in have and mapping[o] not in have]
    return bad + [("ref-exists", n, "the new name is taken") for o, n in mapping.items() if n in have and o in have]


def rename_topic(pages: DataFrame, old: str, new: str) -> DataFrame:
    """All pages of a topic under a new one. The rule is the mapping, so nothing is gathered: refs, relations and links of bodies outside code with that first part change."""
    swap = lambda c: F.regexp_replace(c, f"^{re.escape(old)}/", f"{new}/")
    relations = F.transform("relations", lambda r: F.struct(r["rel"].alias("rel"), F.when(norm_ref(r["to"]).startswith(f"{old}/"), swap(norm_ref(r["to"]))).otherwise(r["to"]).alias("to")))
    moved = F.col("topic") == old
    return pages.withColumns({"relations": relations, "body": rewrite_topic_links(F.col("body"), old, new)["text"], "ref": F.when(moved, swap(F.col("ref"))).otherwise(F.col("ref")), "topic": F.when(moved, new).otherwise(F.col("topic"))}).select(*pages.columns)


def log_rows(spark, day: str, op: str, targets: list[str], detail: str, refs: DataFrame) -> DataFrame:
    """Rows for the operation log: all targets must exist, or none is logged."""
    want = spark.createDataFrame([(t,) for t in targets], "ref string")
    missing = [r[0] for r in want.join(refs.select("ref").distinct(), "ref", "left_anti").collect()]
    if missing:
        raise LookupError(f"no such pages: {', '.join(sorted(missing))}")
    return want.select(F.lit(day).cast("date").alias("date"), F.lit(op).alias("op"), F.col("ref").alias("target"), F.lit(detail).alias("detail"))


def append_log(spark, path: str, rows: DataFrame) -> None:
    """Add the lines of rows to the log, a folder of text files; what is there stays as it is."""
    log_lines(rows).coalesce(1).write.mode("append").text(path)


def commit_move(store, mapping: dict[str, str], day: str, topics: list[str], types: list[str], log: str, layer: str = "global", to_layer: str | None = None) -> str:
    """Move pages in a store (see ``build.Store``) as a whole: check, relabel, derive edges and communities anew, commit, log.

    The version pointer moves last, so a failure before it leaves the old
    state; run again, a move that was committed is not applied twice, and only
    its log line is added if it is missing.  Returns moved or resumed.
    """
    from quillmesh.operators import community, graph

    was = store.current()
    if was is None:
        raise LookupError("there is nothing built to move in")
    spark, pages = store.spark, store.table("pages", was)
    have = {(r["layer"], r["ref"]) for r in pages.where(F.col("ref").isin([*mapping, *mapping.values()])).select("layer", "ref").distinct().collect()}
    done = all((to_layer or layer, n) in have and (layer, o) not in have for o, n in mapping.items())
    if not done:
        bad = check(pages, mapping, layer, topics, types)
        if bad:
            raise ValueError("; ".join(": ".join(b) for b in bad))
        new = relabel(pages, mapping, layer, to_layer)
        e = graph.edges(new)
        c = community.inherit_ids(store.table("communities", was), community.communities(community.pair_weights(e, new)))
        store.commit(store.next_version(), {"pages": new, "edges": e, "communities": c})
    rows = spark.createDataFrame([(day, "move", o, f"to {n}") for o, n in mapping.items()], "date string, op string, target string, detail string").withColumn("date", F.col("date").cast("date"))
    lines = log_lines(rows)
    fs, p = _fs(spark, log)
    if fs.exists(p):
        lines = lines.join(spark.read.text(log), "value", "left_anti")
    lines.coalesce(1).write.mode("append").text(log)
    return "resumed" if done else "moved"


def log_lines(log: DataFrame) -> DataFrame:
    """value: the log as lines ``- date [op] target — detail``."""
    tail = F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" — "), "detail")).otherwise("")
    return log.select(F.concat(F.lit("- "), F.coalesce(F.col("date").cast("string"), F.lit("")), F.lit(" ["), F.coalesce("op", F.lit("")), F.lit("] "), F.coalesce("target", F.lit("")), tail).alias("value"))
