"""From page files to derived tables: scan, hash, diff, parse, gate and commit, in full or only what changed.

Files are read with Spark, parsed in Arrow batches, and everything derived is
written as one new version of the tables; a pointer file that names the
version is replaced last, by rename.
"""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh import SCHEMA_VERSION, __version__
from quillmesh.functions import frontmatter as fm
from quillmesh.functions.text import summary_of
from quillmesh.operators import community, graph, overlay
from quillmesh.operators.incremental import _fs, read_text, write_once
from quillmesh.session import written

# The vocabulary that a corpus has unless its configuration says otherwise.
TYPES = ["concepts", "entities", "papers", "articles", "queries", "decisions"]
RELATIONS = ["relates_to", "is_a", "part_of", "uses", "contradicts", "supersedes", "derived_from", "evaluated_by"]
KEYS = ["title", "type", "slug", "summary", "keywords", "relations", "sources", "updated"]

PAGE = (
    "title string, type string, slug string, summary string, keywords array<string>, relations array<struct<rel:string,to:string>>, "
    "sources array<struct<url:string,title:string,accessed:date>>, updated date, body string, "
    "issues array<struct<severity:string,code:string,target:string,message:string,halts:boolean>>"
)


@dataclass
class Config:
    """Topics, types and relations of a layer."""

    topics: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=lambda: list(TYPES))
    relations: list[str] = field(default_factory=lambda: list(RELATIONS))


def load_config(text: str) -> tuple[Config, list[str]]:
    """The configuration of a layer and what is wrong with it: keys it does not know, values of another kind, names that are no slug or stand twice."""
    data, issues = fm.parse_lines(text.replace("\r\n", "\n").split("\n"))
    wrong = [f"line {n}: {m}" for n, m in issues]
    c = Config()
    wrong += [f"unknown key {k}" for k in data if k not in ("version", "topics", "types", "relations", "vector")]
    if not isinstance(data.get("version", 1), int) or isinstance(data.get("version"), bool):
        wrong.append("version is no number")
    if not isinstance(data.get("vector", False), bool):
        wrong.append("vector is neither true nor false")
    topics = data.get("topics")
    if topics is not None and not isinstance(topics, list):
        wrong.append("topics is no list")
    for t in topics if isinstance(topics, list) else []:
        if isinstance(t, dict):
            wrong += [f"unknown key {k} of a topic" for k in t if k not in ("name", "description")]
        name = t.get("name") if isinstance(t, dict) else t
        if not isinstance(name, str) or not re.fullmatch("[a-z0-9-]+", name):
            wrong.append(f"topic {name!r} is no slug")
        elif name in c.topics:
            wrong.append(f"topic {name} is given again")
        else:
            c.topics.append(name)
    for key, form in (("types", "[a-z0-9-]+"), ("relations", "[a-z0-9_]+")):
        given = data.get(key)
        if given is None:
            continue
        if not isinstance(given, list):
            wrong.append(f"{key} is no list")
            continue
        good = [x for x in given if isinstance(x, str) and re.fullmatch(form, x)]
        wrong += [f"{key}: {x!r} is no name" for x in given if x not in good]
        wrong += [f"{key}: {x} is given again" for i, x in enumerate(good) if x in good[:i]]
        setattr(c, key, list(dict.fromkeys(good)))
    if "mentions" in c.relations:
        wrong.append("mentions is reserved for links of the body")
    return c, wrong


def scan(spark: SparkSession, root: str, layer: str, content: bool = True) -> DataFrame:
    """layer, topic, type, slug, ref, path and, if wanted, text and hash of the page files one level below pages/<type>/.

    Without content no file is opened.  Line ends become LF; bytes that are no
    UTF-8 become the replacement sign.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(f"{root.rstrip('/')}/topics/*/pages/*/*")
    part = lambda i: F.regexp_extract("path", r"/topics/([^/]+)/pages/([^/]+)/([^/]+)\.md$", i)
    d = f.select(F.lit(layer).alias("layer"), part(1).alias("topic"), part(2).alias("type"), part(3).alias("slug"), "path", *(["content"] if content else []))
    d = d.withColumn("ref", F.concat_ws("/", "topic", "type", "slug"))
    if content:
        d = d.withColumns({"hash": F.concat(F.lit("sha256:"), F.sha2("content", 256)), "text": F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\r\n"), F.lit("\n"))}).drop("content")
    return d


def scan_topics(spark: SparkSession, root: str) -> list[str]:
    """The topics that have a folder, with or without pages."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/topics")
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory() and f.getPath().getName()[0] != ".") if fs.exists(p) else []


def parse_page(text: str, ref: str, types: list[str], relations: list[str]) -> dict | None:
    """The fields of a page and its issues; a page without front matter has only its issue."""
    topic, type_dir, slug_name = ref.split("/")
    issues: list[tuple] = []
    err = lambda code, msg: issues.append(("error", code, ref, msg, True))
    warn = lambda code, msg: issues.append(("warn", code, ref, msg, False))
    lines, body, fatal = fm.split_page(text)
    out = dict.fromkeys(("title", "type", "slug", "summary", "keywords", "relations", "sources", "updated")) | {"body": body}
    if fatal:
        err("fm-parse", fatal)
        return out | {"body": None, "issues": issues}
    data, bad = fm.parse_lines(lines, 2)
    for no, msg in bad:
        err("fm-parse", f"line {no}: {msg}")
    for k in data:
        if k not in KEYS:
            err("fm-schema", f"unknown key {k}")
    for k in ("title", "type", "slug"):
        v = fm.as_text(data.get(k))
        if not isinstance(v, str) or not v:
            err("fm-schema", f"{k} is missing or no text")
        else:
            out[k] = v
    if out["type"] and (out["type"] != type_dir or out["type"] not in types):
        err("type-mismatch", f"type {out['type']} in the folder {type_dir}")
    if out["slug"] and out["slug"] != slug_name:
        err("slug-mismatch", f"slug {out['slug']} in the file {slug_name}")
    if isinstance(data.get("updated"), datetime.date):
        out["updated"] = data["updated"]
    else:
        err("fm-schema", "updated is missing or no date")
    if data.get("summary") is not None:
        if isinstance(data["summary"], str):
            out["summary"] = data["summary"]
        else:
            err("fm-schema", "summary is no text")
    out["keywords"] = _keywords(data.get("keywords"), err, warn)
    out["relations"] = _relations(data.get("relations"), ref, relations, err, warn)
    out["sources"] = _sources(data.get("sources"), err)
    return out | {"issues": issues}


def _keywords(given, err, warn) -> list[str]:
    out: list[str] = []
    if given is None:
        return out
    if not isinstance(given, list):
        err("fm-schema", "keywords is no list")
        return out
    for k in map(fm.as_text, given):
        if not isinstance(k, str):
            err("fm-schema", "a keyword is no text")
        else:
            if k in out:
                warn("keywords-duplicate", f"keyword {k} is given again")
            out.append(k)
    return out


def _relations(given, ref: str, vocabulary: list[str], err, warn) -> list[dict]:
    out: list[dict] = []
    if given is not None and not isinstance(given, list):
        err("fm-schema", "relations is no list")
    for r in given if isinstance(given, list) else []:
        if not isinstance(r, dict) or not isinstance(r.get("rel"), str) or not isinstance(r.get("to"), str):
            err("fm-schema", "a relation needs rel and to")
            continue
        for k in r:
            if k not in ("rel", "to"):
                err("fm-schema", f"unknown key {k} of a relation")
        if r["rel"] not in vocabulary or r["rel"] == "mentions":
            err("rel-undefined", f"relation {r['rel']}")
        if not re.fullmatch(r"[a-z0-9-]+/[a-z0-9-]+/[a-z0-9-]+", r["to"]):
            err("ref-format", f"target {r['to']}")
        if r["to"] == ref:
            err("rel-self", f"relation {r['rel']} to itself")
        one = {"rel": r["rel"], "to": r["to"]}
        if one in out:
            warn("rel-duplicate", f"relation {r['rel']} to {r['to']} is given again")
        out.append(one)
    return out


def _sources(given, err) -> list[dict]:
    out: list[dict] = []
    if given is not None and not isinstance(given, list):
        err("fm-schema", "sources is no list")
    for s in given if isinstance(given, list) else []:
        if not isinstance(s, dict) or not isinstance(s.get("url"), str):
            err("fm-schema", "a source needs a url")
            continue
        if s.get("accessed") is not None and not isinstance(s["accessed"], datetime.date):
            err("fm-schema", "accessed is no date")
        out.append({"url": s["url"], "title": fm.as_text(s.get("title")), "accessed": s["accessed"] if isinstance(s.get("accessed"), datetime.date) else None})
    return out


def parse(scanned: DataFrame, config: Config) -> DataFrame:
    """Scanned pages with the fields of their front matter, body and issues. An absent summary is taken from the body."""
    types, relations = list(config.types), list(config.relations)

    @F.pandas_udf(PAGE)
    def parsed(text: pd.Series, ref: pd.Series) -> pd.DataFrame:
        rows = [parse_page(t, r, types, relations) for t, r in zip(text, ref, strict=True)]
        d = pd.DataFrame(rows, columns=["title", "type", "slug", "summary", "keywords", "relations", "sources", "updated", "body", "issues"])
        d["issues"] = [[dict(zip(("severity", "code", "target", "message", "halts"), i, strict=True)) for i in x] for x in d["issues"]]
        return d

    d = scanned.withColumn("p", parsed("text", "ref"))
    return d.select("layer", "topic", "ref", "path", "hash", d["type"], d["slug"], "p.title", F.coalesce("p.summary", summary_of(F.coalesce("p.body", F.lit("")))).alias("summary"), "p.keywords", "p.relations", "p.sources", "p.updated", "p.body", "p.issues")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change (added, changed, removed, same) between two tables of keys and hash: a full outer join."""
    o, n = (d.select(*keys, F.col("hash").alias(x)) for d, x in ((old, "_o"), (new, "_n")))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "same").otherwise("changed")
    return o.withColumn("_o", F.coalesce("_o", F.lit(""))).join(n.withColumn("_n", F.coalesce("_n", F.lit(""))), keys, "full_outer").select(*keys, change.alias("change"))


def counters(changes: DataFrame, by: str = "topic") -> DataFrame:
    """by, pages, added, changed, removed."""
    n = lambda c: F.count_if(F.col("change") == c).alias(c)
    return changes.groupBy(by).agg(F.count_if(F.col("change") != "removed").alias("pages"), n("added"), n("changed"), n("removed"))


class Store:
    """Versioned tables below a path: pages, edges, communities. _CURRENT names the version that holds."""

    TABLES = ("pages", "edges", "communities")

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    def current(self) -> dict | None:
        """The committed version, or None if there is none or another version of the engine wrote it."""
        fs, p = _fs(self.spark, f"{self.home}/_CURRENT.json")
        if not fs.exists(p):
            return None
        try:
            v = json.loads(read_text(self.spark, f"{self.home}/_CURRENT.json"))
        except ValueError:
            return None
        return v if v.get("schema_version") == SCHEMA_VERSION and v.get("tool_version") == __version__ else None

    def next_version(self) -> int:
        """A number above that of every version that was ever written here, committed or not."""
        fs, p = _fs(self.spark, self.home)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)), default=0) + 1

    def table(self, name: str, version: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/v{version['version']}/{name}")

    def commit(self, version: int, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.home}/v{version}/{name}")
        write_once(self.spark, f"{self.home}/_CURRENT.json", json.dumps({"version": version, "schema_version": SCHEMA_VERSION, "tool_version": __version__}))


def build(spark: SparkSession, root: str, layer: str, home: str, config: Config | None = None, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bring the derived tables up to date; counters per topic and issues.

    Only files that are new or changed, or whose type or relations the
    configuration no longer has, are parsed; the rest is carried over.  A topic
    with an issue that halts keeps its last version; other topics go on.  The
    result equals that of a full build.
    """
    config = config or Config()
    store = Store(spark, home)
    was = None if full else store.current()
    files = scan(spark, root, layer)
    now = written(files.where(F.col("topic").isin(config.topics)) if config.topics else files, "scan")
    if was:
        old = store.table("pages", was)
        ch = written(diff(old, now, ["topic", "ref"]), "diff")
        odd = old.where(~F.col("type").isin(config.types) | F.exists("relations", lambda r: ~r["rel"].isin(config.relations))).select("topic", "ref")
        again = ch.where(F.col("change").isin("added", "changed")).select("topic", "ref").union(odd).distinct()
        fresh = parse(now.join(again, ["topic", "ref"], "left_semi"), config)
        kept = old.join(ch.where("change = 'same'").select("topic", "ref"), ["topic", "ref"], "left_semi").join(again, ["topic", "ref"], "left_anti")
        pages = written(fresh.unionByName(kept.select(*fresh.columns)), "pages")
    else:
        ch = now.select("topic", "ref", F.lit("added").alias("change"))
        pages = written(parse(now, config), "pages")
    issues = pages.select("topic", F.explode("issues").alias("i")).select("topic", "i.*")
    halted = issues.where("halts").select("topic").distinct()
    good = pages.join(halted, "topic", "left_anti")
    e = graph.edges(good)
    c = community.communities(community.pair_weights(e, good))
    tables = {"pages": good, "edges": e, "communities": c}
    if was:
        # Ids of communities live on; halted topics keep what they had.
        old_c = store.table("communities", was)
        tables["communities"] = community.inherit_ids(old_c, written(c, "communities"))
        for k, d in tables.items():
            tables[k] = d.unionByName(store.table(k, was).join(halted, "topic", "left_semi").select(*d.columns))
    store.commit(store.next_version(), tables)
    return counters(ch.join(halted, "topic", "left_anti")), issues


def export_index_jsonl(index: DataFrame) -> DataFrame:
    """value: one compact JSON record a page, keys in alphabetical order, in order of ref."""
    cols = sorted(c for c in index.columns)
    return index.orderBy("ref").select(F.to_json(F.struct(*cols)).alias("value"))


def export_index_md(index: DataFrame) -> DataFrame:
    """topic, ref, line: the bullet of each page, keywords after it if it has some."""
    kw = F.when(F.size("keywords") > 0, F.concat(F.lit(" | kw: "), F.array_join("keywords", ", "))).otherwise("")
    return index.select("topic", "ref", F.rtrim(F.concat(F.lit("- [["), "ref", F.lit("]] — "), "summary", kw)).alias("line"))


def export_index_pages(index: DataFrame) -> DataFrame:
    """topic, pos, line: the index of each topic as lines in order: a header with the number of pages, an empty line, and a bullet a page."""
    n = Window.partitionBy("topic").orderBy("ref")
    bullets = export_index_md(index).select("topic", (F.row_number().over(n) + 1).alias("pos"), "line")
    head = index.groupBy("topic").agg(F.count("*").alias("n")).select("topic", F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.concat(F.lit("# index: "), "topic", F.lit(" ("), F.col("n").cast("string"), F.lit(" pages)")).alias("line")), F.struct(F.lit(1).alias("pos"), F.lit("").alias("line")),
    )).alias("x")).select("topic", "x.*")
    return head.unionByName(bullets)


def export_graph_tsv(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws("\t", "src_ref", "rel", "dst_ref", "src").alias("value")).distinct().orderBy("value")


def export_adjacency(adj: DataFrame) -> DataFrame:
    """node, dir, links: sorted (relation, ref) pairs of each node and direction as text."""
    return adj.groupBy("node", F.when(F.col("dir") == 0, "out").otherwise("in").alias("dir")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "rel", "other"))), ", ").alias("links"))


def export_adjacency_jsonl(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """value: one JSON object a node with its links in and out as sorted pairs of relation and ref; nodes without links too (column node)."""
    pair = lambda d: F.array_sort(F.collect_set(F.when(F.col("dir") == d, F.array("rel", "other"))))
    links = adj.groupBy("node").agg(pair(1).alias("in"), pair(0).alias("out"))
    none = F.array().cast("array<array<string>>")
    return nodes.select("node").distinct().join(links, "node", "left").select(F.to_json(F.struct(F.coalesce("in", none).alias("in"), "node", F.coalesce("out", none).alias("out"))).alias("value"))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """node, dir, rel, other of adjacency files: JSON lines of one node each, or one object with maps ``out`` and ``in`` from node to pairs. What cannot be read gives no rows."""
    lines = "node string, in array<array<string>>, out array<array<string>>"
    maps = "map<string,array<array<string>>>"
    text = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", f"struct<in:{maps},out:{maps}>")
    one = text.select(whole.alias("j")).where("j.in is not null or j.out is not null")
    each = spark.read.text(path).select(F.from_json("value", lines).alias("j")).where("j.node is not null").select("j.*")
    out = None
    for name, d in (("in", 1), ("out", 0)):
        a = one.select(F.explode(F.col(f"j.{name}")).alias("node", "l"))
        for part in (a, each.select("node", F.col(name).alias("l"))):
            rows = part.select("node", F.lit(d).alias("dir"), F.explode("l").alias("p")).where("size(p) = 2").select("node", "dir", F.col("p")[0].alias("rel"), F.col("p")[1].alias("other"))
            out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def read_assignment(spark: SparkSession, path: str, layer: str, topic: str) -> DataFrame:
    """layer, topic, cid, ref of an assignment file: an object whose ``communities`` maps an id to its members. What cannot be read gives no rows."""
    j = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<communities:map<string,array<string>>>").alias("j"))
    m = j.select(F.explode("j.communities").alias("cid", "refs"))
    return m.select(F.lit(layer).alias("layer"), F.lit(topic).alias("topic"), "cid", F.explode("refs").alias("ref"))


def export_assignment(assigned: DataFrame) -> DataFrame:
    """layer, topic, value: one JSON line a community with its id and sorted members."""
    g = assigned.groupBy("layer", "topic", "cid").agg(F.array_sort(F.collect_list("ref")).alias("members"))
    return g.select("layer", "topic", F.to_json(F.struct(F.col("cid").alias("community"), "members")).alias("value"))


def read_index_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Index records of JSON lines; lines that are no record, or have no ref, are passed over."""
    schema = "hash string, keywords array<string>, layer string, ref string, summary string, title string, type string, updated string, topic string"
    return spark.read.schema(schema).json(path).where("ref is not null")


def read_graph_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a TSV file; lines of other than four columns are passed over."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.size(parts) == 4).select(parts[0].alias("src_ref"), parts[1].alias("rel"), parts[2].alias("dst_ref"), parts[3].alias("src"))


__all__ = ["Config", "Store", "build", "counters", "diff", "load_config", "overlay", "parse", "scan"]
