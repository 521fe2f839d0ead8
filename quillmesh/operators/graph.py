"""The knowledge graph: edges, adjacency, breadth-first traversal and shortest paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.refs import norm_ref
from quillmesh.functions.text import canonical_links
from quillmesh.session import written

OUT, IN = 0, 1
STEP = "array<struct<ref:string,rel:string,dir:int>>"
KEY = "array<struct<dir:int,rel:string,other:string>>"
#: Rows of a level that are kept on the driver and sent to the tasks; a larger level is written to the shared folder and joined.
SMALL = 5_000
#: Nodes that are named in the scan of the adjacency, so that it reads the buckets of these only.
NAMED = 1_000


def edges(pages: DataFrame) -> DataFrame:
    """Distinct (layer, topic, src_ref, rel, dst_ref, src): relations of the front matter, and canonical links of the body to other pages.

    Null relations and targets give none; relation names and targets count in
    normal form.
    """
    base = pages.select("layer", "topic", F.col("ref").alias("src_ref"), "relations", "body")
    fm = base.select("layer", "topic", "src_ref", F.explode("relations").alias("r")).where("r.rel is not null and r.to is not null")
    fm = fm.select("layer", "topic", "src_ref", F.lower(F.trim("r.rel")).alias("rel"), norm_ref(F.col("r.to")).alias("dst_ref"), F.lit("frontmatter").alias("src"))
    body = base.where(F.contains("body", F.lit("[["))).select("layer", "topic", "src_ref", F.lit("mentions").alias("rel"), F.explode(canonical_links(F.col("body"))).alias("dst_ref"), F.lit("body").alias("src")).where("dst_ref <> src_ref")
    return fm.unionByName(body).distinct()


def adjacency(e: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """Distinct (node, dir, rel, other): each edge from both ends. Where an edge was written is lost here.

    topics restrict where edges start, not what they lead to.
    """
    if topics is not None:
        e = e.where(F.col("topic").isin(topics))
    a = e.select(F.col("src_ref").alias("node"), F.lit(OUT).alias("dir"), "rel", F.col("dst_ref").alias("other"))
    b = e.select(F.col("dst_ref").alias("node"), F.lit(IN).alias("dir"), "rel", F.col("src_ref").alias("other"))
    return a.unionByName(b).distinct()


def nodes(e: DataFrame, refs: DataFrame) -> DataFrame:
    """Pages and all ends of edges, those that name no page included."""
    return refs.select(F.col("ref").alias("node")).union(e.select("src_ref")).union(e.select("dst_ref")).distinct()


def neighbours(adj: DataFrame, rels: list[str] | None = None, direction: str = "both") -> DataFrame:
    """Adjacency of the wanted relations and direction; filtered before any expansion."""
    if direction not in ("out", "in", "both"):
        raise ValueError("direction must be out, in or both")
    if rels:
        adj = adj.where(F.col("rel").isin(rels))
    return adj if direction == "both" else adj.where(F.col("dir") == (OUT if direction == "out" else IN))


@dataclass
class _Level:
    """The rows of one level: at most SMALL of them at hand, or a table."""

    spark: SparkSession
    schema: object
    rows: list | None
    table: DataFrame | None
    _df: DataFrame | None = None

    @classmethod
    def of(cls, df: DataFrame, name: str) -> _Level:
        rows = df.limit(SMALL + 1).collect()
        small = len(rows) <= SMALL
        return cls(df.sparkSession, df.schema, rows if small else None, None if small else written(df, name))

    @property
    def empty(self) -> bool:
        return self.rows is not None and not self.rows

    def df(self) -> DataFrame:
        if self._df is None:
            self._df = self.table if self.rows is None else self.spark.createDataFrame(self.rows, self.schema, verifySchema=False)
        return self._df

    def links(self, adj: DataFrame) -> DataFrame:
        """The level's rows (column node) with the links of their nodes; of few nodes only the buckets and row groups that may hold them are read."""
        if self.rows is None:
            return self.table.join(adj, "node")
        nodes = sorted({r["node"] for r in self.rows})
        if len(nodes) <= NAMED:
            # One text to parse: a literal each would be as many calls.
            named = ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in nodes)
            adj = adj.where(F.expr(f"node in ({named})")) if nodes else adj.limit(0)
        return adj.join(F.broadcast(self.df()), "node")

    def without(self, df: DataFrame, column: str) -> DataFrame:
        """df without the rows whose column names a node of this level."""
        mine = self.df().select(F.col("node").alias(column))
        return df.join(F.broadcast(mine) if self.rows is not None else mine, column, "left_anti")


def _require(index: DataFrame, ref: str) -> None:
    if not index.where(F.col("ref") == ref).limit(1).count():
        raise KeyError(f"no page {ref}")


def traverse(adj: DataFrame, index: DataFrame, start: str, hops: int = 1, rels: list[str] | None = None, direction: str = "both", limit: int | None = None) -> DataFrame:
    """ref, hop, parent, rel, direction of every node within the hops, each once, by its first discoverer.

    A node's key is its parent's key and the step (out before in, relation,
    name); the least key of a level is what a queue would have found first, so
    each level is one join, one map-side reduced minimum and one anti-join.
    The start must be a page; nodes that name no page are returned, and walked
    through.  hops is 1 to 6.  With a limit the first rows by hop and ref.
    """
    if not 1 <= hops <= 6:
        raise ValueError("hops must be 1 to 6")
    if limit is not None and limit < 1:
        raise ValueError("limit must be 1 or more")
    _require(index, start)
    spark = adj.sparkSession
    adj = neighbours(adj, rels, direction)
    front = _Level(spark, spark.createDataFrame([], f"node string, key {KEY}").schema, [Row(node=start, key=[])], None)
    seen, levels = [front], []
    for hop in range(1, hops + 1):
        step = front.links(adj).select("other", F.struct(F.concat("key", F.array(F.struct("dir", "rel", "other"))).alias("key"), F.col("node").alias("parent"), "rel", "dir").alias("s"))
        new = step.groupBy("other").agg(F.min("s").alias("s"))
        for one in seen:
            new = one.without(new, "other")
        new = _Level.of(new.select(F.col("other").alias("node"), "s.key", "s.parent", "s.rel", "s.dir"), "level")
        levels.append(new.df().select(F.col("node").alias("ref"), F.lit(hop).alias("hop"), "parent", "rel", F.when(F.col("dir") == OUT, "out").otherwise("in").alias("direction")))
        if new.empty:
            break
        front = _narrow(new, ["node", "key"])
        seen.append(front)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out if limit is None else out.orderBy("hop", "ref").limit(limit)


def _narrow(level: _Level, columns: list[str]) -> _Level:
    """The level with these columns only."""
    df = level.df().select(*columns)
    return _Level(level.spark, df.schema, level.rows, df if level.rows is None else None, df)


def cut_note(rows: DataFrame, limit: int) -> str | None:
    """What a limit hides of a traversal: how many of how many rows are shown, and hops among the rest; None if it hides nothing."""
    n = rows.groupBy("hop").count().orderBy("hop").collect()
    total, left, hidden = sum(r["count"] for r in n), limit, []
    for r in n:
        left -= r["count"]
        if left < 0:
            hidden.append(r["hop"])
    return f"{limit} of {total} rows; the rest has hops {hidden}" if hidden else None


def reach(adj: DataFrame, starts: DataFrame, hops: int, until: str | None = None) -> DataFrame:
    """node, dist of all nodes within the hops of any start (column node), in either direction; no farther than the level of ``until``."""
    front = _Level.of(starts.select("node").distinct(), "reach")
    seen, out = [front], front.df().withColumn("dist", F.lit(0))
    for hop in range(1, hops + 1):
        new = front.links(adj).select(F.col("other").alias("node")).distinct()
        # Links run both ways, so a neighbour is at most one level nearer.
        for one in seen[-2:]:
            new = one.without(new, "node")
        front = _Level.of(new, "reach")
        if front.empty:
            break
        seen.append(front)
        out = out.unionByName(front.df().withColumn("dist", F.lit(hop)))
        if until is not None and not front.df().where(F.col("node") == until).isEmpty():
            break
    return out


def shortest_paths(adj: DataFrame, a: str, b: str, max_paths: int = 3, max_hops: int = 6) -> DataFrame:
    """path_no, len, steps of the first shortest paths, in order of their steps (ref, relation, out before in).

    Only distances that fall towards b are walked, so every prefix can be
    completed, and the max_paths least prefixes of a level are enough.
    Parallel relations are paths of their own.  Unreachable: no rows; a equal
    to b: one path of no steps.
    """
    if max_paths < 1:
        raise ValueError("max_paths must be 1 or more")
    spark = adj.sparkSession
    paths = _Level(spark, spark.createDataFrame([], f"node string, steps {STEP}").schema, [Row(node=a, steps=[])], None)
    dist = _Level.of(reach(adj, spark.createDataFrame([(b,)], "node string"), max_hops, a), "dist")
    far = dist.df().where(F.col("node") == a).select("dist").first()
    if far is None:
        return paths.df().limit(0).select(F.lit(1).alias("path_no"), F.lit(0).alias("len"), "steps")
    for t in range(far[0]):
        to = dist.df().where(F.col("dist") == far[0] - t - 1).select(F.col("node").alias("other"))
        step = paths.links(adj).join(to, "other").select(F.col("other").alias("node"), F.concat("steps", F.array(F.struct(F.col("other").alias("ref"), "rel", "dir"))).alias("steps"))
        paths = _Level.of(step.orderBy("steps").limit(max_paths), "paths")
    rows = paths.df().select(F.size("steps").alias("len"), "steps").orderBy("steps").limit(max_paths)
    # max_paths rows: a position over them needs no distribution.
    return rows.select(F.expr("row_number() over (order by steps)").alias("path_no"), "len", "steps")


def path_text(start: str) -> Column:
    """A path as text: the start, then for each step an arrow with the relation and the ref."""
    one = lambda s: F.concat(F.when(s["dir"] == OUT, F.concat(F.lit(" -"), s["rel"], F.lit("-> "))).otherwise(F.concat(F.lit(" <-"), s["rel"], F.lit("- "))), s["ref"])
    return F.concat(F.lit(start), F.array_join(F.transform("steps", one), ""))
