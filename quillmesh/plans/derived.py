"""Tables derived from the pages once and read by many queries: the search index, and the merged graph.

They are what a build leaves behind.  Each is made when it is first asked for,
in the session's shared folder, under a name that tells the input files by
path, size and time, so that a changed input is derived anew.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import bucketed, graph, overlay, search
from quillmesh.operators.incremental import _fs
from quillmesh.session import buckets, shared_dir

SEARCH = ["layer", "topic", "title", "summary", "keywords"]
EDGES = ["layer", "topic", "relations", "body"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str, *columns: str, topic: str | None = None) -> DataFrame:
    """The corpus with these columns only. A page belongs to one topic, so a topic is asked for at the scan."""
    p = table(spark, d, "pages")
    return overlay.corpus(p if topic is None else p.where(F.col("topic") == topic), list(columns))


def merged(p: DataFrame) -> DataFrame:
    return overlay.merge_edges(graph.edges(p), overlay.shadowed(p))


class Derived:
    """The derived tables of the pages below d."""

    _of: dict[tuple, Derived] = {}

    def __init__(self, spark: SparkSession, d: str, home: str):
        self.spark, self.d, self.home = spark, d, home
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, d: str) -> Derived:
        fs, p = _fs(spark, f"{d}/pages.parquet")
        files = [p] if not fs.getFileStatus(p).isDirectory() else [f.getPath() for f in fs.listStatus(p)]
        says = sorted(f"{f} {s.getLen()} {s.getModificationTime()}" for f in files for s in [fs.getFileStatus(f)])
        key = (spark.sparkContext.applicationId, d, hashlib.sha256("\n".join(says).encode()).hexdigest()[:16])
        if key not in cls._of:
            cls._of[key] = cls(spark, d, f"{shared_dir(spark)}/derived-{key[0]}-{key[2]}-{hashlib.sha256(d.encode()).hexdigest()[:8]}")
        return cls._of[key]

    def _once(self, name: str, make) -> DataFrame:
        fs, p = _fs(self.spark, f"{self.home}/{name}/_SUCCESS")
        if name not in self._tables or not fs.exists(p):
            self._tables[name] = make(f"{self.home}/{name}")
        return self._tables[name]

    def _plain(self, df: DataFrame, at: str) -> DataFrame:
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def search_index(self, bodies: bool) -> DataFrame:
        """Merged records with search fields, in order of topic and ref, so that a topic is found by the statistics of the files."""
        def make(at: str) -> DataFrame:
            z = F.coalesce
            rec = pages(self.spark, self.d, *SEARCH, *(["body"] if bodies else [])).select(
                "ref", "layer", "topic", z("title", F.lit("")).alias("title"), z("summary", F.lit("")).alias("summary"), z("keywords", F.array().cast("array<string>")).alias("keywords"), *(["body"] if bodies else [])
            )
            # Put in order first: what finds the bounds of the ranges reads its input once more, and that is not to be the fields.
            ordered = overlay.merge_index(rec).repartitionByRange(buckets(self.spark), "topic", "ref").sortWithinPartitions("topic", "ref")
            return self._plain(search.with_search_fields(ordered, bodies).drop("body"), at)
        return self._once("search_bodies" if bodies else "search", make)

    def index(self) -> DataFrame:
        """ref and title of the merged pages."""
        return self.search_index(False).select("ref", "title")

    def edges(self) -> DataFrame:
        return self._once("edges", lambda at: self._plain(merged(pages(self.spark, self.d, *EDGES)), at))

    def adjacency(self) -> DataFrame:
        """The merged adjacency, bucketed by node."""
        def make(at: str) -> DataFrame:
            adj = graph.adjacency(self.edges())
            return bucketed.write(adj, at, ["node"], buckets(self.spark))
        return self._once("adjacency", make)

    def start(self) -> str:
        """The page with most out-edges."""
        first = self._once("start", lambda at: self._plain(self.edges().groupBy("src_ref").count().orderBy(F.desc("count"), "src_ref").limit(1), at)).first()
        return first[0] if first else ""

    def build(self) -> None:
        self.search_index(False), self.search_index(True), self.edges(), self.adjacency(), self.start()
