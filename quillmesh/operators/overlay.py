"""Two layers, of which a project page stands for the global page of the same ref."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.refs import norm_ref


def rank(layer: Column) -> Column:
    return F.when(F.lower(F.trim(layer)) == "project", 1).otherwise(0)


#: The columns of a page, beside its id and ref.
COLUMNS = ["layer", "topic", "type", "slug", "title", "summary", "keywords", "relations", "sources", "updated", "body", "hash"]


def corpus(pages: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per page_id with its ref in normal form; of repeated rows the earliest ingested holds, reduced map side.

    Only the columns named are read and moved (all of them by default).  Rows
    without page_id or ref are no pages.
    """
    cols = COLUMNS if columns is None else columns
    one = pages.where("page_id is not null and ref is not null").select("page_id", "ingested_at", norm_ref(F.col("ref")).alias("ref"), *cols)
    first = F.min_by(F.struct("ref", *cols), F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp")))
    return one.groupBy("page_id").agg(first.alias("p")).select("page_id", "p.*")


def of_layer(pages: DataFrame, layer: str | None) -> DataFrame:
    """The pages of one layer, or of both. Asked for before the overlay: without the project's pages nothing stands for a global one."""
    if layer not in (None, "both", "global", "project"):
        raise ValueError("layer must be global, project or both")
    return pages if layer in (None, "both") else pages.where(F.lower(F.trim("layer")) == layer)


def index_records(pages: DataFrame) -> DataFrame:
    """The search record of a page: no body, sources or relations; nulls as empty texts."""
    z = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return pages.select("ref", "layer", "topic", "type", z("title"), z("summary"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), z("updated"), z("hash"))


def merge_index(records: DataFrame) -> DataFrame:
    """One record per ref: the project's, if there is one. Extra columns pass through."""
    others = [c for c in records.columns if c not in ("topic", "ref")]
    best = records.groupBy("topic", "ref").agg(F.max_by(F.struct(*others), F.struct(rank(F.col("layer")), F.col("layer"))).alias("r"))
    return best.select("topic", "ref", *[f"r.{c}" for c in others]).select(*records.columns)


def shadowed(records: DataFrame) -> DataFrame:
    """Refs that both layers have."""
    r = rank(F.col("layer"))
    return records.groupBy("ref").agg(F.min(r).alias("a"), F.max(r).alias("b")).where("a = 0 and b = 1").select("ref")


def merge_edges(edges: DataFrame, shadow: DataFrame) -> DataFrame:
    """Edges of both layers without those of global pages that are shadowed: an anti-join on where the edge starts."""
    top, low = edges.where(rank(F.col("layer")) == 1), edges.where(rank(F.col("layer")) == 0)
    return top.unionByName(low.join(shadow.select(F.col("ref").alias("src_ref")), "src_ref", "left_anti").select(*edges.columns))
