"""Vector retrieval: exact cosine top-k, chunk hits to pages, and rank fusion with lexical search (an extension)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import written

#: Queries that are scored in one scan, and vectors that are scored at once.
QUERY_BLOCK, VECTOR_BLOCK = 1000, 1024


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine with a query vector in double precision; null where a vector is null, of other length, or zero."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(x * x for x in query) ** 0.5
    dbl = F.transform(v, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(dbl, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(dbl, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((F.size(v) == len(query)) & (own > 0) & F.lit(norm > 0), dot / (own * norm))


def top_k(vectors: DataFrame, key: str, column: str, query: list[float], k: int = 10) -> DataFrame:
    """key, score, rank order of the k nearest by cosine; among equals the least key. A scan and a top-k, no shuffle of vectors."""
    s = vectors.select(key, F.round(cosine(F.col(column), query), 6).alias("score")).where("score is not null")
    return s.orderBy(F.desc("score"), key).limit(k)


def top_k_batch(vectors: DataFrame, key: str, column: str, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """query, key, score: for each row of queries (key, column) its k nearest of all vectors by cosine, as top_k has them; key is an integer column.

    The queries are taken in blocks, one scan each; of more than one block each
    result is written before the next block is fetched, so the driver holds one
    block.  A task sends on k rows a query.  Vectors with null or not finite
    elements have no score.
    """
    usable = lambda d: d.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("v")).where("key is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    schema, out, v = "query long, key long, score double", None, usable(vectors)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    for rows in batched(usable(queries).toLocalIterator(), block):
        got = v.mapInPandas(_nearest(rows, k), schema).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
        if out is not None or len(rows) == block:
            got = written(got, "nearest")
        out = got if out is None else out.unionByName(got)
    out = v.sparkSession.createDataFrame([], schema) if out is None else out
    return out.select("query", F.col("key").alias(key), "score")


def _nearest(rows: tuple, k: int):
    """A function of the batches of a task: query, key, score of the k nearest to each of rows (key, v) in the task."""
    by: dict[int, tuple] = {}
    for size in {len(r["v"]) for r in rows}:
        some = [(r["key"], r["v"]) for r in rows if len(r["v"]) == size and any(r["v"])]
        if some:
            m = np.array([q for _, q in some])
            by[size] = np.array([i for i, _ in some]), m / np.linalg.norm(m, axis=1, keepdims=True)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = {size: (np.empty((0, len(ids)), dtype=np.int64), np.empty((0, len(ids)))) for size, (ids, _) in by.items()}
        for b in batches:
            sizes = b["v"].map(len)
            for size, (ids, m) in by.items():
                part = b[sizes == size]
                for at in range(0, len(part), VECTOR_BLOCK):
                    v = np.stack(part["v"].iloc[at : at + VECTOR_BLOCK].to_list())
                    norm = np.linalg.norm(v, axis=1)
                    keys = part["key"].to_numpy()[at : at + VECTOR_BLOCK][norm > 0]
                    score = np.round(v[norm > 0] / norm[norm > 0, None] @ m.T, 6)
                    keys = np.concatenate([kept[size][0], np.repeat(keys[:, None], len(ids), axis=1)])
                    score = np.concatenate([kept[size][1], score])
                    order = np.lexsort((keys, -score), axis=0)[:k]
                    kept[size] = np.take_along_axis(keys, order, 0), np.take_along_axis(score, order, 0)
        for size, (keys, score) in kept.items():
            yield pd.DataFrame({"query": np.tile(by[size][0], len(keys)), "key": keys.ravel(), "score": score.ravel()})

    return scan


def chunk_hits_to_refs(hits: DataFrame, roots: dict[str, str], index: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """ref, layer, score, rank of pages, from hits on their files: layer, path, score, rank.

    Only ``topics/<topic>/pages/<type>/<slug>.md`` under the root of a layer
    names a page; chunks of one page count with their best score and rank; of
    a ref in two layers the greatest score holds and the project is shown.
    With an index, refs it lacks keep a null title.  ``by`` names the columns
    that tell the hits of one query from those of another.
    """
    prefix = F.lit("")
    for layer, root in roots.items():
        prefix = F.when(F.col("layer") == layer, root.rstrip("/") + "/").otherwise(prefix)
    rest = F.when(F.startswith("path", prefix), F.expr("path")).otherwise("")
    rest = F.substring(rest, F.length(prefix) + 1, F.lit(2**30))
    part = lambda i: F.regexp_extract(rest, r"^topics/([a-z0-9-]+)/pages/([a-z0-9-]+)/([a-z0-9-]+)\.md\z", i)
    ref = F.concat_ws("/", part(1), part(2), part(3))
    one = hits.select(*by, "layer", ref.alias("ref"), "score", "rank").where("ref <> '//'").groupBy(*by, "layer", "ref").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    best = one.groupBy(*by, "ref").agg(F.max("score").alias("score"), F.min("rank").alias("rank"), F.max_by("layer", F.col("layer") == "project").alias("layer"))
    out = best if index is None else best.join(index.select("ref", "title", "summary"), "ref", "left")
    return out.orderBy(*by, F.desc("score"), "ref")


def reciprocal_rank_fusion(ranked: list[DataFrame], key: str, limit: int = 10, k: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """key, score = sum of 1 / (k + position) over the lists (key, pos from 1), best first; with ``by``, limit rows for each of its values."""
    each = ranked[0].select(*by, key, "pos")
    for r in ranked[1:]:
        each = each.unionByName(r.select(*by, key, "pos"))
    if by:
        fused = each.groupBy(*by, key).agg(F.round(F.sum(1.0 / (F.lit(float(k)) + F.col("pos"))), 9).alias("score"))
        n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key))
        return fused.withColumn("n", n).where(F.col("n") <= limit).drop("n")
    return each.groupBy(key).agg(F.round(F.sum(1.0 / (F.lit(float(k)) + F.col("pos"))), 9).alias("score")).orderBy(F.desc("score"), key).limit(limit)
