"""Filling containers of fixed capacity: vector best-fit over tokens, texts and attention cost.

A container has three residual capacities: tokens, number of texts, and
attention cost (the sum of squared lengths, as texts in one container do not
attend to each other).  Items go in by decreasing size; each goes into the
open container in which it fits under every constraint and which it leaves
with the least weighted residual norm, the weights being the mean demands.

Items are spread over shards by hash, many to a shard, and each shard is
packed by itself.  Containers that a shard leaves too empty are dissolved, and
their items are packed again together, in fewer shards, round by round until
they fit one, or a round leaves about as many as it was given.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import written

#: Items of a shard: large enough that the open containers at its end do not matter, small enough for one task.
SHARD = 16_000
#: Containers filled below this share are dissolved and packed again.
KEEP_FILL = 0.985
#: A round that leaves more than this share of its items to the next one is the last: what cannot be filled is kept as it is.
SHRINK = 0.8


def vector_best_fit(sizes: np.ndarray, capacity: int, max_docs: int, max_cost: float) -> np.ndarray:
    """The container (0, 1, ...) of each item. Items must not exceed the capacity; equal sizes keep their order."""
    n = len(sizes)
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    order = np.argsort(-sizes, kind="stable")
    least = float(sizes.min())
    cap = np.array([capacity, max_docs, max_cost], float)
    demand = np.stack([sizes / cap[0], np.full(n, 1 / cap[1]), sizes.astype(float) ** 2 / cap[2]])
    weight = demand.mean(axis=1)
    room = np.empty((3, 1024))
    ids = np.empty(1024, np.int64)
    m = bins = 0
    for i in order:
        d = demand[:, i]
        if m:
            left = room[:, :m] - d[:, None]
            fits = (left >= -1e-9).all(axis=0)
            if fits.any():
                norm = weight @ (left * left)
                norm[~fits] = np.inf
                k = int(norm.argmin())
                room[:, k] = left[:, k]
                out[i] = ids[k]
                # A container that can take nothing more is closed; the last open one takes its place.
                if room[0, k] * capacity < least - 1e-6 or room[1, k] < demand[1, 0] - 1e-9:
                    m -= 1
                    room[:, k], ids[k] = room[:, m], ids[m]
                continue
        if m == len(ids):
            room, ids = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([ids, np.empty_like(ids)])
        room[:, m], ids[m] = 1 - d, bins
        out[i] = bins
        bins += 1
        if room[0, m] * capacity >= least - 1e-6 and room[2, m] > 0:
            m += 1
    return out


def _pack(keep_fill: float, last: bool):
    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        cap = int(d["capacity"].iloc[0])
        sizes = d["tokens"].to_numpy(np.int64)
        bins = vector_best_fit(sizes, cap, int(d["max_docs"].iloc[0]), float(d["max_cost"].iloc[0]))
        fill = np.bincount(bins, weights=sizes) / cap
        done = np.full(len(d), last) | (fill[bins] >= keep_fill)
        d["bin"] = [f"{r}.{s}.{b}" for r, s, b in zip(d["round"], d["shard"], bins, strict=True)]
        d["done"] = done
        return d[["limit_id", "capacity", "max_docs", "max_cost", "doc_id", "piece", "tokens", "bin", "done"]]
    return run


PACKED = "limit_id int, capacity long, max_docs long, max_cost double, doc_id long, piece long, tokens long, bin string, done boolean"


def pack(sizes: DataFrame, limits: list[dict], shard: int = SHARD, keep_fill: float = KEEP_FILL) -> DataFrame:
    """limit_id, bin_id, doc_id, piece, first_token, tokens: where each text, or piece of one, is.

    sizes: doc_id, n.  limits: limit_id, capacity, and optionally max_docs
    (texts of a container) and max_cost (attention cost); by default there is
    no limit but that of tokens, which keeps texts below the capacity and cost
    below its square.  A text whose own cost is over max_cost is alone.  A
    text longer than the capacity is cut into pieces of exactly the capacity
    and a rest; no other text is cut.  Texts without tokens have no place.
    Repeated doc_ids are separate items.  Limits with a capacity below 1 are
    left out.  Every round but the last leaves at most the share of items that
    sit in containers below keep_fill, so each round's shards get fewer.
    """
    spark = sizes.sparkSession
    given = [x for x in limits if x["capacity"] and x["capacity"] > 0]
    if not given:
        return spark.createDataFrame([], "limit_id int, bin_id string, doc_id long, piece long, first_token long, tokens long")
    spec = F.array(*[
        F.struct(
            F.lit(int(x["limit_id"])).alias("limit_id"), F.lit(int(x["capacity"])).cast("long").alias("capacity"),
            F.lit(int(x.get("max_docs") or x["capacity"])).cast("long").alias("max_docs"),
            F.lit(float(x.get("max_cost") or float(x["capacity"]) ** 2)).alias("max_cost"),
        ) for x in given
    ])
    each = sizes.where("n > 0").select("doc_id", "n", F.explode(spec).alias("l")).select("doc_id", "n", "l.*")
    whole = F.floor(F.col("n") / F.col("capacity"))
    full = (
        each.where(whole > 0).select("limit_id", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
        .select("limit_id", F.concat_ws(".", F.lit("full"), "doc_id", "piece").alias("bin_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("tokens"))
    )
    rest = each.withColumns({"piece": whole, "tokens": F.col("n") % F.col("capacity")}).where("tokens > 0")
    cols = ["limit_id", "capacity", "max_docs", "max_cost", "doc_id", "piece", "tokens"]
    rest = written(rest.select(*cols), "items")
    out, before = None, float("inf")
    for i in itertools.count():
        # One count a limit reaches the driver.
        count = {r[0]: r[1] for r in rest.groupBy("limit_id").count().collect()}
        if not count:
            break
        shards = {k: -(-n // shard) for k, n in count.items()}
        last = max(shards.values()) == 1 or sum(count.values()) > SHRINK * before
        before = sum(count.values())
        n_of = F.element_at(F.create_map(*[F.lit(x) for kv in shards.items() for x in kv]), F.col("limit_id"))
        sharded = rest.withColumns({"round": F.lit(i), "shard": F.pmod(F.xxhash64("doc_id", "piece", F.lit(i)), n_of)})
        got = written(sharded.groupBy("limit_id", "shard").applyInPandas(_pack(keep_fill, last), PACKED), "packed")
        done = got.where("done")
        out = done if out is None else out.unionByName(done)
        if last:
            break
        rest = got.where("not done").select(*cols)
    if out is None:
        return full
    placed = out.select("limit_id", F.col("bin").alias("bin_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), "tokens")
    return full.unionByName(placed)


def fill_report(packed: DataFrame, limits: list[dict]) -> DataFrame:
    """limit_id, containers, least number of containers that could do, tokens, fill."""
    cap = F.element_at(F.create_map(*[F.lit(x) for r in limits for x in (int(r["limit_id"]), int(r["capacity"]))]), F.col("limit_id"))
    per = packed.groupBy("limit_id", "bin_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"))
    g = per.groupBy("limit_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.max("k").alias("most_texts"))
    return g.select(
        "limit_id", cap.cast("long").alias("capacity"), "containers", F.ceil(F.col("tokens") / cap).alias("least_containers"), "tokens", "fullest", "most_texts",
        F.round(F.col("tokens") / (F.col("containers") * cap), 6).alias("fill"),
    )
