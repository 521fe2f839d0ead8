"""Mixing sources to target weights by balanced sampling (the cube method).

The size of a mixture is the largest at which every source can give its share
without using a text more than its capped number of times.  A source then
needs its texts e times each, e at most the cap: floor(e) times all of them,
and once more a part drawn with inclusion probability e - floor(e).  That part
is drawn so that its tokens and its number of texts are those expected: the
flight phase moves the probabilities along the null space of the two
constraints until all but two are 0 or 1, block by block and then for what the
blocks left, until one small landing problem is left per source, which is
solved by trying every outcome, and by exchanges where one long text remains.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import written

#: Texts of one block of the flight phase.
BLOCK = 20_000
#: Open units with which the landing starts: 2^LANDING outcomes are tried.
LANDING = 12
EPS = 1e-9


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator, stop: int = 2) -> np.ndarray:
    """Move p along the null space of (x, 1) until at most ``stop`` (2 at least) units are strictly between 0 and 1.

    Both sum(p * x) and sum(p) stay as they are; each p is a martingale, so
    inclusion probabilities hold.
    """
    p = [0.0 if v < EPS else 1.0 if v > 1 - EPS else float(v) for v in p]
    xs = [float(v) for v in x]
    todo = [i for i, v in enumerate(p) if 0 < v < 1]
    open_n, act, at = len(todo), [], 0
    coin = rng.random(len(todo) + 8)
    c = 0
    while open_n > max(2, stop):
        while len(act) < 3 and at < len(todo):
            act.append(todo[at])
            at += 1
        if len(act) < 3:
            break
        a, b, d = act
        u = (xs[b] - xs[d], xs[d] - xs[a], xs[a] - xs[b])
        if u[0] == 0 and u[1] == 0:
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, v in zip(act, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
            elif v < 0:
                up, down = min(up, p[k] / -v), min(down, (1 - p[k]) / -v)
        step = up if coin[c] * (up + down) < down else -down
        c += 1
        if c == len(coin):
            coin, c = rng.random(len(coin)), 0
        keep = []
        for k, v in zip(act, u, strict=True):
            q = p[k] + step * v
            if q < EPS or q > 1 - EPS:
                p[k] = 0.0 if q < 0.5 else 1.0
                open_n -= 1
            else:
                p[k] = q
                keep.append(k)
        act = keep
    return np.array(p)


def landing(p: np.ndarray, x: np.ndarray, target: float) -> np.ndarray:
    """Round the open units so that tokens come nearest to the target, then texts; every outcome is tried."""
    live = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    out = p.copy()
    if len(live):
        options = np.array(list(itertools.product((0.0, 1.0), repeat=len(live))))
        fixed = float((p * x).sum() - (p[live] * x[live]).sum())
        miss = np.abs(options @ x[live] + fixed - target)
        texts = np.abs(options.sum(axis=1) - p[live].sum())
        out[live] = options[np.lexsort((texts, np.round(miss, 6)))[0]]
    return settle(np.round(out), x, target)


def settle(take: np.ndarray, x: np.ndarray, target: float, rounds: int = 50) -> np.ndarray:
    """Exchange a text drawn for one not drawn as long as that brings the tokens nearer to the target.

    One long text among the last open units can leave more than these can make
    up for; an exchange keeps the number of texts.
    """
    for _ in range(rounds):
        over = float((take * x).sum() - target)
        inside, outside = np.flatnonzero(take > 0.5), np.flatnonzero(take < 0.5)
        if abs(over) < 0.5 or not len(inside) or not len(outside):
            break
        outside = outside[np.argsort(x[outside], kind="stable")]
        w = x[outside]
        k = np.searchsorted(w, x[inside] - over)
        best = None
        for near in (np.clip(k, 0, len(w) - 1), np.clip(k - 1, 0, len(w) - 1)):
            left = np.abs(over - (x[inside] - w[near]))
            i = int(left.argmin())
            if best is None or left[i] < best[0]:
                best = (float(left[i]), inside[i], outside[near[i]])
        if best[0] >= abs(over) - 1e-9:
            break
        take[best[1]], take[best[2]] = 0.0, 1.0
    return take


def _fly(last: bool):
    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["h", "doc_id"], kind="stable")
        x, p = d["n"].to_numpy(float), d["p"].to_numpy(float)
        rng = np.random.default_rng(abs(int(d["h"].iloc[0])) % 2**32)
        target = float((p * x).sum())
        p = flight(p, x, rng, LANDING if last else 2)
        d["p"] = landing(p, x, target) if last else p
        return d[["mix_id", "source", "doc_id", "n", "base", "p", "h"]]
    return run


UNIT = "mix_id int, source string, doc_id long, n long, base long, p double, h long"


def norm_source(c):
    return F.lower(F.trim(c))


def distinct_texts(sizes: DataFrame) -> DataFrame:
    """One unit for each text: of copies the one with the least doc_id, so that no text is used more often than its cap by way of its copies.

    sizes: doc_id, source, digest, n.  Copies are reduced map side.
    """
    one = sizes.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "n")).alias("u"))
    return one.select("u.doc_id", "u.source", "u.n")


def plan(stats: list, targets: list, total: int | None = None) -> list[dict]:
    """Per mix and source: expected uses of each text. Sources without texts have none; the others keep their shares.

    stats: (source, texts, tokens); targets: (mix_id, source, target_share,
    max_repeats).  By default a mix is as large as its scarcest source allows,
    so that every share is met.  With a total, each source gives its share of
    that total, or all it can at its cap; what it cannot give is its
    shortfall, and the others do not change for it.
    """
    have = {s: (k, t) for s, k, t in stats if t}
    out = []
    for mix in sorted({t["mix_id"] for t in targets}):
        rows = [t for t in targets if t["mix_id"] == mix and t["target_share"] and t["target_share"] > 0]
        able = [t for t in rows if t["source"] in have and (t["max_repeats"] or 0) > 0]
        size = min((t["max_repeats"] * have[t["source"]][1] / t["target_share"] for t in able), default=0)
        size = float(total) if total else size
        for t in rows:
            e = min(size * t["target_share"] / have[t["source"]][1], float(t["max_repeats"])) if t in able else 0.0
            base = int(e + EPS)
            p = e - base
            out.append(dict(t) | {"uses": e, "base": base, "p": 0.0 if p < EPS else p, "texts": have.get(t["source"], (0, 0))[0], "size": size, "wanted": size * t["target_share"], "shortfall": max(0.0, size * t["target_share"] - e * have.get(t["source"], (0, 0))[1])})
    return out


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK) -> DataFrame:
    """mix_id, source, doc_id, tokens, copies of each text used.

    sizes: doc_id, source (normalised), n.  targets are gathered to the
    driver: one row a mix and source; repeated targets of a mix count once.
    Texts of no source, and sources that no mix names, are not used.  A source
    may hold any part of all rows: blocks are cut within a source by hash.
    """
    spark = sizes.sparkSession
    t = targets.where("source is not null and mix_id is not null").select("mix_id", norm_source(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = [r.asDict() for r in t.collect()]
    # As many rows as the mixes name sources.
    stats = sizes.join(t.select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.count("*").alias("k"), F.sum("n").alias("t")).collect()
    plans = [x for x in plan([tuple(r) for r in stats], wanted, total) if x["uses"] > 0]
    empty = spark.createDataFrame([], "mix_id int, source string, doc_id long, tokens long, copies long")
    if not plans:
        return empty
    p = spark.createDataFrame([(x["mix_id"], x["source"], x["base"], float(x["p"]), x["texts"]) for x in plans], "mix_id int, source string, base long, p double, texts long")
    # The plan has as many rows as mix_targets.
    units = sizes.select("doc_id", "source", "n").join(F.broadcast(p), "source").select("mix_id", "source", "doc_id", F.col("n").cast("long").alias("n"), "base", "p", F.xxhash64("doc_id", "mix_id").alias("h"), "texts")
    fixed = units.where("p = 0").select("mix_id", "source", "doc_id", "n", "base", "p")
    live = units.where("p > 0")
    level, done = written(live, "units"), fixed
    most = max((x["texts"] for x in plans if x["p"] > 0), default=0)
    while most > block:
        b = F.pmod(F.col("h"), F.ceil(F.col("texts") / block))
        flown = written(level.withColumn("b", b).groupBy("mix_id", "source", "b").applyInPandas(_fly(False), UNIT), "flown")
        done = done.unionByName(flown.where("p = 0 or p = 1").select(*done.columns))
        rest = flown.where("p > 0 and p < 1")
        left = rest.groupBy("mix_id", "source").agg(F.count("*").alias("texts"))
        # Of every block two units at most are left: the next level is smaller by a factor of block / 2.
        level = written(rest.join(F.broadcast(left), ["mix_id", "source"]).select("mix_id", "source", "doc_id", "n", "base", "p", F.xxhash64("h").alias("h"), "texts"), "units")
        most = level.agg(F.max("texts")).first()[0] or 0
    landed = written(level.groupBy("mix_id", "source").applyInPandas(_fly(True), UNIT), "landed")
    done = done.unionByName(landed.select(*done.columns))
    return done.select("mix_id", "source", "doc_id", F.col("n").alias("tokens"), (F.col("base") + F.col("p").cast("long")).alias("copies")).where("copies > 0")


def stock(sizes: DataFrame) -> DataFrame:
    """source, texts, copies, elsewhere: distinct texts that a source counts with, further copies of them in it, and texts of it that count with another source.

    sizes: doc_id, source, digest, n.
    """
    each = sizes.groupBy("digest", "source").agg(F.count("*").alias("k"), F.min("doc_id").alias("first"))
    owner = sizes.groupBy("digest").agg(F.min(F.struct("doc_id", "source")).alias("o")).select("digest", F.col("o.source").alias("owner"))
    j = each.join(owner, "digest")
    mine = F.col("source") == F.col("owner")
    return j.groupBy("source").agg(F.count_if(mine).alias("texts"), F.sum(F.when(mine, F.col("k") - 1).otherwise(0)).alias("copies"), F.count_if(~mine).alias("elsewhere"))


def shares(mixed: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """mix_id, source, target_share, actual_share, tokens, texts, most_copies; sources that could give nothing have 0.

    With a total also shortfall: tokens that the source's share of it lacks.
    """
    t = targets.where("source is not null and mix_id is not null").select("mix_id", norm_source(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    all_ = got.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    lack = [F.greatest(F.round(F.col("target_share") * total).cast("long") - F.coalesce("tokens", F.lit(0)), F.lit(0)).alias("shortfall")] if total else []
    return (
        t.join(got, ["mix_id", "source"], "left").join(all_, "mix_id", "left")
        .select("mix_id", "source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), "max_repeats", z("tokens"), z("texts"), z("most_copies"), *lack)
    )
