"""Communities of a topic's pages: greedy modularity, ids that survive rebuilds, lookups and documents."""

from __future__ import annotations

import hashlib
import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import buckets, written

#: Pairs of one connected component that one task merges; larger components stop with an error instead of changing the result.
MAX_PAIRS = 5_000_000
#: Pairs of a topic that one task merges as they are; only larger topics are split into their components first.
WHOLE_PAIRS = 500_000


def pair_weights(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """layer, topic, a, b, w: number of edges between two different pages of one topic and layer, whatever their direction and relation."""
    member = pages.select("layer", "topic", F.col("ref").alias("dst_ref"))
    inner = edges.where("src_ref <> dst_ref").join(member, ["layer", "topic", "dst_ref"], "left_semi")
    inner = inner.join(member.withColumnRenamed("dst_ref", "src_ref"), ["layer", "topic", "src_ref"], "left_semi")
    return inner.groupBy("layer", "topic", F.least("src_ref", "dst_ref").alias("a"), F.greatest("src_ref", "dst_ref").alias("b")).agg(F.count("*").alias("w"))


def strengths(weights: DataFrame) -> DataFrame:
    """layer, topic, node, k: sum of the weights at each node."""
    return weights.select("layer", "topic", F.explode(F.array("a", "b")).alias("node"), "w").groupBy("layer", "topic", "node").agg(F.sum("w").alias("k"))


def merge_keys(weights: DataFrame) -> DataFrame:
    """layer, topic, a, b, key = 2 m W - K K of every connected pair: the integer that the first merge maximises."""
    k = strengths(weights)
    m = weights.groupBy("layer", "topic").agg(F.sum("w").alias("m"))
    ka, kb = (k.select("layer", "topic", F.col("node").alias(x), F.col("k").alias(f"k{x}")) for x in "ab")
    on = ["layer", "topic"]
    j = weights.join(m, on).join(ka, [*on, "a"]).join(kb, [*on, "b"])
    return j.select("layer", "topic", "a", "b", (2 * F.col("m") * F.col("w") - F.col("ka") * F.col("kb")).alias("key"))


def greedy(pairs: list[tuple[str, str, int]], m: int | None = None) -> list[list[str]]:
    """Communities of a weighted graph by greedy modularity.

    The connected pair of communities with the greatest 2 m W - K K is merged,
    of equal ones that with the least pair of smallest members, until none is
    above 0.  m is the weight of the whole topic (default: of these pairs):
    components never influence each other but through it, so each may be
    merged alone.

    A key 2 m W - K K falls as K grows and rises only with W.  Each pair is
    therefore queued at the community of greater K alone, by W and then by K
    and name of the other, an order that its own K does not disturb; what is
    queued is never worse than it is now, and is looked at again only when it
    comes first.  Of two communities the one with fewer neighbours is moved.
    """
    m = sum(w for _, _, w in pairs) if m is None else m
    names = sorted({x for a, b, _ in pairs for x in (a, b)})
    at = {x: i for i, x in enumerate(names)}
    links: list[dict[int, int]] = [{} for _ in names]
    for a, b, w in pairs:
        a, b = at[a], at[b]
        links[a][b] = links[b][a] = links[a].get(b, 0) + w
    k = [sum(d.values()) for d in links]
    # The number of a community stays that of the one with more neighbours; least is that of its smallest member, which names it.
    least, joined = list(range(len(names))), list(range(len(names)))
    queued: list[dict[int, list]] = [{} for _ in names]
    # First of each community's queue, or better; of what stands in the heap only this counts.
    none = (0,)
    first: list[tuple] = [none] * len(names)
    heap: list[tuple] = []

    def ranked(u: int, c: int, w: int) -> tuple:
        x, y = least[u], least[c]
        return (k[u] * k[c] - 2 * m * w, x, y, u, c) if x < y else (k[u] * k[c] - 2 * m * w, y, x, u, c)

    def put(u: int, c: int, w: int) -> None:
        if k[u] < k[c]:
            u, c = c, u
        r = ranked(u, c, w)
        if r < none:
            heapq.heappush(queued[u].setdefault(w, []), (k[c], least[c], c))
            if r < first[u]:
                first[u] = r
                heapq.heappush(heap, r)

    def look(u: int) -> tuple:
        """The first of u's queue as it is now."""
        q, found = queued[u], none
        first[u] = ()
        for w in list(q):
            h = q[w]
            while h:
                kc, _, c = h[0]
                if links[u].get(c) != w:
                    heapq.heappop(h)
                elif k[c] != kc:
                    heapq.heappop(h)
                    put(u, c, w)
                else:
                    break
            r = ranked(u, h[0][2], w) if h else none
            if r < none:
                found = min(found, r)
            else:
                # The others of this weight are not above 0 either, and never will be.
                del q[w]
        first[u] = found
        return found

    for a, d in enumerate(links):
        for b, w in d.items():
            if a < b:
                put(a, b, w)
    while heap:
        r = heapq.heappop(heap)
        u = r[3]
        if r != first[u]:
            continue
        now = look(u)
        if now != r:
            if now < none:
                heapq.heappush(heap, now)
            continue
        c = r[4]
        if len(links[u]) < len(links[c]):
            u, c = c, u
        del links[u][c], links[c][u]
        joined[c] = u
        k[u] += k[c]
        least[u] = min(least[u], least[c])
        first[u] = first[c] = ()
        for x, w in links[c].items():
            del links[x][c]
            links[u][x] = links[x][u] = w = w + links[u].get(x, 0)
            put(u, x, w)
        links[c], queued[c] = {}, {}
        now = look(u)
        if now < none:
            heapq.heappush(heap, now)
    members: dict[int, list[str]] = {}
    for i, x in enumerate(names):
        while joined[i] != joined[joined[i]]:
            joined[i] = joined[joined[i]]
        members.setdefault(joined[i], []).append(x)
    return sorted(members.values())


def community_id(members: list[str]) -> str:
    return "c-" + hashlib.sha256("\n".join(sorted(members)).encode()).hexdigest()[:8]


def components(weights: DataFrame) -> DataFrame:
    """layer, topic, node, comp: the least node of each connected component, by rounds of hooking and pointer jumping.

    Each round every node takes the least label of its neighbours and then the
    label of its label, so that long chains shrink fast; labels are written
    each round, and only their number of changes reaches the driver.
    """
    on = ["layer", "topic"]
    both = written(weights.select(*on, F.col("a").alias("node"), F.col("b").alias("other")).unionByName(weights.select(*on, F.col("b").alias("node"), F.col("a").alias("other"))), "links")
    label = written(both.groupBy(*on, "node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "other"), [*on, "other"]).groupBy(*on, "node").agg(F.min("comp").alias("n"))
        hook = label.join(near, [*on, "node"]).select(*on, "node", "comp", F.least("comp", "n").alias("c2"))
        jump = label.select(*on, F.col("node").alias("c2"), F.col("comp").alias("c3"))
        new = written(hook.join(jump, [*on, "c2"], "left").select(*on, "node", "comp", F.least("c2", F.coalesce("c3", "c2")).alias("c4")), "labels")
        changed = not new.where("comp <> c4").isEmpty()
        label = new.select(*on, "node", F.col("c4").alias("comp"))
        if not changed:
            return label


def _detect(d: pd.DataFrame) -> pd.DataFrame:
    if len(d) > MAX_PAIRS:
        raise ValueError(f"component {d['comp'].iloc[0]} has {len(d)} pairs; the greedy merge takes {MAX_PAIRS} in one task")
    got = greedy(list(zip(d["a"], d["b"], d["w"], strict=True)), int(d["m"].iloc[0]))
    layer, topic = d["layer"].iloc[0], d["topic"].iloc[0]
    return pd.DataFrame([(layer, topic, cid, r) for g in got for cid in [community_id(g)] for r in g], columns=["layer", "topic", "cid", "ref"])


def communities(weights: DataFrame) -> DataFrame:
    """layer, topic, cid, ref of every page with an edge inside its topic.

    Parallel over the topics, and over the connected components of large ones.
    """
    on = ["layer", "topic"]
    spark = weights.sparkSession
    sizes = written(weights.groupBy(*on).agg(F.sum("w").alias("m"), F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > WHOLE_PAIRS).select(*on)
    each = weights.join(sizes.drop("n"), on)
    if large.isEmpty():
        each = each.withColumn("comp", F.lit(None).cast("string"))
    else:
        each = each.join(components(weights.join(large, on, "left_semi")).withColumnRenamed("node", "a"), [*on, "a"], "left")
    # Groups cost far more than their bytes tell, so a fixed number of tasks, which is not brought together by size.
    each = each.repartition(max(buckets(spark), 8 * spark.sparkContext.defaultParallelism), *on, "comp")
    return each.groupBy(*on, "comp").applyInPandas(_detect, "layer string, topic string, cid string, ref string")


def modularity(weights: DataFrame, assigned: DataFrame) -> DataFrame:
    """layer, topic, q of a given assignment (layer, topic, cid, ref)."""
    on = ["layer", "topic"]
    m = weights.groupBy(*on).agg(F.sum("w").alias("m"))
    c = assigned.select(*on, F.col("ref").alias("node"), "cid")
    k = strengths(weights).join(c, [*on, "node"]).groupBy(*on, "cid").agg(F.sum("k").alias("k")).groupBy(*on).agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("kk"))
    ca, cb = (c.select(*on, F.col("node").alias(x), F.col("cid").alias(f"c{x}")) for x in "ab")
    inner = weights.join(ca, [*on, "a"]).join(cb, [*on, "b"]).groupBy(*on).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0)).alias("w_in"))
    return m.join(k, on).join(inner, on).select(*on, F.round(F.col("w_in") / F.col("m") - F.col("kk") / (4.0 * F.col("m") * F.col("m")), 9).alias("q"))


def inherit_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """layer, topic, old_cid, new_cid, both, either, new_min: pairs that share half of their members or more.

    Pairs without a common member can never qualify, so an equi-join on the
    member finds all of them.
    """
    on = ["layer", "topic"]
    n_old = old.groupBy(*on, F.col("cid").alias("old_cid")).agg(F.count("*").alias("n_old"))
    n_new = new.groupBy(*on, F.col("cid").alias("new_cid")).agg(F.count("*").alias("n_new"), F.min("ref").alias("new_min"))
    both = old.select(*on, "ref", F.col("cid").alias("old_cid")).join(new.select(*on, "ref", F.col("cid").alias("new_cid")), [*on, "ref"]).groupBy(*on, "old_cid", "new_cid").agg(F.count("*").alias("both"))
    j = both.join(n_old, [*on, "old_cid"]).join(n_new, [*on, "new_cid"]).withColumn("either", F.col("n_old") + F.col("n_new") - F.col("both"))
    return j.where(2 * F.col("both") >= F.col("either")).select(*on, "old_cid", "new_cid", "both", "either", "new_min")


def _inherit(d: pd.DataFrame) -> pd.DataFrame:
    from fractions import Fraction

    rows = sorted(zip(d["old_cid"], d["new_cid"], d["both"], d["either"], d["new_min"], strict=True), key=lambda r: (-Fraction(int(r[2]), int(r[3])), r[0], r[4], r[1]))
    used_old, used_new, out = set(), set(), []
    for o, n, *_ in rows:
        if o not in used_old and n not in used_new:
            used_old.add(o)
            used_new.add(n)
            out.append((d["layer"].iloc[0], d["topic"].iloc[0], o, n))
    return pd.DataFrame(out, columns=["layer", "topic", "old_cid", "cid"])


def inherit_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """new with the ids of old communities that live on; each old id goes to one new community, the most alike first.

    A community takes part in three candidates at most, so a topic's list
    is as short as its number of communities.
    """
    took = inherit_candidates(old, new).groupBy("layer", "topic").applyInPandas(_inherit, "layer string, topic string, old_cid string, cid string")
    return new.join(took, ["layer", "topic", "cid"], "left").select("layer", "topic", F.coalesce("old_cid", "cid").alias("cid"), "ref")


def set_hash(df: DataFrame, by: list[str]) -> DataFrame:
    """by, set_hash: SHA-256 over the sorted lines ``ref<tab>hash`` of each group, without a last line end."""
    digest = F.regexp_replace(F.lower(F.trim("hash")), "^sha256:", "")
    lines = F.array_join(F.array_sort(F.collect_list(F.concat("ref", F.lit("\t"), F.coalesce(digest, F.lit(""))))), "\n")
    return df.groupBy(*by).agg(F.concat(F.lit("sha256:"), F.sha2(lines, 256)).alias("set_hash"))


def community_hits(hits: DataFrame, assigned: DataFrame) -> DataFrame:
    """topic, cid, hits, size of the communities of search hits, most hits first. Of a ref in both layers the project's community counts."""
    size = assigned.groupBy("layer", "topic", "cid").agg(F.count("*").alias("size"))
    one = assigned.groupBy("ref").agg(F.max_by(F.struct("layer", "topic", "cid"), F.struct(F.col("layer") == "project", "layer", "cid")).alias("c")).select("ref", "c.*")
    return hits.select("ref").join(one, "ref").join(size, ["layer", "topic", "cid"]).groupBy("topic", "cid", "size").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "cid").select("topic", "cid", "hits", "size")


def documents(assigned: DataFrame, pages: DataFrame, edges: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """layer, topic, cid, n_members, built_from, members, relations, summary: the community documents.

    members and relations are the generated part as text; a summary written by
    hand (old: layer, topic, cid, summary) is kept.
    """
    on = ["layer", "topic"]
    m = assigned.join(pages.select(*on, "ref", "summary", "hash"), [*on, "ref"])
    line = F.rtrim(F.concat(F.lit("- [["), "ref", F.lit("]] — "), F.coalesce("summary", F.lit(""))))
    text = m.groupBy(*on, "cid").agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("members"))
    built = set_hash(m, [*on, "cid"]).withColumnRenamed("set_hash", "built_from")
    ca = assigned.select(*on, F.col("ref").alias("src_ref"), "cid")
    cb = assigned.select(*on, F.col("ref").alias("dst_ref"), F.col("cid").alias("cid2"))
    rel = edges.where("src_ref <> dst_ref").join(ca, [*on, "src_ref"]).join(cb, [*on, "dst_ref"]).where("cid = cid2").groupBy(*on, "cid", "rel").agg(F.count("*").alias("n"))
    rel = rel.groupBy(*on, "cid").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "rel", "n"))), "\n").alias("relations"))
    out = text.join(built, [*on, "cid"]).join(rel, [*on, "cid"], "left").withColumn("relations", F.coalesce("relations", F.lit("")))
    if old is None:
        return out.withColumn("summary", F.lit(""))
    return out.join(old.select(*on, "cid", "summary"), [*on, "cid"], "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def stale(docs: DataFrame, assigned: DataFrame, pages: DataFrame) -> DataFrame:
    """layer, topic, cid, reason of documents to renew: orphan (their community is gone) or stale (a member changed)."""
    on = ["layer", "topic"]
    now = set_hash(assigned.join(pages.select(*on, "ref", "hash"), [*on, "ref"]), [*on, "cid"])
    j = docs.select(*on, "cid", "built_from").join(now, [*on, "cid"], "left")
    return j.where(~F.col("set_hash").eqNullSafe(F.col("built_from"))).select(*on, "cid", F.when(F.col("set_hash").isNull(), "orphan").otherwise("stale").alias("reason"))
