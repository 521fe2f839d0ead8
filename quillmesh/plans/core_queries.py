"""Queries of the engine's own operators over the page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as tx
from quillmesh.functions.refs import is_ref, norm_hash, norm_ref
from quillmesh.operators import build, community, documents, graph, hierarchy, move, overlay, pack, search, snapshots, validate, vector
from quillmesh.plans import derived
from quillmesh.plans.derived import Derived
from quillmesh.session import workspace, written

QUERIES: dict = {}

#: Queries of the search operators, as a user would type them.
SEARCHES = {"search_nobody": ("glossary token", False), "search_body": ("tokenizer reranker", True), "search_multi_term": ("Token budget recall", True), "search_bigram": ("知識グラフ 検索", False), "search_accent": ("Zürich prüfung", True)}
RECALL = [(1, "lexical", "prompt cache"), (2, "lexical", "glossary"), (3, "semantic", "知識グラフ")]
MOVED_TO = "moved/articles/renamed-page"


def query(f):
    QUERIES[f.__name__] = f
    return f


_t = derived.table
_pages = derived.pages
_merged = derived.merged
INDEX = ["layer", "topic", "type", "title", "summary", "keywords", "updated", "hash"]
EDGES = derived.EDGES


def _index(pages: DataFrame) -> DataFrame:
    return overlay.merge_index(overlay.index_records(pages))


def _whole(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, *overlay.COLUMNS)


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str]:
    """Index, adjacency and the page with most out-edges, as derived from the pages once."""
    of = Derived.of(spark, d)
    return of.index(), of.adjacency(), of.start()


def _search_index(spark: SparkSession, d: str, bodies: bool) -> DataFrame:
    return Derived.of(spark, d).search_index(bodies)


def _searcher(name: str):
    text, bodies = SEARCHES[name]
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.search(_search_index(spark, d, bodies), text, 25, bodies).select("ref", F.bround("score", 2).alias("score"))
    run.__name__ = name
    return run


QUERIES |= {n: _searcher(n) for n in SEARCHES}


@query
def search_topic(spark: SparkSession, d: str) -> DataFrame:
    """With a topic filter, which reaches the scan of the stored index."""
    return search.search(_search_index(spark, d, False), "glossary", 10, False, topic="retrieval").select("ref", F.bround("score", 2).alias("score"))


@query
def search_layer(spark: SparkSession, d: str) -> DataFrame:
    """The pages of one layer only: nothing stands for a global page."""
    p = overlay.of_layer(_pages(spark, d, *derived.SEARCH), "global")
    i = search.with_search_fields(overlay.merge_index(overlay.index_records(p.withColumns({"type": F.lit(""), "updated": F.lit(""), "hash": F.lit("")}))))
    return search.search(i, "glossary token", 25, False).select("ref", F.bround("score", 2).alias("score"))


@query
def hook_context(spark: SparkSession, d: str) -> DataFrame:
    """The lines before a prompt, without a deadline."""
    lines = search.hook_context(_search_index(spark, d, False), '{"prompt": "How does the tokenizer handle a glossary?"}', deadline=None)
    return spark.createDataFrame(list(enumerate(lines)), "pos int, line string")


@query
def prompt_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").where("title is not null")
    return docs.select("doc_id", F.array_join(search.prompt_terms(F.col("title")), " ").alias("terms"))


@query
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    return search.prompt_context(_search_index(spark, d, False), "How does the tokenizer handle a glossary?").select("ref", "line")


@query
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, "title").select("page_id", tx.normalize(F.col("title")).alias("title_n"))


@query
def overlay_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(_pages(spark, d, *INDEX)).select("ref", "layer", "topic", "title", "summary", "updated", F.array_join("keywords", "|").alias("keywords"))


@query
def overlay_shadow(spark: SparkSession, d: str) -> DataFrame:
    return overlay.shadowed(_pages(spark, d, "layer"))


@query
def edges_extract(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_pages(spark, d, *EDGES))


@query
def overlay_edges(spark: SparkSession, d: str) -> DataFrame:
    return _merged(_pages(spark, d, *EDGES)).select("src_ref", "rel", "dst_ref", "src").distinct()


@query
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(_merged(_pages(spark, d, *EDGES)))


@query
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d, *EDGES)
    return graph.nodes(_merged(p), p)


@query
def neighbours_rel_dir(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(graph.adjacency(_merged(_pages(spark, d, *EDGES))), ["part_of", "uses"], "out").select("node", "rel", "other")


@query
def bfs_via(spark: SparkSession, d: str) -> DataFrame:
    index, adj, start = _graph(spark, d)
    return graph.traverse(adj, index, start, 3)


@query
def bfs_limited(spark: SparkSession, d: str) -> DataFrame:
    index, adj, start = _graph(spark, d)
    rows = graph.traverse(adj, index, start, 2, ["part_of", "uses", "is_a"], "out", 20)
    return rows.join(index.select("ref", "title"), "ref", "left").select("ref", "hop", "parent", F.coalesce("title", F.lit("(missing)")).alias("title"))


@query
def bfs_topic(spark: SparkSession, d: str) -> DataFrame:
    """Edges that start in one topic only; what they lead to may be anywhere."""
    of = Derived.of(spark, d)
    e = of.edges().where(F.col("topic") == "retrieval")
    start = e.groupBy("src_ref").count().orderBy(F.desc("count"), "src_ref").first()
    adj = written(graph.adjacency(of.edges(), ["retrieval"]), "adj")
    return graph.traverse(adj, of.index(), start[0], 2)


@query
def path_dist(spark: SparkSession, d: str) -> DataFrame:
    _, adj, start = _graph(spark, d)
    return graph.reach(adj, spark.createDataFrame([(start,)], "node string"), 3)


@query
def path_topk(spark: SparkSession, d: str) -> DataFrame:
    _, adj, start = _graph(spark, d)
    far = graph.reach(adj, spark.createDataFrame([(start,)], "node string"), 3).groupBy("dist").agg(F.max("node")).orderBy(F.desc("dist")).first()
    return graph.shortest_paths(adj, start, far[1], 5, 6).select("path_no", "len", graph.path_text(start).alias("path"))


def _by_type(p: DataFrame) -> DataFrame:
    return p.select("layer", "topic", "ref", F.col("type").alias("cid"))


def _type_docs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages, and the documents of the partition by type, which SQL can state."""
    p = written(_pages(spark, d, "layer", "topic", "type", "summary", "hash", "relations", "body"), "pages")
    return p, community.documents(_by_type(p), p, graph.edges(p))


@query
def type_community_docs(spark: SparkSession, d: str) -> DataFrame:
    return documents.document_text(_type_docs(spark, d)[1]).select("layer", "topic", "cid", F.md5("text").alias("text_md5"))


@query
def community_format(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which some have lost a mark and others a key."""
    t = documents.document_text(_type_docs(spark, d)[1])
    lost = F.when(F.col("topic") == "retrieval", F.replace("text", F.lit(documents.MARKS[3]), F.lit(""))).when(F.col("layer") == "project", F.replace("text", F.lit("\ncommunity: "), F.lit("\nkind: "))).otherwise(F.col("text"))
    return documents.format_issues(t.withColumn("text", lost))


@query
def community_stale(spark: SparkSession, d: str) -> DataFrame:
    """Documents after some pages changed and one community went."""
    p, docs = _type_docs(spark, d)
    now = p.withColumn("hash", F.when(F.md5("ref") < "1", "other").otherwise(F.col("hash")))
    return community.stale(docs, _by_type(p).where("cid <> 'papers'"), now)


@query
def community_of_ref(spark: SparkSession, d: str) -> DataFrame:
    p, docs = _type_docs(spark, d)
    got = documents.of_ref(Derived.of(spark, d).start(), _by_type(p), documents.document_text(docs), p)
    return got.select("layer", "cid", F.array_join("members", " ").alias("members"), "summary", "stale")


@query
def inherit_ids(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d, "layer", "topic", "type")
    new = p.select("layer", "topic", "ref", F.concat(F.lit("n-"), F.when(F.md5("ref") < "4", F.lit("new")).otherwise(F.col("type"))).alias("cid"))
    return community.inherit_ids(_by_type(p), new)


@query
def pair_weights(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d, *EDGES)
    return community.pair_weights(graph.edges(p), p)


@query
def node_strength(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d, *EDGES)
    return community.strengths(community.pair_weights(graph.edges(p), p)).select("layer", "topic", "node", F.col("k").cast("long").alias("k"))


@query
def delta_q_rank(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d, *EDGES)
    return community.merge_keys(community.pair_weights(graph.edges(p), p)).select("layer", "topic", "a", "b", F.col("key").cast("long").alias("key"))


def _communities(spark: SparkSession, d: str, *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = written(_pages(spark, d, *EDGES, *more), "pages")
    e = written(graph.edges(p), "edges")
    return p, e, written(community.communities(written(community.pair_weights(e, p), "weights")), "communities")


@query
def cnm_communities(spark: SparkSession, d: str) -> DataFrame:
    return _communities(spark, d)[2]


@query
def community_docs(spark: SparkSession, d: str) -> DataFrame:
    p, e, c = _communities(spark, d, "summary", "hash")
    return community.documents(c, p, e)


@query
def community_of_search(spark: SparkSession, d: str) -> DataFrame:
    c = _communities(spark, d)[2]
    return community.community_hits(search.search(_search_index(spark, d, True), "glossary recall", 10), c)


@query
def type_community_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits by community on a partition that SQL can state: the type of a page."""
    p = _pages(spark, d, "layer", "topic", "type")
    c = p.select("layer", "topic", "ref", F.concat_ws("/", "topic", "type").alias("cid"))
    hits = search.search(_search_index(spark, d, False), "glossary recall", 50, False)
    return community.community_hits(hits, c)


@query
def modularity(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d, *EDGES, "type")
    return community.modularity(written(community.pair_weights(graph.edges(p), p), "weights"), p.select("layer", "topic", "ref", F.col("type").alias("cid")))


@query
def community_ids(spark: SparkSession, d: str) -> DataFrame:
    g = _pages(spark, d, "layer", "topic").groupBy("layer", "topic").agg(F.array_join(F.array_sort(F.collect_list("ref")), "\n").alias("m"))
    return g.select("layer", "topic", F.concat(F.lit("c-"), F.substring(F.sha2("m", 256), 1, 8)).alias("cid"))


@query
def set_hash(spark: SparkSession, d: str) -> DataFrame:
    return community.set_hash(_pages(spark, d, "layer", "topic", "hash"), ["layer", "topic"])


@query
def inherit_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d, "layer", "topic", "type").select("layer", "topic", "ref", "type")
    old = p.select("layer", "topic", "ref", F.col("type").alias("cid"))
    new = p.select("layer", "topic", "ref", F.when(F.md5("ref") < "4", F.lit("new")).otherwise(F.col("type")).alias("cid"))
    return community.inherit_candidates(old, new)


@query
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "manifest")
    a, b = (_snap(m, k) for k in _last_two(m))
    return build.diff(a, b, ["layer", "topic", "ref"]).where("change <> 'same'")


def _last_two(m: DataFrame) -> list[int]:
    """The last two snapshots that came."""
    return sorted(r[0] for r in m.select("snap_id").where("snap_id is not null").distinct().collect())[-2:]


def _snap(m: DataFrame, k: int) -> DataFrame:
    return snapshots.manifest_delivery(m, k).select("layer", "topic", "ref", F.col("h").alias("hb")).select("layer", "topic", "ref", F.lower(F.hex("hb")).alias("hash"))


@query
def build_counters(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "manifest")
    return build.counters(build.diff(*(_snap(m, k) for k in _last_two(m)), ["layer", "topic", "ref"]))


@query
def reparse_set(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a build would parse again: new, changed against the last snapshot, or no longer in the vocabulary."""
    m = _t(spark, d, "manifest")
    p = _pages(spark, d, "layer", "topic", "type", "hash", "relations")
    ch = build.diff(_snap(m, _last_two(m)[-1]), p.select("layer", "topic", "ref", F.lower(F.hex(norm_hash(F.col("hash")))).alias("hash")), ["layer", "topic", "ref"])
    odd = p.where((~F.col("type").isin(build.TYPES[:5])) | F.exists(F.coalesce("relations", F.array()), lambda r: F.coalesce(~r["rel"].isin(build.RELATIONS), F.lit(False))))
    return ch.where(F.col("change").isin("added", "changed")).select("layer", "ref").union(odd.select("layer", "ref")).distinct()


def _check(name: str, columns: list[str], f):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(_pages(spark, d, *columns)).select("code", "severity", "target", "message")
    run.__name__ = name
    QUERIES[name] = run


_check("validate_broken_relations", ["layer", "topic", "relations"], lambda p: validate.broken_relations(p, p))
_check("validate_broken_links", ["layer", "body"], lambda p: validate.broken_links(p, p))
_check("validate_malformed_links", ["layer", "body"], validate.malformed_links)
_check("validate_undefined_relations", ["layer", "topic", "relations"], lambda p: validate.undefined_relations(p, build.RELATIONS))
_check("validate_self_relations", ["layer", "topic", "relations"], validate.self_relations)
_check("validate_duplicate_relations", ["layer", "topic", "relations"], validate.duplicate_relations)
_check("validate_duplicate_keywords", ["layer", "keywords"], validate.duplicate_keywords)
_check("validate_types", ["type"], lambda p: validate.type_mismatch(p, build.TYPES[:5]))
_check("validate_slugs", ["slug"], validate.slug_mismatch)
_check("validate_missing_fields", ["title", "updated"], validate.missing_fields)
_check("validate_body_headings", ["layer", "body"], validate.body_heading)
_check("validate_shadow", ["layer"], validate.shadow)
_check("validate_orphans", [*INDEX, "relations", "body"], lambda p: validate.orphans(_index(p), _merged(p)))
_check("validate_contradictions", EDGES, lambda p: validate.contradictions(_merged(p)))
_check("validate_superseded", EDGES, lambda p: validate.superseded(_merged(p)))


_check("validate_ref_format", ["layer", "topic", "relations"], validate.malformed_relations)
_check("validate_topic_empty", ["topic"], lambda p: validate.empty_topics(p, ["caching", "no-such-topic"]))


@query
def validate_derived(spark: SparkSession, d: str) -> DataFrame:
    """Derived tables that are missing or of another version, by a rule that SQL can state."""
    h = F.md5("topic")
    t = _pages(spark, d, "topic").select("topic").distinct().select(
        "topic", F.lit(True).alias("pages"), (h >= "3").alias("built"), (h < "c").alias("current"), F.when(h < "8", F.array(F.lit("pages"), F.lit("edges"))).otherwise(F.array(F.lit("pages"), F.lit("edges"), F.lit("communities"))).alias("present")
    )
    return validate.stale_derived(t, list(build.Store.TABLES)).select("code", "target", "message")


@query
def validate_quick(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "manifest")
    return validate.quick(_pages(spark, d, "layer"), build.diff(*(_snap(m, k) for k in _last_two(m)), ["layer", "topic", "ref"]))


@query
def validate_all(spark: SparkSession, d: str) -> DataFrame:
    p = written(_whole(spark, d), "pages")
    m = _t(spark, d, "manifest")
    ch = build.diff(*(_snap(m, k) for k in _last_two(m)), ["layer", "topic", "ref"])
    r = validate.validate(p, _index(p), written(_merged(p), "edges"), build.RELATIONS, build.TYPES[:5], ["caching", "no-such-topic"], ch)
    return r.groupBy("severity", "code").agg(F.count("*").alias("issues"))


@query
def validate_stale(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "manifest")
    return validate.stale_topics(build.diff(*(_snap(m, k) for k in _last_two(m)), ["layer", "topic", "ref"])).select("code", "target", "message")


@query
def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d, *INDEX, "relations", "body")
    return validate.degrees(_index(p), _merged(p).select("src_ref", "rel", "dst_ref", "src"))


@query
def body_link_list(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, "body").where("body like '%[[%'").select("page_id", F.posexplode(tx.body_links(F.col("body"))).alias("pos", "link"))


@query
def summary_extract(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, "body").where("body is not null").select("page_id", tx.summary_of(F.col("body")).alias("summary"))


@query
def canonical_refs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "manifest").groupBy(is_ref(F.col("ref")).alias("as_stored"), is_ref(norm_ref(F.col("ref"))).alias("normalised")).agg(F.count("*").alias("n"))


@query
def pack_collect_refs(spark: SparkSession, d: str) -> DataFrame:
    index, adj, start = _graph(spark, d)
    return pack.collect_refs(adj, index, [start], 2)


@query
def pack_sizes(spark: SparkSession, d: str) -> DataFrame:
    return pack.sizes(overlay.merge_index(_whole(spark, d).drop("page_id", "ingested_at")))


@query
def pack_greedy(spark: SparkSession, d: str) -> DataFrame:
    """A pack of the pages within two hops of the page with most links, in 20,000 bytes."""
    index, adj, start = _graph(spark, d)
    refs = pack.collect_refs(adj, index, [start], 2)
    p = overlay.merge_index(_whole(spark, d).drop("page_id", "ingested_at")).join(refs, "ref", "left_semi")
    return pack.greedy(pack.sizes(p), 20_000)


@query
def pack_query(spark: SparkSession, d: str) -> DataFrame:
    """A pack of the best hits of a query, in 20,000 bytes."""
    of = Derived.of(spark, d)
    refs = pack.collect(["tokenizer", "reranker"], of.adjacency(), of.search_index(True), limit=10)
    p = overlay.merge_index(_pages(spark, d, "layer", "topic", "title", "updated", "sources", "body").drop("page_id")).join(refs, "ref", "left_semi")
    return pack.greedy(pack.sizes(p), 20_000)


def _probe(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    v = _t(spark, d, "embeddings")
    return v, v.orderBy("vec_id").select("embedding").first()[0]


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v, q = _probe(spark, d)
    return vector.top_k(v, "vec_id", "embedding", q, 20)


@query
def vector_chunk_dedupe(spark: SparkSession, d: str) -> DataFrame:
    v, q = _probe(spark, d)
    top = vector.top_k(v, "vec_id", "embedding", q, 50).join(v.select("vec_id", "label"), "vec_id")
    hits = top.select(F.lit("global").alias("layer"), F.concat(F.lit("/w/topics/vectors/pages/chunks/page-"), F.col("label").cast("string"), F.lit(".md")).alias("path"), "score", F.col("vec_id").alias("rank"))
    return vector.chunk_hits_to_refs(hits, {"global": "/w"}).select("ref", "score", "rank")


def _ranked(df: DataFrame, order: list) -> DataFrame:
    """pos of the few rows of a result list."""
    from pyspark.sql import Window

    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


@query
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and vector results fused; here a page's vector is that of its number."""
    v, q = _probe(spark, d)
    lex = _ranked(search.search(_search_index(spark, d, False), "glossary recall", 20, False).select("ref", F.bround("score", 2).alias("s")), [F.desc("s"), "ref"])
    near = vector.top_k(v, "vec_id", "embedding", q, 20).join(_pages(spark, d).select(F.col("page_id").alias("vec_id"), "ref"), "vec_id")
    return vector.reciprocal_rank_fusion([lex, _ranked(near, [F.desc("score"), "vec_id"])], "ref", 10)


def _nearest(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the k nearest of every vector whose number is divisible by 100."""
    v = _t(spark, d, "embeddings")
    return v, vector.top_k_batch(v, "vec_id", "embedding", v.where("vec_id % 100 = 0"), k)


@query
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, 20)[1]


@query
def vector_chunk_dedupe_batch(spark: SparkSession, d: str) -> DataFrame:
    v, top = _nearest(spark, d, 50)
    path = F.concat(F.lit("/w/topics/vectors/pages/chunks/page-"), F.col("label").cast("string"), F.lit(".md"))
    hits = top.join(v.select("vec_id", "label"), "vec_id").select("query", F.lit("global").alias("layer"), path.alias("path"), "score", F.col("vec_id").alias("rank"))
    return vector.chunk_hits_to_refs(hits, {"global": "/w"}, by=("query",)).select("query", "ref", "score", "rank")


@query
def hybrid_rrf_batch(spark: SparkSession, d: str) -> DataFrame:
    """One lexical result fused with the vector result of every query."""
    from pyspark.sql import Window

    top = written(_nearest(spark, d, 20)[1], "top")
    lex = _ranked(search.search(_search_index(spark, d, False), "glossary recall", 20, False).select("ref", F.bround("score", 2).alias("s")), [F.desc("s"), "ref"])
    near = top.join(_pages(spark, d).select(F.col("page_id").alias("vec_id"), "ref"), "vec_id")
    near = near.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return vector.reciprocal_rank_fusion([top.select("query").distinct().crossJoin(F.broadcast(lex)), near], "ref", 10, by=("query",))


@query
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of the pages with a keyword among the first ten found for it."""
    index = written(_search_index(spark, d, False), "index")
    found, expected = None, None
    for i, kind, text in RECALL:
        f = _ranked(search.search(index, text, 10, False), [F.desc("score"), "ref"]).select(F.lit(i).alias("id"), "ref", "pos")
        e = index.where(F.array_contains("keywords", text)).agg(F.collect_set("ref").alias("expected")).select(F.lit(i).alias("id"), F.lit(kind).alias("kind"), "expected")
        found, expected = (f, e) if found is None else (found.unionByName(f), expected.unionByName(e))
    return search.recall_at_k(found, expected)


def _moving(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    p = written(_whole(spark, d), "pages")
    r = p.select(F.explode("relations").alias("r")).where("r.to is not null").groupBy(norm_ref(F.col("r.to")).alias("ref")).count().join(p.select("ref").distinct(), "ref").orderBy(F.desc("count"), "ref").first()
    return p, r[0]


@query
def move_plan_counts(spark: SparkSession, d: str) -> DataFrame:
    p, old = _moving(spark, d)
    return move.plan(p, {old: MOVED_TO})


@query
def move_relabel(spark: SparkSession, d: str) -> DataFrame:
    p, old = _moving(spark, d)
    n = move.relabel(p, {old: MOVED_TO})
    return n.select("page_id", "layer", "ref", "topic", "type", "slug", F.md5("body").alias("body_md5"), F.array_join(F.transform("relations", lambda r: F.concat(F.coalesce(r["rel"], F.lit("")), F.lit(">"), F.coalesce(r["to"], F.lit("")))), " ").alias("relations"))


@query
def topic_rename(spark: SparkSession, d: str) -> DataFrame:
    n = move.rename_topic(_whole(spark, d), "caching", "cache-notes")
    return n.select("page_id", "ref", "topic", F.array_join(F.transform("relations", lambda r: F.coalesce(r["to"], F.lit(""))), " ").alias("targets"))


@query
def topic_rename_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies after the renaming of a topic, as hash, and how many of their links changed."""
    links = tx.rewrite_topic_links(F.col("body"), "caching", "cache-notes")["count"].cast("long")
    n = move.rename_topic(_whole(spark, d).withColumn("links", links), "caching", "cache-notes")
    return n.select("page_id", F.md5("body").alias("body_md5"), "links")


@query
def oplog_lines(spark: SparkSession, d: str) -> DataFrame:
    """The log as lines, each operation once."""
    log = _t(spark, d, "oplog").groupBy("op_id").agg(F.min(F.struct("date", "op", "target", "detail")).alias("r")).select("r.*")
    return move.log_lines(log)


@query
def oplog_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "oplog").groupBy(F.lower(F.trim("op")).alias("op")).agg(F.count_distinct("op_id").alias("ops"), F.count_distinct(norm_ref(F.col("target"))).alias("targets"))


@query
def export_index_md(spark: SparkSession, d: str) -> DataFrame:
    return build.export_index_md(_index(_pages(spark, d, *INDEX)))


@query
def export_index_pages(spark: SparkSession, d: str) -> DataFrame:
    return build.export_index_pages(_index(_pages(spark, d, *INDEX)))


@query
def adjacency_read_back(spark: SparkSession, d: str) -> DataFrame:
    """The adjacency written as JSON, nodes without links included, and read again."""
    p = _pages(spark, d, *EDGES)
    e = written(_merged(p), "edges")
    at = workspace(spark, "adjacency")
    build.export_adjacency_jsonl(graph.adjacency(e), graph.nodes(e, p)).write.text(at)
    return build.read_adjacency(spark, at)


@query
def export_index_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """All fields of the record but keywords, whose JSON SQL writes otherwise."""
    return build.export_index_jsonl(_index(_pages(spark, d, *INDEX)).drop("keywords"))


@query
def export_graph_tsv(spark: SparkSession, d: str) -> DataFrame:
    return build.export_graph_tsv(_merged(_pages(spark, d, *EDGES)))


@query
def export_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return build.export_adjacency(graph.adjacency(_merged(_pages(spark, d, *EDGES))))


@query
def star_edges(spark: SparkSession, d: str) -> DataFrame:
    """The star schema as a graph: every foreign key an edge, edges of order lines once a pair of part and supplier."""
    t = lambda n: _t(spark, d, n)
    ref = lambda kind, c: F.concat(F.lit(kind + "-"), F.col(c).cast("string"))
    e = lambda df, k1, c1, rel, k2, c2: df.select(ref(k1, c1).alias("src"), F.lit(rel).alias("rel"), ref(k2, c2).alias("dst"))
    parts = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    all_ = e(t("nation"), "nation", "n_nationkey", "part_of", "region", "n_regionkey").union(e(t("customer"), "customer", "c_custkey", "part_of", "nation", "c_nationkey"))
    all_ = all_.union(e(t("supplier"), "supplier", "s_suppkey", "part_of", "nation", "s_nationkey")).union(e(t("orders"), "order", "o_orderkey", "derived_from", "customer", "o_custkey")).union(e(parts, "part", "l_partkey", "uses", "supplier", "l_suppkey"))
    return all_.groupBy("rel", "dst").agg(F.count("*").alias("n"))


@query
def trade_weights(spark: SparkSession, d: str) -> DataFrame:
    """Trade between nations as pair weights: order lines by customer's and supplier's nation, in either direction."""
    t = lambda n: _t(spark, d, n)
    per = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    j = per.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.where("c_nationkey <> s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.sum("n").alias("w"))


@query
def page_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_t(spark, d, "pages")).select("ref", "descendant", F.col("distance").cast("long").alias("distance"))
