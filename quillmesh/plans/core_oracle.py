"""The core queries as SQL for DuckDB, built from the same definitions of terms, weights and vocabularies."""

from __future__ import annotations

from quillmesh.functions.text import CJK, is_cjk
from quillmesh.operators import build
from quillmesh.operators.documents import MARKS
from quillmesh.operators.pack import BANNER, OMIT
from quillmesh.operators.search import BANNER as HOOK
from quillmesh.operators.search import query_terms
from quillmesh.plans.core_queries import MOVED_TO, RECALL, SEARCHES

ORACLE: dict[str, str] = {}

_NORM = "translate(nfc_normalize({}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REF = "regexp_full_match({}, '[a-z0-9-]+/[a-z0-9-]+/[a-z0-9-]+')"

PG = """pg as (select page_id, lower(trim(ref)) ref, layer, topic, type, slug, title, summary, keywords, relations, sources, updated, body, hash from
    (select *, row_number() over (partition by page_id order by coalesce(ingested_at, timestamp '9999-12-31')) rn from pages where page_id is not null and ref is not null) where rn = 1)"""
IX = """ix as (select * from (select *, row_number() over (partition by ref order by (layer = 'project') desc, layer desc) k from pg) where k = 1)"""
OUTSIDE = """oc as (select page_id, layer, topic, ref, fence, regexp_replace(regexp_replace(fence, '``[^\\n]+?``', ' ', 'g'), '`[^`\\n]+`', ' ', 'g') t from
    (select *, regexp_replace(replace(body, chr(13) || chr(10), chr(10)), '(?ms)(^ {0,3}```.*?(^ {0,3}```[^\\n]*$|\\z))|(^ {0,3}~~~.*?(^ {0,3}~~~[^\\n]*$|\\z))', '', 'g') fence from pg where body is not null)),
  bl as (select page_id, layer, topic, ref, unnest(ls) link, generate_subscripts(ls, 1) - 1 pos from (select *, regexp_extract_all(t, '\\[\\[([^\\[\\]\\n]+)\\]\\]', 1) ls from oc))"""
REL = "rl as (select page_id, layer, topic, ref, lower(trim(r.rel)) rel, r.rel rel_raw, r.to to_raw, lower(trim(r.to)) dst from (select *, unnest(relations) r from pg) where r.rel is not null and r.to is not null)"
EDGES = f"""{REL}, {OUTSIDE}, e as (select layer, topic, ref src_ref, rel, dst dst_ref, 'frontmatter' src from rl
    union select layer, topic, ref, 'mentions', link, 'body' from bl where {_REF.format('link')} and link <> ref)"""
MERGED = """sh as (select ref from pg group by 1 having bool_or(layer = 'project') and bool_or(coalesce(layer, '') <> 'project')),
  me as (select * from e where layer = 'project' or src_ref not in (select ref from sh))"""
ADJ = "adj as (select src_ref node, 0 dir, rel, dst_ref other from me union select dst_ref, 1, rel, src_ref from me)"
START = "st as (select src_ref s from me group by 1 order by count(*) desc, 1 limit 1)"
GRAPH = f"{PG}, {IX}, {EDGES}, {MERGED}, {ADJ}, {START}"


def walk(hops: int, where: str = "true") -> str:
    """All walks from the start up to so many hops; the first of a node by hop and key is its discovery."""
    return f"""w(node, hop, key, parent, rel, dir) as (select s, 0, []::struct(d int, r varchar, o varchar)[], null::varchar, null::varchar, null::int from st
    union all select a.other, w.hop + 1, list_append(w.key, {{'d': a.dir::int, 'r': a.rel, 'o': a.other}}), w.node, a.rel, a.dir::int from w join adj a on a.node = w.node where w.hop < {hops} and {where}),
  first as (select * from (select *, row_number() over (partition by node order by hop, key) k from w) where k = 1)"""


def _match(field: str, t: str) -> str:
    if is_cjk(t) and len(t) >= 2:
        g = sorted({t[i : i + 2] for i in range(len(t) - 1)})
        return "(" + " + ".join(f"contains({field}, '{x}')::int" for x in g) + f") / {len(g)}::double"
    return f"contains({field}, '{t}')::int::double"


def _term(t: str) -> str:
    f = lambda c: f"(case when {c} = '{t}' then 2::double else {_match(c, t)} end)"
    kw = f"coalesce(list_max(list_transform(kn, lambda k: {f('k')})), 0::double)"
    return f"greatest(3::double * {f('tn')}, 2::double * {kw}, {f('sn')})"


def scored(query: str, bodies: bool) -> str:
    terms = query_terms(query)
    total = " + ".join(_term(t) for t in terms)
    every = " and ".join(f"{_term(t)} > 0" for t in terms)
    body = " + ".join(f"0.5::double * least(len(list_filter(ln, lambda l: contains(l, '{t}'))), 5)" for t in terms) if bodies else "0::double"
    return f"""n as (select *, {_NORM.format("coalesce(title, '')")} tn, {_NORM.format("coalesce(summary, '')")} sn, list_transform(coalesce(keywords, []), lambda k: {_NORM.format('k')}) kn,
      string_split({_NORM.format("replace(coalesce(body, ''), chr(13) || chr(10), chr(10))")}, chr(10)) ln from ix),
    sc as (select *, (case when {every} then 2::double * ({total}) else {total} end) + {body} score from n)"""


for _name, (_text, _bodies) in SEARCHES.items():
    ORACLE[_name] = f"with {PG}, {IX}, {scored(_text, _bodies)} select ref, round_even(score, 2) score from (select * from sc where score > 0 order by score desc, ref limit 25)"
ORACLE["search_topic"] = f"with {PG}, {IX}, {scored('glossary', False)} select ref, round_even(score, 2) score from (select * from sc where score > 0 and topic = 'retrieval' order by score desc, ref limit 10)"

ORACLE["search_layer"] = f"with {PG}, ix as (select * from pg where layer = 'global'), {scored('glossary token', False)} select ref, round_even(score, 2) score from (select * from sc where score > 0 order by score desc, ref limit 25)"
_RUN = f"[0-9a-z]{{3,}}|[{CJK}]{{2,}}"
ORACLE["prompt_terms"] = f"""with t as (select doc_id, regexp_extract_all({_NORM.format('title')}, '{_RUN}') x from documents where title is not null)
  select doc_id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i)[1:8], ' ') terms from t"""
ORACLE["prompt_context"] = f"with {PG}, {IX}, {scored('how does the tokenizer handle glossary', False)} select ref, rtrim('- [[' || ref || ']] — ' || coalesce(summary, '')) line from (select * from sc where score > 0 order by score desc, ref limit 5)"
ORACLE["hook_context"] = f"with {PG}, {IX}, {scored('how does the tokenizer handle glossary', False)}, h as (select *, row_number() over (order by score desc, ref) n from (select * from sc where score > 0 order by score desc, ref limit 5)) select 0 pos, '{HOOK}' line union all select n::int, rtrim('- [[' || ref || ']] — ' || coalesce(summary, '')) from h"
ORACLE["normalize_text"] = f"with {PG} select page_id, {_NORM.format('title')} title_n from pg"
ORACLE["overlay_index"] = f"with {PG}, {IX} select ref, layer, topic, coalesce(title, '') title, coalesce(summary, '') summary, coalesce(updated::varchar, '') updated, coalesce(array_to_string(keywords, '|'), '') keywords from ix"
ORACLE["overlay_shadow"] = f"with {PG}, {EDGES}, {MERGED} select ref from sh"
ORACLE["edges_extract"] = f"with {PG}, {EDGES} select * from e"
ORACLE["overlay_edges"] = f"with {PG}, {EDGES}, {MERGED} select distinct src_ref, rel, dst_ref, src from me"
ORACLE["adjacency"] = f"with {GRAPH} select * from adj"
ORACLE["graph_nodes"] = f"with {GRAPH} select ref node from pg union select src_ref from me union select dst_ref from me"
ORACLE["neighbours_rel_dir"] = f"with {GRAPH} select node, rel, other from adj where dir = 0 and rel in ('part_of', 'uses')"
ORACLE["bfs_via"] = f"with recursive {GRAPH}, {walk(3)} select node ref, hop, parent, rel, case dir when 0 then 'out' else 'in' end direction from first where hop > 0"
_NARROW = "a.dir = 0 and a.rel in ('part_of', 'uses', 'is_a')"
ORACLE["bfs_limited"] = f"with recursive {GRAPH}, {walk(2, _NARROW)}, f as (select * from first where hop > 0 order by hop, node limit 20) select f.node ref, hop, parent, coalesce(case when ix.ref is not null then coalesce(ix.title, '') end, '(missing)') title from f left join ix on ix.ref = f.node"
_TOPIC = GRAPH.replace("from me union select", "from me where topic = 'retrieval' union select").replace("src_ref from me)", "src_ref from me where topic = 'retrieval')").replace("s from me group", "s from me where topic = 'retrieval' group")
ORACLE["bfs_topic"] = f"with recursive {_TOPIC}, {walk(2)} select node ref, hop, parent, rel, case dir when 0 then 'out' else 'in' end direction from first where hop > 0"
ORACLE["path_dist"] = f"with recursive {GRAPH}, {walk(3)} select node, hop dist from first"
ORACLE["path_topk"] = f"""with recursive {GRAPH}, {walk(3)}, goal as (select node, hop from first where hop > 0 order by hop desc, node desc limit 1),
  p as (select list_transform(w.key, lambda k: {{'ref': k.o, 'rel': k.r, 'dir': k.d}}) steps, w.hop len from w join goal g on w.node = g.node and w.hop = g.hop),
  q as (select *, row_number() over (order by steps) path_no from p)
  select path_no, len, (select s from st) || array_to_string(list_transform(steps, lambda k: case k.dir when 0 then ' -' || k.rel || '-> ' else ' <-' || k.rel || '- ' end || k.ref), '') path from q where path_no <= 5"""

WEIGHTS = f"""{PG}, {EDGES}, pw as (select e.layer, e.topic, least(src_ref, dst_ref) a, greatest(src_ref, dst_ref) b, count(*) w from e
    where src_ref <> dst_ref and exists (select 1 from pg p where p.layer = e.layer and p.topic = e.topic and p.ref = e.src_ref) and exists (select 1 from pg p where p.layer = e.layer and p.topic = e.topic and p.ref = e.dst_ref) group by 1, 2, 3, 4),
  ks as (select layer, topic, node, sum(w)::bigint k from (select layer, topic, a node, w from pw union all select layer, topic, b, w from pw) group by 1, 2, 3)"""
ORACLE["pair_weights"] = f"with {WEIGHTS} select * from pw"
ORACLE["node_strength"] = f"with {WEIGHTS} select * from ks"
ORACLE["delta_q_rank"] = f"""with {WEIGHTS}, m as (select layer, topic, sum(w) m from pw group by 1, 2)
  select layer, topic, a, b, (2 * m * w - x.k * y.k)::bigint as key from pw join m using (layer, topic) join ks x on x.layer = pw.layer and x.topic = pw.topic and x.node = a join ks y on y.layer = pw.layer and y.topic = pw.topic and y.node = b"""
ORACLE["modularity"] = f"""with {WEIGHTS}, m as (select layer, topic, sum(w)::double m from pw group by 1, 2), ty as (select layer, topic, ref, type from pg),
  kk as (select layer, topic, sum(k * k) kk from (select ks.layer, ks.topic, type, sum(k)::double k from ks join ty on ty.layer = ks.layer and ty.topic = ks.topic and ty.ref = node group by 1, 2, 3) group by 1, 2),
  i as (select pw.layer, pw.topic, sum(case when x.type = y.type then w else 0 end)::double w_in from pw join ty x on x.layer = pw.layer and x.topic = pw.topic and x.ref = a join ty y on y.layer = pw.layer and y.topic = pw.topic and y.ref = b group by 1, 2)
  select layer, topic, round(w_in / m - kk / (4 * m * m), 9) q from m join kk using (layer, topic) join i using (layer, topic)"""
ORACLE["community_ids"] = f"with {PG} select layer, topic, 'c-' || substr(sha256(string_agg(ref, chr(10) order by ref)), 1, 8) cid from pg group by 1, 2"
_HEX = "regexp_replace(lower(trim(coalesce(hash, ''))), '^sha256:', '')"
ORACLE["set_hash"] = f"with {PG} select layer, topic, 'sha256:' || sha256(string_agg(ref || chr(9) || {_HEX}, chr(10) order by ref || chr(9) || {_HEX})) set_hash from pg group by 1, 2"
TYPE_DOCS = f"""{PG}, {EDGES}, z as (select layer, topic, type cid, count(*) n, string_agg(rtrim('- [[' || ref || ']] — ' || coalesce(summary, '')), chr(10) order by rtrim('- [[' || ref || ']] — ' || coalesce(summary, ''))) members,
    'sha256:' || sha256(string_agg(ref || chr(9) || {_HEX}, chr(10) order by ref || chr(9) || {_HEX})) built from pg group by 1, 2, 3),
  ir as (select a.layer, a.topic, a.type cid, e.rel, count(*) n from e join pg a on a.layer = e.layer and a.topic = e.topic and a.ref = src_ref join pg b on b.layer = e.layer and b.topic = e.topic and b.ref = dst_ref where src_ref <> dst_ref and a.type = b.type group by 1, 2, 3, 4),
  it as (select layer, topic, cid, string_agg('| ' || rel || ' | ' || n || ' |', chr(10) order by rel || ' ' || n) t from ir group by 1, 2, 3),
  dt as (select z.layer, z.topic, z.cid, array_to_string(['---', 'community: ' || z.cid, 'topic: ' || z.topic, 'built_from: ' || built, '---', '', '{MARKS[0]}', '## Pages (' || n || ')', '', members, '', '## Relations inside', '',
    case when t is null then '(no relations inside)' else '| rel | edges |' || chr(10) || '|---|---|' || chr(10) || t end, '{MARKS[1]}', '', '{MARKS[2]}', '{MARKS[3]}', ''], chr(10)) body from z left join it on it.layer = z.layer and it.topic = z.topic and it.cid = z.cid)"""
ORACLE["type_community_docs"] = f"with {TYPE_DOCS} select layer, topic, cid, md5(body) text_md5 from dt"
ORACLE["community_format"] = f"""with {TYPE_DOCS}, f as (select layer || '/' || topic || '/' || cid target, layer, topic from dt)
  select 'error' severity, 'community-format' code, target, message from (select target, '{MARKS[3]} stands 0 times' message from f where topic = 'retrieval' union all
    select target, unnest(['community is missing', '1 lines of front matter that are no key of a document']) from f where topic <> 'retrieval' and layer = 'project')"""
ORACLE["community_stale"] = f"with {PG} select layer, topic, type cid, case when type = 'papers' then 'orphan' else 'stale' end reason from pg group by 1, 2, 3 having type = 'papers' or bool_or(md5(ref) < '1')"
ORACLE["community_of_ref"] = f"""with {GRAPH}, a as (select layer, topic, type from pg where ref = (select s from st) order by layer = 'project' desc, layer limit 1)
  select pg.layer, pg.type cid, string_agg(ref, ' ' order by ref) members, '' summary, false stale from pg join a on a.layer = pg.layer and a.topic = pg.topic and a.type = pg.type group by 1, 2"""
ORACLE["type_community_hits"] = f"""with {PG}, {IX}, {scored('glossary recall', False)}, h as (select ref from sc where score > 0 order by score desc, ref limit 50),
  z as (select layer, topic, topic || '/' || type cid, count(*) size from pg group by 1, 2, 3), o as (select ref, layer, topic, topic || '/' || type cid from ix)
  select z.topic, z.cid, count(*) hits, z.size from h join o using (ref) join z on z.layer = o.layer and z.cid = o.cid group by z.layer, z.topic, z.cid, z.size"""
ORACLE["inherit_candidates"] = f"""with {PG}, o as (select layer, topic, ref, type cid from pg), n as (select layer, topic, ref, case when md5(ref) < '4' then 'new' else type end cid from pg),
  a as (select layer, topic, cid, count(*) c from o group by all), b as (select layer, topic, cid, count(*) c, min(ref) m from n group by all),
  x as (select o.layer, o.topic, o.cid old_cid, n.cid new_cid, count(*) n_both from o join n using (layer, topic, ref) group by all)
  select x.layer, x.topic, old_cid, new_cid, n_both as "both", a.c + b.c - n_both as "either", b.m new_min from x join a on a.layer = x.layer and a.topic = x.topic and a.cid = old_cid join b on b.layer = x.layer and b.topic = x.topic and b.cid = new_cid where 2 * n_both >= a.c + b.c - n_both"""
_CAND = ORACLE["inherit_candidates"].replace("then 'new' else type end cid", "then 'n-new' else 'n-' || type end cid")
ORACLE["inherit_ids"] = f"""with k as ({_CAND}), r as (select *, row_number() over (partition by layer, topic, old_cid order by "both" / "either"::double desc, new_min, new_cid) ro, row_number() over (partition by layer, topic, new_cid order by "both" / "either"::double desc, old_cid) rn from k),
  {PG}, n as (select layer, topic, ref, case when md5(ref) < '4' then 'n-new' else 'n-' || type end cid from pg)
  select n.layer, n.topic, ref, coalesce(r.old_cid, n.cid) cid from n left join r on r.layer = n.layer and r.topic = n.topic and r.new_cid = n.cid and ro = 1 and rn = 1"""

SNAP = """sn as (select snap_id, coalesce(layer, '') layer, lower(trim(ref)) ref, arg_max({'topic': coalesce(topic, ''), 'h': regexp_replace(lower(trim(hash)), '^sha256:\\s*', '')}, (loaded_at, regexp_replace(lower(trim(hash)), '^sha256:\\s*', ''))) v
    from manifest where ref is not null group by 1, 2, 3), s7 as (select layer, v.topic, ref, v.h from sn where snap_id = (select max(snap_id) from manifest where snap_id < (select max(snap_id) from manifest))), s8 as (select layer, v.topic, ref, v.h from sn where snap_id = (select max(snap_id) from manifest)),
  df as (select layer, topic, ref, case when s7.ref is null then 'added' when s8.ref is null then 'removed' when s7.h is not distinct from s8.h then 'same' else 'changed' end change from s7 full join s8 using (layer, topic, ref))"""
SNAP = SNAP.replace("when s7.ref is null", "when s7.k is null").replace("when s8.ref is null", "when s8.k is null").replace("v.h from sn where snap_id", "v.h, 1 k from sn where snap_id")
ORACLE["manifest_diff"] = f"with {SNAP} select * from df where change <> 'same'"
ORACLE["build_counters"] = f"with {SNAP} select topic, count(*) filter (change <> 'removed') pages, count(*) filter (change = 'added') added, count(*) filter (change = 'changed') changed, count(*) filter (change = 'removed') removed from df group by 1"
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
ORACLE["reparse_set"] = f"""with {SNAP}, {PG}, p as (select layer, topic, ref, regexp_replace(lower(trim(hash)), '^sha256:\\s*', '') h from pg)
  select p.layer, p.ref from p left join s8 on s8.layer = p.layer and s8.topic = p.topic and s8.ref = p.ref where s8.ref is null or s8.h is distinct from p.h
  union select layer, ref from pg where type not in ({_IN(build.TYPES[:5])}) or len(list_filter(relations, lambda r: r.rel not in ({_IN(build.RELATIONS)}))) > 0"""


CHECKS: dict[str, str] = {}


def _check(name: str, base: str, severity: str, code: str, body: str) -> None:
    CHECKS[name] = f"select '{severity}' severity, '{code}' code from ({body})"
    ORACLE[name] = f"with {base} select '{code}' code, '{severity}' severity, target, message from ({body})"


_check("validate_broken_relations", f"{PG}, {REL}", "error", "link-broken-fm", f"select distinct ref target, rel || ' -> ' || dst message from rl where {_REF.format('dst')} and dst not in (select ref from pg)")
_check("validate_broken_links", f"{PG}, {OUTSIDE}", "warn", "link-broken-body", f"select distinct ref target, link message from bl where {_REF.format('link')} and link not in (select ref from pg)")
_check("validate_malformed_links", f"{PG}, {OUTSIDE}", "error", "ref-format", f"select distinct ref target, link message from bl where not {_REF.format('link')}")
_check("validate_undefined_relations", f"{PG}, {REL}", "error", "rel-undefined", f"select distinct ref target, rel_raw message from rl where rel_raw not in ({_IN(build.RELATIONS)})")
_check("validate_self_relations", f"{PG}, {REL}", "error", "rel-self", "select distinct ref target, rel_raw message from rl where dst = ref")
_check("validate_duplicate_relations", f"{PG}, {REL}", "warn", "rel-duplicate", "select ref target, rel_raw || ' -> ' || dst || ' #' || k message from (select ref, rel_raw, dst, unnest(generate_series(2, count(*))) k from rl group by layer, ref, rel_raw, dst)")
_check("validate_duplicate_keywords", PG, "warn", "keywords-duplicate", "select ref target, w || ' #' || k message from (select ref, w, unnest(generate_series(2, count(*))) k from (select layer, ref, unnest(keywords) w from pg) where w is not null group by layer, ref, w)")
_check("validate_types", PG, "error", "type-mismatch", f"select ref target, coalesce(type, '') message from pg where not coalesce(type in ({_IN(build.TYPES[:5])}) and type = split_part(ref, '/', 2), false)")
_check("validate_slugs", PG, "error", "slug-mismatch", "select ref target, coalesce(slug, '') message from pg where not coalesce(lower(trim(slug)) = split_part(ref, '/', 3), false)")
_check("validate_missing_fields", PG, "error", "fm-schema", "select ref target, 'title is missing' message from pg where trim(coalesce(title, '')) = '' union all select ref, 'updated is missing' from pg where updated is null")
_check("validate_body_headings", f"{PG}, {OUTSIDE}", "warn", "body-h1", "select ref target, layer message from oc where regexp_matches(fence, '(?m)^#( |$)')")
_check("validate_shadow", f"{PG}, {EDGES}, {MERGED}", "warn", "shadow", "select ref target, 'project stands for global' message from sh")
_check("validate_orphans", GRAPH, "warn", "page-orphan", "select ref target, 'no edges' message from ix where ref not in (select src_ref from me union select dst_ref from me)")
_check("validate_contradictions", GRAPH, "info", "contradicts-pair", "select distinct src_ref target, dst_ref message from me where rel = 'contradicts'")
_SUP = "select distinct m.src_ref target, m.rel || ' -> ' || m.dst_ref || ' (superseded by ' || s.f || ')' message from me m join (select dst_ref, max(src_ref) f from me where rel = 'supersedes' group by 1) s on s.dst_ref = m.dst_ref where m.src_ref <> s.f"
_check("validate_superseded", GRAPH, "info", "superseded-ref", _SUP)
_check("validate_ref_format", f"{PG}, {REL}", "error", "ref-format", f"select distinct ref target, to_raw message from rl where not {_REF.format('to_raw')}")
_check("validate_topic_empty", PG, "info", "topic-empty", "select t target, 'no pages' message from (values ('caching'), ('no-such-topic')) v(t) where t not in (select topic from pg where topic is not null)")
ORACLE["validate_all"] = f"with {GRAPH}, {SNAP}, every as ({' union all '.join(CHECKS.values())} union all select 'warn', 'derived-stale' from (select topic from df where change <> 'same' group by topic)) select severity, code, count(*) issues from every group by all"
ORACLE["validate_derived"] = f"""with {PG}, t as (select distinct topic, md5(topic) h from pg)
  select 'derived-stale' code, topic target, 'not built yet' message from t where h < '3' union all select 'derived-stale', topic, 'missing: communities' from t where h >= '3' and h < '8' union all select 'derived-stale', topic, 'built by another version' from t where h >= 'c'"""
ORACLE["validate_quick"] = f"with {PG}, {SNAP} select (select count(distinct layer) from pg) layers, (select count(*) from pg) pages, case when exists (select 1 from df where change <> 'same') then 'stale' else 'fresh' end derived"
ORACLE["validate_stale"] = f"with {SNAP} select 'derived-stale' code, topic target, count(*) || ' pages differ' message from df where change <> 'same' group by topic"
ORACLE["node_degrees"] = f"with {GRAPH} select ix.ref, coalesce(n, 0)::bigint degree from ix left join (select ref, count(*) n from (select src_ref ref from me union all select dst_ref from me) group by 1) d using (ref)"
ORACLE["body_link_list"] = f"with {PG}, {OUTSIDE} select page_id, pos::int pos, link from bl"
_LINES = "list_transform(string_split(regexp_replace(fence, '(?ms)^[ \\t]*<!--.*?(-->[^\\n]*|\\z)', '', 'g'), chr(10)), lambda l: regexp_replace(l, '^[\\s　]+|[\\s　]+$', '', 'g'))"
_RUNNING = "l <> '' and not regexp_matches(l, '^[#>|]') and not regexp_matches(l, '^([-+*]|[0-9]+[.)]) ') and not regexp_matches(l, '^((-[ \\t]*){3,}|(\\*[ \\t]*){3,}|(_[ \\t]*){3,})$')"
ORACLE["summary_extract"] = f"with {PG}, {OUTSIDE} select page_id, coalesce(substr(list_filter({_LINES}, lambda l: {_RUNNING})[1], 1, 120), '') summary from oc"
ORACLE["canonical_refs"] = f"select {_REF.format('ref')} as_stored, {_REF.format('lower(trim(ref))')} normalised, count(*) n from manifest group by 1, 2"
ORACLE["pack_collect_refs"] = f"with recursive {GRAPH}, {walk(2)} select node ref from first where node in (select ref from ix)"
SIZES = """bk as (select ref, topic, strlen('## [[' || ref || ']] — ' || coalesce(title, '') || ' (updated: ' || coalesce(updated::varchar, '') || ')' || chr(10) || chr(10)
    || case when len(coalesce(sources, [])) > 0 then '### sources' || chr(10) || chr(10) || array_to_string(list_transform(sources, lambda s: '- ' || coalesce(s.url, '') || case when coalesce(s.title, '') <> '' then ' — ' || s.title else '' end || case when s.accessed is not null then ' (accessed: ' || s.accessed::varchar || ')' else '' end), chr(10)) || chr(10) || chr(10) else '' end
    || case when regexp_replace(coalesce(body, ''), '\\s+', '', 'g') <> '' then regexp_replace(body, '^\\n+|\\n+\\z', '', 'g') || chr(10) || chr(10) else '' end)::bigint size from ix)"""
ORACLE["pack_sizes"] = f"with {PG}, {IX}, {SIZES} select ref, size from bk"
ORACLE["pack_greedy"] = f"""with recursive {GRAPH}, {walk(2)}, {SIZES}, o as (select ref, size, row_number() over (order by ref) n from bk where ref in (select node from first)),
  f as (select {sum(len(x.encode()) + 1 for x in BANNER)} + 3 + strlen('## Pages (' || count(*) || ')') + 1 + sum(strlen(ref) + 7) + strlen('{OMIT}') + 1 z from o),
  g(n, ref, size, kept, run) as (select 0::bigint, null::varchar, 0::bigint, null::boolean, z::bigint from f
    union all select o.n, o.ref, o.size, g.run + o.size <= 20000, case when g.run + o.size <= 20000 then g.run + o.size else g.run + strlen(o.ref) + 7 end from g join o on o.n = g.n + 1)
  select ref, size, kept from g where n > 0"""
ORACLE["pack_query"] = ORACLE["pack_greedy"].replace(f"{GRAPH}, {walk(2)}, {SIZES}", f"{PG}, {IX}, {scored('tokenizer reranker', True)}, {SIZES}").replace("ref in (select node from first)", "ref in (select ref from (select ref, score from sc where score > 0 order by score desc, ref limit 10))")
PROBE = "q as (select embedding::double[] e from embeddings order by vec_id limit 1), vs as (select vec_id, label, round(list_cosine_similarity(embedding::double[], (select e from q)), 6) score from embeddings)"
ORACLE["vector_topk"] = f"with {PROBE} select vec_id, score from vs order by score desc, vec_id limit 20"
ORACLE["vector_chunk_dedupe"] = f"with {PROBE}, t as (select * from vs order by score desc, vec_id limit 50) select 'vectors/chunks/page-' || label ref, max(score) score, min(vec_id) as rank from t group by label"
ORACLE["hybrid_rrf"] = f"""with {PG}, {IX}, {scored('glossary recall', False)}, {PROBE},
  l as (select ref, row_number() over (order by round_even(score, 2) desc, ref) pos from (select ref, score from sc where score > 0 order by score desc, ref limit 20)),
  v as (select p.ref, row_number() over (order by t.score desc, t.vec_id) pos from (select * from vs order by score desc, vec_id limit 20) t join pg p on p.page_id = t.vec_id)
  select ref, round(sum(1 / (60::double + pos)), 9) score from (select * from l union all select * from v) group by ref order by 2 desc, 1 limit 10"""
NEAREST = """vp as (select a.vec_id query, b.vec_id, b.label, round(list_cosine_similarity(b.embedding::double[], a.embedding::double[]), 6) score from embeddings a cross join embeddings b where a.vec_id % 100 = 0),
  vn as (select *, row_number() over (partition by query order by score desc, vec_id) n from vp)"""
ORACLE["vector_topk_batch"] = f"with {NEAREST} select query, vec_id, score from vn where n <= 20"
ORACLE["vector_chunk_dedupe_batch"] = f"with {NEAREST} select query, 'vectors/chunks/page-' || label ref, max(score) score, min(vec_id) as rank from vn where n <= 50 group by query, label"
ORACLE["hybrid_rrf_batch"] = f"""with {PG}, {IX}, {scored('glossary recall', False)}, {NEAREST},
  l as (select ref, row_number() over (order by round_even(score, 2) desc, ref) pos from (select ref, score from sc where score > 0 order by score desc, ref limit 20)),
  v as (select query, p.ref, row_number() over (partition by query order by t.score desc, t.vec_id) pos from vn t join pg p on p.page_id = t.vec_id where t.n <= 20),
  f as (select query, ref, round(sum(1 / (60::double + pos)), 9) score from (select q.query, l.* from l cross join (select distinct query from vn) q union all select * from v) group by query, ref)
  select query, ref, score from (select *, row_number() over (partition by query order by score desc, ref) k from f) where k <= 10"""
ORACLE["recall_at_k"] = f"with {PG}, {IX}, " + ", ".join(
    f"r{i} as (with {scored(t, False)} select '{k}' kind, (select count(*) from (select ref from sc where score > 0 order by score desc, ref limit 10) f where f.ref in (select ref from ix where list_contains(keywords, '{t}')))::double / nullif((select count(*) from ix where list_contains(keywords, '{t}')), 0) r)"
    for i, k, t in RECALL
) + " select kind, count(*) queries, round(avg(r), 6) recall from (" + " union all ".join(f"select * from r{i}" for i, _, _ in RECALL) + ") where r is not null group by 1"
# A body as the list of its code spans, the links named, and runs of other characters.
PIECES = r"regexp_extract_all(body, '(?ms)^ {0,3}```.*?(?:^ {0,3}```[^\n]*$|\z)|^ {0,3}~~~.*?(?:^ {0,3}~~~[^\n]*$|\z)|``[^\n]+?``|`[^`\n]+`|\[\[%s\]\]|[^\[`\n]+|.')"
MOVE = f"{PG}, {REL}, {OUTSIDE}, mv as (select dst old from rl where dst in (select ref from pg) group by 1 order by count(*) desc, 1 limit 1)"
_TO = f"'{MOVED_TO}'"
ORACLE["move_plan_counts"] = f"""with {MOVE} select layer, ref, count(*) links from (select page_id, layer, ref from (select page_id, layer, ref, unnest(relations) r from pg) where lower(trim(r.to)) = (select old from mv) union all select page_id, layer, ref from bl where link = (select old from mv)) group by page_id, layer, ref"""
ORACLE["move_relabel"] = f"""with {MOVE}, z as (select pg.*, mv.old, ref = mv.old mine from pg cross join mv)
  select page_id, layer, case when mine then {_TO} else ref end ref, case when mine then split_part({_TO}, '/', 1) else topic end topic, case when mine then split_part({_TO}, '/', 2) else type end "type", case when mine then split_part({_TO}, '/', 3) else slug end slug,
    md5(array_to_string(list_transform({PIECES % "[^\\[\\]\\n]+"}, lambda v: case when v = '[[' || old || ']]' then '[[' || {_TO} || ']]' else v end), '')) body_md5,
    array_to_string(list_transform(relations, lambda r: coalesce(r.rel, '') || '>' || coalesce(case when lower(trim(r.to)) = old then {_TO} else r.to end, '')), ' ') relations from z"""
_SWAP = "regexp_replace(lower(trim({})), '^caching/', 'cache-notes/')"
ORACLE["topic_rename"] = f"""with {PG} select page_id, case when topic = 'caching' then {_SWAP.format('ref')} else ref end ref, case when topic = 'caching' then 'cache-notes' else topic end topic,
  array_to_string(list_transform(relations, lambda r: coalesce(case when starts_with(lower(trim(r.to)), 'caching/') then {_SWAP.format('r.to')} else r.to end, '')), ' ') targets from pg"""
ORACLE["topic_rename_bodies"] = f"""with {PG}, z as (select page_id, {PIECES % "caching/[a-z0-9-]+/[a-z0-9-]+"} x from pg)
  select page_id, md5(array_to_string(list_transform(x, lambda v: case when starts_with(v, '[[caching/') then '[[cache-notes/' || substr(v, 11) else v end), '')) body_md5, coalesce(len(list_filter(x, lambda v: starts_with(v, '[[caching/'))), 0) links from z"""
ORACLE["oplog_lines"] = """with l as (select distinct on (op_id) * from oplog order by op_id, date, op, target, detail nulls first)
  select '- ' || coalesce(date::varchar, '') || ' [' || coalesce(op, '') || '] ' || coalesce(target, '') || case when coalesce(detail, '') <> '' then ' — ' || detail else '' end as value from l"""
ORACLE["oplog_counts"] = "select lower(trim(op)) op, count(distinct op_id) ops, count(distinct lower(trim(target))) targets from oplog group by 1"
_LINE = "rtrim('- [[' || ref || ']] — ' || coalesce(summary, '') || case when len(coalesce(keywords, [])) > 0 then ' | kw: ' || array_to_string(keywords, ', ') else '' end)"
ORACLE["export_index_md"] = f"with {PG}, {IX} select topic, ref, {_LINE} line from ix"
_JSON = "to_json(coalesce({}::varchar, ''))::varchar"
ORACLE["export_index_jsonl"] = f"with {PG}, {IX} select '{{' || " + " || ',' || ".join(f"'\"{c}\":' || " + _JSON.format(c) for c in ("hash", "layer", "ref", "summary", "title", "topic", "type", "updated")) + " || '}' as value from ix"
ORACLE["export_index_pages"] = f"with {PG}, {IX} select topic, 0 pos, '# index: ' || topic || ' (' || count(*) || ' pages)' line from ix group by topic union all select distinct topic, 1, '' from ix union all select topic, (row_number() over (partition by topic order by ref) + 1)::int, {_LINE} from ix"
ORACLE["adjacency_read_back"] = f"with {GRAPH} select node, dir, rel, other from adj"
ORACLE["export_graph_tsv"] = f"with {GRAPH} select distinct src_ref || chr(9) || rel || chr(9) || dst_ref || chr(9) || src as value from me"
ORACLE["export_adjacency"] = f"with {GRAPH} select node, case dir when 0 then 'out' else 'in' end dir, string_agg(rel || ' ' || other, ', ' order by rel || ' ' || other) links from adj group by 1, adj.dir"
ORACLE["star_edges"] = """with e as (select 'part_of' rel, 'region-' || n_regionkey dst from nation union all select 'part_of', 'nation-' || c_nationkey from customer union all select 'part_of', 'nation-' || s_nationkey from supplier
    union all select 'derived_from', 'customer-' || o_custkey from orders union all select 'uses', 'supplier-' || l_suppkey from (select distinct l_partkey, l_suppkey from lineitem)) select rel, dst, count(*) n from e group by 1, 2"""
ORACLE["trade_weights"] = """select least(c_nationkey, s_nationkey) a, greatest(c_nationkey, s_nationkey) b, count(*) w from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2"""
ORACLE["page_descendants"] = """with recursive l as (select lower(trim(ref)) ref, max(case when layer = 'project' then 1 else 0 end) over (partition by lower(trim(ref))) top, case when layer = 'project' then 1 else 0 end rk, relations from pages),
  p as (select distinct ref child, lower(trim(r.to)) parent from (select ref, unnest(relations) r from l where rk = top) where lower(trim(r.rel)) = 'part_of' and r.to is not null),
  ok(ref) as (select distinct parent from p where parent not in (select child from p) union all select p.child from ok join p on p.parent = ok.ref),
  t(ref, descendant, distance) as (select parent, child, 1::bigint from p where child in (select ref from ok) union all select p.parent, t.descendant, t.distance + 1 from t join p on p.child = t.ref)
  select ref, descendant, distance from t"""
