"""Queries of the general data problems 2, 3, 4 and 5, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import hierarchy, incremental, orphans, snapshots
from quillmesh.session import written


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(_t(spark, d, "manifest")).select("snap_id", "layer", "ref", "change")


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "manifest")
    return snapshots.old_rows(written(snapshots.snapshot_changes(m), "changes"), m)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.page_hierarchy(_t(spark, d, "pages"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.page_paths(_t(spark, d, "pages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.feed_runs(_t(spark, d, "page_feed"), _t(spark, d, "build_runs")).select("run_id", "layer", "ref")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(_t(spark, d, "pages"), _t(spark, d, "oplog"))[0].select("page_id", "field", "target", "reason")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphan_references(_t(spark, d, "pages"), _t(spark, d, "oplog"))[0])


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    """References open at the end of each month, from the periodic counts of the state."""
    return orphans.orphan_references(_t(spark, d, "pages"), _t(spark, d, "oplog"))[1].counts()


def p3_levels(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy with 200 links a task, so that links of other tasks are merged over several levels at any size."""
    return hierarchy.page_hierarchy(_t(spark, d, "pages"), 200)


def p3_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Of pages with several parents the links beside the least one."""
    return hierarchy.page_conflicts(_t(spark, d, "pages"))


QUERIES = {f.__name__: f for f in (p2_found, p2_changes, p3_found, p3_paths, p3_levels, p3_conflicts, p4_found, p5_found, p5_report, p5_periods)}

_SNAP = """
d as (select snap_id, coalesce(layer, '') layer, coalesce(topic, '') topic, lower(trim(ref)) ref,
        arg_max(regexp_replace(lower(trim(hash)), '^sha256:\\s*', ''), (loaded_at, regexp_replace(lower(trim(hash)), '^sha256:\\s*', ''))) h, max(loaded_at) loaded_at
      from manifest where snap_id is not null and ref is not null group by all),
g as (select layer, topic, snap_id, lag(snap_id) over (partition by layer, topic order by snap_id) prev
      from (select distinct layer, topic, snap_id from d)),
g2 as (select * from g where prev is not null),
c as (select g2.snap_id, g2.layer, g2.topic, d.ref, case when o.ref is null then 'added' else 'changed' end change, o.h old_h, d.h new_h, o.snap_id old_snap_id, o.loaded_at old_loaded_at
      from g2 join d on d.layer = g2.layer and d.topic = g2.topic and d.snap_id = g2.snap_id
      left join d o on o.layer = g2.layer and o.topic = g2.topic and o.snap_id = g2.prev and o.ref = d.ref
      where o.ref is null or o.h is distinct from d.h
      union all
      select g2.snap_id, g2.layer, g2.topic, o.ref, 'removed', o.h, null, o.snap_id, o.loaded_at
      from g2 join d o on o.layer = g2.layer and o.topic = g2.topic and o.snap_id = g2.prev
      left join d on d.layer = g2.layer and d.topic = g2.topic and d.snap_id = g2.snap_id and d.ref = o.ref
      where d.ref is null)
"""

_TREE = """
l as (select lower(trim(ref)) ref, max(case when layer = 'project' then 1 else 0 end) over (partition by lower(trim(ref))) top,
        case when layer = 'project' then 1 else 0 end rk, relations from pages),
p as (select distinct ref child, lower(trim(r.to)) parent from (select ref, unnest(relations) r from l where rk = top) where lower(trim(r.rel)) = 'part_of' and r.to is not null),
roots as (select distinct parent ref from p where parent not in (select child from p)),
t(ref, root_ref, depth, path) as (select ref, ref, 0, ref from roots union all
      select p.child, t.root_ref, t.depth + 1, t.path || ' > ' || p.child from t join p on p.parent = t.ref)
"""

_ORPHANS = """
m as (select page_id, min(ingested_at) named_at from pages group by 1),
f as (select lower(trim(ref)) target, min(ingested_at) first_at from pages where ref is not null group by 1),
b as (select page_id, regexp_replace(regexp_replace(regexp_replace(replace(body, chr(13) || chr(10), chr(10)),
        '(?ms)(^ {0,3}```.*?(^ {0,3}```[^\\n]*$|\\z))|(^ {0,3}~~~.*?(^ {0,3}~~~[^\\n]*$|\\z))', '', 'g'),
        '``[^\\n]+?``', ' ', 'g'), '`[^`\\n]+`', ' ', 'g') t from pages),
r as (select page_id, 'relations' field, lower(trim(x.to)) target from (select page_id, unnest(relations) x from pages) where x.to is not null
      union select page_id, 'body', lower(trim(regexp_extract(x, '^[^|#]*'))) from (select page_id, unnest(regexp_extract_all(t, '\\[\\[([^\\[\\]\\n]+)\\]\\]', 1)) x from b)
      where regexp_full_match(lower(trim(regexp_extract(x, '^[^|#]*'))), '[a-z0-9-]+/[a-z0-9-]+/[a-z0-9-]+')),
g as (select distinct lower(trim(target)) target from oplog where lower(trim(op)) in ('delete', 'move')),
o as (select r.page_id, r.field, r.target, case when f.target is not null then 'late' when g.target is not null then 'deleted' else 'missing' end reason, strftime(m.named_at, '%Y-%m') as month
      from r join m using (page_id) left join f using (target) left join g using (target) where f.target is null or f.first_at > m.named_at)
"""

ORACLE = {
    "p2_found": f"with {_SNAP} select snap_id, layer, ref, change from c",
    "p2_changes": f"with {_SNAP} select snap_id, layer, topic, ref, change, old_h old_hash, new_h new_hash, old_snap_id, old_loaded_at from c",
    "p3_found": f"with recursive {_TREE} select ref, root_ref, depth from t union all select child, 'cycle', -1 from p where child not in (select ref from t)",
    "p3_conflicts": f"with recursive {_TREE.replace('roots as', 'low as (select child, min(parent) m from p group by 1), roots as')} select p.child ref, low.m parent, p.parent other from p join low using (child) where p.parent <> low.m",
    "p3_levels": f"with recursive {_TREE} select ref, root_ref, depth from t union all select child, 'cycle', -1 from p where child not in (select ref from t)",
    "p3_paths": f"""with recursive {_TREE}, n as (select a.ref, count(*) - 1 n from t a join t b on b.path = a.path or starts_with(b.path, a.path || ' > ') group by 1)
      select ref, root_ref, depth, path, n n_descendants from t join n using (ref)
      union all select child, 'cycle', -1, null, 0 from p where child not in (select ref from t)""",
    "p4_found": """with r as (select run_id, min(started_at) s from build_runs where lower(trim(status)) = 'ok' group by 1),
      f as (select distinct coalesce(layer, '') layer, lower(trim(ref)) ref, regexp_replace(lower(trim(hash)), '^sha256:\\s*', '') h, arrived_at, feed_id from page_feed where hash is not null and ref is not null),
      w as (select f.*, (select min(s) from r where r.s >= f.arrived_at) s from f),
      st as (select s, layer, ref, arg_max(h, (arrived_at, feed_id)) h from w where s is not null group by 1, 2, 3),
      c as (select *, lag(h) over (partition by layer, ref order by s) was from st)
      select r.run_id, c.layer, c.ref from c join r on r.s = c.s where was is distinct from h""",
    "p5_found": f"with {_ORPHANS} select page_id, field, target, reason from o",
    "p5_periods": f"""with {_ORPHANS},
      ev as (select target, first_at tt, false dead from f union all select distinct lower(trim(target)), date::timestamp, true from oplog where lower(trim(op)) in ('delete', 'move') and target is not null),
      em as (select *, coalesce(strftime(tt, '%Y-%m'), '0000-00') mo from ev), rm as (select r.*, strftime(m.named_at, '%Y-%m') mo from r join m using (page_id) where m.named_at is not null),
      ms as (select mo from em union select mo from rm), tm as (select distinct target from rm),
      st as (select ms.mo period, tm.target, arg_max(dead, (coalesce(tt, timestamp '0001-01-01'), dead)) dead, bool_or(dead) lost, count(*) filter (not dead) came from ms cross join tm join em on em.target = tm.target and em.mo <= ms.mo group by 1, 2),
      o2 as (select ms.mo period, rm.field, coalesce(st.lost, false) lost, case when st.dead is null or (st.dead and not (ms.mo = (select max(mo) from ms) and st.came > 0)) then 1 else 0 end n
             from ms join rm on rm.mo <= ms.mo left join st on st.period = ms.mo and st.target = rm.target)
      select ms.mo period, f.field, l.lost, coalesce(sum(n), 0)::bigint refs from ms cross join (values ('relations'), ('body')) f(field) cross join (values (false), (true)) l(lost) left join o2 on o2.period = ms.mo and o2.field = f.field and o2.lost = l.lost group by all""",
    "p5_report": f"with {_ORPHANS} select 'pages' table_name, field, reason, month, count(*) refs, count(distinct target) targets from o group by all",
}
