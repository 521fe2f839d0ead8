"""References to records that do not exist: keyed state of pending orphans, carried from period to period.

References to one target share its fate, so the state is keyed by target: when
its record first came, whether it is there now, whether it was ever deleted,
and how many references wait for it, by field.  A period brings new
references, arrivals and deletions.  They are reduced to one row a target (map
side first, so a target named by a third of all rows costs no more than
another), meet the state in the buckets where it lies, and the targets they
touch are written as the next piece of state: new references probe the index,
arrivals resolve what waits, deletions reopen it.  Each piece tells what it
opened and closed, which gives the counts of every period without reading the
rest.  The references themselves stay in their table and are looked up at the
end, against the targets that may leave any open or late.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions.refs import REF_RE, norm_ref
from quillmesh.functions.text import body_links
from quillmesh.operators import bucketed
from quillmesh.operators.incremental import _fs, read_text, write_once
from quillmesh.session import buckets, workspace

REF_SCHEMA = "page_id long, field string, target string, named_at timestamp"
FIELDS = ("relations", "body")
#: Pieces of state after which they are written anew as one.
COMPACT_EVERY = 8
#: Parts into which the references of one target are split when they are looked up.
SPLITS = 16


def body_targets(body: Column) -> Column:
    """The refs named by double-bracket links outside code, normalised, in order, each once."""
    got = F.transform(body_links(body), lambda x: norm_ref(F.regexp_extract(x, r"^[^|#]*", 0)))
    return F.array_distinct(F.filter(got, lambda x: x.rlike(REF_RE)))


def first_seen(pages: DataFrame) -> DataFrame:
    """page_id, named_at: when each page came in, its earliest ingested_at."""
    return pages.groupBy("page_id").agg(F.min("ingested_at").alias("named_at"))


def page_references(pages: DataFrame) -> DataFrame:
    """Distinct references (page_id, field, target, named_at) of relations and of body links.

    Null targets, null pages and pages that never came in (no ingested_at at
    all) name nothing.
    """
    r = pages.select("page_id", "relations", "body").where("page_id is not null")
    rel = r.select("page_id", F.lit("relations").alias("field"), F.explode(F.filter("relations", lambda x: x["to"].isNotNull())).alias("x")).select("page_id", "field", norm_ref(F.col("x.to")).alias("target"))
    body = r.where("body like '%[[%'").select("page_id", F.lit("body").alias("field"), F.explode(body_targets(F.col("body"))).alias("target"))
    return rel.unionByName(body).distinct().join(first_seen(pages), "page_id").where("named_at is not null")


class OrphanState:
    """State of the targets after each period, kept in ``home``; a new object on the same home goes on after the last period.

    Layout under home: targets/<seq> (what the period touched), base/<seq>
    (compacted), periods/<seq>.json (put last, by rename: a period without it
    does not exist, and a retry overwrites what it left).
    """

    def __init__(self, spark: SparkSession, home: str | None = None, fields: tuple[str, ...] = FIELDS, n_buckets: int | None = None):
        self.spark = spark
        self.home = (home or workspace(spark, "orphans")).rstrip("/")
        self.periods: list[dict] = []
        self._tables: dict[str, DataFrame] = {}
        fs, p = _fs(spark, f"{self.home}/periods")
        if fs.exists(p):
            names = sorted(f.getPath().getName() for f in fs.listStatus(p))
            self.periods = [json.loads(read_text(spark, f"{self.home}/periods/{n}")) for n in names if n.endswith(".json") and n[0] != "."]
        last = self.periods[-1] if self.periods else None
        self.n = n_buckets or (last["buckets"] if last else buckets(spark))
        self.fields = tuple(last["fields"]) if last else fields

    def _table(self, at: str, schema: str) -> DataFrame:
        if at not in self._tables:
            self._tables[at] = bucketed.open_table(self.spark, f"{self.home}/{at}", schema, ["target"], self.n)
        return self._tables[at]

    def _row(self) -> Column:
        """The state of a target; the later row is the greater."""
        return F.struct("seq", "first_at", "alive", "lost", "named_at", *[f"n_{f}" for f in self.fields])

    def _pieces(self) -> list[tuple[str, str]]:
        """Where the state is, and its schema: the last base and the periods after it."""
        base = max((p for p in self.periods if p["base"]), key=lambda p: p["seq"], default=None)
        return ([(base["base"], base["schema"])] if base else []) + [(f"targets/{p['seq']}", p["schema"]) for p in self.periods if not base or p["seq"] > base["seq"]]

    def targets(self) -> DataFrame:
        """target and its state, one row each."""
        pieces = self._pieces()
        if not pieces:
            return self.spark.createDataFrame([], "target string, first_at timestamp, alive boolean, lost boolean, named_at timestamp")
        rows = bucketed.plain(self.spark, [f"{self.home}/{at}" for at, _ in pieces], pieces[-1][1])
        return rows.groupBy("target").agg(F.max(self._row()).alias("r")).select("target", "r.*")

    def step(self, period: str, refs: DataFrame, events: DataFrame, fail_at: str | None = None) -> None:
        """One period: refs (field, target, named_at, any others), events (target, at, dead: deleted, or else arrived).

        A target is there if its last event is an arrival; at equal times a
        deletion comes last.  An event without a time is the earliest of its
        period.  A period that was committed before is passed over.
        """
        if any(p["period"] == period for p in self.periods):
            return
        at = F.coalesce("at", F.lit("0001-01-01").cast("timestamp"))
        arrived, died = F.when(~F.col("dead"), at), F.when(F.col("dead"), at)
        nul = lambda t: F.lit(None).cast(t)
        # One reduction for both inputs: references count by field, events give times.
        rows = refs.select("target", nul("timestamp").alias("first_at"), nul("timestamp").alias("last_at"), nul("timestamp").alias("dead_at"), "named_at", *[(F.col("field") == f).cast("long").alias(f"n_{f}") for f in self.fields])
        rows = rows.unionByName(events.select("target", arrived.alias("first_at"), arrived.alias("last_at"), died.alias("dead_at"), nul("timestamp").alias("named_at"), *[F.lit(0).cast("long").alias(f"n_{f}") for f in self.fields]))
        new = rows.where("target is not null").groupBy("target").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("dead_at").alias("dead_at"), F.min("named_at").alias("named_at"), *[F.sum(f"n_{f}").alias(f"n_{f}") for f in self.fields])
        new = new.select("target", F.struct("first_at", "last_at", "dead_at", "named_at", *[f"n_{f}" for f in self.fields]).alias("_new")).repartition(self.n, "target")
        old_type = "struct<seq:int,first_at:timestamp,alive:boolean,lost:boolean,named_at:timestamp," + ",".join(f"n_{f}:bigint" for f in self.fields) + ">"
        both = new.withColumn("_old", F.lit(None).cast(old_type))
        if self.periods:
            both = bucketed.versions(both, [self._table(*x) for x in self._pieces()], ["target"], self._row(), "_old", {"_new": F.lit(None).cast(new.schema["_new"].dataType)})
        j = both.groupBy("target").agg(F.max("_new").alias("_new"), F.max("_old").alias("_old")).where("_new is not null")
        z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        had = F.coalesce("_old.alive", F.lit(False))
        alive = F.when(F.col("_new.dead_at").isNull(), F.col("_new.last_at").isNotNull() | had).otherwise(F.coalesce(F.col("_new.last_at") > F.col("_new.dead_at"), F.lit(False)))
        lost = F.coalesce("_old.lost", F.lit(False)) | F.col("_new.dead_at").isNotNull()
        seq = (self.periods[-1]["seq"] if self.periods else 0) + 1
        out = j.select(
            "target", F.lit(seq).alias("seq"), F.least("_old.first_at", "_new.first_at").alias("first_at"), alive.alias("alive"), lost.alias("lost"),
            F.least("_old.named_at", "_new.named_at").alias("named_at"), *[(z(F.col(f"_old.n_{f}")) + F.col(f"_new.n_{f}")).alias(f"n_{f}") for f in self.fields],
            F.coalesce("_old.lost", F.lit(False)).alias("was_lost"), *[F.when(had, 0).otherwise(z(F.col(f"_old.n_{f}"))).cast("long").alias(f"open_{f}") for f in self.fields],
        )
        table = bucketed.write(out, f"{self.home}/targets/{seq}", ["target"], self.n, placed=True)
        if fail_at == "written":
            raise RuntimeError("failed before the commit")
        entry = {"period": period, "seq": seq, "buckets": self.n, "fields": self.fields, "schema": bucketed.ddl(table), "base": None}
        self._tables[f"targets/{seq}"] = table
        if seq % COMPACT_EVERY == 0:
            self.periods.append(entry)
            every = self.targets().withColumns({"was_lost": F.lit(False), **{f"open_{f}": F.lit(0).cast("long") for f in self.fields}})
            self.periods.pop()
            entry["base"] = f"base/{seq}"
            self._tables[entry["base"]] = bucketed.write(every.select(*table.columns), f"{self.home}/{entry['base']}", ["target"], self.n)
        write_once(self.spark, f"{self.home}/periods/{seq:06d}.json", json.dumps(entry))
        self.periods.append(entry)

    def counts(self) -> DataFrame:
        """period, field, lost, refs: references open at the end of each period, from what each period opened and closed."""
        none = "period string, field string, lost boolean, refs long"
        if not self.periods:
            return self.spark.createDataFrame([], none)
        change = None
        for p in self.periods:
            t = self._table(f"targets/{p['seq']}", p["schema"])
            each = F.explode(F.array(*[
                F.struct(F.lit(f).alias("field"), l.alias("lost"), n.alias("n"))
                for f in self.fields
                for l, n in ((F.col("was_lost"), -F.col(f"open_{f}")), (F.col("lost"), F.when(F.col("alive"), 0).otherwise(F.col(f"n_{f}"))))
            ]))
            d = t.select(each.alias("x")).groupBy("x.field", "x.lost").agg(F.sum("x.n").alias("n")).withColumn("seq", F.lit(p["seq"]))
            change = d if change is None else change.unionByName(d)
        names = self.spark.createDataFrame([(p["seq"], p["period"]) for p in self.periods], "seq int, period string")
        kinds = self.spark.createDataFrame([(f, l) for f in self.fields for l in (False, True)], "field string, lost boolean")
        # As many rows as periods, fields and two.
        grid = names.crossJoin(F.broadcast(kinds)).join(change, ["seq", "field", "lost"], "left")
        run = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("field", "lost").orderBy("seq"))
        return grid.select("period", "field", "lost", run.cast("long").alias("refs"))

    def orphans(self, refs: DataFrame) -> DataFrame:
        """The columns of refs and reason of every reference that is open (deleted, missing), or whose target came after it (late).

        Only targets with such references are looked up, each in SPLITS
        copies, so that the references of one target are spread.
        """
        t = self.targets().where("not alive or first_at > named_at").select("target", "first_at", "alive", "lost").withColumn("_split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
        cols = refs.columns
        r = refs.withColumn("_split", F.pmod(F.xxhash64(*[c for c in cols if c != "target"]), F.lit(SPLITS)).cast("int"))
        reason = F.when(~F.col("alive"), F.when(F.col("lost"), "deleted").otherwise("missing")).when(F.col("first_at") > F.col("named_at"), "late")
        return r.join(t, ["target", "_split"]).select(*cols, reason.alias("reason")).where("reason is not null")


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def _monthly(df: DataFrame, name: str) -> DataFrame:
    """df written once, one folder a month (column m)."""
    at = workspace(df.sparkSession, name)
    df.write.partitionBy("m").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def orphan_references(pages: DataFrame, oplog: DataFrame, home: str | None = None) -> tuple[DataFrame, OrphanState]:
    """page_id, field, target, reason, month of every reference whose page is missing, lost or came in later; and the state.

    Periods are the months in which pages came in or were deleted.  late: the
    target has a page in some layer that came in after the naming page;
    deleted: it has none, and the log has a delete or move of it; missing:
    neither.  A deletion reopens the references to its target.  The log does
    not tell when a deleted page came back; that it is among the pages says
    that it did, so the last period ends with its return.  References repeated
    in one field count once.  Empty tables give no rows.  The months are
    gathered to the driver.
    """
    refs = _monthly(page_references(pages).withColumn("m", month(F.col("named_at"))), "refs")
    came = pages.where("ref is not null and ingested_at is not null").groupBy(norm_ref(F.col("ref")).alias("target")).agg(F.min("ingested_at").alias("at"))
    gone = oplog.where(F.lower(F.trim("op")).isin("delete", "move") & F.col("target").isNotNull()).select(norm_ref(F.col("target")).alias("target"), F.col("date").cast("timestamp").alias("at")).distinct()
    events = came.withColumn("dead", F.lit(False)).unionByName(gone.withColumn("dead", F.lit(True)))
    events = _monthly(events.withColumn("m", F.coalesce(month(F.col("at")), F.lit("0000-00"))), "events")
    months = sorted({r[0] for r in refs.select("m").union(events.select("m")).distinct().collect()})
    state = OrphanState(pages.sparkSession, home)
    for i, m in enumerate(months):
        ev = events.where(F.col("m") == m).drop("m")
        if i == len(months) - 1:
            back = events.groupBy("target").agg(F.max(F.when(F.col("dead"), F.coalesce("at", F.lit("0001-01-01").cast("timestamp")))).alias("d"), F.min(F.when(~F.col("dead"), F.col("at"))).alias("a"))
            ev = ev.unionByName(back.where("a is not null and d is not null").select("target", (F.greatest("a", "d") + F.expr("interval 1 second")).alias("at"), F.lit(False).alias("dead")))
        state.step(m, refs.where(F.col("m") == m).drop("m"), ev)
    out = state.orphans(refs.drop("m"))
    return out.select("page_id", "field", "target", "reason", month(F.col("named_at")).alias("month")), state


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts by table, field, reason and month of the naming page."""
    return orphans.groupBy(F.lit("pages").alias("table_name"), "field", "reason", "month").agg(F.count("*").alias("refs"), F.countDistinct("target").alias("targets"))
