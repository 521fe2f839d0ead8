"""What changed between full snapshots: a bucketed key-to-hash index that each delivery probes and then replaces.

The index of the last delivery is a table bucketed by key.  A new delivery is
reduced to one row per key (map side first, so that repeated rows of one key
never meet in one task), shuffled once into the same buckets and joined; the
index itself is read bucket by bucket and never shuffled.  The joined rows are
written as the next version, and the version pointer moves on (swap).  The
index also tells which delivery a key's row is in, so that old values other
than the hash are fetched by an equality, and only for keys that changed.

Layout under ``home``: index/<version> (bucketed), changes/<version>,
pointer/<version>.json (put last, by rename; the greatest holds).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.refs import norm_hash, norm_ref
from quillmesh.operators import bucketed
from quillmesh.operators.incremental import _fs, read_text, write_once
from quillmesh.session import buckets, remove, workspace


class SnapshotIndex:
    """The key-to-hash index of everything delivered so far.

    keys: names of the key columns; scope: names of the columns that say which
    part of the table a delivery covers.  A part without any row in a delivery
    was not delivered: its keys stay as they are, and its next delivery is
    compared with its last one.  The first delivery of a part has no changes.

    Rows are expected as (keys, scope, h, at): ``h`` is any binary digest; a null
    digest is a value of its own; ``at`` is the id of the delivery.  Null keys
    and scopes must be replaced before (``delivery`` does so).  An empty
    delivery changes nothing.  A new object on the same home goes on after the
    last delivery that was committed.
    """

    def __init__(self, spark: SparkSession, keys: list[str], scope: list[str], home: str | None = None, n_buckets: int | None = None):
        self.spark, self.keys, self.scope = spark, keys, scope
        self.home = (home or workspace(spark, "snapshots")).rstrip("/")
        self.entries: list[dict] = []
        fs, p = _fs(spark, f"{self.home}/pointer")
        if fs.exists(p):
            names = sorted(f.getPath().getName() for f in fs.listStatus(p))
            self.entries = [json.loads(read_text(spark, f"{self.home}/pointer/{n}")) for n in names if n.endswith(".json") and n[0] != "."]
        last = self.entries[-1] if self.entries else None
        self.n = n_buckets or (last["buckets"] if last else buckets(spark))
        self.current = bucketed.open_table(spark, f"{self.home}/index/{last['version']}", last["schema"], keys, self.n) if last else None

    def changes(self, entry: dict) -> DataFrame:
        """The changes of one delivery: keys, scope, change (added, removed, changed), old_h, new_h, old_at."""
        return self.spark.read.schema(entry["changes"]).parquet(f"{self.home}/changes/{entry['version']}")

    def _commit(self, delivery: str, df: DataFrame, placed: bool, fail_at: str | None) -> DataFrame:
        """Write the next version and its changes, move the pointer, and drop the versions before the last one."""
        version = (self.entries[-1]["version"] if self.entries else 0) + 1
        index = bucketed.write(df, f"{self.home}/index/{version}", self.keys, self.n, placed)
        got = index.where("change is not null").select(*self.keys, *self.scope, "change", "old_h", F.when(F.col("change") != "removed", F.col("h")).alias("new_h"), "old_at")
        got.write.mode("overwrite").parquet(f"{self.home}/changes/{version}")
        if fail_at == "written":
            raise RuntimeError("failed before the commit")
        entry = {"delivery": delivery, "version": version, "buckets": self.n, "schema": bucketed.ddl(index), "changes": bucketed.ddl(got)}
        write_once(self.spark, f"{self.home}/pointer/{version:08d}.json", json.dumps(entry))
        self.entries.append(entry)
        self.current = index
        remove(self.spark, f"{self.home}/index/{version - 2}")
        return self.changes(entry)

    def step(self, delivery: str, new: DataFrame, fail_at: str | None = None) -> DataFrame:
        """Probe with the rows of one delivery (one row per key), swap, and give the changes.

        A delivery that was committed before is not applied again: its changes
        are given as they were.
        """
        for e in self.entries:
            if e["delivery"] == delivery:
                return self.changes(e)
        k, s = self.keys, self.scope
        new = new.select(*k, *s, "h", "at")
        if self.current is None:
            at = F.lit(None).cast(new.schema["at"].dataType)
            first = new.withColumns({"alive": F.lit(True), "change": F.lit(None).cast("string"), "old_h": F.lit(None).cast("binary"), "old_at": at})
            return self._commit(delivery, first, False, fail_at)
        index = self.current.where("alive").select(*k, *s, "h", "at")
        # The parts of this delivery and those known from before: as many rows as there are parts, not as there are keys.
        now = new.select(*[F.col(c).alias(f"_{c}") for c in s]).distinct().withColumn("_now", F.lit(True))
        known = index.select(*[F.col(c).alias(f"_{c}") for c in s]).distinct().withColumn("_known", F.lit(True))
        parts = now.join(known, [f"_{c}" for c in s], "full_outer")
        a = index.select(*k, *[F.col(c).alias(f"a_{c}") for c in s], F.col("h").alias("a_h"), F.col("at").alias("a_at"), F.lit(True).alias("a_in"))
        b = new.select(*k, *[F.col(c).alias(f"b_{c}") for c in s], F.col("h").alias("b_h"), F.col("at").alias("b_at"), F.lit(True).alias("b_in")).repartition(self.n, *k)
        j = a.join(b, k, "full_outer").withColumns({c: F.coalesce(f"b_{c}", f"a_{c}") for c in s})
        on = [F.col(c) == F.col(f"_{c}") for c in s]
        j = j.join(parts, on, "left")
        change = (
            F.when(F.col("b_in").isNull(), F.when(F.col("_now"), "removed"))
            .when(F.col("a_in").isNull(), F.when(F.col("_known"), "added"))
            .when(~F.col("a_h").eqNullSafe(F.col("b_h")), "changed")
        )
        j = j.select(
            *k, *s,
            F.when(F.col("b_in"), F.col("b_h")).otherwise(F.col("a_h")).alias("h"), F.coalesce("b_at", "a_at").alias("at"),
            (F.col("b_in").isNotNull() | F.col("_now").isNull()).alias("alive"),
            change.alias("change"),
            F.when(change.isin("changed", "removed"), F.col("a_h")).alias("old_h"), F.when(change.isin("changed", "removed"), F.col("a_at")).alias("old_at"),
        )
        return self._commit(delivery, j, True, fail_at)


def delivery(rows: DataFrame, key: dict[str, Column], scope: dict[str, Column], digest: Column, order: Column, keep: list[str] | None = None) -> DataFrame:
    """One row per key: that with the greatest ``order``; among equals the greatest digest, so that ties have one result.

    Null parts of keys and scopes become the empty string; ``keep`` names
    further columns of the holding row.  Only these expressions are read, so
    other columns of any name do no harm.
    """
    cols = {n: F.coalesce(c.cast("string"), F.lit("")) for n, c in key.items()}
    of = F.struct(order.alias("o"), digest.alias("h"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in scope.items()], *[F.col(c) for c in keep or []])
    best = rows.select(*[c.alias(n) for n, c in cols.items()], of.alias("_s")).groupBy(*key).agg(F.max("_s").alias("_s"))
    return best.select(*key, *[f"_s.{n}" for n in scope], "_s.h", *[f"_s.{c}" for c in keep or []])


def manifest_delivery(manifest: DataFrame, snap: int) -> DataFrame:
    """The rows of one snapshot of the manifest, reduced to one per page; rows without a ref name no page."""
    at = manifest.where((F.col("snap_id") == snap) & F.col("ref").isNotNull())
    return delivery(
        at, {"layer": F.col("layer"), "ref": norm_ref(F.col("ref"))}, {"topic": F.col("topic")},
        norm_hash(F.col("hash")), F.col("loaded_at"),
    )


def snapshot_changes(manifest: DataFrame, n_buckets: int | None = None, home: str | None = None) -> DataFrame:
    """Every change between consecutive snapshots of the manifest.

    Result: snap_id, layer, topic, ref, change, old_hash, new_hash (hex),
    old_snap_id (the snapshot that held the old row).  Of
    several rows of a page in one snapshot the latest ``loaded_at`` holds.  A
    null hash differs from every hash and equals null.  A null layer or topic
    is a layer or topic of its own, shown as null.  No rows: no changes.  The
    list of snapshot ids is gathered to the driver; it is as long as there are
    deliveries.
    """
    spark = manifest.sparkSession
    ids = [r[0] for r in manifest.select("snap_id").where("snap_id is not null").distinct().orderBy("snap_id").collect()]
    index = SnapshotIndex(spark, ["layer", "ref"], ["scope"], home, n_buckets)
    out = None
    for snap in ids:
        rows = manifest_delivery(manifest, snap).withColumn("scope", F.concat_ws("\u0001", "layer", "topic")).withColumn("at", F.lit(snap).cast("int"))
        got = index.step(str(snap), rows).withColumn("snap_id", F.lit(snap).cast("int"))
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], "layer string, ref string, scope string, change string, old_h binary, new_h binary, old_at int, snap_id int")
    return out.select(
        "snap_id", F.nullif("layer", F.lit("")).alias("layer"),
        F.nullif(F.element_at(F.split("scope", "\u0001"), 2), F.lit("")).alias("topic"),
        "ref", "change", F.lower(F.hex("old_h")).alias("old_hash"), F.lower(F.hex("new_h")).alias("new_hash"), F.col("old_at").alias("old_snap_id"),
    )


def old_rows(changes: DataFrame, manifest: DataFrame) -> DataFrame:
    """The changes with old_loaded_at: of changed and removed pages only, their rows of the snapshot that the index names are fetched."""
    want = changes.where("change <> 'added'").select("snap_id", "layer", "ref", "old_snap_id")
    m = manifest.select(F.col("snap_id").alias("s"), F.col("layer").alias("l"), norm_ref(F.col("ref")).alias("r"), "loaded_at")
    got = (
        want.join(m, F.col("layer").eqNullSafe(F.col("l")) & (F.col("ref") == F.col("r")) & (F.col("s") == F.col("old_snap_id")))
        .groupBy("snap_id", "layer", "ref").agg(F.max("loaded_at").alias("old_loaded_at"))
        .select(F.col("snap_id").alias("s2"), F.col("layer").alias("l2"), F.col("ref").alias("r2"), "old_loaded_at")
    )
    return changes.join(got, (F.col("snap_id") == F.col("s2")) & F.col("layer").eqNullSafe(F.col("l2")) & (F.col("ref") == F.col("r2")), "left").drop("s2", "l2", "r2")
