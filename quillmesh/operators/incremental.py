"""Processing only new or changed records: a manifest of processed input files, anti-joined with each listing.

A run lists the input folder with Spark, anti-joins the listing with the
manifest of committed batches by path and size, and stages the rows of what is
left in one pass that also yields a checksum of each file's content; a file
whose size and checksum the manifest has under another name is no news.  The
staged rows are reduced to one state per key and compared with the committed
state, which is bucketed by key and never shuffled.  The batch is written to a
folder named by the batch identifier that a retry overwrites, its files go to
the manifest, and last its commit entry is put there, as one rename.  Without
its entry a batch does not exist: a run that fails at any point leaves nothing
behind that a later run would skip or repeat.

Layout under ``home``: batches/<id> (key, state, order columns, changed),
base/<id> (compacted state), files/<id> (path, size, checksum of the input
files), manifest/<seq>-<id>.json (one per committed batch).
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.refs import norm_hash, norm_ref
from quillmesh.operators import bucketed
from quillmesh.session import buckets, remove, workspace

#: Committed batches after which the state and the list of files are written anew as one table.
COMPACT_EVERY = 8
FILES = "path string, size long, checksum string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def listing(spark: SparkSession, path: str, suffix: str = ".parquet") -> DataFrame:
    """path, uri, size of every data file below path; names that begin with a dot or underscore are left out.

    Spark lists, in parallel where there are many folders, and reads no
    content.  ``uri`` is the path as a scan of the file reports it, so that
    rows and listing meet whatever signs a name holds.
    """
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], "path string, uri string, size long")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(literal(path))
    return d.select("path", d.metadataColumn("_metadata")["file_path"].alias("uri"), F.col("length").alias("size"))


def literal(path: str) -> str:
    """A path whose signs are not taken for a pattern of names."""
    return "".join("\\" + c if c in "[]{}*?\\" else c for c in path)


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and rename it over the target: a reader sees the old or the new text, whole."""
    jvm = spark._jvm
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    tmp = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.tmp")
    o = fs.create(tmp, True)
    o.write(bytearray(text.encode()))
    o.close()
    ctx = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    ctx.rename(fs.makeQualified(tmp), fs.makeQualified(p), over)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    i = fs.open(p)
    try:
        return bytes(i.readAllBytes()).decode()
    finally:
        i.close()


@dataclass
class Entry:
    """One committed batch; ``base`` and ``files_base`` name the compacted tables that hold it and all before it."""

    batch: str
    seq: int
    schema: str
    buckets: int
    base: str | None = None
    files_base: str | None = None


class IncrementalRun:
    """State of one incremental job, kept in ``home``; a new object on the same home goes on where the last commit was.

    keys: key columns; value: the column whose change counts; order: columns
    that order the versions of one key.  Rows must come with exactly these
    columns; ``prepare`` makes them from the rows of the input files.  Keys
    must not be null.  One run at a time.
    """

    def __init__(self, spark: SparkSession, source: str, home: str, keys: list[str], value: str, order: list[str], prepare=lambda d: d, n_buckets: int | None = None):
        self.spark, self.source, self.home = spark, source.rstrip("/"), home.rstrip("/")
        self.keys, self.value, self.order, self.prepare = keys, value, order, prepare
        self._n = n_buckets
        self._entries: dict[str, Entry] = {}
        self._tables: dict[str, DataFrame] = {}

    def entries(self) -> list[Entry]:
        """Committed batches in order.  An entry never changes once it is there, so each is read once."""
        fs, p = _fs(self.spark, f"{self.home}/manifest")
        if not fs.exists(p):
            return []
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            if name.endswith(".json") and name[0] != "." and name not in self._entries:
                self._entries[name] = Entry(**json.loads(read_text(self.spark, f.getPath().toString())))
        return sorted(self._entries.values(), key=lambda e: e.seq)

    def _table(self, at: str, e: Entry) -> DataFrame:
        """A committed table of state, opened once."""
        if at not in self._tables:
            schema = e.schema if at.startswith("batches/") else ", ".join(c for c in e.schema.split(", ") if not c.startswith("`changed`"))
            self._tables[at] = bucketed.open_table(self.spark, f"{self.home}/{at}", schema, self.keys, e.buckets)
        return self._tables[at]

    def manifest(self, entries: list[Entry]) -> DataFrame:
        """path, size, checksum of all files of committed batches."""
        base = max((e for e in entries if e.files_base), key=lambda e: e.seq, default=None)
        at = [f"{self.home}/{base.files_base}"] if base else []
        at += [f"{self.home}/files/{e.batch}" for e in entries if not base or e.seq > base.seq]
        return self.spark.read.schema(FILES).json(at) if at else self.spark.createDataFrame([], FILES)

    def _parts(self, entries: list[Entry]) -> list[tuple[str, Entry]]:
        """Where the committed state is: the last base and the batches after it."""
        base = max((e for e in entries if e.base), key=lambda e: e.seq, default=None)
        return ([(base.base, base)] if base else []) + [(f"batches/{e.batch}", e) for e in entries if not base or e.seq > base.seq]

    def state(self, entries: list[Entry]) -> list[DataFrame]:
        """The parts of the committed state, each bucketed by key."""
        return [self._table(at, e).select(*self.keys, self.value, *self.order) for at, e in self._parts(entries)]

    def latest(self, entries: list[Entry] | None = None) -> DataFrame:
        """The committed state, one row a key."""
        entries = self.entries() if entries is None else entries
        if not entries:
            raise LookupError("nothing was committed yet")
        schema = ", ".join(c for c in entries[-1].schema.split(", ") if not c.startswith("`changed`"))
        rows = bucketed.plain(self.spark, [f"{self.home}/{at}" for at, _ in self._parts(entries)], schema)
        one = rows.groupBy(*self.keys).agg(F.max(self._version()).alias("_s"))
        return one.select(*self.keys, *[F.col(f"_s.{c}").alias(c) for c in (self.value, *self.order)])

    def _version(self) -> F.Column:
        return F.struct(*self.order, self.value)

    def _stage(self, paths: list[str], batch: str) -> DataFrame:
        """One pass over the new files: their prepared rows, where each comes from, and the hash of the whole row.

        The schema is that of all files of the batch together, so a column
        that only a later file has is read, and counts in the checksum.
        """
        d = self.spark.read.option("basePath", self.source).option("mergeSchema", "true").parquet(*map(literal, paths))
        every = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(d.columns)])
        marked = self.prepare(d.withColumns({"_uri": d.metadataColumn("_metadata")["file_path"], "_hash": every}))
        at = f"{self.home}/staged/{batch}"
        marked.select(*self.keys, self.value, *self.order, "_uri", "_hash").write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def run(self, batch: str, want: F.Column | None = None, fail_at: str | None = None) -> DataFrame | None:
        """Process what is new under the identifier ``batch`` and commit; the rows of the batch, or None if there is no news.

        Result: keys, value, order columns, changed (whether the state of the
        key differs from its committed state, or it had none).  A batch that
        was committed before is returned as it is, not processed again.
        ``want`` is a condition on the column path of the listing.  The paths
        of the new files reach the driver, as every scan's do.  ``fail_at``
        (staged, written, listed or committing) raises there, for tests.
        """
        def stop(where: str) -> None:
            if fail_at == where:
                raise RuntimeError(f"failed where asked to: {where}")

        entries = self.entries()
        at = f"batches/{batch}"
        for e in entries:
            if e.batch == batch:
                return self._table(at, e)
        known = self.manifest(entries)
        there = listing(self.spark, self.source)
        there = there if want is None else there.where(want)
        fresh = sorted(there.join(known.select("path", "size"), ["path", "size"], "left_anti").collect())
        if not fresh:
            return None
        n = self._n or (entries[-1].buckets if entries else buckets(self.spark))
        pool = ThreadPoolExecutor(1)
        # Content is compared only where a size came before; that is asked while the files are read.
        same = pool.submit(self._sizes, fresh, known)
        staged = self._stage([r["path"] for r in fresh], batch)
        stop("staged")
        sums = pool.submit(self._checksums, staged, fresh)
        twice = self._copies(fresh, sums.result(), known) if same.result() else []
        rows = staged.where(~F.col("_uri").isin(twice)) if twice else staged
        # One aggregate over the state, which lies in its buckets, and the new rows, the only ones that move.
        v = rows.groupBy(*self.keys).agg(F.max(self._version()).alias("_new")).repartition(n, *self.keys)
        none = F.lit(None).cast(v.schema["_new"].dataType)
        both = v.withColumn("_old", none)
        if entries:
            both = bucketed.versions(both, self.state(entries), self.keys, self._version(), "_old", {"_new": none})
        one = both.groupBy(*self.keys).agg(F.max("_new").alias("_new"), F.max("_old").alias("_old")).where("_new is not null")
        # A version older than the committed one, delivered late, changes nothing.
        late = F.coalesce(F.struct(*[f"_old.{c}" for c in self.order]) > F.struct(*[f"_new.{c}" for c in self.order]), F.lit(False))
        holds = F.when(late, F.col("_old")).otherwise(F.col("_new"))
        changed = F.col("_old").isNull() | (~late & ~F.col(f"_old.{self.value}").eqNullSafe(F.col(f"_new.{self.value}")))
        out = one.select(*self.keys, *[holds[c].alias(c) for c in (self.value, *self.order)], changed.alias("changed"))
        table = bucketed.write(out, f"{self.home}/{at}", self.keys, n, placed=True)
        stop("written")
        got = sums.result()
        pool.shutdown()
        lines = [json.dumps({"path": r["path"], "size": r["size"], "checksum": got.get(r["uri"])}, ensure_ascii=False) for r in fresh]
        write_once(self.spark, f"{self.home}/files/{batch}/files.json", "\n".join(lines))
        stop("listed")
        seq = max((e.seq for e in entries), default=0) + 1
        entry = Entry(batch, seq, bucketed.ddl(table), n)
        self._tables[at] = table
        if seq % COMPACT_EVERY == 0:
            s = self.latest([*entries, entry])
            entry.base, entry.files_base = f"base/{batch}", f"files/base-{batch}"
            self._tables[entry.base] = bucketed.write(s, f"{self.home}/{entry.base}", self.keys, n)
            self.manifest([*entries, Entry(batch, seq, "", n)]).coalesce(1).write.mode("overwrite").json(f"{self.home}/{entry.files_base}")
        stop("committing")
        write_once(self.spark, f"{self.home}/manifest/{seq:08d}-{batch}.json", json.dumps(asdict(entry)))
        remove(self.spark, f"{self.home}/staged/{batch}")
        return table

    def _checksums(self, staged: DataFrame, fresh: list) -> dict[str, str]:
        """By uri the checksum of each file: number of rows, sum of their hashes and the greatest; one row a new file reaches the driver.

        Files without rows have none: they are never compared.  Rows of a
        file that the listing does not have are an error, as its name would
        be lost.
        """
        h = F.col("_hash")
        got = staged.groupBy("_uri").agg(F.concat_ws(":", F.count("*"), F.sum(h.cast("decimal(38,0)")).cast("string"), F.max(h)).alias("s")).collect()
        lost = {r["_uri"] for r in got} - {r["uri"] for r in fresh}
        if lost:
            raise RuntimeError(f"rows of files that the listing does not have: {sorted(lost)[:10]}")
        return {r["_uri"]: r["s"] for r in got}

    def _sizes(self, fresh: list, known: DataFrame) -> bool:
        """Whether any new file has the size of another or of a committed one."""
        sizes = {r["size"] for r in fresh}
        if len(sizes) < len(fresh):
            return True
        return not known.join(self.spark.createDataFrame([(x,) for x in sizes], "size long"), "size", "left_semi").isEmpty()

    def _copies(self, fresh: list, sums: dict[str, str], known: DataFrame) -> list[str]:
        """The uris of new files whose content came before: in a committed file, or in one of this batch whose path is less."""
        mine = [(r["uri"], r["size"], sums[r["uri"]]) for r in fresh if r["uri"] in sums]
        if not mine:
            return []
        here = self.spark.createDataFrame(mine, "uri string, size long, checksum string")
        out = {r[0] for r in here.join(known, ["size", "checksum"], "left_semi").select("uri").collect()}
        first: dict[tuple, str] = {}
        for uri, *content in mine:
            if first.setdefault(tuple(content), uri) != uri:
                out.add(uri)
        return sorted(out)


def land_feed(feed: DataFrame, runs: list, path: str) -> None:
    """Write the feed as input files, one folder for what arrived between two starts of runs.

    A row is in the folder ``arrived=k`` of the first run k (counted from 0)
    that sees it; rows later than every run are in the last one.  Rows without
    a hash are no input.
    """
    k = F.lit(0)
    for r in runs:
        k = k + (F.col("arrived_at") > F.lit(r["started_at"])).cast("int")
    cols = ["feed_id", "arrived_at", "layer", "topic", "ref", "hash", "updated"]
    rows = feed.where("hash is not null and ref is not null and arrived_at is not null").select(*cols, k.alias("arrived"))
    rows.write.partitionBy("arrived").parquet(path)


def feed_states(d: DataFrame) -> DataFrame:
    return d.withColumns({"layer": F.coalesce("layer", F.lit("")), "ref": norm_ref(F.col("ref")), "h": norm_hash(F.col("hash"))})


def feed_runs(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """For each successful run the pages that are new or changed since the successful run before: run_id, layer, ref, new_hash.

    The feed is landed as files and each run processes the files that the
    manifest does not have yet.  A run that is not ``ok`` commits nothing, so
    its files wait for the next one.  Repeated rows of a run count once; runs
    without a start see nothing.  The runs are gathered to the driver: one row
    a run.  Rows without hash, ref or arrival are ignored; a null layer is a
    layer of its own, shown as null.
    """
    spark = feed.sparkSession
    when = [r for r in runs.where("started_at is not null and run_id is not null").groupBy("run_id").agg(F.min("started_at").alias("started_at"), F.max(F.lower(F.trim("status")) == "ok").alias("ok")).orderBy("started_at", "run_id").collect()]
    home = workspace(spark, "feed")
    land_feed(feed, when, f"{home}/in")
    job = IncrementalRun(spark, f"{home}/in", f"{home}/job", ["layer", "ref"], "h", ["arrived_at", "feed_id"], feed_states)
    out = None
    for i, r in enumerate(when):
        if not r["ok"]:
            continue
        seen = F.regexp_extract("path", r"/arrived=(\d+)/[^/]*$", 1).cast("int") <= i
        got = job.run(f"run-{r['run_id']}", seen)
        if got is not None:
            got = got.where("changed").select(F.lit(r["run_id"]).cast("int").alias("run_id"), F.nullif("layer", F.lit("")).alias("layer"), "ref", F.lower(F.hex("h")).alias("new_hash"))
            out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "run_id int, layer string, ref string, new_hash string")
