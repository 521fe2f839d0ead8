"""Session helpers: where a job keeps written intermediate tables, and how it sizes its shuffles."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillmesh", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine's plans expect; keyword dots are written as double underscores."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that setting is missing (tests, a laptop) a folder under the
    system's temporary directory is made and set, once a session.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = getattr(sc, "_quillmesh_dir", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
        sc.setCheckpointDir(at)
        sc._quillmesh_dir = at
    return at.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for one run of one operator."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Tables that ``written`` left, by application.
_LEFT: dict[str, list[str]] = {}


def clear(spark: SparkSession) -> int:
    """Delete all tables that ``written`` left for this application so far, and say how many. Results that were not read yet are lost with them."""
    left = _LEFT.pop(spark.sparkContext.applicationId, [])
    for at in left:
        remove(spark, at)
    return len(left)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and survives the loss of executors. ``clear`` deletes what is left."""
    spark = df.sparkSession
    at = workspace(spark, name)
    _LEFT.setdefault(spark.sparkContext.applicationId, []).append(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that costs much per row.

    A table of many files is left as it is; only one that a few tasks would
    read is shuffled.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def buckets(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

