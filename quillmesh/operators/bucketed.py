"""Bucketed tables in the shared folder: state that a later run joins without shuffling it.

Spark writes buckets only by way of a catalog table.  The table is registered
for the moment that a plan needs to see its buckets and dropped again; the
files stay, and what there is to know about them (keys, number of buckets,
schema) is kept by the operator beside its own commit entry, so that a new
process opens them from their path.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.session import remove


def _seen(spark: SparkSession, name: str) -> DataFrame:
    df = spark.table(name)
    _ = df.schema  # the plan holds files and buckets from here on
    spark.sql(f"DROP TABLE {name}")
    return df


def write(df: DataFrame, path: str, keys: list[str], n: int, placed: bool = False) -> DataFrame:
    """df in n buckets of its keys below path, which is emptied first; one file a bucket, as the rows are brought together before.

    placed: the rows are hash partitioned by the keys into n already.
    The rows read back are hash partitioned by the keys, so that joins and
    aggregates over them move only the other side.
    """
    spark, name = df.sparkSession, f"qm_{uuid.uuid4().hex}"
    remove(spark, path)
    (df if placed else df.repartition(n, *keys)).write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(name)
    return _seen(spark, name)


def open_table(spark: SparkSession, path: str, schema: str, keys: list[str], n: int) -> DataFrame:
    """A table written before, by this process or another; schema as DDL."""
    name = f"qm_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(f'`{k}`' for k in keys)}) INTO {n} BUCKETS LOCATION '{path}'")
    return _seen(spark, name)


def ddl(df: DataFrame) -> str:
    """The columns of df as DDL."""
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)



def versions(new: DataFrame, tables: list[DataFrame], keys: list[str], row: Column, name: str, others: dict | None = None) -> DataFrame:
    """``new`` (rows of an aggregate by the keys, in n partitions) and the rows of tables of one bucketing, all still where they lie.

    Of each table come the keys, ``row`` as a struct of that name, and the
    columns ``others``.  Spark 4.1 keeps the partitioning of a union only where
    it runs on rows; over scans alone, which are columnar, it claims the
    partitioning and loses it, so tables are never united without ``new``.
    """
    of = [t.select(*keys, row.alias(name), *[c.alias(k) for k, c in (others or {}).items()]) for t in tables]
    return reduce(DataFrame.unionByName, of, new)


def plain(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The rows of tables written here as one scan that knows of no buckets: right for any use, and moved by an aggregate."""
    return spark.read.schema(schema).parquet(*paths)
