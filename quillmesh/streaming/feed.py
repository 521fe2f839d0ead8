"""Structured streaming (an extension): the page feed as a stream of files, its state kept by the incremental operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.functions.refs import norm_hash, norm_ref


def changes_per_window(spark: SparkSession, source: str, schema, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """window, layer, versions, pages of the feed by arrival time; rows later than the watermark are left out, repeated feed_ids count once."""
    feed = spark.readStream.schema(schema).parquet(source).where("hash is not null and ref is not null")
    one = feed.withWatermark("arrived_at", late).dropDuplicates(["feed_id", "arrived_at"])
    w = one.groupBy(F.window("arrived_at", size).alias("w"), "layer")
    return w.agg(F.count("*").alias("versions"), F.approx_count_distinct(norm_ref(F.col("ref"))).alias("pages")).select(F.col("w.start").alias("start"), "layer", "versions", "pages")


def latest_states(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest state of each page below target, one folder per micro-batch, overwritten if the batch is repeated."""

    def one(batch: DataFrame, batch_id: int) -> None:
        s = batch.where("hash is not null and ref is not null").select("layer", norm_ref(F.col("ref")).alias("ref"), norm_hash(F.col("hash")).alias("h"), "arrived_at", "feed_id")
        last = s.groupBy("layer", "ref").agg(F.max(F.struct("arrived_at", "feed_id", "h")).alias("s")).select("layer", "ref", "s.*")
        last.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
