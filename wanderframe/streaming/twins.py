"""Structured Streaming twins of batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.work import scratch


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour_start, event_type, n) in tumbling hours behind a watermark."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("hour_start"), "event_type", "n")


def sliding_contacts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(start, user_id, n) over seven days, moved by one."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day"), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "user_id", "n")


def sessions(stream: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """(user_id, first_at, last_at, n) of runs of events without a longer gap."""
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return s.select("user_id", F.col("a").cast("timestamp_ntz").alias("first_at"), F.col("b").cast("timestamp_ntz").alias("last_at"), "n")


def count_stays(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Stays per user across micro-batches: the last place and the count are the state."""
    last, n = state.get if state.exists else (-1, 0)
    rows = pd.concat(list(batches)).sort_values("datetime")
    for loc in rows["loc"]:
        n += loc != last
        last = int(loc)
    state.update((last, int(n)))
    yield pd.DataFrame({"uid": [key[0]], "stays": [int(n)]})


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, stays): the latest count of each user's stays after the stream has drained."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("uid"), F.col("ts").alias("datetime"), ((F.col("event_id") * 31 + F.col("user_id") * 17) % 40).alias("loc"))
    counted = e.groupBy("uid").applyInPandasWithState(count_stays, "uid long, stays long", "last long, n long", "update", GroupStateTimeout.NoTimeout)
    return drained(spark, counted, "update").groupBy("uid").agg(F.max("stays").alias("stays"))


def drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return its result as a table in the shared folder:
    of ``complete`` the last batch, else the batches one after another."""
    at = scratch(spark, "drained")

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/{'last' if mode == 'complete' else epoch}")

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # windows begin at full hours of UTC
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(at)


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch to a Parquet table by day; empty ones write nothing."""

    def put(df: DataFrame, epoch: int) -> None:
        if not df.isEmpty():
            df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
