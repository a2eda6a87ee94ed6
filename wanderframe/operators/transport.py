"""Transport legs from waypoints or from consecutive observations, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.scalar import MODES, finite, minutes_between, mode, mode_rank


def waypoint_legs(points: DataFrame, mapping: dict[str, str] = MODES) -> DataFrame:
    """(uid, stop_id, mode, jump_km, duration_minutes) of each leg with two waypoints or more.

    One pass: steps come from a window per leg, and all sums from one aggregation."""
    w = Window.partitionBy("uid", "stop_id").orderBy("seq")
    step = haversine(F.lag("lat").over(w), F.lag("lng").over(w), "lat", "lng")
    stepped = points.dropna(subset=["uid", "stop_id"]).select("uid", "stop_id", "seq", "t", "mode", step.alias("km"), (finite("lat") & finite("lng")).alias("placed"))
    legs = stepped.groupBy("uid", "stop_id").agg(
        F.count("*").alias("n"), F.count_if("placed").alias("placed"), F.coalesce(F.sum(F.when(finite("km"), F.col("km"))), F.lit(0.0)).alias("jump_km"),
        minutes_between(F.min("t"), F.max("t")).alias("duration_minutes"), F.min_by("mode", F.when(F.col("mode").isNotNull(), F.col("seq"))).alias("mode"),
    )
    return legs.where("n >= 2 AND placed >= 2").select("uid", "stop_id", mode("mode", mapping).alias("mode"), "jump_km", "duration_minutes")


def observed_legs(df: DataFrame, mode_column: str, duration: str | None = None, mapping: dict[str, str] = MODES) -> DataFrame:
    """A leg for each consecutive pair of a user's rows; the mode is that of the later row."""
    w = Window.partitionBy("uid").orderBy("datetime")
    gap = minutes_between(F.lag("datetime").over(w), "datetime")
    took = F.when(finite(duration), F.col(duration).cast("double")) if duration else gap
    legs = df.select("uid", "datetime", mode(mode_column, mapping).alias("mode"), haversine(F.lag("lat").over(w), F.lag("lng").over(w), "lat", "lng").alias("jump_km"), took.alias("duration_minutes"))
    return legs.where(finite("jump_km"))


def summary(legs: DataFrame) -> DataFrame:
    """Per source and mode: legs, percent of the source's, mean length and duration."""
    per = legs.where("mode IS NOT NULL").groupBy("source", "mode").agg(F.count("*").alias("n_legs"), F.avg("jump_km").alias("mean_jump_km"), F.avg("duration_minutes").alias("mean_minutes"))
    return per.withColumn("share", 100.0 * F.col("n_legs") / F.sum("n_legs").over(Window.partitionBy("source"))).withColumn("mode_order", mode_rank("mode"))
