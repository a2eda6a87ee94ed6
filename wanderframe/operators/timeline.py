"""Timelines: an index of dwells and legs, viewport queries, agents, encounters and friends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geo import in_range
from ..functions.scalar import after_minutes, crp_weight, finite, minutes_between, seconds_of
from .filters import envelope_meets, in_viewport, overlaps


def by_arrival() -> WindowSpec:
    return Window.partitionBy("uid").orderBy("arrival", "stop_id")


def legs_index(stops: DataFrame) -> DataFrame:
    """Dwells at stops and the legs that lead to them.

    A leg ends at the arrival and began as many minutes before as the trip took; the first
    stop of a user has none."""
    category = F.col("category") if "category" in stops.columns else F.lit(None).cast("string")
    s = stops.withColumns({"p_lat": F.lag("lat").over(by_arrival()), "p_lng": F.lag("lng").over(by_arrival()), "cat": category})
    start = (F.col("arrival") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("trip_duration_minutes") * 60).cast("decimal(18,6)"))).cast("timestamp_ntz")
    dwell = F.struct(F.lit("dwell").alias("kind"), F.col("arrival").alias("t_start"), F.col("departure").alias("t_end"), F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"))
    leg = F.struct(F.lit("leg").alias("kind"), start.alias("t_start"), F.col("arrival").alias("t_end"), F.col("p_lat").alias("o_lat"), F.col("p_lng").alias("o_lng"))
    # One pass over the stops instead of a union of two scans.
    parts = F.array_compact(F.array(dwell, F.when(F.col("p_lat").isNotNull(), leg)))
    return s.select("uid", F.inline(parts), F.col("lat").alias("d_lat"), F.col("lng").alias("d_lng"), "purpose", F.col("cat").alias("category"), "stop_id").select("uid", "kind", "t_start", "t_end", "o_lat", "o_lng", "d_lat", "d_lng", "purpose", "category", "stop_id")


def moving_index(points: DataFrame, default: str = "car") -> DataFrame:
    """Waypoints laid out by user, stop and order; a missing mode is the default."""
    filled = points.withColumn("mode", F.coalesce("mode", F.lit(default)) if "mode" in points.columns else F.lit(default))
    return filled.repartition("uid").sortWithinPartitions("uid", "stop_id", "seq")


def candidates(legs: DataFrame, since, until, box, max_agents: int) -> DataFrame:
    """Users with a leg in the window that starts or ends in the box: the first ones by the
    md5 of their id, which is a fixed sample."""
    touch = in_viewport("d_lat", "d_lng", box) | in_viewport("o_lat", "o_lng", box)
    return legs.where(overlaps(since, until) & F.coalesce(touch, F.lit(False))).select("uid").distinct().orderBy(F.md5(F.col("uid").cast("string"))).limit(max_agents)


def active_legs(legs: DataFrame, since, until, box, max_agents: int) -> DataFrame:
    """All rows in the window of the candidate users.  They are at most ``max_agents``, a
    parameter of the view, and so few enough to send to every task."""
    few = candidates(legs, since, until, box, max_agents)
    return legs.where(overlaps(since, until)).join(F.broadcast(few), "uid", "left_semi")


def is_truncated(legs: DataFrame, since, until, box, max_agents: int) -> bool:
    return candidates(legs, since, until, box, max_agents + 1).count() > max_agents


def viewport_segments(legs: DataFrame, since, until, box, max_agents: int) -> DataFrame:
    """Rows whose envelope meets the box, of the first users by id."""
    hit = legs.where(overlaps(since, until) & envelope_meets(box))
    few = hit.select("uid").distinct().orderBy("uid").limit(max_agents)
    return hit.join(F.broadcast(few), "uid", "left_semi")


def with_waypoints(legs: DataFrame, points: DataFrame) -> DataFrame:
    """Legs with their waypoints as an ordered array, and a mode: stay or car by default."""
    lists = points.groupBy("uid", "stop_id").agg(F.sort_array(F.collect_list(F.struct("seq", "lat", "lng", "t", "mode"))).alias("waypoints"))
    joined = legs.join(lists, ["uid", "stop_id"], "left")
    own = F.get(F.col("waypoints"), F.lit(0)).getField("mode")
    return joined.withColumn("mode", F.when(F.col("kind") == "dwell", "stay").otherwise(F.coalesce(own, F.lit("car")))).withColumn("waypoints", F.when(F.col("kind") == "leg", F.col("waypoints")))


def bounds(df: DataFrame) -> DataFrame:
    return df.where(in_range("lat", "lng")).agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))


def agent_trips(stops: DataFrame, uid) -> DataFrame:
    return stops.where(F.col("uid") == uid).orderBy("arrival", "stop_id")


def stop_activities(intervals: DataFrame, uid, key: str = "stop_id") -> DataFrame:
    """Per stop of a user: its activities in order with their minutes."""
    one = intervals.where(F.col("uid") == uid)
    item = F.struct("seq", "activity", "arrival", "departure", minutes_between("arrival", "departure").alias("minutes"))
    return one.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("activities"))


def activity_at(intervals: DataFrame, uid, ts, order: str = "seq") -> DataFrame:
    """The last activity of a user that covers the moment."""
    return intervals.where((F.col("uid") == uid) & (F.col("arrival") <= F.lit(ts)) & (F.col("departure") >= F.lit(ts))).orderBy(F.desc(order)).limit(1)


def merged_trips(stops: DataFrame) -> DataFrame:
    """Consecutive stops of a user at one point merged: the most common purpose (the first
    seen of equals), first arrival, last departure and the minutes between."""
    w = by_arrival()
    moved = ~F.coalesce((F.lag("lat").over(w) == F.col("lat")) & (F.lag("lng").over(w) == F.col("lng")), F.lit(False))
    grouped = stops.withColumn("moved", moved.cast("long")).withColumn("trip", F.sum("moved").over(w))
    per = grouped.groupBy("uid", "trip", "purpose").agg(F.count("*").alias("n"), F.min(F.struct("arrival", "stop_id")).alias("first"), F.max(F.struct("arrival", "stop_id", "departure")).alias("last"), F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    out = per.groupBy("uid", "trip").agg(F.min_by("purpose", F.struct(-F.col("n"), F.col("first"))).alias("purpose"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n_stops"), F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    return out.select("uid", "trip", "purpose", "n_stops", "lat", "lng", F.col("first.arrival").alias("arrival"), F.col("last.departure").alias("departure"), minutes_between("first.arrival", "last.departure").alias("dwell_minutes"))


def encounter_stops(encounters: DataFrame, stops: DataFrame) -> DataFrame:
    """Each encounter with the contact's stop at that second: of stops that cover it, the one
    of the latest arrival.  Stops and encounters meet by user and day, so that a long history
    is never scanned for one moment."""
    days = F.explode(F.sequence(F.to_date("arrival"), F.to_date("departure")))
    held = stops.where("departure >= arrival").select(F.col("uid").alias("contact"), days.alias("day"), "arrival", "departure", "lat", "lng", F.col("purpose"), "stop_id")
    met = encounters.withColumn("at", F.timestamp_seconds("ts").cast("timestamp_ntz")).withColumn("day", F.to_date("at"))
    met = met.withColumn("__id", F.struct("agent", "contact", "ts"))
    hit = met.join(held, ["contact", "day"]).where("arrival <= at AND departure >= at")
    best = hit.groupBy("__id").agg(F.max_by(F.struct("lat", "lng", "purpose", "stop_id"), F.struct("arrival", "stop_id")).alias("s"))
    return met.select("agent", "contact", "ts", "__id").distinct().join(best, "__id", "left").select("agent", "contact", "ts", "s.lat", "s.lng", "s.purpose", "s.stop_id")


def recent_encounters(encounters: DataFrame, stops: DataFrame, uid, n: int = 20) -> DataFrame:
    """The n latest encounters of an agent with the contact's stop."""
    last = encounters.where(F.col("agent") == uid).orderBy(F.desc("ts"), "contact").limit(n)
    return encounter_stops(last, stops).orderBy(F.desc("ts"), "contact")


def encounter_counts(encounters: DataFrame, uid) -> DataFrame:
    """Encounters per contact of an agent, whichever side it is on."""
    own = encounters.where((F.col("agent") == uid) | (F.col("contact") == uid))
    return own.groupBy(F.when(F.col("agent") == uid, F.col("contact")).otherwise(F.col("agent")).alias("contact")).agg(F.count("*").alias("encounters"), F.max("ts").alias("last_ts"))


def friends(edges: DataFrame, node, base: int = 1) -> DataFrame:
    """Outgoing edges of a zero-based node: friend ids from ``base``, weight, reciprocated."""
    out = edges.where(F.col("u") == node).select(F.col("v"), "weight")
    back = edges.where(F.col("v") == node).select(F.col("u").alias("v"), F.lit(True).alias("reciprocated")).distinct()
    return out.join(back, "v", "left").select((F.col("v") + base).alias("uid"), "weight", F.coalesce("reciprocated", F.lit(False)).alias("reciprocated")).orderBy(F.desc("weight"), "uid")


def crp_rows(crp: DataFrame, agent) -> DataFrame:
    return crp.where(F.col("agent") == agent).orderBy(F.desc("usage_count"), "diary_id")


def next_diary(crp: DataFrame, top: int = 10) -> DataFrame:
    """Chances of the next diary per agent and day type: used ones by their count, new ones by
    alpha, each times exp(sim / T); the most likely first."""
    count = F.when(F.col("usage_count") > 0, F.col("usage_count").cast("double")).otherwise(F.col("alpha_a"))
    weighed = crp.withColumn("w", crp_weight(count, "sim", "T_a")).where(finite("w"))
    share = weighed.withColumn("probability", F.col("w") / F.sum("w").over(Window.partitionBy("agent", "day_type")))
    rank = F.row_number().over(Window.partitionBy("agent", "day_type").orderBy(F.desc("probability"), "diary_id"))
    return share.withColumn("rank", rank).where(F.col("rank") <= top).select("agent", "day_type", "diary_id", "probability", "rank")


def chunks(legs: DataFrame, hours: int) -> DataFrame:
    """Rows once for each tumbling window of so many hours that they overlap."""
    size = hours * 3600
    first, last = F.floor(seconds_of("t_start") / size), F.floor(seconds_of("t_end") / size)
    return legs.where("t_end >= t_start").withColumn("chunk", F.explode(F.sequence(first, last)))


def induced(df: DataFrame, uids: DataFrame, *columns: str) -> DataFrame:
    """Rows all of whose user columns are among ``uids`` (uid)."""
    for name in columns:
        df = df.join(uids.select(F.col("uid").alias(name)), name, "left_semi")
    return df


def trip_times(stops: DataFrame) -> DataFrame:
    """When each trip began: arrival less its minutes."""
    return stops.withColumn("trip_start", after_minutes("arrival", -F.col("trip_duration_minutes")).cast("timestamp_ntz"))


def agent_detail(stops: DataFrame, intervals: DataFrame, encounters: DataFrame, profiles: DataFrame, uid) -> DataFrame:
    """One row: the profile of an agent with its trips, activities and encounters as arrays."""
    trips = agent_trips(stops, uid).agg(F.sort_array(F.collect_list(F.struct("arrival", "departure", "stop_id", "lat", "lng", "purpose"))).alias("trips"))
    acts = intervals.where(F.col("uid") == uid).agg(F.sort_array(F.collect_list(F.struct("seq", "activity", "arrival", "departure"))).alias("activities"))
    met = recent_encounters(encounters, stops, uid).agg(F.sort_array(F.collect_list(F.struct("ts", "contact", "purpose", "stop_id")), asc=False).alias("encounters"))
    one = profiles.where(F.col("uid") == uid).limit(1)
    for part in (trips, acts, met):  # each is a single row
        one = one.join(F.broadcast(part))
    return one
