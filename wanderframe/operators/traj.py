"""Trajectories: stays, jumps, gyration, waits, visits and purposes.

Tables have uid, datetime, lat and lng.  All windows are per user and ordered by time, so
that one shuffle by uid serves a chain of these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geo import cell, cell_resolution, haversine, in_range
from ..functions.scalar import finite, minutes_between, purpose

PANEL_SHARE = 0.2
SPEED_KMH = 50.0


def by_time() -> WindowSpec:
    return Window.partitionBy("uid").orderBy("datetime")


def by_user() -> WindowSpec:
    return Window.partitionBy("uid")


def located(df: DataFrame) -> DataFrame:
    """Rows with user, time and a place on earth."""
    return df.dropna(subset=["uid", "datetime", "lat", "lng"]).where(in_range("lat", "lng"))


def place(df: DataFrame, res: int = 10, column: str | None = None) -> Column:
    """The location column as text where it is set, and the grid cell in hexadecimal elsewhere."""
    own = F.lower(F.hex(cell("lat", "lng", res)))
    return F.coalesce(F.col(column).cast("string"), own) if column else own


def collapse_to_stays(df: DataFrame) -> DataFrame:
    """The first row of every run of rows of one user at exactly one point."""
    seen = df.withColumns({"__lat": F.lag("lat").over(by_time()), "__lng": F.lag("lng").over(by_time())})
    same = (F.col("lat") == F.col("__lat")) & (F.col("lng") == F.col("__lng"))
    return seen.where(~F.coalesce(same, F.lit(False))).drop("__lat", "__lng")


def collapse_by(df: DataFrame, key: str) -> DataFrame:
    """The first row of every run of one user with one key; null never equals."""
    seen = df.withColumn("__key", F.lag(key).over(by_time()))
    return seen.where(~F.coalesce(F.col("__key") == F.col(key), F.lit(False))).drop("__key")


def panel_share(df: DataFrame, key: str) -> DataFrame:
    """One row: the share of a user's consecutive rows that repeat the key."""
    seen = df.withColumns({"__key": F.lag(key).over(by_time()), "__n": F.row_number().over(by_time())}).where("__n > 1")
    return seen.agg(F.coalesce(F.avg((F.coalesce(F.col("__key") == F.col(key), F.lit(False))).cast("double")), F.lit(0.0)).alias("share"))


def looks_like_panel(df: DataFrame, key: str, has_duration: bool = False) -> bool:
    """Whether rows are repeated samples of stays: at least a fifth of the steps stay put."""
    if has_duration:
        return False
    return panel_share(df, key).first().share >= PANEL_SHARE


def adapt(df: DataFrame, mode: str = "auto", key: str | None = None, res: int = 10, has_duration: bool = False) -> tuple[DataFrame, str | None]:
    """Collapse panels to stays: mode off, auto or force; a warning if it did."""
    if mode == "off":
        return df, None
    keyed = df.withColumn("__place", place(df, res, key))
    if mode == "auto" and not looks_like_panel(keyed, "__place", has_duration):
        return df, None
    return collapse_by(keyed, "__place").drop("__place"), "rows that repeat a user's place were collapsed to stays"


def with_previous(df: DataFrame) -> DataFrame:
    return df.withColumns({"prev_lat": F.lag("lat").over(by_time()), "prev_lng": F.lag("lng").over(by_time()), "prev_time": F.lag("datetime").over(by_time())})


def jump_lengths(df: DataFrame) -> DataFrame:
    """(uid, datetime, jump_km) of moves to the next row, those of no length left out."""
    out = with_previous(df).select("uid", "datetime", haversine("prev_lat", "prev_lng", "lat", "lng").alias("jump_km"))
    return out.where("jump_km > 0")


def radius_of_gyration(df: DataFrame) -> DataFrame:
    """(uid, rog_km): root mean square distance to the mean point in degrees."""
    centred = df.withColumns({"__lat": F.avg("lat").over(by_user()), "__lng": F.avg("lng").over(by_user())})
    d = haversine("lat", "lng", "__lat", "__lng")
    return centred.groupBy("uid").agg(F.sqrt(F.avg(d * d)).alias("rog_km"))


def waiting_times(df: DataFrame) -> DataFrame:
    """(uid, datetime, wait_minutes) between consecutive rows."""
    return with_previous(df).where("prev_time IS NOT NULL").select("uid", "datetime", minutes_between("prev_time", "datetime").alias("wait_minutes"))


def visits_per_user(df: DataFrame) -> DataFrame:
    return collapse_to_stays(df).groupBy("uid").agg(F.count("*").alias("visits"))


def dwell_minutes(df: DataFrame, column: str | None = None) -> DataFrame:
    """(uid, minutes): the column's values of zero and more, or else the waiting times."""
    if column:
        return df.select("uid", F.col(column).cast("double").alias("minutes")).where(finite("minutes") & (F.col("minutes") >= 0))
    return waiting_times(df).select("uid", F.col("wait_minutes").alias("minutes"))


def trip_minutes(df: DataFrame, column: str | None = None) -> DataFrame:
    """(uid, minutes): the column's values above zero, or else jumps at a fixed speed."""
    if column:
        return df.select("uid", F.col(column).cast("double").alias("minutes")).where(finite("minutes") & (F.col("minutes") > 0))
    return jump_lengths(df).select("uid", (F.col("jump_km") / SPEED_KMH * 60).alias("minutes"))


def visits(df: DataFrame, location: str | None = None, end: str | None = None, purpose_column: str | None = None, res: int = 10) -> DataFrame:
    """(uid, start_timestamp, end_timestamp, location_id, purpose): a visit ends with its
    column, else where the next begins, else at the next midnight."""
    after = F.coalesce(F.lead("datetime").over(by_time()), (F.date_trunc("day", F.col("datetime")) + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz"))
    ends = F.coalesce(F.col(end).try_cast("timestamp_ntz"), after) if end else after
    return df.select("uid", F.col("datetime").alias("start_timestamp"), ends.alias("end_timestamp"), place(df, res, location).alias("location_id"), (F.col(purpose_column) if purpose_column else F.lit(None).cast("string")).alias("purpose"))


def location_resolution(df: DataFrame, location: str, default: int = 10) -> int:
    """The resolution of the first location that is a cell."""
    row = df.where(F.col(location).isNotNull()).select(cell_resolution(F.conv(F.col(location).cast("string"), 16, 10).try_cast("bigint")).alias("r")).head(1)
    return row[0].r if row and row[0].r is not None else default


def modal(df: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """The most frequent key of each group; the smallest of equally frequent ones."""
    counted = df.groupBy(*by, key).agg(F.count("*").alias("__n"))
    return counted.groupBy(*by).agg(F.min_by(key, F.struct(-F.col("__n"), F.col(key))).alias(name))


def anchors(v: DataFrame, start: str = "start_timestamp", location: str = "location_id") -> DataFrame:
    """(uid, home, work): home is modal at hours 2 to 5; work at 10 or 14 to 16, home left out."""
    h = F.hour(start)
    home = modal(v.where(h.between(2, 5)), ["uid"], location, "home")
    day = v.where((h == 10) | h.between(14, 16)).join(home, "uid", "left").where(F.col("home").isNull() | (F.col(location) != F.col("home")))
    return home.join(modal(day, ["uid"], location, "work"), "uid", "full_outer")


def heuristic_purposes(v: DataFrame, start: str = "start_timestamp", location: str = "location_id") -> DataFrame:
    """``v`` with purpose HOME, WORK or OTHER by the anchors; home wins."""
    joined = v.drop("purpose").join(anchors(v, start, location), "uid", "left")
    p = F.when(F.col(location) == F.col("home"), "HOME").when(F.col(location) == F.col("work"), "WORK").otherwise("OTHER")
    return joined.withColumn("purpose", p).drop("home", "work")


def activity_visits(df: DataFrame, location: str | None = None, end: str | None = None, purpose_column: str | None = None, res: int = 10) -> tuple[DataFrame, str | None]:
    """Visits with a purpose from the column, or by heuristic with a warning."""
    v = visits(df, location, end, purpose_column, res).dropna(subset=["uid", "start_timestamp", "location_id"])
    if purpose_column:
        return v.withColumn("purpose", purpose("purpose")), None
    return heuristic_purposes(v), "purposes were inferred from places at night and by day"
