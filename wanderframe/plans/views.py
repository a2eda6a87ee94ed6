"""Mobility tables derived from the test tables, for Spark and as SQL text for the oracle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PINGS = """SELECT user_id AS uid, event_id, ts AS datetime, CAST(48.80 + (loc // 8) * 0.01 AS DOUBLE) AS lat,
 CAST(2.25 + (loc % 8) * 0.01 AS DOUBLE) AS lng, loc, value, CASE event_type WHEN 'signup' THEN 'HOME' WHEN 'purchase' THEN 'WORK' ELSE 'OTHER' END AS purpose,
 CASE event_id % 4 WHEN 0 THEN 'walk' WHEN 1 THEN 'bike' WHEN 2 THEN 'car' ELSE 'rail' END AS mode, user_id % 2 AS side
 FROM (SELECT *, (event_id * 31 + user_id * 17) % 40 AS loc FROM events)"""
STOPS = """SELECT uid, CAST(row_number() OVER w - 1 AS BIGINT) AS stop_id, datetime, lat, lng, datetime AS arrival,
 least(coalesce(lead(datetime) OVER w, datetime + INTERVAL 2 HOUR), datetime + INTERVAL 2 HOUR) AS departure,
 CAST(floor(value) AS BIGINT) % 30 + 1 AS trip_duration_minutes, purpose, loc FROM pings WINDOW w AS (PARTITION BY uid ORDER BY datetime)"""
INTERVALS = "SELECT user_id AS uid, event_id % 25 AS activity, event_id AS seq, ts AS arrival, ts + CAST(1 + event_id % 300 AS INTEGER) * INTERVAL 1 MINUTE AS departure FROM events"
ENCOUNTERS = "SELECT user_id AS agent, (user_id + 1 + event_id % 7) % 150 AS contact, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events"
PROFILES = "SELECT DISTINCT user_id AS uid, CASE (user_id // 2) % 2 WHEN 0 THEN 'female' ELSE 'male' END AS gender, 16 + (user_id * 13) % 65 AS age, 'job' || CAST(user_id % 9 AS VARCHAR) AS job FROM events"
VISITS = """SELECT uid, datetime AS start_timestamp, coalesce(lead(datetime) OVER (PARTITION BY uid ORDER BY datetime), date_trunc('day', datetime) + INTERVAL 1 DAY) AS end_timestamp,
 CAST(loc AS VARCHAR) AS location_id, purpose, side, lat, lng FROM pings"""
EDGES = "SELECT DISTINCT least(agent, contact) AS u, greatest(agent, contact) AS v FROM encounters WHERE agent <> contact"
SQL = {"pings": PINGS, "stops": STOPS, "intervals": INTERVALS, "encounters": ENCOUNTERS, "profiles": PROFILES, "visits": VISITS, "edges": EDGES}
NEEDS = {"stops": ("pings",), "visits": ("pings",), "edges": ("encounters",)}


def common(*names: str) -> str:
    """A WITH clause of these views and of those they need, without a closing comma."""
    order: list[str] = []
    for n in names:
        order += [m for m in (*NEEDS.get(n, ()), n) if m not in order]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order)


def draw(seed: int, *cols: str) -> str:
    """SQL of the seeded draw of ``functions.scalar.uniform``."""
    return f"((CAST(('0x' || left(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)})), 13))::BIGINT AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def normal(seed: int, *cols: str) -> str:
    """SQL of ``functions.scalar.normal``."""
    return f"(sqrt(-2 * ln({draw(seed, *cols)})) * cos(6.283185307179586 * {draw(seed + 7919, *cols)}))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("loc", F.expr("(event_id * 31 + user_id * 17) % 40"))
    purpose = F.when(F.col("event_type") == "signup", "HOME").when(F.col("event_type") == "purchase", "WORK").otherwise("OTHER")
    mode = F.get(F.array(*[F.lit(m) for m in ("walk", "bike", "car", "rail")]), F.expr("cast(event_id % 4 as int)"))
    return e.select(F.col("user_id").alias("uid"), "event_id", F.col("ts").alias("datetime"), F.expr("cast(48.80 + (loc div 8) * 0.01 as double)").alias("lat"), F.expr("cast(2.25 + (loc % 8) * 0.01 as double)").alias("lng"), "loc", "value", purpose.alias("purpose"), mode.alias("mode"), F.expr("user_id % 2").alias("side"))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = "lead(datetime) OVER (PARTITION BY uid ORDER BY datetime)"
    later = "(datetime + INTERVAL 2 HOURS)"
    return pings(spark, sf_dir).selectExpr("uid", "cast(row_number() OVER (PARTITION BY uid ORDER BY datetime) - 1 as bigint) AS stop_id", "datetime", "lat", "lng", "datetime AS arrival", f"least(coalesce({lead}, {later}), {later}) AS departure", "cast(floor(value) as bigint) % 30 + 1 AS trip_duration_minutes", "purpose", "loc")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS uid", "event_id % 25 AS activity", "event_id AS seq", "ts AS arrival", "ts + make_dt_interval(0, 0, cast(1 + event_id % 300 as int), 0) AS departure")


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS agent", "(user_id + 1 + event_id % 7) % 150 AS contact", "unix_seconds(cast(ts as timestamp)) AS ts")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS uid", "CASE (user_id div 2) % 2 WHEN 0 THEN 'female' ELSE 'male' END AS gender", "16 + (user_id * 13) % 65 AS age", "concat('job', user_id % 9) AS job").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encounters(spark, sf_dir).where("agent <> contact").selectExpr("least(agent, contact) AS u", "greatest(agent, contact) AS v").distinct()


#: A viewport over part of the test grid and a day of the test month.
BOX = (2.26, 48.80, 2.29, 48.83)
SINCE, UNTIL = datetime(2024, 1, 10), datetime(2024, 1, 11)
