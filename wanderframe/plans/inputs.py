"""Sources, sinks, caches and validation, each written and read back in the shared folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import graph, timeline, traj
from ..sources import io, schema
from ..sources.work import scratch
from ..streaming import twins
from . import views
from .mobility import cell_sql
from .registry import Registry
from .views import common, table

query = Registry()


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 0")
def source_csv_scan(spark, sf):
    at = scratch(spark, "csv")
    table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.option("header", True).option("compression", "gzip").csv(at)
    return io.csv(spark, at, "c_custkey long, c_mktsegment string, c_acctbal double").where("c_acctbal > 0")


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def source_stata_scan(spark, sf):
    from io import BytesIO

    from ..sources.work import hadoop

    rows = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")).toPandas()
    made = BytesIO()
    rows.to_stata(made, write_index=False)
    at = scratch(spark, "region") + ".dta"
    fs, path = hadoop(spark, at)
    sink = fs.create(path, True)
    sink.write(bytearray(made.getvalue()))
    sink.close()
    return io.stata(spark, at).select(F.col("id").cast("long").alias("id"), "name")


@query("SELECT c_custkey AS id FROM (SELECT c_custkey, c_custkey % 360 - 180.0 AS x, c_custkey % 170 - 85.0 AS y FROM customer WHERE c_custkey % 2 = 0) WHERE x <= -60 AND x + 1 >= -150 AND y <= 20 AND y + 1 >= -40")
def source_geo_box(spark, sf):
    """A table of boxes in two partitions, of which one is read."""
    x, y = F.col("c_custkey") % 360 - 180.0, F.col("c_custkey") % 170 - 85.0
    boxes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.struct(x.alias("xmin"), (x + 1).alias("xmax"), y.alias("ymin"), (y + 1).alias("ymax")).alias("bbox"), F.when(F.col("c_custkey") % 2 == 0, "place").otherwise("building").alias("type"))
    at = scratch(spark, "geo")
    boxes.write.partitionBy("type").parquet(at)
    return io.geo_parquet(spark, at, (-150.0, -40.0, -60.0, 20.0), ["id"], type="place")


NETWORK = "few AS (SELECT DISTINCT u, v FROM edges WHERE u < 60 AND v < 60)"


@query(common("edges") + f", {NETWORK} SELECT u, v, CAST(1 + u % 3 AS DOUBLE) AS weight FROM few WHERE u < 40 AND v < 40")
def source_social_network(spark, sf):
    """A network file of sixty nodes, of which forty are shown."""
    e = views.edges(spark, sf).where("u < 60 AND v < 60")
    node = F.array(*[F.lit("0")] * 3, F.col("id").cast("string"))
    nodes = spark.range(60).agg(F.sort_array(F.collect_list(F.struct("id", node.alias("n")))).alias("l")).select(F.transform("l", lambda x: x.n).alias("nodes"), F.lit(60).cast("long").alias("node_count"))
    rows = e.agg(F.collect_list(F.array(F.col("u").cast("string"), F.col("v").cast("string"), (1 + F.col("u") % 3).cast("string"))).alias("edges"), F.count("*").alias("edge_count"))
    at = scratch(spark, "network")
    nodes.crossJoin(F.broadcast(rows)).coalesce(1).write.json(at)
    return io.social_network(spark, at, 40)[1]


@query("SELECT * FROM (VALUES ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'), ('value', 'double'), ('props', 'string')) t(name, kind)")
def source_schema_rows(spark, sf):
    return spark.createDataFrame(io.schema_rows(table(spark, sf, "events")), "name string, kind string")


@query("SELECT * FROM (VALUES ('20240103T000000'), ('20240101T000000')) t(stamp)")
def source_discovered_runs(spark, sf):
    at = scratch(spark, "runs")
    one = table(spark, sf, "region")
    for name in ("run_20240101T000000", "run_20240103T000000", "other_20240102T000000", "run_now"):
        one.write.parquet(f"{at}/{name}.parquet")
    return spark.createDataFrame([(s,) for s, _ in io.discover_runs(spark, at, "run")], "stamp string")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def source_derived_table(spark, sf):
    at = scratch(spark, "derived")
    build = lambda: table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    inputs = [f"{sf}/events.parquet"]
    io.derived(spark, at, "counts", ["a"], build, inputs)
    return io.derived(spark, at, "counts", ["a"], lambda: build().limit(0), inputs)


@query("SELECT 'fresh' AS step, CAST(1 AS BIGINT) AS builds UNION ALL SELECT 'kept', 1 UNION ALL SELECT 'stale', 2 UNION ALL SELECT 'changed', 3")
def source_payload_cache(spark, sf):
    """Builds so far: at first, from the cache, after a stale payload, and with another key."""
    cache, built = io.PayloadCache(spark, scratch(spark, "payloads"), stale=lambda p: p["laws"] is None), []

    def build(laws):
        return lambda: built.append(1) or {"laws": laws}

    steps = []
    for step, parts, laws in (("fresh", "a", 1), ("kept", "a", 1), ("", "b", None), ("stale", "b", 2), ("changed", "c", 2)):
        cache.get("report", [parts], build(laws))
        steps.append((step, len(built) - (step in ("stale", "changed"))))
    return spark.createDataFrame([s for s in steps if s[0]], "step string, builds long")


@query("SELECT 'present' AS columns, CAST(NULL AS VARCHAR) AS error UNION ALL SELECT 'absent', 'missing columns: lat, when'")
def project_required_columns(spark, sf):
    e, out = table(spark, sf, "events"), []
    for name, cols in (("present", ("event_id", "ts")), ("absent", ("event_id", "lat", "when"))):
        try:
            schema.require(e, *cols)
            out.append((name, None))
        except ValueError as error:
            out.append((name, str(error)))
    return spark.createDataFrame(out, "columns string, error string")


@query("SELECT event_id, user_id, value FROM events")
def sink_sorted_table(spark, sf):
    at = scratch(spark, "sorted")
    io.write_sorted(table(spark, sf, "events").select("event_id", "user_id", "value"), at, ["user_id", "event_id"])
    return io.parquet(spark, at)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_id % 3 < 2 GROUP BY 1")
def sink_append_days(spark, sf):
    at = scratch(spark, "days")
    e = table(spark, sf, "events").withColumnRenamed("ts", "datetime")
    for k in (0, 1, 9):
        io.append_days(e.where(F.col("event_id") % 3 == k), at)
    return io.parquet(spark, at).groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT event_type, 'mean' AS metric, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def sink_metrics_json(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("value")).withColumn("metric", F.lit("mean"))
    at = scratch(spark, "metrics") + ".json"
    io.metrics_json(rows, ["event_type", "metric"], "value", at)
    read = spark.read.text(at, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("event_type", "m"))
    return read.select("event_type", F.explode("m").alias("metric", "value"))


@query("SELECT DISTINCT s_suppkey AS id, round(CAST(s_suppkey % 50 AS DOUBLE) / 10 + 2.0 / 3, 9) AS lng, round(CAST(s_suppkey % 70 AS DOUBLE) / 10 + 2.0 / 3, 9) AS lat FROM supplier")
def source_geometry_centroids(spark, sf):
    """Centroids of well-known binary polygons: half of a rectangle on each supplier's place."""
    import struct

    def triangle(x: float, y: float) -> bytes:
        ring = [(x, y), (x + 2, y), (x, y + 2), (x, y)]
        return struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<dd", *p) for p in ring)

    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id")).distinct()

    @F.pandas_udf("binary")
    def shape(ids: pd.Series) -> pd.Series:  # the test's own geometry
        return ids.map(lambda i: triangle(i % 50 / 10, i % 70 / 10))

    shapes = s.select("id", shape("id").alias("g"))
    lng, lat = io.wkb_centroid(shapes, "g")
    return shapes.select("id", F.round(lng, 9).alias("lng"), F.round(lat, 9).alias("lat"))


# Preparation that reports decide by their input --------------------------------------------------------


@query(common("pings") + " SELECT uid, datetime FROM (SELECT uid, datetime, loc = lag(loc) OVER (PARTITION BY uid ORDER BY datetime) AS same FROM pings) WHERE NOT coalesce(same, FALSE)")
def traj_adapted(spark, sf):
    t, _ = traj.adapt(views.pings(spark, sf), "force", "loc")
    return t.select("uid", "datetime")


@query(common("visits") + " SELECT uid, start_timestamp, purpose FROM visits WHERE location_id IS NOT NULL")
def traj_activity_visits(spark, sf):
    v, _ = traj.activity_visits(views.pings(spark, sf), "loc", None, "purpose")
    return v.select("uid", "start_timestamp", "purpose")


@query(common("pings") + f" SELECT CAST(max(({cell_sql(8)} >> 52) & 15) AS INTEGER) AS res FROM pings")
def traj_location_resolution(spark, sf):
    from ..functions import geo

    p = views.pings(spark, sf).select(geo.cell_hex(geo.cell("lat", "lng", 8)).alias("h"))
    return spark.createDataFrame([(traj.location_resolution(p, "h"),)], "res int")


@query(common("pings") + " SELECT uid, event_id % 40 AS stop_id, event_id AS seq, CASE mode WHEN 'bike' THEN 'car' ELSE mode END AS mode FROM pings")
def timeline_moving_index(spark, sf):
    w = views.pings(spark, sf).selectExpr("uid", "event_id % 40 AS stop_id", "event_id AS seq", "nullif(mode, 'bike') AS mode")
    return timeline.moving_index(w)


CELLS = """s AS (SELECT DISTINCT CAST(datetime AS DATE) AS day, {cell} AS loc, uid FROM pings), z AS (SELECT day, loc FROM s GROUP BY ALL HAVING count(*) BETWEEN 2 AND 200), k AS (SELECT s.* FROM s JOIN z USING (day, loc)),
 pr AS (SELECT DISTINCT a.day, a.uid AS u, b.uid AS v FROM k a JOIN k b ON a.day = b.day AND a.loc = b.loc AND a.uid < b.uid)"""


@query(common("pings") + ", " + CELLS.format(cell=cell_sql(10)) + " SELECT u, v, count(*) AS days FROM pr GROUP BY u, v")
def graph_cell_contacts(spark, sf):
    """Contacts where no column names the place: users of one cell meet."""
    p = views.pings(spark, sf).drop("loc")
    e, _ = graph.co_presence(p.withColumn("location_id", traj.place(p)))
    return e.select("u", "v", "days")


# Streams ---------------------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT user_id, unnest(range(CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 - 6, CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 + 1)) AS d FROM events)
 SELECT TIMESTAMP '1970-01-01' + CAST(d AS INTEGER) * INTERVAL 1 DAY AS start, user_id, count(*) AS n FROM w GROUP BY ALL"""
)
def stream_sliding_contacts(spark, sf):
    s = twins.sliding_contacts(twins.events(spark, sf))
    return twins.drained(spark, s.withColumn("start", F.col("start").cast("timestamp_ntz")), "complete")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_append_days(spark, sf):
    at = scratch(spark, "appended")
    twins.append_to(twins.events(spark, sf), at, scratch(spark, "progress")).awaitTermination()
    return io.parquet(spark, at).groupBy("day", "event_type").agg(F.count("*").alias("n"))


QUERIES, ORACLE = query.queries, query.oracle
