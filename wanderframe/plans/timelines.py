"""Timelines, encounters, routing, streaming twins and generated populations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing, simulate, tessellation, timeline
from ..sources import io
from ..streaming import twins
from ..functions import geo
from . import behaviour, compare, mobility, views
from .mobility import cell_sql, hav
from .registry import Registry
from .views import common, draw, normal

query = Registry()

LEGS = """legs AS (SELECT uid, 'dwell' AS kind, arrival AS t_start, departure AS t_end, lat AS o_lat, lng AS o_lng, lat AS d_lat, lng AS d_lng, purpose, stop_id FROM stops
 UNION ALL SELECT uid, 'leg', arrival - CAST(trip_duration_minutes AS INTEGER) * INTERVAL 1 MINUTE, arrival, plat, plng, lat, lng, purpose, stop_id FROM (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM stops WINDOW w AS (PARTITION BY uid ORDER BY arrival)) WHERE plat IS NOT NULL)"""
WINDOW = f"t_start <= TIMESTAMP '{views.UNTIL}' AND t_end >= TIMESTAMP '{views.SINCE}'"
IN_BOX = "({p}_lng BETWEEN 2.26 AND 2.29 AND {p}_lat BETWEEN 48.80 AND 48.83)"
FEW = f"few AS (SELECT uid FROM (SELECT DISTINCT uid FROM legs WHERE {WINDOW} AND ({IN_BOX.format(p='d')} OR {IN_BOX.format(p='o')})) ORDER BY md5(CAST(uid AS VARCHAR)) LIMIT 20)"


def _legs(spark, sf):
    return timeline.legs_index(views.stops(spark, sf)).drop("category")


@query(common("stops") + f", {LEGS} SELECT uid, kind, t_start, t_end, o_lat, o_lng, d_lat, d_lng, purpose, stop_id FROM legs")
def timeline_legs_index(spark, sf):
    return _legs(spark, sf)


@query(common("stops") + f", {LEGS}, {FEW} SELECT legs.uid, kind, t_start, t_end, o_lat, o_lng, d_lat, d_lng, purpose, stop_id FROM legs JOIN few USING (uid) WHERE {WINDOW}")
def timeline_active_legs(spark, sf):
    return timeline.active_legs(_legs(spark, sf), views.SINCE, views.UNTIL, views.BOX, 20)


@query(
    common("stops") + f""", {LEGS}, hit AS (SELECT * FROM legs WHERE {WINDOW} AND least(o_lng, d_lng) <= 2.29 AND greatest(o_lng, d_lng) >= 2.26 AND least(o_lat, d_lat) <= 48.83 AND greatest(o_lat, d_lat) >= 48.80), few AS (SELECT DISTINCT uid FROM hit ORDER BY uid LIMIT 15)
 SELECT uid, kind, stop_id, t_start FROM hit JOIN few USING (uid)"""
)
def timeline_viewport_segments(spark, sf):
    return timeline.viewport_segments(_legs(spark, sf), views.SINCE, views.UNTIL, views.BOX, 15).select("uid", "kind", "stop_id", "t_start")


@query(
    common("stops", "pings", "profiles") + f""", {LEGS}, {FEW}, w AS (SELECT uid, event_id % 40 AS stop_id, event_id AS seq, mode FROM pings), p AS (SELECT uid, stop_id, count(*) AS k, arg_min(mode, seq) AS m FROM w GROUP BY ALL)
 SELECT legs.uid, kind, legs.stop_id, CASE kind WHEN 'dwell' THEN 'stay' ELSE coalesce(m, 'car') END AS mode, CASE kind WHEN 'leg' THEN coalesce(k, -1) ELSE -1 END AS waypoints, job FROM legs JOIN few USING (uid) LEFT JOIN p ON p.uid = legs.uid AND p.stop_id = legs.stop_id JOIN profiles q ON q.uid = legs.uid WHERE {WINDOW}"""
)
def timeline_legs_with_waypoints(spark, sf):
    legs = timeline.active_legs(_legs(spark, sf), views.SINCE, views.UNTIL, views.BOX, 20)
    w = views.pings(spark, sf).selectExpr("uid", "event_id % 40 AS stop_id", "event_id AS seq", "lat", "lng", "datetime AS t", "mode")
    full = timeline.with_waypoints(legs, w).join(views.profiles(spark, sf).select("uid", "job"), "uid")
    return full.select("uid", "kind", "stop_id", "mode", F.coalesce(F.size("waypoints"), F.lit(-1)).cast("long").alias("waypoints"), "job")


@query(common("stops") + " SELECT min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east FROM stops")
def timeline_bounds(spark, sf):
    return timeline.bounds(views.stops(spark, sf))


@query(common("stops") + " SELECT stop_id, arrival, departure, purpose FROM stops WHERE uid = 7 ORDER BY arrival")
def timeline_agent_trips(spark, sf):
    return timeline.agent_trips(views.stops(spark, sf), 7).select("stop_id", "arrival", "departure", "purpose")


@query(common("intervals") + " SELECT activity, count(*) AS n, min(seq) AS first_seq, round(sum(date_diff('microsecond', arrival, departure)) / 60000000.0, 4) AS minutes FROM intervals WHERE uid = 7 GROUP BY activity")
def timeline_stop_activities(spark, sf):
    a = timeline.stop_activities(views.intervals(spark, sf).withColumn("stop_id", F.col("activity")), 7)
    total = F.aggregate("activities", F.lit(0.0), lambda s, x: s + x.minutes)
    return a.select(F.col("stop_id").alias("activity"), F.size("activities").cast("long").alias("n"), F.get("activities", F.lit(0)).getField("seq").alias("first_seq"), F.round(total, 4).alias("minutes"))


@query(common("intervals") + ", t AS (SELECT median(arrival) AS t FROM (SELECT arrival FROM intervals WHERE uid = 7 ORDER BY arrival LIMIT 1)) SELECT uid, activity, seq FROM intervals, t WHERE uid = 7 AND arrival <= t AND departure >= t ORDER BY seq DESC LIMIT 1")
def timeline_activity_at(spark, sf):
    i = views.intervals(spark, sf)
    first = i.where("uid = 7").agg(F.min("arrival")).first()[0]
    return timeline.activity_at(i, 7, first).select("uid", "activity", "seq")


@query(
    common("stops") + """, s AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM stops WINDOW w AS (PARTITION BY uid ORDER BY arrival)), g AS (SELECT *, CAST(sum(CASE WHEN coalesce(lat = plat AND lng = plng, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY uid ORDER BY arrival) AS BIGINT) AS trip FROM s),
 p AS (SELECT uid, trip, purpose, row_number() OVER (PARTITION BY uid, trip ORDER BY count(*) DESC, min(arrival)) AS r FROM g GROUP BY uid, trip, purpose) SELECT g.uid, g.trip, any_value(p.purpose) AS purpose, count(*) AS n_stops, min(arrival) AS arrival, arg_max(departure, arrival) AS departure FROM g JOIN p ON p.uid = g.uid AND p.trip = g.trip AND p.r = 1 GROUP BY g.uid, g.trip"""
)
def timeline_merged_trips(spark, sf):
    return timeline.merged_trips(views.stops(spark, sf)).select("uid", "trip", "purpose", "n_stops", "arrival", "departure")


ENCOUNTER = """SELECT e.agent, e.contact, e.ts, s.stop_id FROM {e} e LEFT JOIN LATERAL (SELECT stop_id FROM stops t WHERE t.uid = e.contact AND epoch(t.arrival) <= e.ts AND epoch(t.departure) >= e.ts ORDER BY arrival DESC LIMIT 1) s ON TRUE"""


@query(common("stops", "encounters") + ", x AS (SELECT DISTINCT * FROM encounters) SELECT e.agent, e.contact, e.ts, CASE WHEN epoch(s.departure) >= e.ts THEN s.stop_id END AS stop_id FROM x e ASOF LEFT JOIN stops s ON s.uid = e.contact AND epoch(s.arrival) <= e.ts")
def timeline_encounter_stops(spark, sf):
    return timeline.encounter_stops(views.encounters(spark, sf), views.stops(spark, sf)).select("agent", "contact", "ts", "stop_id")


@query(common("stops", "encounters") + ", x AS (SELECT * FROM encounters WHERE agent = 7 ORDER BY ts DESC, contact LIMIT 20) " + ENCOUNTER.format(e="x"))
def timeline_recent_encounters(spark, sf):
    return timeline.recent_encounters(views.encounters(spark, sf), views.stops(spark, sf), 7).select("agent", "contact", "ts", "stop_id")


@query(common("encounters") + " SELECT CASE WHEN agent = 7 THEN contact ELSE agent END AS contact, count(*) AS encounters, max(ts) AS last_ts FROM encounters WHERE agent = 7 OR contact = 7 GROUP BY 1")
def timeline_encounter_counts(spark, sf):
    return timeline.encounter_counts(views.encounters(spark, sf), 7)


@query(common("encounters") + ", w AS (SELECT agent AS u, contact AS v, CAST(count(*) AS DOUBLE) AS weight FROM encounters GROUP BY ALL) SELECT v + 1 AS uid, weight, EXISTS (SELECT 1 FROM w b WHERE b.u = w.v AND b.v = 7) AS reciprocated FROM w WHERE u = 7")
def timeline_friends(spark, sf):
    w = views.encounters(spark, sf).groupBy(F.col("agent").alias("u"), F.col("contact").alias("v")).agg(F.count("*").cast("double").alias("weight"))
    return timeline.friends(w, 7)


def _crp(spark, sf):
    return views.table(spark, sf, "events").selectExpr("user_id % 10 AS agent", "concat('d', event_id % 30) AS diary_id", "CASE event_id % 2 WHEN 0 THEN 'wd' ELSE 'we' END AS day_type", "cast(event_id % 17 as double) / 17 AS sim", "event_id % 5 AS usage_count", "cast(0.5 as double) AS T_a", "cast(1.5 as double) AS alpha_a", "event_id")


CRP = "c AS (SELECT user_id % 10 AS agent, 'd' || CAST(event_id % 30 AS VARCHAR) AS diary_id, CASE event_id % 2 WHEN 0 THEN 'wd' ELSE 'we' END AS day_type, CAST(event_id % 17 AS DOUBLE) / 17 AS sim, event_id % 5 AS usage_count, event_id FROM events)"


@query(f"WITH {CRP} SELECT diary_id, usage_count, event_id FROM c WHERE agent = 3")
def timeline_crp_rows(spark, sf):
    return timeline.crp_rows(_crp(spark, sf), 3).select("diary_id", "usage_count", "event_id")


@query(
    f"WITH {CRP}, g AS (SELECT agent, day_type, diary_id, max(sim) AS sim, max(usage_count) AS n FROM c GROUP BY ALL), w AS (SELECT *, CASE WHEN n > 0 THEN n ELSE 1.5 END * exp(sim / 0.5) AS w FROM g), p AS (SELECT *, w / sum(w) OVER (PARTITION BY agent, day_type) AS p, row_number() OVER (PARTITION BY agent, day_type ORDER BY w DESC, diary_id) AS r FROM w) SELECT agent, day_type, diary_id, round(p, 9) AS probability FROM p WHERE r <= 10"
)
def timeline_next_diary(spark, sf):
    c = _crp(spark, sf).groupBy("agent", "day_type", "diary_id").agg(F.max("sim").alias("sim"), F.max("usage_count").alias("usage_count"), F.max("T_a").alias("T_a"), F.max("alpha_a").alias("alpha_a"))
    return timeline.next_diary(c).select("agent", "day_type", "diary_id", F.round("probability", 9).alias("probability"))


@query(common("stops") + f", {LEGS} SELECT chunk, count(*) AS n FROM (SELECT unnest(range(CAST(floor(floor(epoch(t_start)) / 21600) AS BIGINT), CAST(floor(floor(epoch(t_end)) / 21600) AS BIGINT) + 1)) AS chunk FROM legs) GROUP BY chunk")
def timeline_chunks(spark, sf):
    return timeline.chunks(_legs(spark, sf), 6).groupBy("chunk").agg(F.count("*").alias("n"))


@query(common("encounters", "profiles") + ", few AS (SELECT uid FROM profiles WHERE uid < 40) SELECT agent, contact, ts FROM encounters WHERE agent IN (SELECT uid FROM few) AND contact IN (SELECT uid FROM few)")
def timeline_induced_sample(spark, sf):
    e = views.encounters(spark, sf)
    few = views.profiles(spark, sf).where("uid < 40").select("uid")
    return timeline.induced(e, few, "agent", "contact").select("agent", "contact", "ts")


@query(common("pings") + f", c AS (SELECT {cell_sql(8)} AS cell, count(*) AS n FROM pings GROUP BY 1) SELECT cell, n, lower(to_hex(cell)) AS hex FROM c")
def sink_geojson_cells(spark, sf):
    c = views.pings(spark, sf).groupBy(geo.cell("lat", "lng", 8).alias("cell")).agg(F.count("*").alias("n"))
    f = io.features(c)
    return f.select("cell", F.get_json_object("feature", "$.properties.n").cast("long").alias("n"), F.get_json_object("feature", "$.properties.cell").alias("hex"))


# Routing ----------------------------------------------------------------------------------------------


def _segments(spark, sf):
    """A grid of roads between the test grid's points: a segment for each row and column."""
    line = lambda ids: F.array(*ids)
    point = lambda i, j, at: F.struct((i * 8 + j).cast("long").alias("id"), at.cast("double").alias("at"), (48.80 + i * 0.01).cast("double").alias("lat"), (2.25 + j * 0.01).cast("double").alias("lng"))
    n = F.col("id")
    row = spark.range(5).select(F.concat(F.lit("r"), n).alias("segment_id"), F.lit("primary").alias("class"), line([point(n, F.lit(j), F.lit(j / 7)) for j in range(8)]).alias("connectors"))
    col = spark.range(8).select(F.concat(F.lit("c"), n).alias("segment_id"), F.lit("residential").alias("class"), line([point(F.lit(i), n, F.lit(i / 4)) for i in range(5)]).alias("connectors"))
    return row.unionByName(col).withColumn("access_restrictions", F.when(F.col("segment_id") == "r2", F.array(F.struct(F.lit("denied").alias("access"), F.lit("backward").alias("heading")))))


ROADS = f"""WITH p AS (SELECT i, j, CAST(48.80 + i * 0.01 AS DOUBLE) AS lat, CAST(2.25 + j * 0.01 AS DOUBLE) AS lng FROM range(5) a(i), range(8) b(j)), e AS (SELECT a.i * 8 + a.j AS x, b.i * 8 + b.j AS y, 'primary' AS class, a.i, {hav('a.lat', 'a.lng', 'b.lat', 'b.lng').replace('6371.0088', '6371000.0')} AS m FROM p a JOIN p b ON b.i = a.i AND b.j = a.j + 1
 UNION ALL SELECT a.i * 8 + a.j, b.i * 8 + b.j, 'residential', -1, {hav('a.lat', 'a.lng', 'b.lat', 'b.lng').replace('6371.0088', '6371000.0')} FROM p a JOIN p b ON b.j = a.j AND b.i = a.i + 1), d AS (SELECT x AS from_node, y AS to_node, class, m FROM e UNION ALL SELECT y, x, class, m FROM e WHERE i <> 2)"""
DECI = "CAST(greatest(1, round(m / (CASE class WHEN 'primary' THEN 56.0 ELSE 24.0 END / 3.6) * 10)) AS BIGINT)"
#: The fastest paths between all nodes, of equally fast ones the shortest, round by round.
PATHS = (
    ROADS.replace("WITH", "WITH RECURSIVE", 1) + f""", l AS (SELECT from_node AS x, to_node AS y, min({{{{'w': {DECI}, 'm': m}}}}) AS s FROM d GROUP BY ALL),
 r(k, a, b, s) AS (SELECT 0, i, i, {{{{'w': 0::BIGINT, 'm': 0.0::DOUBLE}}}} FROM range(40) t(i) UNION ALL SELECT k + 1, a, b, min(s) FROM (SELECT k, a, b, s FROM r UNION ALL SELECT r.k, r.a, l.y, {{{{'w': r.s.w + l.s.w, 'm': r.s.m + l.s.m}}}} FROM r JOIN l ON l.x = r.b) WHERE k < 40 GROUP BY k, a, b),
 best AS (SELECT a, b, s.m AS metres FROM r WHERE k = 40)"""
).replace("{{", "{").replace("}}", "}")


@query(
    f"""{ROADS}
 SELECT from_node, to_node, class, round(m, 4) AS length_m, CAST(greatest(1, round(m / (CASE class WHEN 'primary' THEN 56.0 ELSE 24.0 END / 3.6) * 10)) AS BIGINT) AS weight_ds FROM d"""
)
def routing_road_edges(spark, sf):
    return routing.edges(_segments(spark, sf)).select("from_node", "to_node", "class", F.round("length_m", 4).alias("length_m"), "weight_ds")


PAIRS = "p2 AS (SELECT DISTINCT loc % 40 AS a, (loc * 7 + uid) % 40 AS b FROM pings)"
ASKED = PATHS + ", " + common("pings").removeprefix("WITH ") + f", {PAIRS} SELECT p2.a, p2.b, round(coalesce(metres, 0), 3) AS metres, metres IS NOT NULL AS connected FROM p2 LEFT JOIN best ON best.a = p2.a AND best.b = p2.b"


def _pairs(spark, sf):
    return views.pings(spark, sf).select((F.col("loc") % 40).alias("a"), ((F.col("loc") * 7 + F.col("uid")) % 40).alias("b"))


@query(ASKED)
def routing_paths_by_joins(spark, sf):
    """The way that is left where no task can hold the graph."""
    return routing.shortest(routing.edges(_segments(spark, sf)), _pairs(spark, sf), limit_mb=0).select("a", "b", F.round("metres", 3).alias("metres"), "connected")


@query(ASKED)
def routing_shortest_paths(spark, sf):
    pairs = _pairs(spark, sf)
    return routing.shortest(routing.edges(_segments(spark, sf)), pairs).select("a", "b", F.round("metres", 3).alias("metres"), "connected")


@query(
    PATHS + ", " + common("pings").removeprefix("WITH ") + """, j AS (SELECT uid, loc AS b, lag(loc) OVER (PARTITION BY uid ORDER BY datetime) AS a FROM pings)
 SELECT uid, count(*) AS n, round(sum(metres) / 1000, 3) AS km, count(*) AS routed FROM j JOIN best USING (a, b) GROUP BY uid"""
)
def routing_road_jumps(spark, sf):
    s = _segments(spark, sf)
    j = routing.road_jumps(views.pings(spark, sf).select("uid", "datetime", "lat", "lng"), routing.nodes(s), routing.edges(s))
    return j.groupBy("uid").agg(F.count("*").alias("n"), F.round(F.sum("jump_km"), 3).alias("km"), F.count_if("routed").alias("routed"))


# Streams -------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_counts(spark, sf):
    return twins.drained(spark, twins.hourly_counts(twins.events(spark, sf)), "complete")


@query(
    """SELECT user_id, s AS first_at, max(ts) AS last_at, count(*) AS n FROM (SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id, k) AS s FROM (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT user_id, ts,
 CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events))) GROUP BY user_id, s"""
)
def stream_sessions(spark, sf):
    return twins.drained(spark, twins.sessions(twins.events(spark, sf), "6 hours"), "complete")


@query(common("pings") + " SELECT uid, count(*) AS stays FROM (SELECT uid, loc = lag(loc) OVER (PARTITION BY uid ORDER BY datetime) AS same FROM pings) WHERE NOT coalesce(same, FALSE) GROUP BY uid")
def stream_stays(spark, sf):
    return twins.stays(spark, sf)


# Generation ------------------------------------------------------------------------------------------------


DIARIES = f"""WITH RECURSIVE {CRP}, bank AS (SELECT agent, day_type, diary_id, max(sim) AS sim FROM c GROUP BY ALL), top AS (SELECT agent, day_type, max(sim) AS top FROM bank GROUP BY ALL),
 r(agent, day, pick, used) AS (SELECT DISTINCT agent, -1, NULL::VARCHAR, []::VARCHAR[] FROM bank UNION ALL SELECT agent, day, pick, list_append(used, pick) FROM (SELECT agent, day, any_value(used) AS used, arg_min(diary_id, run) FILTER (WHERE run > u * total) AS pick FROM (SELECT *, sum(w) OVER (PARTITION BY agent ORDER BY diary_id) AS run, sum(w) OVER (PARTITION BY agent) AS total, {draw(42, 'agent', 'day')} AS u FROM
  (SELECT *, CASE WHEN n > 0 THEN n ELSE 1.5 / greatest(1, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY agent)) END * exp((sim - top) / 0.5) AS w FROM (SELECT r.agent, r.day + 1 AS day, r.used, b.diary_id, b.sim, t.top, len(list_filter(r.used, lambda x: x = b.diary_id)) AS n
   FROM r JOIN bank b ON b.agent = r.agent AND b.day_type = CASE WHEN (r.day + 1) % 7 >= 5 THEN 'we' ELSE 'wd' END JOIN top t ON t.agent = b.agent AND t.day_type = b.day_type WHERE r.day < 13))) GROUP BY agent, day))"""


@query(DIARIES + " SELECT agent, CAST(day AS BIGINT) AS day, CASE WHEN day % 7 >= 5 THEN 'we' ELSE 'wd' END AS day_type, pick AS diary_id FROM r WHERE day >= 0")
def simulate_diary_choice(spark, sf):
    c = _crp(spark, sf).groupBy("agent", "day_type", "diary_id").agg(F.max("sim").alias("sim"), F.max("T_a").alias("T_a"), F.max("alpha_a").alias("alpha_a"))
    return simulate.choose_diaries(c, 14)


TRAILS = (
    common("pings").replace("WITH", "WITH RECURSIVE", 1) + f""", pl AS (SELECT row_number() OVER (ORDER BY loc) - 1 AS i, loc, lat, lng, CAST(count(*) AS DOUBLE) AS mass FROM pings GROUP BY loc, lat, lng), m AS (SELECT *, sum(mass) OVER (ORDER BY i) AS run, sum(mass) OVER () AS total FROM pl), a AS (SELECT id + 1 AS uid FROM range(60) t(id)),
 r(uid, step, here, seen) AS (SELECT uid, 0, arg_min(i, run), [arg_min(i, run)] FROM a JOIN m ON run > total * {draw(42, 'uid', '-1')} GROUP BY uid
 UNION ALL SELECT uid, step + 1, pick, list_append(seen, pick) FROM (SELECT uid, step, any_value(seen) AS seen, arg_min(i, run) FILTER (WHERE w > 0 AND run > total * u) AS pick FROM (SELECT *, sum(w) OVER (PARTITION BY uid ORDER BY i) AS run, sum(w) OVER (PARTITION BY uid) AS total, {draw(42, 'uid', 'step', '1')} AS u FROM
  (SELECT *, CASE WHEN {draw(42, 'uid', 'step', '0')} < 0.6 * pow(known, -0.21) AND known < (SELECT count(*) FROM pl) THEN CASE WHEN n = 0 THEN mass * pow(greatest(d, 0.001), -2.0) ELSE 0 END ELSE n END AS w
   FROM (SELECT r.uid, r.step, r.seen, p.i, p.mass, len(list_filter(r.seen, lambda x: x = p.i)) AS n, len(list_distinct(r.seen)) AS known, {hav('q.lat', 'q.lng', 'p.lat', 'p.lng')} AS d FROM r JOIN pl q ON q.i = r.here CROSS JOIN pl p WHERE r.step < 47))) GROUP BY uid, step))"""
)


@query(TRAILS + " SELECT uid, CAST(step AS BIGINT) AS step, loc AS place, round(lat, 9) AS lat, round(lng, 9) AS lng FROM r JOIN pl ON pl.i = r.here")
def simulate_trajectories(spark, sf):
    places = views.pings(spark, sf).groupBy("loc", "lat", "lng").agg(F.count("*").cast("double").alias("relevance"))
    return simulate.explore_and_return(spark, places, agents=60, steps=48).select("uid", "step", "place", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"))


@query("SELECT user_id % 3 AS dataset, event_type AS variant, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM events GROUP BY ALL")
def simulate_ablation_summary(spark, sf):
    e = views.table(spark, sf, "events").select((F.col("user_id") % 3).alias("dataset"), F.col("event_type").alias("variant"), "value")
    s = simulate.ablation_summary(e, "value")
    return s.select("dataset", "variant", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


ACTS = ", ".join(f"({i}, '{a}', {mu}::DOUBLE, {sd}::DOUBLE, {list(ok)}::BIGINT[])" for i, (a, mu, sd, ok) in enumerate(simulate.ACTIVITIES) if a not in ("commute", "travel"))
_U = [draw(47, "uid", "stop_id", "seq", str(k)) for k in range(3)]
CHAINS = (
    common("stops").replace("WITH", "WITH RECURSIVE", 1) + f""", acts AS (SELECT * FROM (VALUES {ACTS}) t(i, activity, mu, sd, ok)), st AS (SELECT uid, stop_id, arrival, departure, CASE purpose WHEN 'HOME' THEN 0 WHEN 'WORK' THEN 1 ELSE 2 END AS kind, row_number() OVER (PARTITION BY uid ORDER BY arrival, stop_id) AS k FROM stops WHERE arrival < departure),
 r(uid, k, stop_id, seq, activity, beg, fin, dep, done) AS (SELECT DISTINCT uid, 0::BIGINT, -1::BIGINT, -1::BIGINT, NULL::VARCHAR, NULL::TIMESTAMP, NULL::TIMESTAMP, NULL::TIMESTAMP, []::INTEGER[] FROM st
 UNION ALL SELECT uid, k, stop_id, seq, activity, beg, least(departure, beg + to_seconds(CAST(round(greatest(exp(mu + sd * sqrt(-2 * ln({_U[1]})) * cos(6.283185307179586 * {_U[2]})), 1 / 60.0) * 3600) AS BIGINT))), departure, list_append(done, i) FROM
 (SELECT uid, k, stop_id, seq, beg, departure, any_value(done) AS done, arg_min(i, run) FILTER (WHERE hit) AS i, arg_min(activity, run) FILTER (WHERE hit) AS activity, arg_min(mu, run) FILTER (WHERE hit) AS mu, arg_min(sd, run) FILTER (WHERE hit) AS sd FROM (SELECT *, run > {_U[0]} * total AS hit FROM
  (SELECT *, sum(w) OVER (PARTITION BY uid ORDER BY i) AS run, sum(w) OVER (PARTITION BY uid) AS total FROM (SELECT n.*, a.i, a.activity, a.mu, a.sd, len(list_filter(n.done, lambda x: x = a.i)) + 1.0::DOUBLE / count(*) OVER (PARTITION BY n.uid) AS w FROM
   (SELECT r.uid, st.k, st.stop_id, CASE WHEN st.k = r.k THEN r.seq + 1 ELSE 0 END AS seq, CASE WHEN st.k = r.k THEN r.fin ELSE st.arrival END AS beg, st.departure, st.kind, r.done FROM r JOIN st ON st.uid = r.uid AND st.k = CASE WHEN r.fin < r.dep THEN r.k ELSE r.k + 1 END) n JOIN acts a ON list_contains(a.ok, n.kind)))) GROUP BY uid, k, stop_id, seq, beg, departure))"""
)


@query(CHAINS + " SELECT uid, stop_id, seq, activity, beg AS arrival, fin AS departure FROM r WHERE seq >= 0")
def simulate_micro_activities(spark, sf):
    m = simulate.micro_activities(views.stops(spark, sf))
    return m.select("uid", "stop_id", F.col("seq").cast("long").alias("seq"), "activity", "arrival", "departure")


@query(
    common("encounters") + """, c AS (SELECT least(agent, contact) AS u, greatest(agent, contact) AS v, ts // 86400 AS day FROM encounters WHERE agent <> contact), m AS (SELECT u, v, count(DISTINCT day) AS met FROM c GROUP BY ALL), t AS (SELECT DISTINCT user_id AS u, user_id + 1 + user_id % 12 AS v, CAST(user_id % 11 AS DOUBLE) / 10 AS strength FROM events),
 j AS (SELECT u, v, coalesce(strength, 0) AS s, coalesce(met, 0) AS met FROM t FULL JOIN m USING (u, v)), n AS (SELECT u, v, CASE WHEN s = 0 THEN CASE WHEN met / 30 >= 0.2 THEN 0.2 * met / 30 END ELSE least(1.0, greatest(0.0, s + 0.2 * met / 30 - CASE WHEN met = 0 THEN 0.05 ELSE 0 END)) END AS strength FROM j) SELECT u, v, round(strength, 9) AS strength FROM n WHERE strength > 0"""
)
def simulate_new_friendships(spark, sf):
    """Ties that grow, fade, are clipped at one, begin, or stay away."""
    e = views.encounters(spark, sf).where("agent <> contact").selectExpr("least(agent, contact) AS u", "greatest(agent, contact) AS v", "ts div 86400 AS day")
    ties = views.table(spark, sf, "events").selectExpr("user_id AS u", "user_id + 1 + user_id % 12 AS v", "cast(user_id % 11 as double) / 10 AS strength").distinct()
    return simulate.updated_friendships(ties, e, regularity=0.2, days=30).select("u", "v", F.round("strength", 9).alias("strength"))


@query(
    common("stops", "intervals", "encounters", "profiles") + """, x AS (SELECT * FROM encounters WHERE agent = 7 ORDER BY ts DESC, contact LIMIT 20), m AS (""" + ENCOUNTER.format(e="x") + """)
 SELECT uid, gender, job, (SELECT string_agg(stop_id || ':' || purpose, ',' ORDER BY arrival) FROM stops WHERE uid = 7) AS trips, (SELECT string_agg(seq || ':' || activity, ',' ORDER BY seq) FROM intervals WHERE uid = 7) AS activities,
 (SELECT string_agg(ts || ':' || contact || ':' || coalesce(CAST(stop_id AS VARCHAR), '-'), ',' ORDER BY ts DESC, contact DESC, stop_id DESC) FROM m) AS encounters FROM profiles WHERE uid = 7"""
)
def timeline_agent_detail(spark, sf):
    d = timeline.agent_detail(views.stops(spark, sf), views.intervals(spark, sf), views.encounters(spark, sf), views.profiles(spark, sf), 7)
    text = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields])), ",").alias(c)
    return d.select("uid", "gender", "job", text("trips", "stop_id", "purpose"), text("activities", "seq", "activity"), text("encounters", "ts", "contact", "stop_id"))


@query()
def report_all_sections(spark, sf):
    p = views.pings(spark, sf).withColumnRenamed("loc", "location_id").drop("event_id", "value")
    rest = tuple(x for x in compare.SECTIONS if x != "stvd")  # that section is a query of its own
    rows, _ = compare.report(p.where("side = 0").drop("side"), p.where("side = 1").drop("side"), rest, index=geo)
    return rows.select("filter_key", "metric_name", F.round("value", 6).alias("value"), "unit")


@query()
def report_stvd_by_filter(spark, sf):
    p = views.pings(spark, sf).withColumnRenamed("loc", "location_id").drop("event_id", "value")
    rows, _ = compare.report(p.where("side = 0").drop("side"), p.where("side = 1").drop("side"), ("stvd",), index=geo)
    return rows.select("filter_key", "metric_name", F.round("value", 6).alias("value"), "unit")


@query(
    f"SELECT 'all' AS filter_key, 'cpc_' || res AS metric_name, cpc AS value, CAST(NULL AS VARCHAR) AS unit FROM ({mobility.ORACLE['od_common_part_of_commuters']}) UNION ALL SELECT 'all', 'jsd_activity', jsd, NULL FROM ({mobility.ORACLE['distance_jensen_shannon_activity']})"
    f" UNION ALL SELECT 'all', 'jsd_transitions', jsd, NULL FROM ({behaviour.ORACLE['activity_transition_divergence']}) UNION ALL SELECT 'all', 'jsd_daily_profile', jsd, NULL FROM ({behaviour.ORACLE['activity_daily_profile_divergence']})"
    f" UNION ALL SELECT 'all', 'jsd_motifs', jsd, NULL FROM ({behaviour.ORACLE['motif_divergence']})"
)
def report_divergence_sections(spark, sf):
    p = views.pings(spark, sf).withColumnRenamed("loc", "location_id").drop("event_id", "value")
    rows, _ = compare.report(p.where("side = 0").drop("side"), p.where("side = 1").drop("side"), ("cpc", "activity", "motifs"), index=geo)
    return rows.where("filter_key = 'all'").select("filter_key", "metric_name", F.round("value", 9).alias("value"), "unit")


@query(f"WITH r AS (SELECT unnest(range(CAST(floor((48.80 + 90) * 64) AS BIGINT), CAST(floor((48.86 + 90) * 64) AS BIGINT) + 1)) AS y), c AS (SELECT unnest(range(CAST(floor((2.25 + 180) * 64) AS BIGINT), CAST(floor((2.33 + 180) * 64) AS BIGINT) + 1)) AS x), t AS (SELECT {7 << 52} + y * {1 << 26} + x AS tile_id, (y + 0.5) / 64 - 90 AS lat, (x + 0.5) / 64 - 180 AS lng FROM r, c), " + common("pings").removeprefix("WITH ") + f", n AS (SELECT {cell_sql(7)} AS tile_id, count(*) AS k FROM pings GROUP BY 1) SELECT CAST(tile_id AS BIGINT) AS tile_id, round(lat, 9) AS lat, round(lng, 9) AS lng, coalesce(k, 0) AS total_poi_count FROM t LEFT JOIN n USING (tile_id) WHERE lat BETWEEN 48.80 AND 48.86 AND lng BETWEEN 2.25 AND 2.33")
def tessellation_cover(spark, sf):
    t = tessellation.with_counts(tessellation.cover(spark, (2.25, 48.80, 2.33, 48.86), 7), views.pings(spark, sf), 7)
    return t.select("tile_id", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"), "total_poi_count")


FILTERS = "k AS (SELECT side, purpose, unnest(list_filter(['all', CASE WHEN isodow(datetime) < 6 THEN 'weekday' ELSE 'weekend' END, CASE WHEN hour(datetime) < 6 THEN 'night' WHEN hour(datetime) < 12 THEN 'morning' WHEN hour(datetime) < 18 THEN 'afternoon' ELSE 'evening' END], lambda x: TRUE)) AS filter_key FROM pings)"


@query(
    common("pings") + f""", {FILTERS}, n AS (SELECT filter_key, purpose, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS o FROM k GROUP BY ALL), p AS (SELECT filter_key, s / sum(s) OVER w AS p, o / sum(o) OVER w AS q FROM n WINDOW w AS (PARTITION BY filter_key))
 SELECT filter_key, round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 9) AS value FROM p GROUP BY filter_key"""
)
def report_activity_by_filter(spark, sf):
    p = views.pings(spark, sf).withColumnRenamed("loc", "location_id").drop("event_id", "value")
    rows, _ = compare.report(p.where("side = 0").drop("side"), p.where("side = 1").drop("side"), ("activity",))
    return rows.where("metric_name = 'jsd_activity'").select("filter_key", F.round("value", 9).alias("value"))


def _both(spark, sf):
    return behaviour._visits(spark, sf, 0), behaviour._visits(spark, sf, 1)


@query(common("pings") + ", n AS (SELECT purpose, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS o FROM pings GROUP BY 1) SELECT purpose, round(100.0 * s / sum(s) OVER (), 2) AS synthetic, round(100.0 * o / sum(o) OVER (), 2) AS observed FROM n")
def report_purpose_bars(spark, sf):
    return compare.activity_block(*_both(spark, sf))["purpose"]


DIFFERENCE = """, d AS (SELECT {k}, coalesce(o.pct, 0) - coalesce(s.pct, 0) AS d FROM s FULL JOIN o USING ({k})) SELECT {k}, round(d, 3) AS diff, round(greatest((SELECT max(abs(d)) FROM d), 1.0), 6) AS bound FROM d"""


@query(common("visits") + "".join(f", {n} AS (SELECT a, b, 100.0 * n / sum(n) OVER () AS pct FROM ({behaviour.TRANSITIONS.format(where=f'WHERE side = {i}')}))" for i, n in enumerate("so")) + DIFFERENCE.format(k="a, b"))
def report_transition_difference(spark, sf):
    return compare.activity_block(*_both(spark, sf))["transition"].withColumn("bound", F.round("bound", 6))


@query(common("visits") + "".join(f", {n} AS (SELECT activity, bin, 100.0 * seconds / sum(seconds) OVER (PARTITION BY bin) AS pct FROM ({behaviour._bins('visits', 'purpose', 60, f'AND side = {i}')}))" for i, n in enumerate("so")) + DIFFERENCE.format(k="activity, bin"))
def report_daily_difference(spark, sf):
    return compare.activity_block(*_both(spark, sf))["daily"].withColumn("bound", F.round("bound", 6))


@query()
def report_profile_boxes(spark, sf):
    b = compare.profiles_block(*_both(spark, sf), minutes=60)["box"]
    return b.select("metric", "dataset", "profile", *[F.round(c, 6).alias(c) for c in ("least", "q1", "median", "q3", "most")])


TILES_9 = f"r AS (SELECT unnest(range(CAST(floor((48.80 + 90) * 256) AS BIGINT), CAST(floor((48.86 + 90) * 256) AS BIGINT) + 1)) AS y), c AS (SELECT unnest(range(CAST(floor((2.25 + 180) * 256) AS BIGINT), CAST(floor((2.33 + 180) * 256) AS BIGINT) + 1)) AS x), t AS (SELECT CAST({9 << 52} + y * {1 << 26} + x AS BIGINT) AS tile_id, (y + 0.5) / 256 - 90 AS lat, (x + 0.5) / 256 - 180 AS lng FROM r, c)"


@query(
    common("pings") + f""", {TILES_9}, n AS (SELECT {cell_sql(9)} AS tile_id, count(*) AS k FROM pings GROUP BY 1), w AS (SELECT t.*, CAST(round(1.0::DOUBLE / (1 + coalesce(k, 0)) * 1e9) AS BIGINT) AS w FROM t LEFT JOIN n USING (tile_id) WHERE lat BETWEEN 48.80 AND 48.86 AND lng BETWEEN 2.25 AND 2.33),
 cum AS (SELECT *, sum(w) OVER (ORDER BY tile_id) AS upto, sum(w) OVER () AS total FROM w), drawn AS (SELECT id AS anchor FROM range((SELECT count(*) FROM pings)) r(id))
 SELECT anchor, tile_id, round(lat + ({draw(43, 'anchor')} - 0.5) * 2 * 0.4 / 256, 9) AS lat, round(lng + ({draw(44, 'anchor')} - 0.5) * 2 * 0.4 / 256, 9) AS lng FROM drawn JOIN cum ON floor({draw(42, 'anchor')} * total) >= upto - w AND floor({draw(42, 'anchor')} * total) < upto"""
)
def tessellation_home_anchors(spark, sf):
    """As many anchors as there are pings: far more than tiles."""
    p = views.pings(spark, sf)
    t = tessellation.with_counts(tessellation.cover(spark, (2.25, 48.80, 2.33, 48.86), 9), p, 9)
    return tessellation.home_anchors(t, p.count()).select("anchor", "tile_id", F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"))


@query(common("pings") + f", n AS (SELECT {cell_sql(7)} AS tile_id, count(*) AS total_poi_count FROM pings GROUP BY 1) SELECT tile_id, total_poi_count, CAST(NULL AS BIGINT) AS anchor FROM n UNION ALL SELECT -1 - id, NULL, id FROM range(3) t(id)")
def set_appended_anchors(spark, sf):
    """Anchors appended to the tiles: each side lacks a column of the other."""
    n = views.pings(spark, sf).groupBy(geo.cell("lat", "lng", 7).alias("tile_id")).agg(F.count("*").alias("total_poi_count"))
    a = spark.range(3).select((-1 - F.col("id")).alias("tile_id"), F.col("id").alias("anchor"))
    return n.unionByName(a, allowMissingColumns=True)


NEAR = ", ".join(str(i * (1 << 26) + j) for i in (-1, 0, 1) for j in (-1, 0, 1))


@query(
    common("pings") + f""", h AS (SELECT uid, arg_min(c, datetime) AS home, arg_max(c, datetime) AS work FROM (SELECT *, {cell_sql(7)} AS c FROM pings) GROUP BY uid), a AS (SELECT *, least(greatest(round(exp(1.5 + 0.6 * {normal(42, 'uid')})), 1), 30) AS want FROM h),
 n AS (SELECT a.uid AS src, b.uid AS dst, want, CASE WHEN a.work = b.work THEN 2.0 ELSE 1.0 END AS weight FROM a JOIN h b ON b.home - a.home IN ({NEAR}) AND a.uid <> b.uid), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ln(weight) - ln(-ln({draw(43, 'src', 'dst')})) DESC, dst) AS draw FROM n)
 SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM r WHERE draw <= want"""
)
def social_friendships(spark, sf):
    p = views.pings(spark, sf).groupBy("uid").agg(F.min_by(F.struct("lat", "lng"), "datetime").alias("h"), F.max_by(F.struct("lat", "lng"), "datetime").alias("w"))
    return tessellation.friendships(p.select("uid", geo.cell("h.lat", "h.lng", 7).alias("home"), geo.cell("w.lat", "w.lng", 7).alias("work")))


@query(
    common("pings") + f""" SELECT event_id, purpose AS p, round({hav('lat', 'lng', '48.83', '2.27')}, 6) AS km, {cell_sql(8)} AS cell, round((floor((lat + 90) * 128) + 0.5) / 128 - 90, 9) AS c_lat, round((floor((lng + 180) * 128) + 0.5) / 128 - 180, 9) AS c_lng FROM pings"""
)
def sql_registered_functions(spark, sf):
    from ..functions.register import register

    register(spark)
    views.pings(spark, sf).createOrReplaceTempView("pings_sql")
    return spark.sql("SELECT event_id, purpose_of(purpose) AS p, round(haversine_km(lat, lng, 48.83D, 2.27D), 6) AS km, cell_id(lat, lng, 8) AS cell, round(cell_lat(cell_id(lat, lng, 8)), 9) AS c_lat, round(cell_lng(cell_id(lat, lng, 8)), 9) AS c_lng FROM pings_sql")


@query(behaviour.WITH_MOTIFS + " SELECT uid, day, motif FROM m")
def sql_motif_function(spark, sf):
    from ..functions.register import register

    register(spark)
    behaviour._visits(spark, sf).createOrReplaceTempView("visits_sql")
    return spark.sql("SELECT uid, day, motif_id(transform(array_sort(collect_list(struct(s, node))), x -> x.node)) AS motif FROM (SELECT uid, cast(start_timestamp AS date) AS day, start_timestamp AS s, concat_ws('_', location_id, if(purpose = 'HOME', 'HOME', 'VISIT')) AS node FROM visits_sql) GROUP BY uid, day")


@query(common("intervals") + f", {behaviour.SEGMENTS} SELECT uid, activity, CAST(day AS DATE) AS day, a AS seg_start, b AS seg_end FROM seg")
def sql_midnight_function(spark, sf):
    from ..functions.register import register

    register(spark)
    views.intervals(spark, sf).createOrReplaceTempView("intervals_sql")
    return spark.sql("SELECT uid, activity, m.day, m.seg_start, m.seg_end FROM intervals_sql, LATERAL split_midnight(arrival, departure) m")


QUERIES, ORACLE = query.queries, query.oracle
