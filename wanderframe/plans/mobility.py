"""Trajectories, flows, densities and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..operators import distance, od, traj, transport
from . import views
from .registry import Registry
from .views import common

query = Registry()
HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


def hav(a: str, c: str, b: str, d: str) -> str:
    """SQL of the distance in km from (a, c) to (b, d), latitudes first."""
    return HAV.format(a=a, b=b, c=c, d=d)


def cell_sql(res: int, lat: str = "lat", lng: str = "lng") -> str:
    n = 2 ** (res - 1)
    return f"(CAST({res << 52} AS BIGINT) + CAST(floor(({lat} + 90.0) * {n}) AS BIGINT) * {1 << 26} + CAST(floor(({lng} + 180.0) * {n}) AS BIGINT))"


STAYS = """SELECT uid, datetime, lat, lng, side, purpose, value FROM (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM pings WINDOW w AS (PARTITION BY uid ORDER BY datetime))
 WHERE NOT coalesce(lat = plat AND lng = plng, FALSE)"""
JUMPS = f"SELECT uid, datetime, side, {hav('plat', 'plng', 'lat', 'lng')} AS jump_km FROM (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM pings WINDOW w AS (PARTITION BY uid ORDER BY datetime)) WHERE plat IS NOT NULL AND NOT (lat = plat AND lng = plng)"


@query(common("pings") + f", s AS ({STAYS}) SELECT uid, datetime, lat, lng FROM s")
def traj_collapse_to_stays(spark, sf):
    return traj.collapse_to_stays(views.pings(spark, sf)).select("uid", "datetime", "lat", "lng")


@query(common("pings") + " SELECT round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 9) AS share FROM (SELECT loc = lag(loc) OVER w AS same, row_number() OVER w AS n FROM pings WINDOW w AS (PARTITION BY uid ORDER BY datetime)) WHERE n > 1")
def traj_panel_share(spark, sf):
    return traj.panel_share(views.pings(spark, sf), "loc").select(F.round("share", 9).alias("share"))


@query(common("pings") + f", j AS ({JUMPS}) SELECT uid, datetime, round(jump_km, 6) AS jump_km FROM j")
def traj_jump_lengths(spark, sf):
    return traj.jump_lengths(views.pings(spark, sf)).select("uid", "datetime", F.round("jump_km", 6).alias("jump_km"))


@query(common("pings") + f" SELECT uid, round(sqrt(avg(d * d)), 6) AS rog_km FROM (SELECT uid, {hav('lat', 'lng', 'mlat', 'mlng')} AS d FROM (SELECT *, avg(lat) OVER (PARTITION BY uid) AS mlat, avg(lng) OVER (PARTITION BY uid) AS mlng FROM pings)) GROUP BY uid")
def traj_radius_of_gyration(spark, sf):
    return traj.radius_of_gyration(views.pings(spark, sf)).select("uid", F.round("rog_km", 6).alias("rog_km"))


@query(common("pings") + " SELECT uid, datetime, round(us / 60000000.0, 4) AS wait_minutes FROM (SELECT uid, datetime, date_diff('microsecond', lag(datetime) OVER (PARTITION BY uid ORDER BY datetime), datetime) AS us FROM pings) WHERE us IS NOT NULL")
def traj_waiting_times(spark, sf):
    return traj.waiting_times(views.pings(spark, sf)).select("uid", "datetime", F.round("wait_minutes", 4).alias("wait_minutes"))


@query(common("pings") + f", s AS ({STAYS}) SELECT uid, count(*) AS visits FROM s GROUP BY uid")
def traj_visits_per_user(spark, sf):
    return traj.visits_per_user(views.pings(spark, sf))


@query(common("pings") + f", j AS ({JUMPS}) SELECT uid, count(*) AS n, round(sum(jump_km / 50 * 60), 4) AS minutes FROM j GROUP BY uid")
def traj_trip_minutes_proxy(spark, sf):
    return traj.trip_minutes(views.pings(spark, sf)).groupBy("uid").agg(F.count("*").alias("n"), F.round(F.sum("minutes"), 4).alias("minutes"))


@query(common("pings") + " SELECT uid, count(*) AS n, round(sum(value), 4) AS minutes FROM pings WHERE value >= 0 GROUP BY uid")
def traj_dwell_minutes_column(spark, sf):
    return traj.dwell_minutes(views.pings(spark, sf), "value").groupBy("uid").agg(F.count("*").alias("n"), F.round(F.sum("minutes"), 4).alias("minutes"))


@query(common("visits") + " SELECT uid, start_timestamp, end_timestamp, location_id, purpose FROM visits")
def traj_visits(spark, sf):
    return traj.visits(views.pings(spark, sf), "loc", None, "purpose")


ANCHORS = """h AS (SELECT uid, location_id AS home FROM (SELECT uid, location_id, row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, location_id) AS r FROM visits WHERE hour(start_timestamp) BETWEEN 2 AND 5 GROUP BY uid, location_id) WHERE r = 1),
 k AS (SELECT uid, location_id AS work FROM (SELECT uid, location_id, row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, location_id) AS r FROM (SELECT v.* FROM visits v LEFT JOIN h USING (uid)
 WHERE (hour(start_timestamp) = 10 OR hour(start_timestamp) BETWEEN 14 AND 16) AND (home IS NULL OR location_id <> home)) GROUP BY uid, location_id) WHERE r = 1)"""


@query(common("visits") + f", {ANCHORS} SELECT uid, home, work FROM h FULL OUTER JOIN k USING (uid)")
def traj_home_work_anchors(spark, sf):
    return traj.anchors(traj.visits(views.pings(spark, sf), "loc"))


@query(common("visits") + f", {ANCHORS} SELECT uid, start_timestamp, CASE WHEN location_id = home THEN 'HOME' WHEN location_id = work THEN 'WORK' ELSE 'OTHER' END AS purpose FROM visits LEFT JOIN h USING (uid) LEFT JOIN k USING (uid)")
def traj_heuristic_purposes(spark, sf):
    v, _ = traj.activity_visits(views.pings(spark, sf), "loc")
    return v.select("uid", "start_timestamp", "purpose")


@query("SELECT upper(trim(event_type)) IN ('HOME', 'WORK') AS known, CASE WHEN upper(trim(event_type)) IN ('HOME', 'WORK') THEN upper(trim(event_type)) ELSE 'OTHER' END AS purpose, count(*) AS n FROM events GROUP BY ALL")
def traj_purpose_collapse(spark, sf):
    e = views.table(spark, sf, "events").withColumn("purpose", scalar.purpose("event_type"))
    return e.groupBy((F.col("purpose") != "OTHER").alias("known"), "purpose").agg(F.count("*").alias("n"))


# Transport ---------------------------------------------------------------------------------------


@query(
    common("pings") + f""", o AS (SELECT CASE side WHEN 0 THEN 'synthetic' ELSE 'observed' END AS source, mode, {hav('plat', 'plng', 'lat', 'lng')} AS km, us / 60000000.0 AS m FROM (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng,
 date_diff('microsecond', lag(datetime) OVER w, datetime) AS us FROM pings WINDOW w AS (PARTITION BY uid ORDER BY datetime)) WHERE plat IS NOT NULL)
 SELECT source, mode, count(*) AS n_legs, round(avg(km), 6) AS mean_jump_km, round(avg(m), 4) AS mean_minutes, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM o GROUP BY source, mode"""
)
def transport_observed_summary(spark, sf):
    p = views.pings(spark, sf)
    legs = lambda side, name: transport.observed_legs(p.where(F.col("side") == side), "mode").withColumn("source", F.lit(name))
    s = transport.summary(legs(0, "synthetic").unionByName(legs(1, "observed")))
    return s.select("source", "mode", "n_legs", F.round("mean_jump_km", 6).alias("mean_jump_km"), F.round("mean_minutes", 4).alias("mean_minutes"), F.round("share", 6).alias("share"))


@query(
    common("pings") + f""", w AS (SELECT uid, event_id // 40 AS stop_id, event_id AS seq, lat, lng, datetime AS t, mode FROM pings), s AS (SELECT *, {hav('plat', 'plng', 'lat', 'lng')} AS km FROM
 (SELECT *, lag(lat) OVER x AS plat, lag(lng) OVER x AS plng FROM w WINDOW x AS (PARTITION BY uid, stop_id ORDER BY seq)))
 SELECT uid, stop_id, arg_min(mode, seq) AS mode, round(coalesce(sum(CASE WHEN plat IS NOT NULL THEN CASE WHEN lat = plat AND lng = plng THEN 0 ELSE km END END), 0), 6) AS jump_km, round(date_diff('microsecond', min(t), max(t)) / 60000000.0, 4) AS duration_minutes
 FROM s GROUP BY uid, stop_id HAVING count(*) >= 2"""
)
def transport_waypoint_legs(spark, sf):
    w = views.pings(spark, sf).selectExpr("uid", "event_id div 40 AS stop_id", "event_id AS seq", "lat", "lng", "datetime AS t", "mode")
    legs = transport.waypoint_legs(w)
    return legs.select("uid", "stop_id", "mode", F.round("jump_km", 6).alias("jump_km"), F.round("duration_minutes", 4).alias("duration_minutes"))


# Cells, flows, histograms, density ----------------------------------------------------------------


@query(common("pings") + f" SELECT event_id, {cell_sql(9)} AS cell, {cell_sql(7)} AS parent, CAST(9 AS INTEGER) AS res FROM pings")
def cell_index(spark, sf):
    c = views.pings(spark, sf).select("event_id", geo.cell("lat", "lng", 9).alias("cell"))
    return c.select("event_id", "cell", geo.cell_parent("cell", 7).alias("parent"), geo.cell_resolution("cell").alias("res"))


@query(common("pings") + " SELECT loc, round((floor((lat + 90) * 256) + 0.5) / 256 - 90, 9) AS c_lat, round((floor((lng + 180) * 256) + 0.5) / 256 - 180, 9) AS c_lng, CAST(9 AS BIGINT) AS disk FROM pings GROUP BY loc, lat, lng")
def cell_centres(spark, sf):
    p = views.pings(spark, sf).select("loc", geo.cell("lat", "lng", 9).alias("cell")).distinct()
    lat, lng = geo.cell_centre("cell")
    return p.select("loc", F.round(lat, 9).alias("c_lat"), F.round(lng, 9).alias("c_lng"), F.size(geo.cell_disk("cell", 1)).cast("long").alias("disk"))


@query(common("pings") + " SELECT loc, round(radians(lng) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS y FROM pings GROUP BY loc, lat, lng")
def geo_web_mercator(spark, sf):
    p = views.pings(spark, sf).select("loc", "lat", "lng").distinct()
    x, y = geo.mercator("lat", "lng")
    return p.select("loc", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def _flows(res: int, side: str = "") -> str:
    return f"SELECT origin, destination, count(*) AS flow FROM (SELECT c AS origin, lead(c) OVER (PARTITION BY uid ORDER BY datetime) AS destination FROM (SELECT uid, datetime, {cell_sql(res)} AS c FROM pings {side})) WHERE origin <> destination GROUP BY ALL"


@query(common("pings") + " " + _flows(8))
def od_flows(spark, sf):
    return od.flows(views.pings(spark, sf), 8, geo)


@query(common("pings") + "".join(f", s{r} AS ({_flows(r, 'WHERE side = 0')}), o{r} AS ({_flows(r, 'WHERE side = 1')})" for r in (7, 8, 9)) + " " + " UNION ALL ".join(f"SELECT CAST({r} AS INTEGER) AS res, round(2.0 * sum(least(coalesce(s{r}.flow, 0), coalesce(o{r}.flow, 0))) / (sum(coalesce(s{r}.flow, 0)) + sum(coalesce(o{r}.flow, 0))), 9) AS cpc FROM s{r} FULL OUTER JOIN o{r} USING (origin, destination)" for r in (7, 8, 9)))
def od_common_part_of_commuters(spark, sf):
    p = views.pings(spark, sf)
    out = None
    for res in (7, 8, 9):
        one = od.common_part(od.flows(p.where("side = 0"), res, geo), od.flows(p.where("side = 1"), res, geo)).select(F.lit(res).alias("res"), F.round("cpc", 9).alias("cpc"))
        out = one if out is None else out.unionByName(one)
    return out


@query(common("pings") + f" SELECT {cell_sql(8)} AS cell, CAST(hour(datetime) AS INTEGER) AS hour, count(*) AS n FROM pings GROUP BY ALL")
def stvd_hourly(spark, sf):
    return od.hourly(views.pings(spark, sf), 8, geo)


@query(
    common("pings") + f""", h AS (SELECT side, {cell_sql(8)} AS cell, hour(datetime) AS hr, count(*) AS n FROM pings GROUP BY ALL), v AS (SELECT side, cell, CAST(sum(n) AS BIGINT) AS vol, CAST(arg_min(hr, -n * 100 + hr) AS INTEGER) AS peak FROM h GROUP BY side, cell),
 b AS (SELECT coalesce(s.cell, o.cell) AS cell, coalesce(s.vol, 0) AS syn_volume, coalesce(o.vol, 0) AS obs_volume, coalesce(s.peak, 0) AS syn_peak, coalesce(o.peak, 0) AS obs_peak FROM (SELECT * FROM v WHERE side = 0) s FULL OUTER JOIN (SELECT * FROM v WHERE side = 1) o ON s.cell = o.cell),
 d AS (SELECT *, abs(syn_peak - obs_peak) AS raw FROM b)
 SELECT cell, syn_volume, obs_volume, syn_peak, obs_peak, round((syn_volume - obs_volume) / greatest(obs_volume, 1) * 100.0, 6) AS volume_diff_pct, CAST(least(raw, CASE WHEN raw <= 12 THEN 12 - raw ELSE raw END, 12) AS INTEGER) AS peak_shift FROM d"""
)
def stvd_difference(spark, sf):
    p = views.pings(spark, sf)
    d = od.hourly_difference(od.hourly(p.where("side = 0"), 8, geo), od.hourly(p.where("side = 1"), 8, geo))
    return d.select("cell", "syn_volume", "obs_volume", "syn_peak", "obs_peak", F.round("volume_diff_pct", 6).alias("volume_diff_pct"), F.col("peak_shift").cast("int").alias("peak_shift"))


@query(
    common("pings") + f""", k AS (SELECT uid, purpose AS kind, {cell_sql(12)} AS c, lat, lng, count(*) AS n FROM pings WHERE purpose <> 'OTHER' GROUP BY ALL), m AS (SELECT uid, kind, lat, lng, row_number() OVER (PARTITION BY uid, kind ORDER BY n DESC, c) AS r FROM k)
 SELECT kind, {cell_sql(7)} AS cell, count(*) AS agents FROM m WHERE r = 1 GROUP BY ALL"""
)
def density_explicit(spark, sf):
    return od.density(od.homes(views.pings(spark, sf), "purpose", index=geo), 7, geo)


@query(
    common("pings") + f""", p AS (SELECT uid, datetime, {cell_sql(12)} AS c, lat, lng FROM pings), h AS (SELECT uid, c, lat, lng FROM (SELECT uid, c, lat, lng, row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, c) AS r FROM p WHERE hour(datetime) BETWEEN 2 AND 5 GROUP BY uid, c, lat, lng) WHERE r = 1),
 k AS (SELECT uid, c, lat, lng FROM (SELECT p.uid, p.c, p.lat, p.lng, row_number() OVER (PARTITION BY p.uid ORDER BY count(*) DESC, p.c) AS r FROM p LEFT JOIN h ON p.uid = h.uid WHERE (hour(datetime) = 10 OR hour(datetime) BETWEEN 14 AND 16) AND (h.c IS NULL OR p.c <> h.c) GROUP BY p.uid, p.c, p.lat, p.lng) WHERE r = 1),
 u AS (SELECT 'HOME' AS kind, lat, lng FROM h UNION ALL SELECT 'WORK', lat, lng FROM k) SELECT kind, {cell_sql(7)} AS cell, count(*) AS agents FROM u GROUP BY ALL"""
)
def density_heuristic(spark, sf):
    return od.density(od.homes(views.pings(spark, sf), None, index=geo), 7, geo)


@query(common("pings", "profiles") + ", h AS (SELECT DISTINCT uid FROM pings WHERE purpose = 'HOME') SELECT count(*) AS total, count(p.uid) AS matching FROM h LEFT JOIN (SELECT uid FROM profiles WHERE gender = 'male') p USING (uid)")
def density_matched_agents(spark, sf):
    return od.matched(od.homes(views.pings(spark, sf), "purpose", index=geo), views.profiles(spark, sf).where("gender = 'male'"))


@query(
    common("pings") + f""", k AS (SELECT uid, purpose AS kind, {cell_sql(12)} AS c, lat, lng, count(*) AS n FROM pings WHERE purpose <> 'OTHER' GROUP BY ALL), m AS (SELECT uid, kind, lat, lng, row_number() OVER (PARTITION BY uid, kind ORDER BY n DESC, c) AS r FROM k),
 d AS (SELECT kind, {cell_sql(9)} AS cell, count(*) AS agents FROM m WHERE r = 1 GROUP BY ALL), b AS (SELECT kind, quantile_cont(agents, [0.2, 0.4, 0.6, 0.8]) AS q, sum(agents) AS total FROM d GROUP BY kind)
 SELECT kind, cell, agents, CAST(len(list_filter(q, lambda x: x < agents)) AS INTEGER) AS class, round(100.0 * agents / total, 6) AS pct FROM d JOIN b USING (kind)"""
)
def density_annotated(spark, sf):
    d = od.annotated(od.density(od.homes(views.pings(spark, sf), "purpose", index=geo), 9, geo))
    return d.select("kind", "cell", "agents", "class", F.round("pct", 6).alias("pct"))


@query(
    common("pings") + f""", p AS (SELECT event_id AS id, lat + (event_id % 97) * 0.0003 AS lat, lng + (event_id % 89) * 0.0003 AS lng FROM pings)
 SELECT a.id, count(b.id) AS n FROM p a LEFT JOIN p b ON a.id <> b.id AND abs(a.lat - b.lat) <= 0.0045 AND abs(a.lng - b.lng) <= 0.0045 AND {hav('a.lat', 'a.lng', 'b.lat', 'b.lng').replace('6371.0088', '6371000.0')} <= 500 GROUP BY a.id"""
)
def spatial_neighbours_within(spark, sf):
    p = views.pings(spark, sf).selectExpr("event_id AS id", "lat + cast((event_id % 97) * 0.0003 as double) AS lat", "lng + cast((event_id % 89) * 0.0003 as double) AS lng")
    return od.neighbours_within(p)


@query(
    common("pings") + f""", n AS (SELECT c_custkey AS node, 48.80 + CAST(c_custkey * 37 % 500 AS DOUBLE) / 10000 AS nlat, 2.25 + CAST(c_custkey * 91 % 800 AS DOUBLE) / 10000 AS nlng FROM customer), p AS (SELECT event_id AS id, lat + (event_id % 97) * 0.0003 AS lat, lng + (event_id % 89) * 0.0003 AS lng FROM pings),
 d AS (SELECT id, node, {hav('lat', 'lng', 'nlat', 'nlng').replace('6371.0088', '6371000.0')} AS m FROM p CROSS JOIN n), r AS (SELECT id, node, m, row_number() OVER (PARTITION BY id ORDER BY m, node) AS r FROM d WHERE m <= 750)
 SELECT p.id, coalesce(r.node, -1) AS node, round(r.m, 2) AS metres FROM p LEFT JOIN (SELECT * FROM r WHERE r = 1) r USING (id)"""
)
def spatial_snap_to_nodes(spark, sf):
    n = views.table(spark, sf, "customer").selectExpr("c_custkey AS node", "48.80D + cast(c_custkey * 37 % 500 as double) / 10000 AS lat", "2.25D + cast(c_custkey * 91 % 800 as double) / 10000 AS lng")
    p = views.pings(spark, sf).selectExpr("event_id AS id", "lat + cast((event_id % 97) * 0.0003 as double) AS lat", "lng + cast((event_id % 89) * 0.0003 as double) AS lng")
    return od.snap(p, n).select("id", "node", F.round("metres", 2).alias("metres"))


# Distances ------------------------------------------------------------------------------------------

W1 = """, c AS (SELECT v, sum(na) AS na, sum(nb) AS nb FROM (SELECT {v} AS v, 1 AS na, 0 AS nb FROM {t} WHERE side = 0 UNION ALL SELECT {v}, 0, 1 FROM {t} WHERE side = 1) GROUP BY v),
 t AS (SELECT sum(na) AS ta, sum(nb) AS tb FROM c), f AS (SELECT v, sum(na) OVER (ORDER BY v) AS fa, sum(nb) OVER (ORDER BY v) AS fb, lead(v) OVER (ORDER BY v) - v AS w FROM c)
 SELECT round(sum(abs(fa / ta - fb / tb) * coalesce(w, 0)), 9) AS w1 FROM f CROSS JOIN t"""


W1_BY = """, c AS (SELECT {g} AS g, {v} AS v, count(*) FILTER (WHERE side = 0) AS na, count(*) FILTER (WHERE side = 1) AS nb FROM {t} GROUP BY ALL),
 f AS (SELECT g, sum(na) OVER w AS fa, sum(nb) OVER w AS fb, sum(na) OVER (PARTITION BY g) AS ta, sum(nb) OVER (PARTITION BY g) AS tb, lead(v) OVER w - v AS w FROM c WINDOW w AS (PARTITION BY g ORDER BY v)) SELECT g AS {g}, round(sum(abs(fa / nullif(ta, 0) - fb / nullif(tb, 0)) * coalesce(w, 0)), 9) AS w1 FROM f GROUP BY g"""


def _sides(df):
    return df.where("side = 0"), df.where("side = 1")


@query(common("pings") + W1.format(v="value", t="pings"))
def distance_wasserstein_values(spark, sf):
    a, b = _sides(views.pings(spark, sf))
    return distance.wasserstein(a, b, "value").select(F.round("w1", 9).alias("w1"))


@query(common("pings") + f", j AS ({JUMPS}), r AS (SELECT side, round(jump_km, 9) AS v FROM j)" + W1.format(v="v", t="r"))
def distance_wasserstein_jumps(spark, sf):
    one = lambda p: traj.jump_lengths(p).select(F.round("jump_km", 9).alias("v"))
    a, b = _sides(views.pings(spark, sf))
    return distance.wasserstein(one(a), one(b), "v").select(F.round("w1", 9).alias("w1"))


@query(common("pings") + f", s AS ({STAYS}), n AS (SELECT uid, side, CAST(count(*) AS DOUBLE) AS v FROM s GROUP BY ALL)" + W1.format(v="v", t="n"))
def distance_wasserstein_visits_per_user(spark, sf):
    a, b = (traj.visits_per_user(x) for x in _sides(views.pings(spark, sf)))
    return distance.wasserstein(a, b, "visits").select(F.round("w1", 9).alias("w1"))


JSD = """, p AS (SELECT {k} AS k, count(*) / sum(count(*)) OVER () AS p FROM {a} GROUP BY 1), q AS (SELECT {k} AS k, count(*) / sum(count(*)) OVER () AS q FROM {b} GROUP BY 1), m AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM p FULL OUTER JOIN q USING (k))
 SELECT round(sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2, 9) AS jsd FROM m"""


@query(common("pings") + JSD.format(k="purpose", a="(SELECT * FROM pings WHERE side = 0)", b="(SELECT * FROM pings WHERE side = 1)"))
def distance_jensen_shannon_activity(spark, sf):
    a, b = (distance.shares(x, "purpose") for x in _sides(views.pings(spark, sf)))
    return distance.jensen_shannon(a, b, ["purpose"], "n").select(F.round("jsd", 9).alias("jsd"))


@query(
    common("pings") + """, c AS (SELECT value AS v, count(*) AS n FROM pings WHERE side = 0 GROUP BY 1), f AS (SELECT v AS x, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS p, row_number() OVER (ORDER BY v) - 1 AS i FROM c),
 k AS (SELECT x, p, i FROM f WHERE p <= 0.98 UNION ALL (SELECT x, 0.98, i FROM f WHERE p > 0.98 AND (SELECT coalesce(max(p), 0) FROM f WHERE p <= 0.98) < 0.98 ORDER BY x LIMIT 1)), m AS (SELECT *, count(*) OVER () AS m FROM k)
 SELECT round(x, 6) AS x, round(p, 9) AS p FROM m WHERE m <= 400 OR i = round(round(i * 399.0 / (m - 1)) * (m - 1) / 399.0)"""
)
def distance_ecdf(spark, sf):
    return distance.ecdf(views.pings(spark, sf).where("side = 0"), "value").select(F.round("x", 6).alias("x"), F.round("p", 9).alias("p"))


def _sliced(coords: list[str], points: str, slices: int) -> str:
    """SQL of the mean W1 over the seeded directions: ``points`` has the coordinates and side."""
    rows = [f"SELECT {i} AS slice, side, {' + '.join([f'(0.0::DOUBLE + {coords[0]} * ({row[0]!r}::DOUBLE))'] + [f'{c} * ({x!r}::DOUBLE)' for c, x in zip(coords[1:], row[1:], strict=True)])} AS v FROM {points}" for i, row in enumerate(distance.directions(slices, len(coords)))]
    return f""", spun AS ({" UNION ALL ".join(rows)}), c AS (SELECT slice, v, count(*) FILTER (WHERE side = 0) AS na, count(*) FILTER (WHERE side = 1) AS nb FROM spun GROUP BY ALL),
 f AS (SELECT slice, sum(na) OVER w AS fa, sum(nb) OVER w AS fb, sum(na) OVER (PARTITION BY slice) AS ta, sum(nb) OVER (PARTITION BY slice) AS tb, lead(v) OVER w - v AS w FROM c WINDOW w AS (PARTITION BY slice ORDER BY v)), d AS (SELECT slice, sum(abs(fa / ta - fb / tb) * coalesce(w, 0)) AS w1 FROM f GROUP BY slice)"""


@query(common("pings") + W1_BY.format(v="value", g="purpose", t="pings"))
def distance_wasserstein_by_group(spark, sf):
    a, b = _sides(views.pings(spark, sf))
    return distance.wasserstein(a, b, "value", ["purpose"]).select("purpose", F.round("w1", 9).alias("w1"))


@query(common("pings") + ", h AS (SELECT side, lat, lng, CAST(hour(datetime) AS DOUBLE) AS h FROM pings)" + _sliced(["lat", "lng", "h"], "h", 8) + " SELECT round(avg(w1), 6) AS sliced_w1 FROM d")
def distance_sliced_wasserstein(spark, sf):
    a, b = _sides(views.pings(spark, sf).withColumn("h", F.hour("datetime").cast("double")))
    return distance.sliced_wasserstein(a, b, ["lat", "lng", "h"], 8).select(F.round("sliced_w1", 6).alias("sliced_w1"))


@query(
    common("pings") + ", h AS (SELECT side, radians((floor((lng + 180) * 64) + 0.5) / 64 - 180) * 6378137 AS x, ln(tan(pi() / 4 + radians((floor((lat + 90) * 64) + 0.5) / 64 - 90) / 2)) * 6378137 AS y, hour(datetime) * 1000.0::DOUBLE AS t FROM pings)" + _sliced(["x", "y", "t"], "h", 4) + " SELECT round(avg(w1), 3) AS sliced_w1 FROM d"
)
def distance_stvd_transport(spark, sf):
    a, b = _sides(views.pings(spark, sf))
    return od.hourly_transport(a, b, 7, 4, index=geo).select(F.round("sliced_w1", 3).alias("sliced_w1"))


QUERIES, ORACLE = query.queries, query.oracle
