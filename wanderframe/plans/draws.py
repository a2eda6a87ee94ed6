"""Seeded draws, allocations, formulas of generation, and priors, with the same draws in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..operators import distance, graph, profiles, sampling, simulate, windows
from . import views
from .mobility import hav
from .registry import Registry
from .views import common, draw, normal, table

query = Registry()


@query("SELECT event_id, round(pow(1 + user_id % 5, 1.0) * pow(value + 1, 1.0) * pow(greatest(value / 10, 0.001), -2.0), 9) AS gravity, round(ln(1 + greatest(value - 20, 0)), 9) AS attraction, round(exp(-0.1 * value) / pow(greatest(value, 0.5), 1.5), 9) AS friction FROM events")
def scalar_gravity(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.round(geo.deterrence(F.col("value") / 10, 1 + F.col("user_id") % 5, F.col("value") + 1), 9).alias("gravity"), F.round(F.log1p(F.greatest(F.col("value") - 20, F.lit(0.0))), 9).alias("attraction"), F.round(geo.friction("value", 0.1, 0.5, 1.5), 9).alias("friction"))


@query("SELECT event_id, round(0.6 * pow(greatest(event_id % 30, 1), -0.21), 9) AS p FROM events")
def scalar_explore_probability(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(scalar.explore_probability(F.col("event_id") % 30), 9).alias("p"))


@query(f"SELECT event_id, round(round(greatest(exp(0.4 + 0.5 * {normal(48, 'event_id')}), 1 / 60.0) * 3600) / 3600, 9) AS hours FROM events")
def scalar_log_normal_hours(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.round(scalar.log_normal_hours(F.lit(0.4), F.lit(0.5), scalar.normal(48, "event_id")), 9).alias("hours"))


@query(common("pings") + " SELECT loc, round(lat, 9) AS y, round(lng * cos(radians(48.82)), 9) AS x FROM pings GROUP BY loc, lat, lng")
def geo_local_scale(spark, sf):
    y, x = geo.local_scale("lat", "lng", F.lit(48.82))
    return views.pings(spark, sf).select("loc", F.round(y, 9).alias("y"), F.round(x, 9).alias("x")).distinct()


#: The error function as its power series.
ERF = "(2 / sqrt(pi()) * list_sum(list_transform(range(80), lambda i: pow(-1, i) * pow({x}, 2 * i + 1) / (gamma(i + 1) * (2 * i + 1)))))"


@query(f"WITH k AS (SELECT k, ((ln(k + 0.5) - 1.0) / (0.5 * sqrt(2)))::DOUBLE AS b, ((ln(k - 0.5) - 1.0) / (0.5 * sqrt(2)))::DOUBLE AS a FROM range(1, 13) r(k)), m AS (SELECT k, 0.5 * ({ERF.format(x='b')} - {ERF.format(x='a')}) AS m FROM k) SELECT k, round(m / sum(m) OVER (), 6) AS p FROM m")
def sample_truncated_log_normal(spark, sf):
    p = sampling.log_normal_pmf(1.0, 0.5, 12)
    return spark.createDataFrame(list(enumerate(p, 1)), "k long, p double").select("k", F.round("p", 6).alias("p"))


@query("WITH s AS (SELECT event_type, count(*) AS n, 97.0 * count(*) / sum(count(*)) OVER () AS w FROM events GROUP BY event_type), r AS (SELECT *, floor(w) AS f, row_number() OVER (ORDER BY w - floor(w) DESC, event_type) AS r FROM s) SELECT event_type, CAST(f + CASE WHEN r <= 97 - (SELECT sum(f) FROM r) THEN 1 ELSE 0 END AS BIGINT) AS n FROM r")
def sample_allocated(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type").collect()
    return spark.createDataFrame(list(zip([r.event_type for r in rows], sampling.allocated([float(r.n) for r in rows], 97), strict=True)), "event_type string, n long")


@query("WITH l AS (SELECT user_id, list(event_id ORDER BY event_id) AS l FROM events GROUP BY user_id) SELECT user_id, unnest(CASE WHEN len(l) <= 7 THEN l ELSE list_transform(range(7), lambda i: l[CAST(round(i * (len(l) - 1) / 6.0) AS BIGINT) + 1]) END) AS event_id FROM l")
def sample_spaced_waypoints(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("l"))
    return e.select("user_id", F.explode(sampling.spaced("l", 7)).alias("event_id"))


@query(f"SELECT event_type, event_id, draw FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ln(value) - ln(-ln({draw(42, 'event_type', 'event_id')})) DESC, event_id) AS draw FROM events WHERE value > 0) WHERE draw <= 5")
def sample_weighted_without_replacement(spark, sf):
    return sampling.weighted(table(spark, sf, "events"), ["event_type"], "event_id", "value", 5).select("event_type", "event_id", F.col("draw").cast("long").alias("draw"))


@query(
    f"""WITH v AS (SELECT user_id, round(stddev_pop(value), 6) AS variation, CASE WHEN user_id % 3 = 0 THEN 'we' ELSE 'wd' END AS day_type FROM events GROUP BY user_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY day_type ORDER BY variation, user_id) - 1 AS lo, row_number() OVER (PARTITION BY day_type ORDER BY variation DESC, user_id) - 1 AS hi, row_number() OVER (PARTITION BY day_type ORDER BY {draw(42, 'user_id')}) - 1 AS rnd, least(24, count(*) OVER (PARTITION BY day_type)) AS m FROM v),
 s AS (SELECT day_type, row_number() OVER (ORDER BY day_type) - 1 AS turn, count(*) OVER () AS k FROM (SELECT DISTINCT day_type FROM v)), d AS (SELECT CAST(d AS INTEGER) AS draw, day_type, d // k AS i FROM s, range(24) t(d) WHERE d % k = turn)
 SELECT draw, day_type, user_id FROM d JOIN r USING (day_type) WHERE CASE i % 4 WHEN 0 THEN lo = (i // 4) % m WHEN 1 THEN hi = (i // 4) % m ELSE rnd = (2 * (i // 4) + i % 4 - 2) % m END"""
)
def sample_stratified_pairs(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.stddev_pop("value"), 6).alias("variation")).withColumn("day_type", F.when(F.col("user_id") % 3 == 0, "we").otherwise("wd"))
    return sampling.stratified_pairs(e, 24, "day_type", "user_id")


def _category(shares: dict[str, float], u: str) -> str:
    """SQL of the category in whose part of 0 to 1 a draw falls."""
    edge, out = 0.0, "CASE"
    total = sum(shares.values())
    for name in list(shares)[:-1]:
        edge += shares[name] / total
        out += f" WHEN {u} < {edge!r}::DOUBLE THEN '{name}'"
    return f"{out} ELSE '{list(shares)[-1]}' END"


POPULATION = f"""SELECT uid, CASE WHEN {draw(43, 'uid')} < 0.5 THEN 'female' ELSE 'male' END AS gender, 16 + CAST(floor(64 * pow({draw(44, 'uid')}, 0.9) * (1 - 0.25 * {draw(45, 'uid')})) AS BIGINT) AS age, {_category(simulate.EDUCATION, draw(46, 'uid'))} AS education,
 CAST(1 + floor({draw(47, 'uid')} * 5) AS BIGINT) AS health, {_category(simulate.HOUSEHOLD, draw(48, 'uid'))} AS household, {_category(simulate.JOBS, draw(49, 'uid'))} AS job, {draw(50, 'uid')} < 0.55 AS has_car, {draw(51, 'uid')} < 0.4 AS has_bike FROM (SELECT id + 1 AS uid FROM range(500) r(id))"""


@query(POPULATION)
def simulate_profiles(spark, sf):
    return simulate.population(spark, 500)


SCORES = "s AS (SELECT DISTINCT user_id AS uid, CAST(user_id % 11 AS DOUBLE) / 10 AS car_score, CAST(user_id % 7 AS DOUBLE) / 6 AS bike_score, CAST(user_id % 13 AS DOUBLE) / 12 AS coherence FROM events)"


def _scores(spark, sf):
    return table(spark, sf, "events").selectExpr("user_id AS uid", "cast(user_id % 11 as double) / 10 AS car_score", "cast(user_id % 7 as double) / 6 AS bike_score", "cast(user_id % 13 as double) / 12 AS coherence").distinct()


@query(f"WITH p AS ({POPULATION}), {SCORES} SELECT p.uid, CASE WHEN car_score IS NULL THEN has_car ELSE {draw(43, 'p.uid')} < car_score END AS has_car, CASE WHEN bike_score IS NULL THEN has_bike ELSE {draw(44, 'p.uid')} < bike_score END AS has_bike FROM p LEFT JOIN s ON s.uid = p.uid")
def simulate_vehicle_ownership(spark, sf):
    return simulate.owned(simulate.population(spark, 500), _scores(spark, sf)).select("uid", "has_car", "has_bike")


@query(
    f"""WITH p AS ({POPULATION}), {SCORES}, j AS (SELECT p.*, coalesce(coherence < 0.2 OR {draw(44, 'p.uid')} < 1 - coherence, FALSE) AS again FROM p LEFT JOIN s ON s.uid = p.uid)
 SELECT uid, CASE WHEN again THEN {_category(simulate.EDUCATION, draw(45, 'uid'))} ELSE education END AS education, CASE WHEN again THEN {_category(simulate.HOUSEHOLD, draw(46, 'uid'))} ELSE household END AS household, CASE WHEN again THEN {_category(simulate.JOBS, draw(47, 'uid'))} ELSE job END AS job FROM j"""
)
def simulate_repaired_profiles(spark, sf):
    return simulate.repaired(simulate.population(spark, 500), _scores(spark, sf)).select("uid", "education", "household", "job")


@query(
    f"""WITH p AS ({POPULATION}) SELECT uid, 'Agent ' || uid || ' is a ' || age || '-year-old ' || gender || ' working as a ' || job || '. They have ' || education || ' level education and ' || CASE health WHEN 1 THEN 'very poor' WHEN 2 THEN 'poor' WHEN 3 THEN 'fair' WHEN 4 THEN 'good' ELSE 'very good' END
 || ' health. They live as: ' || household || '. ' || CASE WHEN has_car AND has_bike THEN 'They own a car and a bike.' WHEN has_car THEN 'They own a car.' WHEN has_bike THEN 'They own a bike.' ELSE 'They rely on public transport or walking.' END AS narrative FROM p"""
)
def project_narratives(spark, sf):
    p = simulate.population(spark, 500).withColumn("name", F.concat(F.lit("Agent "), "uid"))
    return p.select("uid", scalar.narrative().alias("narrative"))


MINE = {k: f"({base} * exp(0.4 * {normal(46 + k, 'uid')}))" for k, base in ((1, 1.0), (2, 4.0))}


@query(common("pings") + f", l AS (SELECT uid, event_id, value / 10 AS km FROM pings) SELECT uid, event_id, CASE WHEN km <= {MINE[1]} THEN 'walk' WHEN {draw(56, 'uid')} < 0.5 THEN 'car' WHEN {draw(57, 'uid')} < 0.5 AND km <= {MINE[2]} THEN 'bike' ELSE 'rail' END AS mode FROM l")
def simulate_mode_choice(spark, sf):
    legs = views.pings(spark, sf).selectExpr("uid", "event_id", "value / 10 AS km")
    return simulate.choose_modes(legs, views.profiles(spark, sf)).select("uid", "event_id", "mode")


@query(
    """WITH m AS (SELECT event_id, user_id AS uid, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(value * 60) AS BIGINT) AS dur FROM events), s AS (SELECT *, t - dur - 300 AS ready, sum(dur) OVER (PARTITION BY uid ORDER BY t, event_id) AS total FROM m),
 a AS (SELECT *, total + max(ready - (total - dur)) OVER (PARTITION BY uid ORDER BY t, event_id) AS arrival FROM s) SELECT event_id, uid, CAST(arrival - dur AS BIGINT) AS departure, CAST(arrival AS BIGINT) AS arrival FROM a"""
)
def simulate_stop_times(spark, sf):
    m = table(spark, sf, "events").selectExpr("event_id", "user_id AS uid", "unix_seconds(cast(ts as timestamp)) AS t", "cast(floor(value * 60) as bigint) AS dur")
    return simulate.stop_times(m, "uid", ["t", "event_id"], "t", "dur", 300).select("event_id", "uid", "departure", "arrival")


@query(common("edges") + f", d AS (SELECT u, v, unnest(range(1, 21)) AS day FROM edges) SELECT u, v, round(sum(CASE WHEN {draw(43, 'u', 'v', 'day')} < 0.3 THEN 1 ELSE 0 END) / 20.0, 9) AS persistence FROM d GROUP BY u, v")
def graph_null_persistence(spark, sf):
    e = graph.normalized(views.edges(spark, sf))
    return graph.null_persistence(e, 20, 0.3).select("u", "v", F.round("persistence", 9).alias("persistence"))


@query(common("pings") + " SELECT x, round(coalesce((SELECT count(*) FROM pings WHERE value <= x) / (SELECT count(*) FROM pings)::DOUBLE, 0), 9) AS p FROM (VALUES (-5.0), (30.0), (50.0)) t(x)")
def distance_ecdf_at(spark, sf):
    """The curve of all values, uncut, at three places."""
    curve = distance.ecdf(views.pings(spark, sf), "value", cutoff=1.0, points=1 << 40).persist()
    parts = [distance.ecdf_at(curve, x).select(F.lit(x).cast("decimal(3,1)").alias("x"), F.round("p", 9).alias("p")) for x in (-5.0, 30.0, 50.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


PRIOR = ", ".join(f"({i}, {m >> profiles.SHIFT}, {p})" for i, (m, p) in enumerate(profiles.LITERATURE, 1))


@query(f"SELECT CAST(motif AS BIGINT) AS motif, CAST(n AS BIGINT) AS n_locations, round(p / sum(p) OVER (PARTITION BY n), 9) AS weight FROM (VALUES {PRIOR}) t(motif, n, p)")
def motif_prior(spark, sf):
    return profiles.motif_prior(spark).select("motif", "n_locations", F.round("weight", 9).alias("weight"))


@query(
    f"""WITH d AS (SELECT DISTINCT user_id AS diary, 1 + user_id % 8 AS n_locations FROM events), m AS (SELECT motif, n, p FROM (VALUES {PRIOR}) t(motif, n, p)), s AS (SELECT diary, motif, row_number() OVER (PARTITION BY diary ORDER BY ln(p / t) - ln(-ln({draw(42, 'diary', 'motif')})) DESC, motif) AS r FROM d JOIN (SELECT *, sum(p) OVER (PARTITION BY n) AS t FROM m) m ON m.n = d.n_locations)
 SELECT d.diary, CAST(s.motif AS BIGINT) AS motif FROM d LEFT JOIN s ON s.diary = d.diary AND s.r = 1"""
)
def motif_drawn_for_diaries(spark, sf):
    d = table(spark, sf, "events").selectExpr("user_id AS diary", "1 + user_id % 8 AS n_locations").distinct()
    return profiles.draw_motifs(d, "diary").select("diary", "motif")


@query("SELECT 'gender' AS field, label, round(w / 4.0, 9) AS weight, TRUE AS calibrated FROM (VALUES ('female', 3), ('male', 1)) t(label, w) UNION ALL SELECT 'job', label, round(w, 9), FALSE FROM (VALUES ('a', 0.25), ('b', 0.75)) t(label, w) UNION ALL SELECT 'health', label, round(w, 9), FALSE FROM (VALUES ('low', 0.5), ('high', 0.5)) t(label, w)")
def simulate_calibrated_weights(spark, sf):
    """Answers for one field are usable, for one negative, for one missing a label."""
    answers = spark.createDataFrame([("gender", "female", 3.0), ("gender", "male", 1.0), ("job", "a", -1.0), ("job", "b", 2.0), ("health", "low", 1.0)], "field string, label string, weight double")
    defaults = spark.createDataFrame([("gender", "female", 1.0), ("gender", "male", 1.0), ("job", "a", 1.0), ("job", "b", 3.0), ("health", "low", 1.0), ("health", "high", 1.0)], "field string, label string, weight double")
    return simulate.calibrated(answers, defaults).select("field", "label", F.round("weight", 9).alias("weight"), "calibrated")


@query("WITH p AS (SELECT DISTINCT user_id AS uid, event_id % 4 AS diary FROM events), s AS (SELECT uid, diary, least(1.0, greatest(0.0, CAST((uid * 7 + diary) % 15 AS DOUBLE) / 10 - 0.2)) AS score FROM p WHERE (uid + diary) % 5 > 0) SELECT p.uid, p.diary, round(coalesce(score, 0.5), 9) AS score, score IS NULL AS missing FROM p LEFT JOIN s ON s.uid = p.uid AND s.diary = p.diary")
def simulate_alignment_scores(spark, sf):
    pairs = table(spark, sf, "events").selectExpr("user_id AS uid", "event_id % 4 AS diary").distinct().withColumn("profile", F.concat(F.lit("profile "), "uid")).withColumn("text", F.concat(F.lit("diary "), "diary"))
    cached = pairs.where("(uid + diary) % 5 > 0").select(scalar.content_key(F.lit("model"), "profile", "text").alias("cache_key"), F.expr("cast((uid * 7 + diary) % 15 as double) / 10 - 0.2").alias("score"))
    a = simulate.aligned(pairs, cached, "model", ["profile", "text"])
    return a.select("uid", "diary", F.round("score", 9).alias("score"), "missing")


@query(
    f"""WITH g AS (SELECT event_id, event_id % 200 + 1 AS x, (event_id * 7) % 200 + 1 AS y FROM events), m AS (SELECT avg(y) AS mx, avg(-x) AS my FROM g)
 SELECT event_id, round(-11610.0 + (y - mx) / 1.1 * 500.0, 6) AS metric_x, round(-104950.0 + (-x - my) / 0.9 * 500.0, 6) AS metric_y FROM g, m"""
)
def geo_undistorted_grid(spark, sf):
    g = table(spark, sf, "events").selectExpr("event_id", "event_id % 200 + 1 AS x", "(event_id * 7) % 200 + 1 AS y")
    return geo.undistorted(g).select("event_id", F.round("metric_x", 6).alias("metric_x"), F.round("metric_y", 6).alias("metric_y"))


@query(
    f"""WITH p AS (SELECT event_id, 33.0 + CAST(event_id % 40 AS DOUBLE) / 10 AS lat, 136.0 + CAST(event_id % 23 AS DOUBLE) / 10 AS lng FROM events)
 SELECT event_id, round(lat, 7) AS lat, round(lng, 7) AS lng, {hav('lat', 'lng', 'lat', 'lng')} < 0.001 AS back FROM p"""
)
def geo_plane_round_trip(spark, sf):
    """Degrees to the plane's metres and back."""
    p = table(spark, sf, "events").selectExpr("event_id", "33.0D + cast(event_id % 40 as double) / 10 AS lat", "136.0D + cast(event_id % 23 as double) / 10 AS lng")
    x, y = geo.to_plane("lat", "lng")
    lat, lng = geo.from_plane("x", "y")
    q = p.withColumns({"x": x, "y": y}).withColumns({"la": lat, "lo": lng})
    return q.select("event_id", F.round("la", 7).alias("lat"), F.round("lo", 7).alias("lng"), (geo.haversine("lat", "lng", "la", "lo") < 0.001).alias("back"))


def _window(w: int, seed: int = 50) -> str:
    """SQL of one window: from what agents knew (v), where they were (h) and their ties (t)."""
    days = f"{min(w + 1, 3)}"
    seen = " UNION ALL ".join(f"SELECT u, v, day FROM z{k}" for k in range(max(0, w - 2), w + 1))
    d = hav("q.lat", "q.lng", "p.lat", "p.lng")
    return f""", s{w} AS (SELECT uid, count(*) AS s FROM v{w} GROUP BY uid), g{w} AS (SELECT uid, {draw(seed + 10 * w + 1, 'uid')} < 0.3 AS social FROM s{w} WHERE {draw(seed + 10 * w, 'uid')} < 0.6 * pow(greatest(s, 1), -0.21)),
 f{w} AS (SELECT u AS uid, v AS friend, strength FROM t{w} UNION ALL SELECT v, u, strength FROM t{w}), o{w} AS (SELECT uid, place, CAST(n AS DOUBLE) AS w, 2 AS kind FROM v{w}
 UNION ALL SELECT f.uid, x.place, sum(f.strength * x.n), 0 FROM f{w} f JOIN g{w} g ON g.uid = f.uid AND g.social JOIN v{w} x ON x.uid = f.friend WHERE NOT EXISTS (SELECT 1 FROM v{w} y WHERE y.uid = f.uid AND y.place = x.place) GROUP BY f.uid, x.place
 UNION ALL SELECT h.uid, p.place, p.relevance * pow(greatest({d}, 0.001), -2.0), 1 FROM h{w} h JOIN g{w} g ON g.uid = h.uid JOIN places q ON q.place = h.place CROSS JOIN places p WHERE {d} <= 30 AND NOT EXISTS (SELECT 1 FROM v{w} y WHERE y.uid = h.uid AND y.place = p.place)),
 k{w} AS (SELECT uid, kind, place, row_number() OVER (PARTITION BY uid, kind ORDER BY ln(w) - ln(-ln({draw(seed + 10 * w + 2, 'uid', 'kind', 'place')})) DESC, place) AS r FROM o{w} WHERE w > 0), h{w + 1} AS (SELECT uid, arg_min(place, kind) AS place, CAST(min(kind) AS INTEGER) AS kind FROM k{w} WHERE r = 1 GROUP BY uid),
 v{w + 1} AS (SELECT uid, place, sum(n) AS n FROM (SELECT uid, place, n FROM v{w} UNION ALL SELECT uid, place, 1 FROM h{w + 1}) GROUP BY ALL), c{w} AS (SELECT place FROM h{w + 1} GROUP BY place HAVING count(*) BETWEEN 2 AND 12), z{w} AS (SELECT a.uid AS u, b.uid AS v, {w} AS day FROM h{w + 1} a JOIN h{w + 1} b ON a.place = b.place AND a.uid < b.uid WHERE a.place IN (SELECT place FROM c{w})),
 m{w} AS (SELECT u, v, count(DISTINCT day) AS met FROM ({seen}) GROUP BY ALL), t{w + 1} AS (SELECT u, v, strength FROM (SELECT u, v, CASE WHEN coalesce(strength, 0) = 0 THEN CASE WHEN coalesce(met, 0) / {days} >= 0.3 THEN 0.2 * met / {days} END
  ELSE least(1.0, greatest(0.0, strength + 0.2 * coalesce(met, 0) / {days} - CASE WHEN coalesce(met, 0) = 0 THEN 0.05 ELSE 0 END)) END AS strength FROM t{w} FULL JOIN m{w} USING (u, v)) WHERE strength > 0)"""


WINDOWS = common("pings", "edges") + ", places AS (SELECT loc AS place, lat, lng, CAST(count(*) AS DOUBLE) AS relevance FROM pings GROUP BY ALL), h0 AS (SELECT uid, arg_min(loc, datetime) AS place FROM pings GROUP BY uid), v0 AS (SELECT uid, place, 1 AS n FROM h0), t0 AS (SELECT u, v, 0.5::DOUBLE AS strength FROM edges WHERE (u + v) % 5 = 0)" + "".join(_window(w) for w in range(3))


def _moved(spark, sf):
    p = views.pings(spark, sf)
    places = p.groupBy(F.col("loc").alias("place"), "lat", "lng").agg(F.count("*").cast("double").alias("relevance"))
    homes = p.groupBy("uid").agg(F.min_by("loc", "datetime").alias("place"))
    ties = views.edges(spark, sf).where("(u + v) % 5 = 0").withColumn("strength", F.lit(0.5))
    return windows.move_in_windows(homes, places, ties, 3, crowd=12)


@query(WINDOWS + " " + " UNION ALL ".join(f"SELECT CAST({w} AS INTEGER) AS \"window\", uid, place, kind FROM h{w + 1}" for w in range(3)))
def simulate_windows(spark, sf):
    return _moved(spark, sf)[0]


@query(WINDOWS + " SELECT u, v, round(strength, 9) AS strength FROM t3")
def simulate_window_ties(spark, sf):
    return _moved(spark, sf)[1].select("u", "v", F.round("strength", 9).alias("strength"))


QUERIES, ORACLE = query.queries, query.oracle
