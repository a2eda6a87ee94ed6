"""Operators on small literal tables."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanderframe.functions import geo, scalar
from wanderframe.operators import activity, distance, filters, graph, laws, od, profiles, routing, sampling, simulate, timeline, traj, transport
from wanderframe.sources import io, schema

T0 = datetime(2024, 1, 1)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_waiting_times(spark):
    df = spark.createDataFrame([(1, T0, 1.0, 1.0), (1, T0 + timedelta(hours=1), 1.0, 1.0), (1, T0 + timedelta(hours=3), 1.0, 1.0)], "uid long, datetime timestamp_ntz, lat double, lng double")
    assert [r.wait_minutes for r in traj.waiting_times(df).orderBy("datetime").collect()] == [60.0, 120.0]


def test_roles_are_found_in_order_and_case(spark):
    df = spark.createDataFrame([("a", "2024-01-01 10:00:00", "1.5", "x")], "User_ID string, start_timestamp string, Latitude string, longitude string")
    s = schema.TrajSchema.detect(df)
    assert (s.uid, s.datetime, s.lat, s.lng) == ("User_ID", "start_timestamp", "Latitude", "longitude")
    r = schema.canonical(df).first()
    assert (r.datetime, r.lat, r.lng) == (datetime(2024, 1, 1, 10), 1.5, None)
    with pytest.raises(ValueError, match="lat"):
        schema.TrajSchema.detect(df.drop("Latitude"))


def test_haversine_keeps_nulls(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (None, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.haversine("a", "b", "c", "d")).collect()]
    assert got[0] == pytest.approx(math.radians(1) * 6371.0088) and got[1] is None and got[2] == pytest.approx(math.pi * 6371.0088)


def test_flows_skip_bad_places_and_loops(spark):
    pts = [("u", 0, 48.0, 2.0), ("u", 1, 48.0, 2.0), ("u", 2, 999.0, 2.0), ("u", 3, 49.0, 3.0), ("v", 0, 48.0, 2.0), ("v", 5, 49.0, 3.0)]
    df = spark.createDataFrame([(u, T0 + timedelta(hours=h), a, b) for u, h, a, b in pts], "uid string, datetime timestamp_ntz, lat double, lng double")
    f = od.flows(df, 8).collect()
    assert len(f) == 1 and f[0].flow == 2
    assert od.common_part(od.flows(df, 8), od.flows(df, 8)).first().cpc == 1.0


def test_purposes(spark):
    df = spark.createDataFrame([("HOME",), (" work ",), ("SHOP",), (None,), ("unknown",)], "p string")
    assert [r[0] for r in df.select(scalar.purpose("p")).collect()] == ["HOME", "WORK", "OTHER", "OTHER", "OTHER"]
    df = spark.createDataFrame([(" nan",), ("None",), ("x",)], "p string")
    assert [r[0] for r in df.select(scalar.label("p")).collect()] == [None, None, "X"]


def test_heuristic_purposes_are_per_user(spark):
    v = [("a", 2, "h"), ("a", 5, "h"), ("a", 10, "w"), ("a", 15, "w"), ("a", 20, "s"), ("b", 3, "w"), ("b", 14, "h")]
    df = spark.createDataFrame([(u, T0 + timedelta(hours=h), loc) for u, h, loc in v], "uid string, start_timestamp timestamp_ntz, location_id string")
    assert [r[2] for r in rows(traj.heuristic_purposes(df).select("uid", "start_timestamp", "purpose"), "uid", "start_timestamp")] == ["HOME", "HOME", "WORK", "WORK", "OTHER", "HOME", "WORK"]


def test_stays_and_panels(spark):
    pts = [(0, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 2.0), (3, 1.0, 1.0), (4, None, 1.0), (5, None, 1.0)]
    df = spark.createDataFrame([("u", T0 + timedelta(hours=h), a, b) for h, a, b in pts], "uid string, datetime timestamp_ntz, lat double, lng double")
    assert [r.datetime.hour for r in traj.collapse_to_stays(df).orderBy("datetime").collect()] == [0, 2, 3, 4, 5]
    still = spark.createDataFrame([("u", T0 + timedelta(hours=h), 1.0, 1.0) for h in range(5)], df.schema)
    out, warning = traj.adapt(still, "auto")
    assert warning and out.count() == 1
    assert traj.adapt(still, "off")[1] is None


def test_wasserstein_against_order_statistics(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=500).round(2), rng.normal(0.3, 2, size=500).round(2)
    da, db = (spark.createDataFrame([(float(x),) for x in v], "v double") for v in (a, b))
    assert distance.wasserstein(da, db, "v").first().w1 == pytest.approx(np.abs(np.sort(a) - np.sort(b)).mean(), abs=1e-12)
    g = distance.wasserstein(da.withColumn("g", F.lit(1)), db.withColumn("g", F.lit(1)), "v", ["g"])
    assert g.first().w1 == pytest.approx(np.abs(np.sort(a) - np.sort(b)).mean(), abs=1e-12)
    none = distance.wasserstein(da.where("v > 1e9"), db, "v").first().w1
    assert none is None or math.isnan(none) or none == 0.0


def test_jensen_shannon(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "k string, w double")
    b = spark.createDataFrame([("z", 3.0), ("q", float("nan"))], "k string, w double")
    assert distance.jensen_shannon(a, b, ["k"], "w").first().jsd == pytest.approx(math.log(2))
    assert distance.jensen_shannon(a, a, ["k"], "w").first().jsd == pytest.approx(0)


def test_ecdf_closes_at_the_cutoff(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    c = rows(distance.ecdf(df, "v", 0.85), "x")
    assert c[-1] == (9.0, 0.85) and c[0] == (1.0, 0.1)
    assert distance.ecdf_at(distance.ecdf(df, "v"), 3.5).first().p == pytest.approx(0.3)
    assert len(rows(distance.ecdf(spark.range(5000).select(F.col("id").cast("double").alias("v")), "v"), "x")) <= 401


def test_filters(spark):
    d = [datetime(2024, 1, 5, 6), datetime(2024, 1, 6, 23), datetime(2024, 1, 8, 0), None]
    df = spark.createDataFrame([(x,) for x in d], "datetime timestamp_ntz")
    got = {r.filter_key: r["count"] for r in filters.by_filter(df, special={"s": (date(2024, 1, 6), date(2024, 1, 8))}).groupBy("filter_key").count().collect()}
    assert got == {"all": 4, "weekday": 2, "weekend": 1, "s": 2, "morning": 1, "evening": 1, "night": 1}


def test_motifs():
    m = profiles.motif_of(["h", "w", "h"])
    assert m >> 36 == 2 and profiles.adjacency(m) == [[0, 1], [1, 0]]
    assert profiles.motif_of(["a", "b", "c", "a"]) == profiles.motif_of(["x", "z", "y", "x"])
    assert profiles.motif_of(list("abcdefg")) == -1
    assert profiles.motif_of(["h"]) == 1 << 36


def test_published_motif_ids_are_canonical():
    for m, _ in profiles.LITERATURE:
        a = profiles.adjacency(m)
        edges = frozenset((i, j) for i, r in enumerate(a) for j, x in enumerate(r) if x)
        assert profiles.canonical_id(len(a), edges) == m
    assert sum(p for _, p in profiles.LITERATURE) == pytest.approx(90.08)


def test_distinct_runs():
    for s in ([], [1], [1, 1, 1], [1, 2, 1, 3, 1, 2], list(range(8)), [0, 1] * 5):
        assert profiles.distinct_runs(s) == len({tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)})


def test_power_and_visitation_laws(spark):
    b = spark.createDataFrame([(float(x), 5.0 * x**-1.5) for x in range(1, 21)], "rf double, rho double")
    fit = laws.visitation_fit(b).first()
    assert (fit.eta, fit.mu, fit.r2) == (pytest.approx(1.5), pytest.approx(5), pytest.approx(1))
    v = [("u", T0, "a"), ("u", T0 + timedelta(hours=3), "b"), ("u", T0 + timedelta(days=1), "a"), ("v", T0, "a"), ("v", T0 + timedelta(hours=2), "c")]
    df = spark.createDataFrame(v, "uid string, datetime timestamp_ntz, location_id string")
    assert rows(laws.daily_locations(df), "n_locations") == [(1, 1, pytest.approx(1 / 3)), (2, 2, pytest.approx(2 / 3))]


def test_co_presence(spark):
    c = [("a", T0, "x"), ("b", T0, "x"), ("a", T0 + timedelta(days=1), "x"), ("b", T0 + timedelta(days=1), "x"), ("c", T0 + timedelta(days=1), "x"), ("a", T0 + timedelta(days=2), "y")]
    df = spark.createDataFrame(c, "uid string, datetime timestamp_ntz, location_id string")
    e, skipped = graph.co_presence(df)
    assert [(r.u, r.v, r.days) for r in e.orderBy("u", "v").collect()] == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    assert e.where("days = 2").first().persistence == pytest.approx(2 / 3)
    e, skipped = graph.co_presence(df, 2)
    assert skipped.first().skipped_groups == 1 and e.count() == 1


def test_clustering_and_overlap(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3)], "u long, v long")
    got = {r.node: r.clustering for r in graph.clustering(e).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: pytest.approx(1 / 3), 3: 0.0}
    o = {(r.u, r.v): r.overlap for r in graph.overlap(e).collect()}
    assert o[0, 1] == pytest.approx(1 / 3) and o[2, 3] == 0.0
    assert {(r.u, r.v): r.overlap for r in graph.overlap(e, True).collect()}[0, 1] == 1.0


def test_null_model_is_seeded_and_near_its_degrees(spark):
    d = spark.range(200).select(F.col("id").alias("node"), F.lit(10).cast("long").alias("degree"))
    a, b = graph.null_model(d, 1), graph.null_model(d, 1)
    assert a.exceptAll(b).count() == 0
    assert 800 < a.count() < 1200


def test_legs_index_and_trips(spark):
    s = [(1, 0, T0, T0 + timedelta(hours=1), 1.0, 1.0, 10.0, "HOME"), (1, 1, T0 + timedelta(hours=2), T0 + timedelta(hours=3), 1.0, 2.0, 30.0, "WORK")]
    df = spark.createDataFrame(s, "uid long, stop_id long, arrival timestamp_ntz, departure timestamp_ntz, lat double, lng double, trip_duration_minutes double, purpose string")
    legs = timeline.legs_index(df).orderBy("t_start", "kind").collect()
    assert [(r.kind, r.t_start, r.o_lng) for r in legs] == [("dwell", T0, 1.0), ("leg", T0 + timedelta(hours=1, minutes=30), 1.0), ("dwell", T0 + timedelta(hours=2), 2.0)]
    assert timeline.is_truncated(timeline.legs_index(df), T0, T0 + timedelta(days=1), (0.0, 0.0, 5.0, 5.0), 1) is False


def test_crp_order(spark):
    df = spark.createDataFrame([(0, "wd-0", 1), (0, "we-0", 2), (0, "wd-1", 5), (1, "wd-0", 9)], "agent long, diary_id string, usage_count long")
    assert [r.diary_id for r in timeline.crp_rows(df, 0).collect()] == ["wd-1", "we-0", "wd-0"]


def test_transitions(spark):
    v = [("u1", "a"), ("u1", "b"), ("u1", "a"), ("u2", "b"), ("u2", "b")]
    df = spark.createDataFrame([(u, T0 + timedelta(hours=i), p) for i, (u, p) in enumerate(v)], "uid string, start_timestamp timestamp_ntz, purpose string")
    t = activity.transitions(df).collect()
    assert sorted((r.a, r.b) for r in t) == [("a", "b"), ("b", "a"), ("b", "b")] and all(r.pct == pytest.approx(100 / 3) for r in t)


def test_midnight_split_and_bins(spark):
    df = spark.createDataFrame([(1, "x", datetime(2024, 1, 1, 23), datetime(2024, 1, 2, 1, 30)), (1, "x", T0, T0)], "uid long, activity string, arrival timestamp_ntz, departure timestamp_ntz")
    assert [(r.day, r.minutes) for r in activity.split_midnight(df).orderBy("day").collect()] == [(date(2024, 1, 1), 60.0), (date(2024, 1, 2), 90.0)]
    b = activity.daily_profile(df, "arrival", "departure", "activity", 60)
    assert {r.bin: r.seconds for r in b.collect()} == {23: 3600, 0: 3600, 1: 1800}
    with pytest.raises(ValueError):
        activity.in_bins(df, "arrival", "departure", 7)


def test_waypoint_legs_start_at_zero(spark):
    p = [(1, 1, 0, 1.0, 1.0, T0, "Car"), (1, 1, 1, 1.0, 1.1, T0 + timedelta(minutes=5), "walk"), (1, 2, 0, 1.0, 1.0, T0, "car"), (1, 3, 0, None, None, T0, "bus"), (1, 3, 1, 1.0, 1.0, T0, "bus")]
    df = spark.createDataFrame(p, "uid long, stop_id long, seq int, lat double, lng double, t timestamp_ntz, mode string")
    got = transport.waypoint_legs(df).collect()
    assert len(got) == 1 and got[0].mode == "car" and 11 < got[0].jump_km < 12 and got[0].duration_minutes == 5


def test_allocation_and_samples(spark):
    assert sampling.allocated([0.5, 0.3, 0.2], 10) == [5, 3, 2]
    assert sum(sampling.allocated([0.9, 0.05, 0.05], 10, 4)) == 10
    assert sum(sampling.log_normal_pmf(1.0, 0.5, 10)) == pytest.approx(1)
    df = spark.range(100).select(F.lit(1).alias("g"), "id", F.when(F.col("id") < 10, 100.0).otherwise(0.01).alias("w"))
    got = sampling.weighted(df, ["g"], "id", "w", 8).collect()
    assert len(got) == 8 and sum(r.id < 10 for r in got) >= 7


def test_shortest_paths(spark):
    g = spark.createDataFrame([(0, 1, 100.0, 5), (1, 2, 100.0, 5), (0, 2, 50.0, 20), (0, 1, 1.0, 9)], "from_node long, to_node long, length_m double, weight_ds long")
    p = spark.createDataFrame([(0, 2), (2, 0), (-1, 2)], "a long, b long")
    assert rows(routing.shortest(g, p), "a") == [(-1, 2, 0.0, False), (0, 2, 200.0, True), (2, 0, 0.0, False)]


def test_density_classes_and_cells(spark):
    df = spark.createDataFrame([(48.85, 2.35), (91.0, 0.0), (None, 1.0)], "lat double, lng double")
    r = df.select(geo.cell("lat", "lng", 9).alias("c")).collect()
    assert r[0].c is not None and r[1].c is None and r[2].c is None
    c = df.limit(1).select(geo.cell("lat", "lng", 9).alias("c"))
    got = c.select(geo.cell_resolution("c"), *geo.cell_centre("c"), F.size(geo.cell_disk("c", 2)), geo.cell_ring("c")).first()
    assert got[0] == 9 and abs(got[1] - 48.85) < 0.004 and got[3] == 25 and got[4][0] == got[4][-1]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, T0, 1.0, 2.0), (2, T0 + timedelta(days=1), 1.0, 2.0)], "uid long, datetime timestamp_ntz, lat double, lng double")
    assert io.append_days(df, f"{tmp_path}/t") and not io.append_days(df.where("uid > 9"), f"{tmp_path}/t")
    assert io.parquet(spark, f"{tmp_path}/t", ["uid"]).count() == 2
    with pytest.raises(ValueError, match="nope"):
        io.parquet(spark, f"{tmp_path}/t", ["nope"])
    df.write.parquet(f"{tmp_path}/run_20240101T000000.parquet")
    df.write.parquet(f"{tmp_path}/run_20240102T000000.parquet")
    assert [s for s, _ in io.discover_runs(spark, str(tmp_path), "run")] == ["20240102T000000", "20240101T000000"]
    built = []
    for _ in range(2):
        assert io.derived(spark, str(tmp_path), "d", ["k"], lambda: built.append(1) or df).count() == 2
    assert len(built) == 1
    (tmp_path / "n.json").write_text('{"nodes": [[0, 0, 1, "a"], [1, 1, 2, "b"]], "edges": [[0, 1, 0.5]], "degrees": [1, 1], "node_count": 2, "edge_count": 1}')
    nodes, edges = io.social_network(spark, str(tmp_path / "n.json"))
    assert nodes.count() == 2 and edges.first().weight == 0.5
    (tmp_path / "m.json").write_text('{"nodes": [[0, 0, 1, "a"]], "edges": [], "degrees": [], "node_count": 2, "edge_count": 0}')
    with pytest.raises(ValueError):
        io.social_network(spark, str(tmp_path / "m.json"))


def test_generation_is_seeded(spark):
    a, b = simulate.population(spark, 300), simulate.population(spark, 300)
    assert a.exceptAll(b).count() == 0
    assert 0.4 < a.where("gender = 'female'").count() / 300 < 0.6
    p = spark.createDataFrame([(i, 48.8 + i / 100, 2.3, 1.0) for i in range(10)], "loc long, lat double, lng double, relevance double")
    t = simulate.explore_and_return(spark, p, 5, 20)
    assert t.count() == 100 and t.exceptAll(simulate.explore_and_return(spark, p, 5, 20)).count() == 0
    w = spark.createDataFrame([(1, 1, T0, T0 + timedelta(seconds=100), [1.0, 3.0])], "uid long, stop_id long, departure timestamp_ntz, arrival timestamp_ntz, weights array<double>")
    assert [r.t for r in simulate.waypoint_times(w).orderBy("seq").collect()] == [T0, T0 + timedelta(seconds=25), T0 + timedelta(seconds=100)]


def test_report_and_registered_functions(spark, tmp_path):
    from wanderframe.functions.register import register
    from wanderframe.plans import compare

    def side(shift):
        rows = [(f"u{u}", T0 + timedelta(hours=4 * k), 48.8 + 0.01 * ((u + k + shift) % 3), 2.3 + 0.01 * (k % 2), ("HOME", "WORK", "OTHER")[k % 3], ("walk", "car")[k % 2]) for u in range(4) for k in range(6)]
        return spark.createDataFrame(rows, "uid string, datetime timestamp_ntz, lat double, lng double, purpose string, mode string")

    side(0).write.parquet(f"{tmp_path}/s")
    side(1).write.parquet(f"{tmp_path}/o")
    got = compare.report_from_paths(spark, f"{tmp_path}/s", f"{tmp_path}/o", f"{tmp_path}/r.json", sections=("distributions", "activity", "cpc", "transport"))
    assert got["all"]["jsd_activity"] == 0 and got["all"]["w1_visits_per_user"] == 0 and 0 <= got["all"]["cpc_8"] <= 1
    with pytest.raises(ValueError):
        compare.report(side(0), side(1), ("nothing",))
    assert "haversine_km" in register(spark)
    r = spark.sql("SELECT haversine_km(0D, 0D, 0D, 1D) AS d, haversine_km(NULL, 0D, 0D, 1D) AS n, cell_lat(cell_id(48.85D, 2.35D, 9)) AS lat, motif_id(array('h', 'w', 'h')) AS m").first()
    assert r.d == pytest.approx(111.195, abs=0.01) and r.n is None and abs(r.lat - 48.85) < 0.004 and r.m >> 36 == 2
    days = spark.sql("SELECT * FROM split_midnight(TIMESTAMP_NTZ'2024-01-01 23:00:00', TIMESTAMP_NTZ'2024-01-02 01:00:00')").collect()
    assert len(days) == 2


def test_micro_activities_fill_the_stops(spark):
    s = [(1, k, T0 + timedelta(hours=3 * k), T0 + timedelta(hours=3 * k + 2), ("HOME", "WORK")[k % 2]) for k in range(4)]
    df = spark.createDataFrame(s, "uid long, stop_id long, arrival timestamp_ntz, departure timestamp_ntz, purpose string")
    got = simulate.micro_activities(df).groupBy("stop_id").agg(F.min("arrival").alias("a"), F.max("departure").alias("d"), F.sum(scalar.minutes_between("arrival", "departure")).alias("m")).orderBy("stop_id").collect()
    assert [(r.a, r.d, r.m) for r in got] == [(x[2], x[3], 120.0) for x in s]
