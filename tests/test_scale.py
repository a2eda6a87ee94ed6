"""Paths that only large inputs take, forced on small ones, against plain versions."""

import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanderframe.operators import distance, graph, od, routing, tessellation
from wanderframe.sources import io, work


def test_dense_ranks(spark):
    rng = np.random.default_rng(1)
    values = rng.permutation(500).tolist()
    df = spark.createDataFrame([(int(v), f"k{v}") for v in values], "v long, k string").repartition(7)
    got = work.dense_ranks(df, ["v"], "place").collect()
    assert all(r.place == r.v and r.k == f"k{r.v}" for r in got) and len(got) == 500


def test_halves_of_a_population(spark):
    for n in (1, 2, 7, 50):
        df = spark.range(n).select(F.col("id").alias("uid"))
        a, b = ({r.uid for r in half.collect()} for half in io.split_users(df, "s"))
        assert len(a) == (n + 1) // 2 and not a & b and len(a | b) == n


def test_paths_by_joins_equal_searches(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), int(w), float(w) * 1.5 + int(a)) for a, b, w in zip(rng.integers(0, 40, 160), rng.integers(0, 40, 160), rng.integers(1, 6, 160), strict=True)]
    g = spark.createDataFrame(edges, "from_node long, to_node long, weight_ds long, length_m double")
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(-1, 45, (60, 2))], "a long, b long")
    key = lambda df: sorted((r.a, r.b, round(r.metres, 6), r.connected) for r in df.collect())
    assert key(routing.shortest(g, pairs)) == key(routing.shortest(g, pairs, limit_mb=0))


@pytest.mark.parametrize("rows", [7, 4096])
def test_neighbours_in_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(graph, "BLOCK_ROWS", rows)
    v = np.random.default_rng(5).normal(size=(60, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -np.inf)
    got = {(r.id, r["rank"]): r.neighbour for r in graph.knn(df, 4).collect()}
    assert got == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(-sim[i])[:4])}


def test_distances_of_groups_with_gaps(spark):
    rows = [("a", 0, 1.0), ("a", 1, 3.0), ("a", 1, 5.0), (None, 0, 2.0), (None, 1, 2.5), ("b", 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, side long, v double")
    got = {r.g: r.w1 for r in distance.wasserstein(df.where("side = 0"), df.where("side = 1"), "v", ["g"]).collect()}
    assert got == {"a": 3.0, None: 0.5, "b": None}


def test_friends_in_a_crowded_cell(spark):
    """More people around than are named one by one: as many friends, none twice, and those
    of one work cell about twice as often."""
    people = spark.range(400).select(F.col("id").alias("uid"), F.lit(7 << 52).cast("long").alias("home"), (F.col("id") % 2).alias("work"))
    got = tessellation.friendships(people, few=50).collect()
    each = {}
    for r in got:
        assert r.src != r.dst and r.weight == (2.0 if r.src % 2 == r.dst % 2 else 1.0)
        each.setdefault(r.src, []).append(r.dst)
    assert all(len(set(x)) == len(x) for x in each.values())
    named = tessellation.friendships(people, few=1000).groupBy("src").count().collect()
    assert {r.src: r["count"] for r in named} == {s: len(x) for s, x in each.items()}
    same = sum(r.weight == 2 for r in got) / len(got)
    assert 0.6 < same < 0.73


def test_payloads_are_built_once(spark):
    cache = io.PayloadCache(spark, work.scratch(spark, "payloads"))
    built, gate = [], threading.Event()

    def build():
        built.append(1)
        gate.wait(5)
        return {"x": 1}

    found = []
    threads = [threading.Thread(target=lambda: found.append(cache.get("p", ["k"], build))) for _ in range(4)]
    for t in threads:
        t.start()
    gate.set()
    for t in threads:
        t.join()
    assert found == [{"x": 1}] * 4 and len(built) == 1


def test_centroids_of_binary_geometries():
    point = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    line = struct.pack(">BII", 0, 2, 3) + struct.pack(">6d", 0, 0, 2, 0, 2, 2)
    square = lambda x, s: struct.pack("<I", 5) + struct.pack("<10d", x, 0, x + s, 0, x + s, s, x, s, x, 0)
    holed = struct.pack("<BII", 1, 3, 2) + square(0, 4) + square(2, 2)
    many = struct.pack("<BII", 1, 6, 2) + (struct.pack("<BII", 1, 3, 1) + square(0, 1)) + (struct.pack("<BII", 1, 3, 1) + square(10, 1))
    assert io.wkb_centre(point) == (3.0, 4.0) and io.wkb_centre(line) == (1.5, 0.5)
    assert io.wkb_centre(many) == pytest.approx((5.5, 0.5))
    assert io.wkb_centre(holed) == pytest.approx(((16 * 2 - 4 * 3) / 12, (16 * 2 - 4 * 1) / 12))
    assert io.wkb_centre(None) == io.wkb_centre(b"") == io.wkb_centre(b"\x01\x63\x00\x00\x00") == (None, None)
    assert io.wkb_centre(struct.pack("<BII", 1, 3, 0)) == (None, None)


def far(a, b):
    p, q = np.radians(a[0]), np.radians(b[:, 0])
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(b[:, 1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * np.arcsin(np.sqrt(h))


def crowd(n, lat=48.8):
    """Points of which many share a place, around a few centres."""
    rng = np.random.default_rng(8)
    at = np.round(rng.normal(0, 0.004, (n, 2)) + rng.integers(0, 3, (n, 1)) * 0.006, 4) + [lat, 2.2]
    return np.concatenate([at, at[: n // 3]])


@pytest.mark.parametrize("lat", [48.8, 0.0, -70.0])
def test_neighbours_of_places_that_points_share(spark, lat):
    """Counts equal brute force, and rows between the steps are places, not pairs."""
    at = crowd(600, lat)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)] + [(5000, None, 2.2), (5001, float("nan"), 2.2)], "id long, lat double, lng double")
    want = {i: int(((far(x, at) <= 500) & (np.abs(at - x) <= 0.0045).all(axis=1)).sum()) - 1 for i, x in enumerate(at)}
    assert {r.id: r.n for r in od.neighbours_within(df).collect()} == want | {5000: 0, 5001: 0}
    plan = od.neighbours_within(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # places with their counts; no join makes pairs


def test_nearest_of_crowded_nodes(spark, monkeypatch):
    """Many nodes at each of many places: least node of the nearest place, on any grid."""
    at = crowd(400)
    spots = np.concatenate([crowd(300) + [0.0003, 0.0002]] * 4)
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)] + [(5000, 10.0, 2.2), (5001, None, 2.2)], "id long, lat double, lng double")
    nodes = spark.createDataFrame([(len(spots) - i, *map(float, x)) for i, x in enumerate(spots)], "node long, lat double, lng double")
    want = {5000: (-1, None), 5001: (-1, None)}
    for i, x in enumerate(at):
        d = far(x, spots)
        best = d.min()
        want[i] = (min(len(spots) - k for k in np.flatnonzero(d < best + 1e-6)), pytest.approx(best, abs=1e-6)) if best <= 750 else (-1, None)
    for crowded in (16, 10**6):
        monkeypatch.setattr(od, "CROWD", crowded)
        assert {r.id: (r.node, r.metres) for r in od.snap(points, nodes).collect()} == want
