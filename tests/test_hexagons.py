"""Hexagonal cells against published ones, and against each other."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wanderframe.functions import hexagons as H
from wanderframe.operators import polygons

# Published cells of points (latitude, longitude, resolution).
POINTS = {
    (37.3615593, -122.0553238, 7): "87283472bffffff", (37.3615593, -122.0553238, 5): "85283473fffffff", (40.689167, -74.044444, 10): "8a2a1072b59ffff",
    (37.7752702151959257, -122.418307270836565, 9): "8928308280fffff", (37.769377, -122.388519, 9): "89283082e73ffff",
}
# Published centres.
CENTRES = {"87283472bffffff": (37.35171820183272, -122.05032565263946), "85283473fffffff": (37.34579337536848, -121.97637597255124), "8a2a1072b59ffff": (40.6894218437, -74.0444313999)}
# Published boundaries (latitude, longitude), and first points of others.
RING = [(37.271355866731895, -121.91508032705622), (37.353926450852256, -121.86222328902491), (37.42834118609435, -121.92354999630156), (37.42012867767778, -122.03773496427027), (37.33755608435298, -122.090428929044), (37.26319797461824, -122.02910130919)]
FIRST = {"871fb0116ffffff": (48.41851708165447, 2.698163878468575), "871fb0121ffffff": (48.515507217271185, 2.786233140172542), "871fb012dffffff": (48.51781644860264, 2.8461272899312875)}
# A published cell with its neighbours.
DISK = ["87283472bffffff", "87283472affffff", "87283470cffffff", "87283470dffffff", "872834776ffffff", "872834729ffffff", "872834728ffffff"]


def ids(spark, names):
    return spark.createDataFrame([(n, int(n, 16)) for n in names], "name string, h long")


def every(spark, res):
    """All cells of a resolution, from the base cells down."""
    cells = spark.range(122).select((F.lit(1 << 59 | (1 << 45) - 1) + F.shiftleft(F.col("id"), 45)).alias("h"))
    for _ in range(res):
        cells = cells.select(F.explode(H.children("h")).alias("h"))
    return cells


def away(lat1, lng1, lat2, lng2):
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * math.asin(math.sqrt(a))


def test_published_cells(spark):
    rows = spark.createDataFrame([(*k, v) for k, v in POINTS.items()], "lat double, lng double, res int, want string")
    for res in {k[2] for k in POINTS}:
        got = rows.where(F.col("res") == res).select(H.cell_hex(H.cell("lat", "lng", res)).alias("h"), "want").collect()
        assert got and all(r.h == r.want for r in got)
    for r in ids(spark, CENTRES).select("name", H.centre("h").alias("c")).collect():
        assert tuple(r.c) == pytest.approx(CENTRES[r.name], abs=1e-9)
    assert [tuple(p) for p in ids(spark, ["85283473fffffff"]).select(H.boundary("h").alias("b")).first().b] == [pytest.approx(p, abs=1e-9) for p in RING]
    for r in ids(spark, FIRST).select("name", H.boundary("h")[0].alias("p")).collect():
        assert tuple(r.p) == pytest.approx(FIRST[r.name], abs=1e-9)
    assert sorted(x for x in ids(spark, DISK[:1]).select(H.cell_disk("h", 1, 7).alias("d")).first().d) == sorted(int(n, 16) for n in DISK)


def test_null_and_odd_coordinates(spark):
    rows = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, float("inf")), (91.0, 0.0), (0.0, -181.0)], "lat double, lng double")
    assert [r.h for r in rows.select(H.cell("lat", "lng", 8).alias("h")).collect()] == [None] * 6
    for e in (H.centre("h"), H.boundary("h"), H.cell_disk("h", 1, 5), H.neighbours("h", 5)):
        assert spark.sql("SELECT CAST(NULL AS BIGINT) AS h").select(e.alias("x")).first().x is None
    poles = spark.createDataFrame([(90.0, 0.0), (90.0, 77.0), (-90.0, 0.0), (-90.0, -5.0)], "lat double, lng double").select(H.cell("lat", "lng", 9).alias("h")).collect()
    assert poles[0] == poles[1] and poles[2] == poles[3] and poles[0] != poles[2]


@pytest.mark.parametrize("res", [0, 1, 2, 3])
def test_every_cell_holds_its_centre(spark, res):
    """All cells of the whole sphere: their number, and each centre encodes to its cell."""
    cells = every(spark, res).withColumn("c", H.centre("h"))
    got = cells.select("h", "c", H.cell("c.lat", "c.lng", res).alias("again")).agg(F.count("*").alias("n"), F.count_distinct("h").alias("u"), F.count_if(F.col("h") == F.col("again")).alias("same")).first()
    assert tuple(got) == (2 + 120 * 7**res,) * 3


def test_random_points_down_to_the_finest(spark):
    """A point's cell holds it, its centre encodes to itself, and so on, at odd and even
    resolutions, with a third of the points close to corners of the faces."""
    r = random.Random(1)
    s = H.sphere()
    points = [(math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for _ in range(1000)]
    for n in s.pentagons:
        f, ab = s.home[n]
        p = s.point(f, H._complex(*ab))
        lat, lng = math.degrees(math.asin(p[2])), math.degrees(math.atan2(p[1], p[0]))
        points += [(lat + r.uniform(-1, 1) * d, lng + r.uniform(-1, 1) * d) for d in (3, 0.3, 0.03, 0.003, 1e-4) for _ in range(8)]
    rows = spark.createDataFrame(points, "lat double, lng double")
    for res in (4, 5, 9, 12, 15):
        got = rows.withColumn("h", H.cell("lat", "lng", res)).withColumn("c", H.centre("h")).select("lat", "lng", "c", "h", H.cell("c.lat", "c.lng", res).alias("again"), H.parent("h", 1).alias("up"), H.is_pentagon("h").alias("p")).collect()
        assert all(x.h == x.again for x in got)
        assert all(away(x.lat, x.lng, x.c.lat, x.c.lng) <= 0.62 * H.STEP * 7 ** (-res / 2) for x in got)


@pytest.mark.parametrize("res", [0, 1, 2])
def test_neighbours_are_mutual(spark, res):
    """On the whole sphere: six neighbours, five of twelve cells, each the other's, all near."""
    pairs = every(spark, res).select("h", F.explode(H.neighbours("h", res)).alias("n"))
    rows = pairs.collect()
    links = {(x.h, x.n) for x in rows}
    assert len(links) == len(rows) and all((b, a) in links and a != b for a, b in links)
    counts = {}
    for a, _ in links:
        counts[a] = counts.get(a, 0) + 1
    assert sorted(counts.values()) == [5] * 12 + [6] * (len(counts) - 12) and len(counts) == 2 + 120 * 7**res
    at = {x.h: x.c for x in every(spark, res).select("h", H.centre("h").alias("c")).collect()}
    assert all(away(*at[a], *at[b]) < 1.3 * H.STEP * 7 ** (-res / 2) for a, b in links)


def test_disks_grow_ring_by_ring(spark):
    rows = spark.createDataFrame([(48.85, 2.35), (37.7, -122.4), (64.7, 10.536199075467643)], "lat double, lng double").withColumn("h", H.cell("lat", "lng", 6))
    got = rows.select(H.is_pentagon("h").alias("p"), *[F.size(H.cell_disk("h", k, 6)).alias(f"k{k}") for k in range(3)]).collect()
    assert [tuple(x) for x in got] == [(False, 1, 7, 19), (False, 1, 7, 19), (True, 1, 6, 16)]


def test_whole_tables_get_the_same_cells(spark):
    """Projections and the nested expressions agree, nulls and odd values included."""
    r = random.Random(2)
    points = [(r.uniform(-90, 90), r.uniform(-180, 180), i) for i in range(300)] + [(None, 1.0, 1), (1.0, None, 2), (float("nan"), 0.0, 3), (95.0, 0.0, 4)]
    rows = spark.createDataFrame(points, "lat double, lng double, face int")
    for res in (0, 7, 10):
        got = H.with_centre(H.with_cell(rows, "h", "lat", "lng", res), "h", "c_lat", "c_lng").withColumn("own", H.cell("lat", "lng", res)).withColumn("c", H.centre("own")).collect()
        assert len(got) == len(points) and all(x.h == x.own and ((x.c_lat, x.c_lng) == (None, None) if x.c is None else (x.c_lat, x.c_lng) == pytest.approx(tuple(x.c), abs=1e-12)) for x in got)
        assert sum(x.h is None for x in got) == 4


def test_parents_and_children(spark):
    rows = spark.createDataFrame([(48.85, 2.35), (-33.9, 151.2)], "lat double, lng double").withColumn("h", H.cell("lat", "lng", 9))
    for x in rows.select("h", H.parent("h", 5).alias("up"), H.children(H.parent("h", 8)).alias("kin"), H.cell("lat", "lng", 8).alias("own"), H.parent("h", 8).alias("p8"), H.resolution("h").alias("r")).collect():
        assert x.h in x.kin and len(x.kin) == 7 and x.r == 9 and x.up >> 52 & 15 == 5


@pytest.mark.parametrize("res", [1, 2, 3, 4])
def test_boundaries_enclose_and_meet(spark, res):
    """Sides of neighbouring cells are the same; corners have their place between three
    cells; a boundary's points are as far from the centre as from the neighbour's."""
    some = every(spark, min(res, 2))
    if res > 2:
        some = some.where(F.pmod(F.xxhash64("h"), F.lit(40)) == 0)
        for _ in range(res - 2):
            some = some.select(F.explode(H.children("h")).alias("h"))
    got = some.select("h", H.boundary("h").alias("b"), H.centre("h").alias("c"), H.is_pentagon("h").alias("p")).collect()
    sides = {}
    for x in got:
        assert len(x.b) in ((5, 10) if x.p else (6, 7, 8))
        assert not x.p or len(x.b) == (10 if res % 2 else 5)
        pts = [(round(q.lat, 8), round(q.lng, 8) % 360) for q in x.b]
        for a, b in zip(pts, pts[1:] + pts[:1], strict=True):
            sides.setdefault(frozenset([a, b]), []).append(x.h)
        assert all(0.3 < away(x.c.lat, x.c.lng, q.lat, q.lng) / (H.STEP * 7 ** (-res / 2)) < 0.66 for q in x.b)
    if res <= 2:  # the whole sphere: every side has two cells
        assert all(len(v) == 2 for v in sides.values())


def inside(rings, lng, lat):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > lat) != (y2 > lat) and lng < x1 + (lat - y1) / (y2 - y1) * (x2 - x1):
                n += 1
    return n % 2 == 1


SHAPES = {
    "box": [[(2.2, 48.8), (2.5, 48.8), (2.5, 48.95), (2.2, 48.95)]],
    "hole": [[(2.0, 48.0), (3.0, 48.0), (3.0, 49.0), (2.0, 49.0)], [(2.3, 48.3), (2.7, 48.35), (2.5, 48.7)]],
    "dateline": [[(179.2, -18.0), (-179.5, -18.2), (-179.3, -16.5), (179.0, -16.3)]],
    "star": [[(10, 0.0), (10.2, 0.8), (11, 1.0), (10.3, 1.2), (10.1, 2.0), (9.8, 1.2), (9.0, 1.0), (9.7, 0.8)]],
    "thin": [[(5.0, 60.0), (5.6, 60.3), (5.6, 60.302), (5.0, 60.002)]],
    "flat": [[(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)]],
}


def table_of(spark, shapes):
    rows = [(k, [[{"lng": float(x), "lat": float(y)} for x, y in ring] for ring in rings], 1) for k, rings in shapes.items()]
    return spark.createDataFrame(rows, "id string, rings array<array<struct<lng:double,lat:double>>>, cell int")


@pytest.mark.parametrize("res", [5])
def test_fill_equals_testing_each_centre(spark, res):
    got = {(r.id, r.cell) for r in polygons.fill(table_of(spark, SHAPES), res).collect()}
    want = set()
    for k, rings in SHAPES.items():
        wraps = k == "dateline"
        turned = [[(x + 360 if wraps and x < 0 else x, y) for x, y in ring] for ring in rings]
        xs, ys = [p[0] for r in turned for p in r], [p[1] for r in turned for p in r]
        step = 0.2 * math.degrees(H.STEP) * 7 ** (-res / 2)
        grid = [(min(ys) + i * step, min(xs) + j * step) for i in range(int((max(ys) - min(ys)) / step) + 2) for j in range(int((max(xs) - min(xs)) / step) + 2)]
        near = spark.createDataFrame(grid, "lat double, lng double").withColumn("lng", F.when(F.col("lng") > 180, F.col("lng") - 360).otherwise(F.col("lng"))).select(H.cell("lat", "lng", res).alias("h")).distinct()
        for x in near.select("h", H.centre("h").alias("c")).collect():
            lng = x.c.lng + 360 if wraps and x.c.lng < 0 else x.c.lng
            if inside(turned, lng, x.c.lat):
                want.add((k, x.h))
    assert got == want and (res < 5 or len({k for k, _ in got}) >= 4)


def test_compact_cells_stand_for_the_rest(spark):
    shapes = table_of(spark, {k: SHAPES[k] for k in ("hole", "dateline")})
    whole = {(r.id, r.cell) for r in polygons.fill(shapes, 5).collect()}
    small = polygons.fill(shapes, 5, compact=True)
    grown = small.withColumn("r", H.resolution("cell"))
    assert {r.r for r in grown.select("r").distinct().collect()} == {4, 5}
    once = grown.where("r = 4").select("id", F.explode(H.children("cell")).alias("cell"))
    assert {(r.id, r.cell) for r in grown.where("r = 5").select("id", "cell").unionByName(once).collect()} == whole


def test_fill_a_polar_cap_and_odd_polygons(spark):
    ring = [{"lng": a, "lat": b} for a, b in ((-180.0, 75.0), (-60.0, 75.0), (60.0, 75.0), (180.0, 75.0), (180.0, 90.0), (60.0, 90.0), (-60.0, 90.0), (-180.0, 90.0))]
    t = spark.createDataFrame([("cap", [ring]), (None, [[{"lng": 1.0, "lat": 1.0}, None, {"lng": 2.0, "lat": 1.0}, {"lng": 2.0, "lat": 3.0}, {"lng": None, "lat": 3.0}], None]), ("none", None), ("few", [[{"lng": 1.0, "lat": 1.0}]])], "id string, rings array<array<struct<lng:double,lat:double>>>")
    got = polygons.fill(t, 2).withColumn("c", H.centre("cell")).collect()
    want = {x.h for x in every(spark, 2).withColumn("c", H.centre("h")).where("c.lat > 75").collect()}
    assert {x.cell for x in got if x.id == "cap"} == want
    tri = [[(1.0, 1.0), (2.0, 1.0), (2.0, 3.0)]]
    assert {x.cell for x in got if x.id is None} == {x.h for x in every(spark, 2).withColumn("c", H.centre("h")).where("c.lat > 0 AND c.lat < 4 AND c.lng > 0 AND c.lng < 3").collect() if inside(tri, x.c.lng, x.c.lat)}
    assert {x.id for x in got} <= {"cap", None}
    assert polygons.fill(t.limit(0), 3).count() == 0
