"""Quantiles and distances of columns with far values, and draws by weight."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanderframe.functions import geo
from wanderframe.operators import distance, quantiles, tessellation

PROBS = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]


def rows_of(spark):
    r = random.Random(1)
    rows = [("many", r.gauss(0, 1)) for _ in range(3000)] + [("many", 1e12), ("many", -1e300)]
    rows += [("ties", float(r.choice([1, 1, 1, 1, 2, 7]))) for _ in range(2000)] + [("same", 5.0)] * 700 + [("one", 3.5)] + [("two", 1.0), ("two", 2.0)]
    rows += [(None, float(i)) for i in range(50)] + [("none", None), ("none", float("nan")), ("many", float("inf")), ("many", None)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize("few, parts", [(1 << 20, 256), (40, 16)])
def test_quantiles_are_exact_in_any_number_of_rounds(spark, few, parts):
    rows, df = rows_of(spark)
    got = {r.g: r for r in quantiles.quantiles(df, "v", PROBS, ["g"], few, parts).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and np.isfinite(v):
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        assert got[g].q == pytest.approx(list(np.quantile(np.array(values), PROBS)), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("few", [1 << 20, 30])
def test_quantiles_without_groups_and_of_nothing(spark, few):
    df = spark.createDataFrame([(float(i % 97),) for i in range(1000)], "v double")
    assert quantiles.quantiles(df, "v", [0.5, 0.25], few=few, parts=16).first().q == np.quantile([i % 97 for i in range(1000)], [0.5, 0.25]).tolist()
    none = quantiles.quantiles(df.where("v < 0"), "v", [0.5], few=few).collect()
    assert [(r.n, r.q) for r in none] == [(0, [None])]
    assert quantiles.quantiles(df.withColumn("g", F.lit(1)).where("v < 0"), "v", [0.5], ["g"]).count() == 0


def test_no_part_holds_many_values_beside_a_far_one(spark):
    """100,000 values and one at 1e9: no part, and so no window, holds over 2 % of them."""
    df = spark.range(100_000).select((F.rand(1) * 3).alias("v")).unionByName(spark.createDataFrame([(1e9,)], "v double"))
    counts = [r["count"] for r in quantiles.in_parts(df, []).groupBy("part").count().collect()]
    assert sum(counts) == 100_001 and max(counts) <= 2000 and len(counts) > 200


def test_wasserstein_and_ecdf_with_a_far_value(spark):
    r = random.Random(2)
    a, b = [r.expovariate(1) for _ in range(3000)] + [1e9], [r.expovariate(2) for _ in range(2500)]
    frame = lambda x: spark.createDataFrame([(v, "k" if i % 2 else None) for i, v in enumerate(x)], "v double, g string")

    def w1(x, y):
        xs = np.unique(np.concatenate([x, y]))
        f, g = (np.searchsorted(np.sort(z), xs, "right") / len(z) for z in (x, y))
        return float(np.sum(np.abs(f - g)[:-1] * np.diff(xs)))

    assert distance.wasserstein(frame(a), frame(b), "v").first().w1 == pytest.approx(w1(np.array(a), np.array(b)), rel=1e-9)
    got = {x.g: x.w1 for x in distance.wasserstein(frame(a), frame(b), "v", ["g"]).collect()}
    assert got == {g: pytest.approx(w1(np.array(a[i::2]), np.array(b[i::2])), rel=1e-9) for g, i in ((None, 0), ("k", 1))}
    curve = sorted((x.x, x.p) for x in distance.ecdf(frame(a), "v", 1.0, 10**6).collect())
    want = np.sort(a)
    assert [x for x, _ in curve] == want.tolist() and curve[-1][1] == 1.0 and curve[0][1] == pytest.approx(1 / 3001)


def test_anchors_are_drawn_with_replacement(spark):
    """Exactly n rows, fewer or more than tiles; chances follow the weights."""
    tiles = tessellation.cover(spark, (2.25, 48.80, 2.33, 48.86), 7).withColumn("total_poi_count", (F.col("tile_id") % 4).cast("long"))
    k = tiles.count()
    for n in (0, 3, 20 * k + 7):
        got = tessellation.home_anchors(tiles, n).collect()
        assert sorted(r.anchor for r in got) == list(range(n))
    many = tessellation.home_anchors(tiles, 20_000)
    per = {r.tile_id: r["count"] / 20_000 for r in many.groupBy("tile_id").count().collect()}
    weights = {r.tile_id: 1 / (1 + r.total_poi_count) for r in tiles.collect()}
    total = sum(weights.values())
    assert all(abs(per.get(t, 0) - w / total) < 0.01 for t, w in weights.items())
    inside = many.join(tiles.select("tile_id", F.col("lat").alias("a"), F.col("lng").alias("o")), "tile_id").where((F.abs(F.col("lat") - F.col("a")) > 2.0**-7) | (F.abs(F.col("lng") - F.col("o")) > 2.0**-7))
    assert inside.count() == 0
    only = tessellation.home_anchors(tiles, 50, F.when(F.col("tile_id") == tiles.first().tile_id, 2.0)).select("tile_id").distinct().collect()
    assert [r.tile_id for r in only] == [tiles.first().tile_id]
    assert tessellation.home_anchors(tiles.limit(0), 10).count() == 0


def test_disks_go_around_the_earth(spark):
    h = spark.createDataFrame([(10.0, 179.99), (89.99, 0.0)], "lat double, lng double").withColumn("h", geo.cell("lat", "lng", 5))
    lat, lng = geo.cell_centre("d")
    got = h.select("h", F.explode(geo.cell_disk("h", 1)).alias("d")).select("h", lat.alias("lat"), lng.alias("lng"))
    assert got.where("lng < -180 OR lng > 180 OR lat > 90.1").count() == 0
    assert got.where("lat < 20 AND lng < 0").count() == 3 and got.where("lat < 20").count() == 9
