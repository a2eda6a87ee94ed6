"""What queries do on tables that are denser than the smallest test tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wanderframe.functions.digests import md5_heads
from wanderframe.operators import distance, graph, presence, profiles, quantiles, tessellation
from wanderframe.sources import work


def crowded(spark, at, users=30, n=900):
    """Events so dense that every place of a day has more users than the graph's cap."""
    e = spark.range(n).select((F.col("id") * 40).alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id as int), 0)").alias("ts"), ((F.col("id") % users) * 40).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    e.write.parquet(f"{at}/events.parquet")
    return str(at)


def test_metrics_of_a_graph_without_edges_are_not_compared(spark, tmp_path):
    """As its SQL, which joins both sides' summaries."""
    assert entry.queries()["graph_metric_summaries"](spark, crowded(spark, tmp_path)).collect() == []


@pytest.mark.parametrize("block", [2048, 7])
def test_friends_in_a_crowd_are_those_drawn_by_name(spark, monkeypatch, block):
    """Many around or few: the same friends."""
    monkeypatch.setattr(tessellation, "BLOCK", block)
    people = spark.range(60).select(F.col("id").alias("uid"), (F.lit(7 << 52) + F.col("id") % 3).cast("long").alias("home"), (F.col("id") % 4).alias("work"))
    one, other = (sorted(map(tuple, tessellation.friendships(people, few=f).collect())) for f in (1024, 20))
    assert one == other and len(one) > 60


def test_friends_in_a_large_crowd(spark):
    """So many around that only high draws are kept: still those drawn by name."""
    people = spark.range(700).select(F.col("id").alias("uid"), F.lit(7 << 52).cast("long").alias("home"), (F.col("id") % 4).alias("work"))
    one, other = (sorted(map(tuple, tessellation.friendships(people, few=f).collect())) for f in (1024, 20))
    assert one == other and len(one) > 700


def test_metrics_of_crowded_places_are_whole(spark, tmp_path):
    """Thirty users at one place: all pairs of them."""
    got = {r.metric: r for r in entry.queries()["graph_metric_summaries"](spark, crowded(spark, tmp_path)).collect()}
    assert (got["degree"].obs_n, got["degree"].obs_mean, got["degree"].obs_std) == (30, 29.0, 0.0)
    assert (got["overlap"].obs_n, got["overlap"].obs_p10) == (435, round(28 / 30, 6))
    assert got["clustering"].obs_median == 1.0


def test_metrics_of_places_without_company_are_not_compared(spark, tmp_path):
    """As its SQL, which joins both sides' summaries."""
    e = spark.range(40).select((F.col("id") * 40).alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int), 0, 0, 0)").alias("ts"), (F.col("id") * 40).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    assert entry.queries()["graph_metric_summaries"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize(("side", "sparse"), [(4096, 64), (64, 1 << 40), (32, 1 << 40), (32, 0)])
def test_metrics_without_a_list_of_pairs(spark, monkeypatch, side, sparse):
    """In blocks of any size, with users alike, alone or unnamed: as from the list of pairs."""
    monkeypatch.setattr(presence, "SIDE", side)
    monkeypatch.setattr(presence, "SPARSE", sparse)
    users = "CASE WHEN id % 97 = 0 THEN NULL ELSE CASE WHEN id % 5 = 0 THEN id % 130 + 1000 ELSE id % 130 END END"
    places = "CASE WHEN id % 5 = 0 AND id % 130 < 60 THEN 7 WHEN id % 89 = 0 THEN NULL WHEN id % 130 = 3 THEN -id ELSE pmod(hash(id), 25) END"
    df = spark.range(900).selectExpr(f"{users} AS uid", f"{places} AS location_id", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 3 as int), 0, 0, 0) AS datetime")
    listed = graph.counted(graph.metrics(graph.normalized(graph.co_presence(df, None)[0])))
    rounded = lambda t: sorted((r.metric, round(r.value, 12), r.n) for r in t.collect())
    got = rounded(presence.metric_values(df))
    assert got == rounded(listed) and len(got) > 100


def test_summaries_by_weight(spark):
    """A row that counts as many is that many rows, in selections of quantiles too."""
    df = spark.createDataFrame([(i % 2, float((i * i) % 23) / 7, i % 6 + 1) for i in range(90)], "g long, v double, n long")
    one = lambda t: df.select("g", "v", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k")) if t else df
    flat = lambda t: sorted(tuple(round(x, 9) for x in r) for r in t.collect())
    assert flat(distance.summary(one(True), "v", ["g"])) == flat(distance.summary(df, "v", ["g"], "n"))
    assert flat(distance.wasserstein(one(True).where("g = 0"), one(True).where("g = 1"), "v")) == flat(distance.wasserstein(df.where("g = 0"), df.where("g = 1"), "v", weight="n"))
    a, b = (quantiles.quantiles(t, "v", [0.1, 0.5, 0.93], ["g"], few=10, parts=16, weight=w) for t, w in ((one(True), None), (df, "n")))
    assert sorted((r.g, r.n, r.q) for r in a.collect()) == sorted((r.g, r.n, r.q) for r in b.collect())


def test_heads_of_md5():
    """Any lengths of both parts, over words and blocks."""
    rng = np.random.default_rng(3)
    for m in (0, 1, 4, 7, 8, 45, 60, 64, 70):
        for n in (0, 2, 3, 4, 11, 56, 64):
            a, b = rng.integers(33, 126, (3, m)).astype(np.uint8), rng.integers(33, 126, (5, n)).astype(np.uint8)
            want = [[int(hashlib.md5(x.tobytes() + y.tobytes()).hexdigest()[:8], 16) for y in b] for x in a]
            assert md5_heads(a, b).tolist() == want


@pytest.mark.parametrize("name", ["cast(id * id * id as string)", "concat('a name of many letters, number ', id)"])
def test_friends_are_sought_by_the_heads_of_draws(spark, monkeypatch, name):
    """Names of all lengths; what reaches Spark's rows is a few times the friends, not all pairs."""
    people = spark.range(600).select(F.expr(name).alias("uid"), F.lit(7 << 52).cast("long").alias("home"), (F.col("id") % 4).alias("work"))
    seen, drawn = spark.sparkContext.accumulator(0), tessellation._drawn

    def counted(batches):
        for batch in drawn(batches):
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(tessellation, "_drawn", counted)
    one, other = (sorted(map(tuple, tessellation.friendships(people, few=f).collect())) for f in (1024, 20))
    assert one == other and len(one) > 600
    assert 600 < seen.value < 600 * 600 / 4


def test_spans_are_the_steps_of_visits(spark, monkeypatch):
    """Nested, touching and alike visits included: runs by spans are runs by steps, of far fewer
    rows, and all rounds of the clusters read one table."""
    at = lambda h: F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(({h}) * 30 as int), 0)")
    v = spark.range(600).select((F.col("id") % 20).alias("uid"), at("id div 20 * 7 + id % 20").alias("start_timestamp"), at("id div 20 * 7 + id % 20 + CASE WHEN id % 20 < 5 THEN pmod(hash(id), 30) ELSE 7 END").alias("end_timestamp"), (F.hash("id") % 4).cast("string").alias("location_id"), F.lit("OTHER").alias("purpose"))
    steps, spans = profiles.token_steps(v, 5), profiles.token_spans(v, 5)
    each = spans.select("uid", F.explode(F.sequence("a", "b")).alias("t"), "token")
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, steps.collect()))
    assert spans.where("uid >= 5").count() <= 15 * 30 < steps.where("uid >= 5").count() / 5
    rounded = lambda df: sorted((r.uid, round(r.returner_run, 9), round(r.explorer_run, 9)) for r in df.collect())
    assert rounded(profiles.intermittency(steps)) == rounded(profiles.intermittency(spans))
    kept = []
    monkeypatch.setattr(profiles, "stored", lambda df, name: kept.append(name) or work.stored(df, name))
    assert profiles.clustered(profiles.intermittency(steps)).count() == 20 and "features" in kept


def test_anchors_are_joined_in_bounded_intervals(spark):
    """No window over draws, whatever the tiles: few, or all the weight in one of many."""
    tiles = tessellation.cover(spark, (2.25, 48.80, 2.33, 48.86), 9).withColumn("total_poi_count", F.lit(1).cast("long"))
    one = tiles.agg(F.min("tile_id")).first()[0]
    got = tessellation.home_anchors(tiles, 5000, F.when(F.col("tile_id") == one, 0.9).otherwise(1e-8))
    assert got.count() == 5000 and got.where(F.col("tile_id") == one).count() > 4990
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_search_holds_a_block_at_a_time(spark, monkeypatch):
    """No column of whole blocks: rows go through the tasks one by one, in any cut."""
    v = np.random.default_rng(5).normal(size=(90, 6)).round(1)
    df = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(np.concatenate([v, v[:30]]))], "vec_id long, g long, embedding array<double>")
    got = []
    for block, part, step in ((16384, 65536, 1024), (7, 11, 5), (200, 20, 3)):
        monkeypatch.setattr(graph, "BLOCK_ROWS", block)
        monkeypatch.setattr(graph, "PART_ROWS", part)
        monkeypatch.setattr(graph, "STEP", step)
        found = graph.knn(df, 4, group="g")
        assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
        got.append(sorted((r.id, r["rank"], r.neighbour) for r in found.collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 480


def test_leaders_of_large_groups(spark, monkeypatch):
    """Chunk by chunk, with copies of leaders and a small group beside: as one by one."""
    v = np.random.default_rng(6).normal(size=(120, 4))
    v = np.concatenate([v, v[:40]])
    rows = [(i % 4 // 3, (i * 37) % 160, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g long, id long, v array<double>").repartition(3)
    want = {}
    for g in (0, 1):
        led = []
        for _, i, x in sorted(r for r in rows if r[0] == g):
            x = np.array(x) / np.linalg.norm(x)
            want[g, i] = next((j for j, y in led if x @ y >= 0.8), i)
            if want[g, i] == i:
                led.append((i, x))
    monkeypatch.setattr(graph, "CHUNK", 50)
    assert {(r.g, r.id): r.leader for r in graph.leader_clusters(df, 0.8).collect()} == want
    monkeypatch.setattr(graph, "CHUNK", 8192)
    assert {(r.g, r.id): r.leader for r in graph.leader_clusters(df, 0.8).collect()} == want
