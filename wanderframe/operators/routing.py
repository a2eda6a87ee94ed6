"""Road and rail graphs: building them from segments, and shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..sources.work import dense_ranks, forget, stored

# Speeds in km/h by class, where a segment states none.
SPEEDS = {"motorway": 120.0, "trunk": 90.0, "primary": 70.0, "secondary": 60.0, "tertiary": 50.0, "residential": 30.0, "service": 20.0}
RAIL_SPEEDS = {"rail": 100.0, "subway": 35.0, "light_rail": 30.0, "tram": 20.0}


def speed(cls, limits, share: float = 0.8, table: dict[str, float] = SPEEDS, default: float = 40.0):
    """The limit that holds at the middle of the segment, or its class's speed, times a share.

    ``limits`` is an array of (low, high, kmh) over the segment's length from 0 to 1."""
    middle = F.get(F.filter(limits, lambda x: (F.coalesce(x.low, F.lit(0.0)) <= 0.5) & (F.coalesce(x.high, F.lit(1.0)) >= 0.5) & x.kmh.isNotNull()), F.lit(0)).getField("kmh")
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), cls)
    return F.coalesce(middle, own, F.lit(default)) * share


def directions(restrictions):
    """(forward, backward) allowed: array of (access, heading); no heading denies both."""
    denied = lambda way: F.exists(F.coalesce(restrictions, F.array().cast("array<struct<access:string,heading:string>>")), lambda r: (r.access == "denied") & (r.heading.isNull() | (r.heading == way)))
    return ~denied("forward"), ~denied("backward")


def edges(segments: DataFrame, both: bool = False, table: dict[str, float] = SPEEDS) -> DataFrame:
    """Directed edges between consecutive connectors of segments.

    ``segments``: segment_id, class, connectors (array of id, at, lat, lng), and for roads
    speed_limits and access_restrictions.  Weights are tenths of seconds, at least one."""
    c = segments.select("*", F.explode("connectors").alias("c"))
    w = Window.partitionBy("segment_id").orderBy("c.at", "c.id")
    step = c.withColumn("n", F.lead("c").over(w)).where("n IS NOT NULL AND n.id <> c.id")
    length = haversine("c.lat", "c.lng", "n.lat", "n.lng", 6371000.0)
    limits = F.col("speed_limits") if "speed_limits" in segments.columns else F.array().cast("array<struct<low:double,high:double,kmh:double>>")
    kmh = speed(F.col("class"), limits, 1.0 if both else 0.8, table)
    if both or "access_restrictions" not in segments.columns:
        ahead = back = F.lit(True)
    else:
        ahead, back = directions(F.col("access_restrictions"))
    way = F.array_compact(F.array(F.when(ahead, F.struct(F.col("c.id").alias("from_node"), F.col("n.id").alias("to_node"))), F.when(back, F.struct(F.col("n.id").alias("from_node"), F.col("c.id").alias("to_node")))))
    out = step.select(F.inline(way), length.alias("length_m"), kmh.alias("speed_kmh"), F.col("class"))
    return out.withColumn("weight_ds", F.greatest(F.lit(1), F.round(F.col("length_m") / (F.col("speed_kmh") / 3.6) * 10).cast("long")))


def nodes(segments: DataFrame) -> DataFrame:
    """(node_idx, connector_id, lat, lng): connectors in order of their id."""
    c = segments.select(F.explode("connectors").alias("c")).groupBy("c.id").agg(F.min(F.struct("c.lat", "c.lng")).alias("p"))
    return dense_ranks(c, ["id"], "node_idx").select("node_idx", F.col("id").alias("connector_id"), "p.lat", "p.lng")


def relaxed(light: DataFrame, pairs: DataFrame) -> DataFrame:
    """As :func:`shortest`, by joins alone, for graphs that no task can hold.

    The reach of each origin is a table; a round joins what the last one improved with the
    edges, keeps the least of each origin and node, and is stored.  Rounds end with the first
    that improves nothing, at the latest after as many as the longest path has edges."""
    key = ["a", "node"]
    origins = pairs.select("a").distinct()
    reach = stored(origins.select("a", F.col("a").alias("node"), F.lit(0).cast("long").alias("w"), F.lit(0.0).alias("m"), F.lit(True).alias("fresh")))
    e = light.select("from_node", "to_node", "m.weight_ds", "m.length_m")
    while True:
        step = reach.where("fresh").join(e, F.col("node") == F.col("from_node")).select("a", F.col("to_node").alias("node"), (F.col("w") + F.col("weight_ds")).alias("w"), (F.col("m") + F.col("length_m")).alias("m"))
        step = step.groupBy(*key).agg(F.min(F.struct("w", "m")).alias("s"))
        both = reach.join(step, key, "full_outer")
        old = F.when(F.col("w").isNotNull(), F.struct("w", "m"))
        best = F.least(old, F.col("s"))  # least passes over nulls
        new = stored(both.select(*key, best.alias("x"), (old.isNull() | (best < old)).alias("fresh")).select(*key, "x.w", "x.m", "fresh"))
        forget(reach)
        reach = new
        if reach.where("fresh").isEmpty():
            break
    out = pairs.select("a", "b").distinct().join(reach.select("a", F.col("node").alias("b"), "m"), ["a", "b"], "left")
    return out.select("a", "b", F.coalesce("m", F.lit(0.0)).alias("metres"), F.col("m").isNotNull().alias("connected"))


def shortest(graph: DataFrame, pairs: DataFrame, limit_mb: int = 512) -> DataFrame:
    """(a, b, metres, connected): length of the fastest path of each distinct pair of nodes,
    of equally fast ones the shortest; negative nodes are connected to nothing.

    Of parallel edges the lightest holds.  A graph of at most ``limit_mb`` is sent to every
    task; pairs are dealt by origin, so that one search serves all its targets.  A larger one
    stays distributed (:func:`relaxed`).
    """
    import heapq

    import numpy as np
    import pyarrow as pa

    light = graph.where("from_node <> to_node AND from_node >= 0 AND to_node >= 0").groupBy("from_node", "to_node").agg(F.min(F.struct("weight_ds", "length_m")).alias("m"))
    size = light.count() * 32 / 1e6
    if size > limit_mb:
        known = relaxed(light, pairs.where("a >= 0 AND b >= 0"))
        lost = pairs.select("a", "b").distinct().where("NOT (a >= 0 AND b >= 0)").select("a", "b", F.lit(0.0).alias("metres"), F.lit(False).alias("connected"))
        return known.unionByName(lost)
    e = light.select("from_node", "to_node", "m.weight_ds", "m.length_m").toArrow()
    src, dst, weight, length = (e.column(i).to_numpy() for i in range(4))
    order = np.argsort(src, kind="stable")
    src, dst, weight, length = src[order], dst[order], weight[order], length[order]
    shared = pairs.sparkSession.sparkContext.broadcast((src, dst, weight, length))

    def search(start: int, targets: set[int], g) -> dict[int, float]:
        s, d, w, m = g
        best, done, found = {start: (0, 0.0)}, set(), {}
        heap = [(0, 0.0, start)]
        while heap and len(found) < len(targets):
            t, metres, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            if x in targets:
                found[x] = metres
            lo, hi = np.searchsorted(s, (x, x + 1))
            for y, c, q in zip(d[lo:hi].tolist(), w[lo:hi].tolist(), m[lo:hi].tolist(), strict=True):
                if y not in done and (t + c, metres + q) < best.get(y, (1 << 62, 0.0)):
                    best[y] = (t + c, metres + q)
                    heapq.heappush(heap, (t + c, metres + q, y))
        return found

    def run(batches):
        g = shared.value
        for b in batches:
            a, t, metres, ok = [], [], [], []
            for start, targets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = search(start, set(targets), g) if start >= 0 else {}
                for x in targets:
                    a.append(start)
                    t.append(x)
                    metres.append(got.get(x, 0.0))
                    ok.append(x in got)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(t, pa.int64()), pa.array(metres, pa.float64()), pa.array(ok)], names=["a", "b", "metres", "connected"])

    by_start = pairs.select("a", "b").distinct().groupBy("a").agg(F.collect_list("b").alias("bs"))
    return by_start.mapInArrow(run, "a long, b long, metres double, connected boolean")


def road_jumps(df: DataFrame, node_table: DataFrame, graph: DataFrame, metres: float = 750.0) -> DataFrame:
    """(uid, datetime, jump_km, routed): consecutive moves along the roads, or as the crow
    flies where an end has no road near or no path leads."""
    from .od import snap

    w = Window.partitionBy("uid").orderBy("datetime")
    points = df.select(F.xxhash64("lat", "lng").alias("id"), "lat", "lng").distinct()
    at = snap(points, node_table.select(F.col("node_idx").alias("node"), "lat", "lng"), metres).select("id", "node")
    moves = df.select("uid", "datetime", "lat", "lng", F.lag("lat").over(w).alias("plat"), F.lag("lng").over(w).alias("plng")).where("plat IS NOT NULL")
    m = moves.withColumn("id", F.xxhash64("plat", "plng")).join(at.withColumnRenamed("node", "a"), "id").withColumn("id", F.xxhash64("lat", "lng")).join(at.withColumnRenamed("node", "b"), "id")
    routes = shortest(graph, m.where("a >= 0 AND b >= 0").select("a", "b"))
    crow = haversine("plat", "plng", "lat", "lng")
    j = m.join(routes, ["a", "b"], "left").withColumn("routed", F.coalesce("connected", F.lit(False)))
    return j.select("uid", "datetime", F.when(F.col("routed"), F.col("metres") / 1000).otherwise(crow).alias("jump_km"), "routed")
