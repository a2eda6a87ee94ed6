"""Metrics of whole co-presence graphs, whose pairs are too many to be listed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import dense_ranks, stored
from . import graph

#: Kinds of users in a block at most, and rows of a block that travel as one.
SIDE, STRIP = 4096, 32
#: Pairs are listed where there are many kinds of users and fewer than this part of all pairs meet.
SPARSE = 64


def metric_values(df: DataFrame, uid: str = "uid", ts: str = "datetime", location: str = "location_id") -> DataFrame:
    """(metric, value, n): how often each degree, clustering and overlap occurs in the graph of
    all users who were at one place on one day, however many were there.

    Users of the same days and places have the same neighbours: they are one kind, with a
    number.  Kinds are put into blocks; a task works out which kinds of two blocks meet, and
    then common neighbours are products of such blocks of bits, weighted by the kinds' numbers.
    A task holds two blocks and their product.  Only where few of many kinds meet, pairs and
    triangles are listed."""
    seen = graph.presences(df, uid, ts, location)
    groups = dense_ranks(seen.groupBy("day", "loc").agg(F.count("*").alias("k")).where("k > 1").select("day", "loc"), ["day", "loc"], "g")
    own = seen.join(groups, ["day", "loc"]).groupBy("n").agg(F.sort_array(F.collect_list("g")).alias("gs"))
    kinds = stored(dense_ranks(own.groupBy("gs").agg(F.count("*").alias("m"), F.min("n").alias("first")), ["first"], "c").select("c", "m", "gs"), "kinds")
    met = kinds.select(F.explode("gs").alias("g")).groupBy("g").agg(F.count("*").cast("double").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0))).first()[0]
    n, users = kinds.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    if not n or (n > SIDE and met * SPARSE < float(n) * n):
        return graph.counted(graph.metrics(graph.normalized(graph.co_presence(df, None, uid, ts, location)[0])))
    blocks = -(-n // SIDE)
    side = -(-n // blocks // STRIP) * STRIP
    blocks = -(-n // side)
    found = stored(_products(_meetings(kinds, blocks, side), blocks, side, users), "products")
    sums = found.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    overlap = sums.where("kind = 0").select(F.lit("overlap").alias("metric"), (F.col("a").cast("double") / F.col("b")).alias("value"), "n")
    nodes = sums.where("kind = 2").select("a", F.col("b").alias("degree"), "n").join(sums.where("kind = 1").select("a", (F.col("n") / 2).alias("links")), "a", "left").fillna(0, ["links"])
    degree = nodes.select(F.lit("degree").alias("metric"), F.col("degree").cast("double").alias("value"), "n")
    clustering = nodes.select(F.lit("clustering").alias("metric"), F.when(F.col("degree") > 1, 2.0 * F.col("links") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("value"), "n")
    return degree.unionByName(clustering).unionByName(overlap).groupBy("metric", "value").agg(F.sum("n").alias("n"))


def _meetings(kinds: DataFrame, blocks: int, side: int) -> DataFrame:
    """(i, k, strip, bits, m): which kinds of block i meet which of block k, some rows at a
    time, and in the first strip the numbers of the kinds of block k."""
    import numpy as np
    import pyarrow as pa

    strip = STRIP
    lists = stored(kinds.withColumn("i", F.expr(f"c div {side}")).groupBy("i").agg(F.collect_list(F.struct((F.col("c") % side).alias("pos"), "m", "gs")).alias("own")), "blocks")
    cells = lists.crossJoin(lists.select(F.col("i").alias("k"), F.col("own").alias("other"))).where("i <= k").repartition(min(4096, blocks * (blocks + 1) // 2))

    def read(block):
        pos, gs = block.field("pos").to_numpy(), block.field("gs")
        m = np.zeros(side, np.int64)
        m[pos] = block.field("m").to_numpy()
        g, at = gs.flatten().to_numpy(), np.repeat(pos, gs.value_lengths().to_numpy())
        order = np.argsort(g, kind="stable")
        names, starts = np.unique(g[order], return_index=True)
        return m, dict(zip(names.tolist(), np.split(at[order], starts[1:]), strict=True))

    def told(i: int, k: int, near: np.ndarray, m: np.ndarray):
        bits = np.packbits(near, axis=1)
        rows = [bits[s : s + strip].tobytes() for s in range(0, side, strip)]
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([k] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(rows, pa.binary()), pa.array([m.tobytes()] + [None] * (n - 1), pa.binary())], names=["i", "k", "strip", "bits", "m"])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                i, k = batch.column("i")[row].as_py(), batch.column("k")[row].as_py()
                (m, mine), (w, theirs) = (read(batch.column(c)[row].values) for c in ("own", "other"))
                near = np.zeros((side, side), bool)
                for g, at in mine.items():
                    if g in theirs:
                        near[np.ix_(at, theirs[g])] = True
                yield from told(i, k, near, w)
                if i < k:
                    yield from told(k, i, near.T, m)

    return stored(cells.mapInArrow(run, "i long, k long, strip long, bits binary, m binary"), "meetings")


def _products(meetings: DataFrame, blocks: int, side: int, users: int) -> DataFrame:
    """(kind, a, b, n) in parts to be summed up: of pairs (0) common and all neighbours and how
    many have them; of kinds of users (1) twice the links among the neighbours of one and
    (2) the degree and how many there are."""
    import numpy as np
    import pyarrow as pa

    real = np.float32 if users < 1 << 24 else np.float64  # whole numbers stay exact
    every = lambda a, b: F.explode(F.sequence(F.lit(a) if isinstance(a, int) else a, F.lit(b) if isinstance(b, int) else b))
    left = meetings.select("i", every(F.col("i"), F.lit(blocks - 1).cast("long")).alias("j"), "k", F.lit(0).cast("long").alias("right"), "strip", "bits", "m")
    right = meetings.where("i > 0").select(every(F.lit(0).cast("long"), F.col("i") - 1).alias("i"), F.col("i").alias("j"), "k", F.lit(1).cast("long").alias("right"), "strip", "bits", F.lit(None).cast("binary").alias("m"))
    tasks = max(int(meetings.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4096, blocks * (blocks + 1)))
    met = left.unionByName(right).repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "k", "right", "strip")
    chunk = max(1, (1 << 21) // side)

    def opened(strips: list) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(strips), np.uint8).reshape(side, -1), axis=1)

    def batch(kind: int, a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(np.asarray(x).astype(np.int64)) for x in (a, b, n))], names=["kind", "a", "b", "n"])

    def closed(i: int, j: int, common, near, mi, mj, di, dj):
        """What is known of two blocks: ``common`` counts both ends, ``di`` a kind itself."""
        links, others = np.zeros(side), np.zeros(side)
        for s in range(0, side, chunk):
            r, c = np.nonzero(near[s : s + chunk])
            r += s
            if i == j:
                r, c = r[c >= r], c[c >= r]
            both = np.rint(common[r, c]).astype(np.int64) - 2
            same = (r == c) if i == j else np.zeros(len(r), bool)
            pairs = np.where(same, mi[r] * (mi[r] - 1) // 2, mi[r] * mj[c])
            links += np.bincount(r, both * np.where(same, mi[r] - 1, mj[c]), side)
            others += np.bincount(c, np.where(same, 0, both * mi[r]), side)
            some = pairs > 0
            key, at = np.unique((both[some] << 32) | (di[r[some]] + dj[c[some]] - 2 - both[some]), return_inverse=True)
            yield batch(0, key >> 32, key & 0xFFFFFFFF, np.bincount(at, pairs[some], len(key)))
        for block, x, m in ((i, links, mi), (j, others, mj)):
            at = np.flatnonzero(m)
            yield batch(1, block * side + at, np.zeros(len(at)), x[at])
        if i == j:
            at = np.flatnonzero(mi)
            yield batch(2, i * side + at, di[at] - 1, mi[at])

    def run(batches):
        at, strips, m = None, ([], []), None
        state: dict = {}

        def ended(last):
            """Adds the product of the blocks just read."""
            i, j, k = last
            a = opened(strips[0])
            x, y = a.astype(real), None
            y = x if i == j else opened(strips[1]).astype(real)
            w = m.astype(real)
            state["di"] = state.get("di", 0) + np.rint(x @ w).astype(np.int64)
            state["dj"] = state.get("dj", 0) + np.rint(y @ w).astype(np.int64)
            if k == j:
                state["near"], state["mj"] = a.astype(bool), m
            if k == i:
                state["mi"] = m
            got = (x * w) @ y.T
            state["common"] = got if "common" not in state else np.add(state["common"], got, out=state["common"])

        def finished(last):
            s = dict(state)
            state.clear()
            yield from closed(last[0], last[1], s["common"], s["near"], s["mi"], s["mj"], s["di"], s["dj"])

        for rows in batches:
            keys = list(zip(*(rows.column(c).to_pylist() for c in ("i", "j", "k")), strict=True))
            sides, bits, numbers = rows.column("right").to_pylist(), rows.column("bits"), rows.column("m")
            for n, key in enumerate(keys):
                if key != at:
                    if at is not None:
                        ended(at)
                        if key[:2] != at[:2]:
                            yield from finished(at)
                    at, strips = key, ([], [])
                strips[sides[n]].append(bits[n].as_py())
                if numbers[n].is_valid:
                    m = np.frombuffer(numbers[n].as_py(), np.int64)
        if at is not None:
            ended(at)
            yield from finished(at)

    return met.mapInArrow(run, "kind int, a long, b long, n long")
