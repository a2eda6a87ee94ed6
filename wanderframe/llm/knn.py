"""Exact top-k search (operator 13): a Voronoi join on inner products.

Queries and data are grouped by their nearest pivot.  Two summaries bound what a query group
can need: the radius of its queries about the pivot, and the least score that its k-th best
row must have, which the best lower bounds of the data rows give.  A data row is replicated
to a query group only if its upper bound there reaches that score, cells of data are skipped
as a whole by their radius and greatest norm.  Small groups are put together, large ones are
cut, and each meets its data slice by slice, so that a task holds a bounded number of queries
and rows; the slices' best lists merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import BLOCK, Best, best_of, blocks, extent, integers, matrix, product

#: Pivots, a parameter of the summaries' size; drawn from a sample of four times as many rows.
PIVOTS = 64
#: Queries a group and data rows a slice that one task holds at most (by hash and by number).
QUERIES, ROWS = 16384, 16384
#: Groups or slices for which copies are made at once.
GROUPS = 16
#: Share of slack for rounding in float bounds: bounds are widened by it.
SLACK = 1e-9
FOUND = "query_row long, query_id long, score long, id long, row long"


def pivots_of(table: DataFrame, width: int, n: int = PIVOTS) -> np.ndarray:
    """At most ``n`` different vectors far from each other, from a sample of ``4 * n`` rows
    that the hash of the row's number picks."""
    sample = table.orderBy(F.xxhash64("row"), "row").limit(4 * n).select("v").toArrow()
    m = np.unique(matrix(sample["v"].to_pylist(), width), axis=0)
    far, chosen = np.full(len(m), np.inf), []
    while len(chosen) < min(n, len(m)):
        i = int(np.argmax(far))
        if far[i] == 0:
            break
        chosen.append(i)
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.fmin(far, np.linalg.norm(m - m[i], axis=1))
        far[i] = 0
    return m[chosen]


def nearest(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the nearest pivot, the distance to it, and the products with all pivots."""
    with np.errstate(over="ignore", invalid="ignore"):
        dots = m @ pivots.T
        at = np.argmin(np.nan_to_num((pivots**2).sum(axis=1) - 2 * dots, nan=np.inf), axis=1)
        return at, np.linalg.norm(m - pivots[at], axis=1), dots


def widened(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lower bounds less the rounding that their terms allow; unknown ones are no bounds."""
    return np.nan_to_num(low - SLACK * (np.abs(size) + 1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def summaries(table: DataFrame, pivots: np.ndarray, width: int, k: int) -> tuple[dict, dict, np.ndarray]:
    """Per query group (radius, count), per data cell (radius, greatest norm), and per query
    group the least score of a k-th best row: three aggregations with a row per pivot."""
    sent = table.sparkSession.sparkContext.broadcast(pivots)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                m = matrix(part.column("v").to_pylist(), width)
                at, far, _ = nearest(m, sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(far), pa.array(np.linalg.norm(m, axis=1)), part.column("chosen")], names=["g", "far", "norm", "chosen"])

    cells = table.mapInArrow(measured, "g long, far double, norm double, chosen boolean")
    per = {r.g: r for r in cells.groupBy("g").agg(F.max("far").alias("far"), F.max("norm").alias("norm"), F.max(F.when(F.col("chosen"), F.col("far"))).alias("radius"), F.count_if("chosen").alias("queries")).collect()}
    radius = np.array([per[i].radius if i in per and per[i].queries else np.nan for i in range(len(pivots))])
    own = table.sparkSession.sparkContext.broadcast(radius)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = np.flatnonzero(~np.isnan(own.value))
        best = np.full((len(groups), 0), -np.inf)
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                m = matrix(b.column("v").slice(start, BLOCK).to_pylist(), width)
                with np.errstate(over="ignore", invalid="ignore"):
                    dots = (m @ sent.value[groups].T).T
                    norm = np.linalg.norm(m, axis=1)[None]
                    reach = own.value[groups][:, None] * norm
                    best = np.concatenate([best, widened(dots - reach, np.linalg.norm(sent.value[groups], axis=1)[:, None] * norm + reach)], axis=1)
                best = -np.sort(-best, axis=1)[:, : k + 1]  # one may be the query itself
        for i, g in enumerate(groups.tolist()):
            yield pa.RecordBatch.from_arrays([pa.array([g] * best.shape[1], pa.int64()), pa.array(best[i]), *[pa.array([0] * best.shape[1], pa.int64())] * 2], names=["g", "score", "id", "row"])

    lists = best_of(table.mapInArrow(bounded, "g long, score double, id long, row long"), ["g"], k + 1)
    least = np.full(len(pivots), -np.inf)
    for r in lists.groupBy("g").agg(F.min("score").alias("least"), F.count("*").alias("n")).collect():
        least[r.g] = r.least if r.n == k + 1 else -np.inf
    sent.destroy()
    own.destroy()
    return {i: per[i] for i in per if per[i].queries}, per, least


def grouped(pivots: np.ndarray, queries: dict, size: int) -> tuple[dict[int, int], dict[int, int], int]:
    """The first group of each pivot's queries, in how many groups they are, and all groups:
    pivots are chained, each with the nearest one left, and fill groups of ``size``."""
    left, chain = set(queries), []
    while left:
        last = pivots[chain[-1]] if chain else pivots[min(left)]
        with np.errstate(over="ignore", invalid="ignore"):
            chain.append(min(left, key=lambda i: (np.nan_to_num(np.linalg.norm(pivots[i] - last), nan=np.inf), i)))
        left.remove(chain[-1])
    first, parts, n, room = {}, {}, 0, 0
    for i in chain:
        count = queries[i].queries
        if count > room:  # groups of its own, the last one shared only if it is the only one
            first[i], parts[i] = n, -(-count // size)
            n, room = n + parts[i], size - count
        else:
            first[i], parts[i], room = n - 1, 1, room - count
    return first, parts, n


def search(df: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, pivots: int = PIVOTS, most_queries: int = QUERIES, most_rows: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row the ``k`` rows with the greatest
    inner products, all if there are fewer; exact.

    Components are floor(scale * x); ties go to the smaller id.  Rows without id or vector, or
    with a component that is null or not finite, take no part.  A query's own row is no result
    of it, another row of the same id is; each query row has its own results.  Components that
    a shorter vector lacks are zero; a score that a long cannot hold is the nearest long.  An
    empty table, or one without queries, gives no rows.  Further columns play no part.
    """
    spark = df.sparkSession
    table = integers(df, scale, queries, vec_id, vector)
    n, chosen, width = extent(table)
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centres = pivots_of(table, width, pivots)
    asked, cells, least = summaries(table, centres, width, k)
    first, parts, groups = grouped(centres, asked, most_queries)
    slices = -(-n // most_rows)
    plan = spark.sparkContext.broadcast(_plan(centres, asked, cells, least, first, parts, groups))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every slice, each data row once for every group that may need it."""
        p, count = plan.value, 0
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                m = matrix(part.column("v").to_pylist(), width)
                at, _, dots = nearest(m, p["pivots"])
                here = np.arange(count, count + len(m))
                count += len(m)
                need = p["open"][at] & ~(_above(dots, p["size"], p["radius"], np.linalg.norm(m, axis=1)) < p["least"])
                to_group = np.zeros((len(m), groups), bool)
                for i, (f, c) in p["groups"].items():
                    to_group[:, f : f + c] |= need[:, i][:, None]
                for low in range(0, groups, GROUPS):
                    row, g = np.nonzero(to_group[:, low : low + GROUPS])
                    yield _piece(part, row, g + low, here[row] % slices, False)
                own = np.flatnonzero(part.column("chosen").to_numpy(zero_copy_only=False))
                into = np.array([p["groups"][i][0] + c % p["groups"][i][1] for i, c in zip(at[own].tolist(), here[own].tolist(), strict=True)], np.int64)
                for low in range(0, slices, GROUPS):
                    s = np.arange(low, min(low + GROUPS, slices))
                    yield _piece(part, np.repeat(own, len(s)), np.repeat(into, len(s)), np.tile(s, len(own)), True)

    def solved(met: pa.Table) -> pa.Table:
        asks = met.filter(met["asks"])
        best = _best(asks, met.filter(pc.invert(met["asks"])), width, k)
        own, ids = asks["row"].to_numpy(), asks["vec_id"].to_numpy()
        return pa.table([pa.array(x, pa.int64()) for x in (own[best.list], ids[best.list], best.score, best.id, best.row)], names=["query_row", "query_id", "score", "id", "row"])

    pieces = table.mapInArrow(dealt, "g long, s long, asks boolean, row long, vec_id long, label int, v binary")
    met = pieces.groupBy("g", "s").applyInArrow(solved, FOUND)
    best = best_of(met, ["query_row"], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _above(dots: np.ndarray, size: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Upper bounds of a row's product with any query of each group."""
    with np.errstate(over="ignore", invalid="ignore"):
        reach = radius[None] * norm[:, None]
        return -widened(-(dots + reach), size * norm[:, None] + reach)


def _plan(pivots: np.ndarray, asked: dict, cells: dict, least: np.ndarray, first: dict, parts: dict, groups: int) -> dict:
    """What the tasks need to deal: ``open[j, i]`` says whether any row of data cell j can be
    needed by query group i, by the cell's radius and greatest norm."""
    radius = np.array([asked[i].radius if i in asked else np.nan for i in range(len(pivots))])
    reached = np.zeros((len(pivots), len(pivots)), bool)
    norms = np.linalg.norm(pivots, axis=1)
    for j, c in cells.items():
        with np.errstate(over="ignore", invalid="ignore"):
            above = (pivots @ pivots[j]) + norms * c.far + np.nan_to_num(radius) * c.norm
            reached[j] = ~(-widened(-above, norms * (norms[j] + c.far) + np.nan_to_num(radius) * c.norm) < least)
    reached &= ~np.isnan(radius)
    return {"pivots": pivots, "size": norms, "radius": np.nan_to_num(radius), "least": least, "open": reached, "groups": {i: (first[i], parts[i]) for i in first}}


def _piece(part: pa.RecordBatch, row: np.ndarray, g: np.ndarray, s: np.ndarray, asks: bool) -> pa.RecordBatch:
    taken = part.take(pa.array(row))
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(s, pa.int64()), pa.array(np.full(len(row), asks)), *(taken.column(c) for c in ("row", "vec_id", "label", "v"))], names=["g", "s", "asks", "row", "vec_id", "label", "v"])


def _best(asks: pa.Table, has: pa.Table, width: int, k: int) -> Best:
    q, own = matrix(asks["v"].to_pylist(), width), asks["row"].to_numpy()
    best = Best(len(q), k)
    for batch in has.combine_chunks().to_batches():
        for rows, ids, _, m in blocks(batch, width):
            for start in range(0, len(q), BLOCK):
                s = product(q[start : start + BLOCK], m)
                mine = slice(start, start + len(s))
                i, j = np.nonzero((s >= best.least[mine][:, None]) & (own[mine][:, None] != rows))
                best.add(i + start, s[i, j], ids[j], rows[j])
    return best
