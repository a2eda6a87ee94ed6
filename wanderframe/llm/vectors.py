"""Integer vectors in blocks: what the vector operators (11 and 13) share.

Vectors become integers, row by row, in a stored table; blocks of them are multiplied in
float64, which is exact below 2 ** 53, and by whole numbers beyond; best lists of bounded
length are kept per query and can be merged in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

EXACT = 2.0**53
SMALLEST, LARGEST = -(2**63), 2**63 - 1
#: Rows of a table are multiplied in blocks of so many.
BLOCK = 1024
INTEGERS = "row long, vec_id long, label int, chosen boolean, v binary"


def integers(df: DataFrame, scale: float, chosen: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = None) -> DataFrame:
    """A stored table (row, vec_id, label, chosen, v): every component x as floor(scale * x),
    x as a double, packed as doubles; ``row`` is a number of the row's own.

    Rows without an id, without a vector, or with a component that is null or not finite are
    left out, with ``label`` also those without a label.  ``chosen`` null is false."""
    own = F.col(label).cast("int") if label else F.lit(0)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), own.alias("label"), F.coalesce(chosen, F.lit(False)).alias("chosen"), F.col(vector).cast("array<double>").alias("x"))
    known = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("x")
            at = column.offsets.to_numpy()
            x = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = np.flatnonzero(bad[at[1:]] == bad[at[:-1]])
            kept = b.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("row", "vec_id", "label", "chosen")), pa.array([x[at[i] : at[i + 1]].tobytes() for i in good], pa.binary())], names=["row", "vec_id", "label", "chosen", "v"])

    return stored(known.mapInArrow(packed, INTEGERS), "integers")


def matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Packed vectors as rows of one matrix; a component that a shorter vector lacks is zero."""
    if all(len(p) == 8 * width for p in packed):
        return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), width)
    out = np.zeros((len(packed), width))
    for i, p in enumerate(packed):
        out[i, : len(p) // 8] = np.frombuffer(p, np.float64)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows as longs; one that a long cannot hold is the nearest long."""
    with np.errstate(over="ignore"):
        most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    out = whole(a) @ whole(b).T
    return np.array([[min(max(x, SMALLEST), LARGEST) for x in row] for row in out], np.int64).reshape(len(a), len(b))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows in the cheapest numbers that hold them exactly: float32 below
    2 ** 24, float64 below 2 ** 53, else longs by :func:`product`."""
    with np.errstate(over="ignore"):
        most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if most >= EXACT or np.isnan(most):
        return product(a, b)
    kind = np.float32 if most < 2.0**24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


class Best:
    """The ``k`` best (score, id, row) of each of ``n`` lists: higher scores first, then
    smaller ids, then smaller rows.  What is added is merged with the lists it goes to alone."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self._score, self._id, self._row = (np.empty((n, k), np.int64) for _ in range(3))
        self._size = np.zeros(n, np.int64)
        #: A score below this cannot enter the list any more.
        self.least = np.full(n, SMALLEST, np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(at):
            return
        lists = np.unique(at)
        old, *kept = self._flat(lists)
        of = np.concatenate([old, at])
        s, i, r = (np.concatenate(x) for x in zip(kept, (score.astype(np.int64), ids, rows), strict=True))
        # ~s turns the order round without overflow
        order = np.lexsort((r, i, ~s, of))
        of, s, i, r = of[order], s[order], i[order], r[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        keep = rank < self.k
        to = of[keep], rank[keep]
        self._score[to], self._id[to], self._row[to] = s[keep], i[keep], r[keep]
        last = rank == self.k - 1
        self.least[of[last]] = s[last]
        self._size[lists] = np.minimum(np.diff(np.append(np.searchsorted(of, lists), len(of))), self.k)

    def _flat(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        has = np.arange(self.k) < self._size[lists][:, None]
        return np.repeat(lists, self._size[lists]), self._score[lists][has], self._id[lists][has], self._row[lists][has]

    list = property(lambda self: self._flat(np.arange(len(self._size)))[0])
    score = property(lambda self: self._flat(np.arange(len(self._size)))[1])
    id = property(lambda self: self._flat(np.arange(len(self._size)))[2])
    row = property(lambda self: self._flat(np.arange(len(self._size)))[3])


def best_of(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` first rows of each key with their ``rank``; Spark cuts the lists before it
    shuffles, too."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def blocks(batch: pa.RecordBatch, width: int, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, labels, matrix) of every ``size`` rows of an Arrow batch of integers."""
    for start in range(0, batch.num_rows, size):
        part = batch.slice(start, size)
        yield part.column("row").to_numpy(), part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("v").to_pylist(), width)


def extent(table: DataFrame) -> tuple[int, int, int]:
    """Rows, chosen rows, and components of the longest vector."""
    n, chosen, size = table.agg(F.count("*"), F.count_if("chosen"), F.coalesce(F.max(F.octet_length("v")), F.lit(0))).first()
    return n, chosen, size // 8
