"""Hard-negative mining (operator 11): blocked dense products, best lists that merge, and a
second pass for negatives whose score lies in a window below the positive's.

Anchors are dealt into rounds of a bounded number.  A round's anchors go to all tasks; each
task multiplies them with its candidates block by block and keeps an anchor's best positives;
the tasks' lists merge.  With the positives' scores, which are as many at most as anchors times
positives, a second pass over the candidates keeps the best negatives of each window.
Candidates stay where they are: only best lists are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, work_dir
from .vectors import Best, best_of, blocks, dots, extent, integers, matrix

#: Anchors a round: what is broadcast has a bounded number of vectors.
ANCHORS = 16384
#: Anchors that are multiplied at once, with so many rows.
ROWS, BLOCK = 256, 4096
LISTS = "list long, score long, id long, row long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(df: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, most: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best
    rows of another label with low * positive <= 100 * negative <= high * positive.

    Scores are inner products of components floor(scale * x); higher ones come first, then
    smaller ids.  Rows without id, label or vector, or with a component that is null or not
    finite, take no part.  Every row counts by itself: one that repeats an anchor's id may be
    its positive, and of several anchors with one id each has its own rows.  Components that a
    shorter vector lacks are zero; a score that a long cannot hold is the nearest long.  An
    empty table, or one without anchors, gives no rows.  Further columns play no part.
    """
    spark = df.sparkSession
    table = integers(df, scale, anchors, vec_id, vector, label)
    _, n, width = extent(table)
    rounds = -(-2 * n // most)  # by hash: twice as many, so that none is over the limit
    at = work_dir(spark, "negatives")
    spark.createDataFrame([], MINED).write.parquet(at)
    for k in range(rounds):
        own = table.where("chosen").where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k).select("row", "vec_id", "label", "v").orderBy("row").toArrow()
        if own.num_rows == 0:
            continue
        sent = spark.sparkContext.broadcast({"row": own["row"].to_numpy(), "label": own["label"].to_numpy(), "m": matrix(own["v"].to_pylist(), width)})
        first = best_of(table.mapInArrow(_positives(sent, width, positives), LISTS), ["list"], positives).toArrow()
        p = {c: first[c].to_numpy() for c in ("list", "score", "id", "row")}
        windows = spark.sparkContext.broadcast(_windows(p["list"], p["score"], low, high))
        best = best_of(table.mapInArrow(_negatives(sent, windows, width, negatives), LISTS), ["list"], negatives)
        pairs = spark.createDataFrame(pa.table({"list": pa.array(np.arange(len(p["list"]))), "anchor_id": own["vec_id"].combine_chunks().take(pa.array(p["list"])), "positive_id": pa.array(p["id"]), "positive_score": pa.array(p["score"])}))
        found = best.join(F.broadcast(pairs), "list")  # as many rows as lists at most: anchors of a round times positives
        found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(at)
        sent.destroy()
        windows.destroy()
    forget(table)
    return spark.read.schema(MINED).parquet(at)


def _windows(anchor: np.ndarray, score: np.ndarray, low: int, high: int) -> dict[str, np.ndarray]:
    """Anchor, least and greatest score of each list of negatives, by whole numbers."""
    bounds = [(-(-low * s // 100), high * s // 100) for s in score.tolist()]
    lo, hi = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))
    return {"anchor": anchor, "lo": lo, "hi": hi}


def _told(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (best.list, best.score, best.id, best.row)], names=["list", "score", "id", "row"])


def _positives(sent, width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        best = Best(len(a["row"]), k)
        of = {x: np.flatnonzero(a["label"] == x) for x in np.unique(a["label"]).tolist()}
        for b in batches:
            for rows, ids, labels, m in blocks(b, width, BLOCK):
                for x in np.unique(labels).tolist():
                    these = np.flatnonzero(labels == x)
                    for start in range(0, len(of.get(x, ())), ROWS):
                        own = of[x][start : start + ROWS]
                        s = dots(a["m"][own], m[these])
                        i, j = np.nonzero(s >= best.least[own].astype(s.dtype)[:, None])
                        i, j = (y[a["row"][own[i]] != rows[these[j]]] for y in (i, j))
                        best.add(own[i], s[i, j], ids[these[j]], rows[these[j]])
        yield _told(best)

    return run


def _negatives(sent, windows, width: int, k: int):
    """An anchor is multiplied once for all its windows: what reaches the lowest bound of any
    of them is looked at window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, w = sent.value, windows.value
        best = Best(len(w["anchor"]), k)
        order = np.argsort(w["anchor"], kind="stable")  # lists of one anchor side by side
        own, first, count = np.unique(w["anchor"][order], return_index=True, return_counts=True)
        for b in batches:
            for rows, ids, labels, m in blocks(b, width, BLOCK):
                for start in range(0, len(own), ROWS):
                    part = slice(start, start + ROWS)
                    s = dots(a["m"][own[part]], m)
                    mine = order[first[start] : first[part][-1] + count[part][-1]]
                    low = np.minimum.reduceat(np.maximum(w["lo"][mine], best.least[mine]), first[part] - first[start])
                    i, j = np.nonzero(s >= low.astype(s.dtype)[:, None])
                    other = a["label"][own[part]][i] != labels[j]
                    i, j = i[other], j[other]
                    score = s[i, j].astype(np.int64)
                    found = []
                    for n in range(count[part].max()):
                        has = np.flatnonzero(count[part][i] > n)
                        at = order[first[part][i[has]] + n]
                        fits = (score[has] >= np.maximum(w["lo"][at], best.least[at])) & (score[has] <= w["hi"][at])
                        found.append((at[fits], has[fits]))
                    at, has = (np.concatenate(x) for x in zip(*found, strict=True))
                    best.add(at, score[has], ids[j[has]], rows[j[has]])
        yield _told(best)

    return run
