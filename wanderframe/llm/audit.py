"""Filter interaction audit (operator 12): an incidence matrix times histograms of outcomes.

A document fails some of five filters; which ones is a mask of five bits.  Per part, the
documents, the good ones and the toxic ones are counted by mask: rows of 32 numbers.  What
each of the 120 orders of the filters does at each of its five steps to a mask is a column of
integer matrices of 32 by 600; their products with the rows are the results.  Texts are read
once; what is shuffled is a digest and a mask for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def incidence() -> dict[str, np.ndarray]:
    """Matrices of masks by (order, step): 1 where a document of that mask is kept after the
    step, removed in it, fails its filter but went before, or fails its filter alone."""
    bits = np.arange(MASKS)[:, None] >> np.arange(len(FILTERS)) & 1
    # fails[m, o, s]: whether mask m fails the filter at step s of order o
    fails = bits[:, [[FILTERS.index(f) for f in o] for o in ORDERS]]
    gone = np.cumsum(fails, axis=2) > 0
    before = np.concatenate([np.zeros_like(gone[:, :, :1]), gone[:, :, :-1]], axis=2)
    only = bits.sum(axis=1)[:, None, None] == 1
    out = {"kept": ~gone, "removed": fails & ~before, "redundant": fails & before, "unique_fails": fails & only}
    return {k: x.reshape(MASKS, -1).astype(np.int64) for k, x in out.items()}


def masks(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A under 100 words, B under 80 distinct
    words in 100, C over 10 capital letters in 100 characters, D holds one of ``#$%&*|``."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = F.transform(F.array(counts), lambda c: F.when(c.n < 100, 1).otherwise(0) + F.when(100 * c.d < 80 * c.n, 2).otherwise(0))[0]
    return fails + F.when(100 * capitals.cast("long") > 10 * F.length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def outcomes(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, labelled ones apart.

    A null text is empty, a null part is the empty string.  Filter E is failed by a text that
    a row of a smaller id holds too; rows of one id, or without an id, don't fail it by each
    other.  A document is good or toxic if any of its labels says so.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), masks(t).alias("mask"), F.unhex(F.sha2(t, 256)).alias("same"))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    one = ["same", "part", "mask", "good", "toxic"]
    known = rows.join(told, "doc_id", "left").fillna(False, ["good", "toxic"]).groupBy("doc_id", *one).agg(F.count("*").alias("n"))
    # Of each text, part and label: how many rows, and how many of them have the least id.
    alike = known.groupBy(*one).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("loose"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"))
    each = alike.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("same")))  # a row for each part and label of a text
    unique = F.col("loose") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.array(F.struct("mask", unique.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - unique).alias("n")))
    both = each.select("part", "good", "toxic", F.inline(split))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """For each part, order of the filters and step, as :func:`outcomes` counts: documents
    kept, removed, redundant, failing this filter only, good and toxic ones removed, and what
    the step's filter removes over all orders.

    Every part of the table has all 600 rows, zeros included; an empty table has none.
    Columns of ``docs`` beside the three named play no part."""
    hist = outcomes(docs, labels, doc_id, text, part)
    cells = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).alias(str(m)) for m in range(MASKS)]).alias(c)
    rows = hist.groupBy("part").agg(*[cells(c) for c in ("n", "good", "toxic")])

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = incidence()
        orders = np.repeat(ORDERS, len(FILTERS))
        steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
        filters = np.array([FILTERS.index(f) for o in ORDERS for f in o])
        of_filter = (filters[:, None] == np.arange(len(FILTERS))).astype(np.int64)
        for b in batches:
            n, good, toxic = (np.array(b.column(c).to_pylist(), np.int64).reshape(b.num_rows, MASKS) for c in ("n", "good", "toxic"))
            out = {c: n @ m for c, m in by.items()} | {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
            out["shapley"] = out["removed"] @ of_filter @ of_filter.T
            for i, name in enumerate(b.column("part").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(orders)), pa.array(orders), pa.array(steps), *(pa.array(out[c][i]) for c in COUNTS)], names=["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(multiplied, AUDIT)
