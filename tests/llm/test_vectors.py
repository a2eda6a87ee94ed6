"""Hard negatives and exact search against brute force in whole numbers."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wanderframe.llm import knn, negatives, queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row int, g int, v string"


def frame(spark, rows):
    """A table with column names that the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def whole(rows, scale):
    """(id, label, components) of the rows that take part."""
    out = []
    for i, v, label in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, label, [math.floor(float(np.float32(x)) * scale) for x in v]))
    return out


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=False)), -(2**63)), 2**63 - 1)


def brute_negatives(rows, anchor, k=5, m=10):
    have = [r for r in whole(rows, 256) if r[1] is not None]
    out = Counter()
    for n, (i, label, v) in enumerate(have):
        if i % anchor:
            continue
        scored = sorted((-dot(v, w), j, p, other) for p, (j, other, w) in enumerate(have) if p != n)
        for s, j, _, _ in [x for x in scored if x[3] == label][:k]:
            fits = [x for x in scored if x[3] != label and -30 * s <= -100 * x[0] <= -90 * s][:m]
            out.update((i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(fits, 1))
    return out


def brute_search(rows, query, k=20):
    have = whole(rows, 64)
    out = Counter()
    for n, (i, _, v) in enumerate(have):
        if i % query == 0:
            scored = sorted((-dot(v, w), j) for p, (j, _, w) in enumerate(have) if p != n)[:k]
            out.update((i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1))
    return out


def odd_rows(seed, n=160, dims=6):
    """Ties, copies, repeated rows and ids, nulls, short, empty and unknown vectors."""
    r = random.Random(seed)
    rows = [(i, [r.choice([-0.5, -0.1, 0.0, 0.25, 0.3, 0.9]) for _ in range(dims)], r.randrange(3)) for i in range(n)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(60)]  # a group of copies
    rows += [rows[0], rows[0], rows[20], rows[7], (40, rows[9][1], 0)]
    rows += [(None, rows[1][1], 1), (2000, None, 1), (2020, [0.5, None] + [0.1] * (dims - 2), 1), (2040, [0.5, float("nan")], 1), (2060, [float("inf")] * dims, 1), (2080, [], 1), (2100, [0.5], 2), (2200, rows[2][1], None)]
    r.shuffle(rows)
    return rows


def mined(df, **more):
    return Counter(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 20 == 0, **more).collect())


def found(df, k=20, **more):
    return Counter(tuple(r) for r in knn.search(df, F.col("vec_id") % 20 == 0, k, **more).collect())


@pytest.mark.parametrize("most", [16384, 6])
def test_negatives_equal_brute_force(spark, most):
    rows = odd_rows(1)
    want = brute_negatives(rows, 20)
    assert len(want) > 100
    assert mined(frame(spark, rows).repartition(5), most=most) == want


@pytest.mark.parametrize("pivots, queries_, rows_", [(64, 16384, 16384), (5, 4, 50), (1, 3, 1000)])
def test_search_equals_brute_force(spark, pivots, queries_, rows_):
    rows = odd_rows(2)
    assert found(frame(spark, rows).repartition(5), pivots=pivots, most_queries=queries_, most_rows=rows_) == brute_search(rows, 20)


def test_far_groups_are_left_out_and_results_whole(spark, monkeypatch):
    """Tight groups far apart: rows are replicated to few groups, results stay exact."""
    r = random.Random(3)
    centres = [[20.0 * (c == i) for i in range(8)] for c in range(8)]
    rows = [(i, [x + r.uniform(-0.2, 0.2) for x in centres[i % 8]], 0) for i in range(400)]
    df = frame(spark, rows)
    table = vectors.integers(df, 64.0, F.col("vec_id") % 10 == 0)
    _, _, width = vectors.extent(table)
    pivots = knn.pivots_of(table, width, 16)
    asked, cells, least = knn.summaries(table, pivots, width, 5)
    first, parts, groups = knn.grouped(pivots, asked, 6)
    plan = knn._plan(pivots, asked, cells, least, first, parts, groups)
    assert groups > 4 and plan["open"].mean() < 0.4
    got = Counter(tuple(r) for r in knn.search(df, F.col("vec_id") % 10 == 0, 5, pivots=16, most_queries=6, most_rows=100).collect())
    assert got == brute_search(rows, 10, 5)


def test_large_numbers_stay_exact(spark):
    """Beyond 2 ** 53 whole numbers decide, and beyond a long the nearest long is kept."""
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) * 10 ** r.choice([0, 6, 8]) for _ in range(4)], i % 2) for i in range(60)]
    assert found(frame(spark, rows)) == brute_search(rows, 20)
    assert mined(frame(spark, rows)) == brute_negatives(rows, 20)
    huge = rows + [(i, [3e38 * (-1) ** (i // 20)] * 4, 0) for i in range(100, 200, 10)]
    assert found(frame(spark, huge), pivots=4) == brute_search(huge, 20)
    assert mined(frame(spark, huge)) == brute_negatives(huge, 20)


def test_few_rows_and_none(spark):
    none = frame(spark, [])
    assert not found(none) and not mined(none)
    alone = frame(spark, [(0, [0.5], 1)])
    assert not found(alone) and not mined(alone)
    assert not found(frame(spark, [(1, [0.5], 1)])) and not mined(frame(spark, [(1, [0.5], 1)]))
    assert found(frame(spark, [(0, [], 1), (7, [], 1)])) == Counter([(0, 1, 7, 0)])


def test_best_lists_merge_in_any_order():
    r = np.random.default_rng(5)
    at, score, ids = r.integers(0, 4, 500), r.integers(-3, 3, 500), r.integers(0, 50, 500)
    rows = np.arange(500)
    for order in (rows, rows[::-1], r.permutation(500)):
        best = vectors.Best(4, 7)
        for part in np.array_split(order, 9):
            best.add(at[part], score[part], ids[part], rows[part])
        want = [x for of in range(4) for x in sorted((-score[i], ids[i], i, of) for i in rows if at[i] == of)[:7]]
        assert [(-s, i, n, of) for s, i, n, of in zip(best.score, best.id, best.row, best.list, strict=True)] == want


def test_queries_equal_sql(spark, tmp_path):
    rows = [x for x in odd_rows(6) if x[1] is None or len(x[1]) == 6 or None in x[1]]
    r = random.Random(7)
    rows += [(100 * i, [r.uniform(-1, 1) for _ in range(6)], i % 3) for i in range(30, 50)]
    frame(spark, rows).coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("op11_negatives", "op13_top_k"):
        told = con.execute(queries.ORACLE[name])
        cols = [d[0] for d in told.description]
        want = Counter(told.fetchall())
        assert want and Counter(tuple(x) for x in queries.QUERIES[name](spark, f"file://{tmp_path}").select(*cols).collect()) == want


def test_blocks_cover_a_batch():
    v = [np.array([i, 1.0]).tobytes() for i in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(range(10)), pa.array([0] * 10), pa.array(v)], names=["row", "vec_id", "label", "v"])
    got = list(vectors.blocks(batch, 3, 4))
    assert [len(b[0]) for b in got] == [4, 4, 2] and np.concatenate([b[3] for b in got])[:, 0].tolist() == list(range(10))


def test_lists_are_merged_alone():
    """What is added to one list costs no more however many lists there are: others are not
    sorted again, and cheap numbers give the same products as whole ones."""
    best, plain = vectors.Best(200_000, 10), {}
    every = np.repeat(np.arange(200_000), 10)
    best.add(every, every * 0, every, every)
    sorted_ = []
    lexsort = np.lexsort
    try:
        np.lexsort = lambda keys: sorted_.append(len(keys[0])) or lexsort(keys)
        for i in range(30):
            best.add(np.array([7, 9]), np.array([i, -i]), np.array([i, i]), np.array([i, i]))
    finally:
        np.lexsort = lexsort
    assert max(sorted_) <= 22
    plain = [x for of, x in zip(best.list, best.score, strict=True) if of == 7]
    assert plain == list(range(29, 19, -1)) and len(best.list) == 2_000_000
    a = np.random.default_rng(1).integers(-256, 257, (40, 64)).astype(np.float64)
    assert vectors.dots(a, a).dtype == np.float32
    for scale in (1.0, 2.0**12, 2.0**30):
        assert (vectors.dots(a * scale, a).astype(np.int64) == vectors.product(a * scale, a)).all()
