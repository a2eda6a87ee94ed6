"""The filter audit against running every order of the filters over every document."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from wanderframe.llm import audit, queries

LABELS = "doc_id long, quality int, toxic int, mask string"


def failing(rows):
    """Row -> set of the filters it fails, by the definitions."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        f |= {"A"} if len(words) < 100 else set()
        f |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        out.append(f)
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails, out = failing(rows), {}
    for part in {p or "" for _, _, p in rows}:
        here = [(i, f) for (i, _, p), f in zip(rows, fails, strict=True) if (p or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = here
            for step, x in enumerate(order, 1):
                removed = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                redundant = sum(x in f for _, f in here) - len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(f == {x} for _, f in here), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
                shapley[x] += len(removed)
        for (p, o, s), v in out.items():
            if p == part:
                v.append(shapley[o[s - 1]])
    return {k: tuple(v) for k, v in out.items()}


def texts():
    r = random.Random(1)
    vocab = [f"w{i}é" for i in range(400)]
    rows = []
    for i in range(120):
        n = r.choice([0, 3, 99, 100, 101, 150])
        words = r.sample(vocab, n) if r.random() < 0.6 else [r.choice(vocab[:90]) for _ in range(n)]
        t = r.choice([" ", "\t\n", "  "]).join(words)
        rows.append((i, (t.upper() if r.random() < 0.2 else t) + r.choice(["", "", " #", "|", "A" * 40]), r.choice(["en", "de", "", None])))
    rows += [(200 + i, rows[i % 3][1], "fr" if i % 2 else "en") for i in range(50)]  # copies, over parts
    rows += [rows[5], rows[5], (None, rows[5][1], "en"), (None, None, "en"), (5, "other", "de"), (300, None, None), (301, "", "en"), (-4, rows[1][1], "xx"), (302, "w " * 300_000, "en"), (303, " ".join(map(str, range(100_000))), "en")]
    r.shuffle(rows)
    return rows


LABELLED = [(i, i % 2, (i + 1) % 3 == 0) for i in range(0, 260, 2)] + [(5, 0, 1), (5, 1, 0), (7, None, 1), (9, 1, None), (None, 1, 1), (9999, 1, 1)]


def labels_of(spark, rows=LABELLED):
    return spark.createDataFrame([(i, q, int(x) if x is not None else None, "m") for i, q, x in rows], LABELS)


def told(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit.COUNTS) for r in df.collect()}


def test_equals_running_every_order(spark, docs_of):
    rows = texts()
    df = docs_of([(i, t) for i, t, _ in rows]).drop("lang")
    langs = spark.createDataFrame([(i, t, p, "k", 1) for i, t, p in rows], "doc_id long, text string, lang string, same string, n int")
    assert set(df.columns) - set(langs.columns)
    got = audit.audit(langs.repartition(4), labels_of(spark))
    assert got.count() == len(told(got)) and told(got) == brute(rows, LABELLED)


def test_boundaries_of_the_filters(spark):
    """99 and 100 words, 79 and 80 distinct of 100, capitals of exactly a tenth."""
    w = [f"w{i}" for i in range(100)]
    cases = [" ".join(w[:99]), " ".join(w), " ".join(w[:79] + w[:21]), " ".join(w[:80] + w[:20]), "A" + "b" * 9, "A" + "b" * 8, "\x00 \x1f", " ".join(w)]
    got = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", audit.masks(F.col("t")).alias("m")).collect()
    want = [sum(1 << "ABCD".index(x) for x in f - {"E"}) for f in failing([(i, t, "") for i, t in enumerate(cases)])]
    assert [r.m for r in sorted(got)] == want


def test_tables_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audit(docs, labels_of(spark, [])).count() == 0
    one = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")
    assert told(audit.audit(one, labels_of(spark, []))) == brute([(1, "x", None)], [])


def test_matrices_count_every_mask():
    by = audit.incidence()
    assert {m.shape for m in by.values()} == {(32, 600)}
    last = by["kept"].reshape(32, 120, 5)[:, :, 4]
    assert (last[0] == 1).all() and (last[1:] == 0).all() and (by["removed"].sum(axis=1) == [0] + [120] * 31).all()


@pytest.mark.parametrize("name", ["op12_filter_audit"])
def test_query_equals_sql(spark, tmp_path, name):
    rows = [r for r in texts() if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    labels_of(spark).coalesce(1).write.parquet(f"file://{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in found.description]
    want = Counter(found.fetchall())
    assert Counter(tuple(r) for r in queries.QUERIES[name](spark, f"file://{tmp_path}").select(*cols).collect()) == want
