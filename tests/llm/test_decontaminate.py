import random

import pytest

from wanderframe.llm import decontaminate


def distance(a, t):
    """Least edits of a against any stretch of t."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edited(rng, s, k):
    x = list(s)
    for _ in range(k):
        at = rng.randrange(len(x))
        what = rng.randrange(3)
        x[at : at + 1] = ["q"] if what == 0 else [] if what == 1 else [x[at], "q"]
    return "".join(x)


def test_banded_alignment_against_full():
    rng = random.Random(1)
    for _ in range(60):
        a = sentence(rng, 6).encode()
        t = (sentence(rng, 4) + " " + edited(rng, a.decode(), rng.randint(0, 5)) + " " + sentence(rng, 4)).encode()
        full = distance(a, t)
        got = decontaminate.banded(a, t, 0, len(t), 4)
        assert got == (full if full <= 4 else None)


def segments(clean):
    """(segment, edits allowed) of a normalised item, as the operator's docstring has them."""
    n = min(96, len(clean))
    k = max(k for k in range(n // 16 + 1) if k == 0 or n + 1 - 12 * (k + 1) >= 1)
    return [(clean[s : s + n], k) for s in sorted({*range(0, len(clean) - n + 1, 8), len(clean) - n})]


def brute(items, texts):
    """{(text, item): (segments found, least edits)}."""
    out = {}
    for d, t in enumerate(texts):
        clean = decontaminate.normal((t or "").encode())
        for i, item in enumerate(items):
            own = decontaminate.normal((item or "").encode())
            if len(own) < 12:
                if own and b" " + own + b" " in b" " + clean + b" ":
                    out[d, i] = (1, 0)
                continue
            got = [x for s, k in segments(own) if (x := 0 if s in clean else distance(s, clean)) <= k]
            if got:
                out[d, i] = (len(got), min(got))
    return out


def test_pairs_against_brute_force(spark, docs_of):
    rng = random.Random(7)
    items = [sentence(rng, rng.randint(12, 45)) for _ in range(8)] + [sentence(rng, 12)[:n] for n in (12, 23, 24, 33, 36, 47)] + ["tiny", "", None]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(0, items[0]), (99, items[1].upper() + "!"), (None, None)], "item_id long, text string")
    texts = [None, "", "no match " * 30, "a tiny thing", "tinyness", items[0], items[1].upper().replace(" ", ",\n"), items[2][:130], items[3][7:110]]
    texts += [sentence(rng, 8) + " " + edited(rng, rng.choice(items[:8]), rng.randint(0, 14)) + " " + sentence(rng, 8) for _ in range(14)]
    texts += [sentence(rng, 4) + " " + edited(rng, rng.choice(items[8:14]), rng.randint(0, 3)) + " " + sentence(rng, 4) for _ in range(20)]
    want = brute(items, texts)
    long = "x" * 50_000 + " " + items[3]
    docs = docs_of([*enumerate(texts), (500, long), (500, long), (None, long)])
    got = decontaminate.contaminated(docs, bench, ["doc_id"]).collect()
    assert {(r.doc_id, r.item_id): (r.n_segments, r.edits) for r in got if r.doc_id is not None and r.doc_id < 500} == want
    assert sum(r.item_id == 3 and r.doc_id in (500, None) for r in got) == 3
    flagged = decontaminate.flag_documents(docs.withColumn("contaminated", decontaminate.F.lit(True)), bench)
    assert {r.doc_id for r in flagged.collect() if r.contaminated} == {r.doc_id for r in got}
    classes = {r.item_id: r.class_id for r in decontaminate.benchmark_classes(bench).collect()}
    assert classes[99] == 1 and classes[0] == 0 and 15 not in classes


@pytest.mark.parametrize("size", [103, 110, 150])
def test_every_excerpt_is_found(size):
    rng = random.Random(size)
    item = decontaminate.normal(sentence(rng, 80).encode())
    index = decontaminate.Index([(5, item)])
    cuts = [item[s : s + size] for s in range(0, len(item) - size, 3)]
    assert {t for t, *_ in index.search([b"zz " + c.strip() + b" yy" for c in cuts if len(c.strip()) == size])} == set(range(sum(len(c.strip()) == size for c in cuts)))


def test_a_prefix_that_all_items_share(monkeypatch):
    """Frequent q-grams are expanded slice by slice; no pair is lost."""
    rng = random.Random(2)
    prefix = sentence(rng, 20)
    items = [(i, (prefix + " " + sentence(rng, 20)).encode()) for i in range(60)]
    index = decontaminate.Index(items)
    texts = [items[7][1], prefix.encode(), sentence(rng, 30).encode() + b" " + items[9][1][-120:]]
    whole = sorted(index.search(texts))
    monkeypatch.setattr(decontaminate, "PAIRS", 700)
    assert sorted(index.search(texts)) == whole
    assert {i for t, i, _, e in whole if t == 1} == set(range(60)) and [i for t, i, *_ in whole if t == 2] == [9]


def test_nothing(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs_of([(1, "a b c")]), none, ["doc_id"]).count() == 0
    assert decontaminate.contaminated(docs_of([]), none, ["doc_id"]).count() == 0
    assert not decontaminate.flag_documents(docs_of([(1, "a b c")]), none).first().contaminated


@pytest.mark.parametrize("limit", [200])
def test_blocks_of_the_benchmark(spark, docs_of, monkeypatch, limit):
    rng = random.Random(3)
    items = [sentence(rng, 30) for _ in range(6)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
    got = decontaminate.contaminated(docs_of(list(enumerate(items))), bench, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(6)]
