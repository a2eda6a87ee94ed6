import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wanderframe.llm import substrings
from wanderframe.llm.common import stored


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    n = substrings.LENGTH
    seen = Counter(x[k : k + n] for x in raw for k in range(len(x) - n + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                gone[k : k + n] = True
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_against_brute_force(spark, docs_of):
    rng = random.Random(3)
    shared = [words(rng, 60) for _ in range(3)]
    texts = [None, "", "x", "y" * 199, "z" * 200, "z" * 900, "z" * 201, words(rng, 400)]
    for k in range(30):
        s = rng.choice(shared)
        cut = rng.randint(150, len(s))
        texts.append(words(rng, rng.randint(5, 80)) + s[:cut] + words(rng, rng.randint(0, 60)))
    texts += [texts[-1], texts[-2] + " tail", texts[-3][:210], texts[-3][:205] + "!", texts[-4].replace("a", "b", 1)]
    pairs = list(enumerate(texts)) + [(5, texts[5]), (None, texts[9]), (None, texts[9])]
    got = substrings.remove_repeats(docs_of(pairs)).collect()
    want = Counter((i, *w) for (i, _), w in zip(pairs, brute([t for _, t in pairs]), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_empty_table(spark, docs_of):
    assert substrings.remove_repeats(docs_of([]), texts=False).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(1)
    for high in (3, 50, 1 << 40):
        t = [rng.integers(0, high, 20_000) for _ in range(2)]
        order = substrings.multikey_order(t, small=64)
        assert sorted(order.tolist()) == list(range(20_000))
        pairs = list(zip(t[0][order].tolist(), t[1][order].tolist(), strict=True))
        assert pairs == sorted(pairs)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_order_against_counts(spark, parts):
    """Few tokens over many buckets: ties are parted by place and met at the edges."""
    rng = random.Random(parts)
    rows = [(rng.choice([1, 1, 1, 5, rng.randrange(9, 2000)]), rng.choice([0, 0, 0, 0, rng.randrange(40)]), k % 7, k, k, k) for k in range(400)]
    records = stored(spark.createDataFrame(rows, "h long, g long, doc_id long, row long, s int, e int"))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    known, _ = substrings.ordered(records)
    got = known.collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    both, kinds = Counter(r[:2] for r in rows), Counter(h for h, _ in {r[:2] for r in rows})
    assert {r.s for r in got if r.whole} == {r[4] for r in rows if both[r[:2]] > 1}
    assert sorted((r.h, r.g) for r in got if r.open) == sorted(k for k in both if kinds[k[0]] > 1)


def test_places_beyond_sixteen_mebibytes(spark, docs_of):
    """A passage far behind in one text repeats at the start of others; nothing else does."""
    rng = np.random.default_rng(3)
    letters = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    first, second = letters(400), letters(230)
    texts = [letters(17_500_000) + first + letters(2_000_000) + second + letters(100), first + letters(50), letters(60) + second]
    got = {r.doc_id: r for r in substrings.remove_repeats(docs_of(list(enumerate(texts)))).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in range(3)] == [(630, 2), (400, 1), (230, 1)]
    assert bytes(got[0].kept).decode() == texts[0].replace(first, "").replace(second, "")


@pytest.mark.parametrize("chunk", [450, 700, 5000])
def test_no_run_is_parted(monkeypatch, chunk):
    text = (words(random.Random(chunk), 700) + "z" * 900 + words(random.Random(1), 100)).encode()
    want = substrings.runs_of([text])
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    got = list(substrings.chunked_runs(text))
    assert len(got) > 1 and all(np.array_equal(np.concatenate(x), w) for x, w in zip(zip(*got, strict=True), want, strict=True))


@pytest.mark.parametrize("chunk", [500, 1000, 3000])
def test_stretches_of_long_texts(spark, docs_of, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = random.Random(chunk)
    shared = [words(rng, 80) for _ in range(3)]
    texts = ["".join(rng.choice([*shared, words(rng, 30), "z" * 300]) for _ in range(rng.randint(1, 25))) for _ in range(12)]
    got = substrings.remove_repeats(docs_of(list(enumerate(texts)))).collect()
    want = [(i, *w) for i, w in enumerate(brute(texts))]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("n", [1, 2, 7, 64, 137, 300])
def test_sliding_least(n):
    x = np.random.default_rng(n).integers(0, 1000, 400)
    assert substrings.sliding_least(x, n).tolist() == [x[i : i + n].min() for i in range(400 - n + 1)]
