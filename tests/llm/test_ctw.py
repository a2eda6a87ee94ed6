import math
import random
from collections import Counter, defaultdict

import pytest

from wanderframe.llm import ctw

TEXTS = [None, "", "the cat sat on the mat", "The CAT sat", "\x0b\x0c", "zebra Zebra quagga", "é ü the", "the " * 500]


def test_base_against_counts(spark, docs_of):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(50)]
    texts = TEXTS + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    pairs = list(enumerate(texts)) + [(11, texts[11]), (11, texts[11]), (None, "the null")]
    got = ctw.score_documents(docs_of(pairs)).collect()
    c = Counter()
    for i, t in pairs:
        if not ctw.is_held_out(i):
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in pairs:
        w = [*(t or "").encode().lower().split(), None]
        want.append((str(i), ctw.is_held_out(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def slow_tree(texts, depth):
    """The same tree by recursion over dictionaries."""
    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)
    for t in texts:
        x = bytes(depth) + t + b"\0"
        for i in range(depth, len(x)):
            for d in range(depth + 1):
                ctx = x[i - d : i][::-1]
                if d:
                    kids[ctx[:-1]].add(ctx)
                for j in range(8):
                    prefix = (1 << j) | x[i] >> (8 - j)
                    counts[ctx, prefix][x[i] >> (7 - j) & 1] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(ctx, prefix):
        if (ctx, prefix) not in memo:
            own = kt(*counts[ctx, prefix])
            if len(ctx) == depth:
                memo[ctx, prefix] = (own, own)
            else:
                below = sum(weighted(k, prefix)[1] for k in kids[ctx] if (k, prefix) in counts)
                high = max(own, below)
                memo[ctx, prefix] = (own, high + math.log(math.exp(own - high) + math.exp(below - high)) - math.log(2))
        return memo[ctx, prefix]

    def score(t):
        x, total = bytes(depth) + t + b"\0", 0.0
        for i in range(depth, len(x)):
            for j in range(8):
                prefix, bit, p = (1 << j) | x[i] >> (8 - j), x[i] >> (7 - j) & 1, None
                for d in range(depth, -1, -1):
                    ctx = x[i - d : i][::-1]
                    if (ctx, prefix) not in counts:
                        continue
                    n = counts[ctx, prefix]
                    est = (n[bit] + 0.5) / (sum(n) + 1)
                    own, w = weighted(ctx, prefix)
                    share = math.exp(own - math.log(2) - w) if d < depth else 1
                    p = est if p is None else share * est + (1 - share) * p
                total += math.log10(0.5 if p is None else p)
        return total

    return score


@pytest.mark.parametrize(("depth", "cache_bits"), [(1, 20), (2, 4), (3, 20), (3, 6), (5, 20), (5, 3), (6, 8)])
def test_tree_against_recursion(spark, docs_of, depth, cache_bits):
    """With a large and a small cache: cells then come from the buckets' subtrees."""
    rng = random.Random(depth)
    texts = ["".join(rng.choice("abc \xe9") for _ in range(120)) for _ in range(14)] + ["unseen zzz", None, "x" * 3000]
    pairs = list(enumerate(texts)) + [(3, texts[3]), (6, texts[6]), (6, texts[6])]
    got = [(r.doc_id, r.score) for r in ctw.score_documents(docs_of(pairs), depth=depth, cache_bits=cache_bits).collect()]
    assert len(got) == len(pairs)
    score = slow_tree([(t or "").encode() for i, t in pairs if not ctw.is_held_out(i)], depth)
    want = {i: score((t or "").encode()) for i, t in pairs}
    for i, x in got:
        assert x == pytest.approx(want[i], rel=1e-4), i


def test_nothing_to_learn_from(spark, docs_of):
    held = next(i for i in range(100) if ctw.is_held_out(i))
    r = ctw.score_documents(docs_of([(held, "abc")])).first()
    assert (r.base_score, r.n_known, r.train_tokens) == (0, 0, 0) and r.bits_per_byte == pytest.approx(8)
    assert ctw.score_documents(docs_of([])).count() == 0


def test_log_gamma():
    import numpy as np

    x = np.array([0.5, 1, 1.5, 2, 7.5, 16, 100.5, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
