import random

import pytest
import xxhash
from pyspark.sql import functions as F

from wanderframe.llm import simhash


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps):
    """component of each (doc_id, fingerprint) by pairs."""
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(fps))]


def test_against_brute_force(spark, docs_of):
    rng = random.Random(5)
    texts = [None, "", "  \n", "one", "One TWO", "ÀB c À d", "a b c"]
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "Ij"]) + str(rng.randint(0, 30)) for _ in range(200)) for _ in range(6)]
    for b in base:
        w = b.split()
        texts += [b, b.upper().replace("IJ", "ij")] + [" ".join(w[:k] + ["zz"] + w[k + 1 :]) for k in range(0, 200, 23)]
    pairs = [(i * 3 % 101, t) for i, t in enumerate(texts)] + [(7, texts[9]), (7, texts[9]), (None, texts[9])]
    got = simhash.near_duplicates(docs_of(pairs)).collect()
    fps = [(d, slow_fingerprint(t)) for d, t in pairs]
    want = sorted(zip([(d is None, d) for d, _ in pairs], [f for _, f in fps], classes(fps), strict=True), key=str)
    assert sorted((((r.doc_id is None, r.doc_id), r.fp % (1 << 64), r.component_id) for r in got), key=str) == want


def test_chains_and_crowded_neighbourhoods(spark):
    rng = random.Random(1)
    fps = set()
    x = rng.getrandbits(64)
    for k in range(40):  # a chain, two bits at a time
        x ^= 1 << k | 1 << (63 - k) if k < 31 else 1 << k
        fps.add(x)
    y = rng.getrandbits(64)
    fps |= {y ^ (1 << a) for a in range(64)} | {y ^ 1 ^ (1 << a) for a in range(1, 64)} | {rng.getrandbits(64) for _ in range(200)}
    fps |= {0, (1 << 64) - 1, 1, 3, 7}
    pairs = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in pairs], "fp long")
    roots = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(df)).collect()}
    want = classes(pairs)
    by_root = {}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    for (_, f), c in zip(pairs, want, strict=True):
        by_root.setdefault(c, set()).add(roots.get(f, signed(f)))
    assert all(len(s) == 1 for s in by_root.values()) and len({next(iter(s)) for s in by_root.values()}) == len(by_root)


def test_one_of_each_stays(spark, docs_of):
    docs = docs_of([(5, "a b c d e"), (2, "A b c d e"), (2, "A b c d e"), (9, "other words are here now"), (None, "a b c d e"), (None, "null alone in here"), (4, None), (3, "")])
    got = simhash.keep_one(docs, 3)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect()) == [(False, 2, "A b c d e"), (False, 3, ""), (False, 9, "other words are here now"), (True, 0, "null alone in here")]


def test_empty_and_singles(spark, docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    r = simhash.near_duplicates(docs_of([(1, "alone")])).select("component_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f")).first()
    assert r.component_id == 1 and int(r.f, 16) == slow_fingerprint("alone")


def test_a_very_long_text_and_clashing_names(spark, docs_of):
    text = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    docs = docs_of([(1, text), (2, text + " tail"), (3, "alone")])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, carry=("lang",)).collect()}
    assert got[1].fp % (1 << 64) == slow_fingerprint(text) and got[2].component_id == 1 and got[3].component_id == 3 and got[1].lang == "en"
    with pytest.raises(ValueError, match="fp"):
        simhash.near_duplicates(docs, carry=("fp",))
    odd = docs.withColumnsRenamed({"lang": "__row", "source": "content", "kept": "k"})
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id: r["__row"] for r in kept.collect()} == {1: "en", 3: "en"}


def survivors(texts, words=5, similarity=0.8):
    """Indices that stay of ``texts``, by all pairs."""
    sets = [{hash(tuple(w[i : i + words])) for i in range(len(w) - words + 1)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] == root[j]:
                continue
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return sorted(set(root))


def swapped(rng, words, n, far=5):
    """``words`` with n of them replaced, each ``far`` or more from the next."""
    w = list(words)
    free = list(range(far, len(w) - far))
    for _ in range(n):
        at = rng.choice(free)
        free = [f for f in free if abs(f - at) >= far]
        w[at] = f"n{rng.getrandbits(40)}"
    return " ".join(w)


@pytest.mark.parametrize("group", [1 << 21, 30_000])
def test_a_hub_with_many_edited_copies(spark, docs_of, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(11)
    words = [f"w{rng.getrandbits(30)}" for _ in range(204)]
    # 180 of 220 shingles in common with the original, far fewer with each other.
    texts = [swapped(rng, words, 4) for _ in range(1000)]
    texts.insert(500, " ".join(words))
    texts += [swapped(rng, words, 9) for _ in range(30)]
    got = simhash.keep_one(docs_of(list(enumerate(texts))))
    assert sorted(r.doc_id for r in got.collect()) == survivors(texts)


def test_long_texts_are_verified_on_their_whole_sets(spark, docs_of):
    rng = random.Random(4)
    texts = []
    for copies in range(40):  # 3000 shingles each, alternately just above and below 0.8
        words = [f"w{rng.getrandbits(40)}" for _ in range(3004)]
        texts += [" ".join(words), swapped(rng, words, 66 if copies % 2 else 67)]
    got = simhash.keep_one(docs_of(list(enumerate(texts))))
    want = survivors(texts)
    assert len(want) == 60 and sorted(r.doc_id for r in got.collect()) == want
