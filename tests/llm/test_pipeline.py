"""The pipeline against a plain version of each stage on the smallest tables."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_quality import brute, ratios
from wanderframe.llm import decontaminate, pii, quality, simhash
from wanderframe.llm.queries import PSEUDONYM_KEY, QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1 and not r.toxic}
    texts = {i: t for (i, t), ratio in zip(pairs, ratios(pairs, trusted, quality.BUCKETS), strict=True) if not brute(t)[5] and ratio >= quality.THRESHOLD}
    ids = sorted(texts)
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: shingles(texts[i]) for i in ids}
    for a in ids:
        for b in ids:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    ids = [i for i in ids if top(i) == i]
    bench = [decontaminate.normal(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = [i for i in ids if not any(b in decontaminate.normal(texts[i].encode()) for b in bench)]
    assert sorted(got) == ids
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    key = hashlib.sha256(PSEUDONYM_KEY.encode()).digest()
    for i in ids:
        want = library.encode(pii.pseudonymize(texts[i], key)[0], add_special_tokens=False).ids
        assert got[i].token_ids == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_near_copies_against_exact_similarity(spark):
    """Every link of 0.8 and more over a whole table, counted in an inverted index: how many
    of the rows that exact links leave to others are dropped, and whether any else is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    root = {i: i for i in sets}
    links = 0
    for i in sets:
        for j, both in Counter(j for s in sets[i] for j in holders[s] if j < i).items():
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()} if a != b else root
    wordless = sorted(i for i in sets if not sets[i])
    gone = {i for i in sets if root[i] != i} | set(wordless[1:])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert links > 100 and len(gone) > 50
    assert len(gone - kept) >= 0.99 * len(gone) and not (set(sets) - kept) - gone


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_resemblance_is_exact_for_small_sets():
    _, _, _, a = simhash.sketch(b"a b c d e f g h", 5)
    _, _, _, b = simhash.sketch(b"a b c d e f g x", 5)
    assert simhash.resemblance(a, b) == 3 / 5 and simhash.resemblance(a, a) == 1
    assert simhash.sketch(b"A  b\tc", 5)[0] == simhash.sketch(b"a b c", 5)[0]
