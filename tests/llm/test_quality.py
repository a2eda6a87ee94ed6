import math
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from wanderframe.llm import quality


def brute(text):
    x = text or ""
    w = [v for v in re.split(r"[\x20\x09-\x0D]+", x) if v]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


TEXTS = [None, "", " \t\n", "one", "a b", "a b c", "a b c a b c", "x " * 300, "line one\nline one\n \nline two\r\nline one", "é ß ü \x0b\x0c z#*$%&|<>", "a b c d a b c e f a b", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 40}" for i in range(90)), "\n".join(["same words here"] * 5)]


def test_counts_against_brute_force(spark, docs_of):
    labels = spark.createDataFrame([(11, 1, 0), (11, 1, None), (None, 1, 0), (3, 0, 0)], "doc_id long, quality long, toxic long")
    got = quality.score_documents(docs_of(list(enumerate(TEXTS)) + [(11, TEXTS[11]), (None, TEXTS[11])]), labels)
    assert got.columns[:4] == ["doc_id", "text", "lang", "source"] and got.columns.count("kept") == 1
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.text
        assert not (r.base_failed and r.kept)


def test_ratio_tells_trusted_from_junk(spark, docs_of):
    good = [" ".join(f"word{(i * 7 + j) % 90}" for j in range(80)) for i in range(20)]
    junk = [" ".join(f"w{(i * 5 + j) % 80}###" for j in range(80)) for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality long, toxic long")
    got = {r.doc_id: r for r in quality.score_documents(docs_of(list(enumerate(good + junk))), labels).collect()}
    assert all(got[i].kept for i in range(20)) and not any(got[i].kept for i in range(20, 30))


def test_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert quality.score_documents(docs_of([]), none).count() == 0
    r = quality.score_documents(docs_of([(1, TEXTS[11])]), none).first()
    assert r.kept and r.llr == 0


def test_no_python_on_the_main_path(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long")
    df = quality.score_documents(docs_of([(1, "a b")]), labels).where(F.col("kept"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def spark_hash(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def ratios(pairs, trusted, buckets):
    """Mean log ratio of each (doc_id, text), by two multinomials counted one by one."""

    def grams(t):
        w = [v for v in re.split(r"[\x20\x09-\x0D]+", t or "") if v]
        h = [spark_hash(v) for v in w]
        return [x % buckets for x in h] + [spark_hash((a, 8), (b, 8)) % buckets for a, b in zip(h, h[1:], strict=False)] + [spark_hash((0, 4), v[-3:]) % buckets for v in w]

    raw, target = Counter(), Counter()
    each = [grams(t) for _, t in pairs]
    for (i, _), g in zip(pairs, each, strict=True):
        raw.update(g)
        if i in trusted:
            target.update(g)
    n, m = sum(raw.values()) + 0.5 * buckets, sum(target.values()) + 0.5 * buckets
    return [sum(math.log((target[b] + 0.5) / m) - math.log((raw[b] + 0.5) / n) for b in g) / max(len(g), 1) for g in each]


def test_ratio_against_brute_force(spark, docs_of):
    """Two multinomials over hashed words, pairs and word endings, counted one by one."""
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["ab", "cd", "\u00e9f", "a-long-word", "x"]) for _ in range(rng.randint(0, 90))) for _ in range(20)]
    pairs = list(enumerate(texts)) + [(2, texts[20]), (None, texts[21])]
    labels = spark.createDataFrame([(i, 1, i % 5 == 0) for i in range(0, len(texts), 3)], "doc_id long, quality long, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as long) toxic")
    trusted = {i for i in range(0, len(texts), 3) if i % 5}

    want = sorted((str(i), round(x, 6)) for (i, _), x in zip(pairs, ratios(pairs, trusted, 97), strict=True))
    got = quality.score_documents(docs_of(pairs), labels, buckets_=97).collect()
    assert sorted((str(r.doc_id), round(r.llr, 6) + 0.0) for r in got) == [(i, x + 0.0) for i, x in want]
    assert all(r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD) for r in got)


def test_clashing_names(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    docs = docs_of([(1, TEXTS[11])]).withColumnsRenamed({"lang": "__h", "source": "__text", "n_chars": "__good"})
    r = quality.score_documents(docs, none)
    assert r.columns[:5] == ["doc_id", "text", "__h", "__text", "__good"] and r.first()["__h"] == "en"


def test_a_very_long_text(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    text = " ".join(f"w{i % 70_001}" for i in range(140_000)) + " one two three four one two three"
    r = quality.score_documents(docs_of([(1, text)]), none).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text)
