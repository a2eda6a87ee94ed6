"""Quality rules (operator 3), built of DataFrame functions only.

A document's n-grams are hashed into buckets: its words, pairs of neighbouring words, and the
last three characters of each word, which recur where the words themselves are rare.  Two
multinomials over the buckets, of a trusted target and of the raw corpus, give each document
a log-likelihood ratio, normalised by its number of n-grams.  Base rules on counts of words
and repeats come first.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WS

BUCKETS = 10_000
SMOOTH = 0.5
#: Documents whose mean log ratio (natural, per n-gram) lies below are rejected.
THRESHOLD = -0.25
#: The target is fitted on so many trusted documents at most.
TRUSTED = 100_000
SYMBOLS = "#*$%&|<>"
#: Places of windows take the low bits; no array has more elements.
PLACE_BITS = 31
LOW = (1 << PLACE_BITS) - 1


def once(df: DataFrame, **columns: F.Column) -> DataFrame:
    """``df`` with columns that are computed once: a generator keeps the optimizer from
    putting an expression in the place of each of its uses, inside lambdas above all."""
    one = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(one)))


def with_words(docs: DataFrame, text: str = "text", counts: bool = True, buckets_: int = BUCKETS) -> DataFrame:
    """``docs`` with ``__h``, the hashes of the text's words, and ``__e``, the buckets of their
    last three characters; with ``counts`` also what needs the text: n_words, word_chars,
    n_symbols, n_dup_lines.  The words themselves go no further, so that rows stay small."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split("__text", BLANK), lambda w: w != "")
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    out = once(docs.withColumn("__text", whole), __words=words, **({"__lines": lines} if counts else {}))
    x = F.col("__text")
    own = {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate(x, WS, "")).cast("long"),
        "n_symbols": (F.length(x) - F.length(F.translate(x, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    }
    hashes = F.transform("__words", lambda w: F.xxhash64(w))
    endings = F.transform("__words", lambda w: F.pmod(F.xxhash64(F.lit(0), F.substring(w, -3, 3)), F.lit(buckets_)).cast("int"))
    return once(out, __h=hashes, __e=endings, **(own if counts else {})).drop("__words", "__lines", "__text")


def buckets(buckets: int = BUCKETS) -> F.Column:
    """The buckets of a document's words, of its pairs of neighbouring words and of the
    words' last three characters."""
    single = F.transform("__h", lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pair = F.transform(F.slice("__h", 1, F.greatest(F.size("__h") - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(h, F.get("__h", i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(single, pair, "__e")


def repeated_words(docs: DataFrame) -> DataFrame:
    """``docs`` of :func:`with_words` with ``n_repeat_words``."""
    three = F.when(
        F.size("__h") >= 3,
        F.transform(F.slice("__h", 1, F.greatest(F.size("__h") - 2, F.lit(1))), lambda h, i: F.xxhash64(h, F.get("__h", i + 1), F.get("__h", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    out = once(docs, __three=three).drop("__h", "__e")
    # Windows in order of their hash, with their place in the low bits, for texts in which
    # any is repeated; neighbours alike but for those bits are looked at closely.
    repeats = F.size(F.array_distinct("__three")) < F.size("__three")
    packed = F.sort_array(F.transform("__three", lambda h, i: h.bitwiseAND(F.lit(~LOW)).bitwiseOR(i.cast("long"))))
    none = F.array().cast("array<bigint>")
    out = once(out, __packed=F.when(repeats, packed).otherwise(none))
    top = lambda x: F.shiftright(x, PLACE_BITS)
    close = F.filter("__packed", lambda x, i: (top(x) == top(F.get("__packed", i + 1))) | ((i > 0) & (top(x) == top(F.get("__packed", i - 1)))))
    out = once(out, __close=F.transform(close, lambda x: x.bitwiseAND(LOW).cast("int"))).drop("__packed")
    exact = F.sort_array(F.transform("__close", lambda p: F.struct(F.get("__three", p).alias("h"), p.alias("p"))))
    out = once(out, __exact=F.when(F.size("__close") > 0, exact).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))).drop("__three", "__close")
    twice = F.filter("__exact", lambda x, i: (x.h == F.get("__exact", i + 1).h) | ((i > 0) & (x.h == F.get("__exact", i - 1).h)))
    out = once(out, __at=F.sort_array(F.transform(twice, lambda x: x.p))).drop("__exact")
    covered = F.aggregate(F.transform("__at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1) - p, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", covered).drop("__at")


def log_ratios(words: DataFrame, buckets_: int = BUCKETS) -> list[float]:
    """The log ratio of target to raw for each bucket; ``words`` has ``__trusted``.

    The counts are an aggregate over every document; only the buckets come to the driver."""
    each = words.select("__trusted", F.explode(buckets(buckets_)).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.count(F.when(F.col("__trusted"), 1)).alias("target"))
    raw, target = [0] * buckets_, [0] * buckets_
    for r in each.collect():
        raw[r.b], target[r.b] = r.raw, r.target
    all_raw, all_target = sum(raw) + SMOOTH * buckets_, sum(target) + SMOOTH * buckets_
    if not sum(target):
        return [0.0] * buckets_
    from math import log

    return [log((t + SMOOTH) / all_target) - log((r + SMOOTH) / all_raw) for r, t in zip(raw, target, strict=True)]


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets_: int = BUCKETS, trusted: int = TRUSTED) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, llr, kept``; columns of these names are replaced.

    ``labels`` (doc_id, quality, toxic) names the trusted documents: those of quality 1 that
    are not toxic, the first ``trusted`` by a hash of their id if there are more.  The raw
    multinomial covers every document.  Null texts are as empty: no words, base_failed.  A
    document without words has ratio 0.  Without trusted documents every ratio is 0 and the
    base rules decide alone.  A null doc_id is never trusted; repeated rows count each.
    Columns of any other name pass through.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    own = [c for c in docs.columns if c not in names]
    # Under names of their own, so that none clashes with a column on the way.
    docs = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(own)])
    doc_id, text = (f"c{own.index(c)}" for c in (doc_id, text))
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__good")).distinct()
    good = good.orderBy(F.xxhash64("__good"), "__good").limit(trusted).withColumn("__trusted", F.lit(True))
    words = with_words(docs, text, counts=False, buckets_=buckets_)
    # At most ``trusted`` ids: a bound on what is broadcast.
    flagged = words.join(F.broadcast(good), words[doc_id].cast("long") == good["__good"], "left").select("__h", "__e", F.coalesce("__trusted", F.lit(False)).alias("__trusted"))
    weights = F.from_json(F.lit(json.dumps(log_ratios(flagged, buckets_))), "array<double>")
    sums = F.aggregate(buckets(buckets_), F.lit(0.0), lambda a, b: a + F.get(weights, b))
    grams = F.greatest(3 * F.col("n_words") - 1, F.lit(1))
    out = repeated_words(once(with_words(docs, text, buckets_=buckets_), llr=F.round(sums / grams, 9)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], *names)
