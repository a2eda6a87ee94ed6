"""Suffix-array dedup (operator 2): every byte under a repeated string of ``LENGTH`` bytes.

Suffixes are brought into order by their leading tokens: sampled splitters range-partition
them (ties by place, so that equal suffixes may spread over buckets), each bucket is sorted by
multikey quicksort, neighbours with equal tokens repeat, and the edges of buckets are compared
with each other.  What is removed is what this order finds twice.

The order is taken at three grains, each of which leaves less to the next, so that not every
byte's suffix is shuffled.  In each window of LENGTH bytes the least hash of its ``GRAM``-byte
strings is its anchor; equal windows have equal anchors at the same offset.

1. Neighbouring windows of one anchor make a run.  Its tokens are the hashes of its anchor
   and of all its bytes.  Runs with equal tokens repeat as a whole; an anchor without an equal
   neighbour repeats nothing.
2. Of runs that share the anchor only, one of each kind is cut into blocks of ``BLOCK`` windows
   at fixed offsets from the anchor.  The tokens are hashes of the block's core, the bytes that
   all its windows have, and of all its bytes.
3. Of blocks that share the core only, one of each kind gives its windows.  Their tokens are
   the hashes of their two halves of 100 bytes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, pieces, stored

LENGTH, GRAM, BLOCK = 200, 64, 16
#: Bytes of a text that are hashed at once; longer texts are taken stretch by stretch.
CHUNK = 4 << 20
#: Records of a bucket of the order.
BUCKET = 4_000_000
MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
#: Places within a stretch take the low bits beside an anchor's hash.
LOW = np.uint64((1 << 24) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each position on, by doubling."""
    h = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    h = mixed(h)
    for level, m in enumerate(MULTIPLIERS):
        step = 1 << level
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        nxt = h[:-step] * m
        nxt += h[step:]
        nxt *= np.uint64(0x2545F4914F6CDD1D)
        h = mixed(nxt)
    return h


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, anchor's hash, content hash) of every run."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lens) - lens
    h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
    fits = lens >= LENGTH
    if not fits.any():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    packed = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_least(packed, LENGTH - GRAM + 1) & LOW).astype(np.int64)
    n = (lens - LENGTH + 1)[fits]
    text = np.repeat(np.flatnonzero(fits), n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[fits], n)
    at = anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    s, e = window[first], window[last]
    of = text[first]
    return of, s - starts[of], e - starts[of], at[first] - starts[of], h[at[first]].view(np.int64), stretch(h, s, e + LENGTH).view(np.int64)


def stretch(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the bytes from a to b (at least GRAM, at most 2 * LENGTH), by gram hashes."""
    g = (b - a).astype(np.uint64)
    for j in range(0, 2 * LENGTH - GRAM, GRAM):
        g = mixed((g * MULTIPLIERS[0] + h[np.minimum(a + j, b - GRAM)]) * MULTIPLIERS[1])
    return g


def chunked_runs(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs of a long text as from :func:`runs_of`, stretch by stretch.

    The last run of a stretch may go on behind it: the next stretch starts with its first
    window, so that no run is ever parted."""
    at = 0
    while True:
        of, s, e, a, h, g = runs_of([text[at : at + CHUNK]])
        final = at + CHUNK >= len(text)
        n = len(s) if final else len(s) - 1
        yield of[:n], s[:n] + at, e[:n] + at, a[:n] + at, h[:n], g[:n]
        if final:
            return
        at += int(s[-1])


def find_runs(docs: DataFrame) -> DataFrame:
    """(h, g, doc_id, row, s, e, a): the runs of all texts, h the anchor's hash, g the content's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in pieces(b.column(2), CHUNK):
                long = len(texts[-1]) > CHUNK
                parts = [(start, runs_of(texts[:-1] if long else texts))]
                for at, (of, s, e, a, h, g) in itertools.chain(parts, ((start + len(texts) - 1, x) for x in (chunked_runs(texts[-1]) if long else ()))):
                    take = pa.array(of + at)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), b.column(0).take(take), b.column(1).take(take), *(pa.array(x.astype(np.int32)) for x in (s, e, a))], names=["h", "g", "doc_id", "row", "s", "e", "a"])

    return docs.mapInArrow(run, "h long, g long, doc_id long, row long, s int, e int, a int")


def expanded(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """s, s + 1, ... of n numbers for each s."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)


def hashed(text: pa.Scalar, spans: pa.Scalar, fields: int) -> Iterator[tuple]:
    """(gram hashes, their first place, length of the text, spans) of stretches of the text
    that hold the spans with a margin; the spans are arrays of their fields in order of s."""
    raw = np.frombuffer(text.as_buffer(), np.uint8)
    own = [spans.values.field(f).to_numpy().astype(np.int64) for f in range(fields)]
    order = np.argsort(own[0], kind="stable")
    own = [x[order] for x in own]
    i = 0
    while i < len(order):
        j = int(np.searchsorted(own[0], own[0][i] + CHUNK, "right"))
        low = max(0, int(own[0][i]) - 2 * LENGTH)
        high = min(len(raw), int(own[1][i:j].max()) + 3 * LENGTH)
        yield gram_hashes(raw[low:high]), low, len(raw), [x[i:j] for x in own]
        i = j


def find_blocks(docs: DataFrame) -> DataFrame:
    """The blocks of the runs in ``spans`` (s, e, a): h the core's hash, g the content's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, spans in enumerate(b.column(3)):
                for h, base, size, (s, e, a) in hashed(b.column(2)[i], spans, 3):
                    low, high = (s - a) // BLOCK, (e - a) // BLOCK
                    n = high - low + 1
                    first = np.repeat(a, n) + BLOCK * expanded(low, n)
                    s, e = np.maximum(np.repeat(s, n), first), np.minimum(np.repeat(e, n), first + BLOCK - 1)
                    # With the offset from the anchor: blocks of two runs of one document may cover the same place.
                    offset = (first - np.repeat(a, n)).astype(np.uint64) * MULTIPLIERS[4]
                    core = mixed((stretch(h, first + BLOCK - 1 - base, first + LENGTH - base) ^ offset) * MULTIPLIERS[5])
                    # At either end of the document a block is cut off.
                    x, y = np.maximum(first, 0), np.minimum(first + BLOCK - 1 + LENGTH, size)
                    full = mixed((stretch(h, x - base, y - base) ^ offset ^ (x - first).astype(np.uint64)) * MULTIPLIERS[5])
                    yield pa.RecordBatch.from_arrays([*(pa.array(v.view(np.int64)) for v in (core, full)), *(pa.repeat(b.column(c)[i], len(first)) for c in (0, 1)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["h", "g", "doc_id", "row", "s", "e"])

    return docs.mapInArrow(run, "h long, g long, doc_id long, row long, s int, e int")


def find_windows(docs: DataFrame) -> DataFrame:
    """The windows in ``spans`` (s, e) of each document: h and g the hashes of their halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, spans in enumerate(b.column(3)):
                for h, base, _, (s, e) in hashed(b.column(2)[i], spans, 2):
                    p = expanded(s, e - s + 1)
                    t = [mixed((h[p - base + j] * MULTIPLIERS[2] + h[p - base + j + LENGTH // 2 - GRAM]) * MULTIPLIERS[3]).view(np.int64) for j in (0, LENGTH // 2)]
                    at = pa.array(p.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(t[0]), pa.array(t[1]), *(pa.repeat(b.column(c)[i], len(p)) for c in (0, 1)), at, at], names=["h", "g", "doc_id", "row", "s", "e"])

    return docs.mapInArrow(run, "h long, g long, doc_id long, row long, s int, e int")


def multikey_order(tokens: list[np.ndarray], small: int = 4096) -> np.ndarray:
    """The order of suffixes by their tokens: three-way partition on one token at a time."""
    n = len(tokens[0])
    out, todo = np.empty(n, np.int64), [(0, np.arange(n), 0)]
    while todo:
        at, part, depth = todo.pop()
        if depth == len(tokens) or len(part) < 2:
            out[at : at + len(part)] = part
            continue
        if len(part) <= small:
            out[at : at + len(part)] = part[np.lexsort([t[part] for t in reversed(tokens[depth:])])]
            continue
        key = tokens[depth][part]
        probe = np.sort(key[:: max(1, len(key) // 255)])
        pivot = probe[len(probe) // 2]
        below, same = key < pivot, key == pivot
        n0, n1 = int(below.sum()), int(same.sum())
        todo += [(at, part[below], depth), (at + n0, part[same], depth + 1), (at + n0 + n1, part[~(below | same)], depth)]
    return out


def sorted_bucket(batches: Iterator[pa.RecordBatch], part: int, look: bool) -> Iterator[pa.RecordBatch]:
    """The records of a bucket that repeat, or have neighbours alike in the first token only,
    or stand at its edges, with what the bucket can tell of them.

    Added are ``whole`` (both tokens repeat), ``several`` (its first token goes with several
    second ones), ``one`` (the first of its tokens here), ``n`` (records with its tokens
    here), ``tip`` (it stands for the first or last second token of the bucket's first or last
    first one: at most four records) and ``part``, the bucket."""
    got = list(batches)
    if not sum(b.num_rows for b in got):
        return
    t = pa.Table.from_batches(got).combine_chunks()
    tokens = [t.column(c).to_numpy() for c in ("h", "g")]
    order = multikey_order(tokens)
    h, g = tokens[0][order], tokens[1][order]
    new_h = np.append(True, h[1:] != h[:-1])
    new = new_h | np.append(True, g[1:] != g[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(h)))
    whole = np.repeat(n > 1, n)
    group = np.cumsum(new_h) - 1
    several = (np.bincount(group[first]) > 1)[group]
    edge = (h == h[0]) | (h == h[-1])
    ends = h[first]
    tip = np.zeros(len(h), bool)
    tip[first[[0, np.searchsorted(ends, h[0], "right") - 1, np.searchsorted(ends, h[-1]), -1]]] = True
    keep = np.flatnonzero(edge | whole | (several & look))
    out = t.take(pa.array(order[keep]))
    for name, column in (("whole", whole), ("several", several), ("one", new), ("n", np.repeat(n, n)), ("tip", tip)):
        out = out.append_column(name, pa.array(column[keep]))
    out = out.append_column("part", pa.array(np.full(len(keep), part, np.int32)))
    yield from out.to_batches(max_chunksize=500_000)


def ordered(records: DataFrame, look: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """Of records (h, g, doc_id, row, s, e, ...): those with ``whole``, whose two tokens stand
    twice in the order of all, and with ``open``, whose first token goes with several second
    ones: one of each of these.  Also returns the tables behind, to be dropped in the end.

    ``records`` is a stored table.  Ties are parted by place: a token that very many records
    have spreads over as many buckets as it needs."""
    spark = records.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records.count() // BUCKET))
    added = "whole boolean, several boolean, one boolean, n long, tip boolean, part int"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields] + [added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from sorted_bucket(batches, TaskContext.get().partitionId(), look)

    found = stored(records.repartitionByRange(parts, "h", "g", "doc_id", "row", "s").mapInArrow(run, schema), "found")
    # The edges of buckets, summed up by each before they meet: of its first and last h, the
    # first and last g, so at most four rows of a bucket.
    tips = stored(found.where("tip").select("h", "g", "n", "several", "part"), "tips")
    by_both = tips.groupBy("h", "g").agg((F.sum("n") > 1).alias("whole_"), F.min("part").alias("part_"))
    by_h = tips.groupBy("h").agg((F.max("several") | (F.min("g") < F.max("g"))).alias("several_"))
    # At most four rows a partition: a bound on what is broadcast.
    joined = found.join(F.broadcast(by_both), ["h", "g"], "left").join(F.broadcast(by_h), "h", "left")
    whole, several = F.coalesce("whole_", "whole"), F.coalesce("several_", "several")
    known = joined.select(*records.columns, whole.alias("whole"), (several & (~whole | (F.col("one") & (F.coalesce("part_", "part") == F.col("part"))))).alias("open"))
    return known.where("whole OR open"), [found, tips]


def with_spans(docs: DataFrame, spans: DataFrame, fields: tuple[str, ...], how: str = "inner") -> DataFrame:
    """(doc_id, row, text as bytes, spans): each document with the list of its spans."""
    lists = spans.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set(F.struct(*fields)).alias("spans"))
    return docs.join(lists, F.expr("row = __row AND doc_id <=> __id"), how).select("doc_id", "row", "text", "spans")


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, a, b): stretches of bytes to remove; they may overlap."""
    removed = lambda known: known.where("whole").select("doc_id", "row", F.col("s").alias("a"), (F.col("e") + LENGTH).alias("b"))
    runs = stored(find_runs(docs), "runs")
    known, _ = ordered(runs)
    forget(runs)
    whole = [removed(known)]
    texts = stored(with_spans(docs, known.where("open"), ("s", "e", "a")), "texts")
    blocks = stored(find_blocks(texts), "blocks")
    known, _ = ordered(blocks)
    forget(blocks)
    whole.append(removed(known))
    windows = stored(find_windows(with_spans(texts.drop("spans"), known.where("open"), ("s", "e"))), "windows")
    known, _ = ordered(windows, look=False)
    forget(windows, texts)
    return whole[0].unionByName(whole[1]).unionByName(removed(known))


def merged(spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal stretches that the spans (a, b) cover; null: none."""
    if not spans.is_valid or not len(spans.values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (spans.values.field(f).to_numpy() for f in range(2))
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:], len(b)) - 1]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, text): ``row`` tells rows with one doc_id apart unless they are alike."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("text"))
    return plain.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and,
    with ``texts``, ``kept`` (binary: the bytes that remain).

    Removed is each byte covered by a string of LENGTH bytes that starts anywhere else too,
    in the same document or another, judged on the input.  Null is as empty: no bytes, no
    spans.  Texts shorter than LENGTH stay whole; longer ones may be of any length.  Repeated rows repeat each other and lose
    all of LENGTH bytes or more.  Null doc_ids are allowed; other columns are not read.
    """
    rows = keyed(docs, doc_id, text)
    joined = with_spans(rows, spans_of(rows), ("a", "b"), "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, spans in zip(b.column(1), b.column(2), strict=True):
                raw = memoryview(t.as_buffer())
                at, gone, kept = 0, 0, []
                begin, end = merged(spans)
                for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                    kept.append(raw[at:x])
                    gone, at = gone + y - x, y
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), gone, len(begin), hashlib.sha256(kept).hexdigest(), kept))
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())) if i < 4 or texts]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return joined.select("doc_id", "text", "spans").mapInArrow(run, schema)
