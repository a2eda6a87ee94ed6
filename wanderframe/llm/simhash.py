"""SimHash near-dedup (operator 5): segment-popcount embedding and a grid range-join.

Distinct fingerprints are mapped to the bit counts of their segments.  The Manhattan
distance of two such vectors is at most the Hamming distance, so fingerprints that link lie
within that range of each other in the grid of vectors.  Both sides of the range join meet
half way: each fingerprint enters its own cell and the cells one step away.  Cells that hold
one fingerprint alone are dropped; the rest is verified exactly, again half way and bit by
bit, so that not even a crowded cell is paired out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, pieces, stored

SEED = 42
SEGMENTS = 16  # of four bits; a count is 0 to 4, kept in three bits of the cell
BITS = 64 // SEGMENTS
SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    w = text.lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(b" ".join(w), SEED)
    if words == 3:
        h = [digest(b"%b %b %b" % s, SEED) for s in zip(w, w[1:], w[2:], strict=False)]
    else:
        h = [digest(b" ".join(w[i : i + words]), SEED) for i in range(len(w) - words + 1)]
    bits = np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, carry: list[str], words: int = 3, text: str = "text") -> DataFrame:
    """The columns ``carry`` and ``fp``, the fingerprint as a signed long (null text: 0)."""
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + ["fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for _, part in pieces(b.column(0)) for t in part), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp.view(np.int64))], names=[*carry, "fp"])

    return docs.select(F.col(text).cast("string").alias("__text"), *carry).mapInArrow(run, schema)


def counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the segments, lowest bits first."""
    return np.stack([np.bitwise_count((fp >> np.uint64(BITS * s)) & np.uint64((1 << BITS) - 1)) for s in range(SEGMENTS)], axis=1).astype(np.int64)


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, step, fp): the own cell (step 0) and those one up (segment + 1) or down (-1 - segment)."""
    for b in batches:
        for at in range(0, b.num_rows, 50_000):
            fp = b.column(0)[at : at + 50_000].to_numpy().view(np.uint64)
            c = counts(fp)
            own = (c << (3 * np.arange(SEGMENTS))).sum(axis=1)
            cell, step, of = [own], [np.zeros(len(fp), np.int32)], [fp]
            for s in range(SEGMENTS):
                for sign, ok in ((1, c[:, s] < BITS), (-1, c[:, s] > 0)):
                    cell.append(own[ok] + sign * (1 << 3 * s))
                    step.append(np.full(ok.sum(), sign * (s + 1), np.int32))
                    of.append(fp[ok])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell)), pa.array(np.concatenate(step)), pa.array(np.concatenate(of).view(np.int64))], names=["cell", "step", "fp"])


def midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mid, fp): the fingerprints at most one bit away that lie in the cell of the given step."""
    for b in batches:
        for at in range(0, b.num_rows, 200_000):
            part = b.slice(at, 200_000)
            step, fp = part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64)
            mid, of = [fp[step == 0]], [fp[step == 0]]
            for s in range(SEGMENTS):
                for sign in (1, -1):
                    own = fp[step == sign * (s + 1)]
                    for bit in range(BITS * s, BITS * (s + 1)):
                        got = own[(own >> np.uint64(bit) & np.uint64(1)) == (0 if sign > 0 else 1)]
                        mid.append(got ^ np.uint64(1 << bit))
                        of.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(mid).view(np.int64)), pa.array(np.concatenate(of).view(np.int64))], names=["mid", "fp"])


def neighbours(fps: DataFrame) -> DataFrame:
    """(mid, fp, a): the distinct ``fp`` within one bit of a midpoint, of which a is the least.

    Two fingerprints are at two bits or fewer exactly if they share a midpoint; midpoints of
    one alone are left out."""
    grid = fps.mapInArrow(cells, "cell long, step int, fp long")
    crowded = grid.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    near = grid.join(crowded, "cell", "left_semi").select("step", "fp").mapInArrow(midpoints, "mid long, fp long")
    stars = near.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a")
    return near.join(stars, "mid")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, that connect all distinct ``fp`` at two or fewer differing bits.

    The edges are stars: all fingerprints within one bit of a midpoint link to the least of
    them.
    """
    return neighbours(fps).where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def components(edges: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(node, root): the least node of each connected component, for all of its other nodes.

    Alternating large-star and small-star rounds on the edge table; each is checkpointed, its
    predecessor dropped, and only a count and a fingerprint of the edges come to the driver,
    which stay the same once a round changes nothing.
    """
    a, b = names

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())

    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    was = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # Large star: neighbours above a node link to the least of its neighbourhood.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its lesser neighbours link to the least of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stored(small, "edges")
        forget(now)
        now, before, was = new, was, state(new)
        if was == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the columns ``carry``, ``fp, root,
    component_id``.

    Fingerprints at two or fewer differing bits are linked; ``component_id`` is the smallest
    doc_id reachable and ``root`` the least fingerprint.  Null, empty and wordless texts have
    fingerprint zero and link like any other.  A null doc_id is never the smallest unless a
    component has no other.  Repeated rows each keep their row.  Columns that are not carried
    are not read, whatever their names; a carried one may not be named as a result's.
    """
    if clash := {"doc_id", "fp", "root", "component_id"} & set(carry):
        raise ValueError(f"carried columns named as results: {', '.join(sorted(clash))}")
    rows = stored(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), *carry, F.col(text).alias("text")), ["doc_id", *carry], words))
    ids = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(ids.select("fp")))
    linked = ids.join(roots, ids.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    label = linked.join(best, "root").select("fp", "root", "component_id")
    return rows.join(label, "fp").select("doc_id", *carry, "fp", "root", "component_id")


#: Part fingerprints of a document, and shingles in each.
PARTS, PART = 16, 4


def shingle_hashes(w: list[bytes], words: int) -> np.ndarray:
    """Hashes of the word shingles in order of the text, repeats included."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))] if w else [], np.uint64)


def sketch(text: bytes, words: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(content, fingerprint, keys, set) of a text.

    ``content`` identifies its sequence of words.  ``keys`` are fingerprints of parts of the
    shingle set: the set is dealt by hash into as many classes as give about PART shingles
    each, for both powers of two around that number, and PARTS classes are fingerprinted
    (few shingles make the exclusive-or of their hashes a fingerprint as good as the
    majority).  ``set`` has the hashes of all distinct shingles, in order."""
    w = text.lower().split()
    content = xxhash.xxh64_intdigest(b" ".join(w), SEED + 1)
    h = shingle_hashes(w, words)
    if not len(h):
        return content, 0, np.zeros(0, np.int64), h
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    fp = int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h)).tobytes(), "big")
    own = np.unique(h)
    mixed = own * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    level = max(0, (len(own) // PART).bit_length() - 1)
    keys = []
    for at in (level, level + 1):
        cls = mixed & np.uint64((1 << at) - 1)
        few = cls < PARTS
        order = np.argsort(cls[few], kind="stable")
        c, x = cls[few][order], mixed[few][order]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
        if len(first):
            part = np.bitwise_xor.reduceat(x, first) + (c[first] + np.uint64(at << 8)) * np.uint64(0xD6E8FEB86659FD93)
            keys.append(part.view(np.int64))
    return content, fp, np.concatenate(keys) if keys else np.zeros(0, np.int64), own


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two whole shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sketch(t, words) for _, part in pieces(b.column(0)) for t in part]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(np.array([g[i] for g in got], np.uint64).view(np.int64)) for i in (0, 1)), pa.array([g[2] for g in got], pa.list_(pa.int64()))], names=["doc_id", "row", "content", "fp", "keys"])

    return docs.select("text", "doc_id", "row").mapInArrow(run, "doc_id long, row long, content long, fp long, keys array<bigint>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(content, set) of ``docs`` (text, content): all distinct shingle hashes of the text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in pieces(b.column(0)):
                sets = [np.unique(shingle_hashes(t.lower().split(), words)).tobytes() for t in part]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(start, len(part)), pa.array(sets, pa.binary())], names=["content", "set"])

    return docs.select("text", "content").mapInArrow(run, "content long, set binary")


def keys_of(nodes: DataFrame) -> DataFrame:
    """(k, content) of the keys that several contents share: part fingerprints, whole
    fingerprints, and midpoints of whole fingerprints at two bits or fewer."""
    by_fp = nodes.select("fp", "content")
    near = stored(neighbours(by_fp.select("fp").distinct()).select("mid", "fp").join(by_fp, "fp"), "near")
    keyed = nodes.select(F.explode("keys").alias("k"), "content").unionByName(by_fp.select(F.xxhash64(F.lit("fp"), "fp").alias("k"), "content")).unionByName(near.select(F.xxhash64(F.lit("mid"), "mid").alias("k"), "content"))
    least = keyed.groupBy("k").agg(F.min("content").alias("a"), F.count("*").alias("n")).where("n > 1").select("k", "a")
    shared = stored(keyed.join(least, "k").select("k", "a", F.col("content").alias("b")), "shared")
    forget(near)
    return shared


def centre_links(shared: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the members b of a key that resemble its least member a by ``similarity``."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(i)] for i in (2, 3))
            ok = pa.array([resemblance(p, q) >= similarity for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    pairs = shared.where("a <> b").select("a", "b").distinct()
    left = pairs.join(sets.select(F.col("content").alias("a"), F.col("set").alias("x")), "a")
    return left.join(sets.select(F.col("content").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def joined(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of labels to unite: all that pairs of ``sets`` alike by ``similarity`` connect.

    Members are compared with all others at once, by the counts of shared shingles in an
    inverted index.  Who was just united goes next, so that a hub soon unites its group, and
    the largest class last: once all members left are of one class, every pair of two classes
    has been compared."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    shingle, token = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), size)
    by_token = np.argsort(token, kind="stable")
    posting = member[by_token]
    first = np.append(0, np.cumsum(np.bincount(token, minlength=len(shingle))))
    begin = np.append(0, np.cumsum(size))
    names, cls = np.unique(labels, return_inverse=True)
    cls = cls.copy()
    united = []
    left = np.ones(len(sets), bool)
    wanted: list[int] = []
    order = iter(np.argsort(np.bincount(cls)[cls], kind="stable").tolist())
    while True:
        x = wanted.pop() if wanted else next(order, None)
        if x is None:
            return united
        if not left[x]:
            continue
        rest = cls[left]
        if (rest == rest[0]).all():
            return united
        left[x] = False
        t = token[begin[x] : begin[x + 1]]
        n = first[t + 1] - first[t]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[t], n)
        shared = np.bincount(posting[at], minlength=len(sets))
        alike = (cls != cls[x]) & (shared / np.maximum(size + size[x] - shared, 1) >= similarity)
        for c in np.unique(cls[alike]).tolist():
            united.append((int(names[cls[x]]), int(names[c])))
            wanted += np.flatnonzero((cls == c) & alike & left).tolist()
            cls[cls == c] = cls[x]


#: Shingles of a block of a key's members; members of a larger key meet block by block.
GROUP = 1 << 21


def member_links(shared: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): roots of ``roots`` that pairs of other members of a key connect.

    Of each key the members but the least remain, which has been compared with all, and of
    keys with the same members one.  Members of one component need no comparing.  Keys with
    many shingles are parted into blocks, each pair of which is a group of its own."""
    label = shared.where("a <> b").select("k", F.col("b").alias("content")).join(roots.select(F.col("node").alias("content"), "root"), "content", "left").select("k", "content", F.coalesce("root", "content").alias("root"))
    sized = stored(label.join(sets.select("content", (F.octet_length("set") / 8).cast("long").alias("size")), "content"), "sized")
    members = [F.count("*"), F.bit_xor(F.xxhash64("content")), F.bit_xor(F.xxhash64("content", F.lit(1)))]
    open_ = sized.groupBy("k").agg(F.struct(*[m.alias(f"m{i}") for i, m in enumerate(members)]).alias("of"), F.greatest(F.lit(1), F.ceil(F.sum("size") / GROUP).cast("int")).alias("blocks"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
    one = open_.groupBy("of").agg(F.min(F.struct("k", "blocks")).alias("g")).select("g.k", "g.blocks")
    own = F.pmod(F.xxhash64("content", F.lit(2)), F.col("blocks")).cast("int")
    parted = sized.join(one, "k").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parted = parted.where("blocks = 1 OR own <> other").select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "content", "root")
    groups = parted.join(sets, "content").select("k", "i", "j", "root", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, of = None, [], []

        def unite() -> pa.RecordBatch:
            pairs = joined(at, np.array(of, np.int64), similarity) if len(set(of)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            for k, i, j, root, s in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if group != (k, i, j):
                    if len(at) > 1:
                        yield unite()
                    group, at, of = (k, i, j), [], []
                at.append(np.frombuffer(s, np.uint64))
                of.append(root)
        if len(at) > 1:
            yield unite()

    found = stored(groups.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(run, "a long, b long").distinct(), "united")
    forget(sized)
    return found


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group of near duplicates: one of each stays.

    Groups are connected by documents whose sets of word shingles have a Jaccard similarity
    of at least ``similarity``.  Edits move a whole fingerprint by more than two bits well
    before that, so fingerprints of parts of the set find candidates too, and every link is
    verified on the whole sets.  A pair at 0.8 shares a part with a chance above 0.99; of all
    who share one, every pair is compared that other links do not connect already.
    Of a group stays the row of the smallest doc_id (null last), and among rows of one doc_id
    the one with the least hash of its content; of rows alike in id and text one stays.
    Texts without words form one group.  All columns pass through, whatever their names.
    """
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (f"c{names.index(c)}" for c in (doc_id, text))
    keyed = docs.withColumn("__row", F.xxhash64(F.col(doc_id), F.col(text)))
    own = stored(sketches(keyed.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id"), F.col("__row").alias("row")), words), "sketches")
    nodes = stored(own.groupBy("content").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")), "nodes")
    forget(own)
    shared = keys_of(nodes)
    # The sets of one row of each content that shares a key.
    wanted = nodes.join(shared.select(F.col("b").alias("content")).distinct(), "content").select(F.col("best.row").alias("__row"), "content")
    texts = keyed.select("__row", F.col(text).cast("string").alias("text")).join(wanted, "__row")
    sets = stored(shingle_sets(texts, words).dropDuplicates(["content"]), "sets")
    first = components(centre_links(shared, sets, similarity))
    top = components(member_links(shared, sets, first, similarity)).select(F.col("node").alias("first"), F.col("root").alias("top"))
    linked = nodes.select("content", "best").join(first, nodes.content == first.node, "left").select("best", F.coalesce("root", "content").alias("first")).join(top, "first", "left").groupBy(F.coalesce("top", "first").alias("root")).agg(F.min("best").alias("best"))
    best = stored(linked.select(F.col("best.row").alias("__row")), "best")
    forget(nodes, shared, sets)
    # The row key covers id and text: one shuffle of the texts serves the join and what follows.
    kept = keyed.join(best, "__row", "left_semi")
    # Rows alike in id and text share a row key; the rest are single already.
    return kept.dropDuplicates(["__row", doc_id]).drop("__row").toDF(*names)
