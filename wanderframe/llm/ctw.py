"""LM scoring (operator 10): context-tree weighting over bytes, beside a word-count base.

Bytes are decomposed into eight binary decisions.  Every context of up to DEPTH bytes has,
for each prefix of decisions, a Krichevsky-Trofimov estimate from its counts; a node's
probability is the even mixture of its own estimate and the product of its children's, so
that all depths are weighted by what they have earned in training.  The trained tree is
frozen and gives the code length of each byte.

No context is pruned or pooled, so the tree grows with the corpus; it never stands in one
place.  Contexts are dealt by a hash of their nearest SPLIT bytes, which have at most
256 ** (depth - SPLIT) contexts below them at any size of corpus: a bucket has whole
subtrees.  What is left above, contexts of fewer bytes, is bounded likewise, is summed by an
aggregation and goes to every task.  The values of the most frequent cells (context and
byte), at most 2 ** CACHE_BITS, go to every task too; a position whose cell is not among
them sends it to the bucket that has its subtree, and its value comes back as a part of the
document's sum.  The cache saves shuffling and changes no value.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, forget, pieces, stored

DEPTH = 5
#: Contexts that share their nearest bytes, so many, lie in one bucket.
SPLIT = 3
CACHE_BITS = 21
#: Words counted beside the shuffle; which ones does not change any result.
HEAD = 16384
SAMPLE = 16
END = b"\0"


def cells_of(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all predictions of the texts, and how many each text has.

    A text is read behind ``depth`` zero bytes and ends with one.  A key holds the last byte
    highest, then the bytes before it, and the predicted byte lowest."""
    a, starts, ends = flat([t + END for t in texts], bytes(depth))
    x = a.astype(np.int64)
    key = x.copy()
    for back in range(1, depth + 1):
        key[back:] |= x[:-back] << (8 * (depth + 1 - back))
    inside = np.ones(len(x), bool)
    for d in range(1, depth + 1):
        inside[starts - d] = False
    return key[inside], ends - starts


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of ``n`` over each."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def bucket_of(key: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """The bucket of each key, by a hash of the nearest bytes of its context."""
    near = (key >> (8 * (depth - min(SPLIT, depth)) + 8)).astype(np.uint64)
    near = (near + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    near ^= near >> np.uint64(29)
    return (near * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % parts


def train(docs: DataFrame, depth: int = DEPTH, parts: int | None = None) -> DataFrame:
    """(bucket, keys, counts, sizes): how often each byte follows each context of ``depth``
    bytes in ``text``, a row per bucket: sorted keys and counts packed, and how many of the
    counts have each number of bits."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([k for k, _ in kept]), np.concatenate([n for _, n in kept]))

        def out() -> Iterator[pa.RecordBatch]:
            key, n = folded()
            bucket = bucket_of(key, depth, parts)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                at = order[cut[p] : cut[p + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed(key[at])]), pa.array([n[at].astype("<u8").tobytes()])], names=["bucket", "keys", "counts"])

        for b in batches:
            for _, texts in pieces(b.column(0)):
                key = np.sort(cells_of(texts, depth)[0])
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                kept.append((key[first], np.diff(np.append(first, len(key)))))
                size += len(first)
                if size > 6_000_000:
                    kept[:] = [folded()]
                    size = len(kept[0][0])
                    if size > 3_000_000:
                        yield from out()
                        kept, size = [], 0
        if kept:
            yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for b in batches:
            for p, k, n in zip(*(b.column(c) for c in range(3)), strict=True):
                own = kept.setdefault(p.as_py(), [])
                own.append((unpacked(k.as_py()), np.frombuffer(n.as_py(), "<u8").astype(np.int64)))
                size += len(own[-1][0])
                if size > 8_000_000:
                    own[:] = [summed(np.concatenate([k for k, _ in own]), np.concatenate([n for _, n in own]))]
                    size = 0
        for p in sorted(kept):
            own = kept.pop(p)
            key, n = summed(np.concatenate([k for k, _ in own]), np.concatenate([n for _, n in own]))
            sizes = np.bincount(np.floor(np.log2(n)).astype(np.int64), minlength=64)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed(key)]), pa.array([n.astype("<u8").tobytes()]), pa.array([sizes.tolist()], pa.list_(pa.int64()))], names=["bucket", "keys", "counts", "sizes"])

    dealt = docs.select("text").mapInArrow(count, "bucket int, keys binary, counts binary").repartitionById(parts, "bucket")
    return dealt.mapInArrow(merge, "bucket int, keys binary, counts binary, sizes array<bigint>")


def packed(key: np.ndarray) -> bytes:
    """Sorted keys as differences, in bytes by significance, so that the shuffle compresses them."""
    return np.diff(key, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x >= 0.5."""
    shift = np.where(x < 16, 16.0, 0.0)
    y = x + shift
    out = (y - 0.5) * np.log(y) - y + 0.91893853320467274178 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    small = np.flatnonzero(shift)
    if len(small):
        z = x[small]
        product = np.zeros(len(small))
        for k in range(16):
            product += np.log(z + k)
        out[small] -= product
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Tree:
    """Nodes of the frozen tree by depth: sorted keys, counts, and the weight of their own
    estimate.  A bucket's tree has no nodes above SPLIT bytes until :meth:`under` lends it
    those of the top."""

    def __init__(self, depth: int):
        self.depth = depth
        self.nodes = [np.zeros(0, np.int64)] * (depth + 1)
        self.counts = [np.zeros((0, 2))] * (depth + 1)
        self.own = [np.zeros(0)] * (depth + 1)
        self.weighted = np.zeros(0)

    def grow(self, d: int, node: np.ndarray, counts: np.ndarray, below: np.ndarray | None = None) -> None:
        """Add the level ``d``; ``below`` sums the children's log probabilities (None: leaves)."""
        own = log_kt(*counts.T)
        mixed = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.nodes[d], self.counts[d], self.weighted = node, counts, mixed
        self.own[d] = np.ones(len(own)) if below is None else np.exp(own - np.log(2) - mixed)

    def parents(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The level above ``d``, which was grown last: nodes, counts and ``below``."""
        child = self.nodes[d]
        node, at = np.unique((child >> 16) << 8 | child & 255, return_inverse=True)
        counts = np.stack([np.bincount(at, self.counts[d][:, v], len(node)) for v in (0, 1)], axis=1)
        return node, counts, np.bincount(at, self.weighted, len(node))

    @classmethod
    def bucket(cls, key: np.ndarray, n: np.ndarray, depth: int) -> Tree:
        """The subtrees of sorted keys and their counts."""
        tree = cls(depth)
        ctx, sym = key >> 8, key & 255
        node = np.concatenate([ctx << 8 | (1 << j) | sym >> (8 - j) for j in range(8)])
        bit = np.concatenate([sym >> (7 - j) & 1 for j in range(8)])
        node, at = np.unique(node, return_inverse=True)
        tree.grow(depth, node, np.stack([np.bincount(at, np.tile(n, 8) * (bit == v), len(node)) for v in (0, 1)], axis=1))
        for d in range(depth - 1, min(SPLIT, depth) - 1, -1):
            tree.grow(d, *tree.parents(d + 1))
        return tree

    @classmethod
    def top(cls, node: np.ndarray, counts: np.ndarray, below: np.ndarray, depth: int) -> Tree:
        """The levels above the buckets, from the sums of what all of them pass up."""
        tree = cls(depth)
        d = min(SPLIT, depth) - 1
        tree.grow(d, node, counts, below)
        for d in range(d - 1, -1, -1):
            tree.grow(d, *tree.parents(d + 1))
        return tree

    def under(self, top: Tree) -> Tree:
        for d in range(min(SPLIT, self.depth)):
            self.nodes[d], self.counts[d], self.own[d] = top.nodes[d], top.counts[d], top.own[d]
        return self

    def evaluate(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of the byte of each key behind its context."""
        sym = key & 255
        total = np.zeros(len(key))
        for j in range(8):
            bit = sym >> (7 - j) & 1
            p = np.full(len(key), 0.5)
            known = np.zeros(len(key), bool)  # p holds a child's estimate
            for d in range(self.depth, -1, -1):
                node = (key >> (8 * (self.depth - d) + 8)) << 8 | (1 << j) | sym >> (8 - j)
                at, here = contains(self.nodes[d], node)
                at = at[here]
                n = self.counts[d][at]
                kt = (n[np.arange(len(n)), bit[here]] + 0.5) / (n.sum(axis=1) + 1)
                own = np.where(known[here], self.own[d][at], 1.0)
                p[here] = own * kt + (1 - own) * p[here]
                known[here] = True
            total += np.log10(p)
        return total

    def values(self, key: np.ndarray) -> np.ndarray:
        """As :meth:`evaluate`, in slices."""
        return np.concatenate([self.evaluate(key[i : i + 200_000]) for i in range(0, len(key), 200_000)] or [np.zeros(0)])


class Cache:
    """Values of frequent cells: one probe without chains, then a search in the sorted keys."""

    def __init__(self, key: np.ndarray, value: np.ndarray, n: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order].astype(np.float32)
        self.bits = max(4, len(key).bit_length() + 1)
        # Where cells collide the more frequent stays.
        often = np.argsort(n[order], kind="stable")
        slot = self.slot(self.key[often])
        self.table, self.score = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        self.table[slot], self.score[slot] = self.key[often], self.value[often]

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def lookup(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys (0 where it has none), and the places of those it does not have."""
        slot = self.slot(key)
        out = self.score[slot].astype(np.float64)
        miss = np.flatnonzero(self.table[slot] != key)
        at, here = contains(self.key, key[miss])
        out[miss] = 0
        out[miss[here]] = self.value[at[here]]
        return out, miss[~here]


def contains(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would stand in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


def pass_up(counts: DataFrame, depth: int) -> DataFrame:
    """(node, n0, n1, below) of the buckets' subtrees for the level above them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in zip(b.column(0), b.column(1), strict=True):
                tree = Tree.bucket(unpacked(k.as_py()), np.frombuffer(n.as_py(), "<u8").astype(np.int64), depth)
                node, both, below = tree.parents(min(SPLIT, depth))
                yield pa.RecordBatch.from_arrays([pa.array(node), *(pa.array(both[:, v].astype(np.int64)) for v in (0, 1)), pa.array(below)], names=["node", "n0", "n1", "below"])

    return counts.select("keys", "counts").mapInArrow(run, "node long, n0 long, n1 long, below double")


def crown(counts: DataFrame, depth: int) -> Tree:
    """The top of the tree: contexts of fewer than SPLIT bytes, of which there are at most
    65,793 at any size of corpus."""
    sums = pass_up(counts, depth).groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))
    got = sums.toArrow().sort_by("node").combine_chunks()
    node, n0, n1, below = (got.column(i).to_numpy() for i in range(4))
    return Tree.top(node.astype(np.int64), np.stack([n0, n1], axis=1).astype(np.float64), below.astype(np.float64), depth)


def frequent(counts: DataFrame, top, depth: int, cache_bits: int) -> Cache:
    """The values of the most frequent cells: all that occur at least 2 ** x times, for the
    least x that leaves no more than 2 ** cache_bits of them."""
    sizes = counts.select(F.posexplode("sizes").alias("x", "n")).groupBy("x").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("x")).collect()
    least, held = 64, 0
    for r in sizes:
        if held + r.n > 1 << cache_bits:
            break
        least, held = r.x, held + r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in zip(b.column(0), b.column(1), strict=True):
                key, n = unpacked(k.as_py()), np.frombuffer(n.as_py(), "<u8").astype(np.int64)
                often = n >> least > 0
                value = Tree.bucket(key, n, depth).under(top.value).values(key[often])
                yield pa.RecordBatch.from_arrays([pa.array(key[often]), pa.array(value.astype(np.float32)), pa.array(n[often])], names=["key", "value", "n"])

    if least > 62:
        return Cache(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    got = counts.select("keys", "counts").mapInArrow(run, "key long, value float, n long").toArrow()
    return Cache(*(got.column(i).to_numpy() for i in range(3)))


def missed_sums(counts: DataFrame, missed: DataFrame, top, depth: int, parts: int) -> DataFrame:
    """(bucket, row, s, k, c, v) as :func:`tail_sums` packs them, with c the sums of the cells
    that were sent to the buckets' subtrees."""
    trees = counts.select("bucket", F.lit(0).alias("kind"), F.col("keys").alias("a"), F.col("counts").alias("b"), F.lit(b"").alias("n"))
    cells = missed.select("bucket", F.lit(1).alias("kind"), "a", "b", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(depth).under(top.value)
        for batch in batches:
            for kind, a, b, n in zip(*(batch.column(c) for c in range(1, 5)), strict=True):
                if kind.as_py() == 0:
                    tree = Tree.bucket(unpacked(a.as_py()), np.frombuffer(b.as_py(), "<u8").astype(np.int64), depth).under(top.value)
                    continue
                key, row, n = np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64), np.frombuffer(n.as_py(), np.uint32)
                each, at = np.unique(key, return_inverse=True)
                rows, of = np.unique(row, return_inverse=True)
                yield from dealt_sums(rows, None, None, np.bincount(of, tree.values(each)[at] * n), 0, parts)

    both = trees.unionByName(cells).repartitionById(parts, "bucket").sortWithinPartitions("kind")
    return both.mapInArrow(run, SUMS)


#: Sums of rows on their way: by the rows' own buckets, packed.
SUMS = "bucket int, row binary, s binary, k binary, c binary, v long"


def dealt_sums(rows: np.ndarray, s: np.ndarray | None, k: np.ndarray | None, c: np.ndarray | None, known: int, parts: int) -> Iterator[pa.RecordBatch]:
    bucket = (rows.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(parts + 1))
    kinds = ((s, np.float64), (k, np.uint32), (c, np.float64))
    for p in range(parts):
        at = order[cut[p] : cut[p + 1]]
        if len(at) or (p == 0 and known):
            packed_ = [rows[at].tobytes(), *((np.zeros(len(at), kind) if x is None else x[at]).tobytes() for x, kind in kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x]) for x in packed_), pa.array([known if p == 0 else 0], pa.int64())], names=["bucket", "row", "s", "k", "c", "v"])


def is_held_out(doc_id: int | None, fold: int = 1, folds: int = 5) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def word_parts(docs: DataFrame, head: dict[bytes, int], parts: int) -> DataFrame:
    """Word counts by bucket of the word's hash: columns of (hash, row, n, trained) as bytes.

    Bucket -1 holds the training counts of the head words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.zeros(len(head), np.int64)
        names = ["bucket", "h", "row", "n", "trained"]
        for b in batches:
            held, rows = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            for start, texts in pieces(b.column(0), 8 << 20):
                ids = dict(head)
                of, which = [], []
                for i, t in enumerate(texts):
                    w = t.lower().split()
                    which += [ids.setdefault(x, len(ids)) for x in w]
                    of.append(len(w))
                doc = np.repeat(np.arange(len(texts)), of)
                pair = doc.astype(np.int64) << 32 | np.array(which, np.int64)
                pair.sort()
                first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(pair)))
                doc, word = pair[first] >> 32, pair[first] & 0xFFFFFFFF
                trained = ~held[start + doc]
                front = word < len(head)
                common += np.bincount(word[front & trained], n[front & trained], minlength=len(head)).astype(np.int64)
                doc, word, n, trained = doc[~front], word[~front], n[~front], trained[~front]
                h = np.fromiter((xxhash.xxh64_intdigest(w) for w in list(ids)[len(head) :]), np.uint64, len(ids) - len(head))[word - len(head)]
                bucket = (h >> np.uint64(32)).astype(np.int64) % parts
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(parts + 1))
                for p in range(parts):
                    at = order[cut[p] : cut[p + 1]]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x.tobytes()]) for x in (h[at], rows[start + doc[at]], n[at].astype(np.uint32), trained[at]))], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""]), pa.array([b""]), pa.array([common.tobytes()]), pa.array([b""])], names=names)

    return docs.select("text", "held_out", "row").mapInArrow(run, "bucket int, h binary, row binary, n binary, trained binary")


def tail_sums(blobs: DataFrame, parts: int) -> DataFrame:
    """SUMS over the words of the buckets: log10(c + 0.5) and the known tokens of each row,
    and ``v``, the number of known words of the bucket.

    A bucket has a sum for most rows, so the sums travel packed by the rows' own buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], [], []]
        for b in batches:
            for i, kind in enumerate((np.uint64, np.int64, np.uint32, bool)):
                got[i] += [np.frombuffer(x.as_py(), kind) for x in b.column(i + 1)]
        if not got[0]:
            return
        h, row, n, trained = (np.concatenate(x) for x in got)
        got.clear()
        _, at = np.unique(h, return_inverse=True)
        c = np.bincount(at, n * trained)
        each = c[at]
        rows, of = np.unique(row, return_inverse=True)
        s = np.bincount(of, n * np.log10(each + 0.5))
        k = np.bincount(of, n * (each > 0)).astype(np.uint32)
        yield from dealt_sums(rows, s, k, None, int((c > 0).sum()), parts)

    return blobs.where("bucket >= 0").repartitionById(parts, "bucket").mapInArrow(count, SUMS)


def row_sums(sums: DataFrame, parts: int) -> DataFrame:
    """(row, ts, tk, cs): the sums of SUMS for each row."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], [], []]
        for b in batches:
            for i, kind in enumerate((np.int64, np.float64, np.uint32, np.float64)):
                got[i] += [np.frombuffer(x.as_py(), kind) for x in b.column(i + 1)]
        if not got[0]:
            return
        row, s, k, c = (np.concatenate(x) for x in got)
        rows, of = np.unique(row, return_inverse=True)
        for at in range(0, len(rows), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(rows[cut]), pa.array(np.bincount(of, s)[cut]), pa.array(np.bincount(of, k).astype(np.int64)[cut]), pa.array(np.bincount(of, c)[cut])], names=["row", "ts", "tk", "cs"])

    return sums.repartitionById(parts, "bucket").mapInArrow(merge, "row long, ts double, tk long, cs double")


def head_words(docs: DataFrame) -> list[bytes]:
    """The most frequent words of a sixteenth of the rows: they are counted apart from the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for b in batches:
            c: Counter = Counter()
            for _, texts in pieces(b.column(0)):
                for t in texts:
                    c.update(t.lower().split())
            top = c.most_common(HEAD)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["w", "n"])

    found = docs.where(F.pmod("row", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "w binary, n long")
    return [bytes(r.w) for r in found.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(HEAD).collect()]


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, cache_bits: int = CACHE_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte``.

    Both models learn from the rows whose crc32 of the decimal doc_id is not 1 modulo 5.
    ``base_score`` is the smoothed unigram sum over lower-cased words and one end;
    ``score`` the context tree's log10 probability of the bytes and an end byte, and
    ``bits_per_byte`` its code length over n_bytes + 1.  ``depth`` may be 1 to 6 bytes;
    ``cache_bits`` bounds what is broadcast and changes no result.  Null texts are as empty:
    an end alone.  A null doc_id counts as the text 'None'.  Repeated rows count as often as
    they stand; other columns are not read, whatever their names.  With nothing to learn
    from, base_score is 0 and every bit costs one bit.
    """
    if not 1 <= depth <= 6:
        raise ValueError("a cell of a context and its byte must fit in 56 bits: depth is 1 to 6")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary")) % 5 == 1).alias("held_out"))
    words = head_words(rows)
    head = {w: i for i, w in enumerate(words)}
    blobs = stored(word_parts(rows, head, parts), "words")
    common = np.zeros(len(head), np.int64)
    for r in blobs.where("bucket < 0").select("n").toLocalIterator():
        common += np.frombuffer(r.n, np.int64)
    tail = stored(tail_sums(blobs, parts), "tail")
    forget(blobs)
    counts = stored(train(rows.where("NOT held_out"), depth, parts), "counts")
    top = spark.sparkContext.broadcast(crown(counts, depth))
    logs = {w: (float(np.log10(c + 0.5)), int(c > 0)) for w, c in zip(words, common.tolist(), strict=True)}
    shared = spark.sparkContext.broadcast((frequent(counts, top, depth, cache_bits), logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A record of each document, and records of cells for the buckets."""
        cache, front = shared.value
        nothing = (0.0, 0)
        cells = ["bucket", "a", "b", "n"]
        own = ["doc_id", "row", "held_out", "n_tokens", "s", "k", "score", "n_bytes"]
        kinds = dict(zip([*cells, *own], [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()], strict=True))

        def record(got: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([got.get(c, pa.nulls(n, kind)) for c, kind in kinds.items()], names=list(kinds))

        open_: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            key, row, n = (np.concatenate(x) for x in zip(*open_, strict=True))
            bucket = bucket_of(key, depth, parts)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                at = order[cut[p] : cut[p + 1]]
                yield record({"bucket": pa.array([p], pa.int32()), "a": pa.array([key[at].tobytes()]), "b": pa.array([row[at].tobytes()]), "n": pa.array([n[at].astype(np.uint32).tobytes()])}, 1)

        for b in batches:
            n_tokens, s, k, score, n_bytes = [], [], [], [], []
            ids = b.column(1).to_numpy()
            for start, texts in pieces(b.column(3)):
                for t in texts:
                    w = t.lower().split()
                    got = [front.get(x, nothing) for x in w]
                    n_tokens.append(len(w) + 1)
                    s.append(sum([x for x, _ in got]))
                    k.append(sum([x for _, x in got]))
                    n_bytes.append(len(t))
                key, n = cells_of(texts, depth)
                value, miss = cache.lookup(key)
                first = np.cumsum(n) - n
                score += np.add.reduceat(value, first).tolist()
                if len(miss):
                    # Each cell of a document once, with how often it stands there.
                    of = np.searchsorted(first, miss, "right") - 1
                    order = np.lexsort((key[miss], of))
                    of, cell = of[order], key[miss][order]
                    new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (cell[1:] != cell[:-1])))
                    open_.append((cell[new], ids[start + of[new]], np.diff(np.append(new, len(cell)))))
                    size += len(new)
                    if size > 1_000_000:
                        yield from sent()
                        open_, size = [], 0
            yield record({"doc_id": b.column(0), "row": b.column(1), "held_out": b.column(2), "n_tokens": pa.array(n_tokens, pa.int64()), "s": pa.array(s, pa.float64()), "k": pa.array(k, pa.int64()), "score": pa.array(score, pa.float64()), "n_bytes": pa.array(n_bytes, pa.int64())}, b.num_rows)
        if open_:
            yield from sent()

    scored = rows.select("doc_id", "row", "held_out", "text").mapInArrow(run, "bucket int, a binary, b binary, n binary, doc_id long, row long, held_out boolean, n_tokens long, s double, k long, score double, n_bytes long")
    scored = stored(scored, "scored")
    own = scored.where("bucket IS NULL")
    ends, tokens = own.where("NOT held_out").agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    known_words = (tail.agg(F.sum("v")).first()[0] or 0) + int((common > 0).sum()) + (ends > 0)
    below = float(np.log10(tokens + 0.5 * (known_words + 1)))
    end_log = float(np.log10(ends + 0.5))
    rest = row_sums(tail.unionByName(missed_sums(counts, scored.where("bucket IS NOT NULL"), top, depth, parts)), parts)
    # Rows that are alike sent their words and cells twice: their sums are shared out again.
    many = own.groupBy("row").agg(F.count("*").alias("many"))
    full = own.join(many.join(rest, "row", "left"), "row", "left")
    score = F.col("score") + F.coalesce(F.col("cs") / F.col("many"), F.lit(0.0))
    return full.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("k") + F.coalesce(F.expr("tk div many"), F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("s") + F.coalesce(F.col("ts") / F.col("many"), F.lit(0.0)) + end_log - F.col("n_tokens") * below).alias("base_score"),
        score.alias("score"),
        (-score / float(np.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
