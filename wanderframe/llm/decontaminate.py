"""Benchmark decontamination (operator 9): q-gram lemma filter, then banded alignment.

Items are cut into overlapping segments of SEGMENT bytes, one every STRIDE.  A segment within
``k`` edits of a stretch of text shares at least ``length + 1 - q * (k + 1)`` of its q-grams
with it, on diagonals at most ``k`` apart.  Shared q-grams are counted in overlapping bands
of diagonals, segment by segment; those that meet the bound are verified by an alignment
restricted to the band.

Q-grams are indexed once each by their place in the item, whatever number of segments covers
them.  A document's q-grams count only where enough of them stand close together, and
q-grams that very many items have are expanded slice by slice, so that memory is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, work_dir, worker_cache
from .flatfiles import filesystem

Q = 12
SEGMENT, STRIDE = 96, 8
#: One edit is allowed for so many bytes of a segment, where the lemma still promises a q-gram.
BYTES_PER_EDIT = 16
#: Bytes of benchmark text in an index; a larger benchmark is read in several blocks.
BLOCK_BYTES = 8 << 20
#: Pairs of places with one q-gram that are held at once.
PAIRS = 1 << 21
NOT_WORD = re.compile(r"[\W_]+")
BITS = 22
#: Places take so many bits: a block's bytes and the gaps between items.
PLACE = np.int64(28)


def normal(text: bytes) -> bytes:
    """Lower case, with one space for whatever parts the words."""
    return NOT_WORD.sub(" ", text.decode("utf-8", "replace").lower()).strip().encode()


def qgrams(a: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes at each position."""
    n = len(a) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = a.astype(np.uint64)
    x[:-1] |= x[1:] << np.uint64(8)
    four = x.copy()
    four[:-2] |= x[2:] << np.uint64(16)
    four &= np.uint64(0xFFFFFFFF)
    h = four[:n] | four[4 : n + 4] << np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += four[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def edits_allowed(size: int) -> int:
    """The edits allowed in a segment of ``size`` bytes: one for BYTES_PER_EDIT, but no more
    than leave the lemma one q-gram that must be shared."""
    return max(0, min(size // BYTES_PER_EDIT, size // Q - 1))


class Index:
    """Normalised benchmark items and the places of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]]):
        """Items with one normalised text are a class, named by its least item id."""
        self.short: dict[bytes, int] = {}
        whole: dict[bytes, int] = {}
        for item, raw in sorted(items):
            text = normal(raw)
            if text:
                (self.short if len(text) < Q else whole).setdefault(text, item)
        self.texts, self.ids = list(whole), list(whole.values())
        size = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        # Places are counted through all items, with gaps that no segment bridges.
        self.base = np.cumsum(size + SEGMENT) - size - SEGMENT
        self.size = size
        self.length = np.minimum(size, SEGMENT)
        self.budget = np.array([edits_allowed(n) for n in self.length.tolist()], np.int64)
        self.need = self.length + 1 - Q * (self.budget + 1)
        grams = [qgrams(np.frombuffer(t, np.uint8)) for t in self.texts]
        key = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        place = np.concatenate([b + np.arange(len(g)) for b, g in zip(self.base.tolist(), grams, strict=True)]) if grams else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.place = place[order]
        self.key, self.first, self.many = np.unique(key[order], return_index=True, return_counts=True)
        # The least that any item with the q-gram asks for.
        need = self.need[np.searchsorted(self.base, self.place, "right") - 1]
        self.least = np.minimum.reduceat(need, self.first) if len(need) else need
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[(self.key >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def shared(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text position, number of the q-gram) of the q-grams of ``a`` that some item has,
        where enough of them stand close together for any segment."""
        h = qgrams(a)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.key, h[at]), max(0, len(self.key) - 1))
        ok = self.key[where] == h[at] if len(self.key) else np.zeros(0, bool)
        at, where = at[ok], where[ok]
        most = SEGMENT + 1 - Q * (edits_allowed(SEGMENT) + 1)
        # A segment's shared q-grams lie within its length and its edits.
        end = np.searchsorted(at, at + SEGMENT - Q + edits_allowed(SEGMENT), "right")
        full = np.flatnonzero(end - np.arange(len(at)) >= most)
        step = np.zeros(len(at) + 1, np.int64)
        np.add.at(step, full, 1)
        np.add.at(step, end[full], -1)
        keep = (np.cumsum(step)[:-1] > 0) | (self.least[where] < most)
        return at[keep], where[keep]

    def candidates(self, at: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Rows (item, segment start, lowest diagonal, highest) of the segments that meet the bound."""
        many = self.many[where]
        place = self.place[np.repeat(self.first[where] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        at = np.repeat(at, many)
        item = np.searchsorted(self.base, place, "right") - 1
        shift = int(self.base[-1] + self.size[-1]) + 2 * SEGMENT
        diagonal, width = at - place + shift, self.budget[item] + 1
        found = []
        for half in (0, 1):
            # Bands are 2k + 2 wide and begin every 2k + 2; those of the other half lie between.
            band = (diagonal + half * width) // (2 * width)
            key = np.unique(band << PLACE | place)
            band, p = key >> PLACE, key & ((1 << 28) - 1)
            i = np.searchsorted(self.base, p, "right") - 1
            reach = self.length[i] - Q
            full = np.searchsorted(key, key + reach, "right") - np.arange(len(key)) >= self.need[i]
            # The segments in which a place is the first that is shared.
            inside, last = p - self.base[i], self.size[i] - self.length[i]
            before = np.append(-1, np.where(band[1:] == band[:-1], p[:-1], -1)) - self.base[i]
            low = np.maximum(np.maximum(before + 1, inside - reach), 0)
            first, stop = -(-low // STRIDE), np.minimum(inside, last) // STRIDE
            n = np.where(full, np.maximum(stop - first + 1, 0), 0)
            start = STRIDE * (np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()))
            own = np.repeat(np.arange(len(key)), n)
            tail = np.flatnonzero(full & (low <= last) & (last <= inside) & (last % STRIDE > 0))
            start, own = np.append(start, last[tail]), np.append(own, tail)
            begin = band[own] << PLACE | (self.base[i[own]] + start)
            count = np.searchsorted(key, begin + reach[own], "right") - np.searchsorted(key, begin)
            ok = count >= self.need[i[own]]
            own, start = own[ok], start[ok]
            w = self.budget[i[own]] + 1
            lowest = band[own] * 2 * w - half * w - shift + self.base[i[own]]
            found.append(np.stack([i[own], start, lowest, lowest + 2 * w - 1], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def slices(self, at: np.ndarray, where: np.ndarray) -> Iterator[slice]:
        """Slices of the shared q-grams of about PAIRS pairs each, that overlap by a segment."""
        total = np.cumsum(self.many[where])
        reach = SEGMENT + edits_allowed(SEGMENT)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
            yield slice(int(np.searchsorted(at, at[i] - reach)), j)
            i = j

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, matching segments, least edits) of every contaminated pair."""
        clean = [normal(t) for t in texts]
        if self.short:
            for i, t in enumerate(clean):
                padded = b" " + t + b" "
                for s, item in self.short.items():
                    if b" " + s + b" " in padded:
                        yield i, item, 1, 0
        if not self.texts:
            return
        gap = 2 * (Q + SEGMENT)  # diagonals of two texts never meet in a band
        joined = b"".join(t + b"\0" * gap for t in clean)
        starts = np.cumsum([0] + [len(t) + gap for t in clean])
        at, where = self.shared(np.frombuffer(joined, np.uint8))
        found: dict[tuple[int, int], dict[int, int]] = {}
        for cut in self.slices(at, where):
            for i, s, low, high in self.candidates(at[cut], where[cut]).tolist():
                # The middle of the segment, which lies in the text or in the gap beside it.
                text = int(np.searchsorted(starts, max(s + (low + high) // 2 + SEGMENT // 2, 0), "right")) - 1
                if text >= len(clean):
                    continue
                offset, k = int(starts[text]), int(self.budget[i])
                d = banded(self.texts[i][s : s + SEGMENT], clean[text], low + s - offset, high + s - offset, k)
                if d is not None:
                    segments = found.setdefault((text, self.ids[i]), {})
                    segments[s] = min(d, segments.get(s, d))
        for (text, item), segments in found.items():
            yield text, item, len(segments), min(segments.values())


def banded(a: bytes, t: bytes, low: int, high: int, k: int) -> int | None:
    """The least edits, at most ``k``, that turn ``a`` into a stretch of ``t`` starting on the
    diagonals low to high; the band is ``k`` wider on both sides."""
    low, high = low - k, high + k
    if a in t[max(0, low) : max(0, high + len(a))]:
        return 0
    if k == 0:
        return None
    far, width = k + 1, high - low + 1
    row = [0 if 0 <= low + c <= len(t) else far for c in range(width)]
    for i, x in enumerate(a):
        new, left = [far] * width, far
        for c in range(width):
            j = i + 1 + low + c  # end in t
            if not 0 <= j <= len(t):
                left = far
                continue
            best = row[c] + (j < 1 or t[j - 1] != x) if j >= 1 else far
            if c + 1 < width and row[c + 1] + 1 < best:
                best = row[c + 1] + 1
            if left + 1 < best:
                best = left + 1
            new[c] = left = min(best, far)
        row = new
        if min(row) > k:
            return None
    return min(row) if min(row) <= k else None


def blocks_of(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> list[str]:
    """Folders below the shared one with the benchmark's items, each of about BLOCK_BYTES.

    The items go from task to task through these; none comes to the driver."""
    bench = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    folder = work_dir(benchmark.sparkSession, "benchmark")
    bench.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).repartitionById(n, "block").write.partitionBy("block").parquet(folder)
    where, at = filesystem(folder)
    from pyarrow import fs

    names = sorted(x.base_name for x in where.get_file_info(fs.FileSelector(at)) if x.base_name.startswith("block="))
    return [f"{folder}/{x}" for x in names]


def index_of(folder: str) -> Index:
    """The index of one block of the benchmark, once per worker, which holds one at a time."""

    def make() -> Index:
        import pyarrow.parquet as pq

        where, at = filesystem(folder)
        from pyarrow import fs

        items = []
        for f in sorted(x.path for x in where.get_file_info(fs.FileSelector(at)) if x.path.endswith(".parquet")):
            with where.open_input_file(f) as source:
                t = pq.ParquetFile(source).read(["item_id", "text"])
            items += zip(t.column(0).to_pylist(), (x.encode() for x in t.column(1).to_pylist()), strict=True)
        return Index([(-1 if i is None else i, x) for i, x in items])

    return worker_cache(f"benchmark:{folder}", make, alone="benchmark:")


def benchmark_classes(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, class_id): items whose normalised texts are equal form a class, which
    results name by its least item id (null ids as -1).  Items without a word have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([normal((x or "").encode()) for x in b.column(1).to_pylist()], pa.binary())], names=["item_id", "norm"])

    plain = benchmark.select(F.coalesce(F.col(item_id).cast("long"), F.lit(-1)).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    keyed = plain.mapInArrow(run, "item_id long, norm binary").where("octet_length(norm) > 0")
    return keyed.join(keyed.groupBy("norm").agg(F.min("item_id").alias("class_id")), "norm").select("item_id", "class_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, carry: list[str], doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of documents and benchmark items that they hold, within the edit budget.

    Returns the columns ``carry`` of the document, then ``item_id`` (long), ``n_segments``
    (segments of the item found) and ``edits`` (least of any).  Texts are compared in lower
    case with one space between words; an item of under Q bytes so must stand in the text as
    whole words.  An item is found by any of its segments of SEGMENT bytes (the whole item if
    it is shorter), so every excerpt of SEGMENT + STRIDE - 1 bytes is.  Items that are alike
    are one, named by the least id (:func:`benchmark_classes` has the members); null or empty
    texts and items match nothing; repeated documents give a row each.  A column of ``carry``
    named as one of the three new ones has to be renamed before.  Each task reads the
    benchmark from the shared folder, block by block: its size is bounded there, and a larger
    benchmark costs a scan of the documents for each block.
    """
    fields = [docs.schema[c] for c in carry]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["item_id long", "n_segments long", "edits long"])
    plain = docs.select(F.col(doc_text).cast("string").alias("__text"), *carry)
    out = docs.sparkSession.createDataFrame([], schema)
    for folder in blocks_of(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], folder=folder) -> Iterator[pa.RecordBatch]:
            index = index_of(folder)
            for batch in batches:
                for start, texts in pieces(batch.column(0)):
                    rows = list(index.search(texts))
                    take = pa.array([start + r[0] for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(i + 1).take(take) for i in range(len(carry))] + [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)], names=[*carry, "item_id", "n_segments", "edits"])

        out = out.unionByName(plain.mapInArrow(run, schema))
    return out


def flag_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", flag: str = "contaminated") -> DataFrame:
    """``docs`` with a boolean ``flag``, row by row and without a shuffle; a column of that
    name is replaced.  What counts as found is as in :func:`contaminated`."""
    out = docs.withColumn(flag, F.lit(False))
    at, place = out.columns.index(flag), out.columns.index(text)
    for folder in blocks_of(benchmark):

        def run(batches: Iterator[pa.RecordBatch], folder=folder) -> Iterator[pa.RecordBatch]:
            index = index_of(folder)
            for batch in batches:
                bad = batch.column(at).to_numpy(zero_copy_only=False).copy()
                for start, texts in pieces(batch.column(place)):
                    for i, *_ in index.search(texts):
                        bad[start + i] = True
                yield batch.set_column(at, batch.schema.field(at), pa.array(bad))

        out = out.mapInArrow(run, out.schema)
    return out
