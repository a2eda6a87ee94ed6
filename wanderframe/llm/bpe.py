"""BPE encoding and decoding (operator 4): rank arrays merged for many short words at once."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import worker_cache

NONE = np.int32(1 << 30)
#: Words held in a worker's memory between batches.
KEPT_WORDS = 400_000


class WordBpe:
    """A byte-level BPE vocabulary with word ends, read from a tokenizers JSON file.

    A word is a row of a rank array: its parts' ids, and beside each part the rank of the
    merge with its right neighbour.  Each round scans every row for its least rank (the
    leftmost where equal), deletes that boundary and refreshes the two ranks beside it.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = [""] * (max(self.vocab.values()) + 1)
        for s, i in self.vocab.items():
            self.names[i] = s
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        key = left << 20 | right
        # A pair listed twice keeps its last rank, as a map filled in order would.
        order = np.argsort(key, kind="stable")
        last = np.append(key[order][1:] != key[order][:-1], True)
        self.pair, self.rank, self.made = key[order][last], order[last].astype(np.int32), made[order][last]
        chars = byte_letters()
        self.first = np.array([self.vocab[c] for c in chars], np.int32)
        self.last = np.array([self.vocab[c + self.end] for c in chars], np.int32)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str | int, str] = {}
        self.shown: dict[str | int, str] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], NONE), self.made[at]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words, given as bytes; rows of like length share a rank array."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            # Pad up to a quarter; a block holds at most about a million cells.
            least = max(1, int(sizes[order[at]]))
            most = max(4, least + least // 4)
            to = min(int(np.searchsorted(sizes[order], most, "right")), at + max(1, (1 << 20) // most))
            block = order[at:to]
            if most <= 400:
                for i, ids in zip(block.tolist(), self._block([words[i] for i in block], most), strict=True):
                    out[i] = ids
            else:
                for i in block.tolist():
                    out[i] = self._long(words[i])
            at = to
        return out

    def _block(self, words: list[bytes], width: int) -> list[list[int]]:
        n = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        ids = self.first[raw]
        rows = np.flatnonzero(n)
        ids[rows, n[rows] - 1] = self.last[raw[rows, n[rows] - 1]]
        rank = np.full((len(words), width), NONE, np.int32)
        r, _ = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        rank[:, :-1] = r.reshape(len(words), width - 1)
        rank[np.arange(width)[None, :] >= (n - 1)[:, None]] = NONE
        live, size = np.arange(len(words)), n.copy()
        final: list[list[int]] = [[]] * len(words)
        cols = np.arange(width)
        while len(live):
            j = rank.argmin(axis=1)
            row = np.arange(len(live))
            go = rank[row, j] < NONE
            if not go.all():
                for k in np.flatnonzero(~go).tolist():
                    final[live[k]] = ids[k, : size[k]].tolist()
                live, ids, rank, size, j = live[go], ids[go], rank[go], size[go], j[go]
                if not len(live):
                    break
                row = np.arange(len(live))
            _, new = self.ranks(ids[row, j], ids[row, j + 1])
            # Delete the boundary: what stands right of it moves one to the left.
            moved = cols[None, :] > j[:, None]
            ids = np.where(moved, np.roll(ids, -1, 1), ids)
            rank = np.where(cols[None, :] >= j[:, None], np.roll(rank, -1, 1), rank)
            rank[:, -1] = NONE
            ids[row, j] = new
            size = size - 1
            right = j < size - 1
            r, _ = self.ranks(new, ids[row, np.minimum(j + 1, ids.shape[1] - 1)])
            rank[row, j] = np.where(right, r, NONE)
            left = j > 0
            r, _ = self.ranks(ids[row, np.maximum(j - 1, 0)], new)
            rank[row[left], j[left] - 1] = r[left]
            most = int(size.max())
            if most < ids.shape[1] - 2:
                ids, rank, cols = ids[:, :most].copy(), rank[:, :most].copy(), cols[:most]
        return final

    def _long(self, word: bytes) -> list[int]:
        """One long word: the same merges, least rank first from a heap over linked parts."""
        import heapq

        raw = np.frombuffer(word, np.uint8)
        ids = self.first[raw].tolist()
        ids[-1] = int(self.last[raw[-1]])
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        r, m = self.ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        heap = [(int(a), i, ids[i], ids[i + 1], int(b)) for i, (a, b) in enumerate(zip(r, m, strict=True)) if a < NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n:
                    r, m = self.ranks(np.array([ids[p]]), np.array([ids[q]]))
                    if r[0] < NONE:
                        heapq.heappush(heap, (int(r[0]), p, ids[p], ids[q], int(m[0])))
        return [x for x in ids if x >= 0]

    def split(self, text: str) -> list[str | int]:
        """Words of the text, and the ids of special tokens that stand in it literally.

        White space only parts words, so the normalizer's folding of it changes nothing.
        """
        find = self.words.findall
        if "<" not in text or not self.specials:
            return find(normal(text))
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(text):
            out += find(normal(text[at : m.start()]))
            out.append(self.special[m[0]])
            at = m.end()
        return out + find(normal(text[at:]))

    def learn(self, words: set[str | int]) -> None:
        """Encode the words not known yet."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            self.shown.clear()
            new = words
        ids = [w for w in new if isinstance(w, int)]
        self.known.update((i, str(i)) for i in ids)
        self.shown.update((i, self.by_id[i]) for i in ids)
        new = list(new.difference(ids))
        for w, got in zip(new, self.merge([w.encode() for w in new]), strict=True):
            self.known[w], self.shown[w] = " ".join(map(str, got)), self.decode(got)

    def encode(self, text: str | None) -> list[int]:
        """The ids of one text."""
        return [int(x) for x in self.digest([text])[0][1].split()]

    def digest(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text: how many ids, the ids in decimal joined by one space, and their tokens so joined."""
        split = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        known, shown, out = self.known, self.shown, []
        for p in split:
            ids = " ".join([known[w] for w in p])
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join([shown[w] for w in p])))
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space: what a tokenizer without a decoder gives."""
        return " ".join([self.by_id.get(i) or self.names[i] for i in ids])


def normal(text: str) -> str:
    """NFC and lower case."""
    return text.lower() if text.isascii() else lower(unicodedata.normalize("NFC", text))


def lower(text: str) -> str:
    """Lower case by single characters: without the rule for a sigma at a word's end."""
    low = text.lower()
    return low if "ς" not in low and "Σ" not in text else "".join(c.lower() for c in text)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def load(path: str) -> WordBpe:
    """The vocabulary at ``path``, once per worker."""

    def make() -> WordBpe:
        with open(path, encoding="utf-8") as f:
            return WordBpe(json.load(f))

    return worker_cache(f"word_bpe:{path}", make)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``n_tokens``, ``token_ids`` (array of int) and ``decoded``.

    Whole texts are encoded without added special tokens; a null or empty text gives no
    ids and an empty ``decoded``.  A literal special token in a text becomes its own id, as
    in the tokenizers library.  Other columns pass through; those named as the three new
    columns are replaced.  Rows are independent: ties and repeated rows stay as they are.
    """
    keep = [f for f in docs.schema.fields if f.name not in ("n_tokens", "token_ids", "decoded")]
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for at, n in slices(b.column(b.schema.get_field_index(text))):
                part = b.slice(at, n)
                got = bpe.digest(part.column(part.schema.get_field_index(text)).to_pylist())
                ids = [[int(x) for x in s.split()] for _, s, _ in got]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(f.name)) for f in keep] + [pa.array([n for n, _, _ in got], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([t for _, _, t in got], pa.string())], names=schema.names)

    return docs.select(*[f.name for f in keep]).mapInArrow(run, schema)


def digest_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The same encoding as :func:`encode_documents`, reduced to digests inside the task so
    that ids never leave it.  Null or empty texts give the digests of the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = b.column(1)
            for at, n in slices(texts):
                got = bpe.digest(texts.slice(at, n).to_pylist())
                sha = [[hashlib.sha256(x.encode()).hexdigest() for x in column] for column in ([ids for _, ids, _ in got], [shown for _, _, shown in got])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array([k for k, _, _ in got], pa.int64()), pa.array(sha[0], pa.string()), pa.array(sha[1], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes of text: (first row, rows)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right"))
        to = max(at + 1, min(to, len(column)))
        yield at, to - at
        at = to
