"""Flat token files: writing them, and counting tokens by a separator scan (operator 8).

A flat file is a run of little-endian unsigned 16-bit ids in which every document ends with
the end-of-document id; nothing else says where documents lie.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, worker_cache

#: Ids in a block of the scan; blocks are read by byte range, each by whatever task has it.
BLOCK = 1 << 22
#: A writer starts a new file beyond so many ids.
FILE_IDS = 1 << 24
#: Separators in a record between the two passes of the scan.
CHUNK = 100_000
#: Runs of white space that the encoder's pattern would have to step back over.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4000,}")


def encoder(path: str, pattern: str):
    """The rank file at ``path`` as a tiktoken encoding, once per worker."""

    def make():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return worker_cache(f"tiktoken:{path}", make)


def token_ids(enc, text: str | None) -> np.ndarray:
    """Ids of a whole text, the same as the encoder gives for it in one piece.

    Very long runs of white space overflow the encoder's stack.  Such a run, without its last
    character if anything follows, is one word of the pattern, and what stands around it is
    split as if it stood alone; so the run is merged by itself and the rest encoded as usual.
    """
    if not text:
        return np.zeros(0, np.uint16)
    if len(text) < 4000 or not BLANKS.search(text):
        return np.array(enc.encode_ordinary(text), np.uint16)
    out: list[int] = []
    at = 0
    for m in BLANKS.finditer(text):
        to = m.end() - (m.end() < len(text))
        out += enc.encode_ordinary(text[at : m.start()]) + enc._core_bpe.encode_single_piece(text[m.start() : to].encode())
        at = to
    return np.array(out + enc.encode_ordinary(text[at:]), np.uint16)


def filesystem(uri: str):
    """The file system of a folder's URI and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def settle(where, draft: str, final: str) -> None:
    """Give a finished file its name; what an earlier attempt left there is replaced."""
    try:
        where.move(draft, final)
    except OSError:
        where.delete_file(final)
        where.move(draft, final)


def write_flat(docs: DataFrame, uri: str, path: str, pattern: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` into flat files below ``uri``; returns (file, ordinal, doc_id) of each.

    Every task streams into a draft of its own and names it by the content it has read, so
    that a second attempt of a task replaces its own files and none of another's.  Null and
    empty texts leave only their end-of-document id.  Other columns are not read, whatever
    their names; repeated rows are written as often as they stand; an empty table writes no
    file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path, pattern)
        where, folder = filesystem(uri)
        where.create_dir(folder, recursive=True)
        task = TaskContext.get()
        part, draft = f"part-{task.partitionId():06d}", f"{folder}/_part-{task.partitionId():06d}.{task.taskAttemptId()}"
        end = np.array([end_id], np.uint16)
        out, size, name = None, 0, hashlib.sha256()
        ids: list[int | None] = []

        def put() -> pa.RecordBatch:
            nonlocal out, size, name, ids
            out.close()
            file = f"{part}-{name.hexdigest()[:16]}.bin"
            settle(where, draft, f"{folder}/{file}")
            batch = pa.RecordBatch.from_arrays([pa.array([file] * len(ids)), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64())], names=["file", "ordinal", "doc_id"])
            out, size, name, ids = None, 0, hashlib.sha256(), []
            return batch

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if out is None:
                    out = where.open_output_stream(draft)
                raw = np.concatenate((token_ids(enc, t.as_py()), end)).astype("<u2").tobytes()
                out.write(raw)
                name.update(f"{i},{len(raw)};".encode())
                ids.append(i)
                size += len(raw) // 2
                if size >= FILE_IDS:
                    yield put()
        if out is not None:
            yield put()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "file string, ordinal long, doc_id long")


def separators(spark: SparkSession, uri: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """(file, block, chunk, first, size, n, last, at): the separators in the blocks of all
    flat files below ``uri``.

    Only names and lengths of the files are listed; each block of ``block`` ids is a row that
    goes to any task, which reads its byte range and searches it at once.  ``first`` is the
    block's first id, ``size`` its ids, ``n`` the separators of the record, ``last`` the place
    of the last one in the file (-1 where there is none), ``at`` their places behind
    ``first``, packed.  A block with very many separators makes several records (``chunk``).
    """
    where, folder = filesystem(uri)
    where.create_dir(folder, recursive=True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(uri).select("path", "length")
    ranges = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {2 * block}")))).where("length > 1")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = filesystem(uri)
        for b in batches:
            for path, length, k in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                name = path.rsplit("/", 1)[1]
                first = k * block
                with where.open_input_file(f"{folder}/{name}") as f:
                    f.seek(2 * first)
                    ids = np.frombuffer(f.read(min(2 * block, length - length % 2 - 2 * first)), "<u2")
                at = np.flatnonzero(ids == end_id)
                for c in range(max(1, -(-len(at) // CHUNK))):
                    part = at[c * CHUNK : (c + 1) * CHUNK]
                    row = (name, k, c, first, len(ids), len(part), first + int(part[-1]) if len(part) else -1, part.astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["file", "block", "chunk", "first", "size", "n", "last", "at"])

    return ranges.select("path", "length", "block").repartition(tasks).mapInArrow(run, "file string, block long, chunk long, first long, size long, n long, last long, at binary")


def scan_flat(spark: SparkSession, uri: str, end_id: int, block: int = BLOCK, joined: bool = False) -> DataFrame:
    """Lengths of all documents in the flat files below ``uri``, found by their separators.

    Returns ``file, ordinal, start, n_tokens, ended``: ids before the document in its file,
    ids without the separator, and whether a separator closes it.  A vectorised search finds
    the separators of every block; a prefix scan over the records, which carries only counts
    and last places, tells each how many documents end before it and where its first one
    starts.  Files may be of any length.  Ids after a file's last separator make a document
    that is not ended; with ``joined`` it continues in the next file by name.  An empty file
    gives no row, a folder without files none at all; an odd last byte is left out.
    """
    found = stored(separators(spark, uri, end_id, block), "separators")
    before = Window.partitionBy("file").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    # A record of at most CHUNK documents is one row here: the scan is short beside the rows.
    scan = found.select(
        "file", "block", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("start"),
        F.sum("n").over(whole).alias("all"), (F.max("last").over(whole) + 1).alias("open_at"), F.max(F.col("first") + F.col("size")).over(whole).alias("length"),
        (F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"), F.desc("chunk"))) == 1).alias("final"),
    )
    names = ["file", "ordinal", "start", "n_tokens", "ended"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, first, at, ordinal, start, n, open_at, length, final in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                ends = np.frombuffer(at, "<u4").astype(np.int64) + first
                starts = np.concatenate(([start], ends[:-1] + 1)) if len(ends) else ends
                place = np.arange(len(ends)) + ordinal
                closed = np.ones(len(ends), bool)
                if final and open_at < length:
                    starts, ends, place, closed = np.append(starts, open_at), np.append(ends, length), np.append(place, n), np.append(closed, False)
                if len(ends):
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(ends)), pa.array(place), pa.array(starts), pa.array(ends - starts), pa.array(closed)], names=names)

    both = found.select("file", "block", "chunk", "first", "at").join(scan, ["file", "block", "chunk"])
    rows = both.select("file", "first", "at", "ordinal", "start", "all", "open_at", "length", "final").mapInArrow(run, "file string, ordinal long, start long, n_tokens long, ended boolean")
    if not joined:
        return rows
    # Documents left open run on to the first separator of a later file.  One row per file
    # tells how many ids each leaves behind; files are few beside documents.
    edge = rows.groupBy("file").agg(F.max_by("n_tokens", "ordinal").alias("tail"), F.max_by("ended", "ordinal").alias("closed"), F.max("ended").alias("has_end"), F.max("ordinal").alias("last"))
    w = Window.orderBy("file")
    edge = edge.withColumn("left", F.when(F.col("closed"), 0).otherwise(F.col("tail"))).withColumn("island", F.sum(F.col("has_end").cast("long")).over(w))
    edge = edge.withColumn("so_far", F.sum("left").over(Window.partitionBy("island").orderBy("file"))).withColumn("carried", F.coalesce(F.lag("so_far").over(w), F.lit(0))).withColumn("final", F.lead("file").over(w).isNull())
    out = rows.join(edge.select("file", "carried", "final"), "file")
    return out.where("ended OR final").select("file", "ordinal", F.when(F.col("ordinal") == 0, F.col("start") - F.col("carried")).otherwise(F.col("start")).alias("start"), F.when(F.col("ordinal") == 0, F.col("n_tokens") + F.col("carried")).otherwise(F.col("n_tokens")).alias("n_tokens"), "ended")
