"""Training-order materialisation (operator 1).

Every sequence gets a dense index; a keyed Feistel permutation with cycle-walking maps the
index to its slot in the training order.  Ranges of slots are the shards, files of
fixed-stride records: slot ``s`` lies in shard ``s // shard_size`` at byte
``(s % shard_size) * stride``, so a reader resumes anywhere by arithmetic alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, work_dir
from .flatfiles import encoder, filesystem, settle, token_ids

LENGTH = 256
#: Ids of a packed sequence.
PACKED = 512
SHARD = 8192
ROUNDS = 6
#: Level of compression of ids on their way.
ZSTD = 6
#: Bytes of records in a range of shards, which one task sorts and writes.
RANGE_BYTES = 64 << 20
#: Up to so many files of the sequence table, their first indices go to every task; beyond,
#: they are joined by a shuffle.
FEW_FILES = 100_000


def sequences(docs: DataFrame, path: str, pattern: str, end_id: int, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, tokens): each text's ids and its end id, cut into ``length`` ids.

    ``tokens`` is binary, two bytes an id, unpadded.  Null and empty texts give one piece
    that is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            ids, piece, tokens = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = np.append(token_ids(enc, t.as_py()), np.uint16(end_id)).astype("<u2").tobytes()
                cuts = range(0, len(raw), 2 * length)
                ids += [i] * len(cuts)
                piece += range(len(cuts))
                tokens += [raw[c : c + 2 * length] for c in cuts]
                if len(ids) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int64()), pa.array(tokens, pa.binary())], names=["doc_id", "piece", "tokens"])
                    ids, piece, tokens = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int64()), pa.array(tokens, pa.binary())], names=["doc_id", "piece", "tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece long, tokens binary")


def packed_sequences(docs: DataFrame, path: str, pattern: str, end_id: int, length: int = PACKED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_ids, tokens): texts and their end ids one after another, cut into ``length`` ids.

    Only the last sequence of a task is shorter, so that fixed strides hold next to no
    padding.  ``doc_ids`` lists the documents with an id in the sequence, in order.  Null and
    empty texts are an end id alone; repeated rows stand as often as they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        size = 0

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal ids, parts, size
            flat = np.concatenate(parts)
            ends = np.cumsum([len(p) for p in parts])
            n = -(-len(flat) // length) if last else len(flat) // length
            raw = flat.astype("<u2").tobytes()
            at = np.arange(n) * length
            first = np.searchsorted(ends, at, "right")
            final = np.searchsorted(ends, np.minimum(at + length, len(flat)) - 1, "right")
            batch = pa.RecordBatch.from_arrays([pa.array([ids[a : b + 1] for a, b in zip(first.tolist(), final.tolist(), strict=True)], pa.list_(pa.int64())), pa.array([raw[2 * a : 2 * (a + length)] for a in at.tolist()], pa.binary())], names=["doc_ids", "tokens"])
            rest = flat[n * length :]
            keep = int(np.searchsorted(ends, n * length, "right"))
            starts = np.maximum(np.append(0, ends[:-1])[keep:], n * length) - n * length
            ids, parts, size = ids[keep:], np.split(rest, starts[1:]) if len(rest) else [], len(rest)
            return batch

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                parts.append(np.append(token_ids(enc, t.as_py()), np.uint16(end_id)))
                size += len(parts[-1])
                if size >= 1 << 21:
                    yield cut(False)
        if parts:
            yield cut(True)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_ids array<bigint>, tokens binary")


def round_keys(key: str) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{key}|{r}".encode()).digest()[:7], "big") for r in range(ROUNDS)]


def permutation(n: int, key: str):
    """A keyed permutation of range(n) on numpy arrays: balanced Feistel over the next even
    number of bits; values that fall outside walk on along their cycle."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(k) for k in round_keys(key)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(31)
            f *= np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return left << np.uint64(half) | right

    def slots(index: np.ndarray) -> np.ndarray:
        x = once(index.astype(np.uint64))
        while (out := x >= n).any():
            x[out] = once(x[out])
        return x.astype(np.int64)

    return slots


def materialise(seqs: DataFrame, uri: str, key: str, pad_id: int, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Write ``seqs`` in training order below ``uri``; one row of the manifest per sequence.

    Returns the columns of ``seqs`` but ``tokens``, then ``slot, shard, byte_offset,
    n_tokens``.  The sequences are first written as a table in the shared folder: a row's
    file and place in it then make its dense index the same in every later attempt.  Short
    sequences are padded to the stride with ``pad_id``; an empty table writes nothing.
    Repeated rows are sequences of their own.
    """
    spark = seqs.sparkSession
    table = work_dir(spark, "sequences")
    seqs.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(ZSTD)).parquet(table)
    rows = spark.read.schema(seqs.schema).parquet(table).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    # One row per file; a running sum turns counts into the files' first indices.
    files = stored(rows.groupBy("__file").agg(F.count("*").alias("__n")), "files")
    n = files.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    few = files.count() <= FEW_FILES
    files = files.select("__file", (F.sum("__n").over(Window.orderBy("__file")) - F.col("__n")).alias("__first"))
    slots = permutation(n, key)
    carry = [c for c in seqs.columns if c != "tokens"]
    names = [*carry, "slot", "shard", "byte_offset", "n_tokens"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in seqs.schema.fields if f.name != "tokens"] + ["slot long", "shard long", "byte_offset long", "n_tokens long"])
    stride = 2 * length
    shards = max(1, -(-n // shard))
    # A task holds one range of shards: of bounded bytes at every size of input.
    tasks = min(shards, max(-(-n * stride // RANGE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one range of shards travel together, compressed: far smaller than one by one."""
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD))
        for b in batches:
            slot = slots(b.column(b.num_columns - 1).to_numpy())
            b = b.set_column(b.num_columns - 1, "slot", pa.array(slot))
            part = slot // shard * tasks // shards
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(tasks + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as out:
                    out.write_batch(b.take(pa.array(order[cut[p] : cut[p + 1]])))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "rows"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sort a range of shards by slot and write each; a task holds its ranges one by one."""
        from pyspark import TaskContext

        got: dict[int, list[bytes]] = {}
        for b in batches:
            for p, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got.setdefault(p, []).append(rows)
        if not got:
            return
        where, folder = filesystem(uri)
        where.create_dir(folder, recursive=True)
        attempt, pad = TaskContext.get().taskAttemptId(), np.full(length, pad_id, "<u2").tobytes()
        for p in sorted(got):
            t = pa.concat_tables([pa.ipc.open_stream(rows).read_all() for rows in got.pop(p)]).sort_by("slot").combine_chunks()
            slot = t.column("slot").to_numpy()
            of = slot // shard
            for s in np.unique(of).tolist():
                lo, hi = np.searchsorted(of, (s, s + 1)).tolist()
                part = t.slice(lo, hi - lo)
                tokens = part.column("tokens").to_pylist()
                with where.open_output_stream(f"{folder}/_shard-{s:08d}.{attempt}") as out:
                    out.write(b"".join([x if len(x) == stride else x + pad[len(x) :] for x in tokens]))
                settle(where, f"{folder}/_shard-{s:08d}.{attempt}", f"{folder}/shard-{s:08d}.bin")
                columns = [*(part.column(c).combine_chunks() for c in carry), pa.array(slot[lo:hi]), pa.array(of[lo:hi]), pa.array(slot[lo:hi] % shard * stride), pa.array(np.array([len(x) // 2 for x in tokens], np.int64))]
                yield from pa.table(columns, names=names).to_batches()

    placed = rows.join(F.broadcast(files) if few else files, "__file").select(*carry, "tokens", (F.col("__first") + F.col("__row")).alias("slot"))
    dealt = placed.mapInArrow(deal, "part int, rows binary").repartitionById(tasks, "part")
    return dealt.mapInArrow(write, schema)


def read_slots(uri: str, first: int, count: int, length: int = LENGTH, shard: int = SHARD) -> np.ndarray:
    """``count`` records from slot ``first`` on, as an array of ids: a resumed read."""
    where, folder = filesystem(uri)
    out = []
    while count > 0:
        s, at = divmod(first, shard)
        with where.open_input_file(f"{folder}/shard-{s:08d}.bin") as f:
            f.seek(at * 2 * length)
            raw = f.read(min(count, shard - at) * 2 * length)
        got = np.frombuffer(raw, "<u2").reshape(-1, length)
        if not len(got):
            break
        out.append(got)
        first, count = first + len(got), count - len(got)
    return np.concatenate(out) if out else np.zeros((0, length), "<u2")
