"""Helpers shared by the corpus operators: session settings, shared storage, text batches."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the controls 0x09 to 0x0D.
WS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; set here only where it is
    unset and the driver is all there is; on a cluster an unset folder is an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="wanderframe-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + found


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` with its lineage cut by a compressed table in the shared folder."""
    at = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that nothing will read again, and let the
    driver's cleaner drop the shuffle files behind them."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        released(spark)


def worker_cache(key: str, make: Callable[[], object], alone: str | None = None) -> object:
    """One value per Python worker process, kept across tasks; of the keys that begin with
    ``alone`` the last one only, so that a worker never holds two large values of a kind."""
    kept = sys.__dict__.setdefault("_wanderframe_cache", {})
    if key not in kept:
        for old in [k for k in kept if alone and k.startswith(alone)]:
            del kept[old]
        kept[key] = make()
    return kept[key]


def row_key(*cols: str) -> F.Column:
    """A fingerprint of a row's content; rows alike in ``cols`` get the same one."""
    return F.xxhash64(*[F.col(c) for c in cols])


def pieces(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of an Arrow column as UTF-8 bytes (null: empty), in lists of about ``limit`` bytes."""
    start, part, size = 0, [], 0
    for i, b in enumerate(column.cast(pa.large_binary()).to_pylist()):
        part.append(b or b"")
        size += len(part[-1])
        if size >= limit:
            yield start, part
            start, part, size = i + 1, [], 0
    if part:
        yield start, part


def flat(texts: list[bytes], gap: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte array with ``gap`` before every text; the starts and ends of the texts in it."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens + len(gap))
    return np.frombuffer(gap + gap.join(texts) if texts else b"", np.uint8), ends - lens, ends


def released(spark: SparkSession) -> None:
    """Let the driver's cleaner drop the shuffle files of what a checkpoint has replaced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
