"""Tables between steps: in the folder that the cluster shares, so that they outlive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, ``spark.checkpoint.dir``.

    Only where that is unset and the driver is all there is, a temporary folder stands in."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="wanderframe-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    root = found if ":" in found else f"file://{found}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` with its lineage cut by a table in the shared folder."""
    at = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing will read again."""
    for df in tables:
        fs, p = hadoop(df.sparkSession, df.stored_at)
        fs.delete(p, True)


def running_sums(df: DataFrame, order: list[str], value: str, name: str, part: str) -> DataFrame:
    """``df`` with ``name``, the sum of a whole ``value`` over the rows before in the order of
    the columns, and ``part``, the number of the range of rows.

    The rows are written in ranges; sums run within a range and over the ranges' totals."""
    spark = df.sparkSession
    at = scratch(spark, "sums")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(at)
    rows = spark.read.schema(df.schema).parquet(at).withColumn(part, F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"))
    totals = rows.groupBy(part).agg(F.sum(value).alias("__t"))  # a row for each range
    before = totals.select(part, (F.sum("__t").over(Window.orderBy(part)) - F.col("__t")).alias("__before"))
    own = F.sum(value).over(Window.partitionBy(part).orderBy(*order)) - F.col(value)
    return rows.join(F.broadcast(before), part).withColumn(name, F.col("__before") + own).drop("__before")


def dense_ranks(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: each row's place from 0 on in the order of the columns.

    The rows are written in ranges of the order; a row's place is its index in its file and
    the rows of the files before, so that no task sees more than a range."""
    spark = df.sparkSession
    at = scratch(spark, "ranks")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(at)
    rows = spark.read.schema(df.schema).parquet(at).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = rows.groupBy("__file").agg(F.count("*").alias("__n"))  # a row for each file
    number = F.regexp_extract("__file", r"part-(\d+)", 1).cast("long")  # of the range: as text, 100000 would come before 99999
    before = files.select("__file", (F.sum("__n").over(Window.orderBy(number)) - F.col("__n")).alias("__before"))
    return rows.join(F.broadcast(before), "__file").withColumn(name, F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")
