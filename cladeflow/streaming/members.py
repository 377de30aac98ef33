"""Merged intervals kept up to date from a folder that member files arrive in.

Merging is idempotent and associative: islands of old and new intervals together are those
of all intervals ever seen. Each micro-batch is merged with the version before it and
written as the next one; the version number is the batch's, so a batch that is replayed
after a fault writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeflow.operators.intervals import merge_intervals, resolve_lengths
from cladeflow.runtime import path_exists
from cladeflow.sources.text import parse_members


def version(table: str, number: int) -> str:
    return f"{table}/version={number}"


def current(spark: SparkSession, table: str, before: int = 1 << 62) -> DataFrame | None:
    """The newest version below ``before``."""
    if not path_exists(spark, table):
        return None
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    numbers = [int(n.rpartition("=")[2]) for n in (f.getPath().getName() for f in found) if n.startswith("version=")]
    numbers = [n for n in numbers if n < before and path_exists(spark, f"{version(table, n)}/_SUCCESS")]
    return spark.read.parquet(version(table, max(numbers))) if numbers else None


def update(batch: DataFrame, number: int, table: str, lengths: DataFrame | None = None) -> None:
    """Merge one micro-batch of member lines into the table; faulty lines go to a folder beside it."""
    spark = batch.sparkSession
    rows, faults = parse_members(batch.select(F.regexp_replace("value", "[\\r\\n]+\\z", "").alias("line")))
    faults.write.mode("overwrite").json(f"{table}-faults/batch={number}")
    rows = resolve_lengths(rows, lengths).where("end is not null") if lengths is not None else rows.where("start is not null")
    old = current(spark, table, number)
    rows = rows.select("protein", "family", "start", "end")
    merged = merge_intervals(rows if old is None else old.select("protein", "family", "start", "end").unionByName(rows))
    merged.write.mode("overwrite").parquet(version(table, number))


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, lengths: DataFrame | None = None):
    """Start the stream: all files now there and then those that arrive (with ``availableNow``: once)."""
    source = spark.readStream.format("text").option("lineSep", "\n").load(folder)
    writer = source.writeStream.foreachBatch(lambda df, n: update(df, n, table, lengths))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
