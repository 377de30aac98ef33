"""Session helpers: shared scratch space, materialised tables, table loading."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder (local tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/cladeflow"


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, from ``spark.checkpoint.dir``."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextmanager
def shuffles_end_with_write(spark: SparkSession):
    """Within: a query's shuffle files go as soon as its result is written.

    Else they stay until the driver happens to collect its garbage, and every phase's
    shuffles add up on the executors' disks.
    """
    key = "spark.sql.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """A run's own folder of Parquet tables in the shared root.

    Writing a table and reading it back cuts the lineage: a lost executor costs
    a reread of files, never a recomputation of everything before them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._count = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, parts: int = 0) -> DataFrame:
        """Write ``df`` as table ``name`` and return the table as read back.

        ``parts`` joins partitions of a result known to be small (see ``parts_for``),
        so that a short table is neither made by nor read in very many tasks.
        """
        self._count += 1
        df = df.coalesce(parts) if parts else df
        path = self.path(f"{self._count:03d}-{name}")
        with shuffles_end_with_write(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def put_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """As ``put``, bucketed and sorted by ``key``: joins on it don't shuffle this table again."""
        self._count += 1
        path, n = self.path(f"{self._count:03d}-{name}"), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table_name = f"scratch_{uuid.uuid4().hex}"
        out = df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
        with shuffles_end_with_write(self.spark):
            out.option("path", path).option("compression", "zstd").saveAsTable(table_name)
        out = self.spark.table(table_name)
        self.spark.sql(f"DROP TABLE {table_name}")  # an external table: its files stay, and the frame knows them
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            remove_path(self.spark, df._scratch_path)


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have, for columns of an operator's own."""
    taken, tag = {c.lower() for c in df.columns}, ""
    while any(f"{s}{tag}".lower() in taken for s in stems):
        tag = f"_{uuid.uuid4().hex[:8]}"
    return [f"{s}{tag}" for s in stems]


def parts_for(rows: int, each: int = 200_000) -> int:
    """Partitions for ``rows`` narrow rows, about ``each`` in one; grows with the rows."""
    return max(4, -(-rows // each))


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path object for ``path`` (any store Spark can open)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
