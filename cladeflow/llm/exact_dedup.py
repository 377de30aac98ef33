"""Exact duplicate removal against a persistent digest index (DataFrame functions only).

The index is a Parquet table of entries, bucketed and sorted by SHA-256 digest; the number
of buckets is fixed when it is created and kept with it. A batch is first reduced to one
head per digest (map-side combined). The heads meet the index in a sort-merge anti-join
over its buckets: new digests are appended as they are, known ones as a further entry with
this batch's rows and best row, so counts and heads are right over all batches. The
decisions then go back to all rows by a plain equi-join of narrow rows, which adaptive
execution can split when one digest holds a large part of them.

Entries carry their batch. A batch that is given again finds its own entries, leaves them
out of what is known and appends nothing, so a job that failed after the append can be
repeated with the same answer. ``moved`` tells which rows that earlier batches kept have
lost their place to a longer one of a later batch.

Defined cases: null text is empty text; all empty texts are equal to each other.
A null doc_id sorts after every other. Rows that repeat both doc_id and text are
copies of each other: exactly one of them is kept. Further columns of the input,
whatever their names, are ignored by ``decide`` and passed through by ``drop_duplicates``.
An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cladeflow.runtime import Scratch, filesystem, free_names, path_exists

#: Characters that do not count in a comparison (fixed by the contract).
IGNORED = "[\\x20\\x09-\\x0D]+"


def digest(text: Column) -> Column:
    """32-byte SHA-256 of the text without the ignored characters, in UTF-8."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, ""), 256))


def _order(points: Column, doc_id: Column) -> Column:
    """The least of it stays: most code points, then the smallest id, null last."""
    return F.struct((-points).alias("p"), doc_id.isNull().alias("n"), doc_id.alias("d"))


class DigestIndex:
    """Persistent entries ``(digest, batch, keep_id, n_points, group_size)``, bucketed and sorted by digest.

    An entry has the rows of one batch with that digest, and the best of them. ``buckets``
    counts only where the index doesn't exist yet; a 100 TB corpus wants some thousands.
    """

    SCHEMA = "digest binary, batch string, keep_id bigint, n_points int, group_size bigint"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        made = f"{path}/_buckets"
        if path_exists(spark, made):
            fs, p = filesystem(spark, made)
            stream = fs.open(p)
            self.buckets = stream.readInt()
            stream.close()
        else:
            self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
            fs, p = filesystem(spark, made)
            stream = fs.create(p, False)
            stream.writeInt(self.buckets)
            stream.close()

    @contextmanager
    def _named(self) -> Iterator[str]:
        """The catalog's name for the table while it is needed; frames made meanwhile stay valid."""
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        try:
            yield name
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # an external table: its files stay

    def read(self) -> DataFrame:
        with self._named() as name:
            return self.spark.table(name)

    def known(self, batch: str | None = None) -> DataFrame:
        """``digest, keep_id, n_points, group_size`` over all entries but those of ``batch``."""
        entries = self.read() if batch is None else self.read().where(F.col("batch") != batch)
        each = entries.groupBy("digest").agg(F.min(_order(F.col("n_points"), F.col("keep_id"))).alias("head"), F.sum("group_size").alias("group_size"))
        return each.select("digest", F.col("head.d").alias("keep_id"), (-F.col("head.p")).alias("n_points"), "group_size")

    def holds(self, batch: str) -> bool:
        return self.read().where(F.col("batch") == batch).limit(1).count() > 0

    def append(self, heads: DataFrame, batch: str) -> None:
        rows = heads.select("digest", F.lit(batch).alias("batch"), "keep_id", "n_points", "group_size").repartition(self.buckets, "digest")
        with self._named() as name:
            rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).mode("append").saveAsTable(name)


def moved(index: DigestIndex, batch: str) -> DataFrame:
    """``digest, was, keep_id``: rows kept before ``batch`` that lose their place to one of it."""
    own = index.read().where(F.col("batch") == batch).select("digest", _order(F.col("n_points"), F.col("keep_id")).alias("new"))
    before = index.known(batch).select("digest", _order(F.col("n_points"), F.col("keep_id")).alias("old"))
    return before.join(own, "digest").where("new < old").select("digest", F.col("old.d").alias("was"), F.col("new.d").alias("keep_id"))


def decide(docs: DataFrame, index: DigestIndex, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with most code points, then the smallest doc_id, stays, here and
    in all batches before; group_size counts the rows of all of them. ``batch`` names the
    batch: given again, it gets the same answer.
    """
    batch = batch or uuid.uuid4().hex
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        digest(F.col(text_col)).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"),
    )
    rows = scratch.put(rows.groupBy("doc_id", "digest", "n_points").agg(F.count("*").alias("copies")), "rows")
    heads = rows.groupBy("digest").agg(F.min(_order(F.col("n_points"), F.col("doc_id"))).alias("head"), F.sum("copies").alias("group_size"))
    heads = scratch.put(heads.select("digest", F.col("head.d").alias("keep_id"), (-F.col("head.p")).alias("n_points"), "group_size"), "heads")
    known = index.known(batch).hint("merge")
    fresh = scratch.put(heads.join(known, "digest", "left_anti"), "fresh")
    old = known.select("digest", F.col("group_size").alias("g"), _order(F.col("n_points"), F.col("keep_id")).alias("old"))
    again = heads.join(old, "digest").withColumn("new", _order(F.col("n_points"), F.col("keep_id")))
    again = scratch.put(again.select("digest", "keep_id", "n_points", "group_size", "g", "old", (F.col("new") < F.col("old")).alias("better")), "again")
    if not index.holds(batch):
        index.append(fresh.unionByName(again.select(*fresh.columns)), batch)
    resolved = fresh.withColumn("here", F.lit(True)).unionByName(
        again.select(
            "digest",
            F.when(F.col("better"), F.col("keep_id")).otherwise(F.col("old.d")).alias("keep_id"),
            F.when(F.col("better"), F.col("n_points")).otherwise(-F.col("old.p")).alias("n_points"),
            (F.col("group_size") + F.col("g")).alias("group_size"),
            F.col("better").alias("here"),
        )
    )
    kept = F.col("here") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("head_points"))
    joined = rows.join(resolved.withColumnRenamed("n_points", "head_points"), "digest")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        kept.alias("head"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"),
        "digest",
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("head") & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, index: DigestIndex, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept_id, kept_digest, own_id, own_digest, points, most = free_names(docs, "kept_id", "kept_digest", "own_id", "own_digest", "points", "most")
    kept = decide(docs, index, scratch, id_col, text_col, batch).where("kept")
    kept = scratch.put(kept.select(F.col("doc_id").alias(kept_id), F.unhex("text_sha256").alias(kept_digest)), "kept")
    marked = docs.withColumn(own_id, docs[id_col].cast("bigint")).withColumn(own_digest, digest(docs[text_col]))
    out = marked.join(kept, F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_digest) == F.col(kept_digest)), "left_semi")
    if docs.groupBy(docs[id_col]).agg(F.count("*").alias(most)).where(F.col(most) > 1).limit(1).count():
        # rows that share an id: of the equal ones only the longest, and one of its copies
        out = out.withColumn(points, F.length(F.coalesce(docs[text_col], F.lit(""))))
        best = out.groupBy(F.col(own_id).alias(kept_id), F.col(own_digest).alias(kept_digest)).agg(F.max(points).alias(most))
        same = F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_digest) == F.col(kept_digest)) & (F.col(points) == F.col(most))
        out = out.join(best, same, "left_semi").dropDuplicates([own_id, own_digest])
    return out.drop(own_id, own_digest, points)
