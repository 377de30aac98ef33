"""Row keys for operators that must tell documents apart by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cladeflow.runtime import Scratch


def keyed(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """``rid, doc_id, text``: rid is unique and ascends with doc_id (null last), then text.

    As a rule doc_id itself is the key; only where it repeats or is null are the rows
    sorted and numbered (a range sort, written once).
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    unfit = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not unfit:
        return rows.select(F.col("doc_id").alias("rid"), "doc_id", "text")
    ordered = scratch.put(rows.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("rid", F.monotonically_increasing_id()), "keyed")
    return ordered.select("rid", "doc_id", "text")
