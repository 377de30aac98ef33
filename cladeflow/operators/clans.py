"""Clans: components of the clan edges, their representatives and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cladeflow.operators.components import connected_components
from cladeflow.runtime import Scratch


def weighted_degree(edges: DataFrame) -> DataFrame:
    """Sum of each family's weights, added in a fixed order (as first, then as second family).

    Doubles are folded over a sorted array of one family's neighbours, so the sum does not
    depend on how rows arrive.
    """
    first = edges.select(F.col("family_1").alias("family"), F.lit(0).alias("side"), F.col("family_2").alias("other"), "weight")
    second = edges.select(F.col("family_2").alias("family"), F.lit(1).alias("side"), F.col("family_1").alias("other"), "weight")
    ordered = F.array_sort(F.collect_list(F.struct("side", "other", "weight")))
    return first.unionByName(second).groupBy("family").agg(F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x["weight"]).alias("degree"))


def clans(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``clan_number, family_id, is_representative``: by size, then representative.

    The representative has the largest weighted degree, then the smallest name.
    """
    edges = scratch.put(edges, "clan-edges")
    labels = connected_components(edges, scratch, "family_1", "family_2")
    members = labels.join(weighted_degree(edges).withColumnRenamed("family", "node"), "node")
    best = members.groupBy("label").agg(F.min(F.struct((-F.col("degree")).alias("d"), "node")).alias("best"), F.count("*").alias("size"))
    best = best.select("label", F.col("best.node").alias("representative"), "size")
    # one row per clan: the numbering is the only global order, over components and not families
    numbered = best.withColumn("clan_number", F.row_number().over(Window.orderBy(F.desc("size"), "representative")).cast("bigint"))
    out = members.join(numbered, "label")
    return out.select("clan_number", F.col("node").alias("family_id"), (F.col("node") == F.col("representative")).alias("is_representative"))


def size_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("clan_number").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clans"))
