"""Relational steps of family building: clusters, hits, membership, columns, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cladeflow.functions import names as N


# --- clusters -------------------------------------------------------------------------


def cluster_order(clusters: DataFrame) -> DataFrame:
    """``ord, representative, member`` with the order in which clusters first appear."""
    first = clusters.groupBy("representative").agg(F.min("ord").alias("first"), F.count("*").alias("members"))
    return clusters.join(first, "representative")


def numbered_clusters(clusters: DataFrame) -> DataFrame:
    """One row per cluster: its rank by first appearance (the order of family ids)."""
    first = clusters.groupBy("representative").agg(F.min("ord").alias("first"), F.count("*").alias("members"))
    return first.withColumn("cluster_ord", F.row_number().over(Window.orderBy("first")).cast("bigint")).drop("first")


def membership(clusters: DataFrame, recruits: DataFrame) -> DataFrame:
    """Share of each cluster's distinct members still recruited, as counts and a ratio.

    ``clusters(representative, member)``, ``recruits(representative, member)``.
    """
    own = clusters.select("representative", "member").distinct()
    got = recruits.select("representative", "member").distinct().withColumn("hit", F.lit(1))
    both = own.join(got, ["representative", "member"], "left").groupBy("representative")
    return both.agg(F.count("*").alias("members"), F.count("hit").alias("recruited")).withColumn("membership", F.col("recruited") / F.col("members"))


# --- hits -------------------------------------------------------------------------------


def reported(hits: DataFrame, cutoff: float) -> DataFrame:
    """Hits that clear the reporting threshold; ``evalue`` must be global, over the whole database."""
    return hits.where(F.col("evalue") <= F.lit(cutoff))


def long_enough(env_from: Column, env_to: Column, qlen: Column, share: float, leaving: bool = False) -> Column:
    """Envelope length against the model's; waived when a family is finished."""
    return F.lit(True) if leaving else (env_to - env_from + 1) >= F.lit(share) * qlen


def recruit(hits: DataFrame, database: DataFrame | None, share: float, leaving: bool = False) -> DataFrame:
    """Named, clipped sequences of the hits that are long enough, with hit order kept.

    ``hits(family, target, tlen, env_from, env_to, qlen, ...)`` joined to
    ``database(name, seq)``, or carrying ``seq`` already where database is None. A hit whose
    record the database lacks is an error.
    """
    kept = hits.where(long_enough(F.col("env_from"), F.col("env_to"), F.col("qlen"), share, leaving))
    if database is not None:
        kept = kept.join(database.select(F.col("name").alias("target"), "seq"), "target", "left")
        lacking = F.raise_error(F.concat(F.lit("no record of hit "), F.col("target")))
        kept = kept.withColumn("seq", F.when(F.col("seq").isNull(), lacking.cast("string")).otherwise(F.col("seq")))
    return kept.withColumn("row_name", N.masked_name(F.col("target"), F.col("env_from"), F.col("env_to"), F.col("tlen"))).withColumn(
        "row", F.when(F.col("env_to") - F.col("env_from") + 1 < F.col("tlen"), N.masked_residues(F.col("seq"), F.col("env_from"), F.col("env_to"))).otherwise(F.col("seq"))
    )


def ranked(hits: DataFrame, *order: Column) -> DataFrame:
    """Rank of every hit in its family: ``hit_rank`` ascending is the alignment's row order."""
    return hits.withColumn("hit_rank", F.row_number().over(Window.partitionBy("family").orderBy(*order)).cast("bigint"))


def representatives(ranked_hits: DataFrame, *columns: str) -> DataFrame:
    """First row of each family, without sorting whole families."""
    best = F.min_by(F.struct(*columns), F.col("hit_rank"))
    return ranked_hits.groupBy("family").agg(best.alias("x")).select("family", "x.*")


def new_recruits(recruits: DataFrame, seen: DataFrame) -> DataFrame:
    """``family, member`` pairs met for the first time."""
    return recruits.select("family", "member").distinct().join(seen.select("family", "member").distinct(), ["family", "member"], "left_anti")


def converged(recruits: DataFrame, seen: DataFrame) -> DataFrame:
    """Families with recruits, none of them new."""
    return recruits.select("family").distinct().join(new_recruits(recruits, seen).select("family"), "family", "left_anti")


def success_ranks(outcomes: DataFrame) -> DataFrame:
    """Family ids: 1-based rank among the successful in cluster order; discards take none."""
    good = outcomes.where("outcome = 'successful'")
    return good.withColumn("family_id", F.row_number().over(Window.orderBy("cluster_ord")).cast("bigint"))


# --- alignment columns --------------------------------------------------------------------


def column_occupancy(rows: DataFrame) -> DataFrame:
    """Residues (anything but ``-``) and rows per family and column of ``family, aligned``."""
    chars = rows.select("family", F.posexplode(F.split("aligned", "")).alias("col", "c")).where("c <> ''")
    return chars.groupBy("family", (F.col("col") + 1).cast("bigint").alias("col")).agg(F.count_if(F.col("c") != "-").alias("filled"), F.count("*").alias("rows"))


def trim_positions(occupancy: DataFrame, threshold: float) -> DataFrame:
    """First and last column whose occupancy exceeds the threshold; families with none are absent."""
    passing = occupancy.where(F.col("filled") / F.col("rows") > F.lit(threshold))
    return passing.groupBy("family").agg(F.min("col").alias("first"), F.max("col").alias("last"))


def clip(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows cut to ``first..last`` of their family; unchanged where there is none."""
    joined = rows.join(positions, "family", "left")
    cut = F.when(F.col("first").isNull(), F.col("aligned")).otherwise(F.substring(F.col("aligned"), F.col("first"), F.col("last") - F.col("first") + 1))
    return joined.select(*[c for c in rows.columns if c != "aligned"], cut.alias("aligned"))


def reference_span(rf: Column) -> Column:
    """``struct(first, last)`` of the match columns of a reference line; null without any."""
    lead = F.length(F.regexp_extract(rf, "^(\\.*)", 1))
    tail = F.length(F.regexp_extract(rf, "(\\.*)$", 1))
    return F.when(lead < F.length(rf), F.struct((lead + 1).alias("first"), (F.length(rf) - tail).alias("last")))


# --- outcomes and reports -------------------------------------------------------------------


def length_reason(length: Column, least: int, most: int) -> Column:
    return F.when(length < least, "family representative length too small").when(length > most, "family representative length too large")


def python_bool(flag: Column) -> Column:
    return F.when(flag.isNull(), "").when(flag, "True").otherwise("False")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def reasons(outcomes: DataFrame) -> DataFrame:
    """Count of every reason for a discard."""
    return outcomes.where("outcome <> 'successful'").groupBy(F.col("outcome").alias("reason")).agg(F.count("*").alias("n"))


def delta_line(*fields: Column) -> Column:
    """One CSV line; null fields are empty."""
    return F.concat_ws(",", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
