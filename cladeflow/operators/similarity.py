"""Similarity of families from their merged intervals, with exact integer thresholds."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from cladeflow.operators.intervals import family_totals, residue_overlap, shared_proteins

#: Thresholds are exact to so many parts; families of this similarity are counted as near-redundant.
SCALE = 1_000_000
NEAR_REDUNDANT = Fraction(95, 100)


class ThresholdError(ValueError):
    """A threshold that is no decimal in [0, 1] of at most six places."""


def parse_threshold(text: str | Fraction | float) -> Fraction:
    try:
        value = Fraction(str(text)) if not isinstance(text, Fraction) else text
    except (ValueError, ZeroDivisionError) as error:
        raise ThresholdError(f"not a number: {text}") from error
    if not 0 <= value <= 1 or (value * SCALE).denominator != 1:
        raise ThresholdError(f"must lie in [0, 1] with at most six decimals: {text}")
    return value


def at_least(numerator: Column, denominator: Column, threshold: Fraction) -> Column:
    """``numerator / denominator >= threshold`` without rounding; overflow raises under ANSI mode."""
    return numerator * SCALE >= denominator * int(threshold * SCALE)


def family_pairs(merged: DataFrame) -> DataFrame:
    """All pairs of families that share a protein: shared, overlap, both families' totals and unions."""
    totals = family_totals(merged)
    t1 = totals.select(F.col("family").alias("family_1"), F.col("residues").alias("r1"), F.col("proteins").alias("n1"))
    t2 = totals.select(F.col("family").alias("family_2"), F.col("residues").alias("r2"), F.col("proteins").alias("n2"))
    pairs = shared_proteins(merged).join(residue_overlap(merged), ["family_1", "family_2"], "left")
    pairs = pairs.withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("bigint"))).join(t1, "family_1").join(t2, "family_2")
    return pairs.select(
        "family_1",
        "family_2",
        "shared_proteins",
        "overlap",
        (F.col("n1") + F.col("n2") - F.col("shared_proteins")).alias("protein_union"),
        (F.col("r1") + F.col("r2") - F.col("overlap")).alias("residue_union"),
        F.least("r1", "r2").alias("smaller"),
    )


def six(numerator: str, denominator: str) -> Column:
    """A ratio with six decimals, half to even as of the exact double."""
    return F.format_number(F.col(numerator).cast("double") / F.col(denominator).cast("double"), 6)


def edges(pairs: DataFrame, min_jaccard: Fraction = Fraction(1, 10), min_containment: Fraction = Fraction(1, 2)) -> DataFrame:
    keep = at_least(F.col("overlap"), F.col("residue_union"), min_jaccard) | at_least(F.col("overlap"), F.col("smaller"), min_containment)
    return pairs.where(keep).select(
        "family_1",
        "family_2",
        "shared_proteins",
        six("shared_proteins", "protein_union").alias("protein_jaccard"),
        six("overlap", "residue_union").alias("residue_jaccard"),
        six("overlap", "smaller").alias("residue_containment"),
    )


def clan_edges(pairs: DataFrame, clan_jaccard: Fraction = Fraction(1, 2)) -> DataFrame:
    """Pairs that bind families into clans, of all pairs and not of the edges alone."""
    keep = at_least(F.col("overlap"), F.col("residue_union"), clan_jaccard)
    return pairs.where(keep).select("family_1", "family_2", (F.col("overlap").cast("double") / F.col("residue_union").cast("double")).alias("weight"))


def summary(pairs: DataFrame, min_jaccard=Fraction(1, 10), min_containment=Fraction(1, 2), near: Fraction = NEAR_REDUNDANT) -> DataFrame:
    keep = at_least(F.col("overlap"), F.col("residue_union"), min_jaccard) | at_least(F.col("overlap"), F.col("smaller"), min_containment)
    return pairs.agg(
        F.count("*").alias("pairs_sharing_proteins"),
        F.count_if(keep).alias("edges"),
        F.count_if(at_least(F.col("overlap"), F.col("residue_union"), near)).alias("near_redundant_pairs"),
    )
