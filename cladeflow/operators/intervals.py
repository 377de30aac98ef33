"""Residue intervals: resolving whole proteins, merging, totals and pairwise overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Width of the narrowest bins of the overlap join, and the factor from one class of widths to the next.
BIN, FACTOR = 8, 4


def resolve_lengths(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """``family, protein, start, end``; rows without bounds take their protein's whole length.

    Only these rows meet ``lengths(protein, length)``; end stays null where it is missing.
    """
    bounded = members.where("start is not null").select("family", "protein", "start", "end")
    bare = members.where("start is null").select("family", "protein").distinct()
    whole = bare.join(lengths.select("protein", "length"), "protein", "left")
    return bounded.unionByName(whole.select("family", "protein", F.lit(1).cast("bigint").alias("start"), F.col("length").cast("bigint").alias("end")))


def missing_lengths(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """Proteins of whole-protein rows that ``lengths`` does not hold."""
    return members.where("start is null").select("protein").distinct().join(lengths, "protein", "left_anti")


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Islands of touching or overlapping intervals per protein and family.

    One shuffle by (protein, family): the running maximum, the island number and the
    final aggregation all use that partitioning.
    """
    rows = intervals.select("protein", "family", "start", "end")  # repeats merge by themselves
    order = Window.partitionBy("protein", "family").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0)
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.withColumn("new", new).withColumn("island", island)
    return marked.groupBy("protein", "family", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def family_totals(merged: DataFrame) -> DataFrame:
    """Residues and distinct proteins of each family."""
    per_protein = merged.groupBy("family", "protein").agg(F.sum(F.col("end") - F.col("start") + 1).alias("r"))
    return per_protein.groupBy("family").agg(F.sum("r").alias("residues"), F.count("*").alias("proteins"))


def protein_fanout(merged: DataFrame) -> DataFrame:
    """Families of each protein, and the pairs they make."""
    per = merged.select("protein", "family").distinct().groupBy("protein").agg(F.count("*").alias("families"))
    return per.withColumn("pairs", F.expr("families * (families - 1) div 2"))


def shared_proteins(merged: DataFrame) -> DataFrame:
    """Proteins that two families have in common, per pair (family_1 < family_2)."""
    seen = merged.select("protein", "family").distinct()
    a = seen.select("protein", F.col("family").alias("family_1"))
    b = seen.select("protein", F.col("family").alias("family_2"))
    return a.join(b, "protein").where("family_1 < family_2").groupBy("family_1", "family_2").agg(F.count("*").alias("shared_proteins"))


def _class(length: str) -> str:
    """Class of the narrowest bins that are no shorter than ``length``."""
    return f"cast(greatest(0, ceil(round(log({FACTOR}, ({length}) / {BIN}), 9))) as int)"


def overlapping(merged: DataFrame) -> DataFrame:
    """``family_1, s1, e1, family_2, s2, e2`` of all overlapping intervals of two families.

    Every interval lies in one or two bins of its own class, whose width is at least its
    length, and looks for partners there and in the bins of each wider class that the table
    has. So only neighbours meet, and one long interval widens no bin but its own. A pair
    counts in the bin where its overlap starts.
    """
    sized = merged.select("protein", "family", "start", "end", F.expr(_class("end - start + 1")).alias("own"))
    bits = sized.agg(F.bit_or(F.expr("shiftleft(1L, own)")).alias("bits")).first().bits or 0  # one number
    classes = [c for c in range(63) if bits >> c & 1]
    width = lambda c: F.lit(BIN * FACTOR**c).cast("bigint")
    wide = F.array(*[F.struct(F.lit(c).alias("class"), width(c).alias("w")) for c in classes] or [F.struct(F.lit(0).alias("class"), width(0).alias("w"))])
    seen = sized.select("*", F.explode(F.filter(wide, lambda x: x["class"] >= F.col("own"))).alias("x")).select("*", "x.class", "x.w").drop("x")
    seen = seen.select("*", F.explode(F.expr("sequence(start div w, end div w)")).alias("bin"))
    key = ["protein", "class", "bin"]
    a = seen.where("own = class").select(*key, "w", F.col("family").alias("f1"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = seen.select(*key, "own", F.col("family").alias("f2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    met = a.join(b, key).where("f1 <> f2 and (own < class or f1 < f2) and s1 <= e2 and s2 <= e1 and greatest(s1, s2) div w = bin")
    turned = F.col("f1") > F.col("f2")
    pick = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    return met.select(*[pick(f"{x}{i}", f"{x}{3 - i}", f"{n}{i}") for i in (1, 2) for x, n in (("f", "family_"), ("s", "s"), ("e", "e"))])


def residue_overlap(merged: DataFrame) -> DataFrame:
    """Residues that two families have in common, per pair (family_1 < family_2)."""
    met = overlapping(merged)
    return met.groupBy("family_1", "family_2").agg(F.sum(F.least("e1", "e2") - F.greatest("s1", "s2") + 1).alias("overlap"))
