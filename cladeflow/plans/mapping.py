"""Protein tables derived from the driver's tables: the same rules in DataFrame form and in SQL.

Parts are proteins, supplier groups are families F0..F24. G families leave out untaxed
rows and H families undiscounted ones (shifted by three residues), so that F, G and H of a
group are near copies and clans are not empty. Rows of every 101st order have no bounds
and take their protein's whole length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeflow.runtime import table

GROUPS = 25

RAW_SQL = """
base as (
  select l_suppkey % 25 k, l_orderkey ok, l_linenumber ln, l_tax tax, l_discount discount,
         concat('P', l_partkey) protein, cast(150 + 3 * p_size as bigint) len,
         cast(1 + (l_suppkey % 25 * 17) % 90 + l_linenumber * 2 as bigint) s0, cast(l_quantity as bigint) q
  from lineitem join part on l_partkey = p_partkey),
members as (
  select concat('F', k) family, protein, len, case when ok % 101 = 0 then null else s0 end s,
         case when ok % 101 = 0 then null else least(len, s0 + q) end e from base
  union all
  select concat('G', k), protein, len, case when ok % 101 = 0 then null else s0 end,
         case when ok % 101 = 0 then null else least(len, s0 + q) end from base where tax > 0.005
  union all
  select concat('H', k), protein, len, s0 + 3, least(len, s0 + 3 + q) from base where discount > 0.005),
intervals as (select distinct family, protein, coalesce(s, 1) s, coalesce(e, len) e from members)"""

MERGED_SQL = (
    RAW_SQL
    + """,
flagged as (
  select *, case when s <= 1 + max(e) over (partition by protein, family order by s, e rows between unbounded preceding and 1 preceding)
            then 0 else 1 end f from intervals),
islands as (select *, sum(f) over (partition by protein, family order by s, e rows unbounded preceding) i from flagged),
merged as (select protein, family, min(s) s, max(e) e from islands group by protein, family, i)"""
)

PAIRS_SQL = (
    MERGED_SQL
    + """,
totals as (select family, cast(sum(e - s + 1) as bigint) residues, count(distinct protein) proteins from merged group by family),
pf as (select distinct protein, family from merged),
shared as (
  select a.family family_1, b.family family_2, count(*) shared_proteins
  from pf a join pf b on a.protein = b.protein and a.family < b.family group by all),
lap as (
  select a.family family_1, b.family family_2, cast(sum(least(a.e, b.e) - greatest(a.s, b.s) + 1) as bigint) overlap
  from merged a join merged b on a.protein = b.protein and a.family < b.family and a.s <= b.e and b.s <= a.e group by all),
pairs as (
  select s.family_1, s.family_2, shared_proteins, coalesce(overlap, 0) overlap,
         x.proteins + y.proteins - shared_proteins protein_union,
         x.residues + y.residues - coalesce(overlap, 0) residue_union, least(x.residues, y.residues) smaller
  from shared s left join lap l on s.family_1 = l.family_1 and s.family_2 = l.family_2
  join totals x on x.family = s.family_1 join totals y on y.family = s.family_2)"""
)


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("protein"), F.expr("cast(150 + 3 * p_size as bigint)").alias("length"))


def members(spark: SparkSession, sf_dir: str, marks: str = "FGH") -> DataFrame:
    """``family, protein, start, end`` of the families with these marks; bounds are null for whole proteins.

    Lines meet parts once, whatever the number of marks.
    """
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    base = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.expr(f"l_suppkey % {GROUPS}").alias("k"),
        F.expr("l_orderkey % 101 = 0").alias("bare"),
        F.col("l_tax"),
        F.col("l_discount"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("protein"),
        F.expr("cast(150 + 3 * p_size as bigint)").alias("len"),
        F.expr(f"cast(1 + (l_suppkey % {GROUPS} * 17) % 90 + l_linenumber * 2 as bigint)").alias("s0"),
        F.col("l_quantity").cast("bigint").alias("q"),
    )
    start, end = F.when(~F.col("bare"), F.col("s0")), F.when(~F.col("bare"), F.least("len", F.col("s0") + F.col("q")))
    one = lambda mark, s, e: F.struct(F.concat(F.lit(mark), F.col("k")).alias("family"), F.col("protein"), s.alias("start"), e.alias("end"))
    each = {
        "F": one("F", start, end),
        "G": F.when(F.col("l_tax") > 0.005, one("G", start, end)),
        "H": F.when(F.col("l_discount") > 0.005, one("H", F.col("s0") + 3, F.least("len", F.col("s0") + 3 + F.col("q")))),
    }
    return base.select(F.inline(F.array_compact(F.array(*(each[m] for m in marks)))))


# Hits: suppliers' groups as query models, parts as database records, prices as scores.
HITS_SQL = """
hits as (
  select concat('F', l_suppkey % 25) family, concat('P', l_partkey, '_', 1, '_', length(p_name) + length(p_type)) target,
         concat(p_name, p_type) seq, length(p_name) + length(p_type) tlen, cast(l_linenumber as bigint) env_from,
         least(length(p_name) + length(p_type), l_linenumber + cast(l_quantity as bigint)) env_to, l_extendedprice score,
         l_orderkey ok, l_linenumber ln, l_shipdate shipped, l_discount discount, l_tax tax
  from lineitem join part on l_partkey = p_partkey)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    seq, tlen = F.concat("p_name", "p_type"), (F.length("p_name") + F.length("p_type")).cast("bigint")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("F"), F.expr(f"l_suppkey % {GROUPS}")).alias("family"),
        F.concat(F.lit("P"), F.col("l_partkey"), F.lit("_1_"), tlen.cast("string")).alias("target"),
        seq.alias("seq"),
        tlen.alias("tlen"),
        F.col("l_linenumber").cast("bigint").alias("env_from"),
        F.least(tlen, F.col("l_linenumber") + F.col("l_quantity").cast("bigint")).alias("env_to"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_shipdate").alias("shipped"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )
