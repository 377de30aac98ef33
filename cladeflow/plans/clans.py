"""Queries of the clan operators over the driver's tables, and their SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeflow.operators import clans as C, intervals as I, similarity as S
from cladeflow.plans.mapping import MERGED_SQL, PAIRS_SQL, RAW_SQL, lengths, members
from cladeflow.runtime import Scratch


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.resolve_lengths(members(spark, sf_dir), lengths(spark, sf_dir))


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_intervals(_intervals(spark, sf_dir))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged intervals, written once: every similarity operator reads them."""
    return Scratch(spark, "merged").put(_islands(spark, sf_dir), "merged")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.family_pairs(_merged(spark, sf_dir))


def _clans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clans(S.clan_edges(_pairs(spark, sf_dir)), Scratch(spark, "clans"))


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole proteins without a length, where only parts above the median price have one."""
    from cladeflow.runtime import table

    dear = table(spark, sf_dir, "part").where("p_retailprice >= 1400").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("protein"))
    return I.missing_lengths(members(spark, sf_dir), dear)


QUERIES = {
    "member_intervals": lambda s, d: _intervals(s, d).distinct(),
    "whole_protein_lengths": lambda s, d: I.resolve_lengths(members(s, d).where("start is null"), lengths(s, d)),
    "missing_lengths": missing,
    "merged_intervals": _islands,
    "family_totals": lambda s, d: I.family_totals(_islands(s, d)),
    "protein_fanout": lambda s, d: I.protein_fanout(_islands(s, d)),
    "shared_proteins": lambda s, d: I.shared_proteins(_merged(s, d)),
    "residue_overlap": lambda s, d: I.residue_overlap(_merged(s, d)),
    "similarity_edges": lambda s, d: S.edges(_pairs(s, d)),
    "clan_edges": lambda s, d: S.clan_edges(_pairs(s, d)).select("family_1", "family_2", F.format_number("weight", 6).alias("weight")),
    "edges_at_thresholds": lambda s, d: S.edges(_pairs(s, d), S.parse_threshold("0.25"), S.parse_threshold("0.750000")).select("family_1", "family_2"),
    "near_redundant": lambda s, d: _pairs(s, d).where(S.at_least(F.col("overlap"), F.col("residue_union"), Fraction(85, 100))).select("family_1", "family_2"),
    "similarity_summary": lambda s, d: S.summary(_pairs(s, d), near=Fraction(85, 100)),
    "clan_components": lambda s, d: _clans(s, d).select("clan_number", "family_id"),
    "clan_representatives": lambda s, d: _clans(s, d).where("is_representative").select("clan_number", F.col("family_id").alias("representative")),
    "clan_size_histogram": lambda s, d: C.size_histogram(_clans(s, d)),
}

_CLANS_SQL = (
    PAIRS_SQL
    + """,
ce as (select family_1, family_2, cast(overlap as double) / cast(residue_union as double) w from pairs where 2 * overlap >= residue_union),
both_ways as (select family_1 a, family_2 b from ce union all select family_2, family_1 from ce),
reach(a, b) as (select a, a from both_ways union select r.a, x.b from reach r join both_ways x on r.b = x.a),
labels as (select a family, min(b) label from reach group by a),
sides as (select family_1 family, 0 side, family_2 other, w from ce union all select family_2, 1, family_1, w from ce),
degrees as (select family, list_reduce(list(w order by side, other), lambda x, y: x + y) degree from sides group by family),
ranked as (select family, label, count(*) over (partition by label) size,
                  row_number() over (partition by label order by degree desc, family) r from labels join degrees using (family)),
numbered as (select label, family representative, size, cast(row_number() over (order by size desc, family) as bigint) clan_number from ranked where r = 1)"""
)

ORACLES = {
    "member_intervals": f"with {RAW_SQL} select family, protein, s as start, e as \"end\" from intervals",
    "whole_protein_lengths": f"with {RAW_SQL} select distinct family, protein, cast(1 as bigint) as start, len as \"end\" from members where s is null",
    "missing_lengths": f"with {RAW_SQL} select distinct protein from members where s is null and protein not in (select concat('P', p_partkey) from part where p_retailprice >= 1400)",
    "merged_intervals": f"with {MERGED_SQL} select protein, family, s as start, e as \"end\" from merged",
    "family_totals": f"with {MERGED_SQL} select family, cast(sum(e - s + 1) as bigint) residues, count(distinct protein) proteins from merged group by family",
    "protein_fanout": f"with {MERGED_SQL} select protein, n families, n * (n - 1) // 2 pairs from (select protein, count(distinct family) n from merged group by protein)",
    "shared_proteins": f"with {PAIRS_SQL} select * from shared",
    "residue_overlap": f"with {PAIRS_SQL} select * from lap",
    "similarity_edges": f"""with {PAIRS_SQL} select family_1, family_2, shared_proteins,
        printf('%.6f', shared_proteins::double / protein_union::double) protein_jaccard, printf('%.6f', overlap::double / residue_union::double) residue_jaccard,
        printf('%.6f', overlap::double / smaller::double) residue_containment from pairs where 10 * overlap >= residue_union or 2 * overlap >= smaller""",
    "clan_edges": f"with {PAIRS_SQL} select family_1, family_2, printf('%.6f', overlap::double / residue_union::double) weight from pairs where 2 * overlap >= residue_union",
    "edges_at_thresholds": f"with {PAIRS_SQL} select family_1, family_2 from pairs where 4 * overlap >= residue_union or 4 * overlap >= 3 * smaller",
    "near_redundant": f"with {PAIRS_SQL} select family_1, family_2 from pairs where 100 * overlap >= 85 * residue_union",
    "similarity_summary": f"""with {PAIRS_SQL} select count(*) pairs_sharing_proteins, count(*) filter (10 * overlap >= residue_union or 2 * overlap >= smaller) edges,
        count(*) filter (100 * overlap >= 85 * residue_union) near_redundant_pairs from pairs""",
    "clan_components": f"with recursive {_CLANS_SQL} select clan_number, family as family_id from labels join numbered using (label)",
    "clan_representatives": f"with recursive {_CLANS_SQL} select clan_number, representative from numbered",
    "clan_size_histogram": f"with recursive {_CLANS_SQL} select size, count(*) clans from numbered group by size",
}
