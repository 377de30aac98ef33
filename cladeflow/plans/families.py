"""Queries of the family operators over the driver's tables, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeflow.functions import names as N
from cladeflow.operators import families as O
from cladeflow.operators.rounds import Options, default_kernels, from_models, search
from cladeflow.plans.mapping import HITS_SQL, RAW_SQL, hits, members
from cladeflow.runtime import table

QLEN, SHARE = 15, 0.9


def _member_names(spark: SparkSession, sf_dir: str, marks: str = "FGH") -> DataFrame:
    name = F.when(F.col("start").isNull(), F.col("protein")).otherwise(F.concat("protein", F.lit("/"), "start", F.lit("-"), "end"))
    return members(spark, sf_dir, marks).select("family", name.alias("member"))


def split_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds are 0 for whole proteins."""
    m, zero = F.col("member"), F.lit(0).cast("bigint")
    bounds = [F.coalesce(N.member_bound(m, i).cast("bigint"), zero).alias(n) for i, n in ((1, "start"), (2, "end"))]
    return _member_names(spark, sf_dir).select("family", "member", N.member_protein(m).alias("protein"), *bounds)


def split_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices are told by their length: customers' names with balances as bounds rarely fit."""
    h = hits(spark, sf_dir).select("target", "tlen").distinct()
    c = table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit("_"), F.col("c_nationkey"), F.lit("_"), F.col("c_custkey")).alias("target"), F.lit(7).cast("bigint").alias("tlen"))
    both = h.unionByName(c).withColumn("s", N.slice_of(F.col("target"), F.col("tlen")))
    return both.select("target", "tlen", F.coalesce("s.protein", "target").alias("protein"), F.coalesce("s.start", F.lit(0).cast("bigint")).alias("start"))


def encode_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("/", "p_brand", "p_type", F.concat(F.col("p_size").cast("string"), F.lit("%")), F.lit("%2F"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("encoded", N.encode_record(F.col("name")))


def strip_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.col("encoded"), F.when(F.col("p_partkey") % 2 == 0, "/1_10").otherwise(""))
    return encode_names(spark, sf_dir).withColumn("row_name", row).withColumn("record", N.strip_envelope(F.col("row_name"))).select("p_partkey", "row_name", "record")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).withColumn("qlen", F.lit(QLEN).cast("bigint"))


def envelope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _hits(spark, sf_dir).where(O.long_enough(F.col("env_from"), F.col("env_to"), F.col("qlen"), SHARE))
    return kept.groupBy("family").agg(F.count("*").alias("kept"), F.sum(F.col("env_to") - F.col("env_from") + 1).alias("residues"))


def masked_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.recruit(_hits(spark, sf_dir), None, SHARE, leaving=True).select("row_name", "row").distinct()


def located_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without their first and last residue, found again within their envelopes."""
    rows = O.recruit(_hits(spark, sf_dir), None, SHARE, leaving=True).where("length(row) > 2").select("row_name", "row", "seq", "env_from", "env_to").distinct()
    sought = F.substring(F.col("row"), F.lit(2), F.length("row") - 2)
    return rows.select("row_name", N.located(sought, F.col("seq"), F.col("env_from"), F.col("env_to")).cast("bigint").alias("at"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("C"), F.col("o_custkey")).alias("representative"), F.concat(F.lit("O"), F.col("o_orderkey")).alias("member"))


def _recruits(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    got = line.where(F.col("l_returnflag") == flag).select("l_orderkey").distinct()
    kept = o.join(got, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return kept.select(F.concat(F.lit("C"), F.col("o_custkey")).alias("representative"), F.concat(F.lit("O"), F.col("o_orderkey")).alias("member"))


def cluster_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.membership(_clusters(spark, sf_dir), _recruits(spark, sf_dir, "R"))
    return found.select("representative", "members", "recruited", F.format_number("membership", 6).alias("membership"))


def _order() -> list:
    return [F.desc("score"), "target", "env_from", "env_to", "ok", "ln", "shipped", "discount", "tax"]


def family_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of clusters of which any member is still recruited."""
    outcome = F.when(F.col("recruited") > 0, "successful").otherwise("few seed sequences remained")
    found = O.membership(_clusters(spark, sf_dir), _recruits(spark, sf_dir, "R")).withColumn("outcome", outcome)
    return O.success_ranks(found.join(O.numbered_clusters(_clusters(spark, sf_dir)).select("representative", "cluster_ord"), "representative")).select("representative", "family_id")


def representative_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.representatives(O.ranked(hits(spark, sf_dir), *_order()), "target", "env_from", "env_to")


def _by_family(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("representative", "family")


def new_recruits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.new_recruits(_by_family(_recruits(spark, sf_dir, "N")), _by_family(_recruits(spark, sf_dir, "R")))


def converged_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.converged(_by_family(_recruits(spark, sf_dir, "R")), _by_family(_recruits(spark, sf_dir, "N")))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names are rows of equal width; zeros read as gaps."""
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("family"), F.col("c_custkey").alias("row"), F.translate("c_name", "0", "-").alias("aligned"))


def clip_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _aligned(spark, sf_dir)
    return O.clip(rows, O.trim_positions(O.column_occupancy(rows), 0.5))


def clip_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names with their outer letters before the first and after the last ``e`` as unmatched."""
    rf = F.regexp_replace("p_name", "[^e]", ".")
    span = O.reference_span(rf)
    cut = F.when(span.isNull(), F.col("p_name")).otherwise(F.substring(F.col("p_name"), span["first"], span["last"] - span["first"] + 1))
    return table(spark, sf_dir, "part").select("p_partkey", cut.alias("aligned"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.length(F.concat("p_name", "p_type")) + F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey"), length.cast("bigint").alias("length"), F.coalesce(O.length_reason(length, 25, 60), F.lit("successful")).alias("outcome")
    )


def delta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _outcomes(spark, sf_dir)
    size = F.when(F.col("outcome") == "successful", F.col("length"))
    line = O.delta_line(F.col("p_partkey"), F.col("length"), size, O.python_bool(F.when(size.isNotNull(), F.col("length") > 40)), F.col("outcome"))
    return x.select(line.alias("line"))


def profile_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the market segments, sought in all nations' and customers' names (own kernels: no SQL)."""
    kernels = default_kernels()
    segments = [r.s for r in table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("s")).distinct().orderBy("s").collect()]
    models = [kernels.build(s, [(s, s)] * 4) for s in segments]
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("name"), F.upper("n_name").alias("seq"))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("name"), F.upper(F.concat("c_mktsegment", "c_name")).alias("seq"))
    both = nations.unionByName(customers)
    found = search(from_models(spark, models, Options(recruit_evalue_cutoff=10.0)), both, both.count(), Options(recruit_evalue_cutoff=10.0), kernels)
    return O.ranked(found, F.asc("evalue"), F.desc("score"), F.asc("target"), F.asc("env_from")).drop("seq")


def representative_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stand for the rest of their region, of nations' names as an alignment (own kernels: no SQL)."""
    kernels = default_kernels()

    def trim(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n_nationkey")
        kept, _ = kernels.representatives(list(zip(rows["n_name"], rows["aligned"], strict=True)), 0.5, 2000)
        return pd.DataFrame({"region": key[0], "name": [n for n, _ in kept], "aligned": [r for _, r in kept]})

    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name", F.rpad("n_name", 20, "-").alias("aligned"))
    return rows.groupBy("n_regionkey").applyInPandas(trim, "region bigint, name string, aligned string")


QUERIES = {
    "profile_search": profile_search,
    "representative_trim": representative_trim,
    "split_member": split_member,
    "split_slice": split_slice,
    "encode_names": encode_names,
    "strip_envelope": strip_envelope,
    "envelope_filter": envelope_filter,
    "masked_sequences": masked_sequences,
    "located_residues": located_residues,
    "cluster_groups": lambda s, d: O.numbered_clusters(_clusters(s, d)),
    "cluster_membership": cluster_membership,
    "family_rank": family_rank,
    "hit_order": lambda s, d: O.ranked(hits(s, d), *_order()).select("family", "hit_rank", "target", "env_from", "env_to"),
    "representative_row": representative_row,
    "new_recruits": new_recruits,
    "converged_families": converged_families,
    "column_occupancy": lambda s, d: O.column_occupancy(_aligned(s, d)),
    "clip_ends": clip_ends,
    "clip_reference": clip_reference,
    "discard_reasons": lambda s, d: O.reasons(_outcomes(s, d)),
    "length_histogram": lambda s, d: O.histogram(_outcomes(s, d).where("outcome = 'successful'"), "length"),
    "delta_report": delta_report,
}

_NAMES = f"with {RAW_SQL}, named as (select family, case when s is null then protein else concat(protein, '/', s, '-', e) end as member from members)"
_HITS = f"with {HITS_SQL}"
_RANKED = _HITS + ", ranked as (select *, row_number() over (partition by family order by score desc, target, env_from, env_to, ok, ln, shipped, discount, tax) hit_rank from hits)"
_PARTS = "select p_partkey, concat(p_brand, '/', p_type, '/', p_size, '%/%2F') as name from part"
_CLUSTERS = (
    "with clusters as (select o_orderkey ord, concat('C', o_custkey) representative, concat('O', o_orderkey) as member, "
    "exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') got, "
    "exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'N') fresh from orders)"
)
_ALIGNED = (
    "with rows_ as (select c_mktsegment family, c_custkey as row, replace(c_name, '0', '-') aligned from customer), "
    "chars as (select family, unnest(generate_series(1, length(aligned))) col, aligned from rows_), "
    "occupancy as (select family, col, count(*) filter (substr(aligned, col, 1) <> '-') filled, count(*) as rows from chars group by family, col)"
)
_OUTCOMES = (
    "with x as (select p_partkey, length(p_name) + length(p_type) + p_size as length from part), "
    "outcomes as (select p_partkey, cast(length as bigint) as length, case when length < 25 then 'family representative length too small' "
    "when length > 60 then 'family representative length too large' else 'successful' end outcome from x)"
)

ORACLES = {
    "split_member": _NAMES
    + """ select family, member, case when regexp_matches(member, '^.+/[0-9]+-[0-9]+$') then regexp_extract(member, '^(.+)/[0-9]+-[0-9]+$', 1) else member end protein,
        coalesce(try_cast(regexp_extract(member, '^.+/([0-9]+)-[0-9]+$', 1) as bigint), 0) as start, coalesce(try_cast(regexp_extract(member, '^.+/[0-9]+-([0-9]+)$', 1) as bigint), 0) as "end" from named""",
    "split_slice": _HITS
    + """, both_ as (select distinct target, tlen from hits union all select concat(c_name, '_', c_nationkey, '_', c_custkey), 7 from customer),
        cut as (select target, cast(tlen as bigint) tlen, regexp_extract(target, '^(.+)_[0-9]+_[0-9]+$', 1) protein, cast(regexp_extract(target, '^.+_([0-9]+)_[0-9]+$', 1) as bigint) s,
                cast(regexp_extract(target, '_([0-9]+)$', 1) as bigint) e from both_)
        select target, tlen, case when e - s + 1 = tlen then protein else target end protein, case when e - s + 1 = tlen then s else 0 end as start from cut""",
    "encode_names": f"select p_partkey, name, replace(replace(name, '%', '%25'), '/', '%2F') encoded from ({_PARTS})",
    "strip_envelope": f"select p_partkey, concat(replace(replace(name, '%', '%25'), '/', '%2F'), case when p_partkey % 2 = 0 then '/1_10' else '' end) row_name, name record from ({_PARTS})",
    "envelope_filter": f"{_HITS} select family, count(*) kept, cast(sum(env_to - env_from + 1) as bigint) residues from hits where env_to - env_from + 1 >= {SHARE} * {QLEN} group by family",
    "masked_sequences": f"""{_HITS} select distinct concat(target, case when env_to - env_from + 1 < tlen then concat('/', env_from, '_', env_to) else '' end) row_name,
        substr(seq, env_from, env_to - env_from + 1) as row from hits""",
    "located_residues": f"""{_HITS}, rows_ as (select distinct concat(target, case when env_to - env_from + 1 < tlen then concat('/', env_from, '_', env_to) else '' end) row_name,
        substr(seq, env_from, env_to - env_from + 1) part, env_from from hits)
        select row_name, cast(strpos(part, substr(part, 2, length(part) - 2)) + env_from - 1 as bigint) as at from rows_ where length(part) > 2""",
    "cluster_groups": f"{_CLUSTERS} select representative, count(*) members, row_number() over (order by min(ord)) cluster_ord from clusters group by representative",
    "cluster_membership": f"""{_CLUSTERS} select representative, count(distinct member) members, count(distinct member) filter (got) recruited,
        printf('%.6f', (count(distinct member) filter (got))::double / (count(distinct member))::double) membership from clusters group by representative""",
    "family_rank": f"""{_CLUSTERS}, firsts as (select representative, min(ord) o, bool_or(got) g from clusters group by representative)
        select representative, row_number() over (order by o) family_id from firsts where g""",
    "hit_order": f"{_RANKED} select family, hit_rank, target, env_from, cast(env_to as bigint) env_to from ranked",
    "representative_row": f"{_RANKED} select family, target, env_from, cast(env_to as bigint) env_to from ranked where hit_rank = 1",
    "new_recruits": f"{_CLUSTERS} select distinct representative family, member from clusters where fresh and not got",
    "converged_families": f"{_CLUSTERS} select representative family from clusters where got group by representative having bool_and(fresh)",
    "column_occupancy": f"{_ALIGNED} select family, col, filled, rows from occupancy",
    "clip_ends": f"""{_ALIGNED}, spans as (select family, min(col) a, max(col) b from occupancy where filled / rows > 0.5 group by family)
        select family, row, case when a is null then aligned else substr(aligned, a, b - a + 1) end aligned from rows_ left join spans using (family)""",
    "clip_reference": "select p_partkey, case when strpos(p_name, 'e') = 0 then p_name else substr(p_name, strpos(p_name, 'e'), length(p_name) - strpos(p_name, 'e') + 2 - strpos(reverse(p_name), 'e')) end aligned from part",
    "discard_reasons": f"{_OUTCOMES} select outcome reason, count(*) n from outcomes where outcome <> 'successful' group by outcome",
    "length_histogram": f"{_OUTCOMES} select length as value, count(*) n from outcomes where outcome = 'successful' group by length",
    "delta_report": f"""{_OUTCOMES} select concat(p_partkey, ',', length, ',', case when outcome = 'successful' then cast(length as varchar) else '' end, ',',
        case when outcome <> 'successful' then '' when length > 40 then 'True' else 'False' end, ',', outcome) line from outcomes""",
}
