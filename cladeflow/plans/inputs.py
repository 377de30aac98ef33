"""Queries that go through text files: the driver's tables are written as a user's inputs and read back.

Also the rules on names, thresholds and reports that the commands apply to what they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeflow.functions import names as N
from cladeflow.operators import families as O
from cladeflow.plans.families import _aligned, _clusters, _hits, _member_names, _recruits
from cladeflow.plans.mapping import HITS_SQL, RAW_SQL, lengths, members
from cladeflow.runtime import Scratch, table
from cladeflow.sources import text as T


def _written(rows: DataFrame, scratch: Scratch, name: str, **options: str) -> str:
    """``rows`` of one string column as a folder of text files."""
    path = scratch.path(name)
    writer = rows.write
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.text(path)
    return path


def read_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member tables in two folders, one of them gzipped, the other with carriage returns and blank lines."""
    scratch = Scratch(spark, "read-members")
    line = F.concat("family", F.lit("\t"), "member")
    first = _written(_member_names(spark, sf_dir, "F").select(line.alias("line")), scratch, "first", compression="gzip")
    rest = _member_names(spark, sf_dir, "GH").select(F.concat(line, F.lit("\r\n")).alias("line"))
    good, faults = T.members(spark, [first, _written(rest, scratch, "rest")])
    T.require(faults)
    zero = F.lit(0).cast("bigint")
    return good.select("family", "protein", F.coalesce("start", zero).alias("start"), F.coalesce("end", zero).alias("end"))


def member_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as member lines, of which each sort of key breaks another rule."""
    key = F.col("c_custkey")
    line = (
        F.when(key % 5 == 0, F.concat_ws("\t", F.lit("F1"), "c_name", F.lit("x")))
        .when(key % 5 == 1, F.concat_ws("\t", F.lit("no family"), "c_name"))
        .when(key % 5 == 2, F.concat_ws("\t", F.lit("F1"), F.concat("c_name", F.lit("/"), key, F.lit("-"), F.col("c_nationkey"))))
        .otherwise(F.concat_ws("\t", F.lit("F1"), "c_name"))
    )
    scratch = Scratch(spark, "member-faults")
    _, faults = T.members(spark, _written(table(spark, sf_dir, "customer").select(line.alias("line")), scratch, "lines"))
    return faults.groupBy("fault").agg(F.count("*").alias("n"))


def read_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cluster rows of one file, in the order of their keys."""
    scratch = Scratch(spark, "read-clusters")
    line = _clusters(spark, sf_dir).repartition(1).sortWithinPartitions("ord").select(F.concat("representative", F.lit("\t"), "member").alias("line"))
    good, faults = T.clusters(spark, _written(line, scratch, "lines"))
    T.require(faults)
    return good


def cluster_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cluster rows: some lack a field, some have one too many, some have an empty one."""
    key = F.col("s_suppkey")
    line = F.when(key % 4 == 0, F.col("s_name")).when(key % 4 == 1, F.concat("s_name", F.lit("\t"))).when(key % 4 == 2, F.concat_ws("\t", "s_name", "s_name", "s_name")).otherwise(F.concat_ws("\t", "s_name", "s_name"))
    rows = table(spark, sf_dir, "supplier").repartition(1).sortWithinPartitions("s_suppkey").select(line.alias("line"))
    _, faults = T.clusters(spark, _written(rows, Scratch(spark, "cluster-faults"), "lines"))
    return faults.select("fault", "line")


def read_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of three lines, with a description and white space around the residues."""
    record = F.concat(F.lit(">P"), F.col("p_partkey"), F.lit(" a part\n"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit(" \n\t"), F.replace("p_type", F.lit(" "), F.lit("")))
    good, faults = T.fasta(spark, _written(table(spark, sf_dir, "part").select(record.alias("line")), Scratch(spark, "read-fasta"), "records"))
    T.require(faults)
    return good


def length_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole proteins whose length is missing (cheap parts have no record) or told twice."""
    own = lengths(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("protein"), "p_partkey", "p_retailprice"), "protein")
    records = own.where("p_retailprice >= 1400").unionByName(own.where("p_retailprice >= 1400 and p_partkey % 7 = 0"))
    return T.length_faults(members(spark, sf_dir), records.select(F.col("protein").alias("name"), "length")).select("fault", F.col("line").alias("protein"))


def reported_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by family that clear the reporting threshold, taxes as E-values."""
    kept = O.reported(_hits(spark, sf_dir).withColumn("evalue", F.col("tax").cast("double")), 0.03)
    return kept.groupBy("family").agg(F.count("*").alias("hits"), F.min("score").cast("double").alias("least_score"))


def starting_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that keep enough of their members to start a family."""
    found = O.membership(_clusters(spark, sf_dir), _recruits(spark, sf_dir, "R"))
    return found.where(F.col("recruited") > 0).select("representative", "members", "recruited", (F.col("membership") >= 0.6).alias("kept"))


def external_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of hits, padded with gaps, named in coordinates of their proteins."""
    rows = O.recruit(_hits(spark, sf_dir).withColumn("seq", F.upper("seq")), None, 0.9, leaving=True)
    rows = rows.select("row_name", F.concat(F.lit("--"), F.lower("row"), F.lit("..")).alias("row"), "seq").distinct()
    return rows.select("row_name", N.external_name(F.col("row_name"), F.col("row"), F.col("seq")).alias("name"))


def residue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, columns and residues of each alignment."""
    n = F.length(N.residues(F.col("aligned"))).cast("bigint")
    return _aligned(spark, sf_dir).withColumn("n", n).groupBy("family").agg(
        F.count("*").alias("rows"), F.max(F.length("aligned")).cast("bigint").alias("columns"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.sum("n").alias("residues")
    )


QUERIES = {
    "read_members": read_members,
    "member_faults": member_faults,
    "read_clusters": read_clusters,
    "cluster_faults": cluster_faults,
    "read_fasta": read_fasta,
    "length_faults": length_faults,
    "reported_hits": reported_hits,
    "starting_membership": starting_membership,
    "external_names": external_names,
    "residue_counts": residue_counts,
}

_CLUSTER_HITS = (
    "c as (select concat('C', o_custkey) representative, o_orderkey, "
    "exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') got from orders)"
)

ORACLES = {
    "read_members": f'with {RAW_SQL} select family, protein, coalesce(s, 0) as start, coalesce(e, 0) as "end" from members',
    "member_faults": """select case c_custkey % 5 when 0 then 'expected two tab-separated fields' when 1 then 'unsafe family name' else 'region outside 1..2147483647' end fault, count(*) n
        from customer where c_custkey % 5 < 2 or (c_custkey % 5 = 2 and c_custkey > c_nationkey) group by 1""",
    "read_clusters": "select row_number() over (order by o_orderkey) - 1 as ord, concat('C', o_custkey) representative, concat('O', o_orderkey) as member from orders",
    "cluster_faults": """select concat('row ', n, ': expected two tab-separated fields') fault,
        case s_suppkey % 4 when 0 then s_name when 1 then concat(s_name, chr(9)) else concat(s_name, chr(9), s_name, chr(9), s_name) end line
        from (select *, row_number() over (order by s_suppkey) n from supplier) where s_suppkey % 4 < 3""",
    "read_fasta": """select concat('P', p_partkey) as name, upper(replace(concat(p_name, p_type), ' ', '')) seq, length(replace(concat(p_name, p_type), ' ', '')) as length from part""",
    "length_faults": f"""with {RAW_SQL}, bare as (select distinct protein from members where s is null),
        records as (select concat('P', p_partkey) protein, p_partkey % 7 = 0 twice from part where p_retailprice >= 1400)
        select case when r.protein is null then 'no sequence for whole-protein member' else 'several sequences for whole-protein member' end fault, b.protein
        from bare b left join records r on b.protein = r.protein where r.protein is null or twice""",
    "reported_hits": f"with {HITS_SQL} select family, count(*) hits, cast(min(score) as double) least_score from hits where cast(tax as double) <= 0.03 group by family",
    "starting_membership": f"""with {_CLUSTER_HITS} select representative, count(*) members, count(*) filter (got) recruited, (count(*) filter (got))::double / count(*) >= 0.6 kept
        from c group by representative having bool_or(got)""",
    "external_names": f"""with {HITS_SQL} select distinct concat(target, case when env_to - env_from + 1 < tlen then concat('/', env_from, '_', env_to) else '' end) row_name,
        concat(split_part(target, '_', 1), '/', env_from, '-', env_to) as name from hits""",
    "residue_counts": """select c_mktsegment family, count(*) as rows, cast(max(length(c_name)) as bigint) as columns, min(n) shortest, max(n) longest, cast(sum(n) as bigint) residues
        from (select *, length(replace(c_name, '0', '')) n from customer) group by c_mktsegment""",
}
