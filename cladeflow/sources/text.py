"""Text inputs as DataFrames: member and cluster tables, FASTA databases, model libraries.

Every reader returns rows and, apart, a frame of what is wrong with them; ``require`` turns
the first fault into an error on the driver before anything is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cladeflow.functions import names as N
from cladeflow.runtime import filesystem, shared_root

FAMILY = "^[A-Za-z0-9._-]+$"
#: Largest coordinate of a region.
LIMIT = 2**31 - 1


class InputError(ValueError):
    """Input that no run can use; nothing has been written."""


class DuplicateName(InputError):
    """A sequence name that occurs twice where names must be unique."""


def require(faults: DataFrame, error: type[InputError] = InputError) -> None:
    """Raise for the first of ``faults(fault, line)``."""
    for r in faults.orderBy("line").limit(1).collect():
        raise error(f"{r.fault}: {r.line[:200]!r}")


def first_bytes(spark: SparkSession, path: str, most: int = 1 << 16) -> bytes:
    """First bytes of a file in any store that Spark reads, up to its first one that is no white space."""
    fs, p = filesystem(spark, path)
    codec = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(p)
    raw = fs.open(p)
    try:
        source = codec.createInputStream(raw) if codec is not None else raw
        out = bytearray()
        while len(out) < most and (b := source.read()) >= 0:
            out.append(b)
            if len(out) > 1 and bytes([b]).strip():
                break
        return bytes(out)
    finally:
        raw.close()


def by_content(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files of ``paths``; gzip that its name doesn't show is copied under one that does."""
    out, jvm = [], spark.sparkContext._jvm
    for url in spark.read.text(paths).inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(url)).toString()
        if not path.endswith(".gz") and first_bytes(spark, path)[:2] == b"\x1f\x8b":
            (fs, source), target = filesystem(spark, path), f"{shared_root(spark)}/gzip-{uuid.uuid4().hex}.gz"
            to, at = filesystem(spark, target)
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to, at, False, spark.sparkContext._jsc.hadoopConfiguration())
            path = target
        out.append(path)
    return out


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines ended by line feeds only, without trailing carriage returns; gzip by its first bytes."""
    raw = spark.read.option("lineSep", "\n").text(by_content(spark, paths))
    return raw.select(F.rtrim(F.col("value"), F.lit("\r\n")).alias("line"))


def members(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``family, protein, start, end`` of ``family<TAB>member`` rows; blank lines are skipped."""
    return parse_members(lines(spark, paths))


def parse_members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and faults of member lines; works on streams as well, as no row depends on another."""
    rows = rows.where("line <> ''").select("line", F.substring_index("line", "\t", 1).alias("family"), F.substring_index("line", "\t", -1).alias("member"))
    start, end, sliced = N.region(F.col("member"))
    rows = rows.select("line", "family", "member", start.alias("start"), end.alias("end"), sliced.alias("sliced"))
    two = F.octet_length("family") + F.octet_length("member") + 1 == F.octet_length("line")  # not so without a tab, or with more
    in_range = (F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.col("end") <= LIMIT)
    fault = (
        F.when(~two | (F.col("family") == "") | (F.col("member") == ""), "expected two tab-separated fields")
        .when(~F.col("family").rlike(FAMILY) | F.col("family").isin(".", ".."), "unsafe family name")
        .when(F.col("sliced") & ~F.coalesce(in_range, F.lit(False)), f"region outside 1..{LIMIT}")
    )
    # filters stay above a generator: below, they would repeat all that they rest on, in code too long to be compiled
    rows = rows.select("line", "family", "member", "start", "end", "sliced", F.explode(F.array(fault)).alias("fault"))
    protein = F.when(F.col("sliced"), N.before_region(F.col("member"))).otherwise(F.col("member"))
    good = rows.where("fault is null").select("family", protein.alias("protein"), *(F.when(F.col("sliced"), F.col(c)).alias(c) for c in ("start", "end")))
    return good, rows.where("fault is not null").select("fault", "line")


def clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``ord, representative, member`` of headerless two-column rows, in file order.

    Order is data here, and files are read in order of their splits: a line's number is
    found by the RDD's two-pass index, the one thing DataFrames can't express.
    """
    numbered = lines(spark, path).rdd.zipWithIndex().map(lambda x: (x[1], x[0].line))
    rows = spark.createDataFrame(numbered, "ord bigint, line string")
    field = F.split("line", "\t", -1)
    bad = (F.size(field) != 2) | (F.get(field, F.lit(0)) == "") | (F.coalesce(F.get(field, F.lit(1)), F.lit("")) == "")
    good = rows.where(~bad).select("ord", field[0].alias("representative"), field[1].alias("member"))
    return good, rows.where(bad).select(F.format_string("row %d: expected two tab-separated fields", F.col("ord") + 1).alias("fault"), "line")


def fasta(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``name, seq, length`` of FASTA records; sequences are upper-cased.

    Records are split at ``\\n>``: only a file's first one keeps its mark. A file whose
    first line has none is at fault.
    """
    files = by_content(spark, paths)
    unmarked = [f for f in files if (start := first_bytes(spark, f).strip()) and not start.startswith(b">")]
    raw = spark.read.option("lineSep", "\n>").text(files).where("trim(both ' \\r\\n\\t' from value) <> ''")
    body = F.regexp_replace("value", "^\\s*>", "")
    head = F.regexp_extract(body, "^[^\\n]*", 0)
    name = F.regexp_extract(head, "^\\s*(\\S+)", 1)
    parts = F.split(F.substr(body, F.length(head) + 1), "\n")
    seq = F.upper(F.array_join(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, "^[\\s]+|[\\s]+$", ""))), ""))
    rows = raw.select("value", name.alias("name"), seq.alias("seq"))
    nameless = rows.where("name = ''").select(F.lit("record without a name").alias("fault"), F.col("value").alias("line"))
    headless = spark.createDataFrame([("text before the first record", f) for f in unmarked], "fault string, line string")
    return rows.where("name <> ''").select("name", "seq", F.length("seq").cast("bigint").alias("length")), headless.union(nameless)


def duplicates(records: DataFrame, column: str = "name") -> DataFrame:
    again = records.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
    return again.select(F.lit("duplicate name").alias("fault"), F.col(column).alias("line"))


def length_faults(members_: DataFrame, records: DataFrame) -> DataFrame:
    """Whole-protein members whose length is missing, ambiguous or out of range."""
    bare = members_.where("start is null").select("protein").distinct()
    found = bare.join(records.select(F.col("name").alias("protein"), "length"), "protein", "left").groupBy("protein")
    found = found.agg(F.count("length").alias("n"), F.min("length").alias("least"), F.max("length").alias("most"))
    fault = (
        F.when(F.col("n") == 0, "no sequence for whole-protein member")
        .when(F.col("n") > 1, "several sequences for whole-protein member")
        .when((F.col("least") < 1) | (F.col("most") > LIMIT), "sequence length out of range")
    )
    return found.select(fault.alias("fault"), F.col("protein").alias("line")).where("fault is not null")


def models(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of the models in a folder or library, split at their ``//`` lines, in name order."""
    raw = spark.read.option("lineSep", "\n//").text(path).where("trim(both ' \\r\\n\\t' from value) <> ''")
    name: Column = F.regexp_extract("value", "(?m)^NAME\\s+(\\S+)", 1)
    return raw.select(name.alias("name"), F.regexp_replace("value", "^\\s+", "").alias("text")).where("name <> ''").orderBy("name")
