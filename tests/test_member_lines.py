"""Member lines: the grammar against its patterns, and what parsing costs."""

from pyspark.sql import functions as F

from cladeflow.functions import names as N
from cladeflow.plans import mapping
from cladeflow.sources import text as T

ODD = [
    "P", "P/1-2", "/1-2", "P/1-2\n", "a/b/3-4", "P/3-4/5-6", "P/1-", "P/-2", "P/-", "P/1-2-3", "P/١-٢", "P/1_2", "P/01-002", "P/", "/", "x\ny/7-8",
    "P/99999999999999999999-5", "P/1-99999999999999999999", "P/5-4", "P/0-4", "P/1-2147483647", "P/1-2147483648", "P/ 1-2", "é/1-2", "//1-2",
]


def test_regions_are_those_of_the_pattern(spark):
    m = F.col("m")
    rows = spark.createDataFrame([(x,) for x in ODD], "m string")
    start, end, sliced = N.region(m)
    own = rows.select("m", sliced.alias("s"), F.when(sliced, N.before_region(m)).otherwise(m).alias("p"), F.when(sliced, start).alias("a"), F.when(sliced, end).alias("b"))
    want = rows.select("m", m.rlike(N.REGION).alias("s"), N.member_protein(m).alias("p"), *(N.member_bound(m, k).try_cast("bigint").alias(c) for k, c in ((1, "a"), (2, "b"))))
    assert sorted(map(tuple, own.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_lines_are_told_apart(spark):
    lines = ["F\tP/1-2", "F\tP", "F P", "F\tP\tx", "\tP", "F\t", "\t", "..\tP", "F*\tP", "F\tP/5-4", "F\tP/1-2147483648", "", "F\t\t", "F\tP/99999999999999999999-5"]
    good, faults = T.parse_members(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert sorted(map(tuple, good.collect()), key=str) == [("F", "P", 1, 2), ("F", "P", None, None)]
    kinds = {r.line: r.fault.split(" ")[0] for r in faults.collect()}
    assert kinds == dict.fromkeys(["F P", "F\tP\tx", "\tP", "F\t", "\t", "F\t\t"], "expected") | dict.fromkeys(["..\tP", "F*\tP"], "unsafe") | dict.fromkeys(["F\tP/5-4", "F\tP/1-2147483648", "F\tP/99999999999999999999-5"], "region")


def test_a_line_is_matched_once(spark, sf):
    """No filter repeats the patterns, and lines of the tables meet parts once."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_name").alias("line"))
    for frame in T.parse_members(rows):
        assert frame._jdf.queryExecution().executedPlan().toString().count("RLIKE") <= 2
    assert mapping.members(spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
