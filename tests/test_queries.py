"""Every query with SQL against DuckDB, and the operators' special cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cladeflow.operators import components, families as O, intervals as I
from cladeflow.runtime import Scratch

ORACLES = entry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in ORACLES if not n.startswith("op")])
def test_query_equals_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, result.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(entry.queries())


def test_own_kernels_have_rows(spark, sf):
    rows = entry.queries()["profile_search"](spark, sf).collect()
    assert rows and all(1 <= r.env_from <= r.env_to <= r.tlen for r in rows)
    assert 0 < entry.queries()["representative_trim"](spark, sf).count() <= 25


def test_llm_folder_is_optional():
    """Without the corpus operators the entry point and all else must still import."""
    import subprocess
    import sys

    code = "import sys; sys.modules['cladeflow.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'similarity_edges' in e.queries() and not any(n.startswith('op1') for n in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


@pytest.mark.parametrize("n", [2, 61])
def test_components_of_paths_and_rings(spark, n):
    edges = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(n - 1)] + [("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("y", "y"), (None, "q")]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark, "t")).collect()}
    assert got == {f"a{i:03d}": "a000" for i in range(n)} | {"z1": "z1", "z2": "z1", "z3": "z1", "y": "y"}
    empty = spark.createDataFrame([], "a string, b string")
    assert components.connected_components(empty, Scratch(spark, "t")).count() == 0


def test_merge_joins_adjacent(spark):
    rows = [("P", "f", 1, 5), ("P", "f", 6, 8), ("P", "f", 10, 15), ("P", "g", 1, 3), ("P", "f", 2, 3)]
    df = spark.createDataFrame(rows, "protein string, family string, start bigint, end bigint")
    got = sorted(tuple(r) for r in I.merge_intervals(df).select("protein", "family", "start", "end").collect())
    assert got == [("P", "f", 1, 8), ("P", "f", 10, 15), ("P", "g", 1, 3)]


def test_reference_span(spark):
    df = spark.createDataFrame([("..x.x..",), ("xx",), ("...",), ("",)], "rf string")
    got = [r[0] and tuple(r[0]) for r in df.select(O.reference_span(F.col("rf"))).collect()]
    assert got == [(3, 5), (1, 2), None, None]


def test_filters_reach_the_scan(spark, sf):
    plan = spark._jvm.PythonSQLUtils.explainString(entry.queries()["family_rank"](spark, sf)._jdf.queryExecution(), "formatted")
    assert "l_extendedprice" not in plan and "EqualTo(l_returnflag,R)" in plan
