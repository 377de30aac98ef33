"""Spans of regular-expression matches as columns, without leaving the JVM.

``split`` and ``regexp_extract_all`` walk a text with the same matcher, so gaps and
matches alternate; a running sum of their lengths in code points places each match.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def no_spans() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def placed(text: Column, pattern: str, hits: Column) -> Column:
    """``array<struct<s int, e int, v string>>`` of the matches ``hits`` of ``pattern`` in ``text``."""
    empty = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), empty.alias("out"))

    def step(gaps: Column):
        def one(acc: Column, hit: Column) -> Column:
            s = acc["at"] + F.length(F.get(gaps, acc["i"]))
            e = s + F.length(hit)
            item = F.struct(s.alias("s"), e.alias("e"), hit.alias("v"))
            return F.struct(e.alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(item)).alias("out"))

        return one

    gaps = F.split(text, pattern, -1)
    # the gaps are an array of one array, so that they are made once per text, not once per match
    placed_all = F.get(F.transform(F.array(gaps), lambda g: F.aggregate(hits, start, step(g), lambda acc: acc["out"])), F.lit(0))
    return F.when(F.size(hits) == 0, empty).otherwise(placed_all)


def as_spans(found: Column, kind: str, order: int) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(x["s"].alias("start"), F.lit(order).alias("ord"), x["e"].alias("end"), F.lit(kind).alias("kind")),
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")
