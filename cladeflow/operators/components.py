"""Connected components by contraction towards randomly ranked neighbours.

Each round every root hangs on the neighbour whose rank, drawn anew from a hash of the
round and the node, is lowest, if it is lower than its own. A root that has a neighbour
does so with a chance of a half or more, whatever the graph looks like, so the number of
roots falls by a constant factor a round: paths of any order, hubs and chains settle in a
number of rounds that grows with the logarithm of the nodes. The links are then rewritten
between what is left, so that each round works on fewer of them.

All of it is equi-joins and map-side combined aggregations over narrow rows, written to the
shared folder, so lineage stays flat and no link, label or component reaches the driver
(one counter a round does). What remains below ``TAIL`` links is settled in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cladeflow.runtime import Scratch, parts_for

#: Links that one task settles at the end of the rounds (16 bytes each).
TAIL = 50_000


def smallest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links and the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)  # every root hangs on a smaller one
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if held:
        node, root = smallest_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def _rank(node: Column | str, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), node)


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", tail: int = TAIL) -> DataFrame:
    """``edges(a, b)`` -> ``(node, label)``, label = smallest node reachable.

    Undirected; self-loops keep a lone node in the result; repeated and null
    edges are harmless (a null endpoint is dropped with its edge). An empty edge
    table gives an empty result.
    """
    kind = edges.schema[a].dataType.simpleString()
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    given = given.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    given = scratch.put(given.distinct(), "cc-links")
    links, hung, salt = given.where("a <> b"), [], 0
    count, owned = links.count(), None
    parts = parts_for(count)
    while count > tail:
        near = links.union(links.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min(F.struct(_rank("b", salt).alias("r"), F.col("b").alias("n"))).alias("best"))
        lower = F.col("best") < F.struct(_rank("node", salt).alias("r"), F.col("node").alias("n"))
        up = scratch.put(near.select("node", F.when(lower, F.col("best.n")).otherwise(F.col("node")).alias("up")), "cc-up", parts)
        # one jump: most hang on a root already, as ranks have no long descents
        over = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        roots = scratch.put(up.join(over, "up").select("node", "root"), "cc-roots", parts)
        ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        moved = links.join(ra, "a").join(rb, "b").where("ra <> rb")
        fewer = scratch.put(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-links", parts)
        scratch.drop(up, *([owned] if owned is not None else []))
        hung.append(roots)
        links = owned = fewer
        salt, count = salt + 1, fewer.count()
    if count:
        hung.append(scratch.put(links.repartition(1).mapInArrow(_settle, f"node {kind}, root {kind}"), "cc-tail"))
    # what a node hangs on hangs on something else in turn: the last and smallest table is read first
    final = None
    for step in reversed(hung):
        if final is None:
            final = step
        else:
            on = final.select(F.col("node").alias("root"), F.col("root").alias("end"))
            final = step.join(on, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    lone = given.where("a = b").select(F.col("a").alias("node"))
    if final is None:
        out = lone.select("node", F.col("node").alias("label"))
    else:
        final = scratch.put(final, "cc-final")
        least = final.groupBy("root").agg(F.min("node").alias("label"))
        own = final.join(least, "root").select("node", "label")
        out = own.union(lone.join(own, "node", "left_anti").select("node", F.col("node").alias("label")))
    out = scratch.put(out, "cc-labels", parts)
    scratch.drop(given, *hung, *(x for x in (final, owned) if x is not None))
    return out
