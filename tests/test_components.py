import random

import numpy as np
import pytest

from cladeflow.operators.components import connected_components, smallest_of
from cladeflow.runtime import Scratch

N = 10_000


def _paths():
    mixed = list(range(N))
    random.Random(1).shuffle(mixed)
    up = [(i, i + 1) for i in range(N - 1)]
    return {
        "ascending": up,
        "descending": [(b, a) for a, b in up[::-1]],
        "shuffled": list(zip(mixed, mixed[1:], strict=False)),
        "least at the far end": [(i, i + 1) for i in range(1000, 1099)] + [(1099, 0)],
        "hub": [(N, i) for i in range(N)],
    }


@pytest.mark.parametrize("name", sorted(_paths()))
def test_settles_on_any_path(spark, name):
    edges, scratch = _paths()[name], Scratch(spark, "t")
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), scratch, tail=0).collect()
    assert {r.node for r in got} == {x for e in edges for x in e} and len(got) == len({r.node for r in got})
    assert {r.label for r in got} == {0}
    assert scratch._count <= 3 * 25 + 3  # tables written: three a round


@pytest.mark.parametrize("tail", [0, 3, 50_000])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_matches_union_find(spark, tail, kind):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, 400), (5, 5)]
    edges += edges[:20] + [(b, a) for a, b in edges[:20]]
    cast = (lambda x: f"n{x:04d}") if kind == "string" else int
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = sorted((cast(x), cast(find(x))) for x in root)
    rows = [(cast(a), cast(b)) for a, b in edges] + [(None, cast(1)), (cast(2), None)]
    got = connected_components(spark.createDataFrame(rows, f"a {kind}, b {kind}"), Scratch(spark, "t"), tail=tail).collect()
    assert sorted((r.node, r.label) for r in got) == want


def test_smallest_of_reaches_everything():
    node, label = smallest_of(np.array([9, 3, 5, 7, 2]), np.array([3, 5, 1, 8, 2]))
    assert dict(zip(node.tolist(), label.tolist(), strict=True)) == {1: 1, 2: 2, 3: 1, 5: 1, 7: 7, 8: 7, 9: 1}
