"""Round transitions with scripted kernels, and the numpy kernels end to end."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cladeflow.operators import rounds as R
from cladeflow.operators.kernels import AMINO, Model, NumpyKernels
from cladeflow.runtime import Scratch

LOOSE = R.Options(discard_min_rep_length=1)


class Scripted(NumpyKernels):
    def align_to(self, model, rows):
        width = max(len(r) for _, r in rows)
        return [(n, r.ljust(width, "-")) for n, r in rows], "x" * width

    def representatives(self, rows, identity, most):
        return rows[:most], list(range(len(rows[0][1])))


def family(hits, **more):
    model = Model("f", __import__("numpy").zeros((10, 21)), "A" * 10)
    return R.Family("f", 1, ("a", "b"), model=model, qlen=10, hits=tuple(hits), seed=(("a", "ACDEFGHIKL"),), **more)


SEQ = "ACDEFGHIKL"


def test_transitions():
    k = Scripted()
    three = [(n, SEQ, 1, 10) for n in ("a", "b", "c")]
    assert R.advance(family([("a", SEQ, 1, 5)]), 1, LOOSE, k).reason == R.LOW_COMPLEXITY
    one = R.advance(family(three), 1, LOOSE, k)
    assert one.state == "running" and one.seen == {"a", "b", "c"} and len(one.seed) == 3
    assert R.advance(one, 2, LOOSE, k).state == "converged" and R.advance(one, 2, LOOSE, k).seed == one.seed
    assert R.advance(family(three), 3, LOOSE, k).seed == family(three).seed
    assert R.advance(family(three[:2]), 1, LOOSE, k).reason == R.REDUNDANT
    assert R.advance(family(three), 1, R.Options(), k).reason == R.TOO_SMALL
    assert R.advance(family(three), 1, R.Options(discard_min_rep_length=1, discard_max_rep_length=5), k).reason == R.TOO_LARGE
    assert R.advance(family(three, adopt=True), 1, LOOSE, k).members == ("a", "b", "c")
    done = R.finish(family(three), LOOSE, k)
    assert done.state == "successful" and done.membership == 1.0 and len(done.full) == 3
    assert R.finish(family(three[1:]), LOOSE, k).reason == R.FEW_SEEDS and R.finish(family(three[1:]), LOOSE, k).value == 0.5
    assert R.finish(family([]), LOOSE, k).reason == R.LOW_COMPLEXITY
    assert R.finish(family(three, state="discarded"), LOOSE, k).state == "discarded"
    broken = family(three).guarded("round 1, x", lambda f: 1 / 0)
    assert broken.reason == "internal error during round 1  x" and broken.state == "discarded"
    assert R.recruit_only(family(three), LOOSE).round1_recruits == 3


def test_names_of_recruits():
    f = family([("X", SEQ, 2, 10), ("X/2_10", SEQ, 1, 10), ("X%2F2_10", SEQ, 1, 10)])
    rows = R.recruits(f, 0.9, False)
    assert [n for n, _ in rows] == ["X/2_10", "X%2F2_10", "X%252F2_10"]
    assert [R.decoded(n) for n, _ in rows] == ["X", "X/2_10", "X%2F2_10"]
    assert rows[0][1] == SEQ[1:]


@pytest.mark.parametrize("bad", [{"max_seq_identity": 1.1}, {"recruit_evalue_cutoff": 0.0}, {"discard_min_rep_length": 9, "discard_max_rep_length": 8}, {"max_seed_seqs": 0}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError, match="."):
        R.Options(**bad)


def database(rng):
    bases = ["".join(rng.choice(AMINO) for _ in range(60)) for _ in range(3)]
    rows = []
    for b, base in enumerate(bases):
        for i in range(7):
            seq = "".join(c if rng.random() > 0.15 else rng.choice(AMINO) for c in base)
            rows.append((f"s{b}_{i}", "".join(rng.choice(AMINO) for _ in range(rng.randint(0, 8))) + seq))
    rows += [(f"n{i}", "".join(rng.choice(AMINO) for _ in range(70))) for i in range(20)]
    return rows


def test_rounds_end_to_end_and_partitions_do_not_matter(spark):
    rows = database(random.Random(1))
    clusters = [(0, "s0_0", "s0_0"), (1, "s0_0", "s0_1"), (2, "s1_0", "s1_0"), (3, "s0_0", "s0_2"), (4, "s1_0", "s1_1"), (5, "s1_0", "s1_2"), (6, "lone", "n1"), (7, "gone", "zz")]
    cl = spark.createDataFrame(clusters, "ord bigint, representative string, member string")
    options = R.Options(discard_min_rep_length=20, recruit_hit_length_percentage=0.7, max_seq_identity=0.95)
    seen = []
    for parts in (1, 5):
        db = spark.createDataFrame(rows, "name string, seq string").repartition(parts)
        scratch, kernels = Scratch(spark, "t"), NumpyKernels()
        state = R.run_rounds(R.start(cl, db, scratch, kernels), db, options, scratch, kernels)
        seen.append({r.family: (r.state, r.reason, r.full_size, r.converged, r.rows) for r in R.outcomes(state).collect()})
    assert seen[0] == seen[1]
    got = seen[0]
    assert got["lone"][1] == R.TOO_FEW and got["gone"][1] == R.TOO_FEW
    for b in (0, 1):
        state, _, size, conv, _ = got[f"s{b}_0"]
        assert state == "successful" and size >= 7 and conv


def test_update_from_models(spark):
    rng = random.Random(2)
    rows = database(rng)
    k = NumpyKernels()
    m = k.build("fam", k.align([r for r in rows if r[0].startswith("s2")]))
    none = Model("none", k.build("none", [("a", "W" * 40), ("b", "W" * 40)]).scores, "W" * 40)
    db = spark.createDataFrame(rows, "name string, seq string")
    for skip in (False, True):
        options = R.Options(discard_min_rep_length=20, recruit_hit_length_percentage=0.7, max_seq_identity=0.95, skip_refine=skip)
        scratch = Scratch(spark, "t")
        out = {r.family: r for r in R.outcomes(R.run_rounds(R.from_models(spark, [none, m], options), db, options, scratch, k, loaded=True)).collect()}
        assert out["none"].reason == R.NO_HITS
        assert out["fam"].state == "successful" and out["fam"].round1_recruits >= 7 and out["fam"].model_length_before == m.m
        assert (out["fam"].converged is None) == skip
