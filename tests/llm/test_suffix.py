import collections
import hashlib
import random

import numpy as np
import pytest

from cladeflow.llm import suffix_dedup as D
from cladeflow.llm.queries import QUERIES
from cladeflow.runtime import Scratch

from .cases import awkward, documents


def brute(rows, span=100):
    """By a set of all strings seen, in document order."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        b = (t or "").encode()
        keep = bytearray(b"\1" * len(b))
        for p in range(len(b) - span + 1):
            x = b[p : p + span]
            if x in seen:
                keep[p : p + span] = bytes(span)
            else:
                seen.add(x)
        kept = bytes(c for c, k in zip(b, keep, strict=True) if k)
        runs = sum(not keep[i] and (i == 0 or keep[i - 1]) for i in range(len(keep)))
        out.append((d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    assert sum(r[2] for r in want) > 0
    assert got(QUERIES["op4_suffix_dedup"](spark, sf)) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_repeats(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passages = [word(rng.randint(90, 260)) for _ in range(6)] + ["ab" * 200, "x" * 450]
    rows = []
    for d in range(80):
        parts = [word(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 30) if rng.random() < 0.5 else 0
            parts += [p[a : len(p) - rng.randint(0, 20)], word(rng.randint(0, 60))]
        rows.append((d * 37 % 101, "".join(parts)))
    rows += [(200 + i, rows[5][1]) for i in range(4)]
    docs = documents(spark, rows).repartition(5)
    assert got(D.deduplicate(docs, Scratch(spark, "t"))) == brute(rows)


def test_strings_that_differ_at_their_ends(spark):
    rng = random.Random(9)
    core = "".join(rng.choice("abcdefgh") for _ in range(100))
    rows = [(1, "p" + core + "q"), (2, "r" + core + "s"), (3, core[:99]), (4, core[1:] + "z"), (5, "z" + core[:50]), (6, core * 2)]
    assert got(D.deduplicate(documents(spark, rows), Scratch(spark, "t"))) == brute(rows)


@pytest.mark.parametrize("empty", [False, True])
def test_awkward(spark, empty):
    docs = awkward(spark).limit(0) if empty else awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(D.deduplicate(docs, Scratch(spark, "t"))) == brute(rows)


def test_multikey_quicksort_orders_rows():
    rng = np.random.default_rng(4)
    for n, high in ((0, 2), (1, 2), (20_000, 3), (20_000, 2**63)):
        words = rng.integers(0, high, (n, 5), dtype=np.uint64)
        order = D.multikey_quicksort(words)
        assert words[order].tolist() == sorted(words.tolist())


def test_hot_seed_fills_many_buckets(spark, monkeypatch):
    """A line in every document, each time in another context, in small buckets and runs."""
    monkeypatch.setattr(D, "BUCKETS", 40)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    line = word(120)
    rows = [(d, word(rng.randint(20, 60)) + line + word(rng.randint(20, 60))) for d in range(300)]
    docs = documents(spark, rows).repartition(30)
    monkeypatch.setattr(D, "SAMPLE_DOCS", 100)
    assert got(D.deduplicate(docs, Scratch(spark, "t"))) == brute(rows)
    cuts = D.sample_splitters(docs.selectExpr("doc_id rid", "text"), 100, 320)
    assert max(collections.Counter(x[:32] for x in cuts.tolist()).values()) > 3  # seeds do straddle boundaries


def test_long_texts_are_read_in_pieces(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    common = word(400)
    text = "".join(word(rng.randint(50, 900)) + common[rng.randint(0, 99) : rng.randint(200, 400)] for _ in range(1000 + D.PIECE // 600))
    for cut in (D.PIECE - 150, D.PIECE - 20):  # repeats across the cut between pieces
        text = text[:cut] + common + text[cut:]
    assert len(text) > D.PIECE + 1000
    rows = [(1, text), (2, text[5000:9000]), (3, word(50) + common)]
    assert got(D.deduplicate(documents(spark, rows), Scratch(spark, "t"))) == brute(rows)
