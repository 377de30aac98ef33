import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cladeflow.llm import best_fit_packing as P, ngram_join as J
from cladeflow.llm.queries import QUERIES
from cladeflow.runtime import Scratch

from .cases import awkward, documents


def shingle_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_classes(rows, k, num):
    """{row index: (set size, smallest linked id)} by an inverted index over all shingles."""
    sets = [shingle_set(t, k) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= num * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    best = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return sorted(((d, len(sets[i]), best[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def classes(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_join_matches_brute_force(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_classes(rows, 4, 85)
    assert len({c for _, _, c in want}) < len(rows)
    assert classes(QUERIES["op9_ngram_join"](spark, sf)) == want


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], [rng.choice("abcdefgh") * 3], [words[i], "new"]])
    return words


@pytest.mark.parametrize("cell", [1024, 3])
def test_join_chains_and_hubs(spark, monkeypatch, cell):
    monkeypatch.setattr(J, "HELD", cell)
    monkeypatch.setattr(J, "STREAMED", cell)
    rng = random.Random(5)
    rows = []
    for base in range(12):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.choice([3, 6, 13, 14, 40, 90, 400]))]
        for _ in range(25):  # each copy is made from the one before: chains of links, not cliques
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
            words = edited(rng, words, rng.randint(0, max(1, len(words) // 60))) or ["x"]
    assert classes(J.join(documents(spark, rows), Scratch(spark, "t"), 4, 85)) == brute_classes(rows, 4, 85)


@pytest.mark.parametrize("num", [70, 80, 85])
def test_linked_sets_share_a_tile(num):
    rng = np.random.default_rng(num)
    bands = J.Bands(num)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        if rng.random() < 0.3:
            x = x >> np.uint64(int(rng.integers(1, 40)))  # crowded into few ranges: many are empty
        drop = int(rng.integers(0, n // 5 + 1))
        add = int(rng.integers(0, n // 5 + 2))
        y = np.concatenate([x[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        if not len(y) or 100 * len(np.intersect1d(x, y)) < num * len(np.union1d(x, y)) or np.array_equal(x, y):
            continue
        keys = [set(J.tile_keys(np.zeros(len(s), int), s, np.array([len(s)]), bands)[1].tolist()) for s in (x, y)]
        assert keys[0] & keys[1], (len(x), len(y))


def test_tiles_of_unlinked_sets_stay_small():
    """Sets that have nothing in common share no tile, however many they are."""
    rng = np.random.default_rng(3)
    for n in (4, 8, 100):
        largest = []
        for rows in (5_000, 20_000):
            h = np.sort(rng.integers(0, 2**64, (rows, n), dtype=np.uint64), axis=1).ravel()
            _, keys = J.tile_keys(np.repeat(np.arange(rows), n), h, np.full(rows, n), J.Bands(80))
            largest.append(int(np.unique(keys, return_counts=True)[1].max()))
        assert max(largest) <= 2, (n, largest)


def test_sets_that_share_an_id_are_told_apart(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(30))) for i in range(60)]
    rows += [(100 + i, t + " end") for i, (_, t) in enumerate(rows[:20])] + [(200 + i, t) for i, (_, t) in enumerate(rows[:5])]
    docs = documents(spark, rows)
    nodes = J.document_nodes(J.keyed(docs, Scratch(spark, "t"), "doc_id", "text"), 4)
    crowded = nodes.selectExpr("rid", "doc_id", "text_hash", "n", "node % 16 as node", "check")
    moved = J.shared_ids(crowded)
    assert len(moved) == crowded.select("check").distinct().count() - crowded.select("node").distinct().count()
    some = nodes.select("node", "check").distinct().limit(30).collect()
    monkeypatch.setattr(J, "shared_ids", lambda _: frozenset((r.node, r.check) for r in some))
    assert classes(J.join(docs, Scratch(spark, "t"), 4, 85)) == brute_classes(rows, 4, 85)


def test_cells_hand_out_spanning_links_only(spark):
    rng = random.Random(2)
    words = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(80)]
    rows = [(i, " ".join([*words, *([f"x{i}"] * (i % 3))])) for i in range(300)]
    docs = documents(spark, rows)
    scratch, bands = Scratch(spark, "t"), J.Bands(80)
    keyed = J.keyed(docs, scratch, "doc_id", "text")
    nodes = J.document_nodes(keyed, 5)
    groups = J.groups_of(J.stars(J.tile_rows(keyed, 5, bands, frozenset()))).cache()
    sets = J.node_sets(keyed.join(nodes.select("rid", nodes["node"].alias("want")), "rid").select("want", "text"), 5, frozenset()).dropDuplicates(["node"]).cache()
    links = J.cell_links(J.later_meetings(groups, sets, sets.select("node", sets["node"].alias("label")), scratch, 2), 80, "lead", "block", "chunk")
    assert sets.count() == 201 and links.count() <= 201


def test_sets_that_only_share_a_passage_do_not_travel(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(90 + i % 7))])) for i in range(200)]
    rows += [(1000 + i, t + " end") for i, t in rows[:5]]
    written = []
    put = Scratch.put_bucketed

    def counted(self, df, *rest):
        out = put(self, df, *rest)
        written.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "put_bucketed", counted)
    assert classes(J.join(documents(spark, rows), Scratch(spark, "t"), 5, 80)) == brute_classes(rows, 5, 80)
    assert 10 <= written[0] <= 30


@pytest.mark.parametrize("most", [8192, 2])
def test_possible_keeps_all_linked_sets(spark, monkeypatch, most):
    monkeypatch.setattr(J, "SKETCHED", most)
    monkeypatch.setattr(J, "STEP", 1 << 8)
    rng = np.random.default_rng(most)
    sets = []
    for n in (1, 3, 20, 70, 300, 2500):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        for _ in range(8):
            cut = int(rng.integers(0, n // 4 + 1))
            sets.append(np.unique(np.concatenate([base[cut:], rng.integers(0, 2**64, int(rng.integers(0, n // 5 + 2)), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    n = np.array([len(s) for s in sets])
    drawn = J.sketches(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), n)
    linked = {i for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
    groups = spark.createDataFrame([(7, i) for i in range(len(sets))], "lead bigint, node bigint")
    nodes = spark.createDataFrame([(i, int(n[i]), d) for i, d in enumerate(drawn)], "node bigint, n bigint, sketch binary")
    found = [r.node for r in J.near_groups(groups, nodes, 80).collect()]
    assert linked <= set(found) and len(found) == len(set(found)) < len(sets)


@pytest.mark.parametrize("empty", [False, True])
def test_join_awkward(spark, empty):
    docs = awkward(spark).limit(0) if empty else awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = classes(J.join(docs, Scratch(spark, "t"), 4, 85))
    want = brute_classes(rows, 4, 85)
    assert got == want
    docs = docs.selectExpr("*", "1 as lost_id", "text as own_text", "2 as __lost", "3 as label", "4 as node")
    kept = J.keep_one(docs, Scratch(spark, "t"), 4, 85)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect() if shingle_set(r.text, 4)), key=str) == sorted({c for _, n, c in want if n}, key=str)


def test_keep_one_tells_rows_of_one_id_apart(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (7, "quite another text of its own"), (7, base + " end"), (9, "x y z " + base[::-1]), (9, base[::-1] + " x y z")]
    kept = sorted((r.doc_id, r.text) for r in J.keep_one(documents(spark, rows), Scratch(spark, "t")).collect())
    assert [d for d, _ in kept] == [3, 7] + [9] * (2 if len(shingle_set(base[::-1], 5)) < 30 else 1)
    assert kept[1][1] == "quite another text of its own"


def test_packing_matches_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.default_vocabulary())
    odd = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y\n<|endoftext", "<|endoftext|> a  b\n\n c\t\td", "  x", "x  ", " 　y", "12 5²٣", "I'M don't 'S", "\U0001f600‍ á", "\x1c\x85 z\r\n", "a\nb", "\n", " ", None, "", "tab\tw.\nX, y!", "v" * 5000, "a " * 5000]
    docs = documents(spark, list(enumerate(odd))).union(spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", __import__("pyspark").sql.functions.col("doc_id") + 100))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = P.pack(docs, Scratch(spark, "t")).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 2048)))
        assert all(r.length == 2048 for r in parts[1:])
        at = 0
        for r in parts:
            assert r.start == at
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    check_places(got)
    bins = len({r.sequence_id for r in got})
    assert bins <= -(-sum(r.length for r in got) // 2048) + 1


def check_places(got):
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_packing_awkward(spark):
    docs = awkward(spark)
    got = P.pack(docs, Scratch(spark, "t")).collect()
    assert sum(r.piece == 0 for r in got) == docs.count()
    check_places(got)
    assert P.pack(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_fullest_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        used = P.fullest(counts, room)
        assert all(used[k] <= counts[k] for k in used)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
