"""Exact Jaccard join of documents on word n-grams, and the classes it links.

1. Every document becomes its sorted set of 64-bit shingle fingerprints; documents with
   equal sets are one node from here on. A node's 64-bit id stands for its set only where
   a second, independent fingerprint agrees; sets that share an id by chance get others.
2. Sizes fall into bands. Two sets that link differ in at most ``limit`` members, a bound
   fixed by the band of the smaller, so of ``limit + 1`` ranges of the fingerprint space
   at least one holds exactly the same members in both. Each (band, range, members) is a
   tile. Spare ranges make up for empty ones, and sets with more empty ranges than spare
   ones are split anew by another order of the fingerprints (see ``Bands``), so tiles hold
   true partners and hardly anything else, however large the corpus.
3. A tile's smallest node leads it. Within a batch, the nodes of a tile hang on a leader
   of their own, and only that one travels under the tile's key. Nodes that any tile puts
   under one leader are its group; every pair that shares a tile shares a group.
4. Many groups hold sets that share a passage and no more. Within each group the sketches
   of the sets (hashed bitmaps of three bits a member or more) are compared, every pair in
   some cell of two blocks, and only what could link with another set of the group by that
   bound stays in it. The sets of the others don't travel.
5. Groups are compared where their sets lie side by side: held sets against streamed ones,
   in cells of bounded size, so a large group is many cells. A pair is compared by hashed
   bitmaps first (a bit set only in one of them is a member that the other set lacks, which
   bounds the overlap from above), then by intersecting the sorted arrays. Only links that
   join two components leave a cell, at most one for each set in it.
6. First each node meets the smallest of its leaders; then, in groups that still hold
   several components, all nodes outside the largest one meet all nodes of the group, and
   a pair that shares several groups meets in that of the smallest leader.

No link is lost: every linked pair shares a group, and in the end every pair of a group
is in one component or has been compared. Links and labels stay in tables.

Defined cases: null and empty texts (and texts of white space only) have an empty set
and link with nothing, not even each other; a text of fewer than ``k`` words has its
whole word sequence as its one shingle; rows may repeat (their sets are equal, so they
are one class); a null doc_id counts as larger than any other and names a component
only if no row in it has an id; an empty table gives an empty result; further columns,
whatever their names, are ignored by ``join`` and passed through by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cladeflow.llm import shingles as S
from cladeflow.llm.keys import keyed
from cladeflow.operators.components import connected_components
from cladeflow.runtime import Scratch, free_names, parts_for

U = np.uint64
#: Growth of a band's upper end; at least 1 / similarity, so that partners are at most one band apart.
RATIO = 1.4
#: Orders of the fingerprints that a set with too many empty ranges is split by.
SPLITS = 8
#: Longwords of a bitmap signature, for short and for long sets.
LONGS = (64, 4096)
#: Sets that a cell holds, sets that it streams past them, and members of either.
HELD, STREAMED, MEMBERS = 1024, 4096, 1 << 20
#: Sketches in a block, longwords in a block, and longwords of the longest sketch.
SKETCHED, SKETCH_LONGS, SKETCH_MOST = 8192, 1 << 19, 4096
#: Longwords that one step of the comparison of sketches makes.
STEP = 1 << 19
#: Tile rows that are sorted and combined at once.
ROWS = 400_000
#: Nodes of a batch that make a tile be combined before the shuffle.
COMBINE = 4


class Bands:
    """Size bands for a similarity of ``num`` hundredths, and the ranges of each.

    ``parts[b]`` ranges hold ``limit[b] + 1 + spare[b]`` pieces of the fingerprint space.
    A pair whose smaller set is in band ``b`` differs in at most ``limit[b]`` members, and
    in fewer if its sets are small for the band (``apart``); all other ranges are equal in
    both. If one of the two has fewer empty ranges than that leaves, an equal range has
    members: a common tile. Otherwise both split their members anew, by another order, and
    so on; what is left after ``SPLITS`` orders (a chance of a few hundredths each for the
    smallest sets, none for others) takes its empty ranges as tiles as well.
    """

    def __init__(self, num: int, largest: int = 1 << 31):
        ratio = max(RATIO, 100 / num)
        tops = [1]
        while tops[-1] < largest:
            tops.append(max(tops[-1] + 1, math.floor(tops[-1] * ratio)))
        self.top = np.array(tops, np.int64)  # the largest size in the band
        widest = self.top * 100 // num  # the largest partner of a set in the band
        self.widest = widest
        self.limit = (100 - num) * (self.top + widest) // (100 + num)
        self.spare = np.maximum(1, self.limit * 6 // 100)
        self.parts = self.limit + 1 + self.spare
        self.num = num

    def apart(self, n: np.ndarray, partner: np.ndarray) -> np.ndarray:
        """Members in which linked sets of such sizes differ at most."""
        return (100 - self.num) * (n + partner) // (100 + self.num)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.top, n, "left")


def set_prints(row: np.ndarray, h: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """64-bit fingerprint of each row's set (of its sorted distinct members); 0 if empty."""
    sums = np.zeros(rows, U)
    if len(h):
        with np.errstate(over="ignore"):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            sums[row[first]] = np.add.reduceat(S.mix(h ^ U(seed)), first)
            sums = np.where(np.bincount(row, minlength=rows) > 0, S.mix(sums + np.bincount(row, minlength=rows).astype(U)), U(0))
    return sums.view(np.int64)


#: Seeds of the id and of the fingerprint that confirms it.
SEEDS = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


def node_ids(row: np.ndarray, h: np.ndarray, rows: int, moved: frozenset = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, identity and confirming fingerprint of each row's set.

    ``moved`` has the (id, fingerprint) of sets whose id another set has too: they take
    an id made of both.
    """
    n = np.bincount(row, minlength=rows)
    node, check = (set_prints(row, h, rows, s) for s in SEEDS)
    if moved:
        for i, pair in enumerate(zip(node.tolist(), check.tolist(), strict=True)):
            if pair in moved:
                node[i] = _moved_id(*pair)
    return n, node, check


def _moved_id(node: int, check: int) -> int:
    both = np.array([node, check], np.int64).view(U)
    return int(S.mix(S.mix(both[:1]) ^ both[1:]).view(np.int64)[0])


def tile_keys(row: np.ndarray, h: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every tile that the sets belong to."""
    rows_out, keys_out = [], []
    own = bands.of(n)
    for shift in (0, 1):
        band = own - shift
        ok = (n > 0) & (band >= 0)
        band = np.maximum(band, 0)
        ok &= (shift == 0) | (n <= bands.widest[band])
        # a band whose pairs can't differ holds equal sets only: they are one node already
        ok &= bands.limit[band] > 0
        parts = bands.parts[band].astype(U)
        # the largest partner that this set meets in the band's tiles
        partner = n * 100 // bands.num if shift == 0 else bands.top[band]
        allowed = bands.parts[band] - 1 - np.minimum(bands.limit[band], bands.apart(n, partner))
        for split in range(SPLITS):
            take = ok[row]
            r, m = row[take], h[take]
            if not len(r):
                break
            if split:  # another order of the fingerprints
                m = S.mix(m ^ S.mix(np.array([split], U)))
                order = np.lexsort((m, r))
                r, m = r[order], m[order]
            with np.errstate(over="ignore"):
                part = ((m >> U(32)) * parts[r]) >> U(32)
                seed = S.mix((band.astype(U) << U(33))[r] + part + (U(split) << U(56)))
                new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (part[1:] != part[:-1])]))
                keys_out.append(S.mix(np.add.reduceat(S.mix(m), new) + seed[new]))
            rows_out.append(r[new])
            ok = ok & (bands.parts[band] - np.bincount(r[new], minlength=len(n)) > allowed)
            if split == SPLITS - 1:
                for x in np.flatnonzero(ok):
                    lo, hi = np.searchsorted(r[new], [x, x + 1])
                    empty = np.setdiff1d(np.arange(int(parts[x]), dtype=U), part[new][lo:hi], assume_unique=True)
                    with np.errstate(over="ignore"):
                        keys_out.append(S.mix(S.mix((U(band[x]) << U(33)) + empty) ^ U(0xA0761D6478BD642F)))
                    rows_out.append(np.full(len(empty), x))
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(rows_out), np.concatenate(keys_out)


def _sets(batch: pa.RecordBatch, k: int, moved: frozenset):
    """Per slice of texts: first row, then row and member of all sets, size, id and fingerprint of each."""
    for first, rows, data, off in S.text_slices(batch.column("text")):
        row, h, _ = S.shingles(data, off, k)
        row, h = S.distinct_by_row(row, h)
        yield first, row, h, *node_ids(row, h, rows, moved)


def document_nodes(docs: DataFrame, k: int) -> DataFrame:
    """``rid, doc_id, text_hash, n, node, check, sketch`` of every row; node is null where the set is empty."""

    def run(batches):
        for batch in batches:
            parts, drawn = [], []
            for _, row, h, *part in _sets(batch, k, frozenset()):
                parts.append(part)
                drawn += sketches(row, h, part[0])
            n, node, check = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("rid", "doc_id", "text_hash")), pa.array(n, pa.int64()), pa.array(node, mask=n == 0), pa.array(check), pa.array(drawn, pa.binary())],
                ["rid", "doc_id", "text_hash", "n", "node", "check", "sketch"],
            )

    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    return hashed.mapInArrow(run, "rid bigint, doc_id bigint, text_hash bigint, n bigint, node bigint, check bigint, sketch binary")


def shared_ids(nodes: DataFrame) -> frozenset:
    """(id, fingerprint) of all sets but one of each id that several sets have.

    Chance alone makes these: some ten pairs in 10^10 documents. Their number is checked.
    """
    two = nodes.where("node is not null").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi")
    also = nodes.join(two, "node").where("check <> lo").select("node", "check").distinct().limit(1_000_001).collect()
    if len(also) > 1_000_000:
        raise RuntimeError("more than a million sets share an id: that is no chance")
    return frozenset((r.node, r.check) for r in also)


def chief(lead: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each row the smallest leader that its leader is under itself.

    The tiles of many near copies have many leaders, which mostly meet in a tile of their
    own: their groups would hold the same nodes again and again.
    """
    some = np.unique(lead)
    at = np.minimum(np.searchsorted(some, node), max(len(some) - 1, 0))
    also = some[at] == node if len(some) else np.zeros(0, bool)
    top = some.copy()
    np.minimum.at(top, at[also], lead[also])
    return top[np.searchsorted(some, lead)]


def tile_rows(docs: DataFrame, k: int, bands: Bands, moved: frozenset) -> DataFrame:
    """``key, node, lead``: nodes under their tile's key, or hung on a leader of their batch."""

    def parts(batches):
        tiles, nodes, held = [], [], 0
        for batch in batches:
            for _, row, h, n, node, _ in _sets(batch, k, moved):
                r, keys = tile_keys(row, h, n, bands)
                tiles.append(keys.view(np.int64))
                nodes.append(node[r])
                held += len(r)
                if held >= ROWS:
                    yield np.concatenate(tiles), np.concatenate(nodes)
                    tiles, nodes, held = [], [], 0
        if held:
            yield np.concatenate(tiles), np.concatenate(nodes)

    def run(batches):
        for tile, node in parts(batches):
            order = np.lexsort((node, tile))
            tile, node = tile[order], node[order]
            keep = np.ones(len(tile), bool)
            keep[1:] = (tile[1:] != tile[:-1]) | (node[1:] != node[:-1])
            tile, node = tile[keep], node[keep]
            first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            size = np.diff(np.append(first, len(tile)))
            travels = np.repeat(size < COMBINE, size)
            travels[first] = True
            full = np.repeat(size >= COMBINE, size)  # tiles whose nodes hang on a leader
            lead = chief(np.repeat(node[first], size)[full], node[full])
            hung = np.unique(np.stack([lead, node[full]], axis=1), axis=0)
            hung = hung[hung[:, 0] != hung[:, 1]]
            under = node.copy()  # what travels under the tile's key
            under[full] = lead
            with np.errstate(over="ignore"):
                spread = S.mix(hung[:, 0].view(U) ^ S.mix(hung[:, 1].view(U))).view(np.int64)
            rows = int(travels.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([tile[travels], spread])),
                    pa.array(np.concatenate([under[travels], hung[:, 1]])),
                    pa.array(np.concatenate([np.zeros(rows, np.int64), hung[:, 0]]), mask=np.arange(rows + len(hung)) < rows),
                ],
                ["key", "node", "lead"],
            )

    return docs.select("text").mapInArrow(run, "key bigint, node bigint, lead bigint")


def stars(tiles: DataFrame) -> DataFrame:
    """``lead, node, batch``: nodes under the smallest of their tile, or (batch) of a batch's part of it.

    Rows come sorted by key, so a tile is read as a stream: its leader is all that is
    remembered, however many nodes it has.
    """

    def run(batches):
        last, held = None, None
        for batch in batches:
            key, node, lead = (batch.column(i) for i in range(3))
            hung = lead.is_valid().to_numpy(zero_copy_only=False)
            key, node = key.to_numpy(), node.to_numpy()
            k, v = key[~hung], node[~hung]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
            heads = v[first].copy()
            if len(k) and last is not None and k[0] == last:
                heads[0] = held
            head = np.repeat(heads, np.diff(np.append(first, len(k))))
            if len(k):
                last, held = k[-1], head[-1]
            link = head != v
            tied = np.unique(np.stack([head[link], v[link]], axis=1), axis=0)
            own = np.stack([lead.filter(lead.is_valid()).to_numpy(), node[hung]], axis=1)
            both = np.concatenate([tied, own])
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.arange(len(both)) >= len(tied))], ["lead", "node", "batch"])

    return tiles.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "lead bigint, node bigint, batch boolean")


def groups_of(star: DataFrame) -> DataFrame:
    """``lead, node``: groups that hold every tile's nodes together, their leaders included.

    As in a batch (see ``chief``), a leader that is under others hands its group to the
    smallest of them. What hangs on a batch's leader is in all groups that this one is in.
    """
    tied, hung = (star.where(w).select("lead", "node").distinct() for w in ("not batch", "batch"))
    top = tied.groupBy("node").agg(F.min("lead").alias("top")).select(F.col("node").alias("lead"), "top")
    leads = star.select("lead").distinct().join(top, "lead", "left").select("lead", F.coalesce(F.least("top", "lead"), "lead").alias("top"))
    under = tied.join(leads, "lead").select(F.col("top").alias("lead"), "node").union(leads.select(F.col("top").alias("lead"), F.col("lead").alias("node"))).distinct()
    own = under.union(leads.select(F.col("top").alias("lead"), F.col("top").alias("node")))
    also = under.select(F.col("node").alias("lead"), F.col("lead").alias("top"))
    return own.union(hung.join(also, "lead").select(F.col("top").alias("lead"), "node")).distinct()


def sketches(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Hashed bitmap of each row's set: a power of two of longwords, three bits a member at least, eight in short sets."""
    bits = np.maximum(np.maximum(3 * n, np.minimum(8 * n, 1600)), 64)
    longs = np.minimum(1 << np.ceil(np.log2(bits / 64)).astype(np.int64), SKETCH_MOST)
    ends = np.cumsum(longs)
    out = np.zeros(int(longs.sum()), U)
    at = h & (longs.astype(U) * U(64) - U(1))[row]
    np.bitwise_or.at(out, (ends - longs)[row] + (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    raw = out.tobytes()
    return [raw[8 * (e - w) : 8 * e] for e, w in zip(ends.tolist(), longs.tolist(), strict=True)]


def narrowed(bits: np.ndarray, longs: int) -> np.ndarray:
    """Sketches as they are with fewer longwords."""
    while bits.shape[1] > longs:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def possible(n: np.ndarray, block: np.ndarray, sketch: list[bytes], num: int) -> np.ndarray:
    """Which sets of a cell may link with another of it, by sizes and sketches.

    Sets of one block meet each other, those of two blocks meet across. What isn't found
    can't link; who has one possible partner looks for no other.
    """
    found = np.zeros(len(n), bool)
    across = block.min() != block.max()
    longs = np.array([len(x) // 8 for x in sketch])
    kinds = {}
    for w in np.unique(longs).tolist():
        at = np.flatnonzero(longs == w)
        at = at[np.argsort(n[at], kind="stable")]
        kinds[w] = at, np.frombuffer(b"".join(sketch[i] for i in at.tolist()), U).reshape(-1, w)
    for (w, (mine, own)), (v, (theirs, other)) in ((x, y) for x in kinds.items() for y in kinds.items()):
        if n[theirs[-1]] * 100 < n[mine[0]] * num or n[mine[-1]] * 100 < n[theirs[0]] * num:
            continue
        own, other = narrowed(own, min(w, v)), narrowed(other, min(w, v))
        # members beyond the bits set: so many may share a bit with another member
        hid, hid_other = (n[at] - np.bitwise_count(b).sum(axis=1, dtype=np.int64) for at, b in ((mine, own), (theirs, other)))
        rows = max(1, min(64, STEP // 64 // min(w, v)))
        for first in range(0, len(mine), rows):
            a = np.arange(first, min(first + rows, len(mine)))
            a = a[~found[mine[a]]]
            if not len(a):
                continue
            at = int(np.searchsorted(n[theirs], -(-n[mine[a[0]]] * num // 100)))
            end = int(np.searchsorted(n[theirs], n[mine[a[-1]]] * 100 // num, "right"))
            step = 64
            while at < end and len(a):
                b = np.arange(at, min(at + max(1, min(step, STEP // (len(a) * min(w, v)))), end))
                x, y = mine[a], theirs[b]
                common = np.bitwise_count(own[a][:, None, :] & other[b][None, :, :]).sum(axis=2, dtype=np.int64)
                best = common + np.minimum(hid[a][:, None], hid_other[b][None, :])
                both = n[x][:, None] + n[y][None, :]
                fits = (best * (100 + num) >= both * num) & (np.minimum(n[x][:, None], n[y][None, :]) * 100 >= np.maximum(n[x][:, None], n[y][None, :]) * num)
                fits &= block[x][:, None] != block[y][None, :] if across else x[:, None] != y[None, :]
                found[x[fits.any(axis=1)]] = True
                found[y[fits.any(axis=0)]] = True
                a, at, step = a[~found[x]], int(b[-1]) + 1, 4 * step
    return found


def near_groups(groups: DataFrame, nodes: DataFrame, num: int) -> DataFrame:
    """The rows of ``groups`` that may link with another row of their group; ``nodes(node, n, sketch)``."""

    def run(batches):
        last, held = None, []

        def settled():
            n, block, node = (np.concatenate([h[i] for h in held]) for i in range(3))
            return node[possible(n, block, [x for h in held for x in h[3]], num)]

        for batch in batches:
            leads, out = [], []
            ids = np.stack([batch.column(c).to_numpy() for c in ("lead", "a", "b")], axis=1)
            n, block, node = (batch.column(c).to_numpy() for c in ("n", "block", "node"))
            sketch = batch.column("sketch")
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if last is not None and (ids[a] != last).any():
                    out.append(settled())
                    leads.append(np.full(len(out[-1]), last[0]))
                    held = []
                last = ids[a].copy()
                held.append((n[a:b].copy(), block[a:b].copy(), node[a:b].copy(), sketch.slice(a, b - a).to_pylist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (leads, out)], ["lead", "node"])
        if held:
            rest = settled()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), last[0])), pa.array(rest)], ["lead", "node"])

    size = groups.join(nodes.select("node", (F.length("sketch") / 8).alias("longs")), "node").groupBy("lead").agg(F.count("*").alias("rows"), F.sum("longs").alias("longs"))
    blocks = F.ceil(F.greatest(F.col("rows") / SKETCHED, F.col("longs") / SKETCH_LONGS)).cast("int")
    placed = groups.join(size.where("rows > 1").select("lead", blocks.alias("blocks")), "lead").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.struct(F.least("block", c).alias("a"), F.greatest("block", c).alias("b")))
    placed = placed.select("lead", "node", "block", F.explode(cell).alias("cell")).join(nodes, "node")
    placed = placed.select("lead", "cell.a", "cell.b", "block", "node", "n", "sketch")
    return placed.repartition("lead", "a", "b").sortWithinPartitions("lead", "a", "b").mapInArrow(run, "lead bigint, node bigint").distinct()


def node_sets(texts: DataFrame, k: int, moved: frozenset) -> DataFrame:
    """``want, text`` -> ``node, n, members`` of the rows whose set is the one wanted."""

    def run(batches):
        for batch in batches:
            want = batch.column("want").to_numpy(zero_copy_only=False)
            for first, _, h, n, node, _ in _sets(batch, k, moved):
                ends = np.cumsum(n)
                take = np.flatnonzero((node == want[first : first + len(n)]) & (n > 0))
                if len(take):
                    sets = [h[ends[i] - n[i] : ends[i]].tobytes() for i in take]
                    yield pa.RecordBatch.from_arrays([pa.array(node[take]), pa.array(n[take]), pa.array(sets, pa.binary())], ["node", "n", "members"])

    return texts.mapInArrow(run, "node bigint, n bigint, members binary")


def bitmaps(sets: list[np.ndarray], longs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bitmap of each set, and the bits set in it."""
    out = np.zeros((len(sets), longs), U)
    for row, m in zip(out, sets, strict=True):
        at = np.unique(m % U(longs * 64))
        np.bitwise_or.at(row, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out, np.bitwise_count(out).sum(axis=1, dtype=np.int64)


class Cell:
    """Held sets that streamed ones are compared with; remembers what has become one component."""

    def __init__(self, rows: list[dict], num: int):
        self.num, self.sets = num, [m for r in rows for m in r["members"]]
        self.node, self.label = (np.concatenate([r[c] for r in rows]) for c in ("node", "label"))
        self.n = np.array([len(m) for m in self.sets], np.int64)
        wide = 1 << max(0, int(self.n.max() // 4).bit_length())
        self.longs = min(max(wide, LONGS[0]), LONGS[1])
        self.bits, self.pop = bitmaps(self.sets, self.longs)
        self.now: dict[int, int] = {}
        elsewhere: dict[int, list[int]] = {}
        for i, leads in enumerate(x for r in rows for x in r["before"]):
            for lead in leads.tolist():
                elsewhere.setdefault(lead, []).append(i)
        self.elsewhere = {lead: np.array(at) for lead, at in elsewhere.items()}

    def root(self, label: int) -> int:
        while label in self.now:
            label = self.now[label]
        return label

    def common(self, at: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Members that ``m`` has in common with each of the held sets ``at``: sorted arrays, looked up side by side."""
        many = self.sets[at[0]] if len(at) == 1 else np.concatenate([self.sets[i] for i in at.tolist()])
        hit = m[np.minimum(np.searchsorted(m, many), len(m) - 1)] == many
        return np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(self.n[at])[:-1]]))

    def links(self, row: dict) -> Iterator[tuple[int, int]]:
        """Pairs of labels that a link between a held and a streamed set joins."""
        num, all_bits, all_pop = self.num, *bitmaps(row["members"], self.longs)
        for j, m in enumerate(row["members"]):
            own, n = self.root(int(row["label"][j])), len(m)
            fit = (self.label != own) & (np.minimum(self.n, n) * 100 >= np.maximum(self.n, n) * num)
            if row["apart"][j]:  # held elsewhere as well: one of the two meetings is enough
                fit &= self.node < row["node"][j]
            for lead in row["before"][j].tolist():  # met in a group of a smaller leader
                if lead in self.elsewhere:
                    fit[self.elsewhere[lead]] = False
            at = np.flatnonzero(fit)
            if len(at):
                common = np.bitwise_count(self.bits[at] & all_bits[j]).sum(axis=1, dtype=np.int64)
                # a bit that only one bitmap has is a member that the other set lacks
                best = common + np.minimum(self.n[at] - self.pop[at], n - all_pop[j])
                at = at[best * (100 + num) >= (self.n[at] + n) * num]
            step = 1
            while len(at):
                some, at = at[:step], at[step:]
                for i in some[self.common(some, m) * (100 + num) >= (self.n[some] + n) * num].tolist():
                    if (other := int(self.label[i])) != own:
                        yield own, other
                        self.now[other] = own
                        self.label[self.label == other] = own
                at, step = at[self.label[at] != own], min(2 * step, 64)


def cell_links(rows: DataFrame, num: int, *cell: str) -> DataFrame:
    """``a, b``: labels of components that links within the cells join.

    ``rows(*cell, held, apart, node, label, before, members)``; a cell's held rows come first,
    then the streamed ones. ``before``: groups in which a row has its meetings already.
    """

    def parts(batch):
        ids = np.stack([batch.column(c).to_numpy() for c in cell], axis=1)
        flat = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("held", "apart", "node", "label")}
        before, raw = batch.column("before"), batch.column("members")
        ends, leads = before.offsets.to_numpy(), before.values.to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1) | (flat["held"][1:] != flat["held"][:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            if a < b:
                out = {c: v[a:b].copy() for c, v in flat.items()}
                out["before"] = [leads[ends[i] : ends[i + 1]].copy() for i in range(a, b)]
                out["members"] = [np.frombuffer(raw[i].as_buffer(), U).copy() for i in range(a, b)]
                yield ids[a].copy(), out

    def run(batches):
        last, held, now = None, [], None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for own, rows in parts(batch):
                if last is None or (own != last).any():
                    last, held, now = own, [], None
                if rows["held"][0]:
                    held.append(rows)
                elif held:
                    now = now or Cell(held, num)
                    found += now.links(rows)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = rows.select(*cell, "held", "apart", "node", "label", "before", "members")
    return dealt.repartition(*cell).sortWithinPartitions(*cell, F.col("held").desc()).mapInArrow(run, "a bigint, b bigint")


def _none() -> Column:
    return F.array().cast("array<bigint>")


def leader_meetings(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Cells in which nodes meet leaders: ``pairs(lead, node)`` -> rows of cells (lead, chunk)."""
    size = pairs.groupBy("lead").agg(F.count("*").alias("size")).join(sets.withColumnRenamed("node", "lead"), "lead")
    chunks = F.ceil(F.greatest(F.col("size") / STREAMED, F.col("size") * F.col("n") / MEMBERS)).cast("int")
    size = size.select("lead", chunks.alias("chunks"), "members")
    chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    near = pairs.join(size.select("lead", "chunks"), "lead").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int")).join(sets, "node")

    def rows(df: DataFrame, node: str, held: bool, chunk: Column) -> DataFrame:
        return df.select("lead", chunk, F.lit(held).alias("held"), F.lit(False).alias("apart"), F.col(node).alias("node"), F.col(node).alias("label"), _none().alias("before"), "members")

    return rows(size, "lead", True, chunk).union(rows(near, "node", False, F.col("chunk")))


def later_meetings(groups: DataFrame, sets: DataFrame, labels: DataFrame, scratch: Scratch, parts: int) -> DataFrame | None:
    """Cells in which all nodes outside a group's largest component meet all of the group.

    ``lead, block, chunk, held, label, members``: blocks of held nodes times chunks of
    streamed ones. None if no group holds two components.
    """
    sized = labels.join(sets.select("node", "n"), "node")
    in_group = groups.join(sized, "node")
    kinds = in_group.groupBy("lead", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    most = F.max(F.struct("rows", "label", "n")).alias("most")
    mixed = kinds.groupBy("lead").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.count("*").alias("kinds"), most).where("kinds > 1")
    blocks = F.ceil(F.greatest((F.col("rows") - F.col("most.rows")) / HELD, (F.col("n") - F.col("most.n")) / MEMBERS)).cast("int")
    chunks = F.ceil(F.greatest(F.col("rows") / STREAMED, F.col("n") / MEMBERS)).cast("int")
    mixed = scratch.put(mixed.select("lead", F.col("most.label").alias("main"), blocks.alias("blocks"), chunks.alias("chunks")), "mixed", parts)
    if not mixed.limit(1).count():
        return None
    where = in_group.join(mixed, "lead").select(
        "lead",
        "node",
        "label",
        (F.col("label") != F.col("main")).alias("apart"),
        "blocks",
        "chunks",
        F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"),
        F.pmod(F.xxhash64("node", F.lit(1)), "chunks").cast("int").alias("chunk"),
    )
    leads = where.groupBy("node").agg(F.collect_list("lead").alias("leads")).join(sets.select("node", "members"), "node")
    past = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.col("chunk").alias("chunk"), F.lit(False).alias("held")))
    held = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.col("block").alias("block"), c.alias("chunk"), F.lit(True).alias("held")))
    places = F.concat(past, F.when(F.col("apart"), held).otherwise(F.array().cast("array<struct<block:int,chunk:int,held:boolean>>")))
    before = F.filter("leads", lambda x: x < F.col("lead"))
    placed = where.join(leads, "node").select("lead", "apart", "node", "label", before.alias("before"), "members", F.explode(places).alias("at"))
    return placed.select("lead", "at.block", "at.chunk", "at.held", "apart", "node", "label", "before", "members")


def join(docs: DataFrame, scratch: Scratch, k: int = 5, num: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, node, text_hash, head``.

    head marks the row of each class with the smallest doc_id (then text hash), and rows with empty sets.
    Two documents link when ``100 * intersection >= num * union`` of their ``k``-word shingle sets.
    """
    bands = Bands(num)
    docs = keyed(docs, scratch, id_col, text_col)
    nodes = scratch.put(document_nodes(docs, k), "nodes")
    moved = shared_ids(nodes)
    if moved:
        again = nodes.select("node", "check").distinct().mapInArrow(_renamed(moved), "node bigint, check bigint, other bigint")
        nodes = nodes.join(again.where("node <> other"), ["node", "check"], "left").withColumn("node", F.coalesce("other", "node")).drop("other")
        nodes = scratch.put(nodes, "nodes")
    star = scratch.put(stars(tile_rows(docs, k, bands, moved)), "stars")
    groups = scratch.put(groups_of(star), "groups")
    scratch.drop(star)

    def one_each(groups: DataFrame) -> DataFrame:
        """A row of each node in a group."""
        return nodes.join(groups.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("rid").alias("rid"))

    drawn = nodes.join(one_each(groups).select("rid"), "rid").select("node", "n", "sketch")
    near = scratch.put(near_groups(groups, drawn, num), "near")
    scratch.drop(groups)
    groups = near
    # one text of each node that may link with another one of a group
    wanted = one_each(groups).withColumnRenamed("node", "want")
    sets = scratch.put_bucketed(node_sets(docs.join(wanted, "rid").select("want", "text"), k, moved), "sets", "node")
    known = sets.count()
    parts = parts_for(known)

    labels = sets.select("node", F.col("node").alias("label"))

    def joined(rows: DataFrame, *cell: str) -> DataFrame:
        links = scratch.put(cell_links(rows, num, *cell), "links", parts)
        roots = connected_components(links, scratch)
        out = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
        out = scratch.put(out.select("node", F.coalesce("root", "label").alias("label")), "labels", parts)
        scratch.drop(links, roots)
        return out

    leaders = groups.where("lead = node").select("lead")
    first = groups.where("lead <> node").join(leaders, "lead", "left_semi").groupBy("node").agg(F.min("lead").alias("lead"))
    labels = joined(leader_meetings(first, sets), "lead", "chunk")
    rest = later_meetings(groups, sets, labels, scratch, parts)
    if rest is not None:
        labels = joined(rest, "lead", "block", "chunk")
    scratch.drop(groups, sets)

    marked = nodes.join(labels, "node", "left").select("doc_id", "text_hash", "n", "node", F.coalesce("label", "node").alias("label"))
    marked = scratch.put(marked, "marked")
    scratch.drop(nodes)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = marked.where("label is not null").groupBy("label").agg(F.min(order).alias("first"))
    out = marked.join(first, "label", "left")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    head = F.col("label").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "node", "text_hash", head.alias("head"))


def _renamed(moved: frozenset):
    def run(batches):
        for batch in batches:
            node, check = (batch.column(c).to_pylist() for c in ("node", "check"))
            other = [None if a is None else _moved_id(a, b) if (a, b) in moved else a for a, b in zip(node, check, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("check"), pa.array(other, pa.int64())], ["node", "check", "other"])

    return run


def keep_one(docs: DataFrame, scratch: Scratch, k: int = 5, num: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest doc_id of each class, and all rows with empty sets."""
    lost_id, lost_text, own_id, own_text = free_names(docs, "lost_id", "lost_text", "own_id", "own_text")
    found = join(docs, scratch, k, num, id_col, text_col).where("not head")
    lost = scratch.put(found.select(F.col("doc_id").alias(lost_id), F.col("text_hash").alias(lost_text)).distinct(), "lost")
    named = docs.withColumn(own_id, docs[id_col].cast("bigint")).withColumn(own_text, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    out = named.join(lost, F.col(own_id).eqNullSafe(F.col(lost_id)) & (F.col(own_text) == F.col(lost_text)), "left_anti")
    if docs.groupBy(docs[id_col]).agg(F.count("*").alias(own_text)).where(F.col(own_text) > 1).limit(1).count():
        # rows that share an id: one of those with equal texts
        out = out.dropDuplicates([own_id, own_text])
    return out.drop(own_id, own_text)
