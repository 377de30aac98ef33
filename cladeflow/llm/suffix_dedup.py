"""Removal of repeated byte strings by a sparse, range-partitioned suffix sort.

A byte goes if a string of ``span`` bytes that covers it also starts earlier. Sorting
every suffix would move many times the corpus, so only anchored suffixes are sorted:
positions whose ``SEED``-byte hash is smallest in some window of ``span`` bytes. Equal
strings of ``span`` bytes have their anchors at equal places, so no repeat is missed.

1. Anchored suffixes are dealt to buckets by their leading ``SEED`` bytes, then by context,
   between splitters sampled from the corpus. Each bucket is sorted by a multikey quicksort
   over the bytes themselves, eight at a time. Context is all that strings through the
   anchor can hold: ``span - SEED`` bytes before it and ``span`` after. Neighbours with
   equal context repeat the first of them wholly.
2. A seed in very many contexts fills several buckets, so the outer suffixes of buckets are
   compared across their boundaries: a seed on both sides is one with different contexts.
3. Suffixes with equal seeds but different contexts are where repeats begin and end. The
   strings through them are taken in blocks of neighbours: a block whose core (what all its
   strings share) stands nowhere else is settled, one that equals an earlier block repeats
   it, and only the strings of the few that are left are compared one by one.
4. What repeats meets its document again, overlaps are merged and the rest is kept.

Equal suffixes with equal context never straddle a boundary. Repeats inside a batch are
settled before the shuffle, and those of a bucket whenever ``RUN`` rows are in hand, so a
passage in very many documents never gathers in one place. Long texts are read in
overlapping pieces. Suffixes and strings are equal if ``SEED`` bytes and a 64-bit
fingerprint of the rest are, blocks if two such fingerprints are.

Defined cases: null text is empty text; texts shorter than ``span`` are left alone; rows
that repeat a doc_id (or have none) are documents of their own, ordered by doc_id, null
last, then text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cladeflow.llm import shingles as S
from cladeflow.llm.keys import keyed
from cladeflow.runtime import Scratch

U = np.uint64
SPAN, SEED = 100, 32
#: Buckets per shuffle partition; documents sampled per bucket, and every so many of their suffixes taken.
BUCKETS, SAMPLE_DOCS, THIN = 4, 8, 16
#: Rows of a bucket that are gathered before their repeats are let go; rows that are sorted as one leaf.
RUN, LEAF = 1 << 20, 4096
#: Strings in a block of neighbours.
BLOCK = 9
#: Bytes of a long text read at once.
PIECE = 1 << 20

FOUND = "kind int, rid bigint, s bigint, e bigint"
#: Kinds of finding: repeats an earlier string, must be looked at closely, stands at the boundary of a bucket.
REPEAT, CLOSER, OUTER = 0, 1, 2


def _sliding(x: np.ndarray, w: int, fold: np.ufunc, fill: U) -> np.ndarray:
    """``fold`` over every run of ``w`` values (length ``len(x) - w + 1``)."""
    n = len(x)
    padded = np.full(-(-n // w) * w, fill, U)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = fold.accumulate(blocks, axis=1).ravel()
    back = fold.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(back[: n - w + 1], ahead[w - 1 : n])


class Slice:
    """Seed hashes, window minima and anchors of a slice of documents.

    A piece of a long text begins ``shift`` bytes into it and owns the places ``core``.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, span: int, anchored: bool = True, shift: int = 0, core: tuple[int, int] | None = None):
        self.data, self.off, self.span, self.shift, self.core = data, off, span, shift, core
        self.windows = span - SEED + 1
        n = len(data)
        up, self.down = S._powers(n + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, U)
            np.cumsum(S._TABLE[data] * up[:-1], out=self.sums[1:])
        self.ok = n >= span
        if not self.ok or not anchored:
            self.anchors = np.zeros(0, np.int64)
            return
        at = np.arange(n - SEED + 1)
        self.seed = self.hashes(at, at + SEED)
        self.low = _sliding(self.seed, self.windows, np.minimum, U(2**64 - 1))
        size = np.diff(off)
        self.row = np.repeat(np.arange(len(size)), size)
        inside = self.row[: n - span + 1] == self.row[span - 1 :]
        self.low[~inside] = 0
        # an anchor is the minimum of some window that it lies in
        edge = np.zeros(self.windows - 1, U)
        top = _sliding(np.concatenate([edge, self.low, edge]), self.windows, np.maximum, U(0))
        self.anchors = np.flatnonzero(top == self.seed)
        if core:
            self.anchors = self.anchors[(self.anchors >= core[0] - shift) & (self.anchors < core[1] - shift)]

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return S.mix((self.sums[e] - self.sums[s]) * self.down[s])

    def leads(self, at: np.ndarray) -> np.ndarray:
        """The ``SEED`` bytes from each place on, as big-endian words."""
        if not len(at):
            return np.zeros((0, SEED // 8), U)
        return np.lib.stride_tricks.sliding_window_view(self.data, SEED)[at].view(">u8").astype(U)

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context hash of each anchor, its row, and the context's start and end in the row."""
        a = self.anchors
        row = self.row[a] if len(a) else a
        s = np.maximum(self.off[row], a - (self.span - SEED))
        e = np.minimum(self.off[row + 1], a + self.span)
        with np.errstate(over="ignore"):
            ctx = S.mix(self.hashes(s, e) + ((a - s) * 256 + (e - a)).astype(U))
        return ctx.view(np.int64), row, s - self.off[row] + self.shift, e - self.off[row] + self.shift

    def blocks(self, places: np.ndarray) -> tuple[np.ndarray, ...]:
        """Core hash, hull hash, row, start and end of the blocks of strings through ``places``.

        A block holds the strings that start ``j * BLOCK .. (j + 1) * BLOCK - 1`` bytes before
        the anchor, as far as they lie in the document; only blocks of which some string has
        its minimum at the anchor are needed. The core is what all of them share, wherever
        they are cut off, the hull all that they cover.
        """
        near = places[:, None] - np.arange(self.windows)[None, :]
        own = (near >= 0) & (near < len(self.low))
        own &= self.low[np.clip(near, 0, len(self.low) - 1)] == self.seed[places][:, None]
        count = -(-self.windows // BLOCK)
        own = np.pad(own, ((0, 0), (0, count * BLOCK - self.windows))).reshape(len(places), count, BLOCK).any(axis=2)
        i, j = np.nonzero(own)
        a, row = places[i], self.row[places[i]]
        first, last = j * BLOCK, np.minimum((j + 1) * BLOCK, self.windows) - 1
        lo, hi = np.maximum(first, a + self.span - self.off[row + 1]), np.minimum(last, a - self.off[row])
        s, e = a - hi, a - lo + self.span
        with np.errstate(over="ignore"):
            core = S.mix(self.hashes(a - first, a - last + self.span) + j.astype(U))
            hull = S.mix(self.hashes(s, e) + ((lo << 8) + hi).astype(U))
        return core[:, None], hull.view(np.int64), row, s - self.off[row] + self.shift, e - self.off[row] + self.shift


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of ``words`` (n x depth, unsigned), by their first word, then the next.

    Rows are split three ways about a pivot at one depth; only those equal to the pivot go
    on to the next depth, so a prefix that many rows share is read once.
    """
    n, depth = words.shape
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2 or d == depth:
            continue
        rows = order[lo:hi]
        if hi - lo <= LEAF:
            order[lo:hi] = rows[np.lexsort(words[rows, d:].T[::-1])]
            continue
        column = words[rows, d]
        pivot = np.sort(column[:: max(1, len(column) // 9)])[4]
        below, above = column < pivot, column > pivot
        mid, end = lo + int(below.sum()), hi - int(above.sum())
        order[lo:hi] = np.concatenate([rows[below], rows[~(below | above)], rows[above]])
        todo += [(lo, mid, d), (mid, end, d + 1), (end, hi, d)]
    return order


def _same(words: np.ndarray) -> np.ndarray:
    """Is each row that before it? (the first isn't)"""
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]).all(axis=1)
    return same


def _settle(lead, ctx, rid, s, e):
    """Rows sorted by (lead, context, place), and whether each repeats the row before."""
    order = multikey_quicksort(np.column_stack([lead, ctx.view(U), rid.view(U) ^ U(1 << 63), s.astype(U)]))
    lead, ctx, rid, s, e = (x[order] for x in (lead, ctx, rid, s, e))
    again = _same(lead)
    again[1:] &= ctx[1:] == ctx[:-1]
    return lead, ctx, rid, s, e, again


def _merged(rid: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ``[s, e)`` per rid, as maximal runs (touching ones join)."""
    if not len(rid):
        return rid, s, e
    order = np.lexsort((s, rid))
    rid, s, e = rid[order], s[order], e[order]
    new = np.ones(len(rid), bool)
    first = np.concatenate([[True], rid[1:] != rid[:-1]])
    lift = np.cumsum(first) * (int(e.max()) + 1)  # keeps the running maximum of one rid off the next
    far = np.maximum.accumulate(e + lift) - lift
    new[1:] = first[1:] | (s[1:] > far[:-1])
    cut = np.flatnonzero(new)
    return rid[cut], s[cut], np.maximum.reduceat(e, cut)


ROWS = "bucket bigint, lead binary, ctx bigint, rid bigint, s bigint, e bigint, done boolean"
_ROW_NAMES = ["bucket", "lead", "ctx", "rid", "s", "e", "done"]


def _packed(lead: np.ndarray) -> pa.Array:
    """Rows of words as a column of equally long byte strings."""
    n, width = len(lead), lead.shape[1] * 8
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(lead.astype(">u8").tobytes())])


def _unpacked(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, SEED // 8), U)
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return raw.reshape(len(column), -1).view(">u8").astype(U)


def _ranks(lead: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Suffixes as byte strings that compare as (lead, context)."""
    both = np.ascontiguousarray(np.column_stack([lead, ctx.view(U)]).astype(">u8"))
    return both.view(f"S{both.shape[1] * 8}").ravel()


def _emit(parts: list[tuple], splitters: np.ndarray | None) -> pa.RecordBatch:
    """A batch's rows for the shuffle: what it settles itself is spread, the rest goes by key."""
    lead, ctx, rid, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    lead, ctx, rid, s, e, again = _settle(lead, ctx, rid, s, e)
    ar, as_, ae = _merged(rid[again], s[again], e[again])
    lead, ctx, rid, s, e = (x[~again] for x in (lead, ctx, rid, s, e))
    if splitters is None:
        bucket = S.mix(lead[:, 0]).view(np.int64)
    else:
        bucket = np.searchsorted(splitters, _ranks(lead, ctx), "right").astype(np.int64)
    with np.errstate(over="ignore"):
        spread = S.mix(ar.view(U) ^ S.mix(as_.view(U))).view(np.int64)
    if splitters is not None:
        spread = spread % (len(splitters) + 1)
    none, zero = np.zeros((len(ar), lead.shape[1]), U), np.zeros(len(ar), np.int64)
    cols = [np.concatenate(x) for x in ((ctx, zero), (rid, ar), (s, as_), (e, ae))]
    done = np.concatenate([np.zeros(len(lead), bool), np.ones(len(ar), bool)])
    front = [pa.array(np.concatenate([bucket, spread])), _packed(np.concatenate([lead, none]))]
    return pa.RecordBatch.from_arrays([*front, *(pa.array(c) for c in cols), pa.array(done)], _ROW_NAMES)


def _slices(batch: pa.RecordBatch, span: int, anchored: bool = True):
    rid = batch.column("rid").to_numpy(zero_copy_only=False)
    for base, rows, data, off in S.text_slices(batch.column("text")):
        if len(data) <= PIECE:
            yield base, rid[base : base + rows], Slice(data, off, span, anchored)
            continue
        for lo in range(0, len(data), PIECE):  # a slice beyond the usual size is a single text
            a, b = max(0, lo - 2 * span), min(len(data), lo + PIECE + 2 * span)
            yield base, rid[base : base + rows], Slice(data[a:b], np.array([0, b - a]), span, anchored, a, (lo, lo + PIECE))


def _pairs(value: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    return value.values.field(0).to_numpy(), value.values.field(1).to_numpy()


def anchor_rows(docs: DataFrame, span: int, splitters: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(splitters)

    def run(batches):
        for batch in batches:
            parts = []
            for _, rid, x in _slices(batch, span):
                if len(x.anchors):
                    ctx, row, s, e = x.contexts()
                    parts.append((x.leads(x.anchors), ctx, rid[row], s, e))
            if parts:
                yield _emit(parts, shared.value)

    return docs.select("rid", "text").mapInArrow(run, ROWS)


def sample_splitters(docs: DataFrame, span: int, buckets: int) -> np.ndarray:
    """Suffixes that cut the corpus into about equal buckets, from a sample bounded by the buckets."""
    share = min(1.0, SAMPLE_DOCS * buckets / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("rid"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)

    def run(batches):
        for batch in batches:
            for _, _, x in _slices(batch, span):
                if len(x.anchors):
                    ctx, *_ = x.contexts()
                    lead = np.column_stack([x.leads(x.anchors), ctx.view(U)])[::THIN]
                    yield pa.RecordBatch.from_arrays([_packed(lead)], ["lead"])

    keys = [bytes(r.lead) for r in sample.select("rid", "text").mapInArrow(run, "lead binary").toLocalIterator()]
    keys = np.sort(np.array(keys, f"S{SEED + 8}"))
    return np.unique(keys[[len(keys) * i // buckets for i in range(1, buckets)]]) if len(keys) else keys


def _rows(kind: int, rid: np.ndarray, s: np.ndarray, e: np.ndarray, lead: np.ndarray | None = None, bucket: int = 0) -> pa.RecordBatch:
    n = len(rid)
    leads = pa.nulls(n, pa.binary()) if lead is None else _packed(lead)
    cols = [pa.array(np.full(n, kind, np.int32)), pa.array(rid), pa.array(s), pa.array(e), leads, pa.array(np.full(n, bucket, np.int64))]
    return pa.RecordBatch.from_arrays(cols, ["kind", "rid", "s", "e", "lead", "bucket"])


def sort_buckets(rows: DataFrame) -> DataFrame:
    """``kind, rid, s, e`` and, of suffixes at the boundaries of buckets, ``lead, bucket``."""

    def settle(held: list[tuple]) -> tuple[tuple, pa.RecordBatch]:
        *cols, again = _settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return tuple(x[~again] for x in cols), _rows(REPEAT, *(x[again] for x in cols[2:]))

    def close(held: list[tuple], bucket: int):
        (lead, _, *place), repeats = settle(held)
        yield repeats
        same = _same(lead)  # has a suffix with its seed and another context before it
        tell = same.copy()
        tell[:-1] |= same[1:]
        yield _rows(CLOSER, *(x[tell] for x in place))
        outer = np.unique([0, len(lead) - 1])
        yield _rows(OUTER, *(x[outer] for x in place), lead[outer], bucket)

    def run(batches):
        held, size, at = [], 0, None
        for batch in batches:
            done = batch.column("done").to_numpy(zero_copy_only=False)
            live = batch.filter(pa.array(~done))
            yield _rows(REPEAT, *(batch.column(c).to_numpy()[done] for c in ("rid", "s", "e")))
            bucket = live.column("bucket").to_numpy()
            cols = (_unpacked(live.column("lead")), *(live.column(c).to_numpy() for c in ("ctx", "rid", "s", "e")))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if at is not None and bucket[a] != at:
                    yield from close(held, at)
                    held, size = [], 0
                at = int(bucket[a])
                held.append(tuple(x[a:b] for x in cols))
                size += b - a
                if size >= RUN:
                    firsts, repeats = settle(held)
                    yield repeats
                    held, size = [firsts], 0
        if held:
            yield from close(held, at)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, f"{FOUND}, lead binary, bucket bigint")


def across_boundaries(found: DataFrame) -> DataFrame:
    """Suffixes at boundaries whose seed goes on in another bucket, in other contexts."""
    outer = found.where(F.col("kind") == OUTER)
    split = outer.groupBy("lead").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo < hi")
    return outer.join(split.select("lead"), "lead").select(F.lit(CLOSER).alias("kind"), "rid", "s", "e")


def resolve(rows: DataFrame, by_context: bool) -> DataFrame:
    """``kind, rid, s, e``: kind 0 repeats an earlier string, kind 1 is an anchor to look at closely."""

    def run(batches):
        last = None  # (key, ctx, rid, s, e, already told) of the row before
        for batch in batches:
            ctx, rid, s, e = (batch.column(c).to_numpy() for c in ("ctx", "rid", "s", "e"))
            key = _unpacked(batch.column("lead"))
            done = batch.column("done").to_numpy(zero_copy_only=False)
            out = [(np.zeros(done.sum(), np.int32), rid[done], s[done], e[done])]
            live = ~done
            key, ctx, rid, s, e = (x[live] for x in (key, ctx, rid, s, e))
            if len(key):
                joins = last is not None and np.array_equal(last[0], key[0])
                again = _same(key)
                again[1:] &= ctx[1:] == ctx[:-1]
                again[0] = joins and last[1] == ctx[0]
                out.append((np.zeros(again.sum(), np.int32), rid[again], s[again], e[again]))
                if by_context:
                    first = np.flatnonzero(~again)
                    same = _same(key[first])  # has the first of another context before it
                    if len(first):
                        same[0] = joins and np.array_equal(last[0], key[first[0]])
                    tell = same.copy()
                    tell[:-1] |= same[1:]
                    if len(first) and same[0] and not last[5]:
                        out.append(tuple(np.array([v], t) for v, t in zip((1, *last[2:5]), (np.int32, np.int64, np.int64, np.int64), strict=True)))
                        last = (*last[:5], True)
                    told = first[tell]
                    out.append((np.ones(len(told), np.int32), rid[told], s[told], e[told]))
                    if len(first):
                        f = first[-1]
                        # the first of this context stays in hand until its key is over
                        last = (key[f], ctx[-1], rid[f], s[f], e[f], bool(tell[-1]))
                else:
                    last = (key[-1], ctx[-1])
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "rid", "s", "e"])

    return rows.repartition("bucket").sortWithinPartitions("lead", "ctx", "rid", "s").mapInArrow(run, FOUND)


def block_rows(edges: DataFrame, span: int) -> DataFrame:
    """Blocks of strings through the anchors ``places`` (context starts and ends) of each document."""

    def run(batches):
        for batch in batches:
            parts = []
            places = batch.column("places")
            for base, rid, x in _slices(batch, span):
                if not len(x.anchors):
                    continue
                _, row, s, e = x.contexts()
                mine = (row << 40) + s * 1024 + (e - s)
                want = []
                for i in range(len(rid)):
                    ws, we = _pairs(places[base + i])
                    want.append((np.int64(i) << 40) + ws * 1024 + (we - ws))
                core, hull, row, s, e = x.blocks(x.anchors[np.isin(mine, np.concatenate(want))])
                parts.append((core, hull, rid[row], s, e))
            if parts:
                yield _emit(parts, None)

    return edges.mapInArrow(run, ROWS)


def string_rows(edges: DataFrame, span: int) -> DataFrame:
    """All strings inside the blocks ``places`` of each document."""

    def run(batches):
        for batch in batches:
            parts = []
            places = batch.column("places")
            for base, rid, x in _slices(batch, span, anchored=False):
                starts, rows = [], []
                for i in range(len(rid)):
                    s, e = _pairs(places[base + i])
                    if x.core:
                        own = (s >= x.core[0]) & (s < x.core[1])
                        s, e = s[own], e[own]
                    n = e - s - span + 1
                    p = np.unique(np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    starts.append(p + x.off[i] - x.shift)
                    rows.append(np.full(len(p), i))
                p, row = np.concatenate(starts), np.concatenate(rows)
                at = p - x.off[row] + x.shift
                parts.append((x.leads(p), x.hashes(p, p + span).view(np.int64), rid[row], at, at + span))
            if parts:
                yield _emit(parts, None)

    return edges.mapInArrow(run, ROWS)


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def cut_out(joined: DataFrame) -> DataFrame:
    """Digest of each document without its spans, from ``doc_id, text, spans``."""

    def run(batches):
        for batch in batches:
            rows = []
            spans = batch.column("spans")
            for base, n, data, off in S.text_slices(batch.column("text")):
                for i in range(n):
                    text = data[off[i] : off[i + 1]]
                    removed = runs = 0
                    if spans[base + i].is_valid:
                        s, e = _pairs(spans[base + i])
                        _, s, e = _merged(np.zeros(len(s), np.int64), s, e)
                        keep = np.ones(len(text), bool)
                        for a, b in zip(s, e, strict=True):
                            keep[a:b] = False
                        removed, runs = int((e - s).sum()), len(s)
                        text = text[keep]
                    rows.append((int(off[i + 1] - off[i]), removed, runs, hashlib.sha256(text.tobytes()).hexdigest()))
            if rows:
                a, b, c, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return joined.mapInArrow(run, RESULT)


def repeated_spans(docs: DataFrame, scratch: Scratch, span: int = SPAN) -> DataFrame:
    """``rid, spans`` (array of struct s, e; overlapping, unordered) of what goes from ``rid, text``."""
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.put(sort_buckets(anchor_rows(docs, span, sample_splitters(docs, span, buckets))), "suffixes")
    pair = F.struct("s", "e")

    def edges(rows: DataFrame) -> DataFrame:
        places = rows.where("kind = 1").groupBy("rid").agg(F.collect_list(pair).alias("places"))  # of one document
        return docs.select("rid", "text").join(places, "rid")

    closer = found.select("kind", "rid", "s", "e").unionByName(across_boundaries(found))
    blocks = scratch.put(resolve(block_rows(edges(closer), span), True), "blocks")
    strings = scratch.put(resolve(string_rows(edges(blocks), span), False), "strings")
    covers = found.select("kind", "rid", "s", "e").unionByName(blocks).where("kind = 0").unionByName(strings)
    return covers.groupBy("rid").agg(F.collect_list(pair).alias("spans"))


def deduplicate(docs: DataFrame, scratch: Scratch, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    rows = keyed(docs, scratch, id_col, text_col)
    spans = repeated_spans(rows, scratch, span)
    return cut_out(rows.join(spans, "rid", "left").select("doc_id", "text", "spans"))
