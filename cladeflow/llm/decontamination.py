"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The test items are the stated query set. They are indexed in blocks of bounded size;
each block's index is broadcast and meets all documents in two scans: one counts in
how many documents each of its n-grams occurs, the other looks seeds up. The rarest n-gram
of every ``WINDOW`` neighbours in an item (of fewer in a short one) is a seed, so each
stretch of some words has one, and an item that leaked into many documents keeps its
seeds however frequent they have become. Only passages that hold a seed are aligned,
with the whole item, word by word. A passage counts from half of the item's full score,
or from the score of ``MIN_WORDS`` words in a row, which a quote of a long item reaches.

Defined cases: words are runs of letters, digits and non-ASCII characters, A-Z read as
a-z; an item of fewer than ``n`` words has no seeds and matches nothing; null texts and
null items are empty; an item id that repeats is several items; rows may repeat, each is
reported; a doc_id may be null; with no items or no documents the result is empty;
further columns are ignored by ``matches`` and passed through by ``drop_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cladeflow.llm import shingles as S
from cladeflow.runtime import Scratch, free_names

U = np.uint64
#: Words of a seed; alignment score from which a document counts as contaminated.
SEED_WORDS, MIN_SCORE = 3, 0.5
#: Neighbouring n-grams of which the rarest is a seed; words whose score is enough, however long the item.
WINDOW, MIN_WORDS = 4, 13
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Cells (candidates x passage words) aligned at once.
CELLS = 1 << 20

MATCH, MISMATCH, GAP = 2, -1, -1

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[48:58] = _NOT_WORD[97:123] = _NOT_WORD[128:] = False


def word_rows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every word of a slice, and first word of each row."""
    low = S.lower_ascii(data)
    s, e, row = S.words(low, off, _NOT_WORD)
    h = S.word_hashes(low, s, e) if len(s) else np.zeros(0, U)
    return h, np.searchsorted(row, np.arange(len(off)), "left")


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word position and fingerprint of all n-grams that stay in a row."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    with np.errstate(over="ignore"):
        g = np.zeros(len(h) - n + 1, U)
        for j in range(n):
            g += h[j : j + len(g)] * U(pow(0xD6E8FEB86659FD93, j + 1, 2**64))
    row = np.searchsorted(first, np.arange(len(h)), "right")
    same = row[: len(g)] == row[n - 1 :]
    return np.flatnonzero(same), S.mix(g[same])


class Items:
    """Index of a block of items: words of each, and where each n-gram occurs."""

    def __init__(self, texts: list[str], n: int):
        _, _, data, off = next(S.text_slices(pa.array(texts, pa.string()), 1 << 62))
        self.words, self.first = word_rows(data, off)
        at, g = grams(self.words, self.first, n)
        order = np.argsort(g, kind="stable")
        self.gram, self.at = g[order], at[order]
        self.keys, self.begin = np.unique(self.gram, return_index=True)
        self.begin = np.append(self.begin, len(self.gram))
        self.item = np.searchsorted(self.first, self.at, "right") - 1

    def choose_seeds(self, df: np.ndarray) -> None:
        """Keep the rarest n-gram of all windows of neighbours in each item, and forget the others."""
        freq = np.zeros(len(self.gram), np.int64)
        freq[:] = df[np.searchsorted(self.keys, self.gram)]
        place = np.lexsort((self.at, self.item))  # n-grams item by item, in order
        seed = np.zeros(len(place), bool)
        cuts = np.flatnonzero(np.diff(self.item[place])) + 1
        for own in np.split(place, cuts) if len(place) else ():
            width = max(1, min(WINDOW, len(own) // WINDOW))
            windows = np.lib.stride_tricks.sliding_window_view(freq[own], width)
            seed[own[np.unique(np.arange(len(windows)) + windows.argmin(axis=1))]] = True
        self.gram, self.at, self.item = self.gram[seed], self.at[seed], self.item[seed]
        self.keys, self.begin = np.unique(self.gram, return_index=True)
        self.begin = np.append(self.begin, len(self.gram))

    def lookup(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into ``g`` that are known, and their places in ``keys``."""
        if not len(self.keys):
            return np.zeros(0, int), np.zeros(0, int)
        k = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[k] == g)
        return hit, k[hit]


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """Best local alignment score of each (item, passage), in words."""
    out = [0.0] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    while order:
        width = len(pairs[order[-1]][1])
        take = order[-max(1, CELLS // max(1, width)) :]
        del order[-len(take) :]
        deep = max(len(pairs[i][0]) for i in take)
        item = np.zeros((len(take), deep), U)
        text = np.ones((len(take), width), U)  # 0 and 1 pad; fingerprints are neither but by a 2^-63 chance
        for r, i in enumerate(take):
            item[r, : len(pairs[i][0])], text[r, : len(pairs[i][1])] = pairs[i]
        slope = np.arange(width + 1, dtype=np.int32) * -GAP
        h = np.zeros((len(take), width + 1), np.int32)
        best = np.zeros(len(take), np.int32)
        for j in range(deep):
            step = h[:, :-1] + np.where(item[:, j : j + 1] == text, MATCH, MISMATCH)
            up = np.maximum(h + GAP, 0)
            up[:, 1:] = np.maximum(up[:, 1:], step)
            h = np.maximum.accumulate(up + slope, axis=1) - slope  # gaps in the item
            best = np.maximum(best, h.max(axis=1))
        for r, i in enumerate(take):
            out[i] = float(best[r]) / MATCH
    return out


def _candidates(items: Items, h: np.ndarray, first: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, first word, end word) of passages that hold a seed."""
    at, g = grams(h, first, n)
    hit, key = items.lookup(g)
    if not len(hit):
        return
    times = items.begin[key + 1] - items.begin[key]
    where = np.repeat(items.begin[key], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    pos, item = np.repeat(at[hit], times), items.item[where]
    row = np.searchsorted(first, pos, "right") - 1
    order = np.lexsort((pos, item, row))
    pos, item, row = pos[order], item[order], row[order]
    size = np.diff(np.append(items.first, len(items.words)))[: len(items.first)]
    new = np.ones(len(pos), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > 2 * size[item[1:]])
    cut = np.flatnonzero(new)
    for c in range(len(cut)):
        a, b = cut[c], cut[c + 1] - 1 if c + 1 < len(cut) else len(pos) - 1
        r, i = int(row[a]), int(item[a])
        yield r, i, max(int(first[r]), int(pos[a]) - int(size[i])), min(int(first[r + 1]), int(pos[b]) + n + int(size[i]))


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for r in items.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t)
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def matches(
    docs: DataFrame,
    items: DataFrame,
    scratch: Scratch,
    n: int = SEED_WORDS,
    min_score: float = MIN_SCORE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """``doc_id, item_id, score, n_passages, row_hash`` of every document and item that align.

    score is the best of the item's passages in the document; ``row_hash`` tells rows
    that share a doc_id apart.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("row_hash"))
    schema = "doc_id bigint, item_id bigint, score double, n_passages bigint, row_hash bigint"
    out = spark.createDataFrame([], schema)
    for ids, texts in _blocks(items, item_col, "text"):
        index = Items(texts, n)
        if not len(index.keys):
            continue
        shared = spark.sparkContext.broadcast(index)

        def count(batches, shared=shared):
            index, df = shared.value, None
            df = np.zeros(len(index.keys), np.int64)
            for batch in batches:
                for _, rows, data, off in S.text_slices(batch.column(0)):
                    h, first = word_rows(data, off)
                    at, g = grams(h, first, n)
                    hit, key = index.lookup(g)
                    row = np.searchsorted(first, at[hit], "right")
                    seen = np.unique(row.astype(np.int64) * len(index.keys) + key)
                    df += np.bincount(seen % len(index.keys), minlength=len(index.keys))
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["gram", "df"])

        counted = docs.select("text").mapInArrow(count, "gram bigint, df bigint").groupBy("gram").agg(F.sum("df").alias("df"))
        df = np.zeros(len(index.keys), np.int64)
        for r in counted.toLocalIterator():  # at most one row per n-gram of the block
            df[r.gram] = r.df
        index.choose_seeds(df)
        seeded = spark.sparkContext.broadcast((index, ids))

        def find(batches, seeded=seeded):
            index, ids = seeded.value
            size = np.append(index.first, len(index.words))
            for batch in batches:
                found = []
                for base, rows, data, off in S.text_slices(batch.column("text")):
                    h, first = word_rows(data, off)
                    cands = list(_candidates(index, h, first, n))
                    scores = align([(index.words[size[i] : size[i + 1]], h[a:b]) for _, i, a, b in cands])
                    best: dict[tuple[int, int], list] = {}
                    for (r, i, _, _), words in zip(cands, scores, strict=True):
                        score = words / float(size[i + 1] - size[i])
                        if score >= min_score or words >= MIN_WORDS:
                            own = best.setdefault((base + r, i), [0.0, 0])
                            own[0], own[1] = max(own[0], score), own[1] + 1
                    found += [(r, ids[i], s, c) for (r, i), (s, c) in best.items()]
                if found:
                    r, i, s, c = zip(*found, strict=True)
                    r = pa.array(r, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(r), pa.array(i, pa.int64()), pa.array(s), pa.array(c, pa.int64()), batch.column("row_hash").take(r)],
                        ["doc_id", "item_id", "score", "n_passages", "row_hash"],
                    )

        out = out.unionByName(scratch.put(docs.mapInArrow(find, schema), "matches"))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no passage of any item."""
    found = matches(docs, items, scratch, id_col=id_col, text_col=text_col, **options)
    lost_id, lost_text, own_id, own_text = free_names(docs, "lost_id", "lost_text", "own_id", "own_text")
    leaks = scratch.put(found.select(F.col("doc_id").alias(lost_id), F.col("row_hash").alias(lost_text)).distinct(), "leaks")
    marked = docs.withColumn(own_id, docs[id_col].cast("bigint")).withColumn(own_text, F.xxhash64(docs[text_col]))
    return marked.join(leaks, F.col(own_id).eqNullSafe(F.col(lost_id)) & (F.col(own_text) == F.col(lost_text)), "left_anti").drop(own_id, own_text)
