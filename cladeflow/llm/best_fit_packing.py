"""Packing of tokenised documents into sequences by minimum bin slack.

Tokens are made once and only counts, lengths and checksums go on. Pieces shorter
than a sequence are described by a histogram of lengths (at most ``size - 1`` rows,
whatever the input). The planner fills one bin after another: it takes the longest
length left, then a bitset subset-sum over the lengths still available finds the
fullest feasible rest; the combination found is repeated as often as the histogram
allows and removed. The plan is bounded by the number of lengths too, so it is
broadcast; every piece finds its place by its rank among pieces of equal length,
which is counted in salted parts so that no length gathers in one task.

Defined cases: null text is empty text (one token, the end mark); rows may repeat,
share a doc_id or have none, each is packed; an empty table gives an empty result;
further columns are ignored by ``pack``.
"""

from __future__ import annotations

import itertools
import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cladeflow.runtime import Scratch

#: Tokens in a sequence, and the id that ends every document.
SIZE, END = 2048, 0
#: Words longer than this (characters) are not remembered; entries kept before the memory is emptied.
MEMO_BYTES, MEMO_ENTRIES = 64, 250_000
#: Rows of a salted part when ranks are counted.
PART_ROWS = 200_000

# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Marks that end a word as a pre-token of their own.
MARKS = frozenset(".,;:!?")

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteLevelIds:
    """Ids of a byte-level BPE vocabulary file as little-endian unsigned 32-bit bytes.

    The split pattern always ends a pre-token before a lone space or line feed, so a
    text without two white-space characters in a row falls into words that can be
    encoded apart; each distinct word is encoded once per worker.
    """

    def __init__(self, path: str):
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        marks = spec.get("added_tokens", [])
        if any(t.get(k) for t in marks for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take white space or word ends along are not supported")
        added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in marks}
        # a text is cut at added tokens first; the leftmost is taken, and of those the longest
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        self._added = added
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ids, self._piece = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece
        self._runs = re.compile(r"\s\s").search
        self._first: dict[str, bytes] = {}
        self._later: dict[str, bytes] = {}
        self._marks = {m: self._encode(m) for m in MARKS}

    def _encode(self, text: str) -> bytes:
        return array("I", self._ids(text)).tobytes()

    def _word(self, memo: dict[str, bytes], word: str, lead: str) -> bytes:
        if word.isalpha():  # a single pre-token
            return array("I", self._piece((lead + word).encode())).tobytes()
        stem = word[:-1]
        if word[-1:] in MARKS and stem.isalpha():  # two pre-tokens
            ids = memo.get(stem)
            if ids is None:
                ids = self._word(memo, stem, lead)
                if len(stem) <= MEMO_BYTES:
                    memo[stem] = ids
            return ids + self._marks[word[-1]]
        return self._encode(lead + word)

    def _look(self, memo: dict[str, bytes], words: list[str], lead: str) -> list[bytes]:
        try:
            return [memo[w] for w in words]
        except KeyError:
            pass
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        out = []
        for w in words:
            ids = memo.get(w)
            if ids is None:
                ids = self._word(memo, w, lead)
                if len(w) <= MEMO_BYTES:
                    memo[w] = ids
            out.append(ids)
        return out

    def __call__(self, text: str) -> bytes:
        if self._cut:
            plain, *rest = self._cut(text)
            if rest:  # added tokens and what stands between them take turns
                return b"".join([self._plain(plain), *(self._plain(x) if k % 2 else self._added[x] for k, x in enumerate(rest))])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if self._runs(text):
            return self._encode(text)
        lines, feed = [], self._encode("\n")
        for line in text.split("\n"):
            first, *later = line.split(" ")
            lines.append(b"".join(self._look(self._first, [first], "") + self._look(self._later, later, " ")))
        return feed.join(lines)


assert sys.byteorder == "little" and array("I").itemsize == 4

_loaded: dict[str, ByteLevelIds] = {}


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces of all documents; of a long document the first piece may be short."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _loaded.get(vocabulary) or _loaded.setdefault(vocabulary, ByteLevelIds(vocabulary))
        end = END.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                start, stop = 0, (n - 1) % size + 1
                for piece in itertools.count():
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    if stop == n:
                        break
                    start, stop = stop, stop + size
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how many of each, within ``counts``, whose sum is the largest up to ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        many = 1
        while left:
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= (reach << (length * many)) & mask
            left -= many
            many *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            total -= length * many
            used[length] = used.get(length, 0) + many
    return used


def plan_bins(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first bin, pieces a bin, offset) that place every piece."""
    left = {k: v for k, v in histogram.items() if v}
    ranks = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fullest({k: v for k, v in left.items() if v}, size - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in used.items()), 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, ranks[length], ranks[length] + n * times, bins, n, offset))
            ranks[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        bins += times
    return rows


def pack(docs: DataFrame, scratch: Scratch, vocabulary: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its place (``sequence_id``, ``offset``) besides what ``pieces`` returns."""
    spark = docs.sparkSession
    cut = scratch.put(pieces(docs, vocabulary or default_vocabulary(), size, id_col, text_col), "pieces")
    full = cut.where(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    short = cut.where(F.col("length") < size)
    total = short.count()
    salts = max(8, min(4096, total // PART_ROWS + 1))
    short = short.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    parts = short.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.put(parts.select("length", "salt", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "parts")
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size - 1 rows
    plan = spark.createDataFrame(plan_bins(histogram, size), "length bigint, lo bigint, hi bigint, bin bigint, per_bin bigint, at bigint")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = short.withColumn("own", F.row_number().over(own) - 1).join(parts.select("length", "salt", "base"), ["length", "salt"]).withColumn("rank", F.col("own") + F.col("base"))
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    placed = placed.select(
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("bin") + F.expr("(rank - lo) div per_bin")).alias("sequence_id"),
        (F.col("at") + nth % F.col("per_bin") * ranked["length"]).alias("offset"),
    )
    return placed.unionByName(full)
