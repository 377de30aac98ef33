"""Licence detection by a positional index of rare template words.

Templates are short canonical passages; their words form a small vocabulary. One scan
counts in how many documents each vocabulary word occurs; the words of the highest
inverse document frequency of each template become its index words. A second scan looks
up each file's index words, intersects the templates' postings by relative position
(word position less template position), weighs what agrees, and accepts a label where
the template's mandatory key phrase stands at its place and enough of the template
around it does. The base phrases are matched wherever their words stand consecutively.

Defined cases: null text is empty text and has no words; rows may repeat or lack a
doc_id, each gets its own result row; an empty table gives an empty result; further
columns are ignored. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cladeflow.llm import shingles as S
from cladeflow.llm.decontamination import _NOT_WORD

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, passage of the licence or of its usual notice, mandatory key phrase.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you can redistribute it and or modify it under the terms"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]

#: Share of a template's words that must stand in place; words that a passage may be shifted by.
COVERAGE, DRIFT = 0.6, 3


class Index:
    """Vocabulary, base phrases and positional postings, all of fixed size."""

    def __init__(self, templates=TEMPLATES):
        texts = [t for _, t, _ in templates]
        words = sorted({w for t in [*texts, *BASE, *(k for _, _, k in templates)] for w in t.split()})
        data = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in words])
        h = S.word_hashes(data, ends - [len(w.encode()) for w in words], ends)
        order = np.argsort(h)
        self.hashes = h[order]
        ids = {words[i]: k for k, i in enumerate(order)}
        self.phrases = [(np.array([ids[w] for w in p.split()]), label) for p, label in BASE.items()]
        self.templates = [(label, np.array([ids[w] for w in t.split()]), np.array([ids[w] for w in k.split()])) for label, t, k in templates]
        self.key_at = []
        for _, t, k in self.templates:
            self.key_at.append(next(i for i in range(len(t)) if np.array_equal(t[i : i + len(k)], k)))

    def weigh(self, df: np.ndarray, total: int) -> None:
        """Inverse document frequencies, and the postings of each template's rarer half."""
        idf = np.log((total + 1) / (df + 0.5))
        post: dict[int, list[tuple[int, int, float]]] = {}
        self.need = []
        for n, (_, t, _) in enumerate(self.templates):
            kinds = sorted(set(t.tolist()), key=lambda w: (-idf[w], w))
            rare = set(kinds[: (len(kinds) + 1) // 2])
            places = [q for q, w in enumerate(t.tolist()) if w in rare]
            for q in places:
                post.setdefault(int(t[q]), []).append((n, q, max(float(idf[t[q]]), 0.0)))
            self.need.append(COVERAGE / 2 * sum(max(float(idf[t[q]]), 0.0) for q in places))
        self.postings = post
        self.indexed = np.zeros(len(self.hashes), bool)
        self.indexed[list(post)] = True

    def ids(self, h: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[k] == h, k, -1)


def _words(column: pa.Array):
    """Row base, rows, word fingerprints and first word of each row, by slice."""
    for base, rows, data, off in S.text_slices(column):
        low = S.lower_ascii(data)
        s, e, row = S.words(low, off, _NOT_WORD)
        h = S.word_hashes(low, s, e) if len(s) else np.zeros(0, np.uint64)
        yield base, rows, h, row, np.searchsorted(row, np.arange(rows + 1), "left")


def _runs(ids: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase's words stand consecutively in one row."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(ids[:n] == phrase[0])
    for j in range(1, len(phrase)):
        at = at[ids[at + j] == phrase[j]]
    return at[row[at] == row[at + len(phrase) - 1]]


def _passages(index: Index, ids: np.ndarray, first: np.ndarray) -> list[tuple[int, str, float]]:
    """(row, label, coverage) of template passages, by relative positions of rare words."""
    hits = np.flatnonzero((ids >= 0) & index.indexed[np.maximum(ids, 0)])
    if not len(hits):
        return []
    rows = np.searchsorted(first, hits, "right") - 1
    votes = sorted((int(r), n, int(p) - q, w, q) for p, r in zip(hits, rows, strict=True) for n, q, w in index.postings[int(ids[p])])
    found, i = [], 0
    while i < len(votes):
        j = i + 1  # a cluster: one row, one template, positions that drift by little
        while j < len(votes) and votes[j][:2] == votes[i][:2] and votes[j][2] - votes[j - 1][2] <= DRIFT:
            j += 1
        row, n = votes[i][:2]
        weight: dict[int, float] = {v[4]: v[3] for v in votes[i:j]}
        if sum(weight.values()) >= index.need[n]:
            label, t, key = index.templates[n]
            lo, hi = votes[i][2] - DRIFT, votes[j - 1][2] + DRIFT
            a, b = max(int(first[row]), lo), min(int(first[row + 1]), hi + len(t))
            text = ids[a:b]
            keys = a + _runs(text, np.zeros(len(text), int), key) - index.key_at[n]
            if len(keys) and ((keys >= lo) & (keys <= hi)).any():
                inside = sum(bool((ids[max(a, q + lo) : min(b, q + hi + 1)] == w).any()) for q, w in enumerate(t.tolist()))
                if inside >= COVERAGE * len(t):
                    found.append((row, label, inside / len(t)))
        i = j
    return found


RESULT = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per input row; score is the best coverage of a label's template (1 for a base phrase)."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    index = Index(templates)
    size = len(index.hashes)

    def count(batches):
        df, total = np.zeros(size, np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for _, rows, h, row, _ in _words(batch.column(0)):
                k = index.ids(h)
                seen = np.unique(row[k >= 0].astype(np.int64) * size + k[k >= 0])
                df += np.bincount(seen % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(np.append(df, total))], ["word", "n"])

    df = np.zeros(size + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():
        df[r.word] = r.n  # one row per vocabulary word
    index.weigh(df[:-1], int(df[-1]))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            words, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base_labels: dict[int, set] = {}
            labels: dict[int, set] = {}
            score = np.zeros(n)
            for base, rows, h, row, first in _words(batch.column("text")):
                words[base : base + rows] = np.diff(first)
                ids = index.ids(h)
                for phrase, label in index.phrases:
                    at = _runs(ids, row, phrase)
                    own = at - first[row[at]]
                    np.add.at(places, base + row[at], 1)
                    np.minimum.at(low, base + row[at], own)
                    np.maximum.at(high, base + row[at], own)
                    for r in np.unique(row[at]):
                        base_labels.setdefault(base + int(r), set()).add(label)
                        labels.setdefault(base + int(r), set()).add(label)
                        score[base + r] = 1.0
                for r, label, part in _passages(index, ids, first):
                    labels.setdefault(base + r, set()).add(label)
                    score[base + r] = max(score[base + r], part)
            none = places == 0
            listed = lambda have: pa.array([",".join(sorted(have.get(i, ()))) for i in range(n)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array(places), pa.array(low, mask=none), pa.array(high, mask=none), listed(base_labels), listed(labels), pa.array(score)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.mapInArrow(run, RESULT)
