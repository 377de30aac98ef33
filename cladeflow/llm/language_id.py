"""Language identification by Bayesian fusion of independent evidence.

Text likelihoods come from hashed byte trigrams of a model fitted on a bounded sample
of labelled rows. They are fused with the declared language, whose reliability is
measured on all rows (how often rows of a language declare it), and with a prior of
the host. Host priors are counted by grouped aggregation over all rows and smoothed
towards their address suffix, and that towards the whole corpus.

Defined cases: a text without letters (null and empty ones among them) has no language
(``und``) and is rejected; a missing declaration, host or suffix is a value of its own,
so it says nothing beyond how such rows are spread; rows may repeat or share a doc_id,
each is judged by itself; without labelled rows no language is known, every language is
null and nothing is rejected; an empty table gives an empty result; further columns are
ignored by ``identify`` and passed through by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cladeflow.llm import shingles as S
from cladeflow.runtime import Scratch, free_names

#: The classifier's sample: about so many labelled rows of each language.
SAMPLE_ROWS = 400
#: Trigrams are hashed to so many bins.
BINS = 1 << 16
#: A text counts as so many independent trigrams at most (neighbours overlap).
EVIDENCE = 60.0
#: Rows of belief that a prior from the level above is worth; a posterior below the threshold is a rejection.
STRENGTH, MIN_POSTERIOR = 20.0, 0.5

#: Bytes of a long text read at once.
PIECE = 1 << 20

_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bin of every trigram with a letter in its middle; anything else reads as a space."""
    x = _LETTER[data]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (x[:-2].astype(np.uint32) << 16) | (x[1:-1].astype(np.uint32) << 8) | x[2:]
    bins = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    ok = (row[:-2] == row[2:]) & (x[1:-1] != 32)
    return row[:-2][ok], bins[ok]


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of texts as ``text_slices`` gives them, long texts in pieces that share two bytes: no trigram is lost or read twice."""
    for base, rows, data, off in S.text_slices(column):
        if len(data) <= PIECE:
            yield base, rows, data, off
            continue
        for lo in range(0, len(data) - 2, PIECE):  # a slice beyond the usual size is a single text
            piece = data[lo : lo + PIECE + 2]
            yield base, 1, piece, np.array([0, len(piece)])


def host_of(url: Column) -> Column:
    """Host of a URL, or the value itself where it is none."""
    host = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1)
    return F.lower(F.when(host == "", url).otherwise(host))


def suffix_of(host: Column) -> Column:
    """Last label of a host; null where it has only one."""
    last = F.regexp_extract(host, "\\.([a-z]+)\\.?$", 1)
    return F.when(last == "", F.lit(None)).otherwise(last)


def markup_language(html: Column) -> Column:
    """Primary language that a page's own markup declares."""
    found = F.lower(F.regexp_extract(html, "(?i)<html[^>]{0,400}?\\slang\\s*=\\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found == "", F.lit(None)).otherwise(found)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log-likelihoods (bins x languages) from ``label, text, key``."""
    labelled = labelled.where("label is not null and text is not null")
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a language
    names = sorted(counts)
    if not names:
        return [], np.zeros((BINS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, sample_rows / counts[name]))])[F.col("label")]
    place = {name: k for k, name in enumerate(names)}
    sample = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share * 1_000_000).select("label", "text")

    def count(batches):
        for batch in batches:
            label = np.array([place[x] for x in batch.column("label").to_pylist()], np.int64)
            for base, _, data, off in pieces(batch.column("text")):
                row, bins = trigrams(data, off)
                cell, n = np.unique(label[base + row] * BINS + bins, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell // BINS), pa.array(cell % BINS), pa.array(n.astype(np.int64))], ["lang", "bin", "n"])

    table = np.full((BINS, len(names)), 0.5)
    counted = sample.mapInArrow(count, "lang bigint, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():  # at most BINS rows a language
        table[r.bin, r.lang] += r.n
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def text_beliefs(docs: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """``docs`` with ``trigrams``, ``letters`` and ``ll`` (log-likelihood of each language) for ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        model = shared.value
        for batch in batches:
            n, letters = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            ll = np.zeros((batch.num_rows, len(names)))
            for base, rows, data, off in pieces(batch.column("text")):
                row, bins = trigrams(data, off)
                n[base : base + rows] += np.bincount(row, minlength=rows)
                letters[base : base + rows] += np.diff(np.concatenate([[0], np.cumsum(_LETTER[data] != 32)])[off])
                for k in range(len(names)):
                    ll[base : base + rows, k] += np.bincount(row, model[bins, k], minlength=rows)
            with np.errstate(invalid="ignore", divide="ignore"):
                ll *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(names), pa.int32()), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(n), pa.array(letters), flat], [*rest, "trigrams", "letters", "ll"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)
    return docs.mapInArrow(run, f"{schema}, trigrams bigint, letters bigint, ll array<double>")


def identify(docs: DataFrame, scratch: Scratch, key: Column, text: Column, declared: Column, host: Column, label: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, row_hash, declared, host, language, posterior, accepted``."""
    names, model = fit(docs.select(label.alias("label"), text.alias("text"), key.alias("key")), sample_rows)
    rows = docs.select(
        key.cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row_hash"), F.lower(declared).alias("declared"), host.alias("host"), suffix_of(host).alias("suffix"), text.alias("text")
    )
    if not names:
        none = F.lit(None)
        return rows.select("doc_id", "row_hash", "declared", "host", none.cast("string").alias("language"), none.cast("double").alias("posterior"), F.lit(True).alias("accepted"))
    size = range(len(names))
    seen = scratch.put(text_beliefs(rows, names, model), "beliefs")
    # sums over languages are columns of their own: plans grow with the languages, not with their square
    odds = seen.where("trigrams > 0").withColumn("top", F.array_max("ll")).withColumn("e", F.transform("ll", lambda x: F.exp(x - F.col("top"))))
    odds = odds.withColumn("total", F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x))
    soft = odds.select("declared", "host", "suffix", *[(F.col("e")[k] / F.col("total")).alias(f"p{k}") for k in size])
    sums = [F.sum(f"p{k}").alias(f"p{k}") for k in size]
    by_host = scratch.put(soft.groupBy("suffix", "host").agg(*sums), "hosts")
    by_suffix = by_host.groupBy("suffix").agg(*[F.sum(f"p{k}").alias(f"s{k}") for k in size])
    whole = by_host.agg(*[F.sum(f"p{k}").alias(f"g{k}") for k in size]).first()
    whole = np.array([x or 0.0 for x in whole]) + 1.0
    whole = whole / whole.sum()

    def summed(prefix: str) -> Column:
        return F.aggregate(F.array(*[F.col(f"{prefix}{j}") for j in size]), F.lit(0.0), lambda acc, x: acc + x)

    def smoothed(prefix: str, k: int, prior: Column) -> Column:
        return (F.col(f"{prefix}{k}") + STRENGTH * prior) / (F.col(f"n_{prefix}") + STRENGTH)

    by_suffix = by_suffix.withColumn("n_s", summed("s")).select(F.col("suffix").alias("above"), *[smoothed("s", k, F.lit(float(whole[k]))).alias(f"q{k}") for k in size])
    priors = by_host.withColumn("n_p", summed("p")).join(by_suffix, F.col("suffix").eqNullSafe(F.col("above"))).select(
        "host", "suffix", *[F.log(smoothed("p", k, F.col(f"q{k}"))).alias(f"prior{k}") for k in size]
    )
    priors = priors.select(F.col("host").alias("h"), F.col("suffix").alias("x"), *[f"prior{k}" for k in size])
    says = soft.groupBy("declared").agg(*[F.sum(f"p{k}").alias(f"d{k}") for k in size])
    says = scratch.put(says, "declared")
    totals = [x or 0.0 for x in says.agg(*[F.sum(f"d{k}") for k in size]).first()]
    # P(declared | language), smoothed by the share of the declaration among all rows
    share = F.col("share")
    says = says.withColumn("share", summed("d") / F.lit(max(sum(totals), 1e-9))).select(F.col("declared").alias("said"), *[F.log((F.col(f"d{k}") + STRENGTH * share + 1e-6) / F.lit(totals[k] + STRENGTH + 1e-6)).alias(f"say{k}") for k in size])
    joined = seen.join(priors, seen["host"].eqNullSafe(F.col("h")) & seen["suffix"].eqNullSafe(F.col("x")), "left").join(says, seen["declared"].eqNullSafe(F.col("said")), "left")
    logs = [F.col("ll")[k] + F.coalesce(F.col(f"prior{k}"), F.lit(float(np.log(whole[k])))) + F.coalesce(F.col(f"say{k}"), F.lit(0.0)) for k in size]
    fused = joined.select("doc_id", "row_hash", "declared", "host", "letters", F.array(*logs).alias("logs"))
    top = F.array_max("logs")
    best = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("logs", top).cast("int"))
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    fused = fused.select("doc_id", "row_hash", "declared", "host", "letters", best.alias("best"), posterior.alias("posterior"))
    lettered = F.col("letters") > 0
    return fused.select(
        "doc_id",
        "row_hash",
        "declared",
        "host",
        F.when(lettered, F.col("best")).otherwise("und").alias("language"),
        F.when(lettered, F.col("posterior")).otherwise(0.0).alias("posterior"),
        (lettered & (F.col("posterior") >= MIN_POSTERIOR)).alias("accepted"),
    )


def of_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``identify`` for a table of documents: the source is the host, ``lang`` what is declared."""
    return identify(docs, scratch, F.col("doc_id"), F.col("text"), F.coalesce(markup_language(F.col("text")), F.col("lang")), host_of(F.col("source")), F.col("lang"))


def keep_identified(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` whose language could be told."""
    lost_id, lost_text, own_id, own_text = free_names(docs, "lost_id", "lost_text", "own_id", "own_text")
    lost = of_documents(docs, scratch).where("not accepted").select(F.col("doc_id").alias(lost_id), F.col("row_hash").alias(lost_text)).distinct()
    lost = scratch.put(lost, "rejected")
    marked = docs.withColumn(own_id, docs["doc_id"].cast("bigint")).withColumn(own_text, F.xxhash64(docs["text"]))
    return marked.join(lost, F.col(own_id).eqNullSafe(F.col(lost_id)) & (F.col(own_text) == F.col(lost_text)), "left_anti").drop(own_id, own_text)
