"""Secret scanning over an incremental blob ledger (DataFrame functions only).

Every version of every text is content-addressed by SHA-256. Only pairs of blob and
rule version that the ledger has not seen are scanned; findings are appended to the
ledger and joined back to all paths (rows) that hold the blob.

Defined cases: null text is empty text; rows may repeat and each gets its own result
row; a null doc_id is a path like any other; an empty table gives an empty result;
further columns are ignored. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeflow.llm.spans import SPAN, as_spans, count_kind, listed, no_spans, placed
from cladeflow.runtime import Scratch, path_exists

# The base patterns of the contract, in its order of kinds.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")

# Formats of issued credentials that the base patterns miss.
ISSUED = {
    "pem": "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\\x20\\x09-\\x0D]*-----END [A-Z ]{0,40}PRIVATE KEY-----)?",
    "github": "gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": "xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}",
}
PREFIX = {"pem": "-----", "github": "gh", "slack": "xox", "jwt": "eyJ"}

RULES = "1:" + hashlib.sha256(repr((ASSIGN, ACCESS, HEX, sorted(ISSUED.items()))).encode()).hexdigest()[:16]


def _with_prefix(prefix: str):
    return lambda x: x["v"].startswith(prefix)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """``blobs(digest, text)`` -> ``(digest, spans)``, sorted by start, then kind."""
    any_issued = "|".join(ISSUED.values())
    step = blobs.select(
        "digest",
        "text",
        F.regexp_extract_all("text", F.lit(ASSIGN), 0).alias("assign"),
        F.regexp_extract_all("text", F.lit(ACCESS), 0).alias("access"),
        F.regexp_extract_all("text", F.lit(HEX), 0).alias("hex"),
        F.regexp_extract_all("text", F.lit(any_issued), 0).alias("issued"),
    )
    step = step.select(
        "digest",
        placed(F.col("text"), ASSIGN, F.col("assign")).alias("assign"),
        placed(F.col("text"), ACCESS, F.col("access")).alias("access"),
        placed(F.col("text"), HEX, F.col("hex")).alias("hex"),
        placed(F.col("text"), any_issued, F.col("issued")).alias("issued"),
    )
    # a failing value still uses its text up: it is matched first and dropped after
    assign = F.filter("assign", lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 2)) >= 6)
    spans = [as_spans(assign, "assign", 0), as_spans(F.col("access"), "access", 1), as_spans(F.col("hex"), "hex", 2)]
    for i, kind in enumerate(ISSUED):
        spans.append(as_spans(F.filter("issued", _with_prefix(PREFIX[kind])), kind, 3 + i))
    return step.select("digest", F.array_sort(F.concat(*spans)).alias("spans"))


class BlobLedger:
    """Append-only Parquet table ``(digest, rule_version, spans)`` of all scanned pairs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, rule_version: str) -> DataFrame | None:
        if not path_exists(self.spark, self.path):
            return None
        schema = f"digest binary, rule_version string, spans {SPAN}"
        return self.spark.read.schema(schema).parquet(self.path).where(F.col("rule_version") == rule_version)

    def append(self, findings: DataFrame, rule_version: str) -> None:
        out = findings.select("digest", F.lit(rule_version).alias("rule_version"), "spans")
        out.sortWithinPartitions("digest").write.mode("append").option("compression", "zstd").parquet(self.path)


def scan(docs: DataFrame, ledger: BlobLedger, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", rule_version: str = RULES) -> DataFrame:
    """One row per input row: ``doc_id, digest, spans``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    versions = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    paths = scratch.put(versions.select("doc_id", "digest"), "paths")
    unseen = paths.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    seen = ledger.read(rule_version)
    if seen is not None:
        unseen = unseen.join(seen.select("digest"), "digest", "left_anti")
    unseen = unseen.select(F.col("digest").alias("d"), F.col("doc_id").alias("i"))
    blobs = versions.join(unseen, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left_semi")
    ledger.append(scan_blobs(blobs.select("digest", "text")), rule_version)
    # only the batch's part of the ledger is gathered: a small batch is broadcast to it
    own = ledger.read(rule_version).join(paths.select("digest").distinct(), "digest", "left_semi")
    # a path that repeats a row scans its blob twice with equal findings: one is enough
    findings = own.groupBy("digest").agg(F.max("spans").alias("spans"))
    return paths.join(findings, "digest", "left").select("doc_id", "digest", F.coalesce("spans", no_spans()).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Digest columns of the contract from ``doc_id, spans``."""
    base = F.filter("spans", lambda x: x["ord"] < len(BASE))
    out = found.select("doc_id", "spans", base.alias("base"))
    return out.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
