"""Exact renderings of results as single files, committed by a summary written last."""

from __future__ import annotations

import csv
import gzip
import io
import json
import os
import re
import secrets
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame

# Headers of the output files.
EDGES_HEADER = "family_1,family_2,shared_proteins,protein_jaccard,residue_jaccard,residue_containment"
CLANS_HEADER = "clan_id,family_id,is_representative"


class OutputError(RuntimeError):
    """Output that can't be used; the summary is absent."""


def safe_id(chunk_id: str) -> str:
    from cladeflow.sources.text import InputError

    if not re.fullmatch(r"[A-Za-z0-9._-]+", chunk_id):
        raise InputError(f"unsafe chunk id: {chunk_id!r}")
    return chunk_id


def refuse_alias(outputs: Iterable[Path], inputs: Iterable[str | None]) -> None:
    """Refuse outputs that are one of the inputs by path, symbolic link or hard link."""
    from cladeflow.sources.text import InputError

    for out in outputs:
        for source in filter(None, inputs):
            path = Path(source)
            if out.resolve() == path.resolve() or (out.exists() and path.exists() and out.samefile(path)):
                raise InputError(f"output {out} is an input")


def write_lines(path: Path, header: str | None, rows: DataFrame, column: str = "line") -> int:
    """Rows in their order, streamed partition by partition; the number written."""
    n = 0
    with path.open("w", encoding="utf-8", newline="") as f:
        if header is not None:
            f.write(header + "\n")
        for r in rows.select(column).toLocalIterator():
            f.write(r[0] + "\n")
            n += 1
    return n


def csv_line(fields: Iterable[object]) -> str:
    """One line with minimal quoting, as Python's own writer does it."""
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(["" if x is None else x for x in fields])
    return out.getvalue()


def deterministic_gzip(path: Path, text: str) -> None:
    """Gzip without time or file name, so that equal text gives equal bytes."""
    with path.open("wb") as raw, gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0) as f:
        f.write(text.encode())


def commit_summary(path: Path, payload: dict) -> None:
    """Write the summary under its final name in one step; its presence marks a finished run."""
    part = path.with_name(f"{path.name}.{secrets.token_hex(6)}.tmp")
    try:
        with part.open("x", encoding="utf-8") as f:
            f.write(json.dumps(payload, indent=2, allow_nan=False) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except OSError as error:
        part.unlink(missing_ok=True)
        raise OutputError(f"no summary at {path.name}") from error
