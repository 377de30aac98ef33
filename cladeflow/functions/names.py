"""Name grammars as column expressions.

Members carry regions as ``protein/start-end``; database records may be slices spelt
``protein_start_end`` or ``protein/start-end``; internal alignment rows escape ``%`` and
``/`` so that a literal slash only ever introduces an envelope ``/from_to``. Digits are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

REGION = "(?s)^(.+)/([0-9]+)-([0-9]+)\\z"
UNDERSCORES = "(?s)^(.+)_([0-9]+)_([0-9]+)\\z"


def member_protein(member: Column) -> Column:
    """Protein of a member: what stands before its region, or all of it."""
    return F.when(member.rlike(REGION), F.regexp_extract(member, REGION, 1)).otherwise(member)


def member_bound(member: Column, which: int) -> Column:
    """Start (1) or end (2) of a member's region as text; null for a whole protein."""
    return F.when(member.rlike(REGION), F.regexp_extract(member, REGION, 1 + which))


def region(member: Column) -> tuple[Column, Column, Column]:
    """Start and end of a member's region, and whether it has one; the bounds mean nothing where it has none.

    The same as ``member_bound`` reads: digits, dash, digits after the last slash, something before it.
    """
    last = F.substring_index(member, "/", -1)
    sliced = (F.octet_length(last) + 1 < F.octet_length(member)) & last.rlike("^[0-9]+-[0-9]+\\z")
    return F.substring_index(last, "-", 1).try_cast("bigint"), F.substring_index(last, "-", -1).try_cast("bigint"), sliced


def before_region(member: Column) -> Column:
    """Protein of a member that has a region."""
    return F.left(member, F.length(member) - F.length(F.substring_index(member, "/", -1)) - 1)


def slice_of(name: Column, length: Column) -> Column:
    """``struct(protein, start)`` of a record that is a slice of exactly ``length`` residues, else null."""

    def read(pattern: str) -> Column:
        start = F.regexp_extract(name, pattern, 2).try_cast("decimal(38,0)")
        end = F.regexp_extract(name, pattern, 3).try_cast("decimal(38,0)")
        fits = name.rlike(pattern) & (end - start + 1 == length)
        return F.when(fits, F.struct(F.regexp_extract(name, pattern, 1).alias("protein"), start.cast("bigint").alias("start")))

    return F.when(name.rlike(REGION), read(REGION)).otherwise(read(UNDERSCORES))


def encode_record(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def strip_envelope(row_name: Column) -> Column:
    """Raw record name of an internal row name."""
    return F.replace(F.replace(F.substring_index(row_name, "/", 1), F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))


def residues(row: Column) -> Column:
    """An aligned row without gaps, in upper case."""
    return F.upper(F.translate(row, ".-~", ""))


def masked_name(name: Column, env_from: Column, env_to: Column, length: Column) -> Column:
    """Internal name of a hit: with its envelope, where that is shorter than the record."""
    suffix = F.concat(F.lit("/"), env_from.cast("string"), F.lit("_"), env_to.cast("string"))
    return F.concat(encode_record(name), F.when(env_to - env_from + 1 < length, suffix).otherwise(""))


def masked_residues(seq: Column, env_from: Column, env_to: Column) -> Column:
    return F.substring(seq, env_from, env_to - env_from + 1)


def located(sought: Column, seq: Column, env_from: Column, env_to: Column) -> Column:
    """1-based place of ``sought`` in the record, searched within the envelope only; null if absent."""
    at = F.position(sought, F.substring(seq, env_from, env_to - env_from + 1))
    return F.when(at > 0, at + env_from - 1)


def external_name(row_name: Column, row: Column, seq: Column) -> Column:
    """Name of an alignment row in coordinates of its parent protein; null if its residues are not there."""
    record, own = strip_envelope(row_name), residues(row)
    envelope = F.regexp_extract(row_name, "/([0-9]+)_([0-9]+)$", 1)
    lo = F.when(envelope == "", F.lit(1)).otherwise(envelope.try_cast("int"))
    hi = F.when(envelope == "", F.length(seq)).otherwise(F.regexp_extract(row_name, "/([0-9]+)_([0-9]+)$", 2).try_cast("int"))
    at, part = located(own, seq, lo, hi), slice_of(record, F.length(seq))
    whole = part.isNull() & (F.length(own) == F.length(seq))
    first = at + F.coalesce(part["start"], F.lit(1)) - 1
    spelt = F.concat(F.coalesce(part["protein"], record), F.lit("/"), first.cast("string"), F.lit("-"), (first + F.length(own) - 1).cast("string"))
    return F.when(at.isNull(), F.lit(None)).when(whole, record).otherwise(spelt)
