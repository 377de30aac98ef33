"""The clan command: member tables in, edges, clans and a summary out."""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeflow import __version__
from cladeflow.operators import clans as C, intervals as I, similarity as S
from cladeflow.runtime import Scratch
from cladeflow.sources import sinks, text as T

#: Totals above this could overflow a threshold's cross products.
EXACT = (2**63 - 1) // (2 * S.SCALE)


@dataclass
class Options:
    members: list[str]
    fasta_file: str | None = None
    chunk_id: str = "1"
    output_dir: str = "output"
    min_edge_jaccard: Fraction = Fraction(1, 10)
    min_edge_containment: Fraction = Fraction(1, 2)
    clan_jaccard: Fraction = Fraction(1, 2)
    paths: dict[str, Path] = field(init=False)

    def __post_init__(self):
        sinks.safe_id(self.chunk_id)
        for name in ("min_edge_jaccard", "min_edge_containment", "clan_jaccard"):
            try:
                setattr(self, name, S.parse_threshold(getattr(self, name)))
            except S.ThresholdError as error:
                raise T.InputError(f"{name}: {error}") from error
        root = Path(self.output_dir)
        self.paths = {"edges": root / f"{self.chunk_id}_clan_edges.csv", "clans": root / f"{self.chunk_id}_clans.csv", "summary": root / f"{self.chunk_id}_clans_summary.json"}
        sinks.refuse_alias(self.paths.values(), [*self.members, self.fasta_file])


def read(spark: SparkSession, options: Options) -> tuple[DataFrame, DataFrame]:
    """Validated member rows, and intervals with all lengths resolved."""
    rows, faults = T.members(spark, options.members)
    T.require(faults)
    rows = rows.persist()
    if rows.where("start is null").limit(1).count():
        if not options.fasta_file:
            raise T.InputError("whole-protein members need a FASTA file")
        records, faults = T.fasta(spark, options.fasta_file)
        T.require(faults)
        T.require(T.length_faults(rows, records))
        return rows, I.resolve_lengths(rows, records.select(F.col("name").alias("protein"), "length"))
    return rows, rows.select("family", "protein", "start", "end")


def run(spark: SparkSession, options: Options) -> dict:
    """All of it. Faulty input raises before the output tree is touched; a run that fails
    otherwise takes an earlier run's summary along, which no longer vouches for the files."""
    try:
        return _run(spark, options, *read(spark, options))
    except T.InputError:
        raise
    except BaseException:
        options.paths["summary"].unlink(missing_ok=True)
        raise


def _run(spark: SparkSession, options: Options, rows: DataFrame, intervals: DataFrame) -> dict:
    scratch = Scratch(spark, "clans")
    merged = scratch.put(I.merge_intervals(intervals), "merged")
    totals = I.family_totals(merged)
    most = totals.agg(F.max("residues")).first()[0] or 0
    counts = rows.agg(F.count("*").alias("member_rows"), F.count_if(F.col("start").isNull()).alias("whole_protein_member_rows")).first()
    if max(most, counts.member_rows) > EXACT:
        raise T.InputError("counts exceed the bound of exact arithmetic")
    fan = I.protein_fanout(merged).agg(F.count("*").alias("proteins"), F.sum("pairs").alias("pairs"), F.max("families").alias("most")).first()
    pairs = scratch.put(S.family_pairs(merged), "pairs")
    found = scratch.put(C.clans(S.clan_edges(pairs, options.clan_jaccard), scratch), "found")
    families = totals.count()

    options.paths["summary"].parent.mkdir(parents=True, exist_ok=True)
    options.paths["summary"].unlink(missing_ok=True)
    edges = S.edges(pairs, options.min_edge_jaccard, options.min_edge_containment).orderBy("family_1", "family_2")
    n_edges = sinks.write_lines(options.paths["edges"], sinks.EDGES_HEADER, edges.select(F.concat_ws(",", *edges.columns).alias("line")))
    name = F.concat(F.lit(f"{options.chunk_id}_clan_"), F.col("clan_number"))
    lines = found.orderBy("clan_number", "family_id").select(F.concat_ws(",", name, "family_id", F.when(F.col("is_representative"), "True").otherwise("False")).alias("line"))
    in_clans = sinks.write_lines(options.paths["clans"], sinks.CLANS_HEADER, lines)
    sizes = {r["size"]: r["clans"] for r in C.size_histogram(found).collect()}
    more = S.summary(pairs).first()
    payload = {
        "command": "compute_clans",
        "version": __version__,
        "chunk_id": options.chunk_id,
        "parameters": {k: float(getattr(options, k)) for k in ("min_edge_jaccard", "min_edge_containment", "clan_jaccard")},
        "counts": {
            "member_rows": counts.member_rows,
            "whole_protein_member_rows": counts.whole_protein_member_rows,
            "families": families,
            "proteins": fan.proteins,
            "pair_emissions": fan.pairs or 0,
            "max_families_per_protein": fan.most or 0,
            "pairs_sharing_proteins": more.pairs_sharing_proteins,
            "edges": n_edges,
            "near_redundant_pairs": more.near_redundant_pairs,
            "clans": sum(sizes.values()),
            "families_in_clans": in_clans,
            "singleton_families": families - in_clans,
        },
        "clan_size_histogram": {str(k): sizes[k] for k in sorted(sizes)},
    }
    sinks.commit_summary(options.paths["summary"], payload)
    rows.unpersist()
    return payload
