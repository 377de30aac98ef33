"""The family commands: build families from clusters, or refresh stored models."""

from __future__ import annotations

import hashlib
import json
import logging
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeflow import __version__
from cladeflow.functions import names as N
from cladeflow.operators import rounds as R
from cladeflow.operators.kernels import Kernels, Model
from cladeflow.runtime import Scratch, filesystem, path_exists
from cladeflow.sources import sinks, text as T

# Headers of the output files.
METADATA = "family_id,converged,seed_msa_size,full_msa_size,rep_protein,rep_region,rep_length,consensus_length,rep_sequence,consensus_sequence"
DELTA = "family_id,model_length_before,model_length_after,round1_recruits,full_msa_size,retention,rounds_run,converged,outcome"
CRASH = "internal error"


def database(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of a plain FASTA file with unique names."""
    with open(path, "rb") as f:
        if f.read(2) == b"\x1f\x8b":
            raise T.InputError("the sequence database must not be compressed")
    records, faults = T.fasta(spark, path)
    T.require(faults)
    T.require(T.duplicates(records), T.DuplicateName)
    return records.select("name", "seq")


def named_rows(found: DataFrame) -> DataFrame:
    """``family, n, row, name``: alignment rows in order, with names in parents' coordinates."""
    rows = F.from_json("rows", "array<array<string>>")
    x = found.where("state = 'successful'").select("family", F.posexplode(rows).alias("n", "x"))
    x = x.select("family", "n", F.get("x", F.lit(0)).alias("row_name"), F.get("x", F.lit(1)).alias("row"), F.get("x", F.lit(2)).alias("seq"))
    return x.select("family", "n", "row", N.external_name(F.col("row_name"), F.col("row"), F.col("seq")).alias("name"))


def text_of(value) -> str:
    return "" if value is None else str(value)


def stockholm(name: str, rows: list[tuple[str, str]], rf: str = "") -> str:
    width = max((len(n) for n, _ in rows), default=0)
    body = "".join(f"{n.ljust(width)}  {r}\n" for n, r in rows)
    return f"# STOCKHOLM 1.0\n#=GF ID {name}\n{body}" + (f"#=GC RF  {rf}\n" if rf else "") + "//\n"


TABLES = ("families.tsv", "metadata.csv", "discarded.csv", "successful.txt", "converged.txt", "delta.csv")
FOLDERS = {"rf": "txt", "hmm": "hmm.gz", "seed_msa": "sto.gz", "full_msa": "sto.gz"}


def outputs(root: Path, prefix: str, families: list[str] = ()) -> list[Path]:
    """Every file that a run may write whose name is known beforehand."""
    tables = [root / f"{prefix}_{k}" for k in (*TABLES, "reps.fasta.gz", "stats.json")]
    return [*tables, root / f"{prefix}.log", *(root / folder / f"{n}.{end}" for n in families for folder, end in FOLDERS.items())]


@contextmanager
def logged(root: Path, prefix: str):
    """A run's own log file, ``<prefix>.log``."""
    root.mkdir(parents=True, exist_ok=True)
    log = logging.getLogger(f"cladeflow.run.{uuid.uuid4().hex}")
    log.setLevel(logging.INFO)
    log.propagate = False
    handler = logging.FileHandler(root / f"{prefix}.log", mode="w", encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    try:
        yield log
    except Exception:
        log.exception("the run failed")
        raise
    finally:
        log.removeHandler(handler)
        handler.close()


def artifacts(root: Path, name: str, f: R.Family, named: list[tuple[str, str]], kernels: Kernels) -> None:
    """A family's own files: all of them, or none if one can't be written."""
    try:
        (root / "rf" / f"{name}.txt").write_text(f.full_rf + "\n")
        final = f.model if f.converged is None else kernels.build(name, list(f.seed), f.rf)
        sinks.deterministic_gzip(root / "hmm" / f"{name}.hmm.gz", Model(name, final.scores, final.consensus).to_text())
        if f.converged is not None:
            sinks.deterministic_gzip(root / "seed_msa" / f"{name}.sto.gz", stockholm(name, list(f.seed)))
        sinks.deterministic_gzip(root / "full_msa" / f"{name}.sto.gz", stockholm(name, named, f.full_rf))
    except Exception:
        for folder, end in FOLDERS.items():
            (root / folder / f"{name}.{end}").unlink(missing_ok=True)
        raise


def write(state: DataFrame, root: Path, prefix: str, command: str, options: R.Options, scratch: Scratch, kernels: Kernels, renumber: bool, log: logging.Logger) -> dict:
    """All files of a finished run, family by family in cluster order; the summary last."""
    summary = root / f"{prefix}_stats.json"
    summary.unlink(missing_ok=True)
    found = scratch.put(R.outcomes(state), "outcomes")
    rows = scratch.put(named_rows(found).groupBy("family").agg(F.array_sort(F.collect_list(F.struct("n", "row", "name"))).alias("named")), "rows")
    joined = state.select("family", "ord", "blob").join(rows, "family", "left").orderBy("ord")
    for folder in FOLDERS:
        (root / folder).mkdir(exist_ok=True)
        for old in (root / folder).iterdir():
            if re.fullmatch(re.escape(prefix) + r"_[0-9]+\..*", old.name):
                old.unlink()
    import pickle

    files = {k: (root / f"{prefix}_{k}").open("w", encoding="utf-8") for k in TABLES}
    files["metadata.csv"].write(METADATA + "\n")
    files["discarded.csv"].write("representative,reason,value\n")
    files["delta.csv"].write(DELTA + "\n")
    reps, rank, reasons, sizes = [], 0, Counter(), {k: Counter() for k in ("seed_msa_size", "full_msa_size", "model_length", "representative_length")}
    deltas = {k: Counter() for k in ("model_length_change", "rounds_run", "retention")}
    converged = 0
    for r in joined.toLocalIterator():
        f: R.Family = pickle.loads(r.blob)
        good = f.state == "successful"
        if good and any(x["name"] is None for x in r.named):
            f, good = f.discard(f"{CRASH} during artifact writing", 0.0), False
        name = f"{prefix}_{rank + 1}" if renumber else f.family
        named = [(x["name"], x["row"]) for x in r.named or ()] if good else []
        if good:
            try:
                artifacts(root, name, f, named, kernels)
            except Exception:  # noqa: BLE001  contained in its family, whose files are gone again
                log.exception("family %s failed during artifact writing", f.family)
                f, good = f.discard(f"{CRASH} during artifact writing", 0.0), False
        if good:
            rank += 1
            first, row = named[0]
            residues = re.sub(r"[.\-~]", "", row).upper()
            spot = re.fullmatch(T.N.REGION.replace("\\z", ""), first)
            fits = spot and int(spot[3]) - int(spot[2]) + 1 == len(residues)
            protein, region = (spot[1], f"{spot[2]}-{spot[3]}") if fits else (first, "-")
            seed_size = "" if f.converged is None else len(f.seed)
            files["families.tsv"].write("".join(f"{name}\t{n}\n" for n, _ in named))
            quoted = '"' + protein.replace('"', '""') + '"'
            line = [name, text_of(f.converged), seed_size, len(named), quoted, region, len(residues), f.model.m, residues, f.model.consensus]
            files["metadata.csv"].write(",".join(map(str, line)) + "\n")
            files["successful.txt"].write(name + "\n")
            if f.converged:
                converged += 1
                files["converged.txt"].write(name + "\n")
            reps.append(f">{first}\t{name}\n{residues}\n")
            for k, v in (("seed_msa_size", seed_size), ("full_msa_size", len(named)), ("model_length", f.model.m), ("representative_length", len(residues))):
                if v != "":
                    sizes[k][v] += 1
        else:
            reasons[f.reason] += 1
            log.info("family %s discarded: %s (%s)", f.family, f.reason, f.value)
            files["discarded.csv"].write(sinks.csv_line([f.family, f.reason, f.value]) + "\n")
        outcome = "successful" if good else f.reason
        delta = [f.family, f.model_length_before, f.qlen or None, f.round1_recruits, len(f.full) or None, f.membership, f.rounds or None, f.converged, outcome]
        files["delta.csv"].write(",".join(map(text_of, delta)) + "\n")
        if f.qlen:
            deltas["model_length_change"][f.qlen - f.model_length_before] += 1
        if f.rounds:
            deltas["rounds_run"][f.rounds] += 1
        if f.membership is not None:
            deltas["retention"][f.membership] += 1
    for handle in files.values():
        handle.close()
    log.info("%d families, %d discarded", rank, sum(reasons.values()))
    if renumber:
        (root / f"{prefix}_delta.csv").unlink()
    sinks.deterministic_gzip(root / f"{prefix}_reps.fasta.gz", "".join(reps))
    crashed = sum(n for k, n in reasons.items() if k.startswith(CRASH))
    ordered = lambda c: {str(k): c[k] for k in sorted(c)}
    payload = {
        "tool": "cladeflow",
        "schema_version": 1,
        "version": __version__,
        "command": command,
        "chunk_id": prefix,
        "exit_status": 3 if crashed else 0,
        "parameters": asdict(options),
        "families": {
            "input": rank + sum(reasons.values()),
            "successful": rank,
            "discarded": sum(reasons.values()),
            "converged": None if options.skip_refine else converged,
            "crashed": crashed,
        },
        "discard_reasons": dict(sorted(reasons.items())),
        "histograms": {k: ordered(c) for k, c in (sizes if renumber else sizes | deltas).items()},
    }
    sinks.commit_summary(summary, payload)
    return payload


def stored_database(spark: SparkSession, fasta_file: str, folder: str | None, scratch: Scratch) -> DataFrame:
    """The database as a table; kept in ``folder`` for other runs as long as its files stay as they are.

    A table counts only with the mark that ends its writing, so a run that was stopped half
    way leaves nothing that another would read.
    """
    if folder is None:
        return scratch.put(database(spark, fasta_file), "database")
    fs, path = filesystem(spark, fasta_file)
    state = sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))
    kept = f"{folder.rstrip('/')}/{hashlib.sha256(json.dumps(state).encode()).hexdigest()[:32]}"
    if not path_exists(spark, f"{kept}/_SUCCESS"):
        database(spark, fasta_file).write.mode("overwrite").option("compression", "zstd").parquet(kept)
    return spark.read.parquet(kept)


def generate_families(
    spark: SparkSession, clusters_chunk: str, fasta_file: str, chunk_id: str, output_dir: str, options: R.Options, kernels: Kernels | None = None, batch_size: int | None = None,
    database_table: str | None = None,
) -> dict:
    """``batch_size``: clusters that are refined at once; all of them if None. It changes no result.

    ``database_table``: folder that keeps the parsed database for later runs.
    """
    sinks.safe_id(chunk_id)
    if batch_size is not None and batch_size < 1:
        raise T.InputError("batch_size must be at least 1")
    kernels, scratch = kernels or R.default_kernels(), Scratch(spark, "families")
    root = Path(output_dir)
    sinks.refuse_alias(outputs(root, chunk_id), [clusters_chunk, fasta_file])
    clusters, faults = T.clusters(spark, clusters_chunk)
    T.require(faults)
    db = stored_database(spark, fasta_file, database_table, scratch)
    with logged(root, chunk_id) as log:
        (root / f"{chunk_id}_stats.json").unlink(missing_ok=True)
        clusters = scratch.put(clusters, "clusters")
        state = None
        for wave in waves(clusters, scratch, batch_size):
            done = R.run_rounds(R.start(wave, db, scratch, kernels), db, options, scratch, kernels)
            state = done if state is None else state.unionByName(done)
            log.info("%d families refined", state.count())
        return write(state, root, chunk_id, "generate_families", options, scratch, kernels, renumber=True, log=log)


def waves(clusters: DataFrame, scratch: Scratch, batch_size: int | None) -> Iterator[DataFrame]:
    """Rows of ``batch_size`` clusters at a time, in the order in which clusters begin."""
    if batch_size is None:
        yield clusters
        return
    begins = scratch.put(clusters.groupBy("representative").agg(F.min("ord").alias("begins")), "begins")
    rows = clusters.join(begins, "representative")
    low = -1
    while True:
        ends = [r.begins for r in begins.where(F.col("begins") > low).orderBy("begins").limit(batch_size).collect()]
        if not ends:
            if low < 0:
                yield clusters
            return
        yield rows.where((F.col("begins") > low) & (F.col("begins") <= ends[-1])).drop("begins")
        low = ends[-1]


def update_families(spark: SparkSession, hmm_input: str, fasta_file: str, chunk_id: str, output_dir: str, options: R.Options, kernels: Kernels | None = None, database_table: str | None = None) -> dict:
    sinks.safe_id(chunk_id)
    kernels, scratch = kernels or R.default_kernels(), Scratch(spark, "update")
    root, prefix = Path(output_dir), f"{chunk_id}_updated"
    models = [Model.from_text(r.text) for r in T.models(spark, hmm_input).toLocalIterator()]
    names = [m.name for m in models]
    if not models or len(set(names)) < len(names) or not all(re.fullmatch(T.FAMILY[1:-1], n) and n not in (".", "..") for n in names):
        raise T.InputError("models must be present, and their names unique and safe")
    source = Path(hmm_input)
    sinks.refuse_alias(outputs(root, prefix, names), [*([str(p) for p in source.iterdir()] if source.is_dir() else [hmm_input]), fasta_file])
    if (root / "hmm").is_dir():
        foreign = [p.name for p in (root / "hmm").iterdir() if p.name.removesuffix(".hmm.gz") not in set(names)]
        if foreign:
            raise T.InputError(f"the output holds families of another run: {foreign[:5]}")
    db = stored_database(spark, fasta_file, database_table, scratch)
    with logged(root, prefix) as log:
        (root / f"{prefix}_stats.json").unlink(missing_ok=True)
        state = R.run_rounds(R.from_models(spark, models, options), db, options, scratch, kernels, loaded=True)
        return write(state, root, prefix, "update_families", options, scratch, kernels, renumber=False, log=log)
