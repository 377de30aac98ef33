"""``python -m cladeflow.cli compute_clans | generate_families | update_families``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from cladeflow.operators.rounds import Options as RoundOptions
from cladeflow.plans import compute_clans, family_commands
from cladeflow.sources.sinks import OutputError
from cladeflow.sources.text import InputError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladeflow")
    sub = top.add_subparsers(dest="command", required=True)
    clans = sub.add_parser("compute_clans", help="similarity of families and their clans, from member tables")
    clans.add_argument("members", nargs="+")
    clans.add_argument("--fasta_file")
    for flag, default in (("min_edge_jaccard", "0.1"), ("min_edge_containment", "0.5"), ("clan_jaccard", "0.5")):
        clans.add_argument(f"--{flag}", default=default)
    for name, source in (("generate_families", "clusters_chunk"), ("update_families", "hmm_input")):
        own = sub.add_parser(name, help="families from clusters" if name[0] == "g" else "stored models against a new database")
        own.add_argument(source)
        own.add_argument("fasta_file")
        for f in fields(RoundOptions):
            if f.name == "skip_refine":
                if name == "update_families":
                    own.add_argument("--skip_refine", action="store_true")
            else:
                own.add_argument(f"--{f.name}", type=type(f.default), default=f.default)
        own.add_argument("--database_table", help="folder that keeps the parsed database for later runs")
        if name == "generate_families":
            own.add_argument("--batch_size", type=int, help="clusters refined at once (all)")
    for own in sub.choices.values():
        own.add_argument("--chunk_id", default="1")
        own.add_argument("--output_dir", default="output")
    return top


def main(argv: list[str] | None = None) -> int:
    """Exit status: 0 done, 1 output unusable, 2 bad input, 3 done with contained faults."""
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    spark = SparkSession.builder.appName("cladeflow").getOrCreate()
    try:
        if command == "compute_clans":
            compute_clans.run(spark, compute_clans.Options(**args))
            return 0
        chosen = {f.name: args.pop(f.name) for f in fields(RoundOptions) if f.name in args}
        return getattr(family_commands, command)(spark, options=RoundOptions(**chosen), **args)["exit_status"]
    except (InputError, ValueError) as error:
        print(f"cladeflow: {error}", file=sys.stderr)
        return 2
    except (OutputError, OSError) as error:
        print(f"cladeflow: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
