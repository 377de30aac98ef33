"""The commands through their front door, file by file."""

import csv
import gzip
import json
import random

import pytest

from cladeflow.cli import main
from cladeflow.functions import names as N
from cladeflow.plans import family_commands
from pyspark.sql import functions as F

from .test_rounds import database

FLAGS = ["--discard_min_rep_length", "20", "--recruit_hit_length_percentage", "0.7", "--max_seq_identity", "0.95", "--chunk_id", "c"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("fam")
    rows = database(random.Random(1))
    (root / "db.fa").write_text("".join(f">{n} d\n{s[:30].lower()}\n{s[30:]}\n" for n, s in rows))
    (root / "cl.tsv").write_text("s0_0\ts0_0\ns1_0\ts1_0\ns0_0\ts0_1\ns1_0\ts1_1\ns1_0\ts1_2\ns0_0\ts0_2\nlone\tn1\n")
    assert main(["generate_families", str(root / "cl.tsv"), str(root / "db.fa"), "--output_dir", str(root / "out"), *FLAGS]) == 0
    return root


def test_generate(built):
    out = built / "out"
    meta = list(csv.DictReader((out / "c_metadata.csv").open()))
    assert [m["family_id"] for m in meta] == ["c_1", "c_2"]
    lines = (out / "c_families.tsv").read_text().splitlines()
    assert sum(x.startswith("c_1\t") for x in lines) == int(meta[0]["full_msa_size"])
    bad = list(csv.DictReader((out / "c_discarded.csv").open()))
    assert bad == [{"representative": "lone", "reason": "too few sequences before initial hmmbuild", "value": "1"}]
    stats = json.loads((out / "c_stats.json").read_text())
    assert stats["families"] == {"input": 3, "successful": 2, "discarded": 1, "converged": 2, "crashed": 0}
    assert stats["histograms"]["full_msa_size"] and (out / "c_successful.txt").read_text() == "c_1\nc_2\n"
    reps = gzip.decompress((out / "c_reps.fasta.gz").read_bytes()).decode()
    assert reps.count(">") == 2 and meta[0]["rep_sequence"] in reps
    for kind, end in (("rf", "txt"), ("hmm", "hmm.gz"), ("seed_msa", "sto.gz"), ("full_msa", "sto.gz")):
        assert sorted(p.name for p in (out / kind).iterdir()) == [f"c_1.{end}", f"c_2.{end}"]


@pytest.mark.parametrize("skip", [False, True])
def test_update(built, tmp_path, skip):
    flags = ["--skip_refine"] if skip else []
    lib = tmp_path / "lib.hmm"
    lib.write_text("".join(gzip.decompress((built / "out" / "hmm" / f"c_{i}.hmm.gz").read_bytes()).decode() for i in (2, 1)))
    assert main(["update_families", str(lib), str(built / "db.fa"), "--output_dir", str(tmp_path / "up"), *FLAGS, *flags]) == 0
    rows = list(csv.DictReader((tmp_path / "up" / "c_updated_delta.csv").open()))
    assert [r["family_id"] for r in rows] == ["c_1", "c_2"] and {r["outcome"] for r in rows} == {"successful"}
    assert all(r["retention"] == "1.0" and r["converged"] == ("" if skip else "True") for r in rows)
    stats = json.loads((tmp_path / "up" / "c_updated_stats.json").read_text())
    assert stats["families"]["converged"] == (None if skip else 2) and stats["histograms"]["retention"] == {"1.0": 2}


def test_log_and_batches(built, tmp_path):
    assert "3 families refined" in (built / "out" / "c.log").read_text() or "2 families" in (built / "out" / "c.log").read_text()
    assert main(["generate_families", str(built / "cl.tsv"), str(built / "db.fa"), "--output_dir", str(tmp_path / "b"), *FLAGS, "--batch_size", "2"]) == 0
    for name in ("c_families.tsv", "c_metadata.csv", "c_discarded.csv", "c_converged.txt", "hmm/c_2.hmm.gz"):
        assert (tmp_path / "b" / name).read_bytes() == (built / "out" / name).read_bytes()


def test_a_family_whose_files_fail_leaves_none(spark, built, tmp_path, monkeypatch):
    real = family_commands.sinks.deterministic_gzip
    monkeypatch.setattr(family_commands.sinks, "deterministic_gzip", lambda path, text: 1 / 0 if path.name == "c_1.sto.gz" and path.parent.name == "full_msa" and "s0_0" in text else real(path, text))
    assert main(["generate_families", str(built / "cl.tsv"), str(built / "db.fa"), "--output_dir", str(tmp_path / "f"), *FLAGS]) == 3
    out = tmp_path / "f"
    assert [r["reason"] for r in csv.DictReader((out / "c_discarded.csv").open())] == ["internal error during artifact writing", "too few sequences before initial hmmbuild"]
    assert (out / "c_successful.txt").read_text() == "c_1\n" and sorted(p.name for p in (out / "hmm").iterdir()) == ["c_1.hmm.gz"]


def test_no_output_may_be_an_input(built, tmp_path):
    (tmp_path / "c_families.tsv").write_bytes((built / "cl.tsv").read_bytes())
    assert main(["generate_families", str(tmp_path / "c_families.tsv"), str(built / "db.fa"), "--output_dir", str(tmp_path), "--chunk_id", "c"]) == 2
    (tmp_path / "hmm").mkdir()
    lib = tmp_path / "hmm" / "c_1.hmm.gz"
    lib.write_bytes((built / "out" / "hmm" / "c_1.hmm.gz").read_bytes())
    assert main(["update_families", str(lib), str(built / "db.fa"), "--output_dir", str(tmp_path), "--chunk_id", "c"]) == 2
    assert (tmp_path / "c_families.tsv").read_bytes() == (built / "cl.tsv").read_bytes()


def test_bad_input_exits_2(built, tmp_path):
    (tmp_path / "bad.tsv").write_text("a\tb\tc\n")
    (tmp_path / "twice.fa").write_text(">a\nAC\n>a\nAC\n")
    (tmp_path / "z.fa").write_bytes(gzip.compress(b">a\nAC\n"))
    out = ["--output_dir", str(tmp_path / "o")]
    assert main(["generate_families", str(tmp_path / "bad.tsv"), str(built / "db.fa"), *out]) == 2
    assert main(["generate_families", str(built / "cl.tsv"), str(tmp_path / "twice.fa"), *out]) == 2
    assert main(["generate_families", str(built / "cl.tsv"), str(tmp_path / "z.fa"), *out]) == 2
    assert main(["generate_families", str(built / "cl.tsv"), str(built / "db.fa"), *out, "--max_seq_identity", "2.0"]) == 2
    assert main(["compute_clans", str(tmp_path / "bad.tsv"), *out]) == 2
    assert not (tmp_path / "o").exists()


def test_database_is_parsed_once(spark, tmp_path):
    fasta, kept = tmp_path / "db.fa", tmp_path / "kept"
    fasta.write_text(">a\nACD\n>b\nEF\n")
    rows = lambda: sorted((r.name, r.seq) for r in family_commands.stored_database(spark, str(fasta), str(kept), None).collect())
    assert rows() == [("a", "ACD"), ("b", "EF")]
    first = {p: p.stat().st_mtime_ns for p in kept.rglob("*.parquet")}
    assert rows() == [("a", "ACD"), ("b", "EF")]
    assert {p: p.stat().st_mtime_ns for p in kept.rglob("*.parquet")} == first
    next(kept.rglob("_SUCCESS")).unlink()  # as a run leaves it that was stopped half way
    assert rows() == [("a", "ACD"), ("b", "EF")]
    fasta.write_text(">a\nACDE\n")
    assert rows() == [("a", "ACDE")]


def test_external_names(spark):
    rows = [
        ("P_11_20/2_5", "--CDE", "ACDEFGHIKL", "P/12-14"),  # a slice, clipped
        ("X", "ACDE", "ACDE", "X"),  # a whole protein, all of it
        ("X", "-cd-", "ACDE", "X/2-3"),
        ("a%2Fv1%2F5-8", "CD", "ACDE", "a/v1/6-7"),  # the other spelling; its base has a slash
        ("scaffold_12_34", "CD", "ACDE", "scaffold_12_34/2-3"),  # bounds that don't fit the length
        ("R/6_10", "ACDEF", "ACDEFACDEF", "R/6-10"),  # a repeat: the second copy, not the first
        ("X%252F1_10", "AC", "AC", "X%2F1_10"),
        ("R/6_10", "WWW", "ACDEFACDEF", None),
    ]
    df = spark.createDataFrame(rows, "n string, r string, s string, want string")
    for r in df.withColumn("got", N.external_name(F.col("n"), F.col("r"), F.col("s"))).collect():
        assert r.got == r.want, r
