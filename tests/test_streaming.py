from cladeflow.streaming import members as M


def test_stream_equals_batch(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()

    def run():
        M.follow(spark, str(folder), table, str(tmp_path / "cp")).awaitTermination(120)
        return sorted(tuple(r) for r in M.current(spark, table).select("protein", "family", "start", "end").collect())

    (folder / "a.tsv").write_text("F\tP/1-5\nF\tP/10-12\nbad line\n")
    assert run() == [("P", "F", 1, 5), ("P", "F", 10, 12)]
    (folder / "b.tsv").write_text("F\tP/6-9\nG\tP/3-4\n")
    assert run() == [("P", "F", 1, 12), ("P", "G", 3, 4)]
    assert run() == [("P", "F", 1, 12), ("P", "G", 3, 4)]
