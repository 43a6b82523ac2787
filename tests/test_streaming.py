"""Streaming over landed files and the command line."""

import datetime as dt

from impactframe.cli import main
from impactframe.streaming.scans import change_counts, read_landing, upsert_batches

SCHEMA = "change_id bigint, status string, landed_at timestamp"


def test_landed_files_arrive_once(spark, tmp_path):
    land, target, mark = (str(tmp_path / n) for n in ("land", "out", "mark"))
    rows = lambda a, b: spark.createDataFrame([(i, "added", dt.datetime(2025, 1, 1)) for i in range(a, b)], SCHEMA)
    rows(0, 5).write.parquet(land)
    for extra in (None, rows(5, 9), None):
        if extra is not None:
            extra.write.mode("append").parquet(land)
        upsert_batches(read_landing(spark, land, SCHEMA), target, mark, lambda b: b.where("change_id <> 3")).awaitTermination()
    assert sorted(r.change_id for r in spark.read.parquet(target).collect()) == [0, 1, 2, 4, 5, 6, 7, 8]
    counted = change_counts(spark.read.parquet(land))  # the same plan serves a batch
    assert [(r.status, r.n) for r in counted.collect()] == [("added", 9)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("x\n")
    assert main(["scan", str(tmp_path)], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["added a.txt", "1 added, 0 modified, 0 deleted"]
    assert main(["commit", str(tmp_path), "-m", "m"], spark) == 0
    (tmp_path / "a.txt").write_text("y\n")
    capsys.readouterr()
    main(["diff", str(tmp_path)], spark)
    assert capsys.readouterr().out.splitlines()[-2:] == ["-x", "+y"]
    assert main(["undo", str(tmp_path)], spark) == 0 and main(["undo", str(tmp_path)], spark) == 1
    form = tmp_path / "F.txt"
    form.write_text("Begin Form\n Caption =\"C\"\nEnd\n")
    capsys.readouterr()
    main(["form", str(form)])
    assert capsys.readouterr().out.startswith("# F\n\n## Form Metadata\n\n- **Caption:** C")
