"""The command line: what it lists, runs and compares."""

import json

import pytest

from quire import __main__ as cli


def test_list_and_unknown_names(capsys):
    cli.main(["list"])
    assert "a1_page_tally" in capsys.readouterr().out.split()
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", "--input", "x", "--out", "y"])


def test_run_writes_the_result(spark, tmp_path):
    cli.main(["run", "a2_run_report", "--input", "/root/testdata/sf0.001/", "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).first()["regions"] > 0


def test_two_exports_are_compared(spark, tmp_path, capsys):
    def export(name, lines):
        doc = {"pages": [{"name": "p1", "regions": [{"id": i, "order": i, "kind": "bubble", "japanese": "行こう", "english": t, "speaker": "a"} for i, t in enumerate(lines)]}]}
        (tmp_path / name).write_text(json.dumps(doc))
        return str(tmp_path / name)

    cli.main(["evaluate", export("a.json", ["We go", "I see", " "]), export("b.json", ["we go", "You see", "x"])])
    out = capsys.readouterr().out
    assert "compared=2 word_for_word=1" in out and "disagree=1" in out
