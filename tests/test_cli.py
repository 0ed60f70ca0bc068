"""The command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera.plans import registry


def test_query(spark, tmp_path, capsys):
    rows = [(1, 10, "Methods", "The lattice has 4 sites. It is cold."), (2, 11, "Results", "Spin waves travel fast."), (3, 12, "Results", "Nothing of this kind.")]
    path = str(tmp_path / "chunks")
    spark.createDataFrame(rows, "doc_id long, paper_id long, section string, text string").write.parquet(path)
    cli.main(["query", "how many sites has the lattice", "--chunks", path, "--json", "--top-k", "2"])
    got = json.loads(capsys.readouterr().out)
    assert got["documents"][0]["doc_id"] == 1 and len(got["documents"]) <= 2 and "lattice" in got["answer"]
    cli.main(["query", "how many sites has the lattice", "--chunks", path])
    assert capsys.readouterr().out.strip() == got["answer"]


def test_run_and_list(spark, small, tmp_path, capsys):
    cli.main(["list"])
    assert capsys.readouterr().out.split() == sorted(registry.QUERIES)
    out = str(tmp_path / "out")
    cli.main(["run", "key_ranges", "--tables", small, "--out", out])
    assert spark.read.parquet(out).agg(F.sum("n")).collect()[0][0] == spark.read.parquet(f"{small}/events.parquet").count()
    with pytest.raises(SystemExit):
        cli.main(["run", "no_such_query", "--tables", small])
