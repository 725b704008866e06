"""The command line: results on standard output, errors on standard error, exit codes."""

import pytest

from trestle import cli
from trestle.operators import zonemap


def test_query(spark, capsys, tmp_path):
    assert cli.main(["query"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "பெயர்\tவயது" and len(lines) == 11 and lines[1].endswith("\t22")
    spark.createDataFrame([(1, None), (2, "x")], "r_regionkey long, r_name string").coalesce(1).write.parquet(str(tmp_path / "region.parquet"))
    assert cli.main(["query", "இருந்து region | தேடு r_regionkey, r_name, r_regionkey", "--tables", str(tmp_path)]) == 0
    assert capsys.readouterr().out == "r_regionkey\tr_name\tr_regionkey\n1\t\t1\n2\tx\t2\n"


@pytest.mark.parametrize(("text", "name"), [("இருந்து இல்லை", "ColumnNotFound"), ("வடி x > 1", "ParseFailed"), ("இருந்து பயனர்கள் | எடு 99999999999999999999", "LiteralOverflow")])
def test_errors(spark, capsys, text, name):
    assert cli.main(["query", text]) == 1
    out = capsys.readouterr()
    assert out.out == "" and out.err.startswith(name + ":")


def test_ingest(spark, capsys, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n3,a\n1,b\n")
    out = str(tmp_path / "out")
    assert cli.main(["ingest", str(tmp_path / "in.csv"), "--schema", "id:i64,name:utf8", "--out", out]) == 0
    assert capsys.readouterr().out.strip() == "2 rows"
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "b"), (3, "a")]
    assert [(r["row_count"], r["min"], r["max"]) for r in zonemap.load(spark, f"{out}.zmap/id").collect()] == [(2, 1, 3)]
    assert cli.main(["ingest", str(tmp_path / "in.csv"), "--schema", "id:i64", "--out", out]) == 1
    assert capsys.readouterr().err.startswith("HeaderMismatch:")
    assert cli.main(["ingest", str(tmp_path / "none.csv"), "--schema", "id:i64", "--out", out]) == 1
    assert capsys.readouterr().err.startswith("IoError:")
    assert cli.main(["ingest", str(tmp_path / "in.csv"), "--schema", "a:utf8,b:utf8", "--out", out, "--no-header"]) == 0
    assert capsys.readouterr().out.strip() == "3 rows"
