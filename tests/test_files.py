"""CSV ingest and zone maps."""

import pytest

from trestle import errors as E
from trestle.operators import zonemap as Z
from trestle.sources import ingest as I


def test_schema():
    assert I.parse_schema("id:i64, name:TEXT,age:int") == [("id", "long"), ("name", "string"), ("age", "long")]
    for bad in ("", "id", "id:float", "id:i64,id:utf8", ":i64"):
        with pytest.raises(E.SchemaError):
            I.parse_schema(bad)


def put(tmp_path, data):
    p = tmp_path / "in.csv"
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def take(spark, tmp_path, data, schema, header=True):
    out = str(tmp_path / "out")
    n = I.ingest_csv(spark, put(tmp_path, data), schema, out, header)
    rows = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert len(rows) == n
    return rows


def test_ingest(spark, tmp_path):
    assert sorted(take(spark, tmp_path, "id,name,age\r\n1,அருண்,18\r\n\r\n2, x ,+7\n3,,-5", "id:i64,name:utf8,age:i64")) == [(1, "அருண்", 18), (2, " x ", 7), (3, "", -5)]
    assert sorted(take(spark, tmp_path, 'id,note\n1,"hello, world"\n2,"she said ""hi"""\n3,"a"b\n', "id:i64,note:utf8")) == [(1, "hello, world"), (2, 'she said "hi"'), (3, "ab")]
    assert take(spark, tmp_path, "", "id:i64") == []
    big = "user_id,price\n" + "".join(f"{i % 500},{100 + i % 900}\n" for i in range(12_000))
    got = take(spark, tmp_path, big, "user_id:i64,price:i64")
    assert sum(p for _, p in got) == sum(100 + i % 900 for i in range(12_000))


@pytest.mark.parametrize(
    ("data", "error", "line"),
    [("id,v\n1,2\n3\n", E.ColumnCountMismatch, 3), ("id,v\nx,2\n1\n", E.NumericParse, 2), ("id,v\n1,9223372036854775808\n", E.NumericParse, 2), ("id,v\n1,1_0\n", E.NumericParse, 2), ("a,v\n1,2\n", E.HeaderMismatch, None), ('id,v\n1,"2\n', E.UnterminatedQuote, 2), (b"id,v\n1,\xff\n", E.InvalidUtf8, 0)],
)
def test_bad(spark, tmp_path, data, error, line):
    with pytest.raises(error) as e:
        take(spark, tmp_path, data, "id:i64,v:i64")
    assert line is None or e.value.line == line
    assert not (tmp_path / "out").exists()


def column(spark, tmp_path, values):
    path = str(tmp_path / "t")
    spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_zones(spark, tmp_path):
    values = [(i * 2654435761) % 1_000_000 for i in range(12_000)]
    df = column(spark, tmp_path, values)
    zones = Z.build(df, "v")
    got = sorted((r["page_index"], r["row_count"], r["min"], r["max"]) for r in zones.collect())
    assert got == [(p, len(x), min(x), max(x)) for p, x in enumerate(values[i : i + 512] for i in range(0, 12_000, 512))]
    Z.save(zones, str(tmp_path / "z"))
    assert Z.load(spark, str(tmp_path / "z")).count() == 24
    assert Z.load(spark, str(tmp_path / "none")) is None
    with pytest.raises(E.ZoneMapError):
        Z.load(spark, str(tmp_path / "t"))


@pytest.mark.parametrize(("op", "literal", "skipped", "kept"), [(">", 99_999, 1, 512), (">", 511, 1, 512), (">", 510, 0, 513), ("<", 0, 2, 0), ("=", 100_000, 1, 1), ("=", 600, 2, 0)])
def test_pushdown(spark, tmp_path, op, literal, skipped, kept):
    df = column(spark, tmp_path, [*range(512), *range(100_000, 100_512)])
    with_map, without = Z.filter_pages(df, "v", op, literal, Z.build(df, "v")), Z.filter_pages(df, "v", op, literal)
    rows = sorted(r[0] for r in with_map.rows.collect())
    assert rows == sorted(r[0] for r in without.rows.collect()) and len(rows) == kept
    s = with_map.stats.collect()[0]
    assert (s["pages_total"], s["pages_skipped"], s["rows_kept"], s["rows_scanned"]) == (2, skipped, kept, 512 * (2 - skipped))
    assert without.stats.collect()[0]["pages_skipped"] == 0


def test_page_may_match(spark):
    page = spark.createDataFrame([(100, 200)], "min long, max long")
    for op, literal, yes in ((">", 200, False), (">", 199, True), ("<", 100, False), ("<", 101, True), ("=", 99, False), ("=", 100, True), ("=", 200, True), ("=", 201, False)):
        assert page.filter(Z.page_may_match(op, literal)).count() == yes


def test_marks_and_digits(spark, tmp_path):
    """A byte order mark is part of the first field; numbers of thousands of digits are errors or, with zeros, numbers."""
    with pytest.raises(E.HeaderMismatch):
        take(spark, tmp_path, b"\xef\xbb\xbfid\n1\n", "id:i64")
    assert take(spark, tmp_path, b"\xef\xbb\xbfx\ny\n", "v:utf8", header=False) == [("\ufeffx",), ("y",)]
    with pytest.raises(E.NumericParse) as e:
        take(spark, tmp_path, "v\n1\n" + "9" * 5000 + "\n", "v:i64")
    assert e.value.line == 3
    assert sorted(take(spark, tmp_path, "v\n" + "0" * 5000 + "7\n-" + "0" * 5000 + "\n-9223372036854775808\n", "v:i64")) == [(-(1 << 63),), (0,), (7,)]


def test_lines_of_a_large_file(spark, tmp_path):
    """The first error and its line, over several partitions; bytes that aren't UTF-8 go before all others."""
    lines = ["id,v", *(f"{i},x{i}" for i in range(30_000))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(put(tmp_path, "\n".join(lines))).rdd.getNumPartitions() > 3
        assert len(take(spark, tmp_path, "\n".join(lines), "id:i64,v:utf8")) == 30_000
        lines[20_001], lines[25_000] = "bad,x", "1"
        with pytest.raises(E.NumericParse) as e:
            take(spark, tmp_path, "\n".join(lines), "id:i64,v:utf8")
        assert e.value.line == 20_002
        with pytest.raises(E.InvalidUtf8):
            take(spark, tmp_path, "\n".join(lines).encode() + b"\n7,\xff\n", "id:i64,v:utf8")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def scanned(df):
    """(rows, files) that the scan of a frame gives, by the plan's own metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    m = plan.collectLeaves().head().metrics()
    return m.apply("numOutputRows").value(), m.apply("numFiles").value()


def test_pages_are_skipped(spark, tmp_path):
    """In a stored table the reader leaves out the pages that the map rules out, where values are clustered, and files without a match aren't listed."""
    n = 200 * 512
    clustered = Z.store(spark.range(n).selectExpr("id AS v").coalesce(1), str(tmp_path / "c"))
    mixed = Z.store(spark.range(n).selectExpr("(id * 48271) % 1000003 AS v").coalesce(1), str(tmp_path / "r"))
    zones = Z.build(clustered, "v")
    assert zones.count() == 200
    found = Z.filter_pages(clustered, "v", ">", n - 1000, zones)
    assert found.rows.count() == 999 and scanned(found.rows)[0] <= 3 * 512
    s = found.stats.collect()[0]
    assert (s["pages_total"], s["pages_skipped"], s["pages_scanned"], s["rows_scanned"], s["rows_kept"]) == (200, 198, 2, 1024, 999)
    assert scanned(Z.filter_pages(mixed, "v", ">", 500_000, Z.build(mixed, "v")).rows)[0] == n
    parts = Z.store(spark.range(0, n, 1, 8).selectExpr("id AS v"), str(tmp_path / "p"))
    some = Z.filter_pages(parts, "v", ">", n - 10, Z.build(parts, "v").drop("x"))
    assert scanned(some.rows)[1] == 1 and some.rows.count() == 9
    without = Z.build(parts, "v").filter("max < 20000")
    s = Z.filter_pages(parts, "v", ">", n - 10, without).stats.collect()[0]
    assert s["pages_skipped"] == without.count() and s["rows_kept"] == 9 and s["pages_total"] == 200


def test_corrupt(spark, tmp_path):
    df = column(spark, tmp_path, range(1500))
    zones = Z.build(df, "v")
    Z.check(df, "v", zones)
    with pytest.raises(E.PageCorrupt) as e:
        Z.check(df, "v", zones.selectExpr("file", "page_index", "row_count - CAST(page_index = 1 AS INT) AS row_count", "min", "max"))
    assert e.value.page_index == 1
    with pytest.raises(E.PageCorrupt) as e:
        Z.execute_streaming(df, "v", rows=2000)
    assert e.value.page_index == 2
    got = Z.execute_streaming(df, "v", rows=1500)
    assert got.columns == ["stream"] and got.count() == 1478


def test_cursor(spark, tmp_path):
    pages = Z.PageCursor(column(spark, tmp_path, range(1100)), 512)
    assert [r[0] for r in pages.next().collect()] == list(range(512))
    assert pages.skip() and pages.pages_emitted == 2
    assert [r[0] for r in pages.next().collect()] == list(range(1024, 1100))
    assert pages.next() is None and not pages.skip()
    pages.rewind()
    assert pages.next().count() == 512
