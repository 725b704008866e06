"""Lexer, parser, planner: hand-computed results."""

import pytest

from trestle import errors as E
from trestle.plans import parser as P
from trestle.plans import planner
from trestle.plans.lexer import KEYWORDS, tokenize
from trestle.sources import catalog as C


def rows(spark, text, tables=None):
    df = planner.run(spark, tables or C.demo_catalog(spark), text)
    return [tuple(r) for r in df.collect()]


def ages(spark, n):
    return C.Catalog().register(C.USERS, C.from_rows(spark, {C.NAME: "string", C.AGE: "long"}, [(str(i % 10), i) for i in range(n)]))


def test_tokens():
    assert [t.kind for t in tokenize(" ".join(KEYWORDS))][:-1] == list(KEYWORDS.values())
    assert [t.kind for t in tokenize("வடிவமைப்பு")] == ["ident", "end"]
    assert [t.kind for t in tokenize("10abc|=><,;*+-")] == ["number", "ident", *"|=><,;*+-", "end"]
    assert [t.kind for t in tokenize("​வடி\v\f​x")] == ["filter", "ident", "end"]
    assert tokenize("a​b")[0].text == "a​b"
    with pytest.raises(E.LexTokenBufferFull):
        tokenize("| " * 9000)


@pytest.mark.parametrize("cut", [1, 2, 4, 5, 7, 8, 10, 11])
def test_torn_bytes(cut):
    with pytest.raises(E.LexMalformedUtf8):
        tokenize("தேடு".encode()[:cut])


def test_parser_errors():
    for text, error in (("", E.EmptyInput), (" \n", E.EmptyInput), ("வடி x > 1", E.MissingSourceContext), ("இருந்து a |", E.UnexpectedToken), ("| | |;", E.MissingSourceContext), ("இருந்து a | வடி x > 9223372036854775808", E.NumberOverflow), ("இருந்து a" + " | வடி x > 0" * 1025, E.ArenaOverflow)):
        with pytest.raises(error):
            P.parse(text)
    assert len(P.parse("இருந்து a; இருந்து")) == 1


def test_engine_errors(spark):
    for text, error in (("வடி x > 1", E.ParseFailed), ("இருந்து இல்லை", E.ColumnNotFound), ("இருந்து பயனர்கள் | வடி இல்லை > 1", E.ColumnNotFound), ("இருந்து பயனர்கள் | வடி பெயர் > 1", E.ColumnNotFound), ("இருந்து பயனர்கள் | அடுக்கு பெயர்", E.ParseFailed), ("இருந்து பயனர்கள் | வடி வயது > 99999999999999999999", E.LiteralOverflow), ("இருந்து பயனர்கள் | தேடு இல்லை", E.ColumnNotFound), (b"\xe0\xae", E.ParseFailed), ("இருந்து பயனர்கள் | இணை ஆர்டர்கள் எங்கே அடையாளம் > விலை", E.ParseFailed)):
        with pytest.raises(error):
            planner.run(spark, C.demo_catalog(spark), text)


def test_demo(spark):
    got = rows(spark, "இருந்து பயனர்கள் | வடி வயது > 21 | அடுக்கு வயது | எடு 10 | தேடு பெயர், வயது;")
    assert [a for _, a in got] == list(range(22, 32))
    assert [n for n, _ in got] == "பிரியா கோபால் மீனா லட்சுமி சுமதி ராஜ் விஜய் நந்தினி முருகன் கார்த்திக்".split()


def test_joins(spark):
    assert len(rows(spark, "இருந்து பயனர்கள் | இணை ஆர்டர்கள் | வடி வயது > 21 | தேடு பெயர், விலை")) == 11
    got = rows(spark, "இருந்து பயனர்கள் | இணை ஆர்டர்கள் | கணி புதிய_விலை = விலை * 2 | வடி புதிய_விலை > 200")
    assert len(got) == 11 and all(len(r) == 1 and r[0] > 200 and r[0] % 2 == 0 for r in got)
    assert len(rows(spark, "இருந்து பயனர்கள் | இணை ஆர்டர்கள் | இணை ஆர்டர்கள் | தேடு விலை")) == 12
    many = C.Catalog().register(C.USERS, C.from_rows(spark, {C.ID: "long", C.AGE: "long"}, [(1, 30), (2, 40)])).register(C.ORDERS, C.from_rows(spark, {C.ID: "long", C.PRICE: "long"}, [(1, 10), (1, 20), (1, 30), (2, 40)]))
    assert sorted(rows(spark, "இருந்து பயனர்கள் | இணை ஆர்டர்கள் | தேடு வயது, விலை", many)) == [(30, 10), (30, 20), (30, 30), (40, 40)]
    assert len(rows(spark, "இருந்து பயனர்கள் | இணை ஆர்டர்கள் எங்கே அடையாளம் = அடையாளம் | தேடு விலை")) == 12


def test_groups(spark):
    assert [r[0] for r in rows(spark, "இருந்து ஆர்டர்கள் | தொகுப்பு விலை | தேடு விலை")] == [100, 350, 400, 450, 500, 550, 600, 700, 800, 900, 1100, 1200]
    dup = C.duplicate_price_catalog(spark)
    assert rows(spark, "இருந்து ஆர்டர்கள் | தொகுப்பு விலை | தேடு விலை, எண்ணிக்கை", dup) == [(100, 3), (250, 4), (500, 1)]
    assert rows(spark, "இருந்து ஆர்டர்கள் | தொகுப்பு விலை | சுருக்கு விலை | தேடு விலை", dup) == [(300,), (1000,), (500,)]
    assert rows(spark, "இருந்து ஆர்டர்கள் | தொகுப்பு விலை | தேடு அடையாளம்", dup) == [(1,), (2,), (7,)]
    assert rows(spark, "இருந்து ஆர்டர்கள் | தொகுப்பு விலை | சுருக்கு அடையாளம் | வடி எண்ணிக்கை > 1 | தேடு அடையாளம்", dup) == [(9,), (20,)]
    assert rows(spark, "இருந்து ஆர்டர்கள் | சுருக்கு விலை", dup) == [(1800,)]
    assert rows(spark, "இருந்து ஆர்டர்கள் | வடி விலை > 9000 | சுருக்கு விலை", dup) == [(0,)]


def test_limits(spark):
    assert len(rows(spark, "இருந்து பயனர்கள் " + "| வடி வயது > 0 " * 80 + "| எடு 5 | தேடு வயது")) == 5
    assert rows(spark, "இருந்து பயனர்கள் | வடி வயது > 2047 | அடுக்கு வயது | தேடு வயது", ages(spark, 2050)) == [(2048,), (2049,)]
    assert rows(spark, "இருந்து பயனர்கள் | எடு 0 | தேடு வயது", ages(spark, 5)) == []
    empty = C.Catalog().register("வெறுமை", C.from_rows(spark, {C.AGE: "long"}, []))
    assert rows(spark, "இருந்து வெறுமை | வடி வயது > 1 | தேடு வயது", empty) == []
    assert rows(spark, "இருந்து வெறுமை | தொகுப்பு வயது | தேடு எண்ணிக்கை", empty) == []
    assert planner.run(spark, C.demo_catalog(spark), "இருந்து பயனர்கள்").columns == []


def test_stability_and_barriers(spark):
    t = C.Catalog().register("t", C.from_rows(spark, {"k": "long", "v": "long"}, [(i % 3, i) for i in range(30)]))
    assert rows(spark, "இருந்து t | அடுக்கு k | எடு 12 | தேடு v", t) == [(v,) for v in [*range(0, 30, 3), 1, 4]]
    assert rows(spark, "இருந்து t | எடு 10 | வடி k = 1 | தேடு v", t) == [(1,), (4,), (7,)]
    assert rows(spark, "இருந்து t | எடு 4 | அடுக்கு k | தேடு v", t) == [(0,), (3,), (1,), (2,)]
    assert rows(spark, "இருந்து t | எடு 4 | தொகுப்பு k | தேடு எண்ணிக்கை", t) == [(2,), (1,), (1,)]
    assert rows(spark, "இருந்து t | அடுக்கு v | அடுக்கு k | எடு 2 | தேடு k, v, k", t) == [(0, 0, 0), (0, 3, 0)]


def test_wrapping(spark):
    big = (1 << 63) - 1
    t = C.Catalog().register("t", C.from_rows(spark, {"v": "long"}, [(big,), (big,)]))
    spark.conf.set("spark.sql.ansi.enabled", "true")
    assert rows(spark, f"இருந்து t | கணி x = v + 1 | எடு 1 | தேடு x", t) == [(-big - 1,)]
    assert rows(spark, "இருந்து t | சுருக்கு v", t) == [(-2,)]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_streaming(spark, tmp_path):
    from trestle.streaming import append

    spark.range(100).selectExpr("id", "id % 7 AS k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k long").parquet(str(tmp_path / "in"))
    out = append.run(spark, C.Catalog().register("t", stream), "இருந்து t | வடி k > 4 | கணி x = id * 2 | தேடு id, x")
    q = out.writeStream.format("memory").queryName("trestle_stream").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("trestle_stream").collect()) == [(i, 2 * i) for i in range(100) if i % 7 > 4]
    with pytest.raises(E.NotImplementedStage):
        append.run(spark, C.Catalog().register("t", stream), "இருந்து t | எடு 3")


def test_long_numbers():
    with pytest.raises(E.NumberOverflow):
        P.parse("இருந்து a | எடு " + "9" * 5000)
    assert P.parse("இருந்து a | எடு " + "0" * 5000 + "7")[1] == P.Take(7)


def test_large_limits(spark, monkeypatch):
    """Limits beyond 32 bits: all rows, and with the bound moved down, rows cut by their places in sorted files."""
    t = C.Catalog().register("t", C.from_rows(spark, {"k": "long", "v": "long"}, [((i * 7) % 100, i) for i in range(100)]))
    assert len(rows(spark, f"இருந்து t | எடு {1 << 40} | தேடு v", t)) == 100
    monkeypatch.setattr(planner, "MAX_LIMIT", 10)
    assert rows(spark, "இருந்து t | அடுக்கு k | எடு 37 | தேடு k", t) == [(i,) for i in range(37)]
    assert rows(spark, "இருந்து t | எடு 64 | வடி v > 60 | தேடு v", t) == [(61,), (62,), (63,)]


def test_tables_open_late(spark):
    opened = []

    def table(name):
        opened.append(name)
        return C.from_rows(spark, {"k": "long"}, [(1,)])

    t = C.Catalog().register("a", lambda: table("a")).register("b", lambda: table("b"))
    assert rows(spark, "இருந்து a | தேடு k", t) == rows(spark, "இருந்து a | தேடு k", t) == [(1,)] and opened == ["a"]


def test_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id AS k").repartition(3).write.parquet(path)
    live = spark.read.parquet(path)
    order = [r[0] for r in live.orderBy("_metadata.file_path", "_metadata.row_index").collect()]
    t = C.Catalog().register_snapshot("t", live)
    spark.range(5).selectExpr("id AS k").write.mode("overwrite").parquet(path)
    assert [r[0] for r in rows(spark, "இருந்து t | எடு 100 | தேடு k", t)] == order


def test_checked(spark):
    df, stats = planner.run_checked(spark, C.demo_catalog(spark), "இருந்து பயனர்கள் | எடு 3 | தேடு வயது, வயது")
    assert [tuple(r) for r in df.collect()] == [(18, 18), (22, 22), (19, 19)] and stats == planner.PageStats(0, 0, 0, 0, 0)
