"""The registered queries of the pipeline language and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from ..operators import groups, zonemap
from ..sources import catalog, folders, ingest, sink
from . import parser, planner

USERS_SQL = "(SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS age FROM customer)"
ORDERS_SQL = "(SELECT o_custkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderkey FROM orders)"

#: name -> (pipeline, SQL)
PIPELINES: dict[str, tuple[str, str]] = {
    "scan_project": ("இருந்து orders | தேடு o_orderkey, o_custkey", "SELECT o_orderkey, o_custkey FROM orders"),
    "filter_gt": ("இருந்து events | வடி user_id > 100 | தேடு event_id, user_id", "SELECT event_id, user_id FROM events WHERE user_id > 100"),
    "filter_lt": ("இருந்து events | வடி user_id < 100 | தேடு event_id, user_id", "SELECT event_id, user_id FROM events WHERE user_id < 100"),
    "filter_eq": ("இருந்து events | வடி user_id = 7 | தேடு event_id, user_id", "SELECT event_id, user_id FROM events WHERE user_id = 7"),
    "filter_conj": ("இருந்து events | வடி user_id > 50 | வடி event_id < 5000 | தேடு event_id, user_id", "SELECT event_id, user_id FROM events WHERE user_id > 50 AND event_id < 5000"),
    "sort_take": ("இருந்து orders | அடுக்கு o_custkey | எடு 10 | தேடு o_custkey, o_orderkey", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 10"),
    "demo_pipeline": ("இருந்து பயனர்கள் | வடி வயது > 21 | அடுக்கு வயது | எடு 10 | தேடு பெயர், வயது;", f'SELECT name AS "பெயர்", age AS "வயது" FROM {USERS_SQL} WHERE age > 21 ORDER BY age, id LIMIT 10'),
    "take_unsorted": ("இருந்து orders | எடு 25 | தேடு o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25"),
    "take_zero": ("இருந்து orders | எடு 0 | தேடு o_orderkey", "SELECT o_orderkey FROM orders LIMIT 0"),
    "take_then_filter": ("இருந்து orders | எடு 100 | வடி o_custkey > 500 | தேடு o_orderkey, o_custkey", "SELECT o_orderkey, o_custkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100) WHERE o_custkey > 500"),
    "sort_then_filter": ("இருந்து orders | அடுக்கு o_custkey | வடி o_orderkey > 100 | எடு 20 | தேடு o_orderkey, o_custkey", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_custkey, o_orderkey LIMIT 20"),
    "join_inner": ("இருந்து பயனர்கள் | இணை ஆர்டர்கள் | தேடு பெயர், விலை", f'SELECT name AS "பெயர்", price AS "விலை" FROM {USERS_SQL} JOIN {ORDERS_SQL} USING (id)'),
    "join_filter_left": ("இருந்து பயனர்கள் | இணை ஆர்டர்கள் | வடி வயது > 21 | தேடு பெயர், விலை", f'SELECT name AS "பெயர்", price AS "விலை" FROM {USERS_SQL} JOIN {ORDERS_SQL} USING (id) WHERE age > 21'),
    "join_filter_right": ("இருந்து பயனர்கள் | இணை ஆர்டர்கள் | வடி விலை > 200000 | தேடு பெயர், விலை", f'SELECT name AS "பெயர்", price AS "விலை" FROM {USERS_SQL} JOIN {ORDERS_SQL} USING (id) WHERE price > 200000'),
    "join_on": ("இருந்து orders | இணை lineitem எங்கே o_orderkey = l_orderkey | தேடு o_custkey, l_partkey", "SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "join_double": ("இருந்து பயனர்கள் | இணை ஆர்டர்கள் | இணை பயனர்கள் | தேடு விலை, பெயர்", f'SELECT price AS "விலை", u.name AS "பெயர்" FROM {USERS_SQL} u JOIN {ORDERS_SQL} o ON u.id = o.id JOIN {USERS_SQL} v ON u.id = v.id'),
    "join_disjoint": ("இருந்து nation | இணை orders எங்கே n_nationkey = o_orderkey | வடி o_orderkey > 1000 | தேடு n_name, o_orderkey", "SELECT n_name, o_orderkey FROM nation JOIN orders ON n_nationkey = o_orderkey WHERE o_orderkey > 1000"),
    "derive_mul": ("இருந்து part | கணி x = p_size * 2 | தேடு p_partkey, x", "SELECT p_partkey, CAST(p_size AS BIGINT) * 2 AS x FROM part"),
    "derive_lit_sub": ("இருந்து part | கணி x = 100 - p_size | தேடு p_partkey, x", "SELECT p_partkey, 100 - CAST(p_size AS BIGINT) AS x FROM part"),
    "derive_col_col": ("இருந்து events | கணி x = event_id + user_id | தேடு event_id, x", "SELECT event_id, event_id + user_id AS x FROM events"),
    "derive_copy": ("இருந்து events | கணி x = user_id | தேடு x", "SELECT user_id AS x FROM events"),
    "derive_literal": ("இருந்து nation | கணி x = 2 + 3 | தேடு n_name, x", "SELECT n_name, CAST(5 AS BIGINT) AS x FROM nation"),
    "derive_chain": ("இருந்து events | கணி x = user_id * 3 | கணி y = x - event_id | வடி y > 0 | தேடு event_id, x, y", "SELECT event_id, user_id * 3 AS x, user_id * 3 - event_id AS y FROM events WHERE user_id * 3 - event_id > 0"),
    "derive_filter_implicit": ("இருந்து பயனர்கள் | இணை ஆர்டர்கள் | கணி புதிய_விலை = விலை * 2 | வடி புதிய_விலை > 200", f'SELECT price * 2 AS "புதிய_விலை" FROM {USERS_SQL} JOIN {ORDERS_SQL} USING (id) WHERE price * 2 > 200'),
    "derive_join": ("இருந்து பயனர்கள் | கணி x = வயது * 10 | இணை ஆர்டர்கள் | தேடு x, விலை", f'SELECT age * 10 AS x, price AS "விலை" FROM {USERS_SQL} JOIN {ORDERS_SQL} USING (id)'),
    "group_keys": ("இருந்து orders | தொகுப்பு o_custkey | தேடு o_custkey", "SELECT DISTINCT o_custkey FROM orders"),
    "group_count": ("இருந்து orders | தொகுப்பு o_custkey | தேடு o_custkey, எண்ணிக்கை", 'SELECT o_custkey, count(*) AS "எண்ணிக்கை" FROM orders GROUP BY 1'),
    "group_having": ("இருந்து orders | தொகுப்பு o_custkey | வடி எண்ணிக்கை > 10 | தேடு o_custkey, எண்ணிக்கை", 'SELECT o_custkey, count(*) AS "எண்ணிக்கை" FROM orders GROUP BY 1 HAVING count(*) > 10'),
    "group_representative": ("இருந்து orders | தொகுப்பு o_custkey | தேடு o_custkey, o_orderkey", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY 1"),
    "group_sum": ("இருந்து orders | தொகுப்பு o_custkey | சுருக்கு o_orderkey | தேடு o_custkey, o_orderkey, எண்ணிக்கை", 'SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS o_orderkey, count(*) AS "எண்ணிக்கை" FROM orders GROUP BY 1'),
    "group_derive": ("இருந்து orders | தொகுப்பு o_custkey | கணி x = எண்ணிக்கை * 100 | தேடு o_custkey, x", "SELECT o_custkey, count(*) * 100 AS x FROM orders GROUP BY 1"),
    "group_sort_take": ("இருந்து orders | தொகுப்பு o_custkey | அடுக்கு எண்ணிக்கை | எடு 7 | தேடு o_custkey, எண்ணிக்கை", 'SELECT o_custkey, count(*) AS "எண்ணிக்கை" FROM orders GROUP BY 1 ORDER BY 2, 1 LIMIT 7'),
    "group_join": ("இருந்து orders | தொகுப்பு o_custkey | இணை customer எங்கே o_custkey = c_custkey | தேடு c_name, எண்ணிக்கை", 'SELECT c_name, n AS "எண்ணிக்கை" FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey'),
    "global_sum": ("இருந்து orders | வடி o_custkey > 100 | சுருக்கு o_orderkey", "SELECT CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS o_orderkey FROM orders WHERE o_custkey > 100"),
    "project_then_filter": ("இருந்து orders | தேடு o_orderkey | வடி o_custkey > 500", "SELECT o_orderkey FROM orders WHERE o_custkey > 500"),
    "take_then_sort": ("இருந்து orders | எடு 40 | அடுக்கு o_custkey | தேடு o_custkey, o_orderkey", "SELECT o_custkey, o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 40)"),
    "take_then_join": ("இருந்து orders | எடு 40 | இணை customer எங்கே o_custkey = c_custkey | தேடு o_orderkey, c_name", "SELECT o_orderkey, c_name FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 40) JOIN customer ON o_custkey = c_custkey"),
    "take_then_group": ("இருந்து orders | எடு 400 | தொகுப்பு o_custkey | தேடு o_custkey, எண்ணிக்கை", 'SELECT o_custkey, count(*) AS "எண்ணிக்கை" FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 400) GROUP BY 1'),
    "take_large": ("இருந்து orders | எடு 9000000000 | தேடு o_orderkey", "SELECT o_orderkey FROM orders"),
    "group_empty": ("இருந்து orders | வடி o_custkey > 999999999 | தொகுப்பு o_custkey | தேடு o_custkey, எண்ணிக்கை", 'SELECT o_custkey, count(*) AS "எண்ணிக்கை" FROM orders WHERE o_custkey > 999999999 GROUP BY 1'),
    "group_sum_key": ("இருந்து orders | தொகுப்பு o_custkey | சுருக்கு o_custkey | தேடு o_custkey", "SELECT CAST(sum(o_custkey) AS BIGINT) AS o_custkey FROM orders GROUP BY orders.o_custkey"),
    "group_restart_derive": ("இருந்து orders | தொகுப்பு o_custkey | இருந்து nation | கணி x = n_nationkey + 1 | தேடு n_name, x", "SELECT n_name, CAST(n_nationkey AS BIGINT) + 1 AS x FROM nation"),
    "lexical_edges": ("\u200bஇருந்து \u200borders\t|\x0bவடி\x0co_custkey>0100|கணி வடிவமைப்பு=o_custkey+00|தேடு o_orderkey,வடிவமைப்பு;இருந்து வடி", 'SELECT o_orderkey, o_custkey AS "வடிவமைப்பு" FROM orders WHERE o_custkey > 100'),
    "restart_source": ("இருந்து orders | எடு 3 | இருந்து nation | தேடு n_name", "SELECT n_name FROM nation"),
}

ZONES_SQL = "SELECT CAST((row_number() OVER (ORDER BY event_id) - 1) // 512 AS BIGINT) AS page_index, user_id, event_id FROM events"


def project_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is projected twice; the second one is renamed by its place, as tables can't have one name twice."""
    pipeline = "இருந்து part | வடி p_size > 40 | தேடு p_name, p_size, p_name"
    return planner.run(spark, catalog.test_tables(spark, sf_dir), pipeline).toDF("p_name", "p_size", "p_name_again")


def _zones(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """The map of a column of events, made once for each session and then read."""
    path = f"{folders.shared_folder(spark)}/trestle/{spark.sparkContext.applicationId}/zones-{zlib.crc32(sf_dir.encode())}/{column}"
    zones = zonemap.load(spark, path)
    if zones is None:
        zonemap.save(zonemap.build(_events(spark, sf_dir), column), path)
        zones = zonemap.load(spark, path)
    return zones


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def zonemap_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemap.build(_events(spark, sf_dir), "user_id").drop("file")


def zonemap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return zonemap.filter_pages(events, "event_id", ">", 9000, _zones(spark, sf_dir, "event_id"), ["user_id"]).rows


def zonemap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return zonemap.filter_pages(events, "event_id", ">", 9000, _zones(spark, sf_dir, "event_id")).stats


def zonemap_stats_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return zonemap.filter_pages(events, "user_id", "=", 7, _zones(spark, sf_dir, "user_id")).stats


def page_stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemap.filter_stream(_events(spark, sf_dir), "user_id", 21, 2)


def page_table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemap.table_filter_project(_events(spark, sf_dir), "user_id", 21, "event_id", 1000)


def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_stats(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation table as CSV, ingested again."""
    base = folders.new_path(spark, "csv")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    nation.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{base}/csv")
    ingest.ingest_csv(spark, f"{base}/csv", "n_nationkey:i64,n_name:utf8", f"{base}/parquet")
    return spark.read.parquet(f"{base}/parquet")


def columnar_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.columnar_demo(spark, 10_000).filter(F.col("ages") > 21)


def demo_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.run(spark, catalog.demo_catalog(spark), "இருந்து பயனர்கள் | தேடு அடையாளம், பெயர், வயது")


def demo_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.run(spark, catalog.demo_catalog(spark), "இருந்து பயனர்கள் | இணை ஆர்டர்கள் | கணி புதிய_விலை = விலை * 2 | வடி புதிய_விலை > 200 | தேடு பெயர், புதிய_விலை")


def duplicate_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.run(spark, catalog.duplicate_price_catalog(spark), "இருந்து ஆர்டர்கள் | தொகுப்பு விலை | தேடு விலை, எண்ணிக்கை")


def checked_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline's rows with the statistics that come with them."""
    df, stats = planner.run_checked(spark, catalog.test_tables(spark, sf_dir), "இருந்து nation | வடி n_nationkey > 10 | தேடு n_name")
    return df.select("n_name", *[F.lit(v).cast("long").alias(k) for k, v in vars(stats).items()])


def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a copy of orders, in the order of the table."""
    tables = catalog.Catalog().register_snapshot("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return planner.run(spark, tables, "இருந்து orders | எடு 700 | தேடு o_orderkey, o_custkey")


def page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page and the fourth."""
    pages = zonemap.PageCursor(_events(spark, sf_dir))
    pages.skip()
    second = pages.next()
    pages.skip()
    return second.select("event_id").unionByName(pages.next().select("event_id"))


def stream_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemap.execute_streaming(_events(spark, sf_dir), "user_id")


def zonemap_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table stored page by page, with a map of its own that agrees with it."""
    table = zonemap.store(_events(spark, sf_dir).select("event_id", "user_id").coalesce(1), folders.new_path(spark, "pages"))
    zones = zonemap.build(table, "event_id")
    zonemap.check(table, "event_id", zones)
    return zonemap.filter_pages(table, "event_id", "<", 700, zones, ["user_id"]).rows


def append_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline over orders as a stream of files, joined with a table at rest."""
    from ..streaming import append

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    base = folders.new_path(spark, "stream")
    orders.repartition(3).write.parquet(f"{base}/in")
    tables = catalog.Catalog().register("orders", spark.readStream.schema(orders.schema).parquet(f"{base}/in")).register("customer", spark.read.parquet(f"{sf_dir}/customer.parquet"))
    out = append.run(spark, tables, "இருந்து orders | வடி o_custkey > 300 | கணி x = o_orderkey * 2 | இணை customer எங்கே o_custkey = c_custkey | தேடு x, c_name")
    q = out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").format("parquet").option("path", f"{base}/out").start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def tsv_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = planner.run(spark, catalog.test_tables(spark, sf_dir), "இருந்து nation | தேடு n_nationkey, n_name, n_nationkey")
    return sink.tsv_lines(df)


def _raised(f: Callable[[], object]) -> str:
    try:
        f()
    except E.TrestleError as e:
        return type(e).__name__
    return "none"


#: name -> (pipeline, error) of pipelines that can't be planned
BAD = {
    "empty": (" \n", "ParseFailed"),
    "no source": ("வடி x > 1", "ParseFailed"),
    "dangling bar": ("இருந்து orders |", "ParseFailed"),
    "no table": ("இருந்து இல்லை", "ColumnNotFound"),
    "no column": ("இருந்து orders | வடி இல்லை > 1", "ColumnNotFound"),
    "filter on text": ("இருந்து nation | வடி n_name > 1", "ColumnNotFound"),
    "sort on text": ("இருந்து nation | அடுக்கு n_name", "ParseFailed"),
    "derive of text": ("இருந்து nation | கணி x = n_name + 1", "ColumnNotFound"),
    "join by greater": ("இருந்து orders | இணை customer எங்கே o_custkey > c_custkey", "ParseFailed"),
    "long literal": ("இருந்து orders | வடி o_custkey > 9223372036854775808", "LiteralOverflow"),
    "negative literal": ("இருந்து orders | வடி o_custkey > -1", "ParseFailed"),
    "number before name": ("இருந்து 10abc", "ParseFailed"),
    "too many stages": ("இருந்து orders " + "| வடி o_custkey > 0 " * 300, "ParseFailed"),
}
#: name -> (source, error) of what the parser itself refuses
UNPARSED = {
    "blank": ("", "EmptyInput"),
    "first stage": ("எடு 3", "MissingSourceContext"),
    "token": ("இருந்து orders | orders", "UnexpectedToken"),
    "overflow": ("இருந்து orders | எடு " + "9" * 5000, "NumberOverflow"),
    "torn bytes": ("இருந்து orders".encode()[:-7] + b"\xe0\xae", "LexMalformedUtf8"),
    "tokens": ("| " * 9000, "LexTokenBufferFull"),
    "nodes": ("இருந்து orders " + "| வடி o_custkey > 0 " * 300, "ArenaOverflow"),
}
#: name -> (file, schema, error, line) of files that can't be ingested
BAD_FILES = {
    "header": (b"a,v\n1,2\n", "id:i64,v:i64", "HeaderMismatch", 0),
    "byte order mark": (b"\xef\xbb\xbfid,v\n1,2\n", "id:i64,v:i64", "HeaderMismatch", 0),
    "few fields": (b"id,v\n1,2\n\n3\nx,y\n", "id:i64,v:i64", "ColumnCountMismatch", 4),
    "letters": (b"id,v\n1,2\n3,4x\n5\n", "id:i64,v:i64", "NumericParse", 3),
    "range": (b"id,v\n1,9223372036854775808\n", "id:i64,v:i64", "NumericParse", 2),
    "underscore": (b"id,v\n1,1_0\n", "id:i64,v:i64", "NumericParse", 2),
    "quote": (b'id,v\n1,2\n3,"4\n', "id:i64,v:utf8", "UnterminatedQuote", 3),
    "bytes": (b"id,v\nx,2\n3,\xff\n", "id:i64,v:utf8", "InvalidUtf8", 0),
    "schema": (b"id\n", "id:float", "SchemaError", 0),
    "column twice": (b"id\n", "id:i64,id:utf8", "SchemaError", 0),
}
CSV = b'id,note\r\n1,"hello, world"\r\n\r\n +2 ,"she said ""hi"""\n-3,"a"b \n4,\n5,x"y\n6,end\r'


def query_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = catalog.test_tables(spark, sf_dir)
    found = [(k, _raised(lambda: planner.run(spark, tables, source))) for k, (source, _) in BAD.items()]  # noqa: B023
    found += [(k, _raised(lambda: parser.parse(source))) for k, (source, _) in UNPARSED.items()]  # noqa: B023
    events = _events(spark, sf_dir)
    zones = zonemap.build(events, "event_id")
    found.append(("short page", _raised(lambda: zonemap.execute_streaming(events, "user_id", rows=1 << 40))))
    found.append(("page of another table", _raised(lambda: zonemap.check(events, "event_id", zones.withColumn("max", F.col("max") + 1)))))
    found.append(("map without columns", _raised(lambda: zonemap.load(spark, f"{sf_dir}/events.parquet"))))
    found.append(("no file", _raised(lambda: ingest.ingest_csv(spark, folders.new_path(spark, "none"), "id:i64", folders.new_path(spark, "none")))))
    return spark.createDataFrame(found, "name string, error string")


def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for name, (data, schema, _, _) in BAD_FILES.items():
        base = folders.new_path(spark, "bad")
        try:
            ingest.ingest_csv(spark, folders.put(spark, f"{base}/in.csv", data), schema, f"{base}/out")
            found.append((name, "none", 0))
        except E.TrestleError as e:
            found.append((name, type(e).__name__, getattr(e, "line", 0)))
    return spark.createDataFrame(found, "name string, error string, line long")


def csv_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, empty lines, signs, spaces and carriage returns of one small file."""
    base = folders.new_path(spark, "csv")
    ingest.ingest_csv(spark, folders.put(spark, f"{base}/in.csv", CSV), "id:i64,note:utf8", f"{base}/out")
    return spark.read.parquet(f"{base}/out")


def _values(rows: list[tuple], names: str) -> str:
    def one(v: object) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


ERRORS = [(k, e) for k, (_, e) in (BAD | UNPARSED).items()] + [("short page", "PageCorrupt"), ("page of another table", "PageCorrupt"), ("map without columns", "ZoneMapError"), ("no file", "IoError")]
#: The demo users.
USERS_ROWS = [(0, "அருண்", 18), (1, "பிரியா", 22), (2, "கண்ணன்", 19), (3, "லட்சுமி", 25), (4, "முருகன்", 30), (5, "கவிதா", 21), (6, "ராஜ்", 27), (7, "மீனா", 24), (8, "சுரேஷ்", 17), (9, "தீபா", 35), (10, "விஜய்", 28), (11, "அனிதா", 20), (12, "கோபால்", 23), (13, "சுமதி", 26), (14, "கார்த்திக்", 31), (15, "நந்தினி", 29)]
DOUBLED = [("பிரியா", 900), ("லட்சுமி", 1600), ("முருகன்", 2400), ("ராஜ்", 700), ("மீனா", 1200), ("தீபா", 1800), ("விஜய்", 1000), ("கோபால்", 1400), ("சுமதி", 1100), ("கார்த்திக்", 2200), ("நந்தினி", 800)]

OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "project_duplicate": (project_duplicate, "SELECT p_name, CAST(p_size AS BIGINT) AS p_size, p_name AS p_name_again FROM part WHERE p_size > 40"),
    "zonemap_build": (zonemap_build, f"SELECT page_index, count(*) AS row_count, min(user_id) AS min, max(user_id) AS max FROM ({ZONES_SQL}) GROUP BY 1"),
    "zonemap_filter": (zonemap_filter, "SELECT event_id, user_id FROM events WHERE event_id > 9000"),
    "zonemap_stats": (zonemap_stats, f"WITH z AS (SELECT page_index, count(*) AS n, max(event_id) AS hi, count(*) FILTER (event_id > 9000) AS k FROM ({ZONES_SQL}) GROUP BY 1) SELECT count(*) AS pages_total, count(*) FILTER (hi <= 9000) AS pages_skipped, count(*) FILTER (hi > 9000) AS pages_scanned, CAST(coalesce(sum(n) FILTER (hi > 9000), 0) AS BIGINT) AS rows_scanned, CAST(coalesce(sum(k), 0) AS BIGINT) AS rows_kept FROM z"),
    "zonemap_stats_random": (zonemap_stats_random, f"WITH z AS (SELECT page_index, count(*) AS n, min(user_id) AS lo, max(user_id) AS hi, count(*) FILTER (user_id = 7) AS k FROM ({ZONES_SQL}) GROUP BY 1) SELECT count(*) AS pages_total, count(*) FILTER (NOT (lo <= 7 AND hi >= 7)) AS pages_skipped, count(*) FILTER (lo <= 7 AND hi >= 7) AS pages_scanned, CAST(coalesce(sum(n) FILTER (lo <= 7 AND hi >= 7), 0) AS BIGINT) AS rows_scanned, CAST(coalesce(sum(k), 0) AS BIGINT) AS rows_kept FROM z"),
    "page_stream_stats": (page_stream_stats, f"SELECT count(DISTINCT page_index) AS pages, count(*) AS row_count, count(*) FILTER (user_id > 21) AS rows_kept, CAST(coalesce(sum(user_id * 2) FILTER (user_id > 21), 0) AS BIGINT) AS products FROM ({ZONES_SQL})"),
    "page_table_stream": (page_table_stream, "SELECT event_id FROM events WHERE user_id > 21 ORDER BY event_id LIMIT 1000"),
    "group_stats": (group_stats, 'SELECT o_custkey AS key, count(*) AS count, CAST(sum(o_custkey) AS BIGINT) AS sum, min(o_custkey) AS min, max(o_custkey) AS max FROM orders GROUP BY 1'),
    "csv_roundtrip": (csv_roundtrip, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"),
    "demo_users": (demo_users, _values(USERS_ROWS, '"அடையாளம்", "பெயர்", "வயது"')),
    "demo_join": (demo_join, _values(DOUBLED, '"பெயர்", "புதிய_விலை"')),
    "duplicate_prices": (duplicate_prices, _values([(100, 3), (250, 4), (500, 1)], '"விலை", "எண்ணிக்கை"')),
    "checked_query": (checked_query, "SELECT n_name, CAST(0 AS BIGINT) AS pages_total, CAST(0 AS BIGINT) AS pages_skipped, CAST(0 AS BIGINT) AS pages_scanned, CAST(0 AS BIGINT) AS rows_scanned, CAST(0 AS BIGINT) AS rows_kept FROM nation WHERE n_nationkey > 10"),
    "snapshot_scan": (snapshot_scan, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 700"),
    "page_cursor": (page_cursor, f"SELECT event_id FROM ({ZONES_SQL}) WHERE page_index IN (1, 3)"),
    "stream_values": (stream_values, "SELECT user_id AS stream FROM events WHERE user_id > 21"),
    "zonemap_stored": (zonemap_stored, "SELECT event_id, user_id FROM events WHERE event_id < 700"),
    "append_stream": (append_stream, "SELECT o_orderkey * 2 AS x, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey > 300"),
    "tsv_result": (tsv_result, "SELECT n_nationkey || chr(9) || n_name || chr(9) || n_nationkey AS line FROM nation"),
    "query_errors": (query_errors, _values(ERRORS, "name, error")),
    "ingest_errors": (ingest_errors, _values([(k, e, n) for k, (_, _, e, n) in BAD_FILES.items()], "name, error, line")),
    "csv_rules": (csv_rules, _values([(1, "hello, world"), (2, 'she said "hi"'), (-3, "ab "), (4, ""), (5, 'x"y'), (6, "end\r")], "id, note")),
    "columnar_demo": (columnar_demo, "SELECT i % 16 AS user_ids, 18 + i % 40 AS ages, 100 + 3 * i AS prices FROM range(10000) t(i) WHERE 18 + i % 40 > 21"),
}


def _run(pipeline: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: planner.run(spark, catalog.test_tables(spark, sf_dir), pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(pipeline) for name, (pipeline, _) in PIPELINES.items()} | {name: f for name, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (PIPELINES | OTHERS).items()}
