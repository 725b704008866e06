"""python -m trestle.cli query [PIPELINE] [--tables DIR] | ingest FILE --schema SPEC --out DIR [--no-header]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import errors as E
from .operators import zonemap
from .plans import planner
from .sources import catalog, ingest, sink

DEMO = "இருந்து பயனர்கள் | வடி வயது > 21 | அடுக்கு வயது | எடு 10 | தேடு பெயர், வயது;"


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="trestle")
    commands = top.add_subparsers(dest="command", required=True)
    q = commands.add_parser("query")
    q.add_argument("pipeline", nargs="?", default=DEMO)
    q.add_argument("--tables", help="folder of Parquet tables; the demo tables if left out")
    i = commands.add_parser("ingest")
    i.add_argument("file")
    i.add_argument("--schema", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--no-header", action="store_true")
    a = top.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    try:
        if a.command == "query":
            tables = catalog.test_tables(spark, a.tables) if a.tables else catalog.demo_catalog(spark)
            df = planner.run(spark, tables, a.pipeline)
            print(sink.header(df))
            for row in sink.tsv_lines(df).toLocalIterator():
                print(row[0])
        else:
            n = ingest.ingest_csv(spark, a.file, a.schema, a.out, not a.no_header)
            print(f"{n} rows")
            table = spark.read.parquet(a.out)
            for name, kind in ingest.parse_schema(a.schema):
                if kind == "long":
                    try:
                        zonemap.save(zonemap.build(table, name), f"{a.out}.zmap/{name}")
                    except Exception as e:  # a missing map only makes filters slower
                        print(f"warning: no zone map for {name}: {e}", file=sys.stderr)
    except E.TrestleError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
