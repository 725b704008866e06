"""Zone maps: least and greatest value of each page of a column, and filters that skip pages by them.

A page is `page_rows` consecutive rows of one file. The map says which files can have a match, and Spark lists only these; within a
file, the filter goes to the Parquet reader, which skips row groups and, in tables that `store` wrote, the very pages of the map by the column index.
Statistics come from the map, the files' footers and the pruned scan of matches: no page that the map rules out is read for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PageCorrupt, ZoneMapError

PAGE_ROWS = 512
SCHEMA = "file string, page_index long, row_count long, min long, max long"
#: Up to so many files are listed by name; with more, the reader's own statistics do the skipping.
LISTED = 10_000


def _paged(df: DataFrame, columns: list[str], page_rows: int) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) for c in columns], F.col("_metadata.file_path").alias("file"), F.expr(f"_metadata.row_index div {page_rows}").alias("page_index"))


def build(df: DataFrame, column: str, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(file, page_index, row_count, min, max) of a table of files."""
    rows = _paged(df, [column], page_rows)
    return rows.groupBy("file", "page_index").agg(F.count(F.lit(1)).alias("row_count"), F.min(column).alias("min"), F.max(column).alias("max"))


def store(df: DataFrame, path: str, page_rows: int = PAGE_ROWS, rows_per_group: int = 1 << 20) -> DataFrame:
    """Write a table whose Parquet pages are the pages of a map, and read it again."""
    out = df.write.mode("overwrite").option("parquet.page.row.count.limit", page_rows).option("parquet.page.size.row.check.min", page_rows)
    out.option("parquet.block.row.count.limit", rows_per_group).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save(zones: DataFrame, path: str) -> None:
    zones.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """A saved map, or None if there is none."""
    try:
        zones = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise ZoneMapError(str(e)) from e
    missing = {x.split()[0] for x in SCHEMA.split(", ")} - set(zones.columns)
    if missing:
        raise ZoneMapError(f"no columns {sorted(missing)}")
    return zones


def page_may_match(op: str, literal: int) -> Column:
    """Whether a page can have a row that matches."""
    lit = F.lit(literal).cast("long")
    if op == ">":
        return F.col("max") > lit
    if op == "<":
        return F.col("min") < lit
    return (F.col("min") <= lit) & (F.col("max") >= lit)


def _matches(column: str, op: str, literal: int) -> Column:
    # without a cast, so that the reader gets it
    c, lit = F.col(column), F.lit(literal)
    return c > lit if op == ">" else c < lit if op == "<" else c == lit


@dataclass
class Pushdown:
    rows: DataFrame
    #: One row: pages_total, pages_skipped, pages_scanned, rows_scanned, rows_kept.
    stats: DataFrame


def _pruned(df: DataFrame, column: str, op: str, literal: int, zones: DataFrame | None) -> DataFrame:
    """Rows that match, from files that the map doesn't rule out. A file that the map lacks is read."""
    rows = df.filter(_matches(column, op, literal))
    if zones is None or len(df.inputFiles()) < 2:
        return rows
    files = zones.groupBy("file").agg(F.max(page_may_match(op, literal)).alias("open")).filter("not open").limit(LISTED + 1).collect()
    return rows if not files or len(files) > LISTED else rows.filter(~F.col("_metadata.file_path").isin([r["file"] for r in files]))


def filter_pages(df: DataFrame, column: str, op: str, literal: int, zones: DataFrame | None = None, others: list[str] | None = None, page_rows: int = PAGE_ROWS) -> Pushdown:
    """The rows that match, without pages that the map rules out. A page that the map lacks is scanned."""
    columns = list(dict.fromkeys([column, *(others or [])]))
    matches = _pruned(df, column, op, literal, zones)
    # counts of files come from their footers; files of the map that the table lacks don't count
    long = lambda v: F.lit(v).cast("long")
    known = df.select(F.col("_metadata.file_path").alias("file"), long(1).alias("rows"), long(0).alias("pages"), long(0).alias("skipped"))
    if zones is not None:
        out = zones.filter(~page_may_match(op, literal)).select("file", long(0).alias("rows"), long(1).alias("pages"), F.col("row_count").alias("skipped"))
        known = known.unionByName(out)
    files = known.groupBy("file").agg(*[F.sum(c).alias(c) for c in ("rows", "pages", "skipped")]).filter("rows > 0")
    sums = files.agg(
        F.coalesce(F.sum(F.ceil(F.col("rows") / page_rows)), long(0)).alias("pages_total"),
        F.coalesce(F.sum("pages"), long(0)).alias("pages_skipped"),
        F.coalesce(F.sum(F.col("rows") - F.col("skipped")), long(0)).alias("rows_scanned"),
    )
    # one row each, added up
    kept = matches.agg(F.count(F.lit(1)).alias("rows_kept"))
    names = ["pages_total", "pages_skipped", "rows_scanned", "rows_kept"]
    either = sums.withColumn("rows_kept", F.lit(0).cast("long")).select(names).unionByName(kept.select(*[F.lit(0).cast("long").alias(n) for n in names[:-1]], "rows_kept"))
    total = either.agg(*[F.sum(n).alias(n) for n in names])
    stats = total.select("pages_total", "pages_skipped", (F.col("pages_total") - F.col("pages_skipped")).alias("pages_scanned"), "rows_scanned", "rows_kept")
    return Pushdown(matches.select(*[F.col(c).cast("long").alias(c) for c in columns]), stats)


def check(df: DataFrame, column: str, zones: DataFrame, page_rows: int = PAGE_ROWS) -> None:
    """Raise PageCorrupt for the first page whose rows aren't what the map says, or that only one of both has."""
    at = ["file", "page_index"]
    now = build(df, column, page_rows).select(*at, F.struct("row_count", "min", "max").alias("now"))
    then = zones.select(*at, F.struct("row_count", "min", "max").alias("then"))
    odd = now.join(then, at, "full").filter(~F.col("now").eqNullSafe(F.col("then"))).orderBy(*at).limit(1).collect()
    if odd:
        raise PageCorrupt(odd[0]["page_index"])


class PageCursor:
    """The pages of a table one after the other, each as a frame; a page that is skipped isn't read."""

    def __init__(self, df: DataFrame, page_rows: int = PAGE_ROWS):
        self.df, self.page_rows = df, page_rows
        counts = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")).orderBy("file").collect()
        self.pages = [(r["file"], k) for r in counts for k in range(-(-r["n"] // page_rows))]
        self.pages_emitted = 0

    def next(self) -> DataFrame | None:
        """The next page, or None after the last one."""
        if self.pages_emitted >= len(self.pages):
            return None
        file, page = self.pages[self.pages_emitted]
        self.pages_emitted += 1
        row = F.col("_metadata.row_index")
        return self.df.filter((F.col("_metadata.file_path") == file) & (row >= page * self.page_rows) & (row < (page + 1) * self.page_rows))

    def skip(self) -> bool:
        """Pass over the next page; False after the last one."""
        self.pages_emitted += self.pages_emitted < len(self.pages)
        return self.pages_emitted < len(self.pages)

    def rewind(self) -> None:
        self.pages_emitted = 0


def execute_streaming(df: DataFrame, column: str, literal: int = 21, rows: int | None = None, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The values of a column over the literal, as `stream`. With `rows`, the table must have so many: PageCorrupt names the first page that is short."""
    if rows is not None:
        found = df.count()
        if found != rows:
            raise PageCorrupt(min(found, rows) // page_rows)
    return df.filter(_matches(column, ">", literal)).select(F.col(column).cast("long").alias("stream"))


def filter_stream(df: DataFrame, column: str, literal: int, factor: int, page_rows: int = PAGE_ROWS) -> DataFrame:
    """One row of what a filter and product over all pages saw: pages, rows, rows kept and the sum of the products."""
    made = _paged(df, [column], page_rows).select("file", "page_index", F.when(F.col(column) > literal, F.col(column) * factor).alias("product"))
    per_page = made.groupBy("file", "page_index").agg(F.count(F.lit(1)).alias("n"), F.count("product").alias("k"), F.sum("product").alias("p"))
    return per_page.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("k"), F.lit(0)).alias("rows_kept"), F.coalesce(F.sum("p"), F.lit(0)).alias("products"))


def table_filter_project(df: DataFrame, column: str, literal: int, out: str, capacity: int | None = None) -> DataFrame:
    """`out` of the rows whose `column` is over the literal, in file order up to a capacity."""
    rows = df.filter(F.col(column) > literal)
    if capacity is not None:
        rows = rows.orderBy(F.col("_metadata.file_path"), F.col("_metadata.row_index")).limit(capacity)
    return rows.select(F.col(out).cast("long").alias(out))
