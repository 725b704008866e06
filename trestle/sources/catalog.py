"""Named tables of the pipeline language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFound
from . import folders

#: Names in the demo tables.
USERS, ORDERS, ID, NAME, AGE, PRICE = "பயனர்கள்", "ஆர்டர்கள்", "அடையாளம்", "பெயர்", "வயது", "விலை"


@dataclass
class Table:
    name: str
    df: DataFrame
    #: Columns that give the rows' order; None: position in the files, or for frames in memory their own order.
    order: list[str] | None = None

    def positions(self) -> list[Column]:
        if self.order is not None:
            return [F.col(c) for c in self.order]
        if self.df.inputFiles():
            return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
        return [F.monotonically_increasing_id()]


class Catalog:
    """The first table registered under a name wins; names are compared byte by byte.

    A table may be given by a function, which is called when a pipeline first names it: the others are never opened.
    """

    def __init__(self) -> None:
        self.tables: dict[str, Table | tuple[Callable[[], DataFrame], list[str] | None]] = {}

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame], order: list[str] | None = None) -> Catalog:
        self.tables.setdefault(name, Table(name, df, order) if isinstance(df, DataFrame) else (df, order))
        return self

    def register_snapshot(self, name: str, df: DataFrame) -> Catalog:
        """A copy of the table as it is now, which replaced or deleted files don't touch; rows keep their order."""
        return self.register(name, *snapshot(df))

    def __getitem__(self, name: str) -> Table:
        if name not in self.tables:
            raise ColumnNotFound(name)
        found = self.tables[name]
        if not isinstance(found, Table):
            found = self.tables[name] = Table(name, found[0](), found[1])
        return found


def snapshot(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """(copy of a table in the shared folder, the columns of the copy that give the rows' order)."""
    places = [c.alias(f"__order{i}") for i, c in enumerate(Table("", df).positions())]
    return folders.written(df.select("*", *places), "snapshot"), [f"__order{i}" for i in range(len(places))]


def widened(df: DataFrame) -> dict[str, tuple[Column, T.DataType]]:
    """First column of each name; whole numbers as bigint."""
    out: dict[str, tuple[Column, T.DataType]] = {}
    for f in df.schema.fields:
        small = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType))
        column = df[f"`{f.name}`"]
        out.setdefault(f.name, (column.cast("long"), T.LongType()) if small else (column, f.dataType))
    return out


def from_rows(spark: SparkSession, columns: dict[str, str], rows: list[tuple]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.LongType() if k == "long" else T.StringType()) for n, k in columns.items()])
    return spark.createDataFrame(rows, schema)


def demo_catalog(spark: SparkSession) -> Catalog:
    """Sixteen users and twelve orders."""
    # fixed values: the demo rows
    names = "அருண் பிரியா கண்ணன் லட்சுமி முருகன் கவிதா ராஜ் மீனா சுரேஷ் தீபா விஜய் அனிதா கோபால் சுமதி கார்த்திக் நந்தினி".split()
    ages = [18, 22, 19, 25, 30, 21, 27, 24, 17, 35, 28, 20, 23, 26, 31, 29]
    prices = [(1, 450), (3, 800), (4, 1200), (6, 350), (7, 600), (9, 900), (10, 500), (12, 700), (13, 550), (14, 1100), (15, 400), (0, 100)]
    users = from_rows(spark, {ID: "long", NAME: "string", AGE: "long"}, [(i, n, a) for i, (n, a) in enumerate(zip(names, ages, strict=True))])
    return Catalog().register(USERS, users).register(ORDERS, from_rows(spark, {ID: "long", PRICE: "long"}, prices))


def duplicate_price_catalog(spark: SparkSession) -> Catalog:
    # fixed values: the rows of the fixture
    rows = [(1, 100), (2, 250), (3, 100), (4, 250), (5, 100), (6, 250), (7, 500), (8, 250)]
    return Catalog().register(ORDERS, from_rows(spark, {ID: "long", PRICE: "long"}, rows))


def columnar_demo(spark: SparkSession, n: int) -> DataFrame:
    """Generated users: ids that repeat every 16 rows, ages from 18 to 57, rising prices."""
    i = F.col("id")
    return spark.range(n).select((i % 16).alias("user_ids"), (18 + i % 40).alias("ages"), (100 + 3 * i).alias("prices"))


def test_tables(spark: SparkSession, sf_dir: str) -> Catalog:
    """The star-schema tables under their own names, and users and orders made of customer and orders; each is opened when it is first named."""
    read = lambda name: lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    out = Catalog()
    for name in ("region", "nation", "orders", "lineitem", "customer", "events", "documents", "part", "supplier"):
        out.register(name, read(name))
    out.register(USERS, lambda: read("customer")().select(F.col("c_custkey").alias(ID), F.col("c_name").alias(NAME), F.col("c_nationkey").cast("long").alias(AGE)))
    out.register(ORDERS, lambda: read("orders")().select(F.col("o_custkey").alias(ID), F.floor("o_totalprice").cast("long").alias(PRICE), F.col("o_orderkey")), order=["o_orderkey"])
    return out
