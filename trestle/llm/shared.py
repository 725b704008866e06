"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import folders

#: Bytes of an Arrow batch between the JVM and a Python worker, unless the session or the cluster sets it.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

_made: list[tuple[SparkSession, str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def new_path(spark: SparkSession, name: str) -> str:
    if not _made:
        atexit.register(_clean)
    path = folders.new_path(spark, name)
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    fs, p = folders.file_system(spark, path)
    fs.delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session has ended: what is left goes with the folder
            return


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return it reread: its lineage is cut and it outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that `table` returned; nothing made of it may be read any more."""
    path = _paths.pop(df, None)
    if path is not None:
        delete(df.sparkSession, path)


def scan_bytes(df: DataFrame) -> int:
    """Bytes of the leaves below df: what its plan reads, before filters and projections."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once for each application; each session gets small Arrow batches."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    folders.ship(spark)


def greatest_before(rows: DataFrame, keys: list[str], at: str, value: Column, name: str, stretch: int) -> DataFrame:
    """rows with the greatest `value` of rows of equal keys whose `at`, a number, is smaller; null if there is none.

    Rows of equal keys are dealt by stretches of `at`, so very many of them don't meet in one task: within a stretch a window looks back,
    and what the stretches before it have goes along one small row for each stretch.
    """
    dealt = rows.withColumn("__v", value).withColumn("__s", F.floor(F.col(at) / stretch))
    inside = Window.partitionBy(*keys, "__s").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy(*keys, "__s").agg(F.max("__v").alias("__t"))
    behind = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__b", F.max("__t").over(behind)).drop("__t")
    found = dealt.withColumn("__i", F.max("__v").over(inside)).join(tops, [*keys, "__s"])
    return found.withColumn(name, F.greatest("__i", "__b")).select(*rows.columns, name)
