"""Statistics of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_stats(df: DataFrame, key: str) -> DataFrame:
    """(key, count, sum, min, max) of the key's own values in each group."""
    k = F.col(key).cast("long")
    return df.select(k.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.sum("key").alias("sum"), F.min("key").alias("min"), F.max("key").alias("max"))
