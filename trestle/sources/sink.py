"""Results as lines of tab-separated values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tsv_lines(df: DataFrame) -> DataFrame:
    """(line) for each row, in its order: nulls are empty, and a boolean is a question mark."""
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    text = [F.lit("?") if isinstance(f.dataType, T.BooleanType) else F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in inner.schema.fields]
    return inner.select(F.array_join(F.array(*text), "\t").alias("line")) if text else df.select(F.lit("").alias("line"))


def header(df: DataFrame) -> str:
    return "\t".join(df.columns)
