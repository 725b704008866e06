"""A pipeline over documents: quality rules, near-duplicate join, decontamination, secret scans, packing.

Each stage works on all that its predecessor kept; all but the last return the columns of documents. Stages are written
as Parquet to the shared folder and read again, so each is a restart point and no stage's lineage reaches into another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.llm import decontaminate, nearjoin, packing, quality, secretscan, shared
from trestle.llm.queries import tokenizer_path

#: Near duplicates share shingles of so many words at so many per cent; query 7's contract, four words and 85, is its own.
WIDTH, PERCENT = 5, 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the robust distance reject go. Each row is carried through its verdict, so null or repeated ids stay as they are and no text is shuffled."""
    shared.ship(spark)
    kept = quality.judge(docs, keep=COLUMNS).filter("kept")
    return kept.select(*[F.col(f"in_{c}").alias(c) for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked rows, one row with the least doc_id stays, a null one only if there are no others.

    Rows are told apart by a number, so those that share a doc_id are linked by their texts alone. Documents without words stay.
    """
    shared.ship(spark)
    rows = shared.table(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")), "rows")
    found = nearjoin.classes(rows.select(F.col("__row").alias("doc_id"), "text"), width=WIDTH, percent=PERCENT)
    found = found.withColumnRenamed("doc_id", "__row").join(rows.select("__row", "doc_id"), "__row")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("__row")).select("__row")
    return rows.join(first, "__row", "left_semi").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that was nothing else goes."""
    shared.ship(spark)
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.filter((F.size("spans") == 0) | (decontaminate.n_hit() < F.col("n_words")))
    cut = decontaminate.remove_spans(found)
    return cut.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    found = secretscan.scan(docs)
    text = secretscan.redacted(F.col("text"), F.col("secrets"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size("secrets") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences, with a checksum of their ids."""
    shared.ship(spark)
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scans", secret_scans), ("packing", pack)]

#: Packing, robust estimates and entropy windows aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
