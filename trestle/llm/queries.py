"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, nearjoin, oracles, packing, pages, quality, quotations, secretscan, shared, substring, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out()))
    out = language.predict(docs, model)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "position")


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link(_table(spark, sf_dir, "conversations"))


def op8_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.conversations(quotations.link(_table(spark, sf_dir, "conversations")))


def _base_spans() -> list:
    count = lambda rank: F.size(F.filter("secrets", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    return [count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secretscan.listing(base), 256).alias("base_sha256")]


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    return found.select("doc_id", *_base_spans(), secretscan.listing(F.col("secrets")).alias("spans"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of query 3 SQL can express: the fixed patterns."""
    return op3_secrets(spark, sf_dir).drop("spans")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.kept_words(substring.repeated(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.classes(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")).drop("text")
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of query 10 SQL can express: the statistics and the fixed rules."""
    return quality.statistics(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text").withColumn("base_failed", quality.base_failed())


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared.ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in (op1_pack, op2_language, op3_secrets, op4_html, op5_substring, op6_warc, op7_near, op8_quotations, op8_replies, op9_decontaminate, op10_quality, secrets_base, quality_base)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
