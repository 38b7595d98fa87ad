"""The queries op1 to op10: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(_table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and SHA-256 of its ids (little-endian 32-bit numbers), and whether decoding them gives the text again."""
    from .sentencepiece_lattice import encode, load_model

    coded = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), load_model(spark), decode_to="decoded")
    n = F.expr("octet_length(tokens) div 4").cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import deduplicate

    return deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compression_classifier import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    return assign(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_sentencepiece, op3_quality_rules, op4_substring_dedup, op5_compression_classifier, op6_toxicity, op7_mixing, op8_embedding_dedup, op9_sharding, op10_simhash)
}
