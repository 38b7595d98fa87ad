"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, encoding.

Each stage works on all rows its predecessor kept and is written as Parquet before the next one reads it.
Stages keep the columns of ``documents``; the last one returns the encoded documents.

Rows without an id can't be told apart and pass the near-duplicate stage. Of rows that share an id and a text one stays there.
A document whose words are all removed as repeats goes; one that the mix takes several times is in the result as often.
Tables may have more columns, whatever their names; all stages but the last keep them. An empty table gives an empty result. A stage deletes
what its predecessors left in the shared folder, as their results are written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terraframe.llm.common import cleanup, free, fresh, quoted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    from terraframe.llm.quality_rules import judge

    cleanup(spark)
    rules = free(docs.columns, "rules")
    return judge(docs, into=rules).filter(F.col(rules)["kept"]).select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of SimHash near-duplicates.

    By the law of op10: fingerprints of three-word shingles within two bits. Most near copies at a similarity of 0.8 are further apart (README).
    Different texts that share the smallest id stay, each once; of equal texts with that id the one with the smallest other columns.
    """
    from terraframe.llm import simhash

    cleanup(spark)
    row = free(docs.columns, "row")
    first = simhash.near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = docs.join(first, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*map(quoted, rest))).alias(row))
    return one.select(*[F.col(quoted(c)) if c in ("doc_id", "text") else F.col(row)[c].alias(c) for c in docs.columns]).union(docs.filter("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that started earlier."""
    from terraframe.llm.substring_dedup import deduplicate

    cleanup(spark)
    found = free(docs.columns, "found")
    left = deduplicate(docs, texts=True, into=found).filter((F.col(found)["n_words"] == 0) | (F.col(found)["n_removed"] < F.col(found)["n_words"]))
    cut = F.when(F.col(found)["n_removed"] > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return left.select(*[cut if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    from terraframe.llm.mixing import mix

    cleanup(spark)
    mixed = mix(docs, keep=docs.columns).select("kept", F.explode("passes"))
    return mixed.select(*[F.col("kept")[c].alias(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' SentencePiece ids, and whether they decode to the text."""
    from terraframe.llm.sentencepiece_lattice import encode, load_model

    cleanup(spark)
    out = encode(docs.select("doc_id", "source", "lang", "text"), load_model(spark), decode_to="decoded")
    return out.select("doc_id", "source", "lang", "tokens", F.expr("octet_length(tokens) div 4").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("sentencepiece", encoded),
]

#: Fingerprints, encoded pieces and the fingerprint index have no SQL equivalent; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
