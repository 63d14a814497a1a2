"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Defined results: null and empty texts pass all stages (null ones come out with
null tokens); rows without doc_id are kept, unless their text is toxic or
contaminated; of several rows with one doc_id, one stays after the
near-duplicate stage; extra columns, whatever their names, are carried up to
the last stage, which returns its own; an empty table gives an empty result.
Stage tables are deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontaminate, scratch, secrets, simhash, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; the others stay as they are."""
    return toxicity.filter_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (doc_id, n_bytes, n_tokens, tokens, round_trip)."""
    return bpe.encode_documents(docs)


STAGES = [("toxicity", toxic), ("simhash", near_duplicates), ("decontamination", decontaminated), ("secrets", without_secrets), ("bpe", tokens)]

#: Learnt lexicons, fingerprints and BPE are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, of the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = scratch.Tables(spark)
    for name, stage in STAGES:
        docs = tables.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        tables.clear(1)
    return docs
