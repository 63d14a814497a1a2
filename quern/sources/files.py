"""Readers of the text formats that an index lives with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: each line without its end and without a byte order mark."""
    return spark.read.text(path).select(F.regexp_replace("value", "^﻿|\r$", "").alias("value"))


def words(spark: SparkSession, path: str) -> DataFrame:
    """word: one a line, blank lines skipped (dictionaries, stop words, sensitive words)."""
    return lines(spark, path).select(F.trim("value").alias("word")).where("word <> ''")


def dictionary(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """word, idf (5 where none is given)."""
    parts = F.split("word", sep)
    return words(spark, path).select(parts[0].alias("word"), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(5.0)).alias("idf"))


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """group_id, term: a group a line, terms parted by ``-`` or a bar."""
    rows = words(spark, path).select(F.xxhash64("word").alias("group_id"), F.explode(F.split("word", r"[-|]")).alias("term"))
    return rows.select("group_id", F.trim("term").alias("term")).where("term <> ''").distinct()


def term_log(spark: SparkSession, path: str) -> DataFrame:
    """day, term: search terms, one a line, in folders ``Y/Y-m/Y-m-d``."""
    day = F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}-\d{2}-\d{2})/[^/]*$", 1))
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    return raw.select(day.alias("day"), F.trim(F.regexp_replace("value", "\r$", "")).alias("term")).where("term <> ''")
