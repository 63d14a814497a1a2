"""Shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one of our own only where that is unset and all tasks run in this process (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quern-")
        sc.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, so that Spark, its file systems and Arrow in the workers mean one place."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


class Tables:
    """Tables that an operator writes on its way; ``clear`` deletes them once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """The rows, written as Parquet in the shared folder and read again."""
        path = new_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, but: int = 0) -> None:
        """Deletes all tables but the newest ``but``."""
        gone, self.paths = self.paths[: len(self.paths) - but], self.paths[len(self.paths) - but :]
        for path in gone:
            delete(self.spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again; the table stays."""
    return Tables(df.sparkSession).written(df, name)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
