"""Files in the shared folder, through Spark's own file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def work_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one of our own only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = getattr(spark, "_quern_folder", None) or tempfile.mkdtemp(prefix="quern-")
        spark._quern_folder = path
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def write(rows: DataFrame, path: str) -> None:
    """Replaces the folder with the rows, by a rename after all tasks are done."""
    spark = rows.sparkSession
    aside = f"{path}-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    p, fs = _fs(spark, path)
    fs.delete(p, True)
    fs.mkdirs(p.getParent())
    fs.rename(_fs(spark, aside)[0], p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces the file by one rename, so that a writer that dies leaves the old text or the new one."""
    p, fs = _fs(spark, path)
    aside, _ = _fs(spark, f"{path}-{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    uri = fs.makeQualified(p)
    context = hadoop.FileContext.getFileContext(uri.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(aside), uri, options)


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
