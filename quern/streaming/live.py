"""Indexing of a stream, and live statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.sources.index import Index


def index_stream(rows: DataFrame, index: Index, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Adds each micro-batch to the index and builds its postings.

    A batch that runs again after a failure adds nothing twice: keys that are
    stored already are left out.
    """

    def batch(part: DataFrame, _: int) -> None:
        index.add(part)
        index.build()

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def term_counts(log: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """start, term, n of a stream of (ts, term), with a watermark for late rows."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "term").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "term", "n")
