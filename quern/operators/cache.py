"""A cache of results by query, as Parquet with a time to live."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.sources import store


class ResultCache:
    """Keys belong to an index; a later ``put`` replaces an earlier one; a time to live of 0 never ends."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock

    def _path(self, index: str, key) -> str:
        text = json.dumps([index, key], sort_keys=True, ensure_ascii=False)
        return f"{self.folder}/{hashlib.sha256(text.encode()).hexdigest()}"

    def put(self, index: str, key, rows: DataFrame, ttl: float = 0) -> None:
        path = self._path(index, key)
        store.write(rows, f"{path}/rows")
        store.write_text(self.spark, f"{path}/entry.json", json.dumps({"set": self.clock(), "ttl": ttl}))

    def get(self, index: str, key) -> DataFrame | None:
        """The rows, or None if there are none or their time is over (they are then deleted)."""
        path = self._path(index, key)
        text = store.read_text(self.spark, f"{path}/entry.json")
        if text is None:
            return None
        entry = json.loads(text)
        if entry["ttl"] > 0 and self.clock() - entry["set"] > entry["ttl"]:
            store.delete(self.spark, path)
            return None
        return self.spark.read.parquet(f"{path}/rows")

    def clear(self) -> None:
        store.delete(self.spark, self.folder)
