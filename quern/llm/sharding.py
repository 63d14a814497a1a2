"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards.  Shards are grouped in tiers
by size (each tier ``FAN_IN`` times the one below); while a tier holds
``FAN_IN`` shards or more, runs of them are merged into one of up to
``TARGET_BYTES``.  Each append and each round of merges is one new version of
the manifest.

Commits.  The manifest itself is the claim: ``manifest-<version>.json`` is
created without overwriting and ends with the checksum of what is before it.
Whoever comes second to a version reads on top of it and tries the next one.
A manifest without its checksum is no version: its writer is at work or dead,
and after ``LEASE_SECONDS`` the next writer removes it and takes the version.
A writer reads its manifest back, so that one who was taken for dead learns of
it.  This needs a file system on which creating without overwriting is
exclusive (HDFS, object stores with conditional writes, one local disk).

Readers see one version or another and nothing between.  Compaction deletes
nothing: versions stay readable until :meth:`ShardedTable.vacuum`, which keeps
the newest ones and all younger than an age, and removes shards that no kept
manifest names (those of lost or repeated attempts too) once they are that old.

A merge copies row groups from files to a file inside one task; nothing is
shuffled, and a task reads at most what its output holds.  The driver handles
names and sizes only.

Defined results: rows are kept as they are (nulls, repeated rows, all columns,
those with clashing names as the Parquet files have them); arrivals may have
other columns: shards are merged with those of their own schema only, and
reading takes all columns, null where a shard lacks one (types that differ are
Spark's error when read); ties in size are broken by name; an empty arrival
commits a version without new shards.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quern.llm import scratch
from quern.llm import textnp as T
from quern.llm.tokenids import file_system

ARRIVAL_BYTES = 8 << 20
TARGET_BYTES = 128 << 20
FAN_IN = 4
FULL = 0.5
LEASE_SECONDS = 60.0
#: What :meth:`ShardedTable.vacuum` keeps unless told otherwise.
KEEP_VERSIONS = 3
KEEP_SECONDS = 7 * 86400.0


@dataclass(frozen=True)
class Entry:
    name: str
    rows: int
    size: int
    schema: str = ""


class Conflict(RuntimeError):
    """Another writer committed this version first, or merged the same shards."""


class ShardedTable:
    """A folder of immutable Parquet shards and versioned manifests."""

    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET_BYTES, arrival: int = ARRIVAL_BYTES, fan_in: int = FAN_IN, lease: float = LEASE_SECONDS):
        self.spark, self.folder, self.target, self.arrival, self.fan_in, self.lease = spark, scratch.qualified(spark, folder), target, arrival, fan_in, lease
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    # ---------------------------------------------------------------- manifests

    def _manifest_path(self, version: int):
        return self._path(f"{self.folder}/manifest-{version:010d}.json")

    def versions(self) -> list[int]:
        """The numbers of all manifests, newest first, whole or not."""
        found = self._fs.globStatus(self._path(f"{self.folder}/manifest-*.json")) or []
        return sorted((int(s.getPath().getName()[9:-5]) for s in found), reverse=True)

    def _load(self, version: int) -> dict | None:
        """The manifest of a version; None where it isn't there or isn't whole."""
        path = self._manifest_path(version)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        body, _, check = raw.rpartition("\n")
        return json.loads(body) if body and hashlib.sha256(body.encode()).hexdigest() == check else None

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return next((v for v in self.versions() if self._load(v)), 0)

    def manifest(self, version: int | None = None) -> list[Entry]:
        version = self.version() if version is None else version
        if not version:
            return []
        found = self._load(version)
        if found is None:
            raise FileNotFoundError(f"no version {version} in {self.folder}")
        return [Entry(**e) for e in found["shards"]]

    def commit(self, version: int, shards: list[Entry]) -> None:
        """Creates the manifest of a version, which must not exist."""
        path, writer = self._manifest_path(version), uuid.uuid4().hex
        body = json.dumps({"version": version, "writer": writer, "shards": [asdict(s) for s in shards]})
        if self._fs.exists(path):
            if self._load(version) or time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000 < self.lease:
                raise Conflict(f"version {version} is taken")
            self._fs.delete(path, False)
        try:
            stream = self._fs.create(path, False)
            stream.write(bytearray(f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}".encode()))
            stream.close()
        except Py4JJavaError as e:
            raise Conflict(f"version {version} is taken") from e
        found = self._load(version)
        if found is None or found["writer"] != writer:
            raise Conflict(f"version {version} was taken over")

    def change(self, added: list[Entry], removed: list[Entry]) -> int:
        """Commits on top of whatever is newest by then; the new version."""
        gone, until = {e.name for e in removed}, time.time() + 3 * self.lease + 60
        while True:
            base = self.version()
            now = self.manifest(base)
            if not gone <= {e.name for e in now}:
                raise Conflict("another writer merged these shards")
            try:
                self.commit(base + 1, [e for e in now if e.name not in gone] + sorted(added, key=lambda e: e.name))
                return base + 1
            except Conflict:
                if time.time() > until:
                    raise
                time.sleep(random.uniform(0.05, 0.5))

    # ---------------------------------------------------------------- writing

    def append(self, rows: DataFrame) -> int:
        """Adds an arrival as small shards and returns the new version."""
        folder, limit, schema = self.folder, self.arrival, to_arrow_schema(rows.schema)
        mark = hashlib.md5(str(schema).encode()).hexdigest()[:12]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, at = file_system(folder)
            shard, done = None, []
            for batch in batches:
                if batch.num_rows:
                    shard = shard or _Shard(fs, at, schema)
                    if shard.add(pa.Table.from_batches([batch]).rename_columns(schema.names).cast(schema)) >= limit:
                        done.append(shard.close())
                        shard = None
            if shard:
                done.append(shard.close())
            yield _entries(done)

        return self.change([Entry(r["name"], r["rows"], r["size"], mark) for r in T.plain_names(rows).mapInArrow(run, _ENTRY).collect()], [])

    def tier(self, size: int) -> int:
        t, bound = 0, max(1, self.arrival // 2)
        while size >= bound * self.fan_in:
            t, bound = t + 1, bound * self.fan_in
        return t

    def plan(self, shards: list[Entry]) -> list[list[Entry]]:
        """Groups to merge: similarly sized shards of one schema, FAN_IN at least, up to the target size."""
        tiers: dict[tuple[str, int], list[Entry]] = {}
        for s in shards:
            if s.size < self.target * FULL:
                tiers.setdefault((s.schema, self.tier(s.size)), []).append(s)
        groups = []
        for _, members in sorted(tiers.items()):
            run: list[Entry] = []
            runs = []
            for s in sorted(members, key=lambda e: (-e.size, e.name)):
                if run and sum(e.size for e in run) + s.size > self.target:
                    runs.append(run)
                    run = []
                run.append(s)
            runs.append(run)
            groups += [r for r in runs if len(r) >= self.fan_in or len(r) > 1 and sum(e.size for e in r) >= self.target * FULL]
        return groups

    def compact(self) -> int:
        """Merges until no tier is full; returns the newest version."""
        while groups := self.plan(self.manifest(version := self.version())):
            folder = self.folder

            def run(batches: Iterator[pa.RecordBatch], folder=folder) -> Iterator[pa.RecordBatch]:
                fs, at = file_system(folder)
                for batch in batches:
                    for group, names in zip(batch.column("i").to_pylist(), batch.column("names").to_pylist(), strict=True):
                        shard = None
                        for source in names:
                            with fs.open_input_file(f"{at}/{source}") as f:
                                file = pq.ParquetFile(f)
                                for g in range(file.num_row_groups):
                                    table = file.read_row_group(g)
                                    shard = shard or _Shard(fs, at, table.schema)
                                    shard.add(table)
                        yield _entries([shard.close()], group)

            tasks = self.spark.createDataFrame([(i, [e.name for e in g]) for i, g in enumerate(groups)], "i int, names array<string>").repartitionByRange(len(groups), "i")
            merged = [Entry(r["name"], r["rows"], r["size"], groups[r["part"]][0].schema) for r in tasks.mapInArrow(run, _ENTRY).collect()]
            try:
                self.change(merged, [e for g in groups for e in g])
            except Conflict:
                # another compaction was first: its result is planned on; our files are orphans
                if self.version() == version:
                    raise
        return version

    def vacuum(self, keep: int = KEEP_VERSIONS, seconds: float = KEEP_SECONDS) -> int:
        """Deletes manifests but the newest ``keep`` and those younger than ``seconds``, and shards of that age that no manifest left names; how many shards."""
        old = lambda status: time.time() - status.getModificationTime() / 1000 >= seconds
        whole = [v for v in self.versions() if self._load(v)]
        left = {v for v in whole if v in whole[: max(1, keep)] or not old(self._fs.getFileStatus(self._manifest_path(v)))}
        named = {e.name for v in left for e in self.manifest(v)}
        for v in whole:
            if v not in left:
                self._fs.delete(self._manifest_path(v), False)
        n = 0
        for status in self._fs.globStatus(self._path(f"{self.folder}/shard-*.parquet")) or []:
            if status.getPath().getName() not in named and old(status):
                self._fs.delete(status.getPath(), False)
                n += 1
        return n

    # ---------------------------------------------------------------- reading

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, with its shards' names as ``_metadata.file_name``; None without shards."""
        shards = self.manifest(version)
        many = len({e.schema for e in shards}) > 1
        return self.spark.read.option("mergeSchema", many).parquet(*(f"{self.folder}/{e.name}" for e in shards)) if shards else None


_ENTRY = "name string, rows long, size long, part int"


def _entries(rows: list[tuple[str, int, int]], part: int = 0) -> pa.RecordBatch:
    return pa.record_batch({"name": pa.array([r[0] for r in rows], pa.string()), "rows": pa.array([r[1] for r in rows], pa.int64()), "size": pa.array([r[2] for r in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int32())})


class _Shard:
    """A file that is being written; sizes are those of the stream, as a file in the making has none on object stores."""

    def __init__(self, fs, folder: str, schema: pa.Schema):
        self.name, self.rows = f"shard-{uuid.uuid4().hex}.parquet", 0
        self.sink = fs.open_output_stream(f"{folder}/{self.name}")
        self.writer = pq.ParquetWriter(self.sink, schema, compression="zstd", use_dictionary=[f.name for f in schema if f.name in ("lang", "source")])

    def add(self, table: pa.Table) -> int:
        self.writer.write_table(table)
        self.rows += table.num_rows
        return self.sink.tell()

    def close(self) -> tuple[str, int, int]:
        self.writer.close()
        size = self.sink.tell()
        self.sink.close()
        return self.name, self.rows, size


def shard_documents(spark: SparkSession, docs: DataFrame, folder: str, target: int = TARGET_BYTES, arrival: int = ARRIVAL_BYTES) -> DataFrame:
    """Appends and compacts docs; doc_id, shard, place (row in the shard) of every row, read through the manifest."""
    table = ShardedTable(spark, folder, target, arrival)
    table.append(docs)
    rows = table.read(table.compact())
    if rows is None:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, shard string, place long")
    return rows.select("doc_id", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("place"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "shards")
    out = shard_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    # nobody else reads this table: what was merged away can go at once
    ShardedTable(spark, folder).vacuum(1, 0)
    return out
