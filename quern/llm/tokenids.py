"""Token ids in binary shards with Elias-Fano encoded document boundaries.

Each task writes shards of two files: ``ids-*.bin``, the concatenated token
ids (little endian, 2 bytes each where the vocabulary allows it, else 4), and
``docs-*.ef``, the document boundaries.  The boundaries are a non-decreasing
sequence: its low bits are packed, its high bits stand in unary, and a sampled
select structure finds the i-th boundary without a table of 64 bit offsets
(about 2 + log2(mean length) bits a document).

Files are written under names of their own per task attempt, and only names
that a finished task returns are part of the result, so a lost executor or a
second attempt can't damage a shard.  The driver gives the folder its scheme,
so that workers write where Spark reads; Arrow must know that file system.
What is returned is read back: each shard's boundaries are loaded from its
file, and the ids' file must have their size.

Defined results: null and empty texts are documents of 0 tokens (ties between
boundaries); null ids and repeated rows stay rows of their own; doc_id keeps
its type; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm import textnp as T
from quern.llm.bpe import VOCABULARY, Bpe

SHARD_TOKENS = 1 << 25
SAMPLE = 256
_HEAD = struct.Struct("<8sQQB7x")
_MAGIC = b"QEF00001"


class EliasFano:
    """Select over a non-decreasing sequence in near-minimal space."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high = n, universe, low_bits, low, high
        # ones before every SAMPLE-th byte; the samples are the select directory
        self.ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(np.bitwise_count(high), np.arange(0, len(high), SAMPLE), dtype=np.int64))]) if len(high) else np.zeros(1, np.int64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = np.zeros((n + (universe >> low_bits) + 8) // 8 if n else 0, np.uint8)
        if n:
            at = (values >> low_bits) + np.arange(n)
            np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
        low = np.packbits((values[:, None] >> np.arange(low_bits) & 1).astype(np.uint8).ravel(), bitorder="little") if n and low_bits else np.zeros(0, np.uint8)
        return cls(n, universe, low_bits, low, high)

    def select(self, i: int) -> int:
        """The i-th value (from 0)."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.ranks, i, "right")) - 1
        left = i - int(self.ranks[block])
        chunk = self.high[block * SAMPLE : (block + 1) * SAMPLE]
        ones = np.cumsum(np.bitwise_count(chunk), dtype=np.int64)
        byte = int(np.searchsorted(ones, left, "right"))
        left -= int(ones[byte - 1]) if byte else 0
        bits = np.flatnonzero(np.unpackbits(chunk[byte : byte + 1], bitorder="little"))
        place = (block * SAMPLE + byte) * 8 + int(bits[left])
        return (place - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a = i * self.low_bits
        b = a + self.low_bits
        word = int.from_bytes(self.low[a >> 3 : (b + 7) >> 3].tobytes(), "little")
        return word >> (a & 7) & ((1 << self.low_bits) - 1)

    def select_all(self) -> np.ndarray:
        """All values, in one sweep."""
        if not self.n:
            return np.zeros(0, np.int64)
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (place - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return high | bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(_MAGIC, self.n, self.universe, self.low_bits) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        magic, n, universe, low_bits = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not an Elias-Fano file")
        size = (n * low_bits + 7) // 8
        body = np.frombuffer(raw, np.uint8, offset=_HEAD.size)
        return cls(n, universe, low_bits, body[:size], body[size:])


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


class Shard:
    """Reader of one shard: any document's tokens by its place."""

    def __init__(self, folder: str, name: str):
        fs, at = file_system(folder)
        with fs.open_input_file(f"{at}/docs-{name}.ef") as f:
            self.bounds = EliasFano.from_bytes(f.read())
        self._file = fs.open_input_file(f"{at}/ids-{name}.bin")
        tokens = self.bounds.universe - 1
        self._kind = np.dtype("<u2" if not tokens or self._file.size() // tokens == 2 else "<u4")

    def __len__(self) -> int:
        return self.bounds.n - 1

    def tokens(self, i: int) -> np.ndarray:
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        return np.frombuffer(self._file.read_at((b - a) * self._kind.itemsize, a * self._kind.itemsize), self._kind)


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards; doc_id, shard, place, start, n_tokens of each document, read back through select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(vocabulary)
        kind = np.dtype("<u2" if bpe.size <= 1 << 16 else "<u4")
        fs, at = file_system(folder)
        name, stream, ids, sizes, total = "", None, [], [], 0

        def finish() -> pa.RecordBatch:
            nonlocal name, stream, ids, sizes, total
            stream.close()
            code = EliasFano.of(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))
            with fs.open_output_stream(f"{at}/docs-{name}.ef") as f:
                f.write(code.to_bytes())
            with fs.open_input_file(f"{at}/docs-{name}.ef") as f:
                bounds = EliasFano.from_bytes(f.read()).select_all()
            n = len(bounds) - 1
            if fs.get_file_info(f"{at}/ids-{name}.bin").size != bounds[-1] * kind.itemsize:
                raise OSError(f"ids-{name}.bin isn't whole")
            out = pa.record_batch({"doc_id": pa.concat_arrays(ids), "shard": pa.array([name]).take(pa.array(np.zeros(n, np.int64))), "place": pa.array(np.arange(n)), "start": pa.array(bounds[:-1]), "n_tokens": pa.array(np.diff(bounds))})
            name, stream, ids, sizes, total = "", None, [], [], 0
            return out

        for batch in batches:
            for part in T.pieces(batch, "text"):
                if not part.num_rows:
                    continue
                tokens, offs = bpe.encode_batch(*T.buffer_of(part.column("text")))
                if stream is None:
                    name = uuid.uuid4().hex
                    stream = fs.open_output_stream(f"{at}/ids-{name}.bin")
                stream.write(tokens.astype(kind).tobytes())
                ids.append(part.column("doc_id"))
                sizes.append(np.diff(offs))
                total += len(tokens)
                if total >= shard_tokens:
                    yield finish()
        if stream is not None:
            yield finish()

    folder = scratch.qualified(docs.sparkSession, folder)
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, shard string, place long, start long, n_tokens long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "token-ids")
    # written before it is returned: reading the result again doesn't write the shards again
    return scratch.written(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), "token-index")
