"""Vectorised word access to Arrow string columns.

Works on the UTF-8 buffer of a whole batch, so that no Python string is made
for the words of a text.  A *word* is a run of word bytes (see ``ALNUM`` and
``NONSPACE``); words never cross rows.  Null and empty rows hold no words.
Hashes are 64 bit polynomials over the bytes, mixed afterwards; they are made in
blocks of ``BLOCK`` bytes, so that tables of powers stay that long however long
a text or a word is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of whitespace-separated words.
NONSPACE = ~SPACE
#: Bytes of letters and digits; every byte beyond ASCII counts as a letter, but :func:`split` takes the signs of ``SIGNS`` as separators.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Punctuation and spaces beyond ASCII, by first and last code point; joiners and soft hyphens are part of words.
SIGNS = (
    *((0xA0, 0xA9), (0xAB, 0xAC), (0xAE, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x200B), (0x2010, 0x205F), (0x2E00, 0x2E7F)),
    *((0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0xFEFF, 0xFEFF), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)),
)
_SIGN = np.zeros(1 << 16, bool)
for _a, _b in SIGNS:
    _SIGN[_a : _b + 1] = True
_LEAD = np.zeros(256, bool)
_LEAD[sorted({chr(_c).encode()[0] for _a, _b in SIGNS for _c in range(_a, _b + 1)})] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Values that are summed up at once.
BLOCK = 1 << 21
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each (BLOCK + 1 at most)."""
    if not _tables or len(_tables[0]) < n:
        size = BLOCK + 1 if n > 1 << 16 else 1 << 16
        with np.errstate(over="ignore"):
            _tables[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, x, U64)]), dtype=U64) for x in (_BASE, _INVERSE)]
    return _tables[0], _tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the row offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offs):
        offs = np.zeros(1, np.int64)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def integer_ids(rows: DataFrame, column: str) -> Column:
    """The id column as long; ids of another kind are refused, as casting would lose them."""
    kind = rows.schema[column].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{column} must be an integer, not {kind.simpleString()}")
    return F.col(column).cast("long").alias(column)


def plain_names(rows: DataFrame) -> DataFrame:
    """The rows with names of their own instead of those that hold other signs than letters, digits and underscores, or occur twice."""
    low = [n.lower() for n in rows.columns]
    return rows.toDF(*(n if re.fullmatch(r"\w+", n) and low.count(n.lower()) == 1 else f"_{i}_of_{len(low)}" for i, n in enumerate(rows.columns)))


def map_rows(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Arrow batches through ``run``, which keeps all columns, whatever they are called."""
    plain = plain_names(rows)
    return plain.mapInArrow(run, plain.schema).toDF(*rows.columns)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text (one row at least)."""
    index = batch.schema.get_field_index(column)
    _, offs = buffer_of(batch.column(index))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters; other scripts stay as written."""
    out = _LOWER[data]
    if len(out) > 1:
        lead = out[:-1] == 0xC3
        if lead.any():
            tail = out[1:]
            up = lead & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
            tail[up] += 32
    return out


def _without_signs(data: np.ndarray, w: np.ndarray) -> None:
    """Takes the bytes of SIGNS out of the word bytes ``w``."""
    i = np.flatnonzero(_LEAD[data])
    three = data[i] >= 0xE0
    i = i[i + 1 + three < len(data)]
    three = data[i] >= 0xE0
    b, c = data[i + 1].astype(np.int32) & 63, data[i + 1 + three].astype(np.int32) & 63
    lead = data[i].astype(np.int32)
    good = _SIGN[np.where(three, (lead & 15) << 12 | b << 6 | c, (lead & 31) << 6 | b)]
    i, three = i[good], three[good]
    w[i] = w[i + 1] = False
    w[i[three] + 2] = False


def split(data: np.ndarray, offs: np.ndarray, wordish: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of each word, and for each row the index of its first word, with the total at the end."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = wordish[data]
    if wordish is ALNUM:
        _without_signs(data, w)
    row = np.zeros(n + 1, bool)
    row[offs] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | row[1:n]
    end = w.copy()
    end[:-1] &= ~w[1:] | row[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def span_sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, plus: int = 0) -> np.ndarray:
    """Polynomial over values[lo:hi] + plus of each span, wherever it stands; lo and hi don't fall."""
    out = np.zeros(len(lo), U64)
    i = 0
    while i < len(lo):
        j = max(i + 1, int(np.searchsorted(hi, lo[i] + BLOCK, "right")))
        a, b = int(lo[i]), int(hi[j - 1])
        if b - a > BLOCK:
            # one span beyond a block: block by block, each moved to its place
            total = 0
            for k in range(a, b, BLOCK):
                total += int(_sums(values[k : min(b, k + BLOCK)], plus)[-1]) * pow(_BASE, k - a, 1 << 64)
            out[i] = U64(total & ((1 << 64) - 1))
        else:
            sums = _sums(values[a:b], plus)
            with np.errstate(over="ignore"):
                out[i:j] = (sums[hi[i:j] - a] - sums[lo[i:j] - a]) * _powers(b - a + 1)[1][lo[i:j] - a]
        i = j
    return out


def _sums(values: np.ndarray, plus: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(U64) + U64(plus)) * _powers(len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bit hash of each span of bytes."""
    with np.errstate(over="ignore"):
        return mix(span_sums(data, starts, ends, 1) + (ends - starts).astype(U64))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k values; as many as len(h)-k+1, or none."""
    lo = np.arange(max(0, len(h) - k + 1))
    return mix(span_sums(h, lo, lo + k))


def word_hashes(column: pa.Array, wordish: np.ndarray = ALNUM, folded: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and each row's first word."""
    data, offs = buffer_of(column)
    if folded:
        data = fold(data)
    starts, ends, first = split(data, offs, wordish)
    return hashes(data, starts, ends), first
