"""Posting blocks, an index's postings as they are stored: a row for each term and chunk of documents.

``docs``, ``tf`` and ``positions`` are variable-length integers (keys and positions as differences; for string keys
the keys' lengths, and ``keys`` the keys), so that Spark sorts and writes a row for each term of some thousand
documents instead of one for each term and document. Whole columns are handled at once, over Arrow batches.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.mapping import Field
from quern.operators import analysis

#: Bytes of text, or tokens, that make up a chunk, whole rows; a longer row is one by itself.
CHUNK_BYTES, CHUNK_TOKENS = 1 << 24, 2_000_000
#: Bytes of text that are cut into tokens at a time, so that the arrays of a step stay in the processor's cache.
PIECE_BYTES = 1 << 20
#: Rows of blocks that are sent at a time, postings that are decoded at a time (whole blocks), integers that are packed at a time.
SENT, DECODED, PACKED = 20_000, 500_000, 1 << 16
#: Bits of a token's term, row and place together; a chunk that needs more is halved.
BITS = 64


def schema(key: str) -> str:
    return f"term string, first {key}, n int, docs binary, keys binary, tf binary, positions binary"


# ---------------------------------------------------------------- integers


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the integers, seven bits each, and where each one begins, with the end."""
    values = values if values.dtype == np.uint32 else values.astype(np.uint64)
    of, width = values.dtype.type, max(1, -(-int(values.max(initial=0)).bit_length() // 7))
    if width == 1:
        return values.astype(np.uint8), np.arange(len(values) + 1)
    found, begins = [], np.zeros(len(values) + 1, np.int64)
    for at in range(0, len(values), PACKED):
        part, ends = values[at : at + PACKED], begins[at + 1 : at + 1 + PACKED]
        size = np.ones(len(part), np.int8)
        for k in range(1, width):
            size += part >= of(1 << 7 * k)
        np.cumsum(size, out=ends)
        first, out = ends - size, np.empty(ends[-1], np.uint8)
        out[first] = part.astype(np.uint8) & np.uint8(127) | ((size > 1).view(np.uint8) << np.uint8(7))
        for k in range(1, width):
            more = np.flatnonzero(size > k)
            out[first[more] + k] = ((part[more] >> of(7 * k)) & of(127)).astype(np.uint8) | ((size[more] > k + 1).view(np.uint8) << np.uint8(7))
        ends += begins[at]
        found.append(out)
    return np.concatenate(found), begins


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    size = ends - begins + 1
    out = (data[begins] & 127).astype(np.uint64)
    for k in range(1, int(size.max(initial=1))):
        at = np.flatnonzero(size > k)
        out[at] |= (data[begins[at] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


# ---------------------------------------------------------------- tokens


#: Dropped characters are 0; those of words come last.
ONE, LETTER, DOT = 1, 2, 3


@functools.cache
def _kinds() -> tuple[np.ndarray, bytes, bytes]:
    """Kinds of characters by code point and of ASCII bytes, and lower-case bytes, as :data:`analysis.BLOCKS` has them."""
    known = re.compile(re.sub(r"\\x\{(\w{4})\}", r"\\u\1", analysis.BLOCKS))
    points = np.array([ONE if known.fullmatch(chr(p)) else 0 for p in range(1 << 16)], np.uint8)
    for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        points[ord(c)] = LETTER
    points[ord(".")] = DOT
    ascii_ = points[:256].copy()
    ascii_[128:] = 0
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return points, ascii_.tobytes(), lower.tobytes()


def _mapped(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(bytearray(data).translate(table), np.uint8)


def _data(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array, and where each value begins, with the end."""
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    if not len(a):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = a.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def standard(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of :func:`analysis.standard` in lower case, one text after the other, and their number by text."""
    texts = pc.fill_null(texts, "")
    points, ascii_, lower = _kinds()
    data, rows = _data(texts)
    lead = np.flatnonzero(data >= 0x80)
    if len(lead):
        try:
            str(memoryview(data), "utf-8")
        except UnicodeDecodeError:  # as the JVM reads it
            data, rows = _data(pa.array([bytes(t).decode("utf-8", "replace") for t in pc.cast(texts, pa.large_binary()).to_pylist()], pa.large_string()))
            lead = np.flatnonzero(data >= 0x80)
    kind = _mapped(data, ascii_)
    lead = lead[data[lead] >= 0xC0]
    if len(lead):
        a, b, c = (data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) for k in range(3))
        point = np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, 0))
        kind[lead] = points[point]
    word = kind > ONE
    begin = word.copy()
    begin[1:] = word[1:] > word[:-1]
    first = rows[:-1][rows[:-1] < rows[1:]]
    begin[first] = word[first]
    dots = np.flatnonzero(kind == DOT)
    if len(dots):
        # dots without a letter or digit in their run are tokens by themselves
        new = np.append(True, begin[dots[1:]] | (np.diff(dots) > 1))
        heads = np.flatnonzero(new)
        size = np.diff(heads, append=len(dots))
        after = dots[heads + size - 1] + 1
        inside = np.minimum(after, len(data) - 1)
        bare = begin[dots[heads]] & ((after == len(data)) | ~word[inside] | begin[inside])
        at = dots[np.repeat(bare, size)]
        kind[at], begin[at] = ONE, False
    one = kind == ONE
    keep = kind > 0
    more = lead[one[lead]]
    keep[more + 1] = True
    keep[more[data[more] >= 0xE0] + 2] = True
    starts = np.flatnonzero(begin | one)
    kept = np.cumsum(keep, dtype=np.int32)
    ends = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_mapped(data[keep], lower))])
    return tokens, np.diff(np.searchsorted(starts, rows))


# ---------------------------------------------------------------- blocks


def _binary(data: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _chunk(keys: pa.Array, terms: pa.Array, codes: np.ndarray, counts: np.ndarray):
    """The blocks of one chunk, sorted by term; ``codes`` are the tokens' places in ``terms``, keys are in order."""
    if not len(codes):
        return
    order = pc.sort_indices(terms).to_numpy()
    # one integer a token: term, row and place
    low, mid, high = (int(n - 1).bit_length() for n in (counts.max(), len(counts), len(order)))
    if low + mid + high > BITS and len(counts) > 1:
        half = len(counts) // 2
        n = int(counts[:half].sum())
        yield from _chunk(keys[:half], terms, codes[:n], counts[:half])
        yield from _chunk(keys[half:], terms, codes[n:], counts[half:])
        return
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64) << np.uint64(low + mid)
    both = rank[codes]
    del codes
    both += np.repeat((np.arange(len(counts)) << low) - np.cumsum(counts) + counts, counts).view(np.uint64)
    both += np.arange(len(both), dtype=np.uint64)
    both.sort()
    new = np.ones(len(both), bool)
    new[1:] = both[1:] ^ both[:-1] >= np.uint64(1 << low)
    begins = np.flatnonzero(new)
    del new
    heads = both[begins] >> np.uint64(low)
    place = (both & np.uint64((1 << low) - 1)).astype(np.uint32)
    n_tokens = len(both)
    del both
    step = np.diff(place, prepend=np.uint32(0))
    step[begins] = place[begins]
    del place
    term, row = heads >> np.uint64(mid), (heads & np.uint64((1 << mid) - 1)).astype(np.int32)
    del heads
    tops = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    cuts = np.append(tops, len(term))
    tf, tf_at = pack(np.diff(begins, append=n_tokens))
    positions, positions_at = pack(step)
    if pa.types.is_integer(keys.type):
        values = keys.to_numpy()[row]
        gap = np.diff(values, prepend=values[:1]).view(np.uint64)
        gap[tops] = 0
        strings = pa.nulls(len(tops), pa.binary())
    else:
        data, ends = _data(keys.take(pa.array(row)))
        gap, strings = np.diff(ends), _binary(data, ends[cuts])
    docs, docs_at = pack(gap)
    columns = {
        "term": terms.take(pa.array(order[term[tops]])).cast(pa.string()), "first": keys.take(pa.array(row[tops])), "n": pa.array(np.diff(cuts).astype(np.int32)),
        "docs": _binary(docs, docs_at[cuts]), "keys": strings, "tf": _binary(tf, tf_at[cuts]), "positions": _binary(positions, positions_at[np.append(begins, n_tokens)[cuts]]),
    }
    out = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    for i in range(0, len(out), SENT):
        yield out.slice(i, SENT)


def _slices(ends: np.ndarray, most: int):
    """From and to of whole rows of so much, by their running sums; a longer row is by itself."""
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


#: Masks of the first bytes of eight.
_FIRST = np.array([(1 << 64) - (1 << 64 - 8 * k) for k in range(9)], np.uint64)


def _standard_codes(texts: pa.Array, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms, the tokens' places in them, and the number of tokens by text. Tokens of eight bytes at most are told apart as integers."""
    short, long, where, counts, n = [], [], [], [], 0
    for at, to in _slices(ends, PIECE_BYTES):
        tokens, count = standard(texts.slice(at, to - at))
        data, begins = _data(tokens)
        size = np.diff(begins)
        eight = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))[begins[:-1]].byteswap()
        eight &= _FIRST[np.minimum(size, 8)]
        over = np.flatnonzero(size > 8)
        eight[over] = 0  # no token: none is empty or has a NUL
        short.append(eight)
        long.append(tokens.take(pa.array(over)))
        where.append(over + n)
        counts.append(count)
        n += len(tokens)
    coded = pa.array(np.concatenate(short)).dictionary_encode()
    del short
    bytes_ = coded.dictionary.to_numpy().astype(">u8").view(np.uint8)
    size = (bytes_.reshape(-1, 8) > 0).sum(1)
    terms = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(bytes_[bytes_ > 0])])
    others = pa.concat_arrays(long).dictionary_encode()
    codes = coded.indices.to_numpy().copy()
    codes[np.concatenate(where)] = others.indices.to_numpy() + np.int32(len(terms))
    return pa.concat_arrays([terms, others.dictionary]), codes, np.concatenate(counts)


def _codes(lists: pa.Array, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As :func:`_standard_codes`, of lists of any tokens."""
    coded = lists.flatten().dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.diff(ends, prepend=0)


def _ends(column: pa.Array, texts: bool) -> np.ndarray:
    """Running sums of the bytes or tokens of each row."""
    size = pc.binary_length(column) if texts else column.value_lengths()
    return np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)


def _chunks(batches, texts: bool, most: int):
    """Keys and values of whole rows of so much, over several batches: the fewer chunks, the fewer blocks a term has."""
    held, size = [], 0
    for b in batches:
        ends, at = _ends(b.column(1), texts), 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, base + most - size, "right")), at if held else at + 1)
            if to > at:
                held.append([c.slice(at, to - at) for c in b.columns])
                size += int(ends[to - 1] - base)
            if to < len(ends) or size >= most:
                yield [pa.concat_arrays(c) for c in zip(*held)]
                held, size = [], 0
            at = to
        # what is kept for the next batch is copied, so that its own batch isn't kept
        held = [[c.take(pa.array(np.arange(len(c)))) for c in h] if h[0].offset or len(h[0]) < len(b) else h for h in held]
    if held:
        yield [pa.concat_arrays(c) for c in zip(*held)]


def _local(batches, texts: bool, most: int):
    for keys, column in _chunks(batches, texts, most):
        order = pc.sort_indices(keys).to_numpy()
        if (np.diff(order.astype(np.int64)) != 1).any():
            keys, column = keys.take(pa.array(order)), column.take(pa.array(order))
        yield from _chunk(keys, *(_standard_codes if texts else _codes)(column, _ends(column, texts)))


def of(rows: DataFrame, key: str, field: Field, analyzers: dict | None = None) -> DataFrame:
    """Blocks of one field, each batch of rows by itself: nothing is shuffled. For rows whose keys differ and aren't null."""
    # the standard analyzer cuts texts over whole batches, other analyzers are expressions
    texts = field.type == "text" and field.analyzer not in (analyzers or {}) and analysis.analyzer(field.analyzer) is analysis.STANDARD
    flat = rows.select(F.col(key).alias("doc_id"), (F.col(field.name).cast("string") if texts else field.tokens(analyzers)).alias("tokens"))
    most = CHUNK_BYTES if texts else CHUNK_TOKENS
    return flat.mapInArrow(lambda batches: _local(batches, texts, most), schema(flat.schema["doc_id"].dataType.simpleString()))


def _postings(b: pa.RecordBatch, positions: bool) -> pa.RecordBatch:
    n = b.column("n").to_numpy()
    block = np.repeat(np.arange(len(n)), n)
    begins = np.cumsum(n) - n
    number = unpack(_data(b.column("docs"))[0])
    first = b.column("first")
    if pa.types.is_integer(first.type):
        sums = np.cumsum(number, dtype=np.uint64)
        keys = pa.array(first.to_numpy()[block] + (sums - sums[begins][block]).view(np.int64))
    else:
        ends = np.concatenate([[0], np.cumsum(number)]).astype(np.int64)
        keys = pa.Array.from_buffers(pa.large_string(), len(block), [None, pa.py_buffer(ends), pa.py_buffer(_data(b.column("keys"))[0])]).cast(pa.string())
    tf = unpack(_data(b.column("tf"))[0]).astype(np.int64)
    columns = {"field": b.column("field").take(pa.array(block)), "term": b.column("term").take(pa.array(block)), "doc_id": keys, "tf": pa.array(tf)}
    if positions:
        step = unpack(_data(b.column("positions"))[0]).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(tf)])
        sums = np.concatenate([[0], np.cumsum(step)])
        place = sums[1:] - np.repeat(sums[ends[:-1]], tf)
        columns["positions"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32)))
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def postings(blocks: DataFrame, positions: bool = True) -> DataFrame:
    """field, term, doc_id, tf (and positions) of rows of blocks with their field."""
    columns = ["field", "term", "first", "n", "docs", "keys", "tf", *(["positions"] if positions else [])]

    def decoded(batches):
        for b in batches:
            for at, to in _slices(np.cumsum(b.column("n").to_numpy(), dtype=np.int64), DECODED):
                yield _postings(b.slice(at, to - at), positions)

    key = blocks.schema["first"].dataType.simpleString()
    return blocks.select(*columns).mapInArrow(decoded, f"field string, term string, doc_id {key}, tf long" + (", positions array<int>" if positions else ""))
