"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words (runs of letters and digits, case folded), so that layout
and punctuation don't hide a passage.  The test strings are all windows of
``WINDOW`` words of every benchmark item (a shorter item, down to one word, is
one string of its own; ``least`` can ask for longer ones).  Strings of one length share a search with
blocks of two words: the shift table says how far any position may be skipped,
a shift of 0 leads to the bucket of strings with that suffix block, and the
strings of the bucket are compared word by word.  All texts of a batch are
searched at once, each lane skipping on its own.

Defined results: null and empty texts and items match nothing; items without
an id are ignored, documents without one are reported as null (and dropped by
:func:`drop_contaminated` like others); repeated documents are judged row by
row; rows of one item are one item, whose strings count once; item_id must be
an integer, doc_id keeps its type; extra columns are carried along or ignored.
The tables of the benchmark are held by every worker: the benchmark's size is
counted in words and checked against ``MAX_WINDOWS``, and a larger one is
searched in several passes over the documents.  An item's texts stay in one
pass however large they are, so that passes never change a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import textnp as T

WINDOW = 10
LEAST = 1
MAX_WINDOWS = 2_000_000


class WuManber:
    """Shift and suffix tables for strings of one length (rows of word hashes)."""

    BITS = 22

    def __init__(self, strings: np.ndarray, owners: np.ndarray):
        self.m = m = strings.shape[1]
        block = self._block(strings[:, :-1], strings[:, 1:]) if m > 1 else strings
        self.shift = np.full(1 << self.BITS, max(1, m - 1), np.uint8 if m < 256 else np.int32)
        # the last place of a block decides: later columns write over earlier ones
        for j in range(block.shape[1]):
            self.shift[block[:, j] >> np.uint64(64 - self.BITS)] = block.shape[1] - 1 - j
        suffix = block[:, -1] >> np.uint64(64 - self.BITS)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.strings, self.owners = suffix[order], strings[order], owners[order]

    @staticmethod
    def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return T.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, owner) of all occurrences in texts that begin at the words ``first``."""
        m = self.m
        # long texts are cut into lanes that overlap by m - 1 words
        lo, hi = first[:-1], first[1:]
        pieces = np.maximum(1, -(-(hi - lo) // 512))
        row = np.repeat(np.arange(len(lo)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = lo[row] + nth * 512 + m - 1
        end = np.minimum(lo[row] + (nth + 1) * 512 + m - 1, hi[row])
        live = at < end
        at, end = at[live], end[live]
        found = []
        while len(at):
            b = (self._block(h[at - 1], h[at]) if m > 1 else h[at]) >> np.uint64(64 - self.BITS)
            s = self.shift[b].astype(np.int64)
            zero = s == 0
            if zero.any():
                found.append((at[zero], b[zero]))
            at = at + np.maximum(s, 1)
            live = at < end
            at, end = at[live], end[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, b = (np.concatenate(x) for x in zip(*found, strict=True))
        left, right = np.searchsorted(self.suffix, b, "left"), np.searchsorted(self.suffix, b, "right")
        n = right - left
        at = np.repeat(at, n)
        k = np.repeat(left, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        for j in range(m):
            ok = h[at - m + 1 + j] == self.strings[k, j]
            at, k = at[ok], k[ok]
        return at - m + 1, self.owners[k]


def test_strings(items: list[tuple[int, str]], window: int = WINDOW, least: int = LEAST) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the distinct (string, item) rows."""
    h, first = T.word_hashes(pa.array([t for _, t in items], pa.string()))
    by: dict[int, tuple[list, list]] = {}
    for (item, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
        m = min(window, b - a)
        if m >= least:
            w = np.lib.stride_tricks.sliding_window_view(h[a:b], m)
            x = by.setdefault(m, ([], []))
            x[0].append(w)
            x[1].append(np.full(len(w), item, np.int64))
    out = {}
    for m, (w, o) in by.items():
        both = np.unique(np.column_stack([np.concatenate(w), np.concatenate(o).view(np.uint64)]), axis=0)
        out[m] = both[:, :-1].copy(), both[:, -1].copy().view(np.int64)
    return out


def _items(benchmark: DataFrame) -> list[tuple[int, str]]:
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).distinct().orderBy("i", "t")
    return [(r["i"], r["t"]) for r in rows.toLocalIterator()]


def _passes(items: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """Runs of items, ordered by id, of up to MAX_WINDOWS words; an item is never parted."""
    parts, size = [[]], 0
    for _, rows in groupby(items, key=itemgetter(0)):
        texts = list(rows)
        n = len(T.word_hashes(pa.array([t for _, t in texts], pa.string()))[0])
        if size + n > MAX_WINDOWS and parts[-1]:
            parts.append([])
            size = 0
        parts[-1] += texts
        size += n
    return parts


def _occurrences(column: pa.Array, searches: list[WuManber]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, first word within the row) of all occurrences in a batch."""
    h, first = T.word_hashes(column)
    found = [s.search(h, first) for s in searches]
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    at = np.concatenate([f[0] for f in found])
    item = np.concatenate([f[1] for f in found])
    row = np.searchsorted(first, at, "right") - 1
    return row, item, at - first[row]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, n_hits (windows in common), first_word (of the first) of each row of docs and item that share a test string."""
    spark = docs.sparkSession
    texts, kind = docs.select("doc_id", F.col("text").cast("string").alias("text")), docs.schema["doc_id"].dataType.simpleString()
    out = None
    for items in _passes(_items(benchmark)):
        shared = spark.sparkContext.broadcast(test_strings(items, window, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searches = [WuManber(*x) for x in shared.value.values()]
            for batch in batches:
                for part in T.pieces(batch, "text"):
                    row, item, word = _occurrences(part.column("text"), searches)
                    order = np.lexsort((word, item, row))
                    row, item, word = row[order], item[order], word[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
                    at = np.flatnonzero(new)
                    n = np.diff(np.append(at, len(row)))
                    yield pa.record_batch({"doc_id": part.column("doc_id").take(pa.array(row[at])), "item_id": pa.array(item[at]), "n_hits": pa.array(n), "first_word": pa.array(word[at])})

        found = texts.mapInArrow(run, f"doc_id {kind}, item_id long, n_hits long, first_word long")
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """The rows that share no test string with the benchmark, with all their columns."""
    spark = docs.sparkSession
    for items in _passes(_items(benchmark)):
        shared = spark.sparkContext.broadcast(test_strings(items, window, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searches = [WuManber(*x) for x in shared.value.values()]
            for batch in batches:
                for part in T.pieces(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[_occurrences(part.column("text"), searches)[0]] = False
                    yield part.filter(pa.array(keep))

        docs = T.map_rows(docs, run)
    return docs


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ', 'abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ')"


def _word_class() -> str:
    """Letters and digits of :func:`textnp.split` as a class: all beyond ASCII but SIGNS."""
    parts, at = [], 0x80
    for a, b in sorted(T.SIGNS):
        if at < a:
            parts.append(f"\\x{{{at:X}}}-\\x{{{a - 1:X}}}")
        at = max(at, b + 1)
    return "[a-zA-Z0-9" + "".join(parts) + f"\\x{{{at:X}}}-\\x{{10FFFF}}]+"


_WORDS = f"regexp_extract_all({_FOLD}, '{_word_class()}')"
ORACLE = f"""
with dw as materialized (select doc_id, row_number() over () as r, {_WORDS} as w from documents where text is not null),
bw as materialized (select item_id, w, least(len(w), {WINDOW}) as m from (select distinct item_id, {_WORDS} as w from benchmark where text is not null and item_id is not null) where len(w) >= {LEAST}),
bs as materialized (select distinct item_id, m, array_to_string(w[i:i+m-1], ' ') as s from (select *, unnest(generate_series(1, len(w) - m + 1)) as i from bw)),
sizes as (select distinct m from bs),
ds as (select doc_id, r, i - 1 as pos, m, array_to_string(w[i:i+m-1], ' ') as s from (select *, unnest(generate_series(1, len(w) - m + 1)) as i from dw, sizes where len(w) >= m))
select doc_id, item_id, count(*)::bigint as n_hits, min(pos)::bigint as first_word from ds join bs using (m, s) group by doc_id, r, item_id"""
