"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut in halves recursively (anywhere between two characters) down to
leaves of ``LEAF`` bytes; leaves are encoded alone, and neighbours are joined
pair by pair up the tree.  A join re-encodes a window around the seam that
grows until the tokens outside provably stay as they are: the pre-tokeniser
splits at every step from a visible ASCII character to a blank whatever
surrounds it, so once such a step is found on each side of the seam, no merge
reaches over it.  Without one the window grows to the whole span, so the
result always equals that of encoding the text at once.  Decoding
concatenates byte strings up the same tree.

Leaves of one Arrow batch are encoded together: pre-tokens are found on the
byte buffer, the distinct new ones are merged side by side (all places of a
word's lowest-ranked pair at once, round by round) and remembered by the
worker; what is remembered is compared byte by byte, hashes only find it.
Leaves with characters outside ASCII and Latin-1 letters are cut by the
pattern itself.  The vocabulary is only read, by path.

Defined results: a null text has null tokens and 0 of them, an empty text an
empty list; rows are independent, so repeated rows, ties and null ids change
nothing; doc_id keeps its type; extra columns are ignored.  In decoding, a null
list gives null, an id that the vocabulary lacks gives null, and bytes that
aren't UTF-8 (of a list that doesn't come from a text) become U+FFFD.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import textnp as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: White space by its Unicode property, which leaves out the separators 28 to 31.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LEAF = 4096
WINDOW = 32
REMEMBERED = 1_000_000

# 0: fallback, 1: letter, 2: digit, 3: white space, 4: other, 5: lead byte of a Latin-1 letter
_CLASS = np.zeros(256, np.uint8)
_CLASS[0:128] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[28, 29, 30, 31]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[0xC3] = 5


class Bpe:
    """One vocabulary with the worker's memory of encoded pre-tokens."""

    _made: dict[str, Bpe] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.pattern = ranks, regex.compile(PATTERN)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # what two neighbours make, for all ways to cut a token in two tokens
        pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.words: dict[bytes, list[int]] = {}
        self.size = max(ranks.values()) + 1
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.length = np.zeros(self.size, np.int64)
        self.at = np.zeros(self.size, np.int64)
        self.bytes = np.frombuffer(b"".join(a for a, _ in order), np.uint8)
        ids = np.array([b for _, b in order])
        sizes = np.array([len(a) for a, _ in order])
        self.length[ids] = sizes
        self.at[ids] = np.cumsum(sizes) - sizes
        # memory: sorted runs of (keys, first token, tokens), each at least twice the next, over one growing array of tokens
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    @classmethod
    def of(cls, path: str) -> Bpe:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode_text(self, raw: bytes) -> np.ndarray:
        """Tokens of a text, pre-token by pre-token."""
        out: list[int] = []
        for m in self.pattern.finditer(raw.decode("utf-8", "replace")):
            out += self._word(m.group().encode())
        return np.array(out, np.int32)

    def _word(self, word: bytes) -> list[int]:
        if word in self.ranks:
            return [self.ranks[word]]
        found = self.words.get(word)
        if found is None:
            if len(word) <= 32:
                parts, get, none = [word[i : i + 1] for i in range(len(word))], self.ranks.get, self.size
                while len(parts) > 1:
                    ranks = [get(a + b, none) for a, b in pairwise(parts)]
                    low = min(ranks)
                    if low == none:
                        break
                    k = ranks.index(low)
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                found = [self.ranks[p] for p in parts]
            else:
                data = np.frombuffer(word, np.uint8)
                found = self.merge(data, np.zeros(1, np.int64), np.array([len(word)]))[0].tolist()
            if len(self.words) >= 100_000:
                self.words.clear()
            if len(word) <= 64:
                self.words[word] = found
        return found

    def merge(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the pre-tokens data[s:e], one after another, and how many each has."""
        n, none = len(s), np.iinfo(np.int64).max
        raw, get = data.tobytes(), self.ranks.get
        whole = np.array([get(raw[a:b], -1) for a, b in zip(s.tolist(), e.tolist(), strict=True)], np.int64)
        size = np.where(whole >= 0, 0, e - s)
        ids, row = self.single[data[_ranges(s, size)]], np.repeat(np.arange(n), size)
        done_ids, done_rows = [whole[whole >= 0]], [np.flatnonzero(whole >= 0)]
        while len(ids):
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where((self.pair_keys[at] == key) & (row[:-1] == row[1:]), self.pair_ids[at], none)
            rank = np.append(rank, none)
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(ids))))
            over = lowest == none
            if over.any():
                done_ids.append(ids[over])
                done_rows.append(row[over])
            place = np.flatnonzero((rank == lowest) & ~over)
            # of places that overlap, every other one from the left
            new = np.append(True, place[1:] != place[:-1] + 1)[: len(place)]
            run = np.flatnonzero(new)
            place = place[(np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))) % 2 == 0]
            ids[place] = rank[place]
            stay = ~over
            stay[place + 1] = False
            ids, row = ids[stay], row[stay]
        flat, rows = np.concatenate(done_ids), np.concatenate(done_rows)
        return flat[np.argsort(rows, kind="stable")].astype(np.int32), np.bincount(rows, minlength=n)

    def encode_spans(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each span between offsets, encoded alone, with the offsets of their tokens."""
        n = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        starts, plain = pretokens(data, offs)
        ends = np.append(starts[1:], len(data))
        h = T.hashes(data, starts, ends)
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        # the words of one hash must be one word; a span where they aren't is encoded by itself
        size = ends - starts
        other = (size != size[first][back]) | (starts != starts[first][back]) & (np.add.reduceat(data[_ranges(starts[first][back], size) % len(data)] != data, starts) > 0)
        plain[np.searchsorted(offs, starts[other], "right") - 1] = False
        uniq_at, uniq_n, flat = self._look(uniq, data, starts[first], ends[first])
        at, counts = uniq_at[back], uniq_n[back]
        span = np.searchsorted(offs, starts, "right") - 1
        odd = np.flatnonzero(~plain)
        if len(odd):
            counts = np.where(plain[span], counts, 0)
        total = np.bincount(span, weights=counts, minlength=n).astype(np.int64)
        replaced = {}
        raw = data.tobytes() if len(odd) else b""
        for i in odd.tolist():
            replaced[i] = self.encode_text(raw[offs[i] : offs[i + 1]])
        out_n = total.copy()
        for i, x in replaced.items():
            out_n[i] = len(x)
        out_offs = np.concatenate([[0], np.cumsum(out_n)])
        gathered = flat[_ranges(at, counts)]
        if not replaced:
            return gathered, out_offs
        out = np.empty(out_offs[-1], np.int32)
        keep = np.repeat(plain, out_n)
        out[keep] = gathered
        for i, x in replaced.items():
            out[out_offs[i] : out_offs[i + 1]] = x
        return out, out_offs

    def _look(self, keys: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, tokens, array of tokens) of distinct pre-tokens with their hashes, remembered or new."""
        at, counts, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for run, starts, sizes in self.runs:
            rest = np.flatnonzero(~known)
            p = np.searchsorted(run, keys[rest])
            ok = p < len(run)
            ok[ok] = run[p[ok]] == keys[rest[ok]]
            at[rest[ok]], counts[rest[ok]], known[rest[ok]] = starts[p[ok]], sizes[p[ok]], True
        # a hash alone proves nothing: the remembered tokens must spell the bytes
        old = np.flatnonzero(known)
        tokens = self.flat[_ranges(at[old], counts[old])]
        length = np.add.reduceat(np.append(self.length[tokens], 0), np.cumsum(counts[old]) - counts[old]) if len(old) else np.zeros(0, np.int64)
        same = length == e[old] - s[old]
        known[old[~same]] = False
        old = old[same]
        if len(old):
            spelt = self.bytes[_ranges(self.at[tk := self.flat[_ranges(at[old], counts[old])]], self.length[tk])]
            wrong = np.flatnonzero(spelt != data[_ranges(s[old], e[old] - s[old])])
            known[old[np.unique(np.searchsorted(np.cumsum(e[old] - s[old]), wrong, "right"))]] = False
        new = np.flatnonzero(~known)
        tokens, sizes = self.merge(data, s[new], e[new])
        starts = self.used + np.cumsum(sizes) - sizes
        at[new], counts[new] = starts, sizes
        # beyond the bound new pre-tokens are merged again in the next batch
        if sum(len(r[0]) for r in self.runs) + len(new) > REMEMBERED:
            return at, counts, np.concatenate([self.flat[: self.used], tokens])
        if len(new):
            if self.used + len(tokens) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * (self.used + len(tokens)))
            self.flat[self.used : self.used + len(tokens)] = tokens
            self.used += len(tokens)
            self.runs.append((keys[new], starts, sizes))
            while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
                a, b = self.runs.pop(), self.runs.pop()
                both = [np.concatenate(x) for x in zip(a, b, strict=True)]
                order = np.argsort(both[0], kind="stable")
                self.runs.append(tuple(x[order] for x in both))
        return at, counts, self.flat

    def join(self, raw: bytes, s: int, m: int, e: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of raw[s:e] from those of raw[s:m] and raw[m:e]."""
        if s == m:
            return right
        if m == e:
            return left
        window = WINDOW
        p, q = s, e
        while True:
            lo, hi = max(s, m - window), min(e, m + window)
            i, j = _step_before(raw, lo, m), _step_after(raw, m, hi)
            p = i if i >= 0 else s
            q = j if j >= 0 else e
            if (i >= 0 or lo == s) and (j >= 0 or hi == e):
                break
            window *= 2
        gone = self._count_back(left, m - p)
        skip = self._count(right, q - m)
        return np.concatenate([left[: len(left) - gone], self.encode_text(raw[p:q]), right[skip:]])

    def _count(self, tokens: np.ndarray, size: int) -> int:
        """How many first tokens make size bytes."""
        take = 64
        while True:
            c = np.cumsum(self.length[tokens[:take]])
            if take >= len(tokens) or (len(c) and c[-1] >= size):
                return 0 if size == 0 else int(np.searchsorted(c, size)) + 1
            take *= 4

    def _count_back(self, tokens: np.ndarray, size: int) -> int:
        return self._count(tokens[::-1], size)

    def reduce(self, raw: bytes, cuts: list[int], leaves: list[np.ndarray]) -> np.ndarray:
        """Joins neighbours, level by level."""
        while len(leaves) > 1:
            up, at = [], [cuts[0]]
            for i in range(0, len(leaves) - 1, 2):
                up.append(self.join(raw, cuts[i], cuts[i + 1], cuts[i + 2], leaves[i], leaves[i + 1]))
                at.append(cuts[i + 2])
            if len(leaves) % 2:
                up.append(leaves[-1])
                at.append(cuts[-1])
            leaves, cuts = up, at
        return leaves[0]

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        raw = text.encode()
        cuts = halves(np.frombuffer(raw, np.uint8), 0, len(raw), leaf)
        offs = np.array(cuts, np.int64)
        tokens, at = self.encode_spans(np.frombuffer(raw, np.uint8), offs)
        return self.reduce(raw, cuts, [tokens[at[i] : at[i + 1]] for i in range(len(cuts) - 1)])

    def decode(self, tokens: np.ndarray) -> bytes:
        """Bytes of the tokens, halves concatenated."""
        if len(tokens) > 1 << 16:
            half = len(tokens) // 2
            return self.decode(tokens[:half]) + self.decode(tokens[half:])
        return self.bytes[_ranges(self.at[tokens], self.length[tokens])].tobytes()

    def encode_batch(self, data: np.ndarray, offs: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all rows, with the offsets of each row's."""
        n = len(offs) - 1
        long = np.flatnonzero(np.diff(offs) > leaf)
        cuts = {i: halves(data, int(offs[i]), int(offs[i + 1]), leaf) for i in long.tolist()}
        inner = np.array([c for x in cuts.values() for c in x[1:-1]], np.int64)
        spans = np.sort(np.concatenate([offs, inner]), kind="stable")
        tokens, at = self.encode_spans(data, spans)
        if not cuts:
            return tokens, at
        # empty rows repeat an offset: a row's first span is found by counting the inner cuts before it
        first = np.arange(n + 1) + np.searchsorted(inner, offs, "left")
        raw = data.tobytes()
        whole = {}
        size = at[first[1:]] - at[first[:-1]]
        for i, c in cuts.items():
            f = int(first[i])
            whole[i] = self.reduce(raw, c, [tokens[at[f + k] : at[f + k + 1]] for k in range(len(c) - 1)])
            size[i] = len(whole[i])
        out_offs = np.concatenate([[0], np.cumsum(size)])
        parts, done = [], 0
        for i in sorted(whole):
            parts += [tokens[at[first[done]] : at[first[i]]], whole[i]]
            done = i + 1
        parts.append(tokens[at[first[done]] : at[first[n]]])
        return np.concatenate(parts), out_offs


def _ranges(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """at[i] .. at[i]+counts[i]-1, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(at - before, counts) + np.arange(total)


def _visible(c: int) -> bool:
    return 33 <= c <= 126


def _step_before(raw: bytes, lo: int, m: int) -> int:
    """Last place in (lo, m) with a blank after a visible ASCII character, or -1."""
    i = raw.rfind(b" ", lo + 1, m)
    while i > lo and not _visible(raw[i - 1]):
        i = raw.rfind(b" ", lo + 1, i)
    return i if i > lo else -1


def _step_after(raw: bytes, m: int, hi: int) -> int:
    i = raw.find(b" ", m + 1, hi)
    while i != -1 and not _visible(raw[i - 1]):
        i = raw.find(b" ", i + 1, hi)
    return i


def halves(data: np.ndarray, s: int, e: int, leaf: int = LEAF) -> list[int]:
    """Cuts of [s, e], halved down to leaves; never inside a character."""
    cuts, level = [s, e], e - s
    while level > leaf:
        fine = [cuts[0]]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            m = (a + b) // 2
            while m > a and data[m] & 0xC0 == 0x80:
                m -= 1
            if m > a:
                fine.append(m)
            fine.append(b)
        if len(fine) == len(cuts):
            break
        cuts, level = fine, (level + 1) // 2
    return cuts


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens, and for each span whether they hold (else it has characters unknown here)."""
    n, rows = len(data), len(offs) - 1
    kind = _CLASS[data]
    lead = np.flatnonzero(kind == 5)
    tail = np.zeros(n, bool)
    if len(lead):
        nxt = np.minimum(lead + 1, n - 1)
        good = (data[nxt] >= 0x80) & (data[nxt] <= 0xBF) & (data[nxt] != 0x97) & (data[nxt] != 0xB7)
        kind[lead[good]] = 1
        kind[nxt[good]] = 1
        tail[nxt[good]] = True
        kind[lead[~good]] = 0
    bad = np.flatnonzero(kind == 0)
    plain = np.ones(rows, bool)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    if len(bad):
        plain[np.searchsorted(offs, bad, "right") - 1] = False
    cut = edge[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    space = kind == 3
    # the last blank of a run goes with what follows, or stands alone if it isn't a blank
    ends_run = space.copy()
    ends_run[:-1] &= ~space[1:]
    ends_run &= ~edge[1:]
    last = np.flatnonzero(ends_run)
    cut[last] = True
    blank = last[data[last] == 32]
    cut[blank + 1] = False
    # contractions where a pre-token begins with an apostrophe
    quote = np.flatnonzero((data == 39) & cut)
    if len(quote):
        # as many bytes of the same span as there are
        left = offs[np.searchsorted(offs, quote, "right")] - quote
        a = np.where(left > 1, data[np.minimum(quote + 1, n - 1)], 0)
        b = np.where(left > 2, data[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        for found, size in ((quote[one], 2), (quote[two], 3)):
            cut[found + 1] = False
            after = found + size
            after = after[after < n]
            cut[after] = True
    cut &= ~tail
    return np.flatnonzero(cut), plain


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_bytes, n_tokens, tokens, round_trip (decoding gave the text back) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(vocabulary)
        for batch in batches:
            for part in T.pieces(batch, "text", 1 << 20):
                column = part.column("text")
                data, offs = T.buffer_of(column)
                tokens, at = bpe.encode_batch(data, offs, leaf)
                same = _same(bpe, tokens, at, data, offs)
                null = np.asarray(column.is_null())
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens), mask=pa.array(null) if null.any() else None)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(offs)), "n_tokens": pa.array(np.diff(at)), "tokens": lists, "round_trip": pa.array(same)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, tokens array<int>, round_trip boolean")


def decode_documents(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of each row of doc_id and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(vocabulary)
        real = bpe.length > 0
        for batch in batches:
            lists = batch.column("tokens")
            texts: list[str | None] = []
            for i in range(len(lists)):
                if not lists[i].is_valid:
                    texts.append(None)
                    continue
                ids = lists[i].values
                t = ids.fill_null(-1).to_numpy(zero_copy_only=False)
                good = (t >= 0) & (t < bpe.size)
                good[good] = real[t[good]]
                texts.append(bpe.decode(t).decode("utf-8", "replace") if good.all() else None)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return tokens.select("doc_id", F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def _same(bpe: Bpe, tokens: np.ndarray, at: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each row's tokens decode to its bytes."""
    decoded = np.frombuffer(bpe.decode(tokens), np.uint8)
    size = np.concatenate([[0], np.cumsum(bpe.length[tokens])])[at]
    n = len(offs) - 1
    if len(decoded) == len(data) and np.array_equal(size, offs):
        wrong = np.flatnonzero(decoded != data)
        ok = np.ones(n, bool)
        ok[np.searchsorted(offs, wrong, "right") - 1] = False
        return ok
    return np.array([decoded[size[i] : size[i + 1]].tobytes() == data[offs[i] : offs[i + 1]].tobytes() for i in range(n)], bool)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
