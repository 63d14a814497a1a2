"""Suffix-array dedup: passages of ``WINDOW`` words or more that occur in several documents.

Suffix arrays are built by linear grouping.  Phase 1 takes groups of suffixes
in descending order; a group's members point to the previous suffix of a
smaller group, and the suffixes so pointed to are split off their groups by
how many members point to them, which extends the groups' common prefixes to
Lyndon prefixes.  Phase 2 fills the array from the smallest suffix on along
the same pointers.  There is no renaming and no recursion.

Routing.  Two occurrences of a passage must meet in one suffix array without
any task holding the corpus.  Every window of ``WINDOW`` words has one anchor,
the smallest hash among its runs of ``ANCHOR`` words, which depends on its
words alone.  Consecutive windows with one anchor make a segment.  Only
(anchor, document, place, hash of the segment) are shuffled at first.  Anchors
of one document are dropped, by an aggregation that is partial before the
shuffle; where all segments at an anchor are equal, their windows repeat as a
whole; the others' distinct segments are fetched once each and go through a
suffix array, in which equal windows are neighbours.  So each window is
compared with all its occurrences, and copies of a segment cost a few bytes
each however many there are.  An anchor with more than ``KINDS`` distinct
segments (a line of boilerplate in many surroundings) doesn't go to one task:
its segments are split by the words of their windows, down to groups of equal
windows, which are counted like copies.

Words are runs of letters and digits, case folded.  Defined results: null and
empty texts and rows without doc_id repeat nothing; rows of one doc_id are one
document, whose own repeats don't count (different texts of it are reported
side by side); ties go to the smallest doc_id; doc_id must be an integer
(other types are refused); extra columns are ignored by
:func:`repeated_passages` and carried by :func:`drop_passages`; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm import textnp as T

WINDOW = 50
ANCHOR = 20
#: Symbols of one suffix array; a bucket that is larger is still taken whole.
SYMBOLS = 200_000
#: Distinct segments of an anchor that still go to one suffix array.
KINDS = 2_000
_PLACE_BITS = 22


# ---------------------------------------------------------------- suffix array


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of a list of integers, by linear grouping."""
    n = len(text)
    if not n:
        return []
    low = min(text) - 1
    text = [*text, low]
    n += 1
    members: list[list[int]] = []
    below: list[int] = []
    above: list[int] = []
    group = [0] * n
    by: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by.setdefault(c, []).append(i)
    for c in sorted(by):
        g = len(members)
        members.append(by[c])
        below.append(g - 1)
        above.append(g + 1)
        for i in by[c]:
            group[i] = g
    above[-1] = -1
    # lists keep members that have left; they are sorted out once, when their group's turn comes
    size = [len(m) for m in members]
    prev = [-1] * n
    done = bytearray(n)
    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if size[g] == 1:
            # the commonest case: one suffix, which points to one other at most
            i = own[0] if len(own) == 1 else next(i for i in own if group[i] == g)
            members[g] = [i]
            done[i] = 1
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0 and size[h := group[j]] > 1:
                new = len(members)
                members.append([j])
                size.append(1)
                size[h] -= 1
                up = above[h]
                below.append(h)
                above.append(up)
                above[h] = new
                if up >= 0:
                    below[up] = new
                group[j] = new
            g = below[g]
            continue
        if len(own) != size[g]:
            own = [i for i in own if group[i] == g]
        own.sort()
        members[g] = own
        for i in own:
            done[i] = 1
        count: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for p, k in count.items():
            h = group[p]
            if size[h] > 1:
                parts.setdefault((h, k), []).append(p)
        touched: dict[int, int] = {}
        # the fewest pointers first, each part right above the one before
        for (h, _), part in sorted(parts.items()) if len(parts) > 1 else parts.items():
            if h not in touched and len(part) == size[h]:
                continue
            at = touched.get(h, h)
            new = len(members)
            members.append(part)
            size.append(len(part))
            size[h] -= len(part)
            up = above[at]
            below.append(at)
            above.append(up)
            above[at] = new
            if up >= 0:
                below[up] = new
            for p in part:
                group[p] = new
            touched[h] = new
        g = below[g]
    # places of the groups, from the smallest on
    g = group[n - 1]
    start = [0] * len(members)
    at = 0
    while g >= 0:
        start[g] = at
        at += size[g]
        g = above[g]
    order = [0] * n
    order[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for r in range(n):
        j = order[r] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            h = group[j]
            order[start[h]] = j
            start[h] += 1
            j = prev[j]
    return order[1:]


def equal_windows(text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A number for each window start, equal just for equal windows, from neighbours in the suffix array."""
    ok = np.zeros(len(text), bool)
    ok[starts] = True
    order = np.array(suffix_array(text.tolist()), np.int64)
    order = order[ok[order]]
    same = np.zeros(len(order), bool)
    view = np.lib.stride_tricks.sliding_window_view(text, window)
    for lo in range(1, len(order), 20_000):
        hi = min(len(order), lo + 20_000)
        same[lo:hi] = (view[order[lo:hi]] == view[order[lo - 1 : hi - 1]]).all(axis=1)
    number = np.zeros(len(text), np.int64)
    number[order] = np.cumsum(~same)
    return number[starts]


# ---------------------------------------------------------------- segments


def _lowest(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    size, step = len(x) - w + 1, 1
    while step * 2 <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:size], x[w - step : w - step + size])


def segments(h: np.ndarray, first: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """anchor, row, at (first window, as a word of its row), n (windows), segment (hash) of all segments of a batch."""
    z = np.zeros(0, np.int64)
    if len(h) < window:
        return {"anchor": z, "row": z, "at": z, "n": z, "segment": z}
    grams = T.rolling(h, anchor)
    keep = np.uint64((1 << 64) - (1 << _PLACE_BITS))
    w, parts = window - anchor + 1, []
    for c in range(0, len(grams) - w + 1, (1 << _PLACE_BITS) - w):
        g = grams[c : c + (1 << _PLACE_BITS) - 1]
        small = _lowest((g & keep) | np.arange(len(g), dtype=np.uint64), w)
        parts.append((small & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64) + c)
    place = np.concatenate(parts)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(place)]
    good = np.arange(len(place)) + window <= first[1:][row]
    s = np.flatnonzero(good)
    if not len(s):
        return {"anchor": z, "row": z, "at": z, "n": z, "segment": z}
    new = np.ones(len(s), bool)
    new[1:] = (place[s[1:]] != place[s[:-1]]) | (s[1:] != s[:-1] + 1)
    a = np.flatnonzero(new)
    n = np.diff(np.append(a, len(s)))
    lo = s[a]
    hi = lo + n + window - 1
    with np.errstate(over="ignore"):
        code = T.mix(T.span_sums(h, lo, hi) + ((hi - lo) * 64 + place[lo] - lo).astype(np.uint64))
    return {"anchor": grams[place[lo]].view(np.int64), "row": row[lo], "at": lo - first[:-1][row[lo]], "n": n, "segment": code.view(np.int64)}


def _routed(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.pieces(batch, "text"):
            x = segments(*T.word_hashes(part.column("text")), window, anchor)
            row = pa.array(x["row"])
            yield pa.record_batch({"anchor": pa.array(x["anchor"]), "doc_id": part.column("doc_id").take(row), "mark": part.column("mark").take(row), "at": pa.array(x["at"].astype(np.int32)), "n": pa.array(x["n"].astype(np.int32)), "segment": pa.array(x["segment"])})


def _fetched(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(anchor, segment, words, skip, code): the words of the wanted segments of the texts, or, at hot anchors, the hash of each of their windows."""
    for batch in batches:
        for part in T.pieces(batch, "text"):
            h, first = T.word_hashes(part.column("text"))
            keys, words, codes = [], [], []
            for i, wanted in enumerate(part.column("wanted").to_pylist()):
                for w in wanted:
                    lo = int(first[i]) + w["at"]
                    x = h[lo : lo + w["n"] + window - 1]
                    if w["hot"]:
                        x = T.rolling(x, window).view(np.int64)
                        codes += [(w["anchor"], w["segment"], k, c) for k, c in enumerate(x.tolist())]
                    else:
                        keys.append((w["anchor"], w["segment"]))
                        words.append(x.view(np.int64))
            offs = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int32)
            n, m = len(keys), len(codes)
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([np.zeros(0, np.int64), *words])))
            yield pa.record_batch(
                {
                    "anchor": pa.array([k[0] for k in keys] + [c[0] for c in codes], pa.int64()),
                    "segment": pa.array([k[1] for k in keys] + [c[1] for c in codes], pa.int64()),
                    "words": pa.concat_arrays([lists, pa.nulls(m, lists.type)]),
                    "skip": pa.array([None] * n + [c[2] for c in codes], pa.int32()),
                    "code": pa.array([None] * n + [c[3] for c in codes], pa.int64()),
                }
            )


def _compared(batches: Iterator[pa.RecordBatch], window: int, symbols: int) -> Iterator[pa.RecordBatch]:
    """(anchor, segment, skip, n, first_doc): runs of windows of a segment that occur in several documents."""
    waiting: list[tuple] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        lengths = np.array([len(w[2]) for w in waiting])
        at = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        words = np.concatenate([w[2] for w in waiting])
        _, rank = np.unique(words, return_inverse=True)
        text = np.zeros(int(lengths.sum()) + len(waiting), np.int64)
        inside = np.ones(len(text), bool)
        inside[at + lengths] = False
        text[inside] = rank + 1
        counts = lengths - window + 1
        which = np.repeat(np.arange(len(waiting)), counts)
        skip = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        number = equal_windows(text, at[which] + skip, window)
        lo, hi = np.array([w[3] for w in waiting]), np.array([w[4] for w in waiting])
        low = np.full(number.max() + 1, np.iinfo(np.int64).max)
        high = np.full(number.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, number, lo[which])
        np.maximum.at(high, number, hi[which])
        first = low[number]
        good = first < high[number]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (first[1:] != first[:-1]) | (good[1:] != good[:-1])
        a = np.flatnonzero(new)
        n = np.diff(np.append(a, len(which)))
        a, n = a[good[a]], n[good[a]]
        return pa.record_batch({"anchor": pa.array([waiting[i][0] for i in which[a]], pa.int64()), "segment": pa.array([waiting[i][1] for i in which[a]], pa.int64()), "skip": pa.array(skip[a].astype(np.int32)), "n": pa.array(n.astype(np.int32)), "first_doc": pa.array(first[a])})

    for batch in batches:
        keys = batch.column("anchor").to_pylist()
        codes = batch.column("segment").to_pylist()
        lists = batch.column("words")
        offs, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        lo, hi = batch.column("lo").to_pylist(), batch.column("hi").to_pylist()
        for i, k in enumerate(keys):
            if k != last and size > symbols:
                yield flush()
                waiting, size = [], 0
            last = k
            waiting.append((k, codes[i], flat[offs[i] : offs[i + 1]], lo[i], hi[i]))
            size += int(offs[i + 1] - offs[i]) + 1
    if waiting:
        yield flush()


# ---------------------------------------------------------------- operator


def _spans(docs: DataFrame, window: int, anchor: int, symbols: int, kinds_at_once: int, tables: scratch.Tables) -> DataFrame:
    """doc_id, mark (of the text), s, e (words), first_doc of runs of windows that occur in several documents; runs overlap."""
    texts = docs.where("doc_id is not null and text is not null").select(T.integer_ids(docs, "doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.shiftright(F.xxhash64("text"), 33).cast("int"))
    found = tables.written(texts.mapInArrow(lambda it: _routed(it, window, anchor), "anchor long, doc_id long, mark int, at int, n int, segment long"), "suffix-segments")
    several = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("segment").alias("a"), F.max("segment").alias("b")).where("lo < hi")
    several = tables.written(several.selectExpr("anchor", "lo", "a = b as alike"), "suffix-anchors")
    # both sides are shuffled tables: a hot anchor's rows are split over tasks when the join is run
    shared = tables.written(found.join(several, "anchor"), "suffix-shared")
    tables.clear(1)
    end = window - 1
    whole = shared.where("alike").selectExpr("doc_id", "mark", "at as s", f"at + n + {end} as e", "lo as first_doc")
    mixed = shared.where("not alike")
    kinds = mixed.groupBy("anchor", "segment").agg(F.min(F.struct("doc_id", "mark", "at", "n")).alias("m"), F.max("doc_id").alias("hi"))
    kinds = tables.written(kinds.selectExpr("anchor", "segment", "m.doc_id as lo", "m.mark as mark", "hi", "m.at as at", "m.n as n"), "suffix-kinds")
    hot = tables.written(kinds.groupBy("anchor").count().where(F.col("count") > kinds_at_once).select("anchor"), "suffix-hot")
    some_hot = not hot.isEmpty()
    kinds = kinds.join(hot.withColumn("hot", F.lit(True)), "anchor", "left").fillna(False, "hot") if some_hot else kinds.withColumn("hot", F.lit(False))
    wanted = kinds.groupBy(F.col("lo").alias("doc_id"), "mark").agg(F.collect_list(F.struct("anchor", "segment", "at", "n", "hot")).alias("wanted"))
    # the texts are shuffled once, for both ways
    fetched = texts.join(wanted, ["doc_id", "mark"]).select("text", "wanted").mapInArrow(lambda it: _fetched(it, window), "anchor long, segment long, words array<long>, skip int, code long")
    ends = kinds.select("anchor", "segment", "lo", "hi")
    if some_hot:
        fetched = tables.written(fetched, "suffix-fetched")
    words = fetched.where("words is not null").select("anchor", "segment", "words").dropDuplicates(["anchor", "segment"]).join(ends, ["anchor", "segment"])
    runs = words.repartition("anchor").sortWithinPartitions("anchor", "segment").mapInArrow(lambda it: _compared(it, window, symbols), "anchor long, segment long, skip int, n int, first_doc long")
    if some_hot:
        each = fetched.where("words is null").select("anchor", "segment", "skip", "code").dropDuplicates(["anchor", "segment", "skip"]).join(ends, ["anchor", "segment"])
        equal = tables.written(each.groupBy("code").agg(F.min("lo").alias("first_doc"), F.max("hi").alias("last")).where("first_doc < last").drop("last"), "suffix-equal")
        runs = runs.union(each.join(equal, "code").select("anchor", "segment", "skip", F.lit(1).alias("n"), "first_doc"))
    partly = mixed.select("anchor", "segment", "doc_id", "mark", "at").join(runs, ["anchor", "segment"]).selectExpr("doc_id", "mark", "at + skip as s", f"at + skip + n + {end} as e", "first_doc")
    return whole.union(partly)


def _merged(spans: DataFrame) -> DataFrame:
    """doc_id, mark, s, e, first_doc: overlapping and adjoining spans of a text as one."""
    order = Window.partitionBy("doc_id", "mark").orderBy("s", "e")
    spans = spans.withColumn("before", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("before") >= F.col("s"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "mark", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("first_doc").alias("first_doc")).drop("run")


def repeated_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, symbols: int = SYMBOLS, kinds: int = KINDS) -> DataFrame:
    """doc_id, start_word, n_words, first_doc_id: the maximal runs of words covered by windows that also occur in another document.

    first_doc_id is the smallest document that has one of the run's windows.
    """
    tables = scratch.Tables(docs.sparkSession)
    runs = _merged(_spans(docs, window, anchor, symbols, kinds, tables))
    out = scratch.written(runs.selectExpr("doc_id", "cast(s as bigint) as start_word", "cast(e - s as bigint) as n_words", "first_doc as first_doc_id"), "suffix-runs")
    tables.clear()
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("_cuts").to_pylist(), strict=True):
            if text and cuts:
                data, offs = T.buffer_of(pa.array([text]))
                starts, _, _ = T.split(T.fold(data), offs, T.ALNUM)
                edges, raw, kept, done = np.append(starts, len(data)), data.tobytes(), [], 0
                for c in sorted(cuts, key=lambda c: c["s"]):
                    kept.append(raw[done : edges[c["s"]]])
                    done = int(edges[c["e"]])
                text = b"".join([*kept, raw[done:]]).decode()
            texts.append(text)
        batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        size = batch.schema.get_field_index("n_chars")
        if size >= 0 and pa.types.is_integer(batch.schema.field(size).type):
            counts = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(size).type)
            had = pa.array([bool(c) for c in batch.column("_cuts").to_pylist()])
            batch = batch.set_column(size, batch.schema.field(size), pc.if_else(had, counts, batch.column(size)))
        yield batch.drop_columns(["_cuts"])


def drop_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, symbols: int = SYMBOLS, kinds: int = KINDS) -> DataFrame:
    """The rows with all words cut out that windows cover which a document with a smaller id has too; every row stays, if only with an empty text."""
    names, docs = docs.columns, T.plain_names(docs)
    tables = scratch.Tables(docs.sparkSession)
    cuts = _merged(_spans(docs, window, anchor, symbols, kinds, tables).where("first_doc < doc_id"))
    cuts = cuts.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("s", "e")).alias("_cuts")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "_cuts")
    cuts = scratch.written(cuts, "suffix-cuts")
    tables.clear()
    mark = F.shiftright(F.xxhash64(docs["text"].cast("string")), 33).cast("int")
    joined = docs.join(cuts, (docs["doc_id"] == cuts["_id"]) & (mark == cuts["_mark"]), "left").select(*docs.columns, "_cuts")
    return joined.mapInArrow(_cut, docs.schema).toDF(*names)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
