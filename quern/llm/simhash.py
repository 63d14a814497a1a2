"""SimHash near-duplicates with a Gray-order hierarchical index.

A document's fingerprint has 256 bits: the majority, bit by bit, over the
hashes of its distinct words (letters and digits, folded).  Two documents are
near-duplicates if their fingerprints differ in ``MAX_BITS`` bits at most, and
groups are the connected components of that relation.

Routing.  Equal fingerprints are joined first.  The others are shuffled to a
few coarse buckets by sampled bits, of ``BUCKET`` members or so; how often each
is copied grows with the number of fingerprints to the power 0.3 from some
millions on, and not at all before.  Buckets that hold far more than their share
are found on a sample of fingerprints.  Where one group makes most of such a
bucket (copies with small changes, which no bits can part), its members are
linked to a common leader and spread over salts, and all others go to every
salt, so that each still meets each; other large buckets are parted by further
bits.

Search.  Inside a bucket, several orderings of the bits are taken in turn.
Members are sorted by the Gray rank of their reordered codes, so that
neighbours share bit patterns: runs that share the leading bits are the cells
that are searched; in a cell, ``FANOUT`` members make a node with the mask of
the bits that they all share, nodes make upper nodes.  A query adds up its
differences from the shared patterns on its way down (each bit is counted at
the highest node that has it) and drops a whole group once the sum passes the
limit.  A pair *at* the limit meets in some cell of some bucket with
probability ``RECALL`` at least, closer pairs nearly always, for any number of
documents.

There is no cap on partners, and pairs aren't listed: neighbours in Gray order
are united first, and members of a cell's largest component are compared with
the others only, so that a group of any size costs one link a member, which
has the same components.

Defined results: null texts and texts without words are never duplicates;
rows with a null doc_id are never reported or removed; repeated rows of one
doc_id are one document, of which :func:`drop_near_duplicates` keeps the first
row in the order of all its columns; the smallest doc_id stays of each group;
doc_id must be an integer (other types are refused); extra columns are carried
along; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm import textnp as T

LANES = 4
BITS = 64 * LANES
MAX_BITS = 48
RECALL = 0.9
#: Members of a coarse bucket, and of a cell within it, that are aimed at.
BUCKET = 1 << 20
CELL = 128
#: A bucket of so many times its share is parted.
HOT = 4
#: Buckets there are at least, so that all cores have work.
LEAST_BITS = 5
FANOUT = 8
_FRONTIER = 1 << 20
_SALT = T.mix(np.arange(1, LANES + 1, dtype=np.uint64))
_COLS = [f"f{i}" for i in range(LANES)]


# ---------------------------------------------------------------- fingerprints


def fingerprint(h: np.ndarray) -> np.ndarray:
    """LANES unsigned words from the hashes of a document's words."""
    u = np.unique(h)
    with np.errstate(over="ignore"):
        lanes = T.mix(u[:, None] ^ _SALT[None, :])
    bits = np.unpackbits(lanes.astype(">u8").view(np.uint8), axis=1)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(bits), 255):
        total += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(u)).view(">u8").astype(np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.pieces(batch, "text"):
            h, first = T.word_hashes(part.column("text"))
            rows = np.flatnonzero(np.diff(first) > 0)
            out = np.zeros((len(rows), LANES), np.uint64)
            for k, r in enumerate(rows.tolist()):
                out[k] = fingerprint(h[first[r] : first[r + 1]])
            signed = out.view(np.int64)
            yield pa.record_batch({"doc_id": part.column("doc_id").take(pa.array(rows)), **{c: pa.array(signed[:, i]) for i, c in enumerate(_COLS)}})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document that has words and an id."""
    return docs.where("doc_id is not null and text is not null").select(T.integer_ids(docs, "doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, " + ", ".join(f"{c} long" for c in _COLS))


# ---------------------------------------------------------------- index


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Position of each code (rows of words, most significant first) in Gray order, as words of the same shape."""
    x = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    parity = np.cumsum(x & np.uint64(1), axis=1) - (x & np.uint64(1))
    odd = (parity & np.uint64(1)).astype(bool)
    x[odd] = ~x[odd]
    return x


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int32)


class GrayIndex:
    """Hierarchy of shared masked bit patterns over fingerprints in Gray order."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT):
        rank = gray_rank(codes)
        self.order = np.lexsort(tuple(rank[:, i] for i in reversed(range(rank.shape[1]))))
        self.codes, self.fanout = codes[self.order], fanout
        # level 0 are the members themselves, sharing every bit with themselves
        pattern, mask = self.codes, np.full_like(self.codes, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.levels = [(pattern, mask)]
        while len(pattern) > 1:
            at = np.arange(0, len(pattern), fanout)
            every = np.bitwise_and.reduceat(pattern & mask, at)
            some = np.bitwise_or.reduceat(pattern & mask, at)
            shared = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
            pattern, mask = every & shared, shared
            self.levels.append((pattern, mask))

    def near(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, member) of all members within ``limit`` bits of the queries (rows of codes)."""
        top = len(self.levels) - 1
        pattern, mask = self.levels[top]
        q = np.repeat(np.arange(len(queries)), len(pattern))
        node = np.tile(np.arange(len(pattern)), len(queries))
        acc = np.zeros(len(q), np.int64)
        upper = np.zeros_like(mask)
        parent = np.zeros(len(q), np.int64)
        for level in range(top, -1, -1):
            pattern, mask = self.levels[level]
            if level < top:
                q, parent, acc = np.repeat(q, self.fanout), np.repeat(node, self.fanout), np.repeat(acc, self.fanout)
                node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                ok = node < len(pattern)
                q, parent, node, acc = q[ok], parent[ok], node[ok], acc[ok]
                upper = self.levels[level + 1][1]
            for lane in range(self.codes.shape[1]):
                new = mask[node, lane] & ~upper[parent, lane] if level < top else mask[node, lane]
                acc = acc + np.bitwise_count((queries[q, lane] ^ pattern[node, lane]) & new)
                ok = acc <= limit
                if not ok.all():
                    q, node, acc = q[ok], node[ok], acc[ok]
                    parent = parent[ok] if level < top else parent[: len(q)]
        return q, self.order[node]


def united(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest member of each component) with the links i, j added."""
    while True:
        a, b = low[i], low[j]
        apart = a != b
        if not apart.any():
            return low
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = low.copy()
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while not ((up := low[low]) == low).all():
            low = up


def _cell(codes: np.ndarray, low: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a cell, in blocks; members of its largest component are targets only, as links among them would add nothing."""
    values, back, many = np.unique(low, return_inverse=True, return_counts=True)
    if len(values) == 1:
        return
    queries = np.flatnonzero(back != np.argmax(many))
    if len(codes) <= 2 * FANOUT:
        i, j = np.nonzero(np.bitwise_count(codes[queries, None] ^ codes[None]).sum(axis=2, dtype=np.int32) <= limit)
        yield queries[i], j
        return
    index, block = GrayIndex(codes), max(1, _FRONTIER // len(codes))
    for k in range(0, len(queries), block):
        i, j = index.near(codes[queries[k : k + block]], limit)
        yield queries[k + i], j


def _reordered(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The codes with their bits in another order."""
    parts = [np.zeros((0, codes.shape[1]), np.uint64)]
    for k in range(0, len(codes), 65536):
        flags = np.unpackbits(np.ascontiguousarray(codes[k : k + 65536].astype(">u8")).view(np.uint8), axis=1)
        parts.append(np.ascontiguousarray(np.packbits(flags[:, order], axis=1)).view(">u8").astype(np.uint64))
    return np.concatenate(parts)


def _meet(bits: int, limit: int) -> float:
    """Chance that a pair at the limit is alike in so many sampled bits."""
    p = 1.0
    for k in range(bits):
        p *= (BITS - limit - k) / (BITS - k)
    return p


def _times(p: float, recall: float) -> int:
    return 1 if p >= 1 else math.ceil(math.log(1 - min(recall, 0.999)) / math.log(1 - p))


def plan_tables(n: int, limit: int = MAX_BITS, recall: float = RECALL, bucket: int | None = None) -> tuple[int, int, float]:
    """(bits, tables, recall within a bucket) for n fingerprints: the fewest copies of a fingerprint, counting a round within a bucket as a quarter of one."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, n) / (bucket or BUCKET))))
    outer = _meet(bits, limit)
    inner = _meet(max(0, math.ceil(math.log2(max(1, n) / 2**bits / CELL))), limit)
    best = None
    for rounds in range(1, _times(inner, 0.95) + 1):
        within = 1 - (1 - inner) ** rounds
        tables = _times(outer * within, recall)
        cost = tables * (1 + rounds / 4)
        if best is None or cost < best[0]:
            best = (cost, tables, within)
    return bits, best[1], best[2]


def links(codes: np.ndarray, limit: int, recall: float, seed: int = 0, cell: int | None = None, depth: int = 0, led: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of the component of each member of a bucket (those that are led are in one from the start); a pair at the limit is found with probability ``recall`` at least."""
    n, cell = len(codes), cell or CELL
    low = np.arange(n)
    if led is not None and led.any():
        low[led] = np.flatnonzero(led)[0]
    bits = math.ceil(math.log2(n / cell)) if n > 2 * cell else 0
    # a cell that is parted again finds a pair with this probability only, which more rounds make up for
    again = 0.97
    random = np.random.default_rng((seed, depth))
    for _ in range(_times(_meet(bits, limit) * again, recall) if bits else 1):
        moved = _reordered(codes, random.permutation(BITS))
        # in Gray order, members with the same leading bits stand together, and close ones side by side: that unites large groups at once
        by = np.argsort(gray_rank(moved[:, :1])[:, 0], kind="stable")
        for step in (1, 2):
            a, b = by[:-step], by[step:]
            near = _ones(moved[a] ^ moved[b]) <= limit
            low = united(low, a[near], b[near])
        lead = moved[by, 0] >> np.uint64(64 - bits) if bits else np.zeros(n, np.uint64)
        at = np.append(np.flatnonzero(np.append(True, lead[1:] != lead[:-1])), n) if n else np.zeros(1, np.int64)
        left, right, waiting = [], [], 0
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            some = by[a:b]
            if b - a > 128 * cell and depth < 1 and bits:
                inner = links(moved[some], limit, again, seed + 1, cell, depth + 1)
                found = [(np.arange(b - a), inner)]
            elif b - a > 1:
                found = _cell(moved[some], low[some], limit)
            else:
                continue
            for i, j in found:
                left.append(some[i])
                right.append(some[j])
                waiting += len(i)
                if waiting > _FRONTIER:
                    low = united(low, np.concatenate(left), np.concatenate(right))
                    left, right, waiting = [], [], 0
        if left:
            low = united(low, np.concatenate(left), np.concatenate(right))
    return low


def _route(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int, key: str | None = None) -> Iterator[pa.RecordBatch]:
    """A copy for each table, with its bucket; with ``key``, within the buckets that the rows have already."""
    chosen = [np.random.default_rng((seed, t)).permutation(BITS)[:bits] for t in range(tables)]
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            codes = np.stack([np.asarray(part.column(c)).view(np.uint64) for c in _COLS], axis=1)
            flags = np.unpackbits(np.ascontiguousarray(codes.astype(">u8")).view(np.uint8), axis=1)
            old = np.asarray(part.column(key)).view(np.uint64) if key else None
            for t, at in enumerate(chosen):
                value = np.zeros(len(codes), np.uint64)
                for b in at:
                    value = value << np.uint64(1) | flags[:, b]
                with np.errstate(over="ignore"):
                    value = value * np.uint64(tables) + np.uint64(t)
                    if old is not None:
                        value = T.mix(old * np.uint64(0x9E3779B97F4A7C15) + value)
                yield pa.record_batch({"bucket": pa.array(value.view(np.int64)), "doc_id": part.column("doc_id"), **{c: part.column(c) for c in _COLS}})


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal key, across batches."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(key))
        cut = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if kept and k[a] != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
            last = k[a]
    if kept:
        yield pa.Table.from_batches(kept)


def _join(batches: Iterator[pa.RecordBatch], limit: int, recall: float, cell: int | None = None) -> Iterator[pa.RecordBatch]:
    for group in _runs(batches, "bucket"):
        if group.num_rows > 1:
            group = group.sort_by("doc_id")
            codes = np.stack([group.column(c).to_numpy().view(np.uint64) for c in _COLS], axis=1)
            low, ids = links(codes, limit, recall, 7919, cell, led=group.column("led").to_numpy()), group.column("doc_id").to_numpy()
            moved = np.flatnonzero(ids[low] != ids)
            yield pa.record_batch({"u": pa.array(ids[moved]), "v": pa.array(ids[low[moved]])})


_WIDE = "doc_id long, " + ", ".join(f"{c} long" for c in _COLS)


def _distance(other: str) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"{other}.{c}"))) for c in _COLS))


def near_pairs(codes: DataFrame, n: int, limit: int = MAX_BITS, bucket: int | None = None, cell: int | None = None) -> DataFrame:
    """Edges (u, v), u > v, that connect the distinct fingerprints within the limit."""
    bucket = bucket or BUCKET
    # a little more than asked for, as parted buckets and cells lose a few pairs
    bits, tables, within = plan_tables(n, limit, 1 - 0.8 * (1 - RECALL), bucket)
    parts, found = _parted(codes, bits, tables, 7919, max(HOT * bucket, HOT * n >> bits), limit)
    for routed in parts:
        found.append(routed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _join(it, limit, within, cell), "u long, v long"))
    return reduce(DataFrame.union, found).distinct()


def _parted(codes: DataFrame, bits: int, tables: int, seed: int, most: int, limit: int, key: str | None = None, depth: int = 0) -> tuple[list[DataFrame], list[DataFrame]]:
    """(routed copies, edges to leaders); buckets hold ``most`` members or so, by an estimate that changes no result."""
    route = lambda rows: rows.mapInArrow(lambda it: _route(it, bits, tables, seed, key), "bucket long, " + _WIDE)
    routed = route(codes).withColumn("led", F.lit(False))
    # one fingerprint in 64 is counted
    share = route(codes.where("pmod(xxhash64(f0, f1, f2, f3), 64) = 0"))
    hot = scratch.written(share.groupBy("bucket").agg((F.count("*") * 64).alias("size")).where(F.col("size") > most), "simhash-hot")
    if hot.isEmpty():
        return [routed], []
    heat, sample = routed.join(hot, "bucket"), share.join(hot, "bucket")
    # of eight members drawn at random, the one with most of the sample around it leads
    drawn = [F.min_by(F.struct("doc_id", *_COLS), F.xxhash64("doc_id", F.lit(k))).alias(f"_{k}") for k in range(8)]
    leaders = sample.groupBy("bucket").agg(*drawn).select("bucket", F.explode(F.array(*(F.col(f"_{k}") for k in range(8)))).alias("leader"))
    around = sample.join(leaders, "bucket").groupBy("bucket", "leader").agg(F.count_if(_distance("leader") <= limit).alias("near"))
    best = scratch.written(around.groupBy("bucket").agg(F.max_by("leader", F.struct("near", "leader.doc_id")).alias("leader")), "simhash-leaders")
    heat = heat.join(best, "bucket").withColumn("led", _distance("leader") <= limit)
    sizes = heat.groupBy("bucket").agg(F.count("*").alias("all"), F.count_if(~F.col("led")).alias("others"))
    sizes = scratch.written(sizes.withColumn("salts", F.ceil(F.col("all") / most).cast("int")).withColumn("spread", F.col("others") * F.col("salts") <= 2 * F.col("all")), "simhash-sizes")
    heat = heat.join(sizes, "bucket")
    salt = F.when(F.col("led"), F.array(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    spread = heat.where("spread").withColumn("salt", F.explode(salt)).select(F.xxhash64("bucket", "salt").alias("bucket"), "doc_id", *_COLS, "led")
    edges = heat.where("spread and led").select(F.greatest("doc_id", "leader.doc_id").alias("u"), F.least("doc_id", "leader.doc_id").alias("v")).where("u <> v")
    parts = [routed.join(hot, "bucket", "left_anti").select("bucket", "doc_id", *_COLS, "led"), spread]
    rest = heat.where("not spread").select("bucket", "doc_id", *_COLS)
    if sizes.where("not spread").isEmpty():
        return parts, [edges]
    if depth == 2:
        return [*parts, rest.withColumn("led", F.lit(False))], [edges]
    more, copies, _ = plan_tables(most * 64, limit, 0.97, most // HOT or 1)
    inner, links_ = _parted(rest, more, copies, seed + 1, most, limit, "bucket", depth + 1)
    return [*parts, *inner], [edges, *links_]


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each id's component, for all ids but the roots.

    Alternating large and small stars; each round is written to the shared folder and the one before deleted.
    """
    tables = scratch.Tables(edges.sparkSession)
    e = tables.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    sign = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = tables.written(e, "stars")
        tables.clear(1)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == sign:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        sign = now


def duplicates(docs: DataFrame, limit: int = MAX_BITS, bucket: int | None = None, cell: int | None = None) -> DataFrame:
    """doc_id, duplicate_of, group_size: each document but the smallest id of a group of near-duplicates."""
    tables = scratch.Tables(docs.sparkSession)
    codes = tables.written(fingerprints(docs).distinct(), "simhash")
    same = codes.groupBy(*_COLS).agg(F.min("doc_id").alias("doc_id"))
    same = tables.written(same, "simhash-distinct")
    # an id that repeats with another text brings its groups together
    edges = near_pairs(same, same.count(), limit, bucket, cell).union(codes.join(same.withColumnRenamed("doc_id", "v"), _COLS).where("doc_id <> v").select(F.col("doc_id").alias("u"), "v"))
    found = components(edges)
    size = found.groupBy("root").agg((F.count("*") + 1).alias("group_size"))
    out = scratch.written(found.join(size, "root").select(F.col("id").alias("doc_id"), F.col("root").alias("duplicate_of"), "group_size"), "simhash-groups")
    tables.clear()
    return out


def drop_near_duplicates(docs: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """The rows without the later documents of each group, with all their columns."""
    names, docs = docs.columns, T.plain_names(docs)
    gone = duplicates(docs, limit).select("doc_id")
    kept = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = scratch.written(again, "repeated-ids")
    if again.isEmpty():
        return kept.toDF(*names)
    # the least row of all in the order of its columns, whatever they hold
    sortable = F.struct(*(F.to_json(F.struct(c)).alias(f"_{k}") for k, c in enumerate(docs.columns)))
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), sortable).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(once).toDF(*names)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
