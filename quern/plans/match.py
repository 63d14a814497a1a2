"""Match queries over postings: analysis of the query, scoring, filters, pages, formats."""

from __future__ import annotations

from dataclasses import dataclass
from dataclasses import field as _field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.functions import dates, money
from quern.mapping import Field, apart
from quern.operators import geo, ordering
from quern.sources import store


#: Tokens that are sorted at a time in a worker, whole rows; a longer row is sorted by itself.
CHUNK = 1_000_000


def _rows_postings(tokens, keys):
    """Arrow batches (term, doc_id, tf, positions) of one batch of token lists: a sort of (row, term) for each chunk of rows."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        lengths = np.diff(ends[at:to], prepend=base)
        values = tokens.slice(at, to - at).flatten().dictionary_encode(null_encoding="encode")
        row = np.repeat(np.arange(to - at), lengths)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        code = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        both = row * max(len(values.dictionary), 1) + code
        order = np.argsort(both, kind="stable")
        both = both[order]
        begins = np.flatnonzero(np.diff(both, prepend=-1))
        first = order[begins]
        tf = np.diff(begins, append=len(both))
        positions = pa.ListArray.from_arrays(pa.array(np.append(begins, len(both)).astype(np.int32)), pa.array(place[order]))
        yield pa.RecordBatch.from_arrays([values.dictionary.take(pa.array(code[first])), keys.take(pa.array(row[first] + at)), pa.array(tf.astype(np.int64)), positions], ["term", "doc_id", "tf", "positions"])
        at = to


def field_postings(rows: DataFrame, key: str, field: Field, analyzers: dict | None = None) -> DataFrame:
    """term, doc_id, tf, positions of one field, each row by itself: nothing is shuffled. For rows whose keys differ."""

    def local(batches):
        for b in batches:
            yield from _rows_postings(b.column(1), b.column(0))

    flat = rows.select(F.col(key).alias("doc_id"), field.tokens(analyzers).alias("tokens"))
    return flat.mapInArrow(local, f"term string, doc_id {flat.schema['doc_id'].dataType.simpleString()}, tf long, positions array<int>")


def postings(rows: DataFrame, key: str, fields: list[Field], positions: bool = True, analyzers: dict | None = None) -> DataFrame:
    """field, term, doc_id, tf, positions of the indexed fields. Only rows that share their key with others are shuffled."""
    alone, many, _ = apart(rows, key)
    columns = ["field", "term", "doc_id", "tf", *(["positions"] if positions else [])]
    parts = [field_postings(alone, key, f, analyzers).withColumn("field", F.lit(f.name)).select(*columns) for f in fields]
    if many is not None:
        each = F.array(*(F.struct(F.lit(f.name).alias("field"), f.tokens(analyzers).alias("tokens")) for f in fields))
        flat = many.select(F.col(key).alias("doc_id"), F.explode(each).alias("p")).select("doc_id", "p.field", F.posexplode("p.tokens").alias("pos", "term"))
        parts.append(flat.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")).select(*columns))
    return reduce(DataFrame.unionByName, parts)


def occurrences(rows: DataFrame, key: str, fields: list[Field], terms: list[str]) -> DataFrame:
    """As :func:`postings`, for a few terms only: other tokens are dropped before anything is shuffled."""
    wanted = sorted(set(terms))
    parts = F.array(*(F.struct(F.lit(f.name).alias("field"), F.filter(f.tokens(), lambda t: t.isin(wanted)).alias("tokens")) for f in fields))
    flat = rows.select(F.col(key).alias("doc_id"), F.explode(parts).alias("p")).select("doc_id", "p.field", F.explode("p.tokens").alias("term"))
    return flat.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"))


class Scan:
    """What a query needs of a table's texts, written once: tokenising is dear, and scores use hits, document frequencies and lengths.

    ``n`` is the number of rows; rows that share a key are one document.
    """

    def __init__(self, rows: DataFrame, key: str, fields: list[Field], terms: list[str]):
        spark, wanted = rows.sparkSession, sorted(set(terms))
        each = [f"_tokens{i}" for i in range(len(fields))]
        tokens = rows.select(F.col(key).alias("doc_id"), *(f.tokens().alias(c) for f, c in zip(fields, each)))

        def of(field: Field, c: str) -> Column:
            found = F.coalesce(F.filter(c, lambda t: t.isin(wanted)), F.array().cast("array<string>"))
            return F.transform(found, lambda t: F.struct(F.lit(field.name).alias("field"), t.alias("term")))

        hits = F.concat(*map(of, fields, each))
        length = reduce(Column.__add__, (F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0).cast("long") for c in each))
        path = store.new_folder(spark, "scan")
        tokens.select("doc_id", length.alias("length"), hits.alias("hits")).write.parquet(path)
        self.rows = spark.read.parquet(path)
        self.n = self.rows.count()

    def occurrences(self) -> DataFrame:
        """field, term, doc_id, tf."""
        return self.rows.select("doc_id", F.inline("hits")).groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"))

    def lengths(self) -> DataFrame:
        """doc_id, length of the documents that have tokens."""
        return self.rows.where("length > 0").groupBy("doc_id").agg(F.sum("length").alias("length"))


def document_frequencies(rows: DataFrame, key: str, field: Field) -> DataFrame:
    """term, df, idf of all terms of a field. Documents with a key of their own are counted where they are; only repeated keys are shuffled."""
    alone, many, n = apart(rows, key)
    terms = alone.select(F.explode(F.array_distinct(field.tokens())).alias("term"))
    if many is not None:
        terms = terms.unionByName(many.select(F.col(key), F.explode(field.tokens()).alias("term")).distinct().select("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(float(max(n, 1))) / F.col("df")))


def merge(*parts: DataFrame) -> DataFrame:
    """Postings of several batches as one."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("field", "term", "doc_id").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def term_statistics(found: DataFrame, n_docs: int) -> DataFrame:
    """field, term, df, idf."""
    return found.groupBy("field", "term").agg(F.count_distinct("doc_id").alias("df")).withColumn("idf", F.log(F.lit(float(max(n_docs, 1))) / F.col("df")))


def expand(terms: list[str], synonyms: DataFrame | None) -> list[list[str]]:
    """One clause for each distinct term: itself and the terms of its groups."""
    distinct = list(dict.fromkeys(terms))
    if synonyms is None or not distinct:
        return [[t] for t in distinct]
    groups = synonyms.where(F.col("term").isin(distinct)).select(F.col("term").alias("base"), "group_id")
    # a query's own synonyms only
    pairs = groups.join(synonyms, "group_id").select("base", "term").distinct().collect()
    return [sorted({t, *(r["term"] for r in pairs if r["base"] == t)}) for t in distinct]


def score(found: DataFrame, clauses: list[list[str]], n_docs: int, weights: dict[str, float] | None = None, operator: str = "and", scoring: str = "tfidf", dictionary: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """doc_id, score of the documents that match.

    ``tfidf`` sums weight * tf * ln(N / df), ``dictionary`` takes the idf from a
    dictionary (5 where it has none), ``bm25`` needs ``lengths`` (doc_id, length).
    """
    if operator not in ("and", "or"):
        raise QueryError(f"operator {operator!r}")
    number = F.coalesce(*(F.when(F.col("term").isin(c), F.lit(i)) for i, c in enumerate(clauses)))
    hits = found.where(F.col("term").isin(sorted({t for c in clauses for t in c})))
    if scoring == "dictionary":
        if dictionary is None:
            raise QueryError("this scoring needs a dictionary")
        idf = dictionary.where(F.col("word").isin(sorted({t for c in clauses for t in c}))).groupBy(F.col("word").alias("term")).agg(F.max("idf").alias("idf"))
        hits = hits.join(F.broadcast(idf), "term", "left").withColumn("idf", F.coalesce("idf", F.lit(5.0)))
    else:
        # at most a row for each field and query term
        hits = hits.join(F.broadcast(term_statistics(hits, n_docs)), ["field", "term"])
    weight = F.coalesce(*(F.when(F.col("field") == f, F.lit(float(w))) for f, w in weights.items()), F.lit(1.0)) if weights else F.lit(1.0)
    value = F.col("tf") * F.col("idf")
    if scoring == "bm25":
        if lengths is None:
            raise QueryError("this scoring needs the documents' lengths")
        mean = lengths.agg(F.avg("length").alias("mean"))
        hits = hits.join(lengths, "doc_id").crossJoin(F.broadcast(mean))
        idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        value = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("mean")))
    grouped = hits.withColumn("clause", number).groupBy("doc_id").agg(F.sum(weight * value).alias("score"), F.count_distinct("clause").alias("n"))
    if operator == "and":
        grouped = grouped.where(F.col("n") == len(clauses))
    return grouped.select("doc_id", "score")


def condition(spec: dict) -> Column:
    """``{field: value | [values] | {gte, gt, lte, lt}}`` or ``{field: {polygon: [...]}}`` on [lat, lon] arrays; all must hold."""
    tests = [F.lit(True)]
    signs = {"gte": lambda c, v: c >= v, "gt": lambda c, v: c > v, "lte": lambda c, v: c <= v, "lt": lambda c, v: c < v}
    for name, want in spec.items():
        c = F.col(name)
        if isinstance(want, dict):
            for k, v in want.items():
                if k == "polygon":
                    shape = F.array(*(F.array(*(F.lit(float(x)) for x in p)) for p in v))
                    tests.append(geo.in_polygon(shape, c[0], c[1]))
                elif k in signs:
                    tests.append(signs[k](c, F.lit(v)))
                else:
                    raise QueryError(f"unknown filter {k!r}")
        elif isinstance(want, (list, tuple, set)):
            tests.append(c.isin(list(want)))
        else:
            tests.append(c == F.lit(want))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def formatted(rows: DataFrame, formats: dict[str, dict] | None) -> DataFrame:
    """Fields written as dates or amounts; unknown fields are skipped."""
    for name, f in (formats or {}).items():
        if name not in rows.columns:
            continue
        if f.get("type") == "date":
            rows = rows.withColumn(name, dates.format_epoch(name, f.get("format", "Y-m-d")))
        elif f.get("type") == "chinesemoney":
            rows = rows.withColumn(name, money.chinese_money(name, f.get("mode", "compat")))
        else:
            raise QueryError(f"unknown format {f!r}")
    return rows


@dataclass
class Match:
    """One match query in the nested form ``{"match": {"field": {"name", "query"}, "list_rows", "page", "_source", "formatter"}}``."""

    field: list[str]
    query: str
    page: int = 1
    rows: int = 10
    source: list[str] | None = None
    formatter: dict = _field(default_factory=dict)
    filter: dict = _field(default_factory=dict)
    operator: str = "and"
    scoring: str = "tfidf"

    @classmethod
    def of(cls, spec: dict, page: int | None = None, rows: int | None = None) -> Match:
        try:
            m = spec["match"]
            name = m["field"]["name"]
            return cls(
                [name] if isinstance(name, str) else list(name),
                m["field"]["query"],
                int(page or m.get("page", 1)),
                int(rows or m.get("list_rows", 10)),
                m.get("_source"),
                m.get("formatter") or {},
                m.get("filter") or {},
                m.get("operator", "and"),
                m.get("scoring", "tfidf"),
            )
        except (KeyError, TypeError, ValueError) as e:
            raise QueryError(f"not a match query: {e}") from e


def best(scored: DataFrame, page: int = 1, rows: int = 10) -> DataFrame:
    """A page by score; ties by doc_id."""
    return ordering.page(scored.orderBy(F.desc("score"), "doc_id"), page, rows)
