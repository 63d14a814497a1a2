"""A full-text index as a folder of Parquet tables.

``docs/`` holds the stored fields and ``blocks/`` the inverted index, both in
batches that are appended and, at compaction, merged; posting blocks are
partitioned by field and sorted by term, so that a query reads the row groups
of its terms.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import IndexError_
from quern.mapping import KEYS, Mapping, fast_mapping
from quern.operators import analysis, blocks, segment
from quern.plans import match as M
from quern.sources import store


class Index:
    def __init__(self, spark: SparkSession, folder: str, synonyms: DataFrame | None = None, dictionary: DataFrame | None = None):
        """``dictionary`` (column ``word``) is what the analyzer ``segment`` cuts Han text by; without one, each character is a token."""
        self.spark, self.folder, self.synonyms, self.analyzers = spark, folder.rstrip("/"), synonyms, {}
        if dictionary is not None:
            cut = segment.segmenter(segment.load(dictionary))
            self.analyzers["segment"] = lambda c: F.transform(cut(c), lambda t: F.lower(t))

    # ---------------------------------------------------------------- life cycle

    def exists(self) -> bool:
        return store.exists(self.spark, f"{self.folder}/meta.json")

    def delete(self) -> None:
        store.delete(self.spark, self.folder)

    def create(self, mapping: Mapping | dict) -> None:
        if self.exists():
            raise IndexError_(f"{self.folder} exists")
        mapping = mapping if isinstance(mapping, Mapping) else Mapping.of(mapping)
        self._save({"mapping": json.loads(mapping.to_json()), "docs": [], "postings": []})

    def create_fast(self, key: str = "Int_Incremental") -> None:
        """Fast mode: no mapping to write, rows are (primarykey, text)."""
        self.create(fast_mapping("fast", key))

    def _meta(self) -> dict:
        text = store.read_text(self.spark, f"{self.folder}/meta.json")
        if text is None:
            raise IndexError_(f"no index in {self.folder}")
        return json.loads(text)

    def _save(self, meta: dict) -> None:
        store.write_text(self.spark, f"{self.folder}/meta.json", json.dumps(meta, ensure_ascii=False))

    @property
    def mapping(self) -> Mapping:
        return Mapping.of(self._meta()["mapping"])

    # ---------------------------------------------------------------- writing

    def add(self, rows: DataFrame) -> None:
        """Stores a batch; keys that the index has already are left out."""
        meta = self._meta()
        mapping = Mapping.of(meta["mapping"])
        stored = mapping.store(rows, self.docs().select(mapping.key.name) if meta["docs"] else None)
        name = f"docs-{len(meta['docs']):06d}"
        store.write(stored, f"{self.folder}/{name}")
        meta["docs"].append(name)
        self._save(meta)

    def build(self) -> None:
        """Indexes the batches that have no postings yet."""
        meta = self._meta()
        mapping = Mapping.of(meta["mapping"])
        for name in meta["docs"][len(meta["postings"]) :]:
            docs = self._spread(self.spark.read.parquet(f"{self.folder}/{name}"))
            target = name.replace("docs", "blocks")
            for f in mapping.indexed:
                # keys differ, so each document's postings are made where it is read: a sorted segment for each task
                self._write_postings(blocks.of(docs, mapping.key.name, f, self.analyzers), target, f.name)
            meta["postings"].append(target)
        self._save(meta)

    def _spread(self, rows: DataFrame) -> DataFrame:
        """Over the cores, if the reader parts the rows in fewer tasks than there are cores; so little is moved."""
        wide = self.spark.sparkContext.defaultParallelism
        return rows.repartition(wide) if rows._jdf.queryExecution().toRdd().getNumPartitions() < wide else rows

    def _write_postings(self, found: DataFrame, name: str, field: str) -> None:
        # one folder a field, as partitionBy names it; the rows then are sorted by the term's first bytes, not by a constant
        at = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(field)
        found.sortWithinPartitions("term", "first").write.mode("overwrite").parquet(f"{self.folder}/{name}/field={at}")

    def compact(self) -> None:
        """One batch of documents and one of postings instead of many."""
        meta = self._meta()
        if len(meta["postings"]) != len(meta["docs"]):
            raise IndexError_("there are batches without postings; build first")
        if len(meta["docs"]) < 2:
            return
        docs, posts = f"docs-merged-{len(meta['docs'])}", f"blocks-merged-{len(meta['docs'])}"
        store.write(self.docs(), f"{self.folder}/{docs}")
        for f in self.mapping.indexed:
            # a key is in one batch only, so nothing is to be added up; by range with the blocks' least key as the last column: a
            # term that most documents have is split over many tasks and files
            found = self._blocks().where(F.col("field") == f.name).drop("field")
            self._write_postings(found.repartitionByRange("term", "first"), posts, f.name)
        old = meta["docs"] + meta["postings"]
        meta["docs"], meta["postings"] = [docs], [posts]
        self._save(meta)
        for name in old:
            store.delete(self.spark, f"{self.folder}/{name}")

    # ---------------------------------------------------------------- reading

    def docs(self) -> DataFrame:
        names = self._meta()["docs"]
        if not names:
            raise IndexError_("the index has no rows")
        return self.spark.read.parquet(*(f"{self.folder}/{n}" for n in names))

    def _blocks(self) -> DataFrame:
        names = self._meta()["postings"]
        if not names:
            raise IndexError_("the index isn't built")
        if old := [n for n in names if not n.startswith("blocks")]:
            raise IndexError_(f"{old} have a row for each posting, as earlier versions wrote them; build the index anew")
        schema = f"{blocks.schema(KEYS[self.mapping.key.primarykey_type])}, field string"
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{n}") for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def postings(self, terms: list[str] | None = None, positions: bool = True) -> DataFrame:
        """field, term, doc_id, tf and, unless they aren't asked for, positions; of some terms only the row groups that may have them are read."""
        found = self._blocks()
        return blocks.postings(found if terms is None else found.where(F.col("term").isin(terms)), positions)

    def _scored(self, q: M.Match) -> DataFrame:
        mapping = self.mapping
        fields = {f.name: f for f in mapping.indexed}
        if missing := [f for f in q.field if f not in fields]:
            raise IndexError_(f"not indexed: {missing}")
        analyzer = fields[q.field[0]].analyzer if fields[q.field[0]].type == "text" else "keyword"
        row = self.spark.createDataFrame([(q.query,)], "q string").select((self.analyzers.get(analyzer) or analysis.analyzer(analyzer))(F.col("q")).alias("t")).first()
        clauses = M.expand(row["t"] or [], self.synonyms)
        if not clauses:
            return self.postings([], False).select("doc_id", F.lit(0.0).alias("score")).where("false")
        found = self.postings(sorted({t for c in clauses for t in c}), False).where(F.col("field").isin(q.field))
        weights = {f: fields[f].weight for f in q.field}
        lengths = self.postings(positions=False).where(F.col("field").isin(q.field)).groupBy("doc_id").agg(F.sum("tf").alias("length")) if q.scoring == "bm25" else None
        scored = M.score(found, clauses, self.docs().count(), weights, q.operator, q.scoring, lengths=lengths)
        if q.filter:
            keys = self.docs().where(M.condition(q.filter)).select(F.col(mapping.key.name).alias("doc_id"))
            scored = scored.join(keys, "doc_id", "left_semi")
        return scored

    def search(self, query: dict, page: int | None = None, rows: int | None = None) -> DataFrame:
        """The fields and score of one page of matches, best first."""
        q = M.Match.of(query, page, rows)
        key = self.mapping.key.name
        found = M.best(self._scored(q), q.page, q.rows).withColumnRenamed("doc_id", key)
        out = self.docs().join(F.broadcast(found), key)
        columns = q.source or [f.name for f in self.mapping.fields]
        ordered = out.orderBy(F.desc("score"), key).select(*columns, "score")
        return M.formatted(ordered, q.formatter)

    def fast_search(self, text: str, page: int = 1, rows: int = 10) -> DataFrame:
        """Primary keys of one page of matches; documents aren't read."""
        names = [f.name for f in self.mapping.indexed]
        return M.best(self._scored(M.Match(names, text)), page, rows).select(F.col("doc_id").alias("primarykey"))
