"""The engine's own operators: golden vectors, properties, index life cycle, and all queries against SQL."""

import math
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.errors import IndexError_, MappingError, QueryError
from quern.functions import dates, money, pinyin, text
from quern.functions.fake import Fake
from quern.mapping import Field, Mapping
from quern.operators import analysis, blocks, cache, geo, ordering, postings, segment, sensitive
from quern.plans import catalog
from quern.plans import match as M
from quern.sources import files, store
from quern.sources.index import Index
from quern.streaming import live

WORDS = frozenset("中国 中国人 国人 人民 人民银行 银行 桌子 子上 桌子上 身上 照耀 阳光 在身".split())


def one(spark, value, kind, use):
    return spark.createDataFrame([(value,)], f"v {kind}").select(use(F.col("v")).alias("r")).first()["r"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="中国人民银行桌子上阳光照耀在身的", max_size=30))
def test_segmentation_loses_nothing(s):
    assert "".join(segment.precise(s, WORDS)) == s
    assert set(segment.precise(s, WORDS)) <= set(segment.full(s, WORDS))


def test_negative_beats_custom_beats_dictionary(spark):
    assert segment.is_word("中国", WORDS) and segment.is_word("新词", WORDS, custom=["新词"])
    assert not segment.is_word("新词", WORDS, custom=["新词"], negative=["新词"])
    word = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    assert segment.load(segment.dictionary(word("a", "b"), word("c"), word("b"))) == {"a", "c"}


def test_hash_vectors(spark):
    for key, want in (("", 579247), ("a", 562414), ("spark", 797108), ("中国", 602525)):
        assert one(spark, key, "string", lambda c: text.term_hash(c, 800000)) == want
    assert one(spark, "spark", "string", lambda c: text.term_hash(c, 1000)) == 108


def test_base64_vector(spark):
    assert one(spark, "a>?~~ÿ", "string", text.url_base64) == "YT4_fn7Dvw**"
    assert one(spark, "x" * 500, "string", lambda c: text.from_url_base64(text.url_base64(c))) == "x" * 500


def test_money_of_large_and_negative_amounts(spark):
    assert one(spark, -12.5, "double", money.chinese_money) == "零圆伍角"
    assert one(spark, -12.5, "double", lambda c: money.chinese_money(c, "strict")) == "负壹拾贰圆伍角"
    assert one(spark, None, "double", money.chinese_money) is None
    assert one(spark, 1e17, "double", money.chinese_money) is None


def test_dates(spark):
    assert one(spark, "2024-03-05 06:07:08", "string", lambda c: dates.format_epoch(dates.to_epoch(c), "Y/n/j G:i")) == "2024/3/5 6:07"
    assert one(spark, "05-03-2024", "string", dates.to_epoch) == 1709596800
    assert one(spark, "nonsense", "string", dates.to_epoch) is None
    assert one(spark, "n/a", "string", lambda c: dates.format_epoch(c, "Y")) is None
    for text, both, day in (("2023-12-31 00:59:59", True, False), ("2023-00-10", False, False), ("10-13-2023", False, False), ("2023-01-32", False, False), ("2023-01-01 10:60:00", False, False), ("01-02-2023", True, True), ("", False, False)):
        assert one(spark, text, "string", dates.is_date_time) == both and one(spark, text, "string", dates.is_date) == day


def test_pinyin_covers_level_one():
    assert len(pinyin.readings()) == 3755


def test_replace(spark):
    assert one(spark, "abcd ab", "string", lambda c: sensitive.replace(c, ["abc", "ab"])) == "**d **"
    assert one(spark, "xyz", "string", lambda c: sensitive.replace(c, ["abc"])) is None
    assert one(spark, "ABC", "string", lambda c: sensitive.contains(c, ["abc"])) is False
    assert one(spark, "A.C a.c", "string", lambda c: sensitive.replace(c, ["a.c", ""], "$1")) == "A.C $1"


def test_sensitive_hits_overlap_and_repeat(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "aaa"), (2, None), (3, ""), (4, "0a")], "doc_id long, text string")
    got = sensitive.hits(rows, spark.createDataFrame([("a a",), ("A",), ("0a",), ("",)], "word string"))
    want = [(1, 0, "a"), (1, 0, "aa"), (1, 1, "a"), (1, 1, "aa"), (1, 2, "a"), (4, 0, "0a"), (4, 1, "a")]
    assert sorted(map(tuple, got.collect())) == want
    words = spark.createDataFrame([("a a",), ("A",), ("0a",), ("",)], "word string")
    for most in (2000, 1):
        monkeypatch.setattr(sensitive, "MOST_IN_PATTERN", most)
        assert sorted(map(tuple, sensitive.hits(rows.union(rows), words).collect())) == sorted(want * 2)


def test_geohash_properties(spark):
    r = random.Random(1)
    points = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(300)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0)]
    df = spark.createDataFrame(points, "lat double, lon double").withColumn("h", geo.encode("lat", "lon", 6)).withColumn("b", geo.bounds("h"))
    for x in df.withColumn("n", geo.adjacent(geo.adjacent("h", "n"), "s")).withColumn("e", geo.adjacent(geo.adjacent("h", "e"), "w")).collect():
        assert x["b"]["sw"]["lat"] <= x["lat"] <= x["b"]["ne"]["lat"] and x["b"]["sw"]["lon"] <= x["lon"] <= x["b"]["ne"]["lon"]
        assert x["n"] == x["h"] == x["e"]
    known = spark.createDataFrame([(57.64911, 10.40744, 11, "u4pruydqqvj"), (39.9042, 116.4074, 8, "wx4g0bm6"), (31.2304, 121.4737, 12, "wtw3sjq6q2e8"), (0.0, 0.0, 5, "s0000")], "lat double, lon double, p int, h string")
    for x in known.select("h", "p", *(geo.encode("lat", "lon", p).alias(f"p{p}") for p in (5, 8, 11, 12))).collect():
        assert x[f"p{x['p']}"] == x["h"]
    odd = spark.createDataFrame([("u4pruydqqvj8",), ("s",), ("U4P",), ("",), (None,), ("s0a",), ("é0",), ("u4pruydqqvj8x",), ("zzz",), ("000",)], "h string")
    for x in geo.with_neighbors(odd, "h").withColumn("all", geo.neighbors("h")).collect():
        assert x["all"] is None and x["n"] is None if x["all"] is None else all(x[d] == x["all"][d] for d in geo._STEPS)
    for x in geo.with_decoded(odd, "h").withColumn("d", geo.decode("h")).withColumn("b", geo.bounds("h")).collect():
        assert (x["lat"], x["lon"]) == ((None, None) if x["d"] is None else tuple(x["d"])) and (x["b"] is None or x["north"] == x["b"]["ne"]["lat"])
    assert one(spark, 91.0, "double", lambda c: geo.encode(c, F.lit(0.0))) is None
    assert one(spark, "s0a", "string", lambda c: geo.decode(c)) is None


def test_multiset_intersection(spark):
    df = spark.createDataFrame([([3, 1, 1, 2], [1, 1, 1, 3]), ([], [1]), ([2, 2], [2])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(postings.intersect_multiset(F.col("a"), F.col("b"))).collect()] == [[1, 1, 3], [], [2]]


def test_fake_values_keep_their_patterns(spark):
    f = Fake("id", 3)
    df = spark.range(200).select(f.uuid().alias("uuid"), f.email().alias("email"), f.ip().alias("ip"), f.number(5).alias("n"), f.color().alias("c"), f.phone_number().alias("p"), f.full_name("male").alias("name"))
    import re

    shapes = {"uuid": r"[0-9A-F]{8}(-[0-9A-F]{4}){3}-[0-9A-F]{12}", "email": r"\d{10}@[a-z.]+", "ip": r"(\d{1,3}\.){3}\d{1,3}", "n": r"[1-9]\d{4}", "c": r"#[0-9a-f]{6}", "p": r"1\d{10}", "name": r"[A-Z][a-z]+ [A-Z][a-z]+"}
    first, again = df.collect(), df.repartition(5).collect()
    assert sorted(first) == sorted(again)
    assert all(re.fullmatch(rx, r[k]) for r in first for k, rx in shapes.items())


MAPPING = {"name": "shop", "field": [{"name": "id", "type": "primarykey", "primarykey_type": "UUID"}, {"name": "title", "type": "text", "index": True, "analyzer": "segment"}, {"name": "tag", "type": "keyword", "index": True}, {"name": "price", "type": "numeric"}, {"name": "made", "type": "date"}, {"name": "note", "type": "text"}]}
ROWS = [("a", "red apple pie", "food", 3.5, "2024-01-02", "x"), ("b", "Red car", "toy", 100.0, "2024-01-03", None), ("c", "green apple", "food", 1.0, None, "z"), (None, "apple", "food", 1.0, None, None), ("a", "copy", "food", 0.0, None, None)]
SCHEMA = "id string, title string, tag string, price double, made string, note string"


def test_index_life_cycle(spark, tmp_path):
    index = Index(spark, str(tmp_path / "shop"), synonyms=spark.createDataFrame([(1, "apple"), (1, "pear")], "group_id int, term string"))
    assert not index.exists()
    index.create(MAPPING)
    assert index.exists()
    with pytest.raises(IndexError_):
        index.create(MAPPING)
    rows = spark.createDataFrame(ROWS[:3], SCHEMA)
    index.add(rows.where("id <> 'c'"))
    index.build()
    index.add(rows)
    index.build()
    spec = {"match": {"field": {"name": "title", "query": "APPLE"}, "list_rows": 10, "page": 1, "_source": ["id", "price", "made"], "formatter": {"made": {"type": "date", "format": "d.m.Y"}, "price": {"type": "chinesemoney"}}}}
    got = [tuple(r)[:3] for r in index.search(spec).collect()]
    assert got == [("a", "叁圆伍角", "02.01.2024"), ("c", "壹圆整", None)]
    before = sorted(map(tuple, index.postings().select("term", "doc_id", "tf").collect()))
    index.compact()
    assert sorted(map(tuple, index.postings().select("term", "doc_id", "tf").collect())) == before
    assert [r["id"] for r in index.search({"match": {"field": {"name": "title", "query": "pear"}}}).collect()] == ["a", "c"]
    assert [r["id"] for r in index.search({"match": {"field": {"name": "tag", "query": "toy"}}}).collect()] == ["b"]
    assert index.search({"match": {"field": {"name": "title", "query": "red"}, "filter": {"price": {"gt": 50}}}}).count() == 1
    assert index.search({"match": {"field": {"name": "title", "query": "red"}, "page": 9}}).count() == 0
    assert index.search({"match": {"field": {"name": "title", "query": ""}}}).count() == 0
    with pytest.raises(IndexError_):
        index.search({"match": {"field": {"name": "note", "query": "x"}}})
    with pytest.raises(QueryError):
        index.search({"match": {}})
    index.delete()
    assert not index.exists()


def test_meta_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "a" / "meta.json")
    store.write_text(spark, path, "old")
    store.write_text(spark, path, "new")
    assert store.read_text(spark, path) == "new"
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["meta.json"]


def test_frequent_term_is_split_over_tasks(spark, tmp_path):
    """Every row holds the term; its postings must be in several files and still be found whole."""
    index = Index(spark, str(tmp_path / "hot"))
    index.create({"name": "hot", "field": [{"name": "id", "type": "primarykey"}, {"name": "t", "type": "text", "index": True}]})
    index.add(spark.range(20000).select("id", F.concat(F.lit("the w"), F.col("id").cast("string")).alias("t")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.build()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hits = index.postings().where("term = 'the'")
    assert hits.count() == 20000
    assert hits.select(F.input_file_name()).distinct().count() > 1


def test_mapping_errors():
    for bad in ({"name": "x", "field": []}, {"name": "x", "field": [{"name": "a", "type": "what"}]}, {"field": []}):
        with pytest.raises(MappingError):
            Mapping.of(bad)


def test_filters_with_polygons(spark):
    df = spark.createDataFrame([(1, [5.0, 5.0]), (2, [50.0, 5.0])], "id int, at array<double>")
    assert [r["id"] for r in df.where(M.condition({"at": {"polygon": [[0, 0], [0, 10], [10, 10], [10, 0]]}})).collect()] == [1]


def test_cache(spark, tmp_path):
    now = [100.0]
    c = cache.ResultCache(spark, str(tmp_path / "cache"), clock=lambda: now[0])
    c.put("i", "q", spark.range(3), ttl=10)
    c.put("i", "q", spark.range(4), ttl=10)
    c.put("i", "for ever", spark.range(1))
    assert c.get("i", "q").count() == 4 and c.get("j", "q") is None
    now[0] = 111.0
    assert c.get("i", "q") is None and c.get("i", "for ever").count() == 1
    c.clear()
    assert c.get("i", "for ever") is None


def test_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("﻿one-two\r\n\r\nthree|four-five\r\n", encoding="utf-8")
    groups = files.synonyms(spark, str(tmp_path / "s.txt")).collect()
    assert sorted(r["term"] for r in groups) == ["five", "four", "one", "three", "two"] and len({r["group_id"] for r in groups}) == 2
    (tmp_path / "d.txt").write_text("a\t2.5\nb\n")
    assert sorted(map(tuple, files.dictionary(spark, str(tmp_path / "d.txt")).collect())) == [("a", 2.5), ("b", 5.0)]
    day = tmp_path / "log" / "2025" / "2025-02" / "2025-02-10"
    day.mkdir(parents=True)
    (day / "terms").write_text("x\r\ny\r\nx\r\n")
    assert sorted((str(r["day"]), r["term"]) for r in files.term_log(spark, str(tmp_path / "log")).collect()) == [("2025-02-10", "x"), ("2025-02-10", "x"), ("2025-02-10", "y")]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "b c")], "primarykey long, text string").write.parquet(str(tmp_path / "in"))
    index = Index(spark, str(tmp_path / "index"))
    index.create_fast()
    for _ in range(2):
        stream = spark.readStream.schema("primarykey long, text string").parquet(str(tmp_path / "in"))
        live.index_stream(stream, index, str(tmp_path / "ck")).awaitTermination()
    assert [r[0] for r in index.fast_search("b").collect()] == [1, 2]
    log = spark.createDataFrame([("2024-01-01 10:00:00", "x"), ("2024-01-01 11:00:00", "x"), ("2024-01-02 00:00:00", "x")], "ts string, term string").select(F.to_timestamp("ts").alias("ts"), "term")
    assert sorted(r["n"] for r in live.term_counts(log).collect()) == [1, 2]


def test_registry(spark):
    analysis.register("first", lambda c: F.array(F.substring(c, 1, 1)))
    assert one(spark, "xyz", "string", analysis.analyzer("first")) == ["x"]
    with pytest.raises(KeyError):
        analysis.analyzer("none")


def comparable(names, found):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    found = got.collect()
    assert found
    if name not in catalog.ORACLES:
        return
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    cur = con.execute(catalog.ORACLES[name])
    assert comparable(got.columns, found) == comparable([d[0] for d in cur.description], cur.fetchall())


def test_stable_sort_gives_every_row_its_place(spark, sf_dir):
    r = random.Random(7)
    rows = [(k, r.choice([None, float("nan"), -1.5, 0.0, 2.0, 2.5, float(r.randrange(50))])) for k in range(700)]
    r.shuffle(rows)
    got = ordering.places(spark.createDataFrame(rows, "k long, v double").repartition(5), "v", "k", 8).collect()
    order = sorted(rows, key=lambda x: ((2, 0) if x[1] is None else (0, 0) if math.isnan(x[1]) else (1, -x[1]), x[0]))
    assert [(x["place"], x["k"]) for x in got] == [(i, k) for i, (k, _) in enumerate(order, 1)]
    assert ordering.places(spark.createDataFrame([], "k long, v double"), "v", "k").count() == 0
    found = catalog.QUERIES["stable_sort_all"](spark, sf_dir).collect()
    assert [x["place"] for x in found] == list(range(1, spark.read.parquet(f"{sf_dir}/orders.parquet").count() + 1))


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_postings_of_unlike_keys_are_made_in_place(spark, monkeypatch):
    """no token is shuffled unless its key is repeated; repeated and null keys are still added up."""
    from quern.mapping import Field

    fields = [Field("a", "text", index=True), Field("b", "keyword", index=True)]
    rows = [(1, "x y x ... a.b", "k"), (2, None, "k"), (3, "", None), (4, "中国x", "X"), (5, "y " * 50, "")]
    df = lambda r: spark.createDataFrame(r, "id long, a string, b string")
    assert "Exchange" not in plan(M.postings(df(rows), "id", fields))
    tokens = {1: "x y x . . . a.b", 4: "中 国 x", 5: "y " * 50}
    for chunk in (M.CHUNK, 4):
        monkeypatch.setattr(M, "CHUNK", chunk)
        for more in ([], [(1, "y x", "k"), (None, "x", "k"), (None, "x z", None)]):
            want = {}
            for k, a, b in rows + more:
                for field, found in (("a", (a and tokens.get(k, a) if (k, a, b) in rows else a) or ""), ("b", None)):
                    for i, t in enumerate(found.split() if field == "a" else [] if b is None else [b]):
                        want.setdefault((field, t.lower() if field == "a" else t, k), []).append(i)
            got = {(r["field"], r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in M.postings(df(rows + more), "id", fields).collect()}
            assert got == {k: (len(v), sorted(v)) for k, v in want.items()}
    assert M.postings(df([]), "id", fields).count() == 0


def test_standard_tokens_in_one_pass(spark):
    """as by block and character, also where a block has dots only."""
    r = random.Random(5)
    rows = [("".join(r.choice(list("aZ0... -中国あアー한é\n][\\'İK😀》℃")) for _ in range(r.randrange(12))),) for _ in range(3000)] + [(None,), ("." * 20000,), ("." * 20000 + "A",)]
    texts = spark.createDataFrame(rows, "t string")
    by_block = F.transform(analysis._per_block("t", analysis._chars), lambda t: F.lower(t))
    assert texts.where(~by_block.eqNullSafe(analysis.standard("t", True))).count() == 0
    assert "transform" not in texts.select(analysis.standard("t"))._jdf.queryExecution().analyzed().toString()


def test_index_is_built_in_place_and_merged_without_adding_up(spark, tmp_path, monkeypatch):
    """a build shuffles no postings, a compaction aggregates none; stored keys are left out before texts are grouped."""
    seen, write = [], Index._write_postings
    monkeypatch.setattr(Index, "_write_postings", lambda self, found, *a: (seen.append(plan(found)), write(self, found, *a))[1])
    index = Index(spark, str(tmp_path / "i"))
    index.create({"name": "i", "field": [{"name": "id", "type": "primarykey"}, {"name": "t", "type": "text", "index": True}, {"name": "a=b/c", "type": "keyword", "index": True}]})
    rows = spark.range(100).select("id", F.concat(F.lit("the the w"), F.col("id") % 7).alias("t"), F.lit("k").alias("a=b/c"))
    for part in (rows.where("id < 40"), rows.where("id < 90"), rows):
        index.add(part.repartition(8))
        index.build()
    assert len(seen) == 6 and not any("Aggregate" in p or "rangepartitioning" in p or "hashpartitioning" in p for p in seen)
    want = sorted((f, t, k, n, p) for k in range(100) for f, t, n, p in (("t", "the", 2, [0, 1]), ("t", f"w{k % 7}", 1, [2]), ("a=b/c", "k", 1, [0])))
    for _ in range(2):
        assert sorted(map(tuple, index.postings().select("field", "term", "doc_id", "tf", "positions").collect())) == want
        index.compact()
    assert len(seen) == 8 and not any("Aggregate" in p for p in seen)
    assert [r[0] for r in index.search({"match": {"field": {"name": "t", "query": "w3 the"}, "list_rows": 2}}).select("id").collect()] == [3, 10]


def test_texts_of_a_match_are_read_once(spark):
    """lengths and hits come from one pass; rows that share a key, or have none, count as one document."""
    from quern.mapping import Field

    rows = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, ""), (3, None), (None, "a"), (None, "a d"), (4, "d")], "id long, t string")
    text = Field("t", "text", index=True)
    found = M.Scan(rows, "id", [text], ["a", "b"])
    assert found.n == 7
    assert sorted(map(tuple, found.lengths().collect()), key=str) == sorted([(1, 5), (None, 3), (4, 1)], key=str)
    assert sorted(map(tuple, found.occurrences().select("term", "doc_id", "tf").collect()), key=str) == sorted([("a", 1, 2), ("b", 1, 2), ("a", None, 2)], key=str)
    assert "regexp" not in found.occurrences()._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted((r["term"], r["df"], round(math.exp(r["idf"]), 6)) for r in M.document_frequencies(rows, "id", text).collect()) == [("a", 2, 3.5), ("b", 1, 7.0), ("c", 1, 7.0), ("d", 2, 3.5)]
    alone = rows.where("id > 1")
    assert plan(M.document_frequencies(alone, "id", text)).count("Exchange hashpartitioning") == 1
    assert [tuple(r)[:2] for r in M.document_frequencies(alone, "id", text).collect()] == [("d", 1)]


def built_plans(spark, path, monkeypatch, mapping, rows):
    seen, write = [], Index._write_postings
    monkeypatch.setattr(Index, "_write_postings", lambda self, found, *a: (seen.append((a, plan(found))), write(self, found, *a))[1])
    index = Index(spark, path)
    index.create(mapping) if mapping else index.create_fast()
    index.add(rows)
    index.build()
    return index, seen


def test_fast_index_tokenises_where_it_reads(spark, tmp_path, monkeypatch):
    """no posting is shuffled while a fast index is built, and its pages are as by brute force."""
    texts = {k: "from " * (k % 5 + 1) + "with " * (k % 3) + f"w{k}" for k in range(300)}
    index, seen = built_plans(spark, str(tmp_path / "f"), monkeypatch, None, spark.createDataFrame(list(texts.items()), "primarykey long, text string"))
    assert len(seen) == 1 and "hashpartitioning" not in seen[0][1] and "Aggregate" not in seen[0][1]
    idf = math.log(300 / 200)  # every text has "from"
    order = sorted((k for k in texts if k % 3), key=lambda k: (-(k % 3) * idf, k))
    assert [r[0] for r in index.fast_search("from WITH", 2, 10).collect()] == order[10:20]


def test_fields_are_indexed_one_by_one(spark, tmp_path, monkeypatch):
    """each field's postings are made and sorted by themselves; a search with filters and other fields gives whole rows."""
    rows = spark.createDataFrame([(k, "thing " * (k % 4) + "only", "en" if k % 2 else "de", str(k * 10), f"s{k}") for k in range(60)], "doc_id long, text string, lang string, n_chars string, source string")
    index, seen = built_plans(spark, str(tmp_path / "p"), monkeypatch, catalog._DOCS, rows)
    assert [a[1] for a, _ in seen] == ["text", "lang", "n_chars"] and not any("hashpartitioning" in p for _, p in seen)
    spec = {"match": {"field": {"name": "text", "query": "thing only"}, "list_rows": 4, "page": 1, "_source": ["doc_id", "lang", "source"], "filter": {"lang": "en", "n_chars": {"gte": 100}}}}
    assert [tuple(r)[:3] for r in index.search(spec).collect()] == [(k, "en", f"s{k}") for k in (11, 15, 19, 23)]


def test_fast_index_stores_blocks_of_unshuffled_texts(spark, tmp_path, monkeypatch):
    """a row for each term and chunk instead of each posting, from texts that stay where they are; repeated keys keep their least row, and tokens are those of the analyzer."""
    written, write = [], store.write
    monkeypatch.setattr(store, "write", lambda rows, path: (written.append(plan(rows)), write(rows, path))[1])
    r = random.Random(6)
    letters = list("aZ0... -中国あアー한é\n][\\'İK😀》℃")
    texts = {k * (-1) ** k: "".join(r.choice(letters) for _ in range(r.randrange(30))) for k in range(400)} | {2**62: "from with from", -(2**62): None, 1001: "." * 3000, 1002: "." * 3000 + "A", 1003: "x" * 5000}
    rows = spark.createDataFrame(list(texts.items()), "primarykey long, text string").repartition(3)
    odd = spark.range(1).select(F.lit(5000).cast("long").alias("primarykey"), F.expr("cast(X'61E428622EFFC3' as string)").alias("text"))
    for chunk, more in ((1 << 24, []), (100, [(-5, "zz"), (None, "zz"), (-7, None)])):
        monkeypatch.setattr(blocks, "CHUNK_BYTES", chunk)
        index = Index(spark, str(tmp_path / f"f{chunk}"))
        index.create_fast()
        index.add(rows.unionByName(odd).unionByName(spark.createDataFrame(more, rows.schema)))
        index.build()
        kept = texts | {k: min([texts[k], t], key=lambda v: (v is not None, v or "")) for k, t in more if k in texts}
        tokens = spark.createDataFrame(list(kept.items()), rows.schema).unionByName(odd).select("primarykey", F.posexplode(analysis.standard("text", True)))
        want = {}
        for k, p, t in sorted(map(tuple, tokens.collect())):
            want.setdefault((t, k), []).append(p)
        got = index.postings().collect()
        assert {(x["term"], x["doc_id"]): (x["tf"], x["positions"]) for x in got} == {k: (len(v), v) for k, v in want.items()} and len(got) == len(want)
        assert index.postings(["from"], False).collect() == [("text", "from", 2**62, 2)]
        if not more:
            terms = {t for t, _ in want}
            assert index._blocks().count() <= 5 * len(terms) < len(want)
    assert "Aggregate" not in written[0] and "hashpartitioning" not in written[0] and "Aggregate" in written[1]


def test_blocks_are_made_of_several_batches(spark, monkeypatch):
    """a task's text gives a block for each term and chunk, however few rows a batch has; tokens of any length, keys in any order."""
    r = random.Random(4)
    words = ["from", "a.b", "...", "é", "中国", "eight888", "nine99999", "nine99998", "x" * 300, "“", "A.", "\0"]
    rows = [(k * 7919 % 1000 - 500, " ".join(r.choices(words, k=k % 9)) if k % 50 else None) for k in range(300)]
    frame = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    want = {}
    for k, p, t in sorted(map(tuple, frame.select("id", F.posexplode(analysis.standard("t", True))).collect())):
        want.setdefault((t, k), []).append(p)
    terms, field = {t for t, _ in want}, Field("t", "text", index=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        for chunk in (1 << 24, 4000):
            monkeypatch.setattr(blocks, "CHUNK_BYTES", chunk)
            found = blocks.of(frame, "id", field).withColumn("field", F.lit("t"))
            got = blocks.postings(found).collect()
            assert {(x["term"], x["doc_id"]): (x["tf"], x["positions"]) for x in got} == {k: (len(v), v) for k, v in want.items()} and len(got) == len(want)
            n = found.groupBy("term").count().agg(F.max("count")).first()[0]
            assert n == 1 if chunk == 1 << 24 else 1 < n < 15
            assert found.select("term").distinct().count() == len(terms)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chunks_beyond_64_bits_are_halved(monkeypatch):
    """the same postings, in more blocks."""
    texts = pa.array([" ".join(f"w{i * k % 17}" for i in range(k)) for k in range(40)])
    batch = [pa.RecordBatch.from_arrays([pa.array(range(40)), texts], ["doc_id", "tokens"])]

    def found():
        made = list(blocks._local(batch, True, 1 << 24))
        both = [pa.RecordBatch.from_arrays([pa.array(["f"] * len(b)), *b.columns], ["field", *b.schema.names]) for b in made]
        return sum(map(len, made)), sorted(((x["term"], x["doc_id"], x["tf"], x["positions"]) for b in both for x in blocks._postings(b, True).to_pylist()))

    n, whole = found()
    monkeypatch.setattr(blocks, "BITS", 12)
    more, halved = found()
    assert halved == whole and more > n


def test_packed_integers():
    """integers come back as they were, up to 64 bits."""
    r = random.Random(8)
    for most in (0, 1, 127, 128, 2**14, 2**35, 2**64 - 1):
        values = np.array([r.randrange(most + 1) for _ in range(300)] + [most, 0], np.uint64)
        data, at = blocks.pack(values)
        assert (blocks.unpack(data) == values).all() and len(data) == at[-1]
    assert len(blocks.unpack(blocks.pack(np.zeros(0, np.int64))[0])) == 0


def test_fields_of_string_keys_are_stored_as_blocks(spark, tmp_path, monkeypatch):
    """keyword, number and analyzed fields under string keys; rows are spread if one task has them all; compaction keeps them."""
    from quern import mapping

    monkeypatch.setattr(mapping, "TASK_ROWS", 20)
    monkeypatch.setattr(blocks, "CHUNK_TOKENS", 7)
    monkeypatch.setattr(blocks, "DECODED", 9)
    fields = [{"name": "id", "type": "primarykey", "primarykey_type": "UUID"}, {"name": "t", "type": "text", "index": True, "analyzer": "unicode_words"}, {"name": "lang", "type": "keyword", "index": True}, {"name": "n", "type": "numeric", "index": True}]
    rows = [(f"kéy{'-' * (k % 3)}{k}", f"Straße é{k % 5} é{k % 5} x", [None, "", "en"][k % 3], str(k % 4) if k % 7 else "odd") for k in range(120)]
    frame = spark.createDataFrame(rows, "id string, t string, lang string, n string").coalesce(1)
    index = Index(spark, str(tmp_path / "i"))
    index.create({"name": "i", "field": fields})
    for part in (frame.where("n <> '1'"), frame):
        index.add(part)
        index.build()
    assert len(list((tmp_path / "i" / "docs-000000").glob("*.parquet"))) > 1
    want = [("t", t, k, n, p) for k, text, _, _ in rows for t, n, p in (("straße", 1, [0]), (text.split()[1], 2, [1, 2]), ("x", 1, [3]))]
    want += [("lang", x, k, 1, [0]) for k, _, x, _ in rows if x is not None] + [("n", f"{x}.0", k, 1, [0]) for k, _, _, x in rows if x != "odd"]
    for _ in range(2):
        assert sorted(map(tuple, index.postings().collect())) == sorted(want)
        assert sorted(map(tuple, index.postings(positions=False).collect())) == sorted(x[:4] for x in want)
        index.compact()
    spec = {"match": {"field": {"name": "t", "query": "é3 x"}, "list_rows": 3, "_source": ["id", "n"], "filter": {"lang": "en"}}}
    assert [x["id"] for x in index.search(spec).collect()] == sorted(k for k, text, x, _ in rows if x == "en" and "é3" in text)[:3]
    index._save(index._meta() | {"postings": ["postings-merged-2"]})
    with pytest.raises(IndexError_):
        index.postings()
