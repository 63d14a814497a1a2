"""Queries of the engine's own operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import dates, money, pinyin, text
from quern.functions.fake import Fake
from quern.mapping import Field, Mapping
from quern.operators import analysis, cache, geo, ordering, postings, segment, sensitive, stats
from quern.plans import match as M
from quern.sources import store
from quern.sources.index import Index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


TEXTS = ("documents", "pages", "conversations")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wide = spark.sparkContext.defaultParallelism
    # a text table that the reader itself parts in fewer tasks than there are cores is spread over them; it has
    # less than a partition's bytes a core then, so that what is moved is bounded, and large tables stay where they are
    return rows.repartition(wide) if name in TEXTS and rows._jdf.queryExecution().toRdd().getNumPartitions() < wide else rows


_RX = "'" + analysis.BLOCKS.replace("'", "''") + "'"
#: Tokens of the standard analyzer in DuckDB, for text without Han, Kana and Hangul: each block is whole.
_TOKENS = f"list_transform(regexp_extract_all(text, {_RX}), lambda t: lower(t))"
_TEXT = Field("text", "text", index=True)
_POSTINGS = f"""flat as (select doc_id, unnest({_TOKENS}) as term from documents),
tf as (select term, doc_id, count(*) as tf from flat group by all),
total as (select count(*)::double as n from documents),
idf as (select term, ln(any_value(n) / count(*)) as idf from tf, total group by term)"""


# ---------------------------------------------------------------- search


def _scored(spark, sf_dir, clauses, **how) -> DataFrame:
    found = M.Scan(table(spark, sf_dir, "documents"), "doc_id", [_TEXT], [t for c in clauses for t in c])
    if how.get("scoring") == "bm25":
        how["lengths"] = found.lengths()
    return M.score(found.occurrences(), clauses, found.n, **how).withColumn("score", F.round("score", 6))


def _match_sql(clauses: list[list[str]], operator: str, tail: str) -> str:
    names = ", ".join(f"('{t}', {i})" for i, c in enumerate(clauses) for t in c)
    having = f"having count(distinct clause) = {len(clauses)}" if operator == "and" else ""
    return f"""with {_POSTINGS}, clauses(term, clause) as (values {names})
select doc_id, round(sum(tf * idf), 6) as score from tf join idf using (term) join clauses using (term) group by doc_id {having} {tail}"""


@query(_match_sql([["thing"], ["only"]], "and", "order by score desc, doc_id limit 10"))
def match_and_topk(spark, sf_dir):
    return M.best(_scored(spark, sf_dir, [["thing"], ["only"]]))


@query(_match_sql([["thing"], ["only"], ["einen"]], "or", "order by score desc, doc_id limit 20"))
def match_or_topk(spark, sf_dir):
    return M.best(_scored(spark, sf_dir, [["thing"], ["only"], ["einen"]], operator="or"), 1, 20)


@query(_match_sql([["thing", "only"], ["from"]], "and", ""))
def match_synonym(spark, sf_dir):
    groups = spark.createDataFrame([(1, "thing"), (1, "only"), (2, "other")], "group_id int, term string")
    return _scored(spark, sf_dir, M.expand(["thing", "from"], groups))


_WEIGHTED = [Field("url", "text", index=True, weight=3.0), Field("html", "text", index=True)]


@query(f"""with flat as (select page_id as doc_id, 'url' as field, unnest({_TOKENS.replace("text,", "url,")}) as term from pages union all select page_id, 'html', unnest({_TOKENS.replace("text,", "html,")}) from pages),
tf as (select field, term, doc_id, count(*) as tf from flat where term in ('article', 'ref', 'en') group by all),
idf as (select field, term, ln((select count(*) from pages)::double / count(*)) as idf from tf group by all)
select doc_id, round(sum(case field when 'url' then 3.0 else 1.0 end * tf * idf), 6) as score from tf join idf using (field, term) group by doc_id having count(distinct term) = 2""")
def match_weighted(spark, sf_dir):
    scan = M.Scan(table(spark, sf_dir, "pages"), "page_id", _WEIGHTED, ["article", "ref", "en"])
    found = scan.occurrences()
    both = M.score(found, [["article"], ["ref"], ["en"]], scan.n, {"url": 3.0}, "or")
    two = found.groupBy("doc_id").agg(F.count_distinct("term").alias("n")).where("n = 2").select("doc_id")
    return both.join(two, "doc_id", "left_semi").withColumn("score", F.round("score", 6))


@query(f"""with flat as (select doc_id, unnest({_TOKENS}) as term from documents), lens as (select doc_id, count(*) as length from flat group by doc_id),
tf as (select term, doc_id, count(*) as tf from flat where term in ('thing', 'only') group by all),
df as (select term, count(*) as df, (select count(*) from documents)::double as n from tf group by term), m as (select avg(length) as mean from lens)
select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score
from tf join df using (term) join lens using (doc_id), m group by doc_id having count(*) = 2""")
def match_bm25(spark, sf_dir):
    return _scored(spark, sf_dir, [["thing"], ["only"]], scoring="bm25")


@query("""with flat as (select doc_id, unnest(%s) as term from documents), tf as (select term, doc_id, count(*) as tf from flat where term in ('thing', 'only') group by all)
select doc_id, round(sum(tf * case term when 'thing' then 3.25 else 5.0 end), 6) as score from tf group by doc_id having count(*) = 2""" % _TOKENS)
def match_dictionary_idf(spark, sf_dir):
    known = spark.createDataFrame([("thing", 3.25), ("nothing", 1.0)], "word string, idf double")
    return _scored(spark, sf_dir, [["thing"], ["only"]], scoring="dictionary", dictionary=known)


def _index(spark, rows, mapping) -> Index:
    index = Index(spark, store.new_folder(spark, "index"))
    index.create(mapping)
    index.add(rows)
    index.build()
    return index


@query(_match_sql([["from"], ["with"]], "and", "order by score desc, doc_id limit 10 offset 10").replace("select doc_id, round", "select doc_id as primarykey from (select doc_id, round") + ")")
def fast_search_ids(spark, sf_dir):
    index = Index(spark, store.new_folder(spark, "fast"))
    index.create_fast()
    index.add(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("primarykey"), "text"))
    index.build()
    return index.fast_search("from WITH", 2, 10)


@query(_match_sql([["from"], ["with"]], "and", "order by score desc, doc_id limit 7 offset 14"))
def paged_match(spark, sf_dir):
    return M.best(_scored(spark, sf_dir, [["from"], ["with"]]), 3, 7)


_DOCS = Mapping("documents", (Field("doc_id", "primarykey"), _TEXT, Field("lang", "keyword", index=True), Field("n_chars", "numeric", index=True), Field("source", "keyword")))


@query(f"""with {_POSTINGS}, m as (select doc_id, sum(tf * idf) as s from tf join idf using (term) where term in ('thing', 'only') group by doc_id having count(*) = 2)
select d.doc_id, lang, source, round(s, 6) as score from m join documents d using (doc_id) where lang = 'en' and n_chars >= 500 order by s desc, doc_id limit 10""")
def source_projection(spark, sf_dir):
    index = _index(spark, table(spark, sf_dir, "documents"), _DOCS)
    spec = {"match": {"field": {"name": "text", "query": "thing only"}, "list_rows": 10, "page": 1, "_source": ["doc_id", "lang", "source"], "filter": {"lang": "en", "n_chars": {"gte": 500}}}}
    return index.search(spec).withColumn("score", F.round("score", 6))


@query("select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%d/%m/%Y %H:%M') as minute from events")
def date_format(spark, sf_dir):
    epoch = table(spark, sf_dir, "events").select("event_id", dates.to_epoch("ts").alias("day"))
    return M.formatted(epoch.withColumn("minute", F.col("day")), {"day": {"type": "date", "format": "Y-m-d"}, "minute": {"type": "date", "format": "d/m/Y H:i"}, "other": {"type": "date"}})


@query("select c_custkey, case when c_nationkey < 5 and c_acctbal >= 0 then 1 else 0 end as near from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal > 0")
def filter_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where(M.condition({"c_mktsegment": ["BUILDING", "MACHINERY"], "c_acctbal": {"gt": 0}}))
    return rows.select("c_custkey", F.when(M.condition({"c_nationkey": {"lt": 5}, "c_acctbal": {"gte": 0}}), 1).otherwise(0).alias("near"))


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 1000 and o_totalprice < 50000 and o_orderstatus = 'F'")
def filter_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(M.condition({"o_totalprice": {"gte": 1000, "lt": 50000}, "o_orderstatus": "F"})).select("o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- analysis and index


@query(f"select doc_id, pos::int as pos, token from (select doc_id, unnest(b) as token, generate_subscripts(b, 1) - 1 as pos from (select doc_id, regexp_extract_all(text, {_RX}) as b from documents))")
def block_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(analysis.blocks("text")).alias("pos", "token"))


@query("select * from (values (1, '全文检,文检索,检索引,索引擎'), (2, '检索,索器,检索器'), (3, '中文,a.b,分词'), (4, 'あ,い,ア,한')) t(id, grams)")
def ngram_tokens(spark, sf_dir):
    rows = spark.createDataFrame([(1, "全文检索引擎", 3, 3), (2, "检索器", 2, 4), (3, "中文 a.b 分词", 2, 2), (4, "あい ア 한", 3, 3)], "id int, t string, lo int, hi int")
    one = F.when(F.col("id") == 2, analysis.ngrams("t", (2, 4))).when(F.col("id") == 3, analysis.ngrams("t", 2)).otherwise(analysis.ngrams("t", 3))
    return rows.select("id", F.array_join(one, ",").alias("grams"))


_STOP = ["the", "of", "and", "a", "to", "in", ",", "."]


@query(f"select conv_id, turn, len(list_filter({_TOKENS}, lambda t: t not in ('the', 'of', 'and', 'a', 'to', 'in', ',', '.'))) as n from conversations")
def stopword_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(analysis.without_stop_words(analysis.standard("text", True), _STOP)).cast("long").alias("n"))


@query(f"select row_number() over (order by n desc, token) as rank, * from (select token, count(*) as n from (select unnest({_TOKENS}) as token from documents) group by token order by n desc, token limit 500)")
def top_terms(spark, sf_dir):
    return analysis.top_terms(table(spark, sf_dir, "documents").select(F.explode(analysis.standard("text", True)).alias("token")))


@query("select lang, count(*) as n, count(distinct w) as kinds from (select lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}.]+')) as w from documents) group by lang")
def unicode_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", F.explode(analysis.unicode_words("text")).alias("w"))
    return words.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("w").alias("kinds"))


@query(f"select 'text' as field, term, doc_id, count(*) as tf, array_to_string(list(pos order by pos), ' ') as positions from (select doc_id, unnest(b) as term, generate_subscripts(b, 1) - 1 as pos from (select doc_id, {_TOKENS} as b from documents)) group by term, doc_id")
def index_postings(spark, sf_dir):
    found = M.postings(table(spark, sf_dir, "documents"), "doc_id", [_TEXT])
    return found.withColumn("positions", F.concat_ws(" ", F.col("positions").cast("array<string>")))


@query(f"select field, term, count(*) as df, sum(tf)::bigint as tf from (select 'text' as field, term, doc_id, count(*) as tf from (select doc_id, unnest({_TOKENS}) as term from documents) group by all union all select 'lang', lang, doc_id, 1 from documents union all select 'n_chars', n_chars::double::varchar, doc_id, 1 from documents) group by field, term")
def incremental_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    index = Index(spark, store.new_folder(spark, "merged"))
    index.create(_DOCS)
    for part in (docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), docs):
        index.add(part)
        index.build()
    index.compact()
    return index.postings(positions=False).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"with {_POSTINGS} select term, count(*) as df, round(any_value(idf), 6) as idf from tf join idf using (term) group by term")
def term_idf(spark, sf_dir):
    return M.document_frequencies(table(spark, sf_dir, "documents"), "doc_id", _TEXT).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"select token, count(*) as n, any_value(case token when 'the' then 1.5 when 'of' then 2.25 else 5.0 end) as idf from (select unnest({_TOKENS}) as token from conversations) group by token")
def dictionary_idf(spark, sf_dir):
    tokens = table(spark, sf_dir, "conversations").select(F.explode(analysis.standard("text", True)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return analysis.with_idf(tokens, spark.createDataFrame([("the", 1.5), ("of", 2.25)], "word string, idf double"))


# ---------------------------------------------------------------- posting lists


@query("select l_suppkey, array_to_string(list_sort(list_intersect(list(distinct l_partkey) filter (l_quantity > 25), list(distinct l_partkey) filter (l_discount > 0.04))), ' ') as both from lineitem group by l_suppkey")
def postings_intersect(spark, sf_dir):
    empty = F.array().cast("array<bigint>")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("a"), F.collect_set(F.when(F.col("l_discount") > 0.04, F.col("l_partkey"))).alias("b"))
    both = postings.intersect_multiset(F.coalesce("a", empty), F.coalesce("b", empty))
    return lists.select("l_suppkey", F.concat_ws(" ", both.cast("array<string>")).alias("both"))


@query("select * from (values (1, '3,1,3'), (2, ''), (3, '2,2'), (4, '5')) t(id, kept)")
def ordered_intersect(spark, sf_dir):
    rows = spark.createDataFrame([(1, [1, 3], [3, 1, 3, 9], [3, 1, 3]), (2, [1], [2], [3]), (3, [2, 4], [4, 2, 2], [9, 2, 2]), (4, [5, 5], [5], [5])], "id int, a array<int>, b array<int>, c array<int>")
    return rows.select("id", F.concat_ws(",", postings.intersect_ordered(F.col("a"), F.col("b"), F.col("c")).cast("array<string>")).alias("kept"))


@query("select l_partkey from lineitem where l_quantity > 25 intersect all select l_partkey from lineitem where l_discount > 0.04 intersect all select l_partkey from lineitem where l_tax > 0.02")
def intersect_all(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return postings.intersect_all_rows([items.where("l_quantity > 25"), items.where("l_discount > 0.04"), items.where("l_tax > 0.02")], "l_partkey")


@query("select doc_id from (select doc_id, unnest(%s) as term from documents) where term in ('thing', 'only', 'from') group by doc_id having count(distinct term) = 3" % _TOKENS)
def containing_all(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select("doc_id", F.explode(_TEXT.tokens()).alias("term"))
    return postings.containing_all(terms, ["thing", "only", "from"])


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') and o_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def intersect_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    builders = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return postings.intersect_rows([builders, orders.where("o_orderstatus = 'F'"), orders], "o_custkey").select("o_orderkey", "o_custkey")


@query("select * from (values (1, 'a', '1,2,3'), (1, 'b', '4'), (1, 'c', '5,6')) t(id, term, docs)")
def merge_postings(spark, sf_dir):
    rows = spark.sql("select 1 as id, map('a', array(1L, 2L), 'b', array(4L)) as x, map('a', array(3L), 'c', array(5L, 6L)) as y")
    return rows.select("id", F.explode(postings.merge_posting_maps(F.col("x"), F.col("y"))).alias("term", "docs")).select("id", "term", F.concat_ws(",", F.col("docs").cast("array<string>")).alias("docs"))


@query("select row_number() over (order by o_totalprice desc, o_orderkey) as place, o_orderkey, o_totalprice from orders order by 1 limit 100")
def stable_sort(spark, sf_dir):
    from pyspark.sql import Window

    top = ordering.by_value(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long"))


@query("select row_number() over (order by o_totalprice desc, o_orderkey) as place, o_orderkey, o_totalprice from orders")
def stable_sort_all(spark, sf_dir):
    return ordering.places(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey").select("place", "o_orderkey", "o_totalprice")


@query("select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 25 offset 50")
def sort_by_field_page(spark, sf_dir):
    return ordering.page(ordering.by_field(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "asc", "c_custkey"), 3, 25)


# ---------------------------------------------------------------- geo

_POINT = "(select event_id, value * 7919.13::double - floor(value * 7919.13::double / 179.9::double) * 179.9::double - 89.95::double as lat, (user_id * 37.77::double + value) - floor((user_id * 37.77::double + value) / 359.9::double) * 359.9::double - 179.95::double as lon from events)"


def _points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.selectExpr("event_id", "value * 7919.13d - floor(value * 7919.13d / 179.9d) * 179.9d - 89.95d as lat", "(user_id * 37.77d + value) - floor((user_id * 37.77d + value) / 359.9d) * 359.9d - 179.95d as lon")


def _duck_hash(lat: str, lon: str, p: int) -> str:
    x = f"least(floor(({lon} + 180) / 360 * 1073741824), 1073741823)::bigint"
    y = f"least(floor(({lat} + 90) / 180 * 1073741824), 1073741823)::bigint"
    bit = lambda b: f"(case when (k * 5 + {b}) % 2 = 0 then ({x}) >> (29 - (k * 5 + {b}) // 2) else ({y}) >> (29 - (k * 5 + {b}) // 2) end & 1) * {16 >> b}"
    return f"array_to_string(list_transform(generate_series(0, {p - 1}), lambda k: substring('{geo.ALPHABET}', ({' + '.join(bit(b) for b in range(5))})::int + 1, 1)), '')"


_CELL = f"""select *, list_reduce(list_prepend(0::bigint, list_transform(string_split(h, ''), lambda c: (position(c in '{geo.ALPHABET}') - 1)::bigint)), lambda a, c: a * 32 + c) as v, len(h) * 5 as bits from (select event_id, {_duck_hash("lat", "lon", 7)} as h from {_POINT})"""
_XY = f"""select *, list_sum(list_transform(generate_series(0, 17), lambda i: ((v >> (34 - 2 * i)) & 1) << (17 - i)))::bigint as x, list_sum(list_transform(generate_series(0, 16), lambda i: ((v >> (33 - 2 * i)) & 1) << (16 - i)))::bigint as y from ({_CELL})"""


@query(f"select event_id, {_duck_hash('lat', 'lon', 12)} as h12, {_duck_hash('lat', 'lon', 5)} as h5 from {_POINT}")
def geohash_encode(spark, sf_dir):
    return _points(spark, sf_dir).select("event_id", geo.encode("lat", "lon").alias("h12"), geo.encode("lat", "lon", 5).alias("h5"))


@query(f"""select event_id, h, round(((y + 0.5) * (180.0::double / 131072) - 90) * 10000) / 10000 as lat,
round(((x + 0.5) * (360.0::double / 262144) - 180) * 10000) / 10000 as lon, round(y * (180.0::double / 131072) - 90, 9) as south, round((x + 1) * (360.0::double / 262144) - 180, 9) as east from ({_XY})""")
def geohash_decode(spark, sf_dir):
    h = _points(spark, sf_dir).select("event_id", geo.encode("lat", "lon", 7).alias("h"))
    return geo.with_decoded(h, "h").select("event_id", "h", "lat", "lon", F.round("south", 9).alias("south"), F.round("east", 9).alias("east"))


def _duck_neighbour(dx: int, dy: int) -> str:
    x, y = f"((x + {dx} + 262144) % 262144 << 12)", f"((y + {dy} + 131072) % 131072 << 13)"
    bit = lambda b: f"(case when (k * 5 + {b}) % 2 = 0 then {x} >> (29 - (k * 5 + {b}) // 2) else {y} >> (29 - (k * 5 + {b}) // 2) end & 1) * {16 >> b}"
    return f"array_to_string(list_transform(generate_series(0, 6), lambda k: substring('{geo.ALPHABET}', ({' + '.join(bit(b) for b in range(5))})::int + 1, 1)), '')"


@query(f"select event_id, {', '.join(f'{_duck_neighbour(*geo._STEPS[d])} as {d}' for d in geo._STEPS)} from ({_XY})")
def geohash_neighbors(spark, sf_dir):
    return geo.with_neighbors(_points(spark, sf_dir).select("event_id", geo.encode("lat", "lon", 7).alias("h")), "h").drop("h")


@query("select * from (values (1, 'ezs42', 0), (2, 'u4pruydqqvj8', 1), (3, 'u4pruydqqvjw', 5)) t(id, h, places)")
def geohash_shortest(spark, sf_dir):
    rows = spark.createDataFrame([(1, 42.605, -5.603, 0.0), (2, 57.64911, 10.40744, 0.5), (3, 57.649111, 10.407440, 5.12345)], "id int, lat double, lon double, v double")
    return rows.select("id", geo.encode_shortest("lat", "lon").alias("h"), geo.decimals("v").alias("places"))


_SHAPES = [(1, [[10.0, 10.0], [10.0, 60.5], [50.0, 60.5], [50.0, 10.0]]), (2, [[-40.0, -120.0], [20.0, -30.5], [-10.0, 80.25]]), (3, [[0.0, 0.0], [40.0, 40.0], [0.0, 80.0], [20.0, 40.5]])]
_SHAPES_SQL = "(values " + ", ".join(f"({i}, {p})" for i, p in _SHAPES) + ") s(shape_id, polygon)"


@query(f"""with e as (select shape_id, polygon[i] as a, polygon[case when i = 1 then len(polygon) else i - 1 end] as b from (select *, unnest(generate_series(1, len(polygon))) as i from {_SHAPES_SQL}))
select event_id, shape_id from {_POINT} p, e where lon < greatest(a[2], b[2]) and lon > least(a[2], b[2]) and lat < (b[1] - a[1]) * (lon - a[2]) / (b[2] - a[2]) + a[1] group by event_id, shape_id having count(*) % 2 = 1""")
def point_in_polygon(spark, sf_dir):
    shapes = spark.createDataFrame(_SHAPES, "shape_id int, polygon array<array<double>>")
    return geo.join_polygons(_points(spark, sf_dir), shapes, cell=10.0).select("event_id", "shape_id")


@query("select * from (values (1, 2, false), (1, 3, true), (1, 4, false), (1, 5, false), (2, 3, true), (2, 4, false), (2, 5, false), (3, 4, true), (3, 5, false), (4, 5, false)) t(a, b, cross_)")
def polygons_intersect(spark, sf_dir):
    more = [(4, [[20.0, 20.0], [20.0, 30.0], [30.0, 30.0], [30.0, 20.0]]), (5, [[80.0, 80.0], [85.0, 80.0], [85.0, 90.0]])]
    s = spark.createDataFrame(_SHAPES + more, "id int, polygon array<array<double>>")
    pairs = s.alias("x").join(s.alias("y"), F.col("x.id") < F.col("y.id"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), geo.polygons_cross("x.polygon", "y.polygon").alias("cross_"))


# ---------------------------------------------------------------- sensitive words

_BAD = ["stupid", "scum", "scumbag", "tr ash", "Loser", "ing", "hing"]
_BAD_SQL = "(values " + ", ".join(f"('{w}')" for w in sensitive.normalise(_BAD)) + ") w(word)"
_BAD_RX = sensitive.pattern(_BAD)


@query(f"select doc_id, exists(select 1 from {_BAD_SQL} where contains(text, word)) as hit from documents")
def sensitive_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sensitive.contains("text", _BAD).alias("hit"))


def _hits_sql(words: list[str]) -> str:
    most = max(map(len, words))
    ahead = "".join(f", lead(ch, {k}) over w as c{k}" for k in range(1, most))
    spelt = lambda n: " || ".join(["ch", *(f"c{k}" for k in range(1, n))])
    heads = ", ".join(sorted({f"'{w[0]}'" for w in words}))
    one = lambda n: f"select doc_id, (i - 1)::int as position, {spelt(n)} as word from places where ch in ({heads})"
    return f"""with places as materialized (select doc_id, i, ch{ahead} from (select doc_id, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) as i from documents) window w as (partition by doc_id order by i))
select doc_id, position, word from ({' union all '.join(one(n) for n in sorted({len(w) for w in words}))}) join {_BAD_SQL} using (word)"""


@query(_hits_sql(sensitive.normalise(_BAD)))
def sensitive_hits(spark, sf_dir):
    return sensitive.hits(table(spark, sf_dir, "documents"), spark.createDataFrame([(w,) for w in _BAD], "word string"))


@query(f"select conv_id, turn, case when regexp_matches(text, '{_BAD_RX}') then regexp_replace(text, '{_BAD_RX}', '**', 'g') end as masked from conversations")
def sensitive_replace(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sensitive.replace("text", _BAD).alias("masked"))


# ---------------------------------------------------------------- helpers


@query("""select c_custkey, list_reduce(list_prepend(596579247::bigint, list_reverse(list_transform(string_split(c_name, ''), lambda c: ascii(c)::bigint))), lambda h, b: xor(h + (h << 5), b) & 2147483647) % 800000 as slot from customer""")
def term_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.term_hash("c_name", 800000).alias("slot"))


@query("select conv_id, turn, translate(to_base64(encode(text)), '+/=', '-_*') as coded, true as back from conversations")
def base64_variant(spark, sf_dir):
    coded = table(spark, sf_dir, "conversations").withColumn("coded", text.url_base64("text"))
    return coded.select("conv_id", "turn", "coded", (text.from_url_base64("coded") == F.col("text")).alias("back"))


@query("select page_id, case when position('.example.' in lower(url)) > 0 then substring(url, 1, position('.example.' in lower(url)) - 1) else url end as host, case when position('/' in url) > 0 then substring(url, 1, position('/' in url)) else url end as scheme from pages")
def substr_before(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.cut_before("url", ".EXAMPLE.").alias("host"), text.cut_before("url", "/", True).alias("scheme"))


@query("select page_id, regexp_replace(url, '[A-Za-z]+', ' \\0 ', 'g') as padded from pages")
def pad_words(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.pad_words("url").alias("padded"))


@query("select * from (values (1, true, true), (2, true, true), (3, false, false), (4, true, false), (5, false, false), (6, true, false), (7, false, false)) t(id, date_time, date_only)")
def date_valid(spark, sf_dir):
    rows = spark.createDataFrame([(1, "2023-02-31"), (2, "31-12-2023"), (3, "2023-13-01"), (4, "2023-01-01 23:59:59"), (5, "2023-01-01 24:00:00"), (6, "01-02-2023 00:00:00"), (7, "x")], "id int, d string")
    return rows.select("id", dates.is_date_time("d").alias("date_time"), dates.is_date("d").alias("date_only"))


@query("select event_id, floor(epoch(ts))::bigint as seconds from events")
def date_epoch(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.to_epoch("ts").alias("seconds"))


@query("select ts::varchar as day, event_type as term, n, rank::int as rank from (select ts::date as ts, event_type, count(*) as n, row_number() over (partition by ts::date order by count(*) desc, event_type) as rank from events group by 1, 2) where rank <= 3")
def search_stats_daily(spark, sf_dir):
    return stats.daily(table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("term")), 3).withColumn("day", F.col("day").cast("string"))


_MONEY = [("0", "零圆整", "零圆整"), ("0.05", "零圆伍分", "零圆伍分"), ("10", "壹拾圆整", "壹拾圆整"), ("1005.5", "壹仟零伍圆伍角", "壹仟零伍圆伍角"), ("123456", "壹拾贰万叁仟肆佰伍拾陆圆整", "壹拾贰万叁仟肆佰伍拾陆圆整"), ("100010", "壹拾万零壹拾圆整", "壹拾万零壹拾圆整"), ("1234560000", "壹拾贰亿叁仟肆佰伍拾陆万圆整", "壹拾贰亿叁仟肆佰伍拾陆万圆整"), ("100000000", "壹亿万圆整", "壹亿圆整"), ("-0.5", "零圆伍角", "负零圆伍角"), ("abc", "零圆整", "零圆整")]


@query("select * from (values " + ", ".join(map(str, _MONEY)) + ") t(amount, compat, strict)")
def money_words(spark, sf_dir):
    rows = spark.createDataFrame([(a,) for a, _, _ in _MONEY], "amount string")
    return rows.select("amount", money.chinese_money("amount").alias("compat"), money.chinese_money("amount", "strict").alias("strict"))


@query("select * from (values ('中国', 'zhongguo', 'ZG', 'Z'), ('全文检索', 'quanwenjiansuo', 'QWJS', 'Q'), ('重庆', 'zhongqing', 'ZQ', 'Z'), ('ABC检索', 'abcjiansuo', 'ABCJS', 'A'), ('鑫', '', 'U', 'U')) t(t, pinyin, initials, first)")
def romanised(spark, sf_dir):
    rows = spark.createDataFrame([("中国",), ("全文检索",), ("重庆",), ("ABC检索",), ("鑫",)], "t string")
    return rows.select("t", pinyin.pinyin("t").alias("pinyin"), pinyin.initials("t").alias("initials"), pinyin.first_letter("t").alias("first"))


_WORDS = "中国 中国人 国人 人民 人民银行 银行 桌子 子上 桌子上 身上 照耀 阳光 在身 中华 中华人民 华人 中华人民共和国 共和国 共和 人民共和国".split()


def _words(spark) -> frozenset[str]:
    base = spark.createDataFrame([(w,) for w in [*_WORDS, "民银"]], "word string")
    return segment.load(segment.dictionary(base, None, spark.createDataFrame([("民银",)], "word string")))


@query("select * from (values ('中国人民银行', '中国,人民银行'), ('我', '我'), ('的桌子上', '的,桌子上'), ('书在桌子上', '书,在,桌子上'), ('阳光照耀在身上', '阳光,照耀,在身,上'), ('engine.v2 银行, ok', 'engine.v2,银行,,,ok')) t(t, tokens)")
def segment_precise(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in ("中国人民银行", "我", "的桌子上", "书在桌子上", "阳光照耀在身上", "engine.v2 银行, ok")], "t string")
    return rows.select("t", F.array_join(segment.segmenter(_words(spark))("t"), ",").alias("tokens"))


@query("select * from (values ('中国人民银行', '中国,人民银行,银行,人民', '中国,国人,人民,银行,中国人,人民银行'), ('', null, '')) t(t, tokens, sub)")
def segment_full(spark, sf_dir):
    rows = spark.createDataFrame([("中国人民银行",), ("",)], "t string")
    words = _words(spark)
    return rows.select("t", F.array_join(segment.segment_all("t", words), ",").alias("tokens"), F.array_join(segment.segmenter(words, "sub")("t"), ",").alias("sub"))


@query("select * from (values (2, 1.386294::double), (1, 0.693147::double)) t(doc_id, score)")
def match_segmented(spark, sf_dir):
    rows = spark.createDataFrame([(1, "中国人民银行"), (2, "人民银行的人民银行"), (3, "中国人民"), (4, "银行")], "doc_id long, body string")
    words = spark.createDataFrame([(w,) for w in _WORDS], "word string")
    index = Index(spark, store.new_folder(spark, "segmented"), dictionary=words)
    index.create(Mapping("han", (Field("doc_id", "primarykey"), Field("body", "text", index=True, analyzer="segment"))))
    index.add(rows)
    index.build()
    return index.search({"match": {"field": {"name": "body", "query": "人民银行"}, "_source": ["doc_id"]}}).withColumn("score", F.round("score", 6))


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_orderstatus")
def cached_result(spark, sf_dir):
    results = cache.ResultCache(spark, store.new_folder(spark, "cache"))
    rows = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    results.put("orders", {"by": "status"}, rows, ttl=600)
    return results.get("orders", {"by": "status"})


@query()
def fake_people(spark, sf_dir):
    f = Fake("id", seed=7)
    kinds = {"full_name": f.full_name(), "name": f.name(), "number": f.number(), "phone": f.phone_number(), "email": f.email(), "address": f.address(), "active": f.boolean(), "han": f.text(), "code": f.text("ascii", 12), "uuid": f.uuid(), "born": f.date("1950-01-01", "2020-12-31"), "hex": f.color(), "rgb": f.color("rgb"), "rgba": f.color("rgba"), "hsl": f.color("hsl"), "employee": f.employee_id(), "ip4": f.ip(), "ip6": f.ip("v6"), "user": f.user_name(), "company": f.company_name()}
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).select("id", *(c.alias(k) for k, c in kinds.items()))
