"""The ten operators and the pipeline on odd tables, against brute force."""

import math
import random
import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

import corpus_pipeline
from test_pure import library
from quern.llm import bpe, decontaminate, html, quality, queries, secrets, sharding, simhash, suffix, tokenids, toxicity
from quern.llm import textnp as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(11)
VOCABULARY = ["w" + "".join(R.choice("abcdefgh") for _ in range(R.randrange(2, 9))) for _ in range(600)]


def prose(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n)) + "."


PASSAGE = prose(60)
COPY = prose(200)
LONG = prose(20_000)
TEXTS = [
    (1, COPY), (2, COPY), (3, COPY.replace(COPY.split()[5], "changed", 1)), (4, prose(80) + " " + PASSAGE + " " + prose(70)), (5, PASSAGE + "\n" + prose(10)),
    (6, prose(150)), (7, None), (8, ""), (9, "   \n\t"), (10, "one"), (11, LONG), (11, LONG), (None, COPY), (12, "日本語 テキスト 한국어 " * 30), (13, prose(49)), (14, 'x password=b7db7aa4a5fcc78305 and token: changeme'),
    (15, "you idiot, you worthless scum, what a moron you are"), (16, 'he wrote "idiot" and nothing else ' + prose(30)), (17, LONG[:5000] + prose(100)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in TEXTS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(docs):
    """Columns that clash with names used inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("a.b", "a b", "tick`", "anchor", "score", "f0", "bucket", "wanted", "n", "shard", "tokens", "item_id", "keep", "u", "v", "count")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE[:200]), (2, prose(30)), (3, None), (4, ""), (None, COPY), (5, "two words"), (1, PASSAGE[:200])], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(15, 1, 1), (6, 1, 0), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_spans(texts, window):
    words = defaultdict(list)
    import pyarrow as pa

    for i, t in dict.fromkeys(texts):
        if i is not None and t:
            words[i].append(T.word_hashes(pa.array([t]))[0].tolist())
    where = defaultdict(set)
    for i, many in words.items():
        for w in many:
            for a in range(len(w) - window + 1):
                where[tuple(w[a : a + window])].add(i)
    out = []
    for i, many in words.items():
        for w in many:
            spans = []
            for a in range(len(w) - window + 1):
                d = where[tuple(w[a : a + window])]
                if len(d) > 1:
                    spans.append((a, a + window, min(d)))
            merged = []
            for s, e, f in spans:
                if merged and s <= merged[-1][1]:
                    merged[-1][1], merged[-1][2] = max(e, merged[-1][1]), min(f, merged[-1][2])
                else:
                    merged.append([s, e, f])
            out += [(i, s, e - s, f) for s, e, f in merged]
    return sorted(out)


def brute_cut(texts, window):
    where, out = defaultdict(set), []
    for i, t in texts:
        if i is not None and t:
            w = re.findall("[a-z0-9]+", t.lower())
            for a in range(len(w) - window + 1):
                where[tuple(w[a : a + window])].add(i)
    for i, t in texts:
        if i is not None and t:
            found = list(re.finditer("[A-Za-z0-9]+", t))
            w, gone = [m.group().lower() for m in found], set()
            for a in range(len(w) - window + 1):
                if min(where[tuple(w[a : a + window])]) < i:
                    gone |= set(range(a, a + window))
            ends = [m.start() for m in found[1:]] + [len(t)]
            t = t[: found[0].start() if found else len(t)] + "".join(t[m.start() : e] for k, (m, e) in enumerate(zip(found, ends)) if k not in gone)
        out.append((i, t))
    return sorted(out, key=repr)


def test_suffix_dedup(spark, docs, odd, empty):
    got = rows(suffix.repeated_passages(docs))
    assert got == sorted(brute_spans(TEXTS, 50), key=repr) and {r[0] for r in got} == {1, 2, 3, 4, 5, 11, 17}
    assert rows(suffix.repeated_passages(odd)) == got
    assert rows(suffix.repeated_passages(empty)) == []


def test_suffix_dedup_random(spark):
    r = random.Random(5)
    texts = []
    base = [[r.choice("abcde") + str(r.randrange(4)) for _ in range(60)] for _ in range(4)]
    for i in range(40):
        w = []
        for _ in range(3):
            b = list(r.choice(base))
            a = r.randrange(30)
            b = b[a : a + r.randrange(5, 50)]
            if r.random() < 0.5:
                b[r.randrange(len(b))] = "zz"
            w += b
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for window, anchor, symbols in ((12, 5, 50), (12, 5, 100_000), (20, 8, 1000)):
        assert rows(suffix.repeated_passages(df, window, anchor, symbols)) == sorted(brute_spans(texts, window), key=repr)
    # hot anchors split by their windows' words, ids that repeat with other texts, and what is left of the texts
    texts += [(i, texts[(i * 7) % 40][1] + " tail") for i in range(0, 40, 5)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for kinds in (1, 3, 1000):
        assert rows(suffix.repeated_passages(df, 12, 5, 100_000, kinds)) == sorted(brute_spans(texts, 12), key=repr)
    assert rows(suffix.drop_passages(df, 12, 5, 100_000, 2)) == brute_cut(texts, 12)


def test_drop_passages(spark, docs, odd, empty):
    left = suffix.drop_passages(odd)
    assert left.columns == odd.columns and left.count() == len(TEXTS)
    ascii_ = [(i, t) for i, t in TEXTS if i != 12]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] != 12), key=repr) == brute_cut(ascii_, 50)
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.collect()) and suffix.drop_passages(empty).count() == 0


def test_quality(docs, odd, empty):
    got = {r["doc_id"]: r for r in quality.assess(docs).collect()}
    assert quality.assess(docs).count() == len(TEXTS) and quality.assess(empty).count() == 0
    assert not got[7]["keep"] and not got[8]["keep"] and "words" in got[8]["failed"]
    assert got[8]["failed"] == "words,word_length" and got[8]["variety"] == 1
    assert rows(quality.assess(odd)) == rows(quality.assess(docs))


def test_quality_rules_hold_alike_below_and_above_twenty_words(spark):
    repeated = [" ".join(["the", "same"] * (n // 2) + ["word"]) for n in (6, 16, 18, 20, 22, 60)]
    varied = [" ".join(f"{c}bcd" for c in "the quick fox of a day".replace(" ", "")[:n]) + " the." for n in (1, 3, 10, 17)]
    table = "a | b\nc | d\ne of the | f\ng | h"
    texts = [*enumerate(repeated), *enumerate(varied, 10), (20, table), (21, "A line.\r\nAnother of the lines.\r\n"), (22, "Word")]
    got = {r["doc_id"]: r for r in quality.assess(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    values = [got[k]["variety"] for k in range(6)]
    assert values == sorted(values, reverse=True) and values[1] < 0.78 < values[0]
    assert all("variety" not in got[k]["failed"] for k in (10, 11, 12, 13, 22))
    assert "open_lines" in got[20]["failed"] and got[21]["open_line_ratio"] == 0 and got[21]["keep"] and got[22]["keep"]
    for r in got.values():
        text = dict(texts)[r["doc_id"]]
        assert r["variety"] == round(math.log(len(set(text.lower().replace(".", " ").replace("|", "|").split())) + 10) / math.log(len(text.replace(".", " ").split()) + 10), 6)


def test_bpe(docs, odd, empty):
    b = bpe.Bpe.of(bpe.VOCABULARY)
    got = bpe.encode_documents(docs, leaf=64).collect()
    want = sorted(((i, library(t) if t is not None else None) for i, t in TEXTS), key=repr)
    assert sorted(((r["doc_id"], r["tokens"]) for r in got), key=repr) == want and all(r["round_trip"] for r in got)
    back = bpe.decode_documents(bpe.encode_documents(odd)).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(TEXTS, key=repr)
    assert [r["text"] for r in bpe.decode_documents(docs.sparkSession.createDataFrame([(1, [10**6]), (2, None), (3, []), (4, [None]), (5, [-1])], "doc_id long, tokens array<int>")).collect()] == [None, None, "", None, None]
    assert bpe.encode_documents(empty).count() == 0 and bpe.encode_documents(odd).count() == len(TEXTS)


def test_secrets(docs, odd, empty):
    assert [(r[0], r[3]) for r in rows(secrets.scan(docs))] == [(14, "password")]
    assert secrets.scan(odd).count() == 1 and secrets.scan(empty).count() == 0
    clean = {(r["doc_id"], r["text"]): r["n_chars"] for r in secrets.redact(odd).collect()}
    assert len(clean) == len(set(TEXTS)) and (14, "x password=[SECRET] and token: changeme") in clean
    assert all(n == len(t or "") for (_, t), n in clean.items())


def test_html(spark):
    pages = spark.createDataFrame([(1, "<p>" + prose(40) + "</p>"), (2, None), (3, ""), (None, "<div"), (1, "<p>" + "x " * 50_000)], "page_id long, html string")
    got = rows(html.extract(pages))
    assert len(got) == 5 and sorted(r[4] for r in got) == [0, 0, 0, 40, 50_000]
    assert html.extract(pages.where("false")).count() == 0
    from pyspark.sql import functions as F

    assert html.extract(pages.withColumn("text", F.lit("clash"))).count() == 5


def brute_groups(texts, limit):
    import pyarrow as pa

    codes = []
    for i, t in texts:
        h = T.word_hashes(pa.array([t], pa.string()))[0]
        if i is not None and len(h):
            codes.append((i, simhash.fingerprint(h)))
    root = {i: i for i, _ in codes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in codes:
        for b, y in codes:
            if a < b and np.bitwise_count(x ^ y).sum() <= limit:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in root}


def test_simhash(docs, odd, empty):
    groups = brute_groups(TEXTS, simhash.MAX_BITS)
    got = simhash.duplicates(docs).collect()
    assert {r["doc_id"]: r["duplicate_of"] for r in got} == {i: g for i, g in groups.items() if i != g}
    assert {1: 1, 2: 1, 3: 1}.items() <= groups.items()
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([i for i in groups if groups[i] == i] + [7, 8, 9, None], key=repr)
    assert simhash.duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_simhash_recall(spark):
    r = random.Random(8)
    texts = []
    for i in range(300):
        base = [r.choice(VOCABULARY) + str(r.randrange(50)) for _ in range(100)]
        texts.append((2 * i, " ".join(base)))
        for k in range(r.randrange(1, 8)):
            base[r.randrange(100)] = f"new{k}"
        texts.append((2 * i + 1, " ".join(base)))
    groups = brute_groups(texts, simhash.MAX_BITS)
    want = {i for i, g in groups.items() if i != g}
    got = {x["doc_id"] for x in simhash.duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 200


def brute_contaminated(texts, items, window, least):
    import pyarrow as pa

    words = lambda t: T.word_hashes(pa.array([t], pa.string()))[0].tolist()
    out = []
    for i, t in texts:
        w = words(t)
        for item in {j for j, x in items if j is not None and x}:
            strings = set()
            for j, x in items:
                if j == item and x:
                    v = words(x)
                    m = min(window, len(v))
                    if m >= least:
                        strings |= {tuple(v[a : a + m]) for a in range(len(v) - m + 1)}
            hits = [a for m in {len(s) for s in strings} for a in range(len(w) - m + 1) if tuple(w[a : a + m]) in strings]
            if hits:
                out.append((i, item, len(hits), min(hits)))
    return sorted(out, key=repr)


def test_decontamination(docs, odd, empty, benchmark):
    items = [tuple(r) for r in benchmark.collect()]
    got = rows(decontaminate.contaminated(docs, benchmark))
    assert got == brute_contaminated(TEXTS, items, decontaminate.WINDOW, decontaminate.LEAST) and {r[0] for r in got} == {4, 5}
    assert rows(decontaminate.contaminated(odd, benchmark)) == got
    assert decontaminate.drop_contaminated(odd, benchmark).count() == len(TEXTS) - 2
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("false")).count() == 0


def test_large_benchmarks_take_several_passes(spark, docs, benchmark, monkeypatch):
    more = benchmark.union(spark.createDataFrame([(1, COPY[:300]), (8, PASSAGE[50:250]), (8, prose(20)), (9, "changed"), (2, PASSAGE)], benchmark.schema))
    want = rows(decontaminate.contaminated(docs, more))
    assert want == brute_contaminated(TEXTS, [tuple(r) for r in more.collect()], decontaminate.WINDOW, decontaminate.LEAST)
    assert any(r[1] == 9 for r in want) and len({(r[0], r[1]) for r in want if r[0] not in (None, 11)}) == len([r for r in want if r[0] not in (None, 11)])
    for most in (5, 12, 60):
        monkeypatch.setattr(decontaminate, "MAX_WINDOWS", most)
        assert len(decontaminate._passes(decontaminate._items(more))) > 1
        assert rows(decontaminate.contaminated(docs, more)) == want


def test_sharding(spark, docs, odd, empty, tmp_path):
    t = sharding.ShardedTable(spark, str(tmp_path / "t"), target=40_000, arrival=2_000, fan_in=2)
    for k in range(5):
        assert t.append(odd) == t.version()
    with pytest.raises(sharding.Conflict):
        t.commit(t.version(), [])
    before = t.manifest()
    t.compact()
    assert rows(t.read().select(*("`" + c.replace("`", "``") + "`" for c in odd.columns))) == sorted([tuple(r) for r in odd.collect()] * 5, key=repr)
    assert len(t.manifest()) < len(before) and not t.plan(t.manifest())
    assert sum(e.rows for e in t.manifest()) == 5 * len(TEXTS)
    t.append(empty)
    assert t.read().count() == 5 * len(TEXTS)
    got = sharding.shard_documents(spark, docs, str(tmp_path / "u")).collect()
    assert len(got) == len({(r["shard"], r["place"]) for r in got}) == len(TEXTS)
    assert sharding.shard_documents(spark, empty, str(tmp_path / "v")).count() == 0


def test_toxicity(docs, odd, empty, labels):
    assert [r["doc_id"] for r in toxicity.toxic_documents(docs, labels).collect()] == [15]
    left = toxicity.filter_toxic(odd, labels)
    assert left.columns == odd.columns and left.count() == len(TEXTS) - 1
    assert toxicity.toxic_documents(empty, labels).count() == 0
    assert toxicity.toxic_documents(docs, labels.where("false")).count() == 1


def test_token_ids(spark, docs, odd, empty, tmp_path):
    b = bpe.Bpe.of(bpe.VOCABULARY)
    folder = str(tmp_path / "ids")
    got = tokenids.write_shards(odd, folder, shard_tokens=500).collect()
    want = sorted(((i, library(t or "")) for i, t in TEXTS), key=repr)
    shards = {r["shard"]: tokenids.Shard(folder, r["shard"]) for r in got}
    read = [(r["doc_id"], shards[r["shard"]].tokens(r["place"]).tolist()) for r in got]
    assert sorted(read, key=repr) == want
    assert all(r["start"] == shards[r["shard"]].bounds.select(r["place"]) for r in got)
    assert tokenids.write_shards(empty, folder).count() == 0


def test_pipeline(spark, sf_dir, odd, benchmark, labels, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == odd.columns, name
    b = bpe.Bpe.of(bpe.VOCABULARY)
    groups = brute_groups([x for x in TEXTS if x[0] != 15], simhash.MAX_BITS)
    kept = {(i, t) for i, t in TEXTS if i is None or i in (7, 8, 9) or groups.get(i) == i}
    kept = [(i, secrets.masked(t) if t else t) for i, t in kept if i not in (4, 5)]
    want = sorted(((i, library(t) if t is not None else None) for i, t in kept), key=repr)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["tokens"]) for r in got), key=repr) == want
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_queries_run(spark, sf_dir):
    assert sorted(queries.queries()) == sorted(f"op{n}_{x}" for n, x in enumerate("suffix_dedup quality_rules bpe secrets html_extract simhash decontaminate sharding toxicity token_ids".split(), 1))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_decontamination_finds_typographic_copies(spark):
    item = 'why don\'t they say "it\'s late" when the clock - at last - strikes twelve'
    copy = item.replace('say "', "say “").replace('late"', "late”").replace("'", "’").replace(" - ", " — ")
    docs = spark.createDataFrame([(1, "x " + copy + " y", "en", "s", 9), (2, prose(40), "en", "s", 9)], DOCS)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()] == [2]


def brute_toxic(texts, labels):
    """Terms by counting in plain Python, hits by edit distance to every term, contexts by reading along."""
    from test_pure import swapped

    chosen = {i: x for i, _, x in labels if i is not None and x is not None}
    seen, kinds = defaultdict(lambda: [set(), 0, 0]), set()
    for i, t in texts:
        if i in chosen and t:
            w = re.findall(r"[a-z0-9]+", t.lower())
            ring = [w[-1], *w, w[0]]
            here = defaultdict(list)
            for k, x in enumerate(w):
                if len(x) >= 3:
                    here[x].append((ring[k], ring[k + 2]))
            for x, c in here.items():
                seen[x][2 - chosen[i]] += len(c)
                if chosen[i]:
                    seen[x][0].add(frozenset(c) if len(c) > 1 else c[0])
    forms = defaultdict(lambda: [0, 0, 0])
    for x, (places, bad, clean) in seen.items():
        for f in {x + "$", *(x[:n] for n in range(4, max(4, min(9, len(x))) + 1))}:
            if len(f) >= 4:
                forms[f] = [a + b for a, b in zip(forms[f], (len(places), clean, 1 if places else 0))]
                if f.endswith("$"):
                    kinds |= {f} if places else set()
    bad, clean = sum(v[1] for v in seen.values() if v), sum(v[2] for v in seen.values())
    terms = list(toxicity.SEED)
    if bad and clean:
        n = sum(1 for f, v in forms.items() if v[2] and (v[0] >= 4 or f.endswith("$")))
        least = max(4, math.ceil((math.log(n) + math.log(100)) / -math.log(bad / (bad + clean))))
        terms += [f[:-1] for f, v in forms.items() if f.endswith("$") and v[0] >= least and v[1] * 20 <= v[0]]
    return terms, {x for x, v in seen.items() if v[2]}, swapped


def test_toxicity_equals_brute_force(spark):
    r = random.Random(21)
    texts, labels = [], []
    for i in range(240):
        words = [r.choice(VOCABULARY) for _ in range(r.randrange(8, 40))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grubnik", "moron", "idoit", "vlonker"]))
            words.insert(r.randrange(len(words)), "grubnik")
        if i % 11 == 5:
            words.insert(3, '"')
            words.insert(5, r.choice(["moron", "idiot"]))
            words.insert(6, '"')
        texts.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    terms, clean, distance = brute_toxic(texts, labels)
    assert "grubnik" in terms
    want = set()
    for i, t in texts:
        score, words, quoted, k = 0.0, [w for w in t.split() if w != '"'], False, 0
        for w in t.split():
            if w == '"':
                quoted = not quoted
                continue
            d = min((0 if w == x else 1 if len(x) >= 5 and abs(len(x) - len(w)) < 2 and distance(w, x) == 1 else 9) for x in terms)
            if d == 0 or d == 1 and w not in clean | set(toxicity.CLEAN_NEAR):
                left, right = words[max(0, k - 4) : k], words[k + 1 : k + 4]
                score += 0.2 if quoted else 0.4 if toxicity.REPORTING & set(left) else 1.5 if toxicity.ADDRESS & set(left[-3:] + right) else 1.0
            k += 1
        if score >= 1.5:
            want.add((i, round(score, 6)))
    got = toxicity.toxic_documents(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(x["doc_id"], x["score"]) for x in got.collect()} == want and len(want) > 40


class BrutePage(HTMLParser):
    """Blocks of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.text, self.linked, self.hidden, self.link = [], "", 0, None, False

    def flush(self):
        words = self.text.split()
        if words:
            self.found.append((" ".join(words), len(words), min(self.linked, len(words))))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in html._HIDDEN:
            self.flush()
            self.hidden = tag
        elif tag == "a":
            self.link = True
        elif tag not in html._INLINE:
            self.flush()
            self.link = False

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = None if tag == self.hidden else self.hidden
        elif tag == "a":
            self.link = False
        elif tag not in html._INLINE:
            self.flush()
            self.link = False

    def handle_data(self, data):
        if not self.hidden:
            self.text += data
            self.linked += len(data.split()) * self.link


def brute_extract(page, tree):
    p = BrutePage()
    p.feed(page)
    p.close()
    p.flush()
    b, kept = p.found, []
    for k, (text, words, links) in enumerate(b):
        x = []
        for near in (k - 1, k, k + 1):
            x += [b[near][1], b[near][2] / b[near][1]] if 0 <= near < len(b) else [0, 0]
        node = tree.root
        while not isinstance(node, int):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        if node:
            kept.append((text, words))
    return "\n".join(t for t, _ in kept), len(b), len(kept), sum(w for _, w in kept)


def test_html_equals_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    tree = html.train()
    want = sorted(((r["page_id"], *brute_extract(r["html"], tree)) for r in pages.collect()), key=repr)
    assert rows(html.extract(pages)) == want and len(want) >= 200
    some = [(1, '<div title="a > b"><p>one two three</p><a href=x>l m</a> n &amp; o &lt;p&gt;<br>z</div><script>if (a<b) "</p>"</script>after it')]
    assert rows(html.extract(spark.createDataFrame(some, "page_id long, html string"))) == [(1, *brute_extract(some[0][1], tree))]


def test_a_dead_writer_holds_nobody_up(spark, docs, tmp_path):
    t = sharding.ShardedTable(spark, str(tmp_path / "t"), lease=60)
    t.append(docs)
    # one died before the checksum, one right after creating
    for k, text in ((2, '{"version": 2, "shards": ['), (2, "")):
        (tmp_path / "t" / f"manifest-{k:010d}.json").write_text(text)
        assert t.version() == 1 and t.read().count() == len(TEXTS)
    with pytest.raises(sharding.Conflict):
        t.commit(2, [])
    t.lease = 0
    assert t.append(docs) == 2 and t.read().count() == 2 * len(TEXTS)
    with pytest.raises(sharding.Conflict):
        t.commit(2, [])


def test_a_writer_taken_for_dead_learns_of_it(spark, docs, tmp_path):
    slow, fast = (sharding.ShardedTable(spark, str(tmp_path / "t"), lease=0) for _ in range(2))
    load, calls = slow._load, []

    def late(version):
        # between writing and reading back, another writer replaces the manifest
        if not calls:
            calls.append(1)
            slow._fs.delete(slow._manifest_path(version), False)
            fast.commit(version, [])
        return load(version)

    slow._load = late
    with pytest.raises(sharding.Conflict):
        slow.commit(1, [])


def test_readers_and_old_versions_survive_compaction(spark, docs, tmp_path):
    t = sharding.ShardedTable(spark, str(tmp_path / "t"), target=1 << 20, arrival=2_000, fan_in=2)
    t.append(docs)
    old = t.read()
    first = t.version()
    for _ in range(3):
        t.append(docs)
    t.compact()
    assert old.count() == t.read(first).count() == len(TEXTS)
    orphan = tmp_path / "t" / "shard-orphan.parquet"
    orphan.write_bytes(b"x")
    assert t.vacuum() == 0 and orphan.exists() and t.read(first).count() == len(TEXTS)
    assert t.vacuum(1, 0) > 1 and not orphan.exists() and t.read().count() == 4 * len(TEXTS)
    with pytest.raises(FileNotFoundError):
        t.read(first)


def test_appends_and_merges_side_by_side(spark, docs, tmp_path):
    a, b = (sharding.ShardedTable(spark, str(tmp_path / "t"), target=1 << 20, arrival=2_000, fan_in=2) for _ in range(2))
    a.append(docs)
    shards = a.manifest()
    b.append(docs)
    assert a.change([], shards[:1]) == 3 and a.read().count() < 2 * len(TEXTS)
    with pytest.raises(sharding.Conflict):
        b.change([], shards[:1])


def test_arrivals_with_other_columns(spark, docs, tmp_path):
    t = sharding.ShardedTable(spark, str(tmp_path / "t"), target=1 << 20, arrival=2_000, fan_in=2)
    for part in (docs, docs.drop("lang"), docs.withColumnRenamed("lang", "a.b"), docs):
        t.append(part)
    t.compact()
    got = t.read()
    assert got.count() == 4 * len(TEXTS) and set(got.columns) == {*docs.columns, "a.b"} and len({e.schema for e in t.manifest()}) == 3
    assert got.where("lang is null").count() == 2 * len(TEXTS)


def test_merge_plans_equal_brute_force(spark, tmp_path):
    r = random.Random(4)
    t = sharding.ShardedTable(spark, str(tmp_path / "t"), target=1000, arrival=20, fan_in=3)
    for _ in range(60):
        shards = [sharding.Entry(f"s{i}", 1, r.choice([5, 11, 29, 31, 95, 300, 499, 500, 2000]) + r.randrange(3), r.choice("xy")) for i in range(r.randrange(40))]
        groups = t.plan(shards)
        names = [e.name for g in groups for e in g]
        assert len(names) == len(set(names))
        for g in groups:
            assert len({e.schema for e in g}) == 1 and sum(e.size for e in g) <= 1000 and len(g) > 1 and max(e.size for e in g) < 500
            assert math.floor(math.log(max(10, min(e.size for e in g)) / 10, 3) + 1e-9) == math.floor(math.log(max(10, max(e.size for e in g)) / 10, 3) + 1e-9)
        # what is left of a tier and schema makes no full run
        for tier in range(8):
            for x in "xy":
                rest = [e for e in shards if e.name not in names and e.schema == x and e.size < 500 and 10 * 3**tier <= max(10, e.size) < 10 * 3 ** (tier + 1)]
                assert len(rest) < 3 or sum(e.size for e in rest) > 1000 - 500


def test_simhash_parts_hot_buckets(spark):
    r = np.random.default_rng(18)
    # a dense group, a chain that hangs on to it, a loose crowd of alike leading bits, and strangers
    base = r.integers(0, 1 << 63, (1, 4), dtype=np.uint64)
    flip = lambda codes, k: codes ^ np.packbits(np.stack([r.permutation(256) < k for _ in codes]), axis=1).view(">u8").astype(np.uint64)
    dense = flip(np.repeat(base, 3000, 0), 8)
    chain = [base]
    for _ in range(6):
        chain.append(flip(chain[-1], 24))
    crowd = np.concatenate([np.full((1500, 1), 5, np.uint64), r.integers(0, 1 << 63, (1500, 3), dtype=np.uint64)], axis=1)
    codes = np.concatenate([dense, *chain[1:], crowd, r.integers(0, 1 << 63, (500, 4), dtype=np.uint64)])
    df = spark.createDataFrame([(i, *map(int, c.view(np.int64))) for i, c in enumerate(codes)], "doc_id long, f0 long, f1 long, f2 long, f3 long")
    parts, edges = simhash._parted(df, 5, 4, 7919, 400, 48)
    assert len(parts) > 1 and sum(p.count() for p in parts) < 12 * 4 * len(codes)
    got = simhash.components(simhash.near_pairs(df, len(codes), 48, bucket=100, cell=32)).collect()
    assert {x["id"] for x in got} == set(range(1, 3006)) and {x["root"] for x in got} == {0}


def test_ids_of_other_types(spark, docs):
    named = docs.withColumn("doc_id", docs["doc_id"].cast("string"))
    for refused in (suffix.repeated_passages, simhash.duplicates):
        with pytest.raises(TypeError):
            refused(named)
    assert {r["doc_id"] for r in quality.assess(named).collect()} >= {"1", None} and secrets.scan(named).first()["doc_id"] == "14"


def test_the_first_row_of_a_repeated_id_stays(spark):
    rows_ = [(5, prose(30), "b", None), (5, "zz " + prose(30), "a", 1), (5, None, None, None), (6, prose(40), "x", 2)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, `a.b` string, x int")
    first = simhash.drop_near_duplicates(df.repartition(3)).collect()
    assert sorted(r["doc_id"] for r in first) == [5, 6]
    assert sorted(map(tuple, simhash.drop_near_duplicates(df.repartition(2)).collect()), key=repr) == sorted(map(tuple, first), key=repr)
