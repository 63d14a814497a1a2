"""Toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon is a small built-in list plus terms learnt from a bounded sample of
labelled documents (:func:`learn_terms`): whole words, and stems that stand for
any word beginning with them.  All terms form one trie.  Each distinct word of
a text gets a Levenshtein automaton that is walked together with the trie, so
that misspelt terms are found without a list of misspellings: one letter more,
less or other, or two neighbours swapped.  Terms under ``FUZZY_CHARS`` letters
are found with two neighbours swapped only, stems exactly only.  Digits that
look like letters (``1d10t``) are read as those letters.  A byte-pair table drops,
without loss, the words that no term can be within the edit bound of.

A misspelt hit counts like an exact one, unless the word is known to be clean:
it is in ``CLEAN_NEAR``, or in a clean row of the sample.  Each hit is scored
from its context: hits inside quotation marks count less (marks are paired
within a paragraph, however long the quotation is; a mark without a partner
quotes nothing), so do hits up to ``REPORT_WORDS`` words after a reporting
verb, and direct address (``ADDRESS_WORDS`` before and after) counts more.  A
document is toxic if the sum reaches ``THRESHOLD`` and ``PER_WORD`` a word.

Defined results: null and empty texts score 0 and are kept; rows are judged
one by one, so ties, repeated rows and null ids change nothing; extra columns
are carried by :func:`filter_toxic` and ignored by :func:`toxic_documents`.
Without labelled rows only the built-in list is used.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import textnp as T

SEED = "idiot idiots idiotic moron morons moronic stupid scum scumbag loser losers pathetic worthless disgusting trash clown clowns imbecile dumbass bastard cretin vermin subhuman degenerate jackass".split()
#: Words within an edit of a term of SEED that aren't misspellings of it, in English, German, French and Spanish; more are learnt from the labelled rows.
CLEAN_NEAR = (
    "idiom idioms boron boronic morn moro moros moran morin morton mormon mormons moroni mouron looser closer closers lose loses losen losel laser lasers lower lowers lover lovers loner loners "
    "poser posers hoser moser leser doser oser loger louer lober loster losser lesers crash brash thrash rash tras trass crown crowns blown flown clow cloven apathetic bathetic bustard bustards dastard "
    "cretan creatin vermis termin verein hermin regenerate jackals"
).split()
#: Labelled rows that the lexicon is learnt from, at most.
SAMPLE = 20_000
#: Chance that a harmless lexicon term is learnt at all.
ALPHA = 0.01
#: A term occurs in clean rows at most once for so many toxic occurrences.
CLEAN_IN_TOXIC = 20
STEM_CHARS = (4, 9)
THRESHOLD = 1.5
PER_WORD = 0.0005
MAX_EDITS = 1
FUZZY_CHARS = 5
WEIGHT = {"exact": 1.0, "fuzzy": 1.0, "quoted": 0.2, "reported": 0.4, "addressed": 1.5}
REPORTING = frozenset("said says saying word words term terms called calls quote quoted quotes slur slurs insult insults wrote phrase phrases means".split())
ADDRESS = frozenset("you your youre yours u ur yourself".split())
REPORT_WORDS = 4
ADDRESS_WORDS = 3
#: Quotation marks, a straight one or what may close an opening one.
_QUOTES = re.compile('\n|["“”«»„‟‹›]')
_CLOSES = {"“": "”", "„": "“”‟", "‟": "”“", "«": "»", "»": "«", "‹": "›", "›": "‹", "”": "”"}
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457", b"oieast", strict=True):
    _LEET[_a] = _b
_LEET_STR = str.maketrans("013457", "oieast")


# ---------------------------------------------------------------- automata


class LevenshteinAutomaton:
    """Accepts the strings within ``k`` edits of a word; states are sparse rows of the edit table."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.k, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], char: str) -> tuple[tuple[int, int], ...]:
        word, k, row = self.word, self.k, []
        if state and state[0][0] == 0 and state[0][1] < k:
            row.append((0, state[0][1] + 1))
        for j, (i, cost) in enumerate(state):
            if i == len(word):
                break
            new = cost + (word[i] != char)
            if row and row[-1][0] == i:
                new = min(new, row[-1][1] + 1)
            if j + 1 < len(state) and state[j + 1][0] == i + 1:
                new = min(new, state[j + 1][1] + 1)
            if new <= k:
                row.append((i + 1, new))
        return tuple(row)

    def distance(self, state: tuple[tuple[int, int], ...]) -> int | None:
        return state[-1][1] if state and state[-1][0] == len(self.word) else None


class SwapAutomaton(LevenshteinAutomaton):
    """The same with two neighbours swapped as one edit; a state holds the last two rows and the last character."""

    def start(self):
        return (), super().start(), ""

    def step(self, state, char: str):
        older, row, last = state
        word, k, new = self.word, self.k, {}
        for i, cost in row:
            new[i] = min(new.get(i, k + 1), cost + 1)
            if i < len(word):
                new[i + 1] = min(new.get(i + 1, k + 1), cost + (word[i] != char))
        for i, cost in older:
            if i + 1 < len(word) and word[i] == char and word[i + 1] == last:
                new[i + 2] = min(new.get(i + 2, k + 1), cost + 1)
        for i in range(min(new), len(word)) if new else ():
            if i in new and new[i] < k:
                new[i + 1] = min(new.get(i + 1, k + 1), new[i] + 1)
        after = tuple(sorted((i, cost) for i, cost in new.items() if cost <= k))
        return (row, after, char) if after else ()

    def distance(self, state) -> int | None:
        return super().distance(state[1]) if state else None


def swaps(term: str) -> set[str]:
    """The term with two neighbours swapped."""
    return {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)} - {term}


class Trie:
    """Terms and stems as nested dicts; ``""`` holds (term, is_stem)."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.root: dict = {}
        for term, stem in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, stem or node.get("", ("", False))[1])

    def match(self, word: str, k: int = MAX_EDITS) -> tuple[str, int] | None:
        """Nearest term and its distance: whole words within k edits (short ones with two neighbours swapped), stems exactly."""
        best: tuple[str, int] | None = None
        node = self.root
        for c in word:
            node = node.get(c)
            if node is None:
                break
            if "" in node and node[""][1]:
                return node[""][0], 0
        else:
            if "" in node:
                return node[""][0], 0
        if k <= 0:
            return None
        auto = SwapAutomaton(word, k)
        stack = [(self.root, auto.start())]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    term, stem = child
                    d = auto.distance(state)
                    if d is not None and not stem and (len(term) >= FUZZY_CHARS or word in swaps(term)) and (best is None or (d, term) < (best[1], best[0])):
                        best = (term, d)
                elif after := auto.step(state, c):
                    stack.append((child, after))
        return best


class Matcher:
    """Trie, byte-pair tables and clean neighbours, made once a worker."""

    def __init__(self, terms: list[tuple[str, bool]], clean: list[str], k: int = MAX_EDITS):
        self.trie, self.k, self.clean = Trie(terms), k, frozenset(clean) | frozenset(CLEAN_NEAR)
        self.cache: dict[bytes, tuple[str, int] | None] = {}
        self.first, self.last = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        for term, stem in terms:
            raw = term.encode()
            fuzzy = not stem and len(term) >= FUZZY_CHARS and k > 0
            # a whole edit may change up to four bytes of UTF-8
            slack = 4 * k if fuzzy and not term.isascii() else k if fuzzy else 0
            lengths = 0
            for n in range(64):
                if (n >= min(len(raw), 63)) if stem else abs(n - min(len(raw), 63)) <= (slack if term.isascii() else max(slack, 4 * fuzzy)):
                    lengths |= 1 << n
            if len(raw) >= 2:
                self.first[raw[0] << 8 | raw[1]] |= np.uint64(lengths)
                if fuzzy:
                    self.last[raw[-2] << 8 | raw[-1]] |= np.uint64(lengths)
            if not stem and not fuzzy and k > 0:
                for other in map(str.encode, swaps(term)):
                    self.first[other[0] << 8 | other[1]] |= np.uint64(1 << min(len(other), 63))

    def maybe(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Indices of the words that may be within the bound of a term: with one edit, the first or the last two bytes are kept."""
        size = ends - starts
        long = np.flatnonzero(size >= 3)
        s, e = starts[long], ends[long]
        pre = data[s].astype(np.int32) << 8 | data[s + 1]
        suf = data[e - 2].astype(np.int32) << 8 | data[e - 1]
        bits = (self.first[pre] | self.last[suf]) >> np.minimum(size[long], 63).astype(np.uint64)
        return long[(bits & np.uint64(1)).astype(bool)]

    def look(self, raw: bytes) -> tuple[str, int] | None:
        if raw in self.cache:
            return self.cache[raw]
        word = raw.decode("utf-8", "replace")
        hit = self.trie.match(word.translate(_LEET_STR), self.k)
        if hit and hit[1] and (word in self.clean or word.isdigit()):
            hit = None
        if len(self.cache) > 300_000:
            self.cache.clear()
        self.cache[raw] = hit
        return hit


# ---------------------------------------------------------------- scoring


def quotations(text: str) -> list[tuple[int, int]]:
    """(opening mark, closing mark) of the quotations of a text, in bytes of its UTF-8 form, in order."""
    out: list[tuple[int, int]] = []
    opened: tuple[int, str] | None = None
    at = done = 0
    for m in _QUOTES.finditer(text):
        c = m.group()
        at += len(text[done : m.start()].encode())
        done = m.start()
        if c == "\n":
            opened = None
        elif opened is None:
            opened = (at, _CLOSES.get(c, c))
        elif c in opened[1]:
            out.append((opened[0], at))
            opened = None
    return out


def context_weight(quoted: bool, left: list[str], right: list[str]) -> float:
    """Weight of a hit between the words next to it."""
    if quoted:
        return WEIGHT["quoted"]
    if REPORTING.intersection(left[-REPORT_WORDS:]):
        return WEIGHT["reported"]
    if ADDRESS.intersection(left[-ADDRESS_WORDS:]) or ADDRESS.intersection(right[:ADDRESS_WORDS]):
        return WEIGHT["addressed"]
    return 1.0


def score_column(column: pa.Array, matcher: Matcher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, hits, quoted or reported hits, words) of each text."""
    data, offs = T.buffer_of(column)
    data = T.fold(data)
    starts, ends, first = T.split(data, offs, T.ALNUM)
    n = len(offs) - 1
    score, hits, soft = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    plain = _LEET[data]
    found = matcher.maybe(plain, starts, ends)
    rows = np.searchsorted(first, found, "right") - 1
    raw = data.tobytes() if len(found) else b""
    marks: dict[int, tuple[list[int], list[int]]] = {}
    for i, r in zip(found.tolist(), rows.tolist(), strict=True):
        s, e = int(starts[i]), int(ends[i])
        hit = matcher.look(raw[s:e])
        if hit is None:
            continue
        if r not in marks:
            pairs = quotations(raw[offs[r] : offs[r + 1]].decode("utf-8", "replace"))
            marks = {r: ([a for a, _ in pairs], [b for _, b in pairs])}
        k = bisect(marks[r][0], s - offs[r])
        quoted = k > 0 and marks[r][1][k - 1] > s - offs[r]
        near = [raw[starts[j] : ends[j]].decode("utf-8", "replace") for j in range(max(int(first[r]), i - REPORT_WORDS), min(int(first[r + 1]), i + ADDRESS_WORDS + 1))]
        here = min(REPORT_WORDS, i - int(first[r]))
        weight = context_weight(quoted, near[:here], near[here + 1 :])
        score[r] += weight * (WEIGHT["exact"] if hit[1] == 0 else WEIGHT["fuzzy"])
        hits[r] += 1
        soft[r] += weight < 1
    return score, hits, soft, np.diff(first)


def is_toxic(score: np.ndarray, words: np.ndarray) -> np.ndarray:
    return score >= np.maximum(THRESHOLD, PER_WORD * words)


# ---------------------------------------------------------------- learning


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, place, bad, clean): a row for each word of a toxic row, with its smallest context and its count; counts of words in the others."""
    for batch in batches:
        for part in T.pieces(batch, "text"):
            data, offs = T.buffer_of(part.column("text"))
            data = T.fold(data)
            starts, ends, first = T.split(data, offs, T.ALNUM)
            if not len(starts):
                continue
            h = T.hashes(data, starts, ends)
            row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
            bad = np.asarray(part.column("toxic").to_pylist(), np.int64)[row] == 1
            ok = (ends - starts >= 3) & (ends - starts <= 60)
            before, after = np.roll(h, 1), np.roll(h, -1)
            with np.errstate(over="ignore"):
                place = T.mix(before * np.uint64(3) + after * np.uint64(5)).view(np.int64)
            raw = data.tobytes()
            i = np.flatnonzero(ok & bad)
            i = i[np.lexsort((place[i], h[i], row[i]))]
            new = np.ones(len(i), bool)
            new[1:] = (h[i[1:]] != h[i[:-1]]) | (row[i[1:]] != row[i[:-1]])
            many = np.diff(np.append(np.flatnonzero(new), len(i)))
            i = i[new]
            _, j, count = np.unique(h[ok & ~bad], return_index=True, return_counts=True)
            j = np.flatnonzero(ok & ~bad)[j]
            k = np.concatenate([i, j])
            yield pa.record_batch(
                {
                    "word": pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[k].tolist(), ends[k].tolist(), strict=True)], pa.string()),
                    "place": pa.array(place[k], mask=np.r_[np.zeros(len(i), bool), np.ones(len(j), bool)]),
                    "bad": pa.array(np.r_[many, np.zeros(len(j), np.int64)]),
                    "clean": pa.array(np.r_[np.zeros(len(i), np.int64), count]),
                }
            )


def learn_terms(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, alpha: float = ALPHA) -> tuple[list[tuple[str, bool]], list[str]]:
    """Terms (word, is_stem) that toxic rows use and others don't, and clean words next to a term.

    A term is taken if ``a`` toxic rows have it whose first contexts all
    differ, hardly any clean row does, and if ``a`` such rows by chance are
    improbable among all the terms looked at (``alpha``, Bonferroni).  One
    context a row keeps copies of a text, and one text's favourite word, from
    counting as evidence many times.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").alias("doc"), "text")
    rows = texts.join(F.broadcast(chosen.withColumnRenamed("doc_id", "doc")), "doc").select("text", "toxic")
    seen = rows.mapInArrow(_observe, "word string, place long, bad long, clean long")
    places = seen.groupBy("word", "place").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))
    words = places.groupBy("word").agg(F.count("place").alias("a"), F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    lo, hi = STEM_CHARS
    forms = words.select(
        F.explode(F.concat(F.array(F.concat(F.col("word"), F.lit("$"))), F.expr(f"transform(sequence({lo}, greatest({lo}, least({hi}, length(word)))), i -> substring(word, 1, i))"))).alias("form"), "word", "a", "clean", "bad"
    ).where(f"length(form) >= {lo}")
    both = forms.groupBy("form").agg(F.sum("a").alias("a"), F.sum("clean").alias("clean"), F.sum("bad").alias("bad"), F.count(F.when(F.col("a") > 0, 1)).alias("kinds")).where("a >= 4 or form like '%$'")
    total = both.agg(F.sum(F.when(F.col("form").endswith("$"), F.col("clean"))).alias("clean"), F.sum(F.when(F.col("form").endswith("$"), F.col("bad"))).alias("bad"), F.count(F.when(F.col("a") > 0, 1)).alias("kinds"))
    both = both.persist()
    try:
        sums = total.first()
        if not sums["bad"] or not sums["clean"]:
            return [(w, False) for w in SEED], []
        share = sums["bad"] / (sums["bad"] + sums["clean"])
        least = max(4, math.ceil((math.log(max(1, sums["kinds"])) + math.log(1 / alpha)) / -math.log(share)))
        # bounded by the sample: each term needs `least` of its toxic occurrences
        found = both.where(f"a >= {least} and clean * {CLEAN_IN_TOXIC} <= a").select("form", "a", "kinds").collect()
        terms = [(w, False) for w in SEED]
        stems: list[str] = []
        for r in sorted((r for r in found if not r["form"].endswith("$") and r["kinds"] > 1), key=lambda r: (len(r["form"]), r["form"])):
            if not any(r["form"].startswith(s) for s in stems):
                stems.append(r["form"])
        known = set(SEED)
        for r in found:
            w = r["form"][:-1]
            if r["form"].endswith("$") and w not in known and not any(w.startswith(s) for s in stems):
                terms.append((w, False))
        # a stem of a built-in word ("scum" of "scumbag") is that word's business
        terms += [(s, True) for s in stems]
        clean = both.where("clean > 0 and form like '%$'").select(F.expr("substring(form, 1, length(form) - 1)").alias("word"))
        heads = {t[:2] for t, s in terms if not s and len(t) >= FUZZY_CHARS}
        tails = {t[-2:] for t, s in terms if not s and len(t) >= FUZZY_CHARS}
        short = {w for t, s in terms if not s and len(t) < FUZZY_CHARS for w in swaps(t)}
        near = clean.where(F.substring("word", 1, 2).isin(list(heads)) | F.expr("right(word, 2)").isin(list(tails)) | F.col("word").isin(list(short)))
        sizes = {len(t) + d for t, s in terms if not s and len(t) >= FUZZY_CHARS for d in (-1, 0, 1)} | {len(w) for w in short}
        trie_terms = terms
        close = near.where(F.length("word").isin(list(sizes))).mapInArrow(lambda it: _close(it, trie_terms), "word string").collect()
        return sorted(set(terms)), sorted(r["word"] for r in close)
    finally:
        both.unpersist()


def _close(batches: Iterator[pa.RecordBatch], terms: list[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
    trie = Trie(terms)
    for batch in batches:
        kept = [w for w in batch.column(0).to_pylist() if (m := trie.match(w)) and m[1] > 0]
        yield pa.record_batch({"word": pa.array(kept, pa.string())})


# ---------------------------------------------------------------- operators


def toxic_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The toxic rows: doc_id, score, n_hits, n_soft (quoted or reported hits), n_words, toxic (true)."""
    terms, clean = learn_terms(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, clean)
        for batch in batches:
            for part in T.pieces(batch, "text"):
                score, hits, soft, words = score_column(part.column("text"), matcher)
                i = np.flatnonzero(is_toxic(score, words))
                yield pa.record_batch(
                    {"doc_id": part.column("doc_id").take(pa.array(i)), "score": pa.array(np.round(score[i], 6)), "n_hits": pa.array(hits[i]), "n_soft": pa.array(soft[i]), "n_words": pa.array(words[i]), "toxic": pa.array(np.ones(len(i), bool))}
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, n_hits long, n_soft long, n_words long, toxic boolean")


def filter_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows that aren't toxic, with all their columns."""
    terms, clean = learn_terms(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, clean)
        for batch in batches:
            for part in T.pieces(batch, "text"):
                score, _, _, words = score_column(part.column("text"), matcher)
                yield part.filter(pa.array(~is_toxic(score, words)))

    return T.map_rows(docs, run)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
