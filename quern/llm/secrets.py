"""Secret scans: how many guesses a value takes that stands where a credential would.

Contexts are names such as ``password=``, ``token:``, ``accessToken:`` or
``signing_key=`` (keys of tables and the like, ``_PLAIN_KEYS``, are left out),
a scheme's word (``Authorization: Basic``), quotes with blanks, URLs with a
password, and well-known key formats.  The credential word is found first and
its name is followed to the left by hand, so that a scan is linear in the text.
Each value is cut into dictionary words, dates, repeats, keyboard walks and
brute-force spans so that the sum of their costs (log2 of guesses, plus
``SPLIT_BITS`` a segment) is least; values of ``THRESHOLD_BITS`` or more are
secrets, cheaper ones (``password=changeme``, ``the secret: international``)
are placeholders or prose.  References to where a secret is kept
(``process.env.SECRET_KEY``, ``${TOKEN}``, ``get_password()``) aren't secrets.

The dictionary ranks :data:`WORDS` first, then the words and parts of words of
public subword vocabularies, which are ordered by how common they are; they
are read by path, and ``words`` adds more.  The dynamic program is linear in
the value and stops where a value is certain to cost ``MOST_BITS``, which is
the most that is reported.

Defined results: null and empty texts have no secrets; every occurrence is a
row of its own, also within repeated rows; doc_id keeps its type, a null one
is reported as null; extra columns are carried by :func:`redact` (where
``n_chars`` is an integer column, it is kept up to date) and ignored by
:func:`scan`; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import textnp as T
from quern.llm.bpe import VOCABULARY

#: Where the ranks of common words come from.
VOCABULARIES = (VOCABULARY, VOCABULARY.replace("byte_bpe", "byte_bpe_multi"))
#: Letters of the shortest and the longest word taken from there.
WORD_CHARS = (4, 24)
#: Words that the caller may add, at most.
MOST_WORDS = 1_000_000
MOST_BITS = 256.0
THRESHOLD_BITS = 40.0
SPLIT_BITS = 1.0
MASK = "[SECRET]"
#: Common words of passwords, the commonest first; also used for placeholders.
WORDS = (
    "password pass admin secret token letmein welcome login master hello monkey dragon shadow qwerty sunshine princess football baseball superman"
    " batman trustno changeme change example sample test testing demo default user root guest public private key value your here insert enter"
    " the and none null true false undefined placeholder redacted hidden removed dummy fake temp temporary access auth api client server"
    " service account database prod production staging dev development local localhost company summer winter spring autumn monday friday"
    " january february march april june july august september october november december love money computer internet system config string"
    " correct horse battery staple orange apple banana cookie flower charlie jordan michael thomas robert daniel andrew george william"
).split()


class Dictionary:
    """Ranks of common words, the commonest first."""

    _made: dict[tuple, Dictionary] = {}

    def __init__(self, paths: tuple[str, ...], extra: tuple[str, ...] = ()):
        self.rank = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
        least, most = WORD_CHARS
        for path in paths:
            with open(path, "rb") as f:
                for n, line in enumerate(f, len(WORDS) + 1):
                    w = base64.b64decode(line.split()[0]).decode("utf-8", "replace").strip().lower()
                    if least <= len(w) <= most and w.isalpha():
                        self.rank[w] = min(n, self.rank.get(w, n))
        for w in extra:
            w = w.lower()
            if least <= len(w) <= 64:
                self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))
        self.heads, self.tails = {w[:3] for w in self.rank}, {w[:-4:-1] for w in self.rank}

    @classmethod
    def of(cls, paths: tuple[str, ...] = VOCABULARIES, extra: tuple[str, ...] = ()) -> Dictionary:
        if (paths, extra) not in cls._made:
            cls._made[paths, extra] = cls(paths, extra)
        return cls._made[paths, extra]


_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_KEY = {c: (r, x + r * 0.5) for r, row in enumerate(_ROWS) for x, c in enumerate(row)}
_ALPHABETS: tuple[tuple[frozenset[str], float], ...] = (
    (frozenset("-_./ "), 2.0),
    (frozenset("0123456789"), math.log2(10)),
    (frozenset("0123456789abcdef"), 4.0),
    (frozenset("0123456789ABCDEF"), 4.0),
    (frozenset("abcdefghijklmnopqrstuvwxyz"), math.log2(26)),
    (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), math.log2(26)),
    (frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), math.log2(62)),
    (frozenset(map(chr, range(33, 127))), math.log2(94)),
)
_ANY = 16.0
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
_PERIODS = 8

_NAME = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|key"
#: Names in ``key`` that no credential has.
_PLAIN_KEYS = frozenset("primary foreign public partition sort cache row group index lookup map dict hash join unique natural surrogate order object registry shortcut hot answer".split())
_SCHEME = r"(?:(?:bearer|basic|digest|token|negotiate|ntlm|apikey)[ \t]+)?"
#: A credential word with what parts it from a value; AWS-like, hub-like, URL and PEM forms have a value only.
CONTEXT = re.compile(
    rf"(?P<name>{_NAME})[\"']?[ \t]*(?:=>|:=|=|:)[ \t]*"
    r"|(?<![A-Za-z0-9])(?P<aws>AKIA[0-9A-Z]{16})(?![0-9A-Z])"
    r"|(?<![A-Za-z0-9])(?P<hub>gh[pousr]_[0-9A-Za-z]{36,})"
    r"|://[^\s/:@]+:(?P<url>[^\s/@]+)@"
    r"|(?P<pem>-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----)",
    re.IGNORECASE,
)
VALUE = re.compile(
    rf"\"{_SCHEME}(?:(?P<q>[^\"\s]+)\"|(?P<qb>[^\"\s][^\"\r\n]*)\"(?![A-Za-z0-9]))|'{_SCHEME}(?:(?P<a>[^'\s]+)'|(?P<ab>[^'\s][^'\r\n]*)'(?![A-Za-z0-9]))|{_SCHEME}(?:\"(?P<sq>[^\"\s]+)\"|'(?P<sa>[^'\s]+)'|(?P<v>[^\s\"',;<>|]+))",
    re.IGNORECASE,
)
_PREFILTER = rf"(?:{_NAME})[\"']?[ \t]*[:=]|AKIA[0-9A-Z]{{16}}|gh[pousr]_|://[^\s/:@]+:|PRIVATE KEY"
_TEMPLATE = re.compile(r"\$\{[^}]*\}?|\$\(.*|\$[A-Z_][A-Z0-9_]*|\{\{.*|%\(?[A-Za-z_]+\)?[sd]?%?|<[^>]*>?|\[[A-Z _-]+\]")
_PATH = re.compile(r"[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)*[(\[][\w.()\[\]]*|[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def _name_start(text: str, word: str, at: int, floor: int) -> int:
    """Where the name begins whose credential word stands at ``at``, or -1 where the word is part of another."""
    before = text[at - 1] if at > floor else ""
    low, key = word.lower(), word.lower() == "key"
    camel = bool(before) and (before.islower() or before.isdigit()) and before.isascii() and word[0].isupper()
    begin = at
    if before.isalpha() and before.isascii():
        if not (camel or low == "secret"):
            return -1
    if camel or low == "secret":
        while begin > floor and at - begin < 64 and text[begin - 1].isascii() and text[begin - 1].isalnum():
            begin -= 1
    if key:
        if not camel and not (before in ("_", "-") and at - 2 >= floor and text[at - 2].isascii() and text[at - 2].isalnum()):
            return -1
        near = _PARTS.findall(text[max(floor, at - 12) : at].rstrip("_-"))
        if near and near[-1].lower() in _PLAIN_KEYS:
            return -1
    while begin - 1 > floor and text[begin - 1] in "_.-" and text[begin - 2].isascii() and text[begin - 2].isalnum():
        begin -= 1
        while begin > floor and text[begin - 1].isascii() and text[begin - 1].isalnum():
            begin -= 1
    return begin


def is_reference(value: str, quoted: bool, words: Dictionary) -> bool:
    """Whether a value only says where the secret is: a template, or code whose names are words."""
    if _TEMPLATE.fullmatch(value):
        return True
    plain = value.rstrip(";,)")
    if quoted or not (_PATH.fullmatch(value) or _PATH.fullmatch(plain)):
        return False
    parts = _PARTS.findall(value)
    known = sum(len(p) for p in parts if p.lower() in words.rank)
    return all(len(p) <= 3 or p.lower() in words.rank for p in parts) and known * 2 >= sum(map(len, parts))


def segments(value: str, words: Dictionary | None = None) -> list[tuple[int, int, float, str]]:
    """(start, end, bits, kind) of all words, dates, repeats and walks of a value."""
    n, low = len(value), value.lower()
    words = words or Dictionary.of()
    rank, longest = words.rank, words.longest
    if len(low) != n:
        # letters whose lower case is longer stay as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    found: list[tuple[int, int, float, str]] = []
    for i in range(n):
        some = low[i : i + 3] in words.heads or plain[i : i + 3] in words.heads or low[i : i + 3] in words.tails
        for j in range(i + 3, min(n, i + longest) + 1) if some else ():
            for form, extra in ((low[i:j], 0.0), (plain[i:j], 1.0), (low[i:j][::-1], 1.0)):
                if form in rank:
                    upper = sum(c.isupper() for c in value[i:j])
                    case = 0.0 if not upper else 1.0 if upper in (1, j - i) else math.log2(math.comb(j - i, min(upper, j - i - upper)) + 1)
                    found.append((i, j, math.log2(rank[form] + 1) + extra + case, "word"))
                    break
        for m in (_DATE.match(value, i, min(n, i + 10)),):
            if m:
                found.append((i, m.end(), math.log2(119 * 365) + 1 if m.end() - i > 4 else math.log2(119), "date"))
    for p in range(1, min(_PERIODS, n // 2) + 1):
        run = 0
        for i in range(n - p - 1, -1, -1):
            run = run + 1 if value[i] == value[i + p] else 0
            times = run // p + 1
            if times >= 2 and times * p >= 3:
                found.append((i, i + times * p, _brute(value[i : i + p]) + math.log2(times) + SPLIT_BITS, "repeat"))
    i = 0
    while i + 2 < n:
        j, turns, way = i + 1, 0, None
        while j < n and (step := _step(low[j - 1], low[j])) is not None:
            turns += way is not None and step != way
            way, j = step, j + 1
        if j - i >= 3:
            found.append((i, j, math.log2(47) + math.log2(j - i) + 2 * turns + 2, "walk"))
        i = max(i + 1, j - 1)
    return found


def _step(a: str, b: str) -> tuple[int, float] | None:
    if a not in _KEY or b not in _KEY or a == b:
        return None
    (r, x), (s, y) = _KEY[a], _KEY[b]
    return (s - r, y - x) if abs(s - r) <= 1 and abs(y - x) <= 1 else None


def _brute(span: str) -> float:
    return len(span) * min((bits for chars, bits in _ALPHABETS if all(c in chars for c in span)), default=_ANY)


def guess_bits(value: str, words: Dictionary | None = None) -> float:
    """Least cost of a segmentation of the value, in bits; ``MOST_BITS`` where it is more."""
    words = words or Dictionary.of()
    return _short(value, words) if len(value) <= 64 else _bits(value, words)


@lru_cache(1 << 16)
def _short(value: str, words: Dictionary) -> float:
    return _bits(value, words)


def _bits(value: str, words: Dictionary) -> float:
    size, most = 512, max(words.longest, 2 * _PERIODS) + 1
    while size < len(value):
        # whatever the rest is, a segmentation passes one of the last places before a cut, or goes on with a segment that is as cheap before it
        if min(_least(value[:size], words)[-most:]) >= MOST_BITS:
            return MOST_BITS
        size *= 4
    return min(_least(value, words)[-1], MOST_BITS)


def _least(value: str, words: Dictionary) -> list[float]:
    """Least costs of all beginnings of a value."""
    n = len(value)
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, bits, _ in segments(value, words):
        ending.setdefault(j, []).append((i, bits))
    kinds = len(_ALPHABETS)
    best = [0.0] + [math.inf] * n
    brute = [math.inf] * (kinds + 1)
    for j in range(1, n + 1):
        c, start = value[j - 1], best[j - 1] + SPLIT_BITS
        for k in range(kinds):
            chars, bits = _ALPHABETS[k]
            brute[k] = min(brute[k], start) + bits if c in chars else math.inf
        brute[kinds] = min(brute[kinds], start) + _ANY
        best[j] = min(min(brute), min((best[i] + bits + SPLIT_BITS for i, bits in ending.get(j, ())), default=math.inf))
    return best


def find(text: str, words: Dictionary | None = None) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, name, bits) of each secret of a text."""
    words = words or Dictionary.of()
    at = floor = 0
    while m := CONTEXT.search(text, at):
        name = m.group("name")
        if name is None:
            g, v = next(k for k in ("aws", "hub", "url", "pem") if m.group(k) is not None), m
        else:
            begin = _name_start(text, name, m.start(), floor)
            v = VALUE.match(text, m.end()) if begin >= 0 else None
            if v is None:
                at = m.end("name")
                continue
            g = next(k for k in ("q", "qb", "a", "ab", "sq", "sa", "v") if v.group(k) is not None)
            name = text[begin : m.end("name")]
        at = floor = v.end()
        value = v.group(g)
        if g in ("aws", "hub", "pem") or not is_reference(value, g != "v", words):
            bits = guess_bits(value, words)
            if bits >= THRESHOLD_BITS:
                yield v.start(g), v.end(g), (name or g).lower(), bits


def _suspects(column: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(column, _PREFILTER, ignore_case=True), False)).to_pylist()


def _added(words: DataFrame | None) -> tuple[str, ...]:
    """The caller's words (column ``word``), in order; more than ``MOST_WORDS`` are refused."""
    if words is None:
        return ()
    rows = words.select("word").where("word is not null").distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    return tuple(sorted(r["word"] for r in rows))


def scan(docs: DataFrame, words: DataFrame | None = None, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """doc_id, start (character), length, name, bits of each secret."""
    extra, kind = _added(words), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary.of(vocabularies, extra)
        for batch in batches:
            for part in T.pieces(batch, "text"):
                column = part.column("text")
                found = [(i, s, e - s, name, round(bits, 6)) for i in _suspects(column) for s, e, name, bits in find(column[i].as_py(), known)]
                i, s, n, name, bits = zip(*found, strict=True) if found else ((),) * 5
                yield pa.record_batch({"doc_id": part.column("doc_id").take(pa.array(i, pa.int64())), "start": pa.array(s, pa.int64()), "length": pa.array(n, pa.int64()), "name": pa.array(name, pa.string()), "bits": pa.array(bits, pa.float64())})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length long, name string, bits double")


def masked(text: str, words: Dictionary | None = None) -> str:
    out, at = [], 0
    for s, e, _, _ in find(text, words):
        out += [text[at:s], MASK]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, words: DataFrame | None = None, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """The rows with each secret's value replaced by ``MASK``."""
    extra = _added(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary.of(vocabularies, extra)
        for batch in batches:
            for part in T.pieces(batch, "text"):
                at = part.schema.get_field_index("text")
                column = part.column(at)
                new = {i: masked(column[i].as_py(), known) for i in _suspects(column)}
                new = {i: t for i, t in new.items() if t != column[i].as_py()}
                if new:
                    mask = pa.array([i in new for i in range(len(column))])
                    part = part.set_column(at, part.schema.field(at), pc.replace_with_mask(column, mask, pa.array(list(new.values()), column.type)))
                    size = part.schema.get_field_index("n_chars")
                    if size >= 0 and pa.types.is_integer(part.schema.field(size).type):
                        counts = pa.array([len(t) for t in new.values()]).cast(part.schema.field(size).type)
                        part = part.set_column(size, part.schema.field(size), pc.replace_with_mask(part.column(size), mask, counts))
                yield part

    return T.map_rows(docs, run)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
