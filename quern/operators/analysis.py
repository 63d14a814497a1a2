"""Tokenisers over built-in expressions, and the registry of analyzers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN = r"\x{4E00}-\x{9FA5}"
#: Runs of one script, words of ASCII letters, digits and dots, or one mark; all else is dropped.
BLOCKS = rf"""[{HAN}]+|[\x{{3040}}-\x{{309F}}]+|[\x{{30A0}}-\x{{30FF}}]+|[\x{{AC00}}-\x{{D7AF}}]+|[a-zA-Z0-9.]+|[-_+!@#$%^&*()|}}{{“”：":?><,./';\[\]~～！￥…（）—？》《·。，℃、；]"""
#: What :func:`standard` gives, in one pass: blocks with ASCII letters or digits whole, every other character of a block by itself.
#: Dots are tried as the beginning of a block only where a run of them begins, so that long runs take linear time.
TOKENS = rf"""[a-zA-Z0-9][a-zA-Z0-9.]*+|(?<!\.)\.++[a-zA-Z0-9][a-zA-Z0-9.]*+|[{HAN}\x{{3040}}-\x{{309F}}\x{{30A0}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}{BLOCKS[BLOCKS.rindex("[-_+") + 1 :]}"""
WORDS = r"[\p{L}\p{N}.]+"

Analyzer = Callable[[Column], Column]
_REGISTRY: dict[str, Analyzer] = {}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def register(name: str, analyzer: Analyzer) -> None:
    """Makes an analyzer (a function of a text column to an array of tokens) known to mappings."""
    _REGISTRY[name] = analyzer


def analyzer(name: str) -> Analyzer:
    if name not in _REGISTRY:
        raise KeyError(f"unknown analyzer {name!r}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def blocks(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(BLOCKS), F.lit(0))


def _per_block(text: Column | str, han: Analyzer) -> Column:
    def one(b: Column) -> Column:
        return F.when(b.rlike("[a-zA-Z0-9]"), F.array(b)).when(b.rlike(f"^[{HAN}]"), han(b)).otherwise(_chars(b))

    return F.flatten(F.transform(blocks(text), one))


def _chars(b: Column) -> Column:
    return F.split(b, "")


def standard(text: Column | str, lowercase: bool = False) -> Column:
    """Blocks with ASCII letters or digits whole, all others per character (what a dictionary without words gives)."""
    out = F.regexp_extract_all(_col(text), F.lit(TOKENS), F.lit(0))
    return F.transform(out, lambda t: F.lower(t)) if lowercase else out


def ngram_block(block: Column, n: int) -> Column:
    """Windows of n characters; a shorter block is its own."""
    size = F.length(block)
    return F.when(size <= n, F.array(block)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(block, i, F.lit(n))))


def ngrams(text: Column | str, n: int | tuple[int, int] = 3) -> Column:
    """Character n-grams of Han blocks, other blocks as in :func:`standard`; a range joins its sizes, each gram of a block once."""
    if isinstance(n, int):
        return _per_block(text, lambda b: ngram_block(b, n))
    return _per_block(text, lambda b: F.array_distinct(F.concat(*(ngram_block(b, k) for k in range(n[0], n[1] + 1)))))


def unicode_words(text: Column | str) -> Column:
    """Lower-case words of any script."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORDS), F.lit(0))


def without_stop_words(tokens: Column | str, stop: Iterable[str]) -> Column:
    """Tokens that aren't in the list; order and repetitions stay."""
    words = sorted(set(stop))
    return F.filter(_col(tokens), lambda t: ~t.isin(words)) if words else _col(tokens)


def with_idf(tokens: DataFrame, dictionary: DataFrame, default: float = 5.0) -> DataFrame:
    """Rows with a column ``token``, and the dictionary's ``idf`` of it or the default."""
    d = dictionary.groupBy(F.col("word").alias("token")).agg(F.max("idf").alias("idf"))
    return tokens.join(d, "token", "left").withColumn("idf", F.coalesce("idf", F.lit(default)))


def top_terms(tokens: DataFrame, k: int = 500) -> DataFrame:
    """rank, token, n of the k most frequent tokens; ties by token."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)
    from pyspark.sql import Window

    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")).cast("long")).select("rank", "token", "n")


def STANDARD(c: Column) -> Column:
    """What "standard" and, without a dictionary, "segment" are; :func:`blocks.standard` gives the same tokens in a worker."""
    return standard(c, lowercase=True)


register("standard", STANDARD)
register("segment", STANDARD)
register("ngram", ngrams)
register("unicode_words", unicode_words)
register("keyword", lambda c: F.array(c.cast("string")))
