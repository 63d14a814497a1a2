"""Sensitive words: flags, all hits, replacement."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word lists up to this length become one regular expression, longer ones are joined.
MOST_IN_PATTERN = 2000


def normalise(words: list[str]) -> list[str]:
    """Lower case without white space and bars; empty words go."""
    return sorted({w for w in (re.sub(r"[\s|]+", "", w).lower() for w in words) if w})


def pattern(words: list[str]) -> str:
    """Alternation, longest first, in a form that Java and RE2 read alike."""
    ordered = sorted(normalise(words), key=lambda w: (-len(w), w))
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in ordered)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains(text: Column | str, words: list[str], case_sensitive: bool = True) -> Column:
    """Whether any word occurs anywhere; words are lower case, so capitals in the text don't match unless asked for."""
    c = _col(text) if case_sensitive else F.lower(_col(text))
    return c.rlike(pattern(words)) if normalise(words) else F.when(c.isNotNull(), F.lit(False))


def replace(text: Column | str, words: list[str], mask: str = "**", case_sensitive: bool = True) -> Column:
    """The text with hits replaced, longest first, left to right; null without a hit."""
    rx = pattern(words)
    flag = "" if case_sensitive else "(?i)"
    return F.when(contains(text, words, case_sensitive), F.regexp_replace(_col(text), flag + rx, mask.replace("\\", "\\\\").replace("$", "\\$")))


def hits(rows: DataFrame, words: DataFrame, text: str = "text", key: str = "doc_id", case_sensitive: bool = True) -> DataFrame:
    """(key, position from 0, word) of all hits, nested and overlapping ones too; repeated rows give their hits again.

    For short lists the text is split before each place where some word begins;
    with longer ones, substrings of the lengths that occur are joined with the list.
    """
    clean = words.select(F.lower(F.regexp_replace("word", r"[\s|]+", "")).alias("word")).where("word <> ''").distinct()
    few = sorted(r[0] for r in clean.limit(MOST_IN_PATTERN + 1).collect())
    c = F.col(text) if case_sensitive else F.lower(text)
    source = rows.where(F.col(text).isNotNull()).select(key, c.alias("_t"))
    if not few:
        return source.select(key, F.lit(0).alias("position"), F.lit("").alias("word")).where("false")
    if len(few) <= MOST_IN_PATTERN:
        return _few_hits(source, key, few)
    sizes = [r[0] for r in clean.select(F.length("word")).distinct().collect()]
    # pieces alone are exploded, never the text they come from
    cut = lambda n: F.when(F.length("_t") >= n, F.transform(F.sequence(F.lit(0), F.length("_t") - n), lambda i: F.struct(i.alias("position"), F.substring(F.col("_t"), i + 1, F.lit(n)).alias("word"))))
    pieces = reduce(DataFrame.union, (source.select(key, F.explode(cut(n)).alias("p")).select(key, "p.*") for n in sorted(sizes)))
    return pieces.join(clean, "word").select(key, "position", "word")


def _few_hits(source: DataFrame, key: str, words: list[str]) -> DataFrame:
    rx = pattern(words)
    longest = max(map(len, words))
    # a split without width leaves nothing before the first letter: a hit there is tested for by itself
    pieces = source.where(F.col("_t").rlike(rx)).select(key, "_t", F.explode(F.array(F.split("_t", f"(?={rx})"))).alias("_p"))
    nothing = F.array().cast("array<int>")
    first = F.when(F.col("_t").rlike(f"^(?:{rx})"), F.array(F.lit(0))).otherwise(nothing)
    after = F.aggregate(F.col("_p"), F.struct(F.lit(0).alias("at"), nothing.alias("all")), lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["all"], F.array(a["at"] + F.length(p))).alias("all")), lambda a: F.slice(a["all"], F.lit(1), F.size(a["all"]) - 1))
    places = F.transform(F.array_distinct(F.concat(first, after)), lambda i: F.struct(i.alias("position"), F.substring(F.col("_t"), i + 1, F.lit(longest)).alias("ahead")))
    found = pieces.select(key, F.explode(places).alias("h"))
    each = F.filter(F.split(F.lit("|".join(words)), r"\|"), lambda w: F.startswith(F.col("h.ahead"), w))
    return found.select(key, F.col("h.position").alias("position"), F.explode(each).alias("word"))
