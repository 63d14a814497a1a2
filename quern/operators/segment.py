"""Dictionary segmentation of Han text.

The longest suffix that is a word is cut off again and again, which is
sequential by nature: plain Python over a frozen set, in Arrow batches, for
Han blocks only.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import analysis

LONGEST = 6
#: After these a two-character hit is looked at again.
PARTICLES = frozenset("着上下中里外出")
#: Dictionaries up to so many words are sent to the workers.
MOST_WORDS = 5_000_000


def is_word(word: str, base: frozenset[str], custom: Iterable[str] = (), negative: Iterable[str] = ()) -> bool:
    """The negative list beats the custom list, which beats the dictionary."""
    return word not in set(negative) and (word in set(custom) or word in base)


def dictionary(base: DataFrame, custom: DataFrame | None = None, negative: DataFrame | None = None) -> DataFrame:
    """The words of ``base`` and ``custom`` without those of ``negative``."""
    words = base.select("word")
    if custom is not None:
        words = words.union(custom.select("word"))
    words = words.where("word is not null").distinct()
    return words.join(negative.select("word"), "word", "left_anti") if negative is not None else words


def load(words: DataFrame) -> frozenset[str]:
    """The words, for the workers; a dictionary beyond ``MOST_WORDS`` is refused."""
    rows = words.select("word").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    return frozenset(r["word"] for r in rows)


def _cut(rest: str, words: frozenset[str]) -> list[str]:
    """What is cut off the end of the text, last piece first."""
    n = len(rest)
    for size in range(min(LONGEST, n), 1, -1):
        hit = rest[n - size :]
        if hit not in words:
            continue
        if size == 2 and hit[1] in PARTICLES:
            for k in (3, 2):
                if n - 1 - k >= 0 and rest[n - 1 - k : n - 1] in words:
                    return [hit[1], rest[n - 1 - k : n - 1]]
        return [hit]
    return [rest[-1]]


def precise(text: str, words: frozenset[str]) -> list[str]:
    """Words of a Han text, end to end; concatenated they are the text."""
    out: list[str] = []
    while text:
        found = _cut(text, words)
        out += found
        text = text[: len(text) - sum(map(len, found))]
    return out[::-1]


def sub_words(word: str, words: frozenset[str]) -> list[str]:
    """Dictionary words inside a word: short to long, left to right."""
    n = len(word)
    top = LONGEST if n >= LONGEST else n - 1
    return [word[i : i + size] for size in range(2, top + 1) for i in range(n - size + 1) if word[i : i + size] in words]


def full(text: str, words: frozenset[str]) -> list[str]:
    """As :func:`precise`, each word of three characters or more followed by its sub-words, long to short, right to left."""
    out: list[str] = []
    for word in precise(text, words):
        out.append(word)
        if len(word) >= 3 and word in words:
            out += sub_words(word, words)[::-1]
    return out


def _han_or_chars(blocks, words: frozenset[str], cut) -> list[str] | None:
    if blocks is None:
        return None
    out: list[str] = []
    for b in blocks:
        if "一" <= b[0] <= "龥":
            out += cut(b, words)
        elif any(c.isascii() and c.isalnum() for c in b):
            out.append(b)
        else:
            out += b
    return out


def segmenter(words: frozenset[str], mode: str = "precise"):
    """An analyzer (column to tokens) for a dictionary; modes: precise, full, sub (of a word)."""
    spark_words = words
    cut = {"precise": precise, "full": full, "sub": sub_words}[mode]

    @F.pandas_udf("array<string>")
    def segment(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: _han_or_chars(b, spark_words, cut))

    return lambda text: segment(analysis.blocks(text))


def segment_all(text: Column | str, words: frozenset[str]) -> Column:
    """Full mode; null where no block was found."""
    found = segmenter(words, "full")(text)
    return F.when(F.size(found) > 0, found)
