"""HTML extraction from flat text blocks.

A page is read as a flat list of text blocks (text between block-level tags);
scripts, styles, comments and the like hold no text.  Of these, an element
that closes itself is empty, and one without an end tag loses its tag alone;
only script and style run to the end of the page, as browsers have it.  Each block is described
by the word count and link density of itself and its two neighbours, and a
decision tree decides whether it is content.  The tree is grown here, by Gini
impurity, from the small labelled table :data:`LABELLED`.

A word is what stands between blanks; in scripts without blanks (Han, Kana,
Thai, Lao, Khmer, Burmese) two characters count as a word.

Defined results: null and empty pages give an empty text and 0 blocks; broken
or unclosed tags never fail (an unfinished tag is dropped); a ``>`` in a quoted
attribute ends no tag, and a quote that is never closed quotes nothing; a
missing neighbour counts as 0 words without links; pages are independent, so
repeated rows and null ids change nothing; page_id keeps its type; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import textnp as T

_HIDDEN = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Inside of a tag; quotes count after an equals sign only.
_INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+"""
_TAG = re.compile(rf"<!--.*?(?:-->|$)|<(?P<close>/?)(?P<tag>[a-z][a-z0-9-]*)\b{_INSIDE}(?:>|$)|<[!?][^>]*(?:>|$)", re.IGNORECASE | re.DOTALL)
#: Characters of scripts without blanks.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f]")
_OPEN, _END = ({t: re.compile(rf"<{c}{t}\b[^>]*>", re.IGNORECASE) for t in _HIDDEN} for c in ("", "/"))
#: A tag that closes itself; the slash isn't part of an attribute without quotes.
_EMPTY = re.compile(r"(?:^<[a-z]+|[\s\"'])/>$", re.IGNORECASE)
#: Tags that an unclosed title ends at.
_AFTER_TITLE = re.compile(r"<(?:/?(?:head|body|div|p|h[1-6]|ul|ol|table|nav|main|article|section|header|footer)|meta|link|base|script|style)\b", re.IGNORECASE)
FEATURES = ("prev_words", "prev_links", "words", "links", "next_words", "next_links")
#: (prev words, prev link density, words, link density, next words, next link density, content)
LABELLED: tuple[tuple[float, ...], ...] = (
    # menus, breadcrumbs and lists of links
    (0, 0, 1, 1, 1, 1, 0), (1, 1, 1, 1, 1, 1, 0), (1, 1, 2, 1, 1, 1, 0), (2, 1, 3, 1, 2, 1, 0), (3, 1, 4, 1, 3, 1, 0),
    (5, 1, 6, 1, 5, 1, 0), (8, 1, 9, 1, 7, 1, 0), (12, 1, 11, 1, 10, 1, 0), (1, 1, 1, 1, 9, 0, 0), (1, 1, 2, 1, 40, 0, 0),
    (4, 0.5, 6, 0.67, 4, 0.5, 0), (10, 0.8, 12, 0.75, 10, 0.9, 0), (30, 0, 8, 0.9, 6, 1, 0), (60, 0, 5, 1, 5, 1, 0), (20, 0.1, 20, 0.7, 4, 1, 0),
    (6, 0, 10, 0.5, 1, 1, 0), (50, 0, 25, 0.6, 10, 1, 0), (90, 0, 30, 0.8, 2, 1, 0), (0, 0, 15, 0.6, 5, 1, 0), (40, 0, 3, 1, 60, 0, 0),
    # advertisements and notices between menus and text
    (1, 1, 9, 0, 8, 0, 0), (1, 1, 6, 0, 10, 0, 0), (1, 1, 12, 0, 7, 0, 0), (2, 1, 4, 0, 6, 0, 0), (3, 1, 8, 0, 12, 0, 0), (1, 1, 10, 0, 5, 0, 0), (1, 1, 7, 0, 40, 0, 0), (1, 1, 5, 0, 3, 0, 0),
    # footers
    (50, 0, 6, 0, 0, 0, 0), (20, 0, 8, 0, 0, 0, 0), (5, 0, 7, 0, 0, 0, 0), (1, 1, 9, 0, 0, 0, 0), (4, 1, 12, 0, 0, 0, 0), (3, 0.5, 5, 0, 0, 0, 0), (80, 0, 4, 0.5, 0, 0, 0),
    (1, 1, 3, 0, 1, 1, 0), (2, 1, 2, 0, 3, 1, 0), (5, 1, 4, 0, 2, 1, 0), (30, 0, 4, 0, 1, 1, 0), (70, 0, 3, 0, 2, 1, 0),
    # headings and paragraphs
    (9, 0, 7, 0, 40, 0, 1), (8, 0, 10, 0, 25, 0, 1), (12, 0, 5, 0, 60, 0, 1), (6, 0, 8, 0, 15, 0, 1), (5, 0, 3, 0, 30, 0, 1),
    (7, 0, 40, 0, 35, 0, 1), (10, 0, 60, 0, 80, 0, 1), (40, 0, 35, 0, 50, 0, 1), (80, 0, 90, 0, 20, 0, 1), (30, 0, 15, 0, 40, 0, 1),
    (50, 0, 8, 0, 45, 0, 1), (60, 0, 2, 0, 70, 0, 1), (20, 0, 1, 0, 30, 0, 1), (35, 0, 4, 0, 10, 0, 1), (15, 0, 12, 0, 5, 0, 1),
    (3, 0, 20, 0, 2, 0, 1), (2, 0, 3, 0, 25, 0, 1), (4, 0, 2, 0, 3, 0, 1), (40, 0.1, 50, 0.1, 30, 0.05, 1), (25, 0.05, 70, 0.2, 60, 0, 1),
    (60, 0.2, 30, 0.15, 40, 0.1, 1), (20, 0, 45, 0.3, 50, 0, 1), (1, 1, 45, 0, 40, 0, 1), (1, 1, 80, 0, 60, 0, 1), (3, 1, 35, 0, 2, 0, 1), (90, 0, 40, 0, 1, 1, 1),
    (30, 0, 60, 0, 4, 1, 1), (45, 0, 25, 0, 6, 0, 1), (70, 0, 30, 0, 8, 0, 1), (8, 0, 22, 0, 0, 0, 1), (0, 0, 30, 0, 0, 0, 1), (0, 0, 60, 0, 20, 0, 1), (0, 0, 100, 0.1, 0, 0, 1), (60, 0, 35, 0, 0, 0, 1),
    (2, 0, 20, 0, 1, 1, 1), (3, 0, 28, 0, 2, 1, 1), (1, 0, 18, 0, 1, 1, 1), (40, 0, 22, 0, 1, 1, 1), (6, 0, 50, 0, 3, 1, 1), (12, 0, 19, 0, 2, 1, 1), (60, 0, 17, 0, 1, 1, 1),
)
DEPTH = 6


class Tree:
    """Binary decision tree; nodes are (feature, threshold, left, right) or a class."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH):
        self.root = self._grow(rows.astype(float), labels.astype(int), depth)

    @staticmethod
    def _gini(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
        share = ones / np.maximum(n, 1)
        return n * 2 * share * (1 - share)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        most = int(y.sum() * 2 >= len(y))
        if depth == 0 or y.min() == y.max() or len(y) < 2:
            return most
        best = (float(self._gini(np.array([y.sum()]), np.array([len(y)]))[0]) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            cost = self._gini(ones, n) + self._gini(ones[-1] - ones, len(y) - n)
            ok = np.flatnonzero(v[:-1] < v[1:])
            if len(ok):
                k = ok[np.argmin(cost[ok])]
                if cost[k] < best[0]:
                    best = (float(cost[k]), f, float((v[k] + v[k + 1]) / 2))
        if best[1] < 0:
            return most
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, int):
                out[at] = bool(node)
            else:
                left = x[at, node[0]] <= node[1]
                stack += [(node[2], at[left]), (node[3], at[~left])]
        return out


def train(labelled=LABELLED, depth: int = DEPTH) -> Tree:
    table = np.array(labelled, float)
    return Tree(table[:, :-1], table[:, -1], depth)


def _hidden_end(page: str, tag: str, raw: str, at: int, unclosed: set[str]) -> int:
    """Where a hidden element ends whose tag ends at ``at``; unclosed: the names without an end tag from here on."""
    code = tag in ("script", "style")
    empty = bool(_EMPTY.search(raw))
    if empty and not code:
        return at
    end = None if tag in unclosed else _END[tag].search(page, at)
    if end is None:
        unclosed.add(tag)
    if empty and (end is None or _OPEN[tag].search(page, at, end.start())):
        return at
    if tag == "title":
        stop = _AFTER_TITLE.search(page, at, end.start() if end else len(page))
        return stop.start() if stop else end.end() if end else len(page)
    return end.end() if end else len(page) if code else at


def count_words(text: str) -> int:
    words = text.split()
    if text.isascii():
        return len(words)
    return sum(max(1, (len(_DENSE.findall(w)) + 1) // 2) for w in words)


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, words, words in links) of each text block of a page."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked, depth, at = 0, 0, 0
    unclosed: set[str] = set()

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if depth:
                linked += count_words(entities.unescape(text))

    def close() -> None:
        nonlocal linked, parts
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            n = count_words(text)
            out.append((text, n, min(linked, n)))
        linked, parts = 0, []

    while m := _TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag:
            tag = tag.lower()
            if tag in _HIDDEN and not m.group("close"):
                close()
                at = _hidden_end(page, tag, m.group(), at, unclosed)
            elif tag == "a":
                depth = 0 if m.group("close") else 1
            elif tag not in _INLINE:
                close()
                depth = 0
    add(page[at:])
    close()
    return out


def features(words: np.ndarray, links: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Rows of FEATURES; edge: the index of each page's first block, with the total at the end."""
    w, d = words.astype(float), links / np.maximum(words, 1)
    x = np.zeros((len(w), 6))
    x[:, 2], x[:, 3] = w, d
    x[1:, 0], x[1:, 1] = w[:-1], d[:-1]
    x[:-1, 4], x[:-1, 5] = w[1:], d[1:]
    starts = edge[:-1][edge[:-1] < len(w)]
    x[starts, 0] = x[starts, 1] = 0
    ends = edge[1:][edge[1:] > 0] - 1
    x[ends, 4] = x[ends, 5] = 0
    return x


def extract(pages: DataFrame, labelled=LABELLED) -> DataFrame:
    """page_id, text (content blocks, a line each), n_blocks, n_content, n_words of each page."""
    tree = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, "html"):
                found = [blocks(h) if h else [] for h in part.column("html").to_pylist()]
                edge = np.concatenate([[0], np.cumsum([len(b) for b in found])]).astype(np.int64)
                words = np.array([w for b in found for _, w, _ in b], np.int64)
                links = np.array([k for b in found for _, _, k in b], np.int64)
                good = tree.predict(features(words, links, edge)) if len(words) else np.zeros(0, bool)
                texts, counts, sizes = [], [], []
                for i, b in enumerate(found):
                    keep = good[edge[i] : edge[i + 1]]
                    texts.append("\n".join(t for (t, _, _), k in zip(b, keep, strict=True) if k))
                    counts.append(int(keep.sum()))
                    sizes.append(int(words[edge[i] : edge[i + 1]][keep].sum()))
                yield pa.record_batch({"page_id": part.column("page_id"), "text": pa.array(texts, pa.string()), "n_blocks": pa.array(np.diff(edge)), "n_content": pa.array(counts, pa.int64()), "n_words": pa.array(sizes, pa.int64())})

    return pages.select("page_id", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, n_blocks long, n_content long, n_words long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
