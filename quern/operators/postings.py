"""Posting-list operators, on arrays and on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersect_ordered(*lists: Column) -> Column:
    """Elements of the last list that are in all others; its order and repetitions stay."""
    return reduce(lambda acc, nxt: F.filter(nxt, lambda x: F.array_contains(acc, x)), lists)


def intersect_multiset(a: Column, b: Column) -> Column:
    """Ascending; each value as often as in the list that has it less often."""
    n = lambda xs, v: F.size(F.filter(xs, lambda y: y == v))
    return F.flatten(F.transform(F.array_sort(F.array_intersect(a, b)), lambda v: F.array_repeat(v, F.least(n(a, v), n(b, v)))))


def merge_posting_maps(a: Column, b: Column) -> Column:
    """Maps of term to list, lists of a common term one after the other."""
    empty = F.array().cast("array<bigint>")
    return F.map_zip_with(a, b, lambda _, x, y: F.concat(F.coalesce(x, empty), F.coalesce(y, empty)))


def intersect_rows(lists: list[DataFrame], key: str) -> DataFrame:
    """Rows of the last list whose key is in all others, repetitions kept."""
    *others, last = lists
    return reduce(lambda acc, o: acc.join(o.select(key).distinct(), key, "left_semi"), others, last)


def intersect_all_rows(lists: list[DataFrame], key: str) -> DataFrame:
    """Multiset intersection: the n-th occurrence of a key stays if all lists have n of them."""
    number = Window.partitionBy(key).orderBy(F.lit(1))
    first, *rest = (x.select(key).withColumn("n", F.row_number().over(number)) for x in lists)
    return reduce(lambda acc, o: acc.join(o, [key, "n"], "left_semi"), rest, first).select(key)


def containing_all(postings: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """Documents that have every term: one aggregation, no self-joins."""
    wanted = sorted(set(terms))
    return postings.where(F.col("term").isin(wanted)).groupBy(key).agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(wanted)).select(key)
