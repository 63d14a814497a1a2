"""Stable orders, top-k and pages."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_value(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Descending by value; ties in the order of ``position``."""
    return rows.orderBy(F.desc(value), F.asc(position))


def places(rows: DataFrame, value: str, position: str, parts: int = 64) -> DataFrame:
    """All rows with ``place``, from 1, in the order of :func:`by_value`: value ranges are sorted side by side, and begin where the ranges before them end."""
    marks = sorted(set(rows.approxQuantile(value, [i / parts for i in range(1, parts)], 0.1 / parts)), reverse=True)
    number = F.col(value).cast("double")
    # nulls are last, NaN is first
    part = F.when(number.isNull(), len(marks)).otherwise(sum((F.when(number < m, 1).otherwise(0) for m in marks), F.lit(0)))
    cut = rows.withColumn("_part", part)
    sizes = {r["_part"]: r["count"] for r in cut.groupBy("_part").count().collect()}
    begins = list(accumulate((sizes.get(k, 0) for k in range(len(marks))), initial=0))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(value), F.asc(position)))
    return cut.withColumn("place", local + F.array(*map(F.lit, begins))[F.col("_part")].cast("long")).drop("_part").orderBy("place")


def by_field(rows: DataFrame, field: str, order: str = "desc", tie: str | None = None) -> DataFrame:
    """By a field, ``asc`` or ``desc``; ties by ``tie``, ascending."""
    if order not in ("asc", "desc"):
        raise ValueError(order)
    first = F.asc(field) if order == "asc" else F.desc(field)
    return rows.orderBy(first, *([F.asc(tie)] if tie else []))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page of ordered rows, from 1; beyond the last it is empty."""
    if number < 1 or size < 1:
        raise ValueError("pages and sizes begin at 1")
    return rows.offset((number - 1) * size).limit(size)
