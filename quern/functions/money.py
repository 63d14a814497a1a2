"""Amounts in Chinese capital numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "零壹贰叁肆伍陆柒捌玖"
_PLACES = ("", "拾", "佰", "仟")
_SECTIONS = ("", "万", "亿", "万亿")
#: Larger amounts have no section name; they give null.
MOST = 10**16


def chinese_money(amount: Column | str, mode: str = "compat") -> Column:
    """The amount with 圆, 角 and 分.

    ``compat`` names a section of zeros too (壹亿万圆整) and drops the sign of
    negative amounts; ``strict`` leaves such sections out and puts 负 before
    negative amounts.  Null for null and from ``MOST`` on.  Text that is no
    number counts as 0.
    """
    if mode not in ("compat", "strict"):
        raise ValueError(mode)
    c = F.col(amount) if isinstance(amount, str) else amount
    number = F.coalesce(c.try_cast("decimal(30,6)"), F.when(c.isNotNull(), F.lit(0).cast("decimal(30,6)")))
    cents = F.round(number * 100, 0).cast("decimal(30,0)")
    size = F.abs(cents)
    # negative amounts print no whole part in compat
    whole = F.when(cents > -100, F.floor(size / 100)).otherwise(F.lit(0)) if mode == "compat" else F.floor(size / 100)
    digits = whole.cast("long").cast("string")
    n = F.length(digits)
    glyph = F.array(*map(F.lit, DIGITS))
    places, sections = F.array(*map(F.lit, _PLACES)), F.array(*map(F.lit, _SECTIONS))

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        p = n - i
        unit, section = (p % 4).cast("int"), F.floor(p / 4).cast("int")
        here = F.when(d == 0, F.lit("")).otherwise(F.concat(F.when(acc["zero"], F.lit("零")).otherwise(F.lit("")), F.element_at(glyph, d + 1), F.element_at(places, unit + 1)))
        named = acc["used"] | (d != 0)
        close = (unit == 0) & (section > 0)
        if mode == "strict":
            close = close & named
        text = F.concat(acc["text"], here, F.when(close, F.element_at(sections, section + 1)).otherwise(F.lit("")))
        return F.struct(text.alias("text"), (d == 0).alias("zero"), F.when(unit == 0, F.lit(False)).otherwise(named).alias("used"))

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("zero"), F.lit(False).alias("used"))
    words = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda a: a["text"])
    rest = (size % 100).cast("int")
    jiao, fen = F.floor(rest / 10).cast("int"), rest % 10
    part = lambda d, unit: F.when(d > 0, F.concat(F.element_at(glyph, d + 1), F.lit(unit))).otherwise(F.lit(""))
    tail = F.when(rest == 0, F.lit("整")).otherwise(F.concat(part(jiao, "角"), part(fen, "分")))
    text = F.concat(F.when(whole > 0, words).otherwise(F.lit("零")), F.lit("圆"), tail)
    if mode == "strict":
        text = F.concat(F.when(cents < 0, F.lit("负")).otherwise(F.lit("")), text)
    return F.when(size < F.lit(MOST * 100).cast("decimal(30,0)"), text)
