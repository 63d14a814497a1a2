"""Date strings, epochs and PHP-style date patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"^(?:\d{4}-(\d\d)-(\d\d)|(\d\d)-(\d\d)-\d{4})"
_CLOCK = r"(?: (\d\d):(\d\d):(\d\d))?$"

#: Letters of the pattern language and what Spark calls them.
LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "n": "M", "d": "dd", "j": "d", "H": "HH", "G": "H", "h": "hh", "i": "mm", "s": "ss", "A": "a", "D": "EEE", "l": "EEEE", "M": "MMM", "F": "MMMM"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_date_time(text: Column | str) -> Column:
    """Y-m-d or d-m-Y, each with H:i:s or without; parts are checked one by one, so 2023-02-31 passes."""
    return _in_range(_col(text), _DAY + _CLOCK)


def _in_range(c: Column, form: str) -> Column:
    """Whether the text has the form and month, day, hour, minute and second are numbers that there are."""
    part = lambda *groups: F.concat(*(F.regexp_extract(c, form, g) for g in groups))
    day = part(1, 4).between("01", "12") & part(2, 3).between("01", "31")
    clock = part(5).between("", "23") & part(6).between("", "59") & part(7).between("", "59") if form.endswith(_CLOCK) else F.lit(True)
    return F.when(c.rlike(form), day & clock).otherwise(F.when(c.isNotNull(), F.lit(False)))


def is_date(text: Column | str) -> Column:
    return _in_range(_col(text), _DAY + "$")


def to_epoch(value: Column | str) -> Column:
    """Seconds since 1970 of a timestamp, or of a string in one of the accepted forms; null for others."""
    c = _col(value)
    text = c.cast("string")
    forms = [F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy")]
    return F.unix_seconds(F.coalesce(F.try_to_timestamp(text), *forms))


def spark_pattern(pattern: str) -> str:
    out = []
    for c in pattern:
        out.append(LETTERS.get(c) or (f"'{c}'" if c.isalpha() else "''" if c == "'" else c))
    return "".join(out)


def format_epoch(value: Column | str, pattern: str) -> Column:
    """Seconds since 1970 in a pattern such as ``Y-m-d H:i:s``; null for what is no number."""
    return F.date_format(F.timestamp_seconds(_col(value).try_cast("long")), spark_pattern(pattern))
