"""Romanisation of Chinese text by the order of the GB 2312 character set.

The level-1 characters of GB 2312 stand in the order of their syllables, so
the first character of each syllable (``resources/syllables.txt``) gives the
reading of all of them.  Each character has one reading.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

_LAST = 0xD7F9


@cache
def readings() -> dict[str, str]:
    """Syllable of every level-1 character."""
    raw = (Path(__file__).parent.parent / "resources" / "syllables.txt").read_text(encoding="utf-8")
    starts = {int.from_bytes(x[0].encode("gb2312")): x[1:] for x in raw.split()}
    out, syllable = {}, ""
    for code in range(min(starts), _LAST + 1):
        syllable = starts.get(code, syllable)
        try:
            out[code.to_bytes(2).decode("gb2312")] = syllable
        except UnicodeDecodeError:
            pass
    return out


def _by_code(text: Column, missing: str, head: bool) -> Column:
    """Each Han character by its code point in a constant array; ASCII stays, the rest becomes ``missing``."""
    table = readings()
    names = [table.get(chr(c), missing) for c in range(0x4E00, 0x9FA6)]
    # splitting a constant is folded at planning, so a lookup is one array access
    values = F.split(F.lit("|".join(n[:1].upper() if head else n for n in names)), r"\|")

    def one(c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 127, c).when(code.between(0x4E00, 0x9FA5), F.element_at(values, code - 0x4DFF)).otherwise(F.lit(missing))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def pinyin(text: Column | str) -> Column:
    """Lower case; Han characters become their syllables without a separator; characters beyond level 1 vanish."""
    c = F.col(text) if isinstance(text, str) else text
    return _by_code(F.lower(c), "", False)


def initials(text: Column | str) -> Column:
    """Han characters become the capital initial of their syllables, unmapped ones ``U``; ASCII stays."""
    c = F.col(text) if isinstance(text, str) else text
    return _by_code(c, "U", True)


def first_letter(text: Column | str) -> Column:
    """Initial of the first character; ASCII letters become capitals."""
    c = F.col(text) if isinstance(text, str) else text
    return F.upper(initials(F.substring(c, 1, 1)))
