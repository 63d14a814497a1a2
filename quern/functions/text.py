"""Text helpers: string hash, cutting, a URL-friendly Base64, word padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SEED = 0x238F13AF


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def term_hash(key: Column | str, modulus: int) -> Column:
    """Shift-add-xor hash over the UTF-8 bytes, last byte first, in 31 bits, modulo ``modulus``; null for null."""
    digits = F.hex(F.encode(_col(key), "UTF-8"))
    size = F.octet_length(_col(key))
    # an empty string has no bytes: sequence(1, 0) would count down
    places = F.when(size > 0, F.sequence(size, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    step = lambda h, i: (h + F.shiftleft(h, 5)).bitwiseXOR(byte(i)).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    return F.when(_col(key).isNotNull(), F.aggregate(places, F.lit(HASH_SEED).cast("long"), step) % F.lit(modulus))


def cut_before(text: Column | str, find: str, contain: bool = False) -> Column:
    """Text before the first occurrence of ``find`` in any case, or through it; all of it without one."""
    at = F.locate(find.lower(), F.lower(_col(text)))
    end = at - 1 + (len(find) if contain else 0)
    return F.when(at > 0, F.substring(_col(text), F.lit(1), end)).otherwise(_col(text))


def url_base64(value: Column | str) -> Column:
    """Base64 with ``+/=`` written as ``-_*``, on one line."""
    return F.translate(F.regexp_replace(F.base64(F.encode(_col(value), "UTF-8")), "[\r\n]", ""), "+/=", "-_*")


def from_url_base64(value: Column | str) -> Column:
    return F.decode(F.unbase64(F.translate(_col(value), "-_*", "+/=")), "UTF-8")


def pad_words(text: Column | str) -> Column:
    """ASCII words set off by a blank on either side, so that they stand apart from Han text."""
    return F.regexp_replace(_col(text), "[A-Za-z]+", " $0 ")
