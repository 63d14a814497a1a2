"""Synthetic values: deterministic functions of an id column and a seed.

Each generator hashes (id, seed, its own tag), so a value doesn't depend on
partitioning and a retried task makes the same one again.
"""

from __future__ import annotations

from datetime import date as _date

from pyspark.sql import Column
from pyspark.sql import functions as F

FEMALE = ["Ada", "Bela", "Cora", "Dina", "Edda", "Fina", "Gilda", "Hanna", "Ilse", "Jutta", "Klara", "Lina"]
MALE = ["Anton", "Bruno", "Curt", "Dirk", "Emil", "Falk", "Gero", "Hugo", "Ivo", "Jens", "Karl", "Lutz"]
LAST = ["Acker", "Birke", "Dorn", "Eiche", "Farn", "Ginster", "Hasel", "Kiefer", "Linde", "Moos", "Nessel", "Ulme"]
HAN_LAST = list("王李张刘陈杨黄赵周吴")
HAN_FIRST = list("云山河月星林海风雪松")
HAN_TEXT = list("天地日月山水火木金土人口手足心目耳大小多少上下左右前后东西南北春夏秋冬")
DOMAINS = ["example.com", "example.org", "example.net", "mail.example.com", "post.example.org"]
PREFIXES = ["130", "131", "135", "139", "150", "158", "180", "188"]
COMPANY = (["North", "South", "River", "Harbour", "Summit", "Meadow"], ["Bright", "Solid", "Swift", "Plain", "Clear"], ["Works", "Trading", "Systems", "Foods", "Press"])
_ALNUM = list("0123456789abcdefghijklmnopqrstuvwxyz")


class Fake:
    """Generators over an id column."""

    def __init__(self, key: Column | str, seed: int = 0):
        self.key, self.seed = F.col(key) if isinstance(key, str) else key, seed

    def _hash(self, tag: str, i: Column | int = 0) -> Column:
        return F.xxhash64(self.key.cast("long"), F.lit(self.seed), F.lit(tag), i if isinstance(i, Column) else F.lit(i))

    def below(self, n: int, tag: str, i: Column | int = 0) -> Column:
        return F.pmod(self._hash(tag, i), F.lit(n).cast("long")).cast("int")

    def pick(self, pool: list[str], tag: str, i: Column | int = 0) -> Column:
        return F.element_at(F.split(F.lit("|".join(pool)), r"\|"), self.below(len(pool), tag, i) + 1)

    def _many(self, n: int, one, sep: str = "") -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), one), sep) if n > 0 else F.lit("")

    def boolean(self) -> Column:
        return self.below(2, "bool") == 1

    def first_name(self, gender: str | None = None) -> Column:
        f, m = self.pick(FEMALE, "female"), self.pick(MALE, "male")
        return f if gender == "female" else m if gender == "male" else F.when(self.below(2, "gender") == 1, f).otherwise(m)

    def last_name(self) -> Column:
        return self.pick(LAST, "last")

    def full_name(self, gender: str | None = None) -> Column:
        return F.concat_ws(" ", self.first_name(gender), self.last_name())

    def name(self, gender: str | None = None) -> Column:
        """A Han name of two or three characters; one pool for all genders."""
        return F.concat(self.pick(HAN_LAST, "hl"), self.pick(HAN_FIRST, "h1"), F.when(self.below(2, "h2") == 1, self.pick(HAN_FIRST, "h3")).otherwise(F.lit("")))

    def number(self, length: int = 6) -> Column:
        head = (self.below(9, "n0") + 1).cast("string")
        return F.concat(head, self._many(length - 1, lambda i: self.below(10, "n", i).cast("string")))

    def phone_number(self, length: int = 11) -> Column:
        return F.concat(self.pick(PREFIXES, "pp"), self._many(length - 3, lambda i: self.below(10, "p", i).cast("string")))

    def email(self) -> Column:
        return F.concat(self._many(10, lambda i: self.below(10, "e", i).cast("string")), F.lit("@"), self.pick(DOMAINS, "ed"))

    def address(self) -> Column:
        parts = []
        for unit in "省市县镇村组":
            parts += [self.pick(HAN_TEXT, "a" + unit, 1), self.pick(HAN_TEXT, "a" + unit, 2), F.lit(unit)]
        return F.concat(*parts, (self.below(900, "ah") + 100).cast("string"), F.lit("号"))

    def text(self, kind: str = "han", length: int = 20) -> Column:
        pool = HAN_TEXT if kind == "han" else _ALNUM
        return self._many(length, lambda i: self.pick(pool, "t" + kind, i))

    def uuid(self) -> Column:
        return F.upper(F.regexp_replace(F.md5(self._hash("uuid").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))

    def date(self, start: str = "1970-01-01", end: str | None = None) -> Column:
        first, last = _date.fromisoformat(start), _date.fromisoformat(end) if end else _date.today()
        return F.date_add(F.lit(first), self.below(max(0, (last - first).days) + 1, "date"))

    def color(self, kind: str = "hex") -> Column:
        r, g, b = (self.below(256, "c" + x) for x in "rgb")
        if kind == "hex":
            return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(x), 2, "0")) for x in (r, g, b)))
        if kind == "rgb":
            return F.format_string("rgb(%d, %d, %d)", r, g, b)
        if kind == "rgba":
            return F.format_string("rgba(%d, %d, %d, %.2f)", r, g, b, self.below(101, "ca") / 100)
        if kind == "hsl":
            return F.format_string("hsl(%d, %d%%, %d%%)", self.below(361, "ch"), self.below(101, "cs"), self.below(101, "cl"))
        raise ValueError(kind)

    def employee_id(self, length: int = 6, prefix: str = "E") -> Column:
        return F.concat(F.lit(prefix), self.number(length))

    def ip(self, version: str = "v4") -> Column:
        if version == "v4":
            return self._many(4, lambda i: self.below(256, "i4", i).cast("string"), ".")
        return self._many(8, lambda i: F.lower(F.lpad(F.hex(self.below(65536, "i6", i)), 4, "0")), ":")

    def user_name(self, length: int = 8) -> Column:
        return F.translate(self.text("ascii", length), " ,", "")

    def company_name(self) -> Column:
        return F.concat_ws(" ", *(self.pick(pool, f"co{k}") for k, pool in enumerate(COMPANY)))
