"""Typed mappings of an index's fields."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import MappingError
from quern.functions import dates
from quern.operators import analysis

KINDS = ("primarykey", "text", "keyword", "numeric", "date")
KEYS = {"Int_Incremental": "long", "UUID": "string"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    index: bool = False
    analyzer: str = "standard"
    primarykey_type: str = "Int_Incremental"
    weight: float = 1.0

    def stored(self) -> Column:
        """The field as it is stored: dates as epoch seconds, numbers as double; null for what is no date, number or key."""
        c = F.col(self.name)
        kind = {"primarykey": KEYS.get(self.primarykey_type), "numeric": "double"}.get(self.type)
        if self.type == "date":
            return dates.to_epoch(c).alias(self.name)
        return c.try_cast(kind).alias(self.name) if kind else c

    def tokens(self, analyzers: dict[str, analysis.Analyzer] | None = None) -> Column:
        """array<string> of what is looked up in this field; ``analyzers`` come before the registered ones."""
        c = F.col(self.name)
        if self.type == "text":
            return ((analyzers or {}).get(self.analyzer) or analysis.analyzer(self.analyzer))(c.cast("string"))
        return F.when(c.isNotNull(), F.array(c.cast("string")))


@dataclass(frozen=True)
class Mapping:
    """Name and fields; exactly one is the primary key."""

    name: str
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if not self.name or len(set(names)) != len(names):
            raise MappingError("an index and its fields need names of their own")
        if bad := [f.type for f in self.fields if f.type not in KINDS]:
            raise MappingError(f"unknown field types {bad}")
        keys = [f for f in self.fields if f.type == "primarykey"]
        if len(keys) != 1 or keys[0].primarykey_type not in KEYS:
            raise MappingError("one field must be the primary key, Int_Incremental or UUID")
        for f in self.fields:
            if f.type == "text":
                analysis.analyzer(f.analyzer)

    @classmethod
    def of(cls, spec: dict) -> Mapping:
        """From the nested form ``{"name": ..., "field": [{"name": ..., "type": ...}, ...]}``."""
        known = set(Field.__dataclass_fields__)
        try:
            return cls(spec["name"], tuple(Field(**{k: v for k, v in f.items() if k in known}) for f in spec["field"]))
        except (KeyError, TypeError) as e:
            raise MappingError(str(e)) from e

    @property
    def key(self) -> Field:
        return next(f for f in self.fields if f.type == "primarykey")

    @property
    def indexed(self) -> list[Field]:
        return [f for f in self.fields if f.index and f.type != "primarykey"]

    def store(self, rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """The stored fields, one row for each key that isn't in ``known``: the least of its rows, field by field. Rows with a key of their own stay where they are."""
        stored = rows.select(*(f.stored() for f in self.fields)).where(F.col(self.key.name).isNotNull())
        if known is not None:
            stored = stored.join(known, self.key.name, "left_anti").select(*stored.columns)
        others = [f.name for f in self.fields if f.type != "primarykey"]
        if not others:
            return stored.distinct()
        alone, many, _ = apart(stored, self.key.name, spread=True)
        if many is None:
            return alone
        least = many.groupBy(self.key.name).agg(F.min(F.struct(*others)).alias("_least"))
        return alone.unionByName(least.select(self.key.name, "_least.*"))

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "field": [asdict(f) for f in self.fields]}, ensure_ascii=False)


#: Keys that are sent to all executors; more of them are joined by a shuffle.
SENT_KEYS = 100_000
#: Rows of a task, if rows have to be spread.
TASK_ROWS = 50_000


def apart(rows: DataFrame, key: str, spread: bool = False) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows whose key no other row has, the other rows (None without such), and the number of all; the keys alone are read for this.

    ``spread``: the first rows are moved if a few of their tasks have most of them, as a file of few row groups gives.
    """
    part = [F.spark_partition_id().alias("_part")] if spread else []
    sizes = rows.select(F.col(key).alias("_key"), *part).groupBy("_key").agg(F.count("*").alias("_n"), *([F.min("_part").alias("_part")] if spread else []))
    totals = sizes.groupBy(*(["_part"] if spread else [])).agg(F.sum("_n").alias("n"), F.max("_n").alias("most"), F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)).alias("repeated")).collect()
    n, most, repeated = (f((r[c] or 0 for r in totals), **d) for f, c, d in ((sum, "n", {}), (max, "most", {"default": 0}), (sum, "repeated", {})))
    wide = rows.sparkSession.sparkContext.defaultParallelism
    if spread and n and max(r["n"] for r in totals) > max(2 * n / wide, TASK_ROWS):
        rows = rows.repartition(max(wide, n // TASK_ROWS), key)
    if most < 2:
        return rows, None, n
    keys = sizes.where("_n > 1").select("_key")
    keys = F.broadcast(keys) if repeated <= SENT_KEYS else keys
    same = F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(keys, same, "left_anti"), rows.join(keys, same, "left_semi"), n


#: What fast mode uses: a key and one text.
def fast_mapping(name: str, key: str = "Int_Incremental") -> Mapping:
    return Mapping(name, (Field("primarykey", "primarykey", primarykey_type=key), Field("text", "text", index=True)))
