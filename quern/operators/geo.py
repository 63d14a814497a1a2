"""Geohashes, neighbours, points in polygons and polygon intersection, all in built-in expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
LONGEST = 12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _cell(value: Column, low: float, span: float) -> Column:
    """The 30 bit cell of a coordinate; the upper end belongs to the last cell."""
    top = 1 << 30
    return F.least(F.floor((value - low) / span * top), F.lit(top - 1)).cast("long")


def _mixed(i: int) -> str:
    """The letter whose bits are those of i >> 2 and i & 3, interleaved."""
    hi, lo = i >> 2, i & 3
    return ALPHABET[(hi >> 2 & 1) << 4 | (lo >> 1 & 1) << 3 | (hi >> 1 & 1) << 2 | (lo & 1) << 1 | hi & 1]


#: Letters in the order of (three bits of one axis, two of the other); axes swap from letter to letter.
_MIXED = "".join(map(_mixed, range(32)))


def _shifts(k: int) -> tuple[int, int]:
    """How far the three and the two bits of letter k stand from the end of the 30 bit cells."""
    m = k // 2
    return (27 - 5 * m, 28 - 5 * m) if k % 2 == 0 else (25 - 5 * m, 25 - 5 * m)


def _spell(x: Column, y: Column, size: int) -> Column:
    """The first letters of a point's 30 bit cells."""

    def letter(k: int) -> Column:
        three, two = (x, y) if k % 2 == 0 else (y, x)
        a, b = _shifts(k)
        number = F.shiftright(three, a).bitwiseAND(F.lit(7).cast("long")) * 4 + F.shiftright(two, b).bitwiseAND(F.lit(3).cast("long"))
        return F.substring(F.lit(_MIXED), number.cast("int") + 1, F.lit(1))

    return F.concat(*map(letter, range(size)))


def encode(lat: Column | str, lon: Column | str, precision: int = LONGEST) -> Column:
    """Geohash of 1 to 12 characters; null outside the ranges of latitude and longitude."""
    if not 1 <= precision <= LONGEST:
        raise ValueError(f"precision {precision} is not in 1 .. {LONGEST}")
    lat, lon = _col(lat), _col(lon)
    inside = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(inside, _let(F.struct(_cell(lon, -180, 360).alias("x"), _cell(lat, -90, 180).alias("y")), lambda p: _spell(p["x"], p["y"], precision)))


def encode_shortest(lat: Column | str, lon: Column | str) -> Column:
    """The shortest geohash that decodes to just this point, else one of 12 characters."""
    lat, lon = _col(lat), _col(lon)

    def exact(g: Column) -> Column:
        return _let(decode(g), lambda d: (d["lat"] == lat) & (d["lon"] == lon))

    def choose(h: Column) -> Column:
        prefixes = F.transform(F.sequence(F.lit(1), F.lit(LONGEST - 1)), lambda n: F.substring(h, F.lit(1), n))
        return F.coalesce(F.get(F.filter(prefixes, exact), F.lit(0)), h)

    return _let(encode(lat, lon), choose)


def _with_cells(h: Column, use) -> Column:
    """use(cell) of a geohash, null for other strings; cell has x, y (south-west corner in 30 bit cells), nx, ny (bits)."""
    low = F.lower(h)
    good = low.rlike(f"^[{ALPHABET}]{{1,{LONGEST}}}$")
    x, y = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(LONGEST):
        # beyond the end the letter is empty, which counts as 0
        at = F.greatest(F.instr(F.lit(_MIXED), F.substring(low, k + 1, 1)) - 1, F.lit(0)).cast("long")
        a, b = _shifts(k)
        three, two = F.shiftleft(F.shiftright(at, 2), a), F.shiftleft(at.bitwiseAND(F.lit(3).cast("long")), b)
        x, y = (x + three, y + two) if k % 2 == 0 else (x + two, y + three)
    bits = F.length(low) * 5
    cell = F.struct(x.alias("x"), y.alias("y"), F.ceil(bits / 2).cast("int").alias("nx"), F.floor(bits / 2).cast("int").alias("ny"))
    return F.when(good, _let(cell, use))


def _size(bits: Column) -> Column:
    """Width of a cell of so many bits, in 30 bit cells."""
    return F.pow(F.lit(2.0), 30 - bits)


_LON, _LAT = 360.0 / (1 << 30), 180.0 / (1 << 30)


def bounds(h: Column | str) -> Column:
    """struct(sw: (lat, lon), ne: (lat, lon)) of a geohash's cell; null for other strings."""
    corner = lambda x, y: F.struct((y * _LAT - 90).alias("lat"), (x * _LON - 180).alias("lon"))
    return _with_cells(_col(h), lambda c: F.struct(corner(c["x"], c["y"]).alias("sw"), corner(c["x"] + _size(c["nx"]), c["y"] + _size(c["ny"])).alias("ne")))


def decode(h: Column | str) -> Column:
    """struct(lat, lon): the cell's centre, rounded to what its size warrants; null for other strings."""

    def rounded(v: Column, size: Column) -> Column:
        unit = F.pow(F.lit(10.0), F.greatest(F.floor(2 - F.log10(size)), F.lit(0)))
        return F.round(v * unit) / unit

    def centre(c: Column) -> Column:
        wide, tall = _size(c["nx"]), _size(c["ny"])
        return F.struct(rounded((c["y"] + tall * 0.5) * _LAT - 90, tall * _LAT).alias("lat"), rounded((c["x"] + wide * 0.5) * _LON - 180, wide * _LON).alias("lon"))

    return _with_cells(_col(h), centre)


_STEPS = {"n": (0, 1), "s": (0, -1), "e": (1, 0), "w": (-1, 0), "ne": (1, 1), "nw": (-1, 1), "se": (1, -1), "sw": (-1, -1)}


def _moved(c: Column, direction: str, length: Column) -> Column:
    to = lambda v, d, n: (v + _size(n).cast("long") * d).bitwiseAND(F.lit((1 << 30) - 1).cast("long"))
    dx, dy = _STEPS[direction]
    at = F.struct(to(c["x"], dx, c["nx"]).alias("x"), to(c["y"], dy, c["ny"]).alias("y"))
    return F.substring(_let(at, lambda p: _spell(p["x"], p["y"], LONGEST)), F.lit(1), length)


def adjacent(h: Column | str, direction: str) -> Column:
    """The neighbouring cell; columns and rows wrap around; null for other strings."""
    return _with_cells(_col(h), lambda c: _moved(c, direction, F.length(_col(h))))


def neighbors(h: Column | str) -> Column:
    """struct of the eight neighbours; null for other strings."""
    return _with_cells(_col(h), lambda c: F.struct(*(_moved(c, d, F.length(_col(h))).alias(d) for d in ("n", "ne", "e", "se", "s", "sw", "w", "nw"))))


def with_cells(rows: DataFrame, h: str, longest: int = LONGEST) -> DataFrame:
    """The rows with ``_x``, ``_y`` (south-west corner in 30 bit cells) and ``_size`` (letters) of a geohash column; null for other strings and longer ones.

    Plain columns, which generated code computes once, where the functions of a
    column above have to bind them in a lambda.
    """
    low = F.lower(F.col(h))
    x, y = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(longest):
        at = F.greatest(F.instr(F.lit(_MIXED), F.substring(low, k + 1, 1)) - 1, F.lit(0)).cast("long")
        a, b = _shifts(k)
        three, two = F.shiftleft(F.shiftright(at, 2), a), F.shiftleft(at.bitwiseAND(F.lit(3).cast("long")), b)
        x, y = (x + three, y + two) if k % 2 == 0 else (x + two, y + three)
    good = low.rlike(f"^[{ALPHABET}]{{1,{longest}}}$")
    return rows.withColumns({"_x": F.when(good, x), "_y": F.when(good, y), "_size": F.when(good, F.length(low))})


_DIRECTIONS = ("n", "ne", "e", "se", "s", "sw", "w", "nw")


def _neighbors(h: pd.Series) -> pd.DataFrame:
    text = h.fillna("").str.lower()
    size = text.str.len().to_numpy(np.int64)
    ascii_ = text.where(text.map(str.isascii) & (size <= LONGEST), "")
    letters = np.array(ascii_.tolist(), f"S{LONGEST}").reshape(-1, 1).view(np.uint8) if len(h) else np.zeros((0, LONGEST), np.uint8)
    table = np.full(256, -1, np.int64)
    table[np.frombuffer(_MIXED.encode(), np.uint8)] = np.arange(32)
    number, inside = table[letters], np.arange(LONGEST) < size[:, None]
    good = (size > 0) & (size <= LONGEST) & (ascii_ != "").to_numpy() & ((number >= 0) | ~inside).all(axis=1)
    number = np.where(inside & (number >= 0), number, 0)
    x, y = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    for k in range(LONGEST):
        a, b = _shifts(k)
        three, two = number[:, k] >> 2 << a, (number[:, k] & 3) << b
        x, y = (x + three, y + two) if k % 2 == 0 else (x + two, y + three)
    top, spell = (1 << 30) - 1, np.frombuffer(_MIXED.encode(), np.uint8)
    wide, tall = 1 << np.maximum(30 - (size * 5 + 1) // 2, 0), 1 << np.maximum(30 - size * 5 // 2, 0)
    out = {}
    for d in _DIRECTIONS:
        dx, dy = _STEPS[d]
        at = ((x + dx * wide) & top, (y + dy * tall) & top)
        found = np.zeros((len(h), LONGEST), np.uint8)
        for k in range(LONGEST):
            a, b = _shifts(k)
            found[:, k] = spell[(at[k % 2] >> a & 7) * 4 + (at[1 - k % 2] >> b & 3)]
        found[~inside] = 0
        out[d] = pd.Series(found.view(f"S{LONGEST}").ravel().astype(str), index=h.index, dtype=object).where(good, None)
    return pd.DataFrame(out)


def with_neighbors(rows: DataFrame, h: str) -> DataFrame:
    """The rows with the eight neighbours as columns n, ne, e, se, s, sw, w, nw; null for other strings.

    Arrow batches through numpy: as expressions, the letters of eight cells take
    longer to compile than a hundred thousand rows take here.
    """
    near = F.pandas_udf(_neighbors, ", ".join(f"{d} string" for d in _DIRECTIONS))
    return rows.withColumn("_near", near(F.col(h))).select(*rows.columns, "_near.*")


def with_decoded(rows: DataFrame, h: str) -> DataFrame:
    """The rows with lat, lon (centre, rounded to what the cell's size warrants), south, west, north, east."""
    cells = with_cells(rows, h).withColumns({"_wide": _size(F.ceil(F.col("_size") * 5 / 2)), "_tall": _size(F.floor(F.col("_size") * 5 / 2))})

    def rounded(v: Column, size: Column) -> Column:
        unit = F.pow(F.lit(10.0), F.greatest(F.floor(2 - F.log10(size)), F.lit(0)))
        return F.round(v * unit) / unit

    x, y, wide, tall = (F.col(c) for c in ("_x", "_y", "_wide", "_tall"))
    out = {"lat": rounded((y + tall * 0.5) * _LAT - 90, tall * _LAT), "lon": rounded((x + wide * 0.5) * _LON - 180, wide * _LON), "south": y * _LAT - 90, "west": x * _LON - 180, "north": (y + tall) * _LAT - 90, "east": (x + wide) * _LON - 180}
    return cells.select(*rows.columns, *(c.alias(n) for n, c in out.items()))


def decimals(value: Column | str) -> Column:
    """Decimal places of a number, 14 at most."""
    text = F.format_number(_col(value).cast("double"), 14)
    return F.length(F.regexp_replace(F.substring_index(text, ".", -1), "0+$", ""))


# ---------------------------------------------------------------- polygons


def _edges(polygon: Column, test) -> Column:
    """test(vertex, previous vertex) of every edge."""
    n = F.size(polygon)
    vertex = lambda i: F.element_at(polygon, i.cast("int"))
    return F.transform(F.sequence(F.lit(1), n), lambda i: test(vertex(i), vertex(F.when(i == 1, n).otherwise(i - 1))))


def in_polygon(polygon: Column | str, lat: Column | str, lon: Column | str) -> Column:
    """Ray casting over an array of [lat, lon]; a vertex at the point's own longitude counts for no edge."""
    polygon, lat, lon = _col(polygon), _col(lat), _col(lon)

    def crossed(a: Column, b: Column) -> Column:
        between = (lon < F.greatest(a[1], b[1])) & (lon > F.least(a[1], b[1]))
        width = b[1] - a[1]
        return F.coalesce(between & (lat < (b[0] - a[0]) * (lon - a[1]) / F.when(width != 0, width) + a[0]), F.lit(False))

    return F.size(F.filter(_edges(polygon, crossed), lambda x: x)) % 2 == 1


def _turn(p: Column, q: Column, r: Column) -> Column:
    return F.signum((q[0] - p[0]) * (r[1] - q[1]) - (q[1] - p[1]) * (r[0] - q[0]))


def _within(p: Column, q: Column, r: Column) -> Column:
    return q[0].between(F.least(p[0], r[0]), F.greatest(p[0], r[0])) & q[1].between(F.least(p[1], r[1]), F.greatest(p[1], r[1]))


def segments_cross(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Whether two closed segments have a point in common."""
    a, b, c, d = _turn(p1, p2, p3), _turn(p1, p2, p4), _turn(p3, p4, p1), _turn(p3, p4, p2)
    touching = ((a == 0) & _within(p1, p3, p2)) | ((b == 0) & _within(p1, p4, p2)) | ((c == 0) & _within(p3, p1, p4)) | ((d == 0) & _within(p3, p2, p4))
    return ((a != b) & (c != d)) | touching


def polygons_cross(a: Column | str, b: Column | str) -> Column:
    """Whether any edges cross; one polygon inside another doesn't."""
    a, b = _col(a), _col(b)
    return F.exists(_edges(a, lambda p, q: F.exists(_edges(b, lambda r, s: segments_cross(p, q, r, s)), lambda x: x)), lambda x: x)


def join_polygons(points: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """Pairs of a point (lat, lon) and a polygon around it.

    Points and the bounding boxes of polygons meet by grid cell, an equi-join, before the exact test.
    """
    at = lambda c: F.floor(c / cell).cast("long")
    side = lambda k: F.transform(F.col("polygon"), lambda v: v[k])
    steps = lambda k: F.explode(F.sequence(at(F.array_min(side(k))), at(F.array_max(side(k)))))
    spread = polygons.withColumn("_x", steps(1)).withColumn("_y", steps(0))
    placed = points.withColumn("_x", at(F.col("lon"))).withColumn("_y", at(F.col("lat")))
    return placed.join(spread, ["_x", "_y"]).where(in_polygon("polygon", "lat", "lon")).drop("_x", "_y")
