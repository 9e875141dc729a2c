"""Column expressions over address rows: keys, display texts, scores, tiles and polygons. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import Query


def text_of(name: str) -> Column:
    """A column as text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shard(column: Column, digits: int = 3) -> Column:
    """Leading hex digits of the md5 of a text: 3 digits make 4096 shards."""
    return F.left(F.md5(column.cast("binary")), F.lit(digits))


def street_key() -> Column:
    """Name, type, suffix, locality, state and postcode, joined by bars."""
    return F.concat_ws("|", *[text_of(c) for c in ("street_name", "street_type_abbrev", "street_suffix_code", "locality_name", "state", "postcode")])


def street_display(kind: str = "street_type_abbrev", suffix: str = "street_suffix_code") -> Column:
    """NAME[ TYPE][ SUFFIX], LOCALITY, STATE[, POSTCODE]."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.concat_ws(", ", F.concat_ws(" ", "street_name", some(kind), some(suffix)), "locality_name", "state", some("postcode"))


def search_display() -> Column:
    """The display with full type and suffix and without apostrophes: what street search indexes."""
    return F.regexp_replace(street_display("street_type_code", "street_suffix_name"), "'", "")


def _number(first: str, last: str) -> Column:
    return F.concat(F.col(first).cast("string"), F.when(F.col(last).isNotNull(), F.concat(F.lit("-"), F.col(last).cast("string"))).otherwise(""))


def street_number() -> Column:
    """NUMBER[-LAST], or LOT n, or null."""
    return F.when(F.col("number_first").isNotNull(), _number("number_first", "number_last")).when(F.col("lot_number").isNotNull(), F.concat(F.lit("LOT "), "lot_number"))


def _unit_lines() -> list[Column]:
    level = F.trim(F.concat(text_of("level_type_name"), F.lit(" "), text_of("level_number")))
    flat = F.trim(F.concat(text_of("flat_type_code"), F.lit(" "), text_of("flat_number")))
    return [level, flat]


def _joined(parts: list[Column], by: str) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), by)


def display_prefix() -> Column:
    """What stands before the street name: level, flat and number, those that exist, joined by commas."""
    return _joined([*_unit_lines(), F.coalesce(street_number(), F.lit(""))], ", ")


def address_lines() -> Column:
    """The lines of a postal address: level, flat, street, locality (with its trailing space if there is no postcode)."""
    street = F.concat(F.coalesce(F.concat(street_number(), F.lit(" ")), F.lit("")), F.col("street_name"), F.lit(" "), F.col("street_type_abbrev"), F.coalesce(F.concat(F.lit(" "), "street_suffix_name"), F.lit("")))
    place = F.concat(F.col("locality_name"), F.lit(" "), F.col("state"), F.lit(" "), text_of("postcode"))
    return F.concat(F.filter(F.array(*_unit_lines()), lambda x: x != ""), F.array(street, place))


def short_lines() -> Column:
    """The compact lines of an address with a flat (level code and number, flat/number STREET, locality), else null."""
    level = F.trim(F.concat(text_of("level_type_code"), text_of("level_number")))
    number = F.coalesce(_number("number_first", "number_last"), F.col("lot_number"), F.lit(""))
    street = F.concat(text_of("flat_number"), F.lit("/"), number, F.lit(" "), F.col("street_name"), F.lit(" "), F.col("street_type_abbrev"), F.coalesce(F.concat(F.lit(" "), "street_suffix_code"), F.lit("")))
    place = F.concat(F.col("locality_name"), F.lit(" "), F.col("state"), F.lit(" "), text_of("postcode"))
    return F.when(F.col("flat_type_code").isNotNull() | F.col("flat_number").isNotNull(), F.concat(F.filter(F.array(level), lambda x: x != ""), F.array(street, place)))


def single_line() -> Column:
    """PREFIX NAME TYPE SUFFIXCODE, LOCALITY STATE POSTCODE on one line."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.trim(F.concat(F.concat_ws(" ", some(F.col("display_prefix")), "street_name", some(F.col("street_type_abbrev")), some(F.col("street_suffix_code"))), F.lit(", "), F.col("locality_name"), F.lit(" "), F.col("state"), F.lit(" "), text_of("postcode")))


def capped(n: Column) -> Column:
    """Numbers above 999 by their first three digits."""
    return F.when(n > 999, F.left(n.cast("string"), F.lit(3)).cast("int")).otherwise(n)


def tier(count: Column) -> Column:
    """Bonus of a street for the number of its addresses."""
    return F.when(count >= 2000, 20).when(count >= 500, 15).when(count >= 100, 10).when(count >= 20, 5).otherwise(0)


def score_column(q: Query, d: str = "display_prefix", n: str = "number_first", n2: str = "number_last", f: str = "flat_number", lv: str = "level_number") -> Column:
    """parse.score() as one expression over entry columns."""
    d, n, n2, f, lv = (F.col(c) for c in (d, n, n2, f, lv))
    if not q.numbers:
        return F.when(f.isNull() & lv.isNull(), 2).otherwise(1)
    yes = lambda c: F.coalesce(c, F.lit(False))
    unit = f if q.level is not None else F.coalesce(f, lv)
    bare = f.isNull() & lv.isNull()
    out = F.lit(None).cast("int")
    at = yes((n == q.street) | F.lit(q.street).between(n, n2)) if q.street is not None else F.lit(False)
    hints = [(h, v) for h, v in ((q.flat, unit), (q.level, lv)) if h is not None]
    if q.street is not None and hints:
        good = F.lit(0)
        clash = F.lit(False)
        for h, v in hints:
            good = good + yes(v == h).cast("int")
            clash = clash | yes(v != h)
        out = F.when(at & (good == len(hints)), 200).when(at & (good > 0) & ~clash, 150).when(at & bare, 100).when(at, 90).when(good == len(hints), 70)
    elif q.street is not None:
        if q.flat_id:
            lead = F.trim(F.split_part(d, F.lit(","), F.lit(1)))
            at_score = F.when(yes((lead == q.flat_id) | lead.endswith(f" {q.flat_id}")), 110).otherwise(90)
        elif q.suffix:
            t = f"{q.street}{q.suffix}"
            at_score = F.when(yes((d == t) | d.startswith(f"{t},") | d.contains(f", {t}")), 110).otherwise(90)
        else:
            at_score = F.when(unit.isNotNull(), 90).otherwise(100)
        out = F.when(at, at_score).when(unit == q.street, 80)
    elif q.flat is not None:
        out = F.when(unit == q.flat, 80).when(n == q.flat, 50)
    shown = F.lit(False)
    for t in q.numbers:
        shown = shown | yes(d.contains(t))
    return F.coalesce(out, F.when(shown, 30).otherwise(0))


def tile(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    """(x, y) of the Web-Mercator tile and (px, py), the fractions within it."""
    size = 2**zoom
    x = (lng + 180) / 360 * size
    rad = lat * (math.pi / 180)
    y = (1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * size
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.floor(v), F.lit(size - 1))).cast("int")
    return clamp(x), clamp(y), x - F.floor(x), y - F.floor(y)


def inside(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd ray casting of a point against one ring, an array of structs (x, y)."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, turned, lambda a, b: ((a["y"] > py) != (b["y"] > py)) & (px < a["x"] + (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))))
    return F.size(F.filter(cross, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1
