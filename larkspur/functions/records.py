"""The nested answer and the lines of an address, from the wide imported table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import text_of


def some(name: str) -> Column:
    """A text column, empty as null."""
    return F.nullif(F.col(name).cast("string"), F.lit(""))


def _affixed(kind: str) -> Column:
    return F.concat(text_of(f"{kind}_prefix"), text_of(kind), text_of(f"{kind}_suffix"))


def _has(kind: str) -> Column:
    return some(f"{kind}_type_code").isNotNull() | F.col(f"{kind}_number").isNotNull()


def _unit(kind: str) -> Column:
    """LEVEL 3A, UNIT 5; empty if the address has neither type nor number."""
    return F.when(_has(kind), F.trim(F.concat(text_of(f"{kind}_type_name"), F.lit(" "), _affixed(f"{kind}_number")))).otherwise("")


def _number() -> Column:
    """The number with its affixes, and the last one of a range; null without one."""
    last = F.when(F.col("number_last").isNotNull(), F.concat(F.lit("-"), _affixed("number_last"))).otherwise("")
    return F.when(F.col("number_first").isNotNull(), F.concat(_affixed("number_first"), last))


def _lot() -> Column:
    return F.when(some("lot_number").isNotNull(), _affixed("lot_number"))


def _leading() -> Column:
    """Lines before the street: level, flat and building name; if there are all three, the first two share one."""
    lines = F.filter(F.array(_unit("level"), _unit("flat"), text_of("building_name")), lambda x: x != "")
    return F.when(F.size(lines) == 3, F.array(F.concat_ws(", ", F.get(lines, F.lit(0)), F.get(lines, F.lit(1))), F.get(lines, F.lit(2)))).otherwise(lines)


def _street(suffix: Column) -> Column:
    kind = F.when(some("street_type_code").isNotNull(), F.coalesce(some("street_type_abbrev"), "street_type_code"))
    return F.concat_ws(" ", "street_name", kind, F.when(some("street_suffix_code").isNotNull(), suffix))


def _place() -> Column:
    return F.concat(F.concat_ws(" ", "locality_name", "state"), F.lit(" "), text_of("postcode"))


def lines() -> Column:
    """The lines of the address; the last one keeps its trailing space if there is no postcode."""
    number = F.coalesce(_number(), F.concat(F.lit("LOT "), _lot()))
    street = F.concat_ws(" ", number, _street(F.coalesce(some("street_suffix_name"), "street_suffix_code")))
    return F.concat(_leading(), F.array(street, _place()))


def short_lines() -> Column:
    """The compact lines of an address with a flat: level code and number, flat/number STREET, locality; else null."""
    level = F.when(_has("level"), F.trim(F.concat(text_of("level_type_code"), _affixed("level_number")))).otherwise("")
    street = F.concat(_affixed("flat_number"), F.lit("/"), F.coalesce(_number(), _lot(), F.lit("")), F.lit(" "), _street(F.col("street_suffix_code")))
    return F.when(_has("flat"), F.concat(F.filter(F.array(level), lambda x: x != ""), F.array(street, _place())))


def prefix() -> Column:
    """What stands before the street's name, joined by commas."""
    number = F.coalesce(_number(), F.concat(F.lit("LOT "), _lot()))
    return F.concat_ws(", ", _leading(), number)


def _coded(code: str, name: str, other: Column | None = None) -> Column:
    return F.when(some(code).isNotNull(), F.struct(some(code).alias("code"), F.coalesce(some(name), other if other is not None else some(code)).alias("name")))


def _numbered(kind: str, there: Column, *more: Column) -> Column:
    return F.when(there, F.struct(some(f"{kind}_prefix").alias("prefix"), F.col(kind).alias("number"), some(f"{kind}_suffix").alias("suffix"), *more))


def _in_building(kind: str) -> Column:
    named = F.struct(text_of(f"{kind}_type_code").alias("code"), text_of(f"{kind}_type_name").alias("name"))
    return F.when(_has(kind), F.struct(named.alias("type"), some(f"{kind}_number_prefix").alias("prefix"), F.col(f"{kind}_number").alias("number"), some(f"{kind}_number_suffix").alias("suffix")))


def precedence() -> Column:
    """primary or secondary as marked, else primary for a principal address."""
    marked = some("primary_secondary")
    return F.when(marked.isNotNull(), F.when(marked == "P", "primary").otherwise("secondary")).when(F.coalesce(F.col("alias_principal"), F.lit("P")) == "P", "primary")


def response() -> Column:
    """The nested answer for an address; to_json() leaves out what has no value."""
    last = _numbered("number_last", F.col("number_last").isNotNull())
    structured = F.struct(
        F.coalesce("confidence", F.lit(0)).alias("confidence"),
        some("building_name").alias("buildingName"),
        _numbered("lot_number", some("lot_number").isNotNull()).alias("lotNumber"),
        _in_building("flat").alias("flat"),
        _in_building("level").alias("level"),
        _numbered("number_first", F.col("number_first").isNotNull(), last.alias("last")).alias("number"),
        F.struct(F.col("street_name").alias("name"), _coded("street_type_code", "street_type_abbrev").alias("type"), _coded("street_suffix_code", "street_suffix_name").alias("suffix"), _coded("street_class_code", "street_class_name").alias("class")).alias("street"),
        F.struct(F.col("locality_name").alias("name"), _coded("locality_class_code", "locality_class_name").alias("class")).alias("locality"),
        some("postcode").alias("postcode"),
        F.struct(F.col("state_name").alias("name"), F.col("state").alias("abbreviation")).alias("state"),
    )
    point = F.struct(F.lit(True).alias("default"), "latitude", "longitude", F.struct(text_of("geocode_type_code").alias("code"), text_of("geocode_type_name").alias("name")).alias("type"))
    geocoding = F.struct(F.struct(F.coalesce(F.col("level_geocoded_code").cast("string"), F.lit("0")).alias("code"), text_of("geocoded_level_name").alias("name")).alias("level"), F.array(point).alias("geocodes"))
    return F.struct(F.col("gnaf_pid").alias("pid"), F.array_join(lines(), ", ").alias("sla"), F.array_join(short_lines(), ", ").alias("ssla"), lines().alias("mla"), short_lines().alias("smla"), some("legal_parcel_id").alias("lpid"), precedence().alias("precedence"), structured.alias("structured"), geocoding.alias("geocoding"))
