"""Point lookups, drill-down into a street, and polygon overlays."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records
from ..functions.columns import inside, shard, single_line, tile


def address_by_pid(addresses: DataFrame, pid: str) -> DataFrame:
    """The address of an id, in any case; the least row if the id repeats."""
    return addresses.where(F.col("gnaf_pid") == pid.upper()).orderBy("number_first", "flat_number").limit(1)


def addresses_by_parcel(addresses: DataFrame, parcel: str) -> DataFrame:
    """All addresses of a legal parcel; ids compare exactly."""
    return addresses.where((F.col("legal_parcel_id") == parcel) & (F.col("legal_parcel_id") != ""))


def parcels(addresses: DataFrame) -> DataFrame:
    """(legal_parcel_id, shard, pids) of all parcels."""
    rows = addresses.where("legal_parcel_id is not null and legal_parcel_id != ''")
    return rows.groupBy("legal_parcel_id").agg(F.array_sort(F.collect_list("gnaf_pid")).alias("pids")).withColumn("lotdp_shard", shard(F.col("legal_parcel_id")))


def responses(addresses: DataFrame) -> DataFrame:
    """(pid, response): the nested answer for each address of the wide table."""
    return addresses.select(F.col("gnaf_pid").alias("pid"), records.response().alias("response"))


def responses_of_parcel(parcels: DataFrame, addresses: DataFrame, parcel: str) -> DataFrame:
    """The answers of a parcel's addresses, from the table of parcels; ids without an address are left out."""
    pids = parcels.where(F.col("legal_parcel_id") == parcel).select(F.explode("pids").alias("gnaf_pid"))
    return responses(addresses.join(pids, "gnaf_pid", "left_semi"))


def street_by_id(streets: DataFrame, street_id: int) -> DataFrame:
    """The street of an id, or no row."""
    return streets.where(F.col("street_id") == street_id).limit(1)


def drill_down(streets: DataFrame, entries: DataFrame, street_id: int, digit: str | None = None) -> DataFrame:
    """(p, s) of a street's entries by number, level and flat, those without first; s is the address on one line.

    entries: with_digits(). With a digit, only its entries and those that aren't split off by digit.
    """
    rows = entries.join(F.broadcast(street_by_id(streets, street_id)), "street_key")  # one row
    if digit is not None:
        rows = rows.where(F.col("digit").isNull() | (F.col("digit") == digit))
    order = [F.coalesce(c, F.lit(-1)) for c in ("number_first", "level_number", "flat_number")]
    return rows.orderBy(*order, "gnaf_pid").select(F.col("gnaf_pid").alias("p"), single_line().alias("s"))


def street_entries(entries: DataFrame, key: str) -> DataFrame:
    """Entries of a street by number, level and flat, those without first."""
    rows = entries.where(F.col("street_key") == key)
    return rows.orderBy(*[F.coalesce(c, F.lit(-1)) for c in ("number_first", "level_number", "flat_number")], "gnaf_pid")


def overlay(points: DataFrame, polygons: DataFrame, zoom: int) -> DataFrame:
    """points (id, latitude, longitude) with the other columns of each polygon (x, y, ring or rings, ...) that holds them.

    Tiles make it an equi-join; ray casting decides within a tile. rings: outer and inner rings of all parts of a polygon; a
    point counts as inside if it is in an odd number of them, so holes are left out. Places are columns of a generator: the
    optimizer would otherwise restate ray casting over each key equal to one that a coordinate is computed from, several times
    a point, and may filter by a copy before its key is joined, which fails.
    """
    x, y, px, py = tile(F.col("latitude"), F.col("longitude"), zoom)
    place = F.struct(x.alias("x"), y.alias("y"), px.alias("_px"), py.alias("_py"))
    placed = points.drop("x", "y", "_px", "_py").select("*", F.inline(F.array(place)))
    if "rings" in polygons.columns:
        within = F.size(F.filter("rings", lambda r: inside(F.col("_px"), F.col("_py"), r))) % 2 == 1
    else:
        within = inside(F.col("_px"), F.col("_py"), F.col("ring"))
    return placed.join(polygons, ["x", "y"]).where(within).drop("_px", "_py")


def chosen_properties(props: Column, keys: list[str] | None) -> Column:
    """The configured keys of a map that it has; all of it if none are configured."""
    return props if keys is None else F.map_filter(props, lambda k, _: k.isin(*keys))


def overlay_by_layer(points: DataFrame, polygons: DataFrame, zoom: int, keys: list[str] | None = None, id_col: str = "gnaf_pid") -> DataFrame:
    """(id, layer, features): the properties of all polygons of each layer that hold a point; layers without any have no row."""
    held = overlay(points, polygons, zoom).select(id_col, "layer", chosen_properties(F.col("props"), keys).alias("props"))
    return held.groupBy(id_col, "layer").agg(F.array_sort(F.collect_list(F.to_json("props"))).alias("features"))


def shard_records(addresses: DataFrame, digits: int = 3) -> DataFrame:
    """(prefix, records): for each shard the map of ids to nested answers as JSON; of an id that repeats the greatest wins."""
    one = responses(addresses).groupBy("pid").agg(F.max(F.to_json("response")).alias("json"))
    return one.groupBy(shard(F.col("pid"), digits).alias("prefix")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pid", "json")))).alias("records"))


def layer_settings(text: str) -> list[dict]:
    """Overlay layers of a JSON setting; quotes that were escaped on the way are read as quotes, anything else is no layer."""
    for form in (text, text.replace(chr(92) + chr(34), chr(34))):
        try:
            found = json.loads(form)
        except ValueError:
            continue
        return found if isinstance(found, list) else []
    return []
