"""The address tables: localities and the wide denormalised addresses from raw tables, and a mapping of the sample schema onto them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Portable SQL (Spark and DuckDB): the sample tables as addresses. Braces name the tables.
ADDRESSES_SQL = """
SELECT 'GA' || left(upper(r_name), 2) || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS gnaf_pid,
  CASE WHEN l_linenumber = 5 THEN 'A' ELSE 'P' END AS alias_principal,
  upper(split_part(p_name, ' ', 1)) AS street_name,
  CASE split_part(p_name, ' ', 2) WHEN 'anvil' THEN 'ROAD' WHEN 'bolt' THEN 'STREET' WHEN 'gear' THEN 'AVENUE' WHEN 'gizmo' THEN 'COURT'
    WHEN 'plate' THEN 'PLACE' WHEN 'ring' THEN 'DRIVE' WHEN 'rod' THEN 'CRESCENT' ELSE 'TERRACE' END AS street_type_code,
  CASE split_part(p_name, ' ', 2) WHEN 'anvil' THEN 'RD' WHEN 'bolt' THEN 'ST' WHEN 'gear' THEN 'AV' WHEN 'gizmo' THEN 'CT'
    WHEN 'plate' THEN 'PL' WHEN 'ring' THEN 'DR' WHEN 'rod' THEN 'CR' ELSE 'TCE' END AS street_type_abbrev,
  CASE WHEN p_size % 10 = 0 THEN 'N' END AS street_suffix_code,
  CASE WHEN p_size % 10 = 0 THEN 'NORTH' END AS street_suffix_name,
  upper(replace(n_name, '_', ' ')) AS locality_name, upper(r_name) AS state,
  CASE WHEN n_nationkey <> 24 THEN CAST(2000 + n_nationkey AS string) END AS postcode,
  CASE WHEN l_linenumber < 7 THEN CAST(round(l_quantity) AS int) END AS number_first,
  CASE WHEN l_linenumber = 6 THEN CAST(round(l_quantity) AS int) + 4 END AS number_last,
  CASE WHEN l_linenumber >= 7 THEN CAST(l_linenumber AS string) END AS lot_number,
  CASE WHEN l_returnflag = 'R' THEN 'UNIT' END AS flat_type_code,
  CASE WHEN l_returnflag = 'R' THEN l_linenumber END AS flat_number,
  CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'L' END AS level_type_code,
  CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'LEVEL' END AS level_type_name,
  CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN CAST(round(l_tax * 100) AS int) END AS level_number,
  CAST(round(l_discount * 100) AS int) % 4 - 1 AS confidence,
  CASE WHEN l_linenumber = 4 THEN '' ELSE l_partkey || '/DP' || l_suppkey END AS legal_parcel_id,
  round(-44 + 34 * ((l_extendedprice * 7 + l_partkey) % 1000) / 1000, 6) AS latitude,
  round(112 + 42 * ((l_extendedprice * 3 + l_suppkey) % 1000) / 1000, 6) AS longitude
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
  JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE CAST(round(l_discount * 100) AS int) % 4 - 1 > -1
"""


def sample_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample tables as addresses with a confidence above -1."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part", "supplier", "nation", "region")}
    return spark.sql(ADDRESSES_SQL, **tables)


def whole_number(column: str) -> Column:
    """A text as an integer, rounded; null if it isn't a number."""
    return F.expr(f"try_cast(round(try_cast({column} as double)) as int)")


def localities(raw: dict[str, DataFrame]) -> DataFrame:
    """Localities with their state, class and mean point. Small tables are joined as Spark sees fit by their size."""
    rows = raw["locality"].join(raw["state"].select("state_pid", "state_abbreviation", "state_name"), "state_pid")
    rows = rows.join(raw["locality_class_aut"].select(F.col("code").alias("locality_class_code"), F.col("name").alias("locality_class_name")), "locality_class_code")
    points = raw["locality_point"].select("locality_pid", F.expr("try_cast(latitude as double)").alias("lat"), F.expr("try_cast(longitude as double)").alias("lng"))
    keys = ["locality_pid", "locality_name", F.col("primary_postcode").alias("postcode"), F.col("state_abbreviation").alias("state"), "state_name", "locality_class_code", "locality_class_name"]
    return rows.join(points, "locality_pid", "left").groupBy(*keys).agg(F.avg("lat").alias("latitude"), F.avg("lng").alias("longitude"))


#: Columns of the wide table, in order.
WIDE = """gnaf_pid alias_principal primary_secondary building_name lot_number_prefix lot_number lot_number_suffix flat_type_code flat_type_name
flat_number_prefix flat_number flat_number_suffix level_type_code level_type_name level_number_prefix level_number level_number_suffix
number_first_prefix number_first number_first_suffix number_last_prefix number_last number_last_suffix street_name street_type_code street_type_abbrev
street_suffix_code street_suffix_name street_class_code street_class_name locality_name locality_class_code locality_class_name locality_postcode postcode
state state_name latitude longitude geocode_type_code geocode_type_name level_geocoded_code geocoded_level_name confidence legal_parcel_id
mb_2016_code mb_2021_code""".split()


def addresses(raw: dict[str, DataFrame], places: DataFrame) -> DataFrame:
    """The wide address table of 47 columns: three inner joins, labels from authority tables, mesh blocks (which may repeat an address).

    Only the columns it has are taken from the raw tables; an address keeps its own postcode beside its locality's.
    """
    detail = raw["address_detail"].where("try_cast(confidence as int) > -1")
    street = raw["street_locality"].select("street_locality_pid", "street_name", "street_type_code", "street_suffix_code", "street_class_code")
    place = places.select("locality_pid", "locality_name", "locality_class_code", "locality_class_name", F.col("postcode").alias("locality_postcode"), "state", "state_name")
    point = raw["address_default_geocode"].select("address_detail_pid", F.expr("try_cast(latitude as double)").alias("latitude"), F.expr("try_cast(longitude as double)").alias("longitude"), "geocode_type_code")
    out = detail.join(street, "street_locality_pid").join(place, "locality_pid").join(point, "address_detail_pid")
    labels = {"geocode_type_aut": ("geocode_type_code", "geocode_type_name"), "flat_type_aut": ("flat_type_code", "flat_type_name"), "level_type_aut": ("level_type_code", "level_type_name"), "street_type_aut": ("street_type_code", "street_type_abbrev"), "street_suffix_aut": ("street_suffix_code", "street_suffix_name"), "street_class_aut": ("street_class_code", "street_class_name")}
    for table, (code, name) in labels.items():
        out = out.join(raw[table].select(F.col("code").alias(code), F.col("name").alias(name)), code, "left")
    level = raw["geocoded_level_type_aut"].select(F.expr("try_cast(code as int)").alias("level_key"), F.col("name").alias("geocoded_level_name"))
    out = out.join(level, F.expr("try_cast(level_geocoded_code as int)") == F.col("level_key"), "left")
    for year in ("2016", "2021"):
        blocks = raw[f"address_mesh_block_{year}"].join(raw[f"mb_{year}"], f"mb_{year}_pid").select("address_detail_pid", f"mb_{year}_code")
        out = out.join(blocks, "address_detail_pid", "left")
    numbers = {c: whole_number(c) for c in ("flat_number", "level_number", "number_first", "number_last", "level_geocoded_code", "confidence")}
    return out.withColumns(numbers).withColumnRenamed("address_detail_pid", "gnaf_pid").select(*WIDE)
