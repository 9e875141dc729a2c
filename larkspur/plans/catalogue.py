"""Queries over the sample tables, one for each family of operators, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.parse import is_short, normalise, parse, token_column
from ..operators import lookup, search, streets
from ..session import new_folder
from ..functions import records
from ..sources.model import ADDRESSES_SQL, WIDE, sample_addresses
from ..sources.psv import street_values
from ..sources.raw import LOCALITIES_CTE, WIDE_CTE, imported_addresses, imported_localities

#: Entries a street needs before it is split by digit, for the sample data.
THRESHOLD = 20
A = f"a AS ({ADDRESSES_SQL.format(lineitem='lineitem', part='part', supplier='supplier', nation='nation', region='region')})"
_KEY = "street_name || '|' || street_type_abbrev || '|' || coalesce(street_suffix_code, '') || '|' || locality_name || '|' || state || '|' || coalesce(postcode, '')"
S = f"""{A}, s0 AS (SELECT street_name, street_type_abbrev, street_suffix_code, locality_name, state, postcode, count(*) AS address_count,
  min(number_first) AS num_min, max(greatest(number_first, number_last)) AS num_max, min(least(flat_number, level_number)) AS flat_min,
  max(greatest(flat_number, level_number)) AS flat_max, min(street_type_code) AS street_type_code, min(street_suffix_name) AS street_suffix_name
  FROM a WHERE alias_principal = 'P' GROUP BY ALL),
s AS (SELECT *, {_KEY} AS street_key, left(md5({_KEY}), 3) AS shard_prefix,
  street_name || ' ' || street_type_abbrev || coalesce(' ' || street_suffix_code, '') || ', ' || locality_name || ', ' || state || coalesce(', ' || postcode, '') AS display,
  replace(street_name || ' ' || street_type_code || coalesce(' ' || street_suffix_name, '') || ', ' || locality_name || ', ' || state || coalesce(', ' || postcode, ''), '''', '') AS display_search,
  row_number() OVER (ORDER BY state NULLS LAST, locality_name NULLS LAST, street_name NULLS LAST, street_type_abbrev NULLS LAST, street_suffix_code NULLS LAST, postcode NULLS LAST) AS street_id FROM s0)"""
_NUM = "coalesce(CAST(number_first AS varchar) || coalesce('-' || CAST(number_last AS varchar), ''), 'LOT ' || lot_number)"
_LEVEL = "trim(coalesce(level_type_name, '') || ' ' || coalesce(CAST(level_number AS varchar), ''))"
_FLAT = "trim(coalesce(flat_type_code, '') || ' ' || coalesce(CAST(flat_number AS varchar), ''))"
_PREFIX = f"array_to_string(list_filter([{_LEVEL}, {_FLAT}, coalesce({_NUM}, '')], lambda x: x <> ''), ', ')"
_PLACE = "locality_name || ' ' || state || ' ' || coalesce(postcode, '')"
E = f"{S}, e AS (SELECT gnaf_pid, {_KEY} AS street_key, {_PREFIX} AS display_prefix, number_first, number_last, flat_number, level_number FROM a WHERE alias_principal = 'P')"
D = f"{E}, d AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY street_key) > {THRESHOLD} THEN left(CAST(number_first AS varchar), 1) END AS digit FROM e)"
_SLA = "trim(display_prefix || ' ' || street_name || ' ' || street_type_abbrev || coalesce(' ' || street_suffix_code, '') || ', ' || locality_name || ' ' || state || ' ' || coalesce(postcode, ''))"
_TIER = "CASE WHEN address_count >= 2000 THEN 20 WHEN address_count >= 500 THEN 15 WHEN address_count >= 100 THEN 10 WHEN address_count >= 20 THEN 5 ELSE 0 END"
_STREET_COLUMNS = ["street_id", "street_key", "shard_prefix", "display", "display_search", "address_count", "num_min", "num_max", "flat_min", "flat_max"]

Query = Callable[[SparkSession, str], DataFrame]


def _streets(spark: SparkSession, sf: str) -> DataFrame:
    return streets.with_ids(streets.streets(sample_addresses(spark, sf)))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return streets.entries(sample_addresses(spark, sf))


def _localities(spark: SparkSession, sf: str) -> DataFrame:
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("nation", "region", "supplier")}
    rows = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).join(t["supplier"], F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.col("n_name").alias("locality_name"), F.col("r_name").alias("state")).agg(F.round(F.avg("s_acctbal"), 4).alias("mean_point"), F.count("s_suppkey").alias("points"))


#: Folder of the standing index of the sample tables, by application and place of the tables.
_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(streets, postings, entries, statistics), written once an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        folder = new_folder(spark, "index")
        search.write_index(sample_addresses(spark, sf), folder)
        _INDEXES[key] = folder
    return search.read_index(spark, _INDEXES[key])


def _search(query: str, limit: int = 10) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows, index, entries, total = _index(spark, sf)
        return search.search(rows, index, entries, query, limit, THRESHOLD, total)

    return run


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    _, index, _, total = _index(spark, sf)
    return search.bm25(index, parse("red st"), total).select("street_id", F.round("rank", 6).alias("rank"))


def _bonus(spark: SparkSession, sf: str) -> DataFrame:
    return _streets(spark, sf).select("street_id", search.bonus(parse("2/5 small rd")).cast("int").alias("bonus"))


def _scores(query: str) -> Query:
    return lambda spark, sf: _entries(spark, sf).select("gnaf_pid", "street_key", "display_prefix", C.score_column(parse(query)).alias("score")).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


def _precompute(spark: SparkSession, sf: str) -> DataFrame:
    return search.streets_of_beginnings(_streets(spark, sf))


def _range_join(spark: SparkSession, sf: str) -> DataFrame:
    """All one- and two-digit numbers."""
    return search.streets_of_numbers(_streets(spark, sf), spark.range(100).select(F.col("id").cast("int").alias("number")))


def _queries_of(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit("/ "), "p_name", F.lit("-Rd. "), "p_brand").alias("raw"))


def _overlay(spark: SparkSession, sf: str) -> DataFrame:
    x, y, _, _ = C.tile(F.col("latitude"), F.col("longitude"), 6)
    points = sample_addresses(spark, sf).select("gnaf_pid", "latitude", "longitude")
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9))])
    polygons = points.select(x.alias("x"), y.alias("y")).distinct().select("x", "y", F.lit("square").alias("layer"), ring.alias("ring"))
    return lookup.overlay(points, F.broadcast(polygons), 6).select("gnaf_pid", "x", "y", "layer")  # at most 64 x 64 tiles


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """The nested answers, shown field by field."""
    r = lookup.responses(imported_addresses(spark, sf)).select("response.*")
    number = lambda f, n: F.concat(F.coalesce(f"structured.{f}.prefix", F.lit("")), F.lit("|"), F.coalesce(F.col(f"structured.{f}.number").cast("string"), F.lit("")), F.lit("|"), F.coalesce(f"structured.{f}.suffix", F.lit(""))).alias(n)
    named = lambda f, n: F.concat_ws("=", f"{f}.code", f"{f}.name").alias(n)
    return r.select("pid", "sla", "ssla", F.array_join("mla", ";").alias("mla"), F.array_join("smla", ";").alias("smla"), "lpid", "precedence", F.col("structured.buildingName").alias("building"), number("lotNumber", "lot"), number("flat", "flat"), number("level", "level"), number("number", "number"), number("number.last", "last"), named("structured.flat.type", "flat_type"), named("structured.level.type", "level_type"), named("structured.street.type", "street_type"), named("structured.street.suffix", "street_suffix"), named("structured.street.class", "street_class"), named("structured.locality.class", "locality_class"), F.col("structured.postcode").alias("postcode"), F.col("structured.state.name").alias("state_name"), F.col("structured.confidence").alias("confidence"), named("geocoding.level", "geocoded_level"), F.col("geocoding.geocodes")[0]["latitude"].alias("latitude"), F.concat_ws("=", F.col("geocoding.geocodes")[0]["type"]["code"], F.col("geocoding.geocodes")[0]["type"]["name"]).alias("geocode_type"))


def _parcel(spark: SparkSession, sf: str) -> DataFrame:
    """The addresses of the least parcel, through the table of parcels."""
    rows = sample_addresses(spark, sf)
    least = rows.where("legal_parcel_id != ''").agg(F.min("legal_parcel_id")).first()[0]
    return lookup.addresses_by_parcel(rows, least).select("gnaf_pid")


_LARGEST = "(SELECT street_id FROM s ORDER BY address_count DESC, street_id LIMIT 1)"


def _drill_down(threshold: int, digit: str | None) -> Query:
    """The entries of the street with most addresses."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _index(spark, sf)[0]
        largest = rows.orderBy(F.desc("address_count"), "street_id").first()["street_id"]
        return lookup.drill_down(rows, streets.with_digits(_entries(spark, sf), threshold), largest, digit)

    return run


def _script_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _streets(spark, sf).select(F.col("street_id").alias("id"), "display", "display_search", "street_key", "shard_prefix", "street_name", F.col("street_type_abbrev").alias("street_type"), F.col("street_suffix_code").alias("street_suffix"), "locality_name", "state", "postcode", "address_count", F.lit(None).cast("string").alias("digit_shards"), "num_min", "num_max", "flat_min", "flat_max")


_quoted = lambda c: f"chr(39) || replace({c}, chr(39), chr(39) || chr(39)) || chr(39)"
_AFF = lambda k: f"(coalesce({k}_prefix, '') || coalesce(CAST({k} AS varchar), '') || coalesce({k}_suffix, ''))"
_SHOWN = lambda k, there: f"CASE WHEN {there} THEN coalesce({k}_prefix, '') || '|' || coalesce(CAST({k} AS varchar), '') || '|' || coalesce({k}_suffix, '') ELSE '||' END"
_CODED = lambda c, n: f"CASE WHEN {c} IS NOT NULL THEN {c} || '=' || coalesce({n}, {c}) ELSE '' END"
_FLAT_THERE, _LEVEL_THERE = "(flat_type_code IS NOT NULL OR flat_number IS NOT NULL)", "(level_type_code IS NOT NULL OR level_number IS NOT NULL)"
_W_NUM = f"CASE WHEN number_first IS NOT NULL THEN {_AFF('number_first')} || CASE WHEN number_last IS NOT NULL THEN '-' || {_AFF('number_last')} ELSE '' END END"
_W_LEAD = f"list_filter([CASE WHEN {_LEVEL_THERE} THEN trim(coalesce(level_type_name, '') || ' ' || {_AFF('level_number')}) ELSE '' END, CASE WHEN {_FLAT_THERE} THEN trim(coalesce(flat_type_name, '') || ' ' || {_AFF('flat_number')}) ELSE '' END, coalesce(building_name, '')], lambda x: x <> '')"
_W_STREET = "street_name || CASE WHEN street_type_code IS NOT NULL THEN ' ' || coalesce(street_type_abbrev, street_type_code) ELSE '' END"
_W_PLACE = "locality_name || ' ' || state || ' ' || coalesce(postcode, '')"
_RESPONSE_SQL = f""", x AS (SELECT *, {_W_LEAD} AS lead_, {_W_NUM} AS num_ FROM wide),
y AS (SELECT *, (CASE WHEN len(lead_) = 3 THEN [lead_[1] || ', ' || lead_[2], lead_[3]] ELSE lead_ END) || [coalesce(num_ || ' ', 'LOT ' || {_AFF('lot_number')} || ' ', '') || {_W_STREET} || CASE WHEN street_suffix_code IS NOT NULL THEN ' ' || coalesce(street_suffix_name, street_suffix_code) ELSE '' END, {_W_PLACE}] AS mla_,
  CASE WHEN {_FLAT_THERE} THEN list_filter([CASE WHEN {_LEVEL_THERE} THEN trim(coalesce(level_type_code, '') || {_AFF('level_number')}) ELSE '' END], lambda x: x <> '') || [{_AFF('flat_number')} || '/' || coalesce(num_, CASE WHEN lot_number IS NOT NULL THEN {_AFF('lot_number')} END, '') || ' ' || {_W_STREET} || coalesce(' ' || street_suffix_code, ''), {_W_PLACE}] END AS smla_ FROM (SELECT * REPLACE (CASE WHEN lot_number IS NULL THEN NULL ELSE coalesce(lot_number_prefix, '') END AS lot_number_prefix) FROM x))
SELECT gnaf_pid AS pid, array_to_string(mla_, ', ') AS sla, array_to_string(smla_, ', ') AS ssla, array_to_string(mla_, ';') AS mla, array_to_string(smla_, ';') AS smla, nullif(legal_parcel_id, '') AS lpid,
  CASE WHEN primary_secondary IS NOT NULL THEN CASE primary_secondary WHEN 'P' THEN 'primary' ELSE 'secondary' END WHEN alias_principal = 'P' THEN 'primary' END AS precedence, building_name AS building,
  {_SHOWN('lot_number', 'lot_number IS NOT NULL')} AS lot, {_SHOWN('flat_number', _FLAT_THERE)} AS flat, {_SHOWN('level_number', _LEVEL_THERE)} AS level, {_SHOWN('number_first', 'number_first IS NOT NULL')} AS number, {_SHOWN('number_last', 'number_first IS NOT NULL AND number_last IS NOT NULL')} AS last,
  CASE WHEN {_FLAT_THERE} THEN coalesce(flat_type_code, '') || '=' || coalesce(flat_type_name, '') ELSE '' END AS flat_type, CASE WHEN {_LEVEL_THERE} THEN coalesce(level_type_code, '') || '=' || coalesce(level_type_name, '') ELSE '' END AS level_type,
  {_CODED('street_type_code', 'street_type_abbrev')} AS street_type, {_CODED('street_suffix_code', 'street_suffix_name')} AS street_suffix, {_CODED('street_class_code', 'street_class_name')} AS street_class, {_CODED('locality_class_code', 'locality_class_name')} AS locality_class,
  postcode, state_name, confidence, coalesce(CAST(level_geocoded_code AS varchar), '0') || '=' || coalesce(geocoded_level_name, '') AS geocoded_level, latitude, coalesce(geocode_type_code, '') || '=' || coalesce(geocode_type_name, '') AS geocode_type FROM y"""
def _square(x0: float, y0: float, x1: float, y1: float) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def _hole(spark: SparkSession, sf: str) -> DataFrame:
    """A square with a hole and a polygon of two parts in each tile; of their properties only the name is asked for."""
    x, y, _, _ = C.tile(F.col("latitude"), F.col("longitude"), 6)
    points = sample_addresses(spark, sf).select("gnaf_pid", "latitude", "longitude")
    tiles = points.select(x.alias("x"), y.alias("y")).distinct()
    of = lambda name, *rings: tiles.select("x", "y", F.lit("land").alias("layer"), F.create_map(F.lit("name"), F.lit(name), F.lit("size"), F.lit("5")).alias("props"), F.array(*rings).alias("rings"))
    polygons = of("ring", _square(0.1, 0.1, 0.9, 0.9), _square(0.4, 0.4, 0.6, 0.6)).unionByName(of("two", _square(0.0, 0.3, 0.2, 0.8), _square(0.7, 0.3, 0.9, 0.8)))
    out = lookup.overlay_by_layer(points, polygons, 6, ["name", "missing"])
    return out.select("gnaf_pid", "layer", F.size("features").alias("n"), F.array_join("features", ";").alias("features"))


_RAD = "radians(latitude)"
_TX = "(longitude + 180) / 360 * 64"
_TY = f"(1 - ln(tan({_RAD}) + 1 / cos({_RAD})) / pi()) / 2 * 64"
_NUMBER_SCORE = "CASE WHEN number_first = 12 THEN CASE WHEN flat_number IS NULL AND level_number IS NULL THEN 100 ELSE 90 END WHEN 12 BETWEEN number_first AND number_last THEN 50 END"
_FORMAT = "SELECT '  ' || p_partkey || '/ ' || p_name || '-Rd. ' || p_brand AS raw FROM part"
_BONUS = f"(CASE WHEN street_name = 'SMALL' THEN 100 WHEN starts_with(street_name, 'SMALL') THEN 10 ELSE 0 END + CASE WHEN num_min IS NULL OR num_max IS NULL THEN 0 WHEN 5 BETWEEN num_min AND num_max THEN 200 ELSE -50 END + CASE WHEN 2 BETWEEN flat_min AND flat_max THEN 50 ELSE 0 END + {_TIER})"
_PART_WORDS = "list_filter(regexp_split_to_array(lower(display_search), '[^a-z0-9]+'), lambda x: x <> '')"
_BM25 = f"""{S}, w AS (SELECT street_id, {_PART_WORDS} AS ws FROM s), m AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
t AS (SELECT street_id, len(ws) AS length, len(list_filter(ws, lambda x: x = 'red')) AS f1, len(list_filter(ws, lambda x: x = 'street')) AS f2, len(list_filter(ws, lambda x: starts_with(x, 'st'))) AS f3 FROM w),
i AS (SELECT *, greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) AS i1, greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) AS i2, greatest(ln((n - d3 + 0.5) / (d3 + 0.5)), 1e-6) AS i3 FROM m, (SELECT count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2, count(*) FILTER (f3 > 0) AS d3 FROM t))
SELECT street_id, round(-(i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * length / mean)) + i2 * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * length / mean)) + i3 * f3 * 2.2 / (f3 + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS rank
FROM t, i WHERE f1 > 0 AND (f2 > 0 OR f3 > 0)"""

#: Name: (query, DuckDB SQL or None).
CATALOGUE: dict[str, tuple[Query, str | None]] = {
    "address_table": (sample_addresses, f"WITH {A} SELECT * FROM a"),
    "localities_mean_point": (_localities, "SELECT n_name AS locality_name, r_name AS state, round(avg(s_acctbal), 4) AS mean_point, count(s_suppkey) AS points FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2"),
    "shard_prefix_counts": (lambda s, d: sample_addresses(s, d).groupBy(C.shard(F.col("gnaf_pid")).alias("prefix")).agg(F.count(F.lit(1)).alias("n")), f"WITH {A} SELECT left(md5(gnaf_pid), 3) AS prefix, count(*) AS n FROM a GROUP BY 1"),
    "parcel_pid_lists": (lambda s, d: lookup.parcels(sample_addresses(s, d)).select("legal_parcel_id", "lotdp_shard", F.array_join("pids", ",").alias("pids")), f"WITH {A} SELECT legal_parcel_id, left(md5(legal_parcel_id), 3) AS lotdp_shard, string_agg(gnaf_pid, ',' ORDER BY gnaf_pid) AS pids FROM a WHERE legal_parcel_id <> '' GROUP BY 1"),
    "street_table": (lambda s, d: _streets(s, d).select(*_STREET_COLUMNS), f"WITH {S} SELECT {', '.join(_STREET_COLUMNS)} FROM s"),
    "street_entries": (_entries, f"WITH {E} SELECT * FROM e"),
    "digit_split_entries": (lambda s, d: streets.with_digits(_entries(s, d), THRESHOLD).select("gnaf_pid", "street_key", "digit"), f"WITH {D} SELECT gnaf_pid, street_key, digit FROM d"),
    "digit_files": (lambda s, d: streets.digit_files(_entries(s, d), THRESHOLD), f"WITH {D} SELECT street_key, digit, count(*) AS entries, left(md5(street_key || '|' || digit), 3) AS prefix FROM d WHERE digit IS NOT NULL GROUP BY 1, 2"),
    "visible_least_digit": (lambda s, d: streets.visible(_entries(s, d), None, None, THRESHOLD).groupBy("street_key").agg(F.count(F.lit(1)).alias("n")), f"WITH {D} SELECT street_key, count(*) AS n FROM (SELECT *, min(digit) OVER (PARTITION BY street_key) AS least FROM d) WHERE digit IS NULL OR digit = least GROUP BY 1"),
    "visible_hinted_digit": (lambda s, d: streets.visible(_entries(s, d), 12, None, THRESHOLD).groupBy("street_key").agg(F.count(F.lit(1)).alias("n")), f"WITH {D} SELECT street_key, count(*) AS n FROM (SELECT *, count(digit) OVER (PARTITION BY street_key) > 0 AS split FROM d) WHERE NOT split OR digit = '1' GROUP BY 1"),
    "address_lines": (lambda s, d: sample_addresses(s, d).select("gnaf_pid", F.array_join(C.address_lines(), "; ").alias("mla")), f"WITH {A} SELECT gnaf_pid, array_to_string(list_filter([{_LEVEL}, {_FLAT}], lambda x: x <> '') || [coalesce({_NUM} || ' ', '') || street_name || ' ' || street_type_abbrev || coalesce(' ' || street_suffix_name, ''), {_PLACE}], '; ') AS mla FROM a"),
    "short_address_lines": (lambda s, d: sample_addresses(s, d).select("gnaf_pid", F.array_join(C.short_lines(), "; ").alias("smla")), f"WITH {A} SELECT gnaf_pid, CASE WHEN flat_type_code IS NOT NULL THEN array_to_string(list_filter([coalesce(level_type_code, '') || coalesce(CAST(level_number AS varchar), '')], lambda x: x <> '') || [flat_number || '/' || coalesce(CAST(number_first AS varchar) || coalesce('-' || CAST(number_last AS varchar), ''), lot_number, '') || ' ' || street_name || ' ' || street_type_abbrev || coalesce(' ' || street_suffix_code, ''), {_PLACE}], '; ') END AS smla FROM a"),
    "single_line_addresses": (lambda s, d: sample_addresses(s, d).withColumn("display_prefix", C.display_prefix()).select("gnaf_pid", C.single_line().alias("sla")), f"WITH {A} SELECT gnaf_pid, {_SLA} AS sla FROM (SELECT *, {_PREFIX} AS display_prefix FROM a)"),
    "streets_with_number": (lambda s, d: _streets(s, d).where(F.lit(12).between(F.col("num_min"), F.col("num_max"))).orderBy(F.desc("address_count"), "street_id").limit(30).select("street_id", "address_count"), f"WITH {S} SELECT street_id, address_count FROM s WHERE 12 BETWEEN num_min AND num_max ORDER BY address_count DESC, street_id LIMIT 30"),
    "number_range_join": (_range_join, f"WITH {S} SELECT CAST(number AS int) AS number, street_id FROM range(100) r(number) JOIN s ON number BETWEEN num_min AND num_max"),
    "number_search": (lambda s, d: search.number_search(_streets(s, d), _entries(s, d), 12), f"WITH {E}, b AS (SELECT *, row_number() OVER (ORDER BY address_count DESC, street_id) AS street_rank FROM s WHERE 12 BETWEEN num_min AND num_max QUALIFY street_rank <= 30), r AS (SELECT *, {_NUMBER_SCORE} AS score, {_SLA} AS sla FROM e JOIN b USING (street_key) WHERE {_NUMBER_SCORE} > 0), t AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY street_key ORDER BY score DESC, street_rank, gnaf_pid) = 1 THEN 0 ELSE 1 END AS turn FROM r) SELECT gnaf_pid, street_id, CAST(street_rank AS int) AS street_rank, score, sla FROM t ORDER BY turn, score DESC, street_rank, gnaf_pid LIMIT 10"),
    "prefix_street_search": (lambda s, d: (lambda rows: search.street_hits(rows, search.postings(rows), parse("5 r"), 10))(_index(s, d)[0]).select("street_id", "street_rank"), f"WITH {S} SELECT street_id, CAST(row_number() OVER (ORDER BY address_count DESC, street_id) AS int) AS street_rank FROM s WHERE starts_with(street_name, 'R') AND 5 BETWEEN num_min AND num_max ORDER BY street_rank LIMIT 10"),
    "street_bm25": (_bm25, f"WITH {_BM25}"),
    "street_bonus": (_bonus, f"WITH {S} SELECT street_id, {_BONUS} AS bonus FROM s"),
    "scores_number": (_scores("5 red st"), f"WITH {E} SELECT CASE WHEN number_first = 5 OR 5 BETWEEN number_first AND number_last THEN CASE WHEN coalesce(flat_number, level_number) IS NOT NULL THEN 90 ELSE 100 END WHEN coalesce(flat_number, level_number) = 5 THEN 80 WHEN contains(display_prefix, '5') THEN 30 ELSE 0 END AS score, count(*) AS n FROM e GROUP BY 1"),
    "scores_flat_and_number": (_scores("2/5 red st"), f"WITH {E}, x AS (SELECT *, coalesce(flat_number, level_number) AS u, coalesce(number_first = 5 OR 5 BETWEEN number_first AND number_last, false) AS hit FROM e) SELECT CASE WHEN hit AND u = 2 THEN 200 WHEN hit AND u IS NULL THEN 100 WHEN hit THEN 90 WHEN u = 2 THEN 70 WHEN contains(display_prefix, '2') OR contains(display_prefix, '5') THEN 30 ELSE 0 END AS score, count(*) AS n FROM x GROUP BY 1"),
    "search_number_street": (_search("5 red st"), None),
    "search_words": (_search("small road nation"), None),
    "search_unit": (_search("unit 3 12 old pl"), None),
    "precomputed_two_letters": (_precompute, f"WITH {S}, p AS (SELECT street_id, address_count, street_name, unnest(list_distinct([lower(left(street_name, 2)), lower(left(locality_name, 2)), lower(left(state, 2))])) AS q FROM s), r AS (SELECT q, street_id, address_count, CASE WHEN lower(street_name) = q THEN 115 WHEN starts_with(lower(street_name), q) THEN 10 ELSE 0 END + {_TIER} AS score FROM p) SELECT q, street_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, address_count DESC, street_id) AS int) AS place FROM r QUALIFY place <= 10"),
    "precomputed_short_queries": (lambda s, d: search.precomputed(_streets(s, d), _entries(s, d), threshold=THRESHOLD), None),
    "short_query_universe": (lambda s, d: search.short_queries(s).where(is_short(F.col("q"))), "SELECT chr(CAST(97 + i AS int)) AS q FROM range(26) t(i) UNION ALL SELECT CAST(i AS varchar) FROM range(10) t(i) UNION ALL SELECT chr(CAST(97 + i AS int)) || chr(CAST(97 + j AS int)) FROM range(26) t(i), range(26) u(j) UNION ALL SELECT lpad(CAST(i AS varchar), 2, '0') FROM range(100) t(i) UNION ALL SELECT i || ' ' || chr(CAST(97 + j AS int)) FROM range(10) t(i), range(26) u(j) UNION ALL SELECT lpad(CAST(i AS varchar), 2, '0') || ' ' || chr(CAST(97 + j AS int)) FROM range(100) t(i), range(26) u(j)"),
    "normalised_queries": (lambda s, d: _queries_of(s, d).select("raw", normalise(F.col("raw")).alias("q")), f"SELECT raw, lower(regexp_replace(regexp_replace(trim(raw), '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS q FROM ({_FORMAT})"),
    "query_tokens": (lambda s, d: _queries_of(s, d).select("raw", F.array_join(token_column(F.col("raw")), "|").alias("tokens")), f"SELECT raw, array_to_string(list_filter(list_transform(regexp_split_to_array(upper(raw), '[-\\s,/]+'), lambda x: regexp_replace(x, '[^A-Za-z0-9_]', '', 'g')), lambda x: x <> ''), '|') AS tokens FROM ({_FORMAT})"),
    "capped_numbers": (lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", C.capped(F.col("o_orderkey").cast("int")).alias("capped")), "SELECT o_orderkey, CAST(CASE WHEN o_orderkey > 999 THEN left(CAST(o_orderkey AS varchar), 3) ELSE CAST(o_orderkey AS varchar) END AS int) AS capped FROM orders"),
    "imported_localities": (imported_localities, f"WITH {LOCALITIES_CTE} SELECT * FROM localities"),
    "imported_addresses": (imported_addresses, f"WITH {WIDE_CTE} SELECT {', '.join(WIDE)} FROM wide"),
    "address_response": (_responses, f"WITH {WIDE_CTE} {_RESPONSE_SQL}"),
    "parcel_lookup": (_parcel, f"WITH {A} SELECT gnaf_pid FROM a WHERE legal_parcel_id = (SELECT min(legal_parcel_id) FROM a WHERE legal_parcel_id <> '')"),
    "address_by_id": (lambda s, d: (lambda rows: lookup.address_by_pid(rows, rows.agg(F.min("gnaf_pid")).first()[0].lower()).select("gnaf_pid", "number_first", "flat_number"))(sample_addresses(s, d)), f"WITH {A} SELECT gnaf_pid, number_first, flat_number FROM a WHERE gnaf_pid = (SELECT min(gnaf_pid) FROM a) ORDER BY number_first NULLS FIRST, flat_number NULLS FIRST LIMIT 1"),
    "street_by_id": (lambda s, d: lookup.street_by_id(_streets(s, d), 7).select("street_id", "street_key", "display"), f"WITH {S} SELECT street_id, street_key, display FROM s WHERE street_id = 7"),
    "street_drilldown": (_drill_down(THRESHOLD, None), f"WITH {E} SELECT gnaf_pid AS p, {_SLA} AS s FROM e JOIN s USING (street_key) WHERE street_id = {_LARGEST}"),
    "street_drilldown_digit": (_drill_down(2, "1"), f"WITH {E}, n AS (SELECT *, count(*) OVER (PARTITION BY street_key) AS entries FROM e) SELECT gnaf_pid AS p, {_SLA} AS s FROM n JOIN s USING (street_key) WHERE street_id = {_LARGEST} AND (entries <= 2 OR number_first IS NULL OR starts_with(CAST(number_first AS varchar), '1'))"),
    "digit_maps": (lambda s, d: streets.digit_maps(_entries(s, d), THRESHOLD).select("street_key", F.to_json("digit_shards").alias("digit_shards")), f"WITH {D}, f AS (SELECT DISTINCT street_key, digit, left(md5(street_key || '|' || digit), 3) AS prefix FROM d WHERE digit IS NOT NULL) SELECT street_key, '{{' || string_agg('\"' || digit || '\":\"' || prefix || '\"', ',' ORDER BY digit) || '}}' AS digit_shards FROM f GROUP BY 1"),
    "street_files": (lambda s, d: streets.street_files(_entries(s, d), THRESHOLD).select("prefix", F.array_join("keys", ";").alias("keys")), f"WITH {D}, k AS (SELECT DISTINCT street_key || coalesce('|' || digit, '') AS key FROM d) SELECT left(md5(key), 3) AS prefix, string_agg(key, ';' ORDER BY key) AS keys FROM k GROUP BY 1"),
    "collected_entries": (lambda s, d: streets.collected_entries(_entries(s, d)).select("street_key", F.array_join("entries.p", ",").alias("pids"), F.size("entries").alias("n")), f"WITH {E} SELECT street_key, string_agg(gnaf_pid, ',' ORDER BY gnaf_pid) AS pids, CAST(count(*) AS int) AS n FROM e GROUP BY 1"),
    "shard_records": (lambda s, d: lookup.shard_records(imported_addresses(s, d)).select("prefix", F.size("records").alias("n"), F.array_join(F.array_sort(F.map_keys("records")), ",").alias("pids")), f"WITH {WIDE_CTE} SELECT left(md5(gnaf_pid), 3) AS prefix, CAST(count(DISTINCT gnaf_pid) AS int) AS n, string_agg(DISTINCT gnaf_pid, ',' ORDER BY gnaf_pid) AS pids FROM wide GROUP BY 1"),
    "overlay_with_hole": (_hole, f"WITH {A}, p AS (SELECT gnaf_pid, {_TX} - floor({_TX}) AS fx, {_TY} - floor({_TY}) AS fy FROM a) SELECT gnaf_pid, 'land' AS layer, CAST(count(*) AS int) AS n, string_agg(shown, ';' ORDER BY shown) AS features FROM (SELECT gnaf_pid, '{{\"name\":\"ring\"}}' AS shown FROM p WHERE fx BETWEEN 0.1 AND 0.9 AND fy BETWEEN 0.1 AND 0.9 AND NOT (fx BETWEEN 0.4 AND 0.6 AND fy BETWEEN 0.4 AND 0.6) UNION ALL SELECT gnaf_pid, '{{\"name\":\"two\"}}' FROM p WHERE (fx BETWEEN 0.0 AND 0.2 OR fx BETWEEN 0.7 AND 0.9) AND fy BETWEEN 0.3 AND 0.8) GROUP BY 1"),
    "shard_prefix_part": (lambda s, d: (lambda rows: rows.where(F.col("shard").startswith("a")).groupBy("shard").agg(F.count(F.lit(1)).alias("n")))(sample_addresses(s, d).select(C.shard(F.col("gnaf_pid")).alias("shard"))), f"WITH {A} SELECT left(md5(gnaf_pid), 3) AS shard, count(*) AS n FROM a WHERE left(md5(gnaf_pid), 1) = 'a' GROUP BY 1"),
    "import_counts": (lambda s, d: imported_addresses(s, d).agg(F.count(F.lit(1)).alias("addresses"), F.count_distinct(C.shard(F.col("gnaf_pid"))).alias("shards"), F.count_distinct(F.when(F.col("legal_parcel_id") != "", C.shard(F.col("legal_parcel_id")))).alias("parcel_shards")), f"WITH {WIDE_CTE} SELECT count(*) AS addresses, count(DISTINCT left(md5(gnaf_pid), 3)) AS shards, count(DISTINCT CASE WHEN legal_parcel_id <> '' THEN left(md5(legal_parcel_id), 3) END) AS parcel_shards FROM wide"),
    "shard_names": (lambda s, d: s.range(4096).select(F.lpad(F.lower(F.hex("id")), 3, "0").alias("prefix")), "SELECT lpad(lower(to_hex(i)), 3, '0') AS prefix FROM range(4096) t(i)"),
    "street_insert_rows": (lambda s, d: street_values(_script_rows(s, d)), f"WITH {S} SELECT street_id AS id, '(' || concat_ws(',', CAST(street_id AS varchar), {_quoted('display')}, {_quoted('display_search')}, {_quoted('street_key')}, {_quoted('shard_prefix')}, {_quoted('street_name')}, {_quoted('street_type_abbrev')}, coalesce({_quoted('street_suffix_code')}, 'NULL'), {_quoted('locality_name')}, {_quoted('state')}, coalesce({_quoted('postcode')}, 'NULL'), CAST(address_count AS varchar), 'NULL', " + ", ".join(f"coalesce(CAST({c} AS varchar), 'NULL')" for c in ("num_min", "num_max", "flat_min", "flat_max")) + ") || ')' AS row FROM s"),
    "tile_coordinates": (lambda s, d: sample_addresses(s, d).select("gnaf_pid", *[c.alias(n) for c, n in zip(C.tile(F.col("latitude"), F.col("longitude"), 6)[:2], ("x", "y"))]), f"WITH {A} SELECT gnaf_pid, CAST(floor({_TX}) AS int) AS x, CAST(floor({_TY}) AS int) AS y FROM a"),
    "polygon_overlay": (_overlay, f"WITH {A}, p AS (SELECT gnaf_pid, {_TX} AS tx, {_TY} AS ty FROM a) SELECT gnaf_pid, CAST(floor(tx) AS int) AS x, CAST(floor(ty) AS int) AS y, 'square' AS layer FROM p WHERE tx - floor(tx) BETWEEN 0.1 AND 0.9 AND ty - floor(ty) BETWEEN 0.1 AND 0.9"),
}
