"""Streets: the aggregate over addresses, ids, entries and their split by leading digit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import display_prefix, search_display, shard, street_display, street_key

KEYS = ["street_name", "street_type_abbrev", "street_suffix_code", "locality_name", "state", "postcode"]


def streets(addresses: DataFrame) -> DataFrame:
    """One row per street of principal addresses, with counts, number ranges, texts and the file of its entries."""
    rows = addresses.where("alias_principal = 'P'").groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("address_count"),
        F.min("number_first").alias("num_min"),
        F.max(F.greatest("number_first", "number_last")).alias("num_max"),
        F.min(F.least("flat_number", "level_number")).alias("flat_min"),
        F.max(F.greatest("flat_number", "level_number")).alias("flat_max"),
        F.min("street_type_code").alias("street_type_code"),
        F.min("street_suffix_name").alias("street_suffix_name"),
    )
    return rows.withColumns({"street_key": street_key(), "display": street_display(), "display_search": search_display()}).withColumn("shard_prefix", shard(F.col("street_key")))


def with_ids(rows: DataFrame) -> DataFrame:
    """Streets numbered from 1 in the order of state, locality, name and the rest of their key.

    The number is the place within a state and locality plus what all smaller ones hold, so no task sorts every street.
    """
    order = [F.col(c).asc_nulls_last() for c in ("street_name", "street_type_abbrev", "street_suffix_code", "postcode")]
    place = ["state", "locality_name"]
    before = Window.orderBy(*[F.col(c).asc_nulls_last() for c in place]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).select(*place, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*place).orderBy(*order)))
    same = F.col("state").eqNullSafe(F.col("_state")) & F.col("locality_name").eqNullSafe(F.col("_locality"))
    sizes = sizes.select(F.col("state").alias("_state"), F.col("locality_name").alias("_locality"), "_base")
    return inside.join(sizes, same).drop("_state", "_locality").withColumn("street_id", (F.col("_base") + F.col("_at")).cast("long")).drop("_base", "_at")


def entries(addresses: DataFrame) -> DataFrame:
    """What street search keeps of each principal address."""
    rows = addresses.where("alias_principal = 'P'").withColumns({"street_key": street_key(), "display_prefix": display_prefix()})
    return rows.select("gnaf_pid", "street_key", "display_prefix", "number_first", "number_last", "flat_number", "level_number")


def with_digits(rows: DataFrame, threshold: int = 100) -> DataFrame:
    """Entries with the leading digit of their number on streets with more than `threshold` of them, else null."""
    counts = rows.groupBy("street_key").agg(F.count(F.lit(1)).alias("_n"))
    many = rows.join(counts, "street_key")
    return many.withColumn("digit", F.when(F.col("_n") > threshold, F.left(F.col("number_first").cast("string"), F.lit(1)))).drop("_n")


def digit_files(rows: DataFrame, threshold: int = 100) -> DataFrame:
    """(street_key, digit, prefix, entries) of each part of a split street."""
    split = with_digits(rows, threshold).where("digit is not null")
    counted = split.groupBy("street_key", "digit").agg(F.count(F.lit(1)).alias("entries"))
    return counted.withColumn("prefix", shard(F.concat_ws("|", "street_key", "digit")))


def digit_maps(rows: DataFrame, threshold: int = 100) -> DataFrame:
    """(street_key, digit_shards): for each split street the file of each digit, as a map."""
    parts = digit_files(rows, threshold)
    return parts.groupBy("street_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("digit", "prefix")))).alias("digit_shards"))


def street_files(rows: DataFrame, threshold: int = 100) -> DataFrame:
    """(prefix, keys): the keys (street, or street and digit) that each file of entries holds, in order."""
    key = F.concat_ws("|", "street_key", "digit")  # a null digit is left out
    named = with_digits(rows, threshold).select(key.alias("key")).distinct()
    return named.groupBy(shard(F.col("key")).alias("prefix")).agg(F.array_sort(F.collect_list("key")).alias("keys"))


def collected_entries(rows: DataFrame) -> DataFrame:
    """(street_key, entries): the entries of each street, those of a principal address, as one array.

    A street's addresses are bounded by what a street can hold; longer ones are split by digit first.
    """
    fields = F.struct(F.col("gnaf_pid").alias("p"), F.col("display_prefix").alias("d"), F.col("number_first").alias("n"), F.col("number_last").alias("n2"), F.col("flat_number").alias("f"), F.col("level_number").alias("l"))
    return rows.groupBy("street_key").agg(F.array_sort(F.collect_list(fields)).alias("entries"))


def visible(rows: DataFrame, street: int | None, flat: int | None, threshold: int = 100) -> DataFrame:
    """The entries that a search looks at: on split streets the hinted digit; with a flat hint all; else the smallest digit.

    Entries without a number are looked at unless a street number is hinted. This limits results by design.
    """
    dealt = with_digits(rows, threshold)
    if flat is not None and street is None:
        return dealt
    if street is not None:
        low = dealt.groupBy("street_key").agg(F.max(F.col("digit").isNotNull()).alias("_split"))
        return dealt.join(low, "street_key").where(~F.col("_split") | (F.col("digit") == str(street)[0])).drop("_split")
    least = dealt.groupBy("street_key").agg(F.min("digit").alias("_least"))
    return dealt.join(least, "street_key").where("digit is null or digit = _least").drop("_least")
