"""Pipe-separated address tables: file choice by state, reading, and writing of lookups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

STATES = ("ACT", "NSW", "NT", "OT", "QLD", "SA", "TAS", "VIC", "WA")


def chosen_states(value: str | None) -> list[str]:
    """States of a comma-separated setting, trimmed and in upper case; all of them if it is empty."""
    named = [s.strip().upper() for s in (value or "").split(",") if s.strip()]
    return named or list(STATES)


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all files below a folder, by Hadoop's listing, so any store works."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found, files = [], path.getFileSystem(conf).listFiles(path, True)
    while files.hasNext():
        found.append(files.next().getPath().toString())
    return sorted(found)


def state_files(files: list[str], table: str, states: list[str]) -> list[str]:
    """Files named {state}_{table}_psv.psv, in any case, for the states."""
    names = {f"{s}_{table}_psv.psv".lower() for s in states}
    return [f for f in files if f.rsplit("/", 1)[-1].lower() in names]


def authority_files(files: list[str], table: str) -> list[str]:
    """Files named authority_code_{table}_psv.psv, in any case."""
    return [f for f in files if f.rsplit("/", 1)[-1].lower() == f"authority_code_{table}_psv.psv".lower()]


def national_files(files: list[str], table: str) -> list[str]:
    """Files of any prefix whose name holds _{table}_psv and ends in .psv."""
    return [f for f in files if re.search(rf"_{re.escape(table)}_psv.*\.psv$", f.rsplit("/", 1)[-1], re.I)]


def read_psv(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """All rows of the files, all columns strings, empty fields null; rows with a wrong number of fields are dropped.

    None if there is no file. Files of a table share their header.
    """
    if not paths:
        return None
    header = spark.read.option("sep", "|").option("header", True).csv(paths[0]).columns
    schema = StructType([StructField(c.lower(), StringType()) for c in header])
    return spark.read.schema(schema).option("sep", "|").option("header", True).option("enforceSchema", True).option("columnPruning", False).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(paths)


def write_shards(df: DataFrame, shard: str, path: str, form: str = "parquet") -> None:
    """One folder a shard value, its rows together: one shuffle, and readers of a shard prune the rest."""
    df.repartition(F.col(shard)).write.mode("overwrite").partitionBy(shard).format(form).save(path)


def read_shard(spark: SparkSession, path: str, shard: str, value: str) -> DataFrame:
    """The rows of one shard; none if it doesn't exist."""
    return spark.read.parquet(path).where(F.col(shard) == value)


def publish(spark: SparkSession, metadata: dict[str, str], folder: str) -> None:
    """Metadata beside the data and then the pointer to the version, last, so readers never see a half-written one."""
    row = spark.createDataFrame([tuple(metadata.values())], ", ".join(f"{k} string" for k in metadata))
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/{metadata['version']}/metadata")
    row.select("version").coalesce(1).write.mode("overwrite").json(f"{folder}/latest")


def latest_version(spark: SparkSession, folder: str, fixed: str | None = None) -> str:
    """The fixed version, or the one the pointer names."""
    return fixed or spark.read.json(f"{folder}/latest").first()["version"]


def newest_archive(resources: DataFrame, datum: str) -> DataFrame:
    """The active ZIP resource whose name holds the datum, in any case, that was modified (or else created) last; no row if there is none."""
    when = F.coalesce(F.try_to_timestamp("last_modified"), F.try_to_timestamp("created"))
    fit = resources.where((F.col("format") == "ZIP") & (F.col("state") == "active") & F.contains(F.upper("name"), F.lit(datum.upper())))
    return fit.orderBy(when.desc_nulls_last(), "name").limit(1)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists and, if it is a folder, holds anything: work that has been done is not done again."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(where) and (fs.getFileStatus(where).isFile() or len(fs.listStatus(where)) > 0)


def version_of(date: str, datum: str) -> str:
    """vYYYYMMDD-datum of an ISO date."""
    return f"v{date[:10].replace('-', '')}-{datum.lower()}"


def merged_counts(partial: DataFrame) -> DataFrame:
    """Counts of a run that was split by shard prefix: shards add up; the total of addresses is the same in each part."""
    return partial.agg(F.max("totalAddresses").alias("totalAddresses"), F.sum("totalShards").alias("totalShards"), F.sum("totalLotDpShards").alias("totalLotDpShards"))


def with_prefix(df: DataFrame, shard: str, prefix: str | None) -> DataFrame:
    """The rows whose shard begins with the prefix; all without one."""
    return df.where(F.col(shard).startswith(prefix)) if prefix else df


def write_answers(answers: DataFrame, path: str) -> None:
    """Answers of short queries, one folder a query, with the marker of a whole write that readers ask for."""
    answers.repartition("q").sortWithinPartitions("q", "kind", "place").write.mode("overwrite").partitionBy("q").parquet(path)


def read_answer(spark: SparkSession, path: str, q: str) -> DataFrame | None:
    """The answers of one query, whose folder alone is read; None until the write is whole."""
    return spark.read.parquet(path).where(F.col("q") == q) if exists(spark, f"{path}/_SUCCESS") else None


#: Columns of the table of streets in SQL scripts, with their types.
STREET_COLUMNS = {"id": "INTEGER PRIMARY KEY", "display": "TEXT NOT NULL", "display_search": "TEXT NOT NULL", "street_key": "TEXT NOT NULL", "shard_prefix": "TEXT NOT NULL", "street_name": "TEXT NOT NULL", "street_type": "TEXT", "street_suffix": "TEXT", "locality_name": "TEXT NOT NULL", "state": "TEXT NOT NULL", "postcode": "TEXT", "address_count": "INTEGER NOT NULL", "digit_shards": "TEXT", "num_min": "INTEGER", "num_max": "INTEGER", "flat_min": "INTEGER", "flat_max": "INTEGER"}


def street_values(streets: DataFrame) -> DataFrame:
    """(id, row): each street as a row of an INSERT statement; quotes are doubled, and empty optional texts are NULL."""

    def literal(name: str, kind: str) -> Column:
        if kind.startswith("INTEGER"):
            return F.coalesce(F.col(name).cast("string"), F.lit("NULL"))
        quote = F.lit(chr(39))
        quoted = F.concat(quote, F.replace(F.col(name).cast("string"), quote, F.lit(2 * chr(39))), quote)
        return quoted if "NOT NULL" in kind else F.when(F.coalesce(name, F.lit("")) == "", "NULL").otherwise(quoted)

    return streets.select("id", F.concat(F.lit("("), F.concat_ws(",", *[literal(n, k) for n, k in STREET_COLUMNS.items()]), F.lit(")")).alias("row"))


def sql_script(streets: DataFrame, batch: int = 200) -> DataFrame:
    """(statement, value): the statements of a script that builds the table of streets, in order; `batch` rows to an INSERT.

    Ids are gapless from 1, so batches are cut by them and no task sees all streets.
    """
    spark, names = streets.sparkSession, ",".join(STREET_COLUMNS)
    head = ["DROP TABLE IF EXISTS streets;", "CREATE TABLE streets (" + ", ".join(f"{n} {k}" for n, k in STREET_COLUMNS.items()) + ");"]
    rows = street_values(streets).groupBy(F.floor((F.col("id") - 1) / batch).alias("k")).agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("rows"))
    inserts = rows.select((F.col("k") + len(head)).alias("statement"), F.concat(F.lit(f"INSERT INTO streets ({names}) VALUES "), F.array_join(F.col("rows.row"), ","), F.lit(";")).alias("value"))
    ends = spark.createDataFrame([(i, x) for i, x in enumerate(head)] + [((1 << 62), "CREATE INDEX idx_streets_name ON streets (street_name);")], "statement long, value string")
    return ends.unionByName(inserts)
