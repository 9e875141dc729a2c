"""Helpers that several text operators need: written tables in the shared folder, and gapless ranks without a global sort."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"  # driver and executors are one process here
    return f"{base.rstrip('/')}/larkspur/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_larkspur_path", None):
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def whole(text: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one sum a task reaches the driver."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0)


#: Bytes of texts that one Arrow batch holds at most, beside its last row.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends texts to Python in batches of at most BATCH_BYTES; a bound on memory, no result depends on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, "67108864b").rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Free memory of this Python worker goes back to the system, where its C library can do that; an idle worker would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_MEMORIES: dict[str, dict] = {}


def memory_of(name: str) -> dict:
    """What the tasks of one operator keep for later ones in this Python worker; tasks of others empty it, see frugal()."""
    return _MEMORIES.setdefault(name, {})


def forget_others(keeps: str) -> None:
    """Empty what other operators than `keeps` kept in this Python worker."""
    others = [kept for name, kept in _MEMORIES.items() if name != keeps and kept]
    for kept in others:
        kept.clear()
    if others:
        gc.collect()


def frugal(run: Callable, keeps: str = "") -> Callable:
    """A function for mapInArrow that gives back memory when its task ends, and what other operators than `keeps` kept when it begins.

    The inner function is sent by value, with copies of the globals it names: so it names functions of this module only.
    """

    def task(batches: Iterator) -> Iterator:
        forget_others(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def frugal_group(run: Callable) -> Callable:
    """A function for applyInArrow that gives back memory after each group."""

    def group(table):  # noqa: ANN001, ANN202  (Spark reads the number of parameters only)
        try:
            return run(table)
        finally:
            give_back()

    return group


#: Bound on the ranges that gapless_rank() collects statistics for, above the number of classes.
RANK_CELLS = 1 << 14


def gapless_rank(df: DataFrame, classes: list[str], order: list[str], spread: list[str], name: str = "rank", offsets_by: list[str] | None = None) -> DataFrame:
    """df with a gapless rank from 0 in each class (offsets_by: the leading columns of classes that start anew; all by default).

    classes must have a bounded number of values (tens of thousands). A class with many rows is dealt into cells by a
    hash of `spread`, in proportion to its rows, so no task ranks more than about total / RANK_CELLS rows plus ties; only
    the counts of cells, at most len(classes) + RANK_CELLS rows, are added up by the driver and broadcast.
    """
    starts = offsets_by or classes
    counts = df.groupBy(*classes).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    target = max(1, -(-total // RANK_CELLS))
    parts = counts.select(*classes, F.ceil(F.col("_n") / F.lit(target)).cast("int").alias("_parts"))
    celled = df.join(F.broadcast(parts), classes).withColumn("_cell", F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int")).drop("_parts")
    cells = celled.groupBy(*classes, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    rows, before, last = [], 0, None
    for r in sorted(cells.collect()):
        start = tuple(r[c] for c in starts)
        before = before if start == last else 0
        rows.append((*r[:-1], before))
        before, last = before + r["_n"], start
    offsets = df.sparkSession.createDataFrame(rows, cells.drop("_n").withColumn("_base", F.lit(0).cast("long")).schema)
    inside = Window.partitionBy(*classes, "_cell").orderBy(*order)
    ranked = celled.withColumn("_at", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(offsets), [*classes, "_cell"]).withColumn(name, (F.col("_base") + F.col("_at")).cast("long")).drop("_cell", "_base", "_at")
