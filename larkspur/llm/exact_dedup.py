"""Exact duplicates by deterministic block naming (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, release, whole

#: Bytes of a block. Documents shorter than one block are one block.
BLOCK = 4096
KEY = ["doc_id", "text_hash"]


def _named(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Integer names for the distinct `parts` that occur more than once: their place in the sorted order of their partition.

    Sorting stays within hash partitions, as sampling whole blocks for ranges would send them to the driver. Counting comes before sorting, with partial sums, so a part that a third of all rows hold is sent once a task. A part
    that occurs once gets no name: its document differs from every other one already.
    """
    repeated = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return materialize(repeated.sortWithinPartitions(*parts).select(*parts, F.monotonically_increasing_id().alias("name")), "block-names")


def block_names(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, name) of documents whose every block, pair of blocks, ... and whole text occurs again.

    Two documents have the same name if and only if their texts are identical: blocks are compared as bytes, pairs as the
    integers of their halves. text_hash tells apart rows that repeat a doc_id with another text. Rounds: log2 of the
    longest document's blocks; each handles only documents all of whose parts are repeated so far.
    """
    raw = whole(text_col).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), F.sha2(raw, 256).alias("text_hash"), raw.alias("raw"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("raw") / F.lit(block)).cast("int"), F.lit(1)) - 1)
    blocks = base.select("doc_id", F.unhex("text_hash").alias("text_hash"), F.size(starts).alias("n"), F.posexplode(F.transform(starts, lambda i: F.substring("raw", i * block + 1, F.lit(block)))).alias("pos", "part"))
    names = _named(blocks, ["part"])
    level = _complete(blocks.join(names, "part").select(*KEY, "n", "pos", "name"))
    release(names)
    while (level.agg(F.max("n")).first()[0] or 0) > 1:
        half = (F.col("pos") / 2).cast("int")
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy(*KEY, ((F.col("n") + 1) / 2).cast("int").alias("n"), half.alias("pos")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        names = _named(pairs, ["a", "b"])
        above = _complete(pairs.join(names, ["a", "b"]).select(*KEY, "n", "pos", "name"))
        release(level, names)
        level = above
    return level.select(*KEY, "name").distinct()


def _complete(rows: DataFrame) -> DataFrame:
    """Rows of those documents that have a name for each of their n parts."""
    rows = materialize(rows, "block-level")
    full = rows.groupBy(*KEY, "n").agg(F.count_distinct("pos").alias("have")).where("have = n").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    out = materialize(rows.join(full, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi"), "block-full")
    release(rows)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, carry_fit: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (and with carry_fit: fit, the text's xxhash64).

    Null text counts as empty; empty texts are one group. Of a group the largest doc_id stays (a null id never beats one
    that is not null). Rows that repeat both id and text count in group_size and share one decision. An empty table gives
    no rows; extra columns are ignored.
    """
    names = materialize(block_names(docs, block, id_col, text_col).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "name"), "names")
    fit = ["fit"] if carry_fit else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(whole(text_col).cast("binary"), 256).alias("text_sha256"), F.xxhash64(whole(text_col)).alias("fit")).select("doc_id", "text_sha256", *fit)
    tagged = materialize(rows.join(names, F.col("doc_id").eqNullSafe(F.col("d")) & (F.unhex("text_sha256") == F.col("h")), "left").select("doc_id", "text_sha256", "name", *fit), "tagged")
    groups = materialize(tagged.where("name is not null").groupBy("name").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("size")), "groups")
    release(names)
    out = tagged.join(groups, "name", "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", *fit)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
