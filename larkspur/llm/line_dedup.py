"""Repeated lines and passages across documents, by digests of their units grouped globally."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import bounded_batches, materialize, release, whole

#: Normalised bytes that consecutive repeated units must have together to go. Shorter ones repeat by chance.
LEAST_BYTES = 130
#: A unit is a line or a sentence of it, as repeated passages needn't fill lines: it ends before a line break or after sentence marks.
_UNIT = re.compile(r"[^\s.!?。！？][^\n.!?。！？]*[.!?。！？]*")


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fit, at, start, end, size, h1, h2) of each unit: its place among the document's, its characters there, and its digest.

    A unit is normalised (lower case, runs of white space as one space) and known by a digest of 128 bits in two halves;
    size is its normalised bytes. fit tells apart texts that repeat an id.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for doc, fit, text in zip(batch.column("id").to_pylist(), batch.column("fit").to_pylist(), batch.column("text").to_pylist()):
                for at, m in enumerate(_UNIT.finditer(text)):
                    unit = " ".join(m[0].lower().split()).encode("utf-8", "replace")
                    for column, value in zip(columns, (doc, fit, at, m.start(), m.end(), len(unit), hashlib.blake2b(unit, digest_size=16).digest())):
                        column.append(value)
                    if len(columns[0]) >= 50_000:
                        yield _batch(columns)
                        columns = [[] for _ in range(7)]
            yield _batch(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text")).select("id", F.xxhash64("text").alias("fit"), "text")
    return rows.mapInArrow(run, "id long, fit long, at int, start long, end long, size int, h1 long, h2 long")


def _batch(columns: list[list]) -> pa.RecordBatch:
    ids, fits, at, starts, ends, sizes, digests = columns
    halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fits, pa.int64()), pa.array(at, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(sizes, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["id", "fit", "at", "start", "end", "size", "h1", "h2"])


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fit, at, start, end, size) of units whose digest has an earlier place, once for rows that repeat id and text.

    Places are ordered by id (none last), then hash of the text, then position, so one place of each digest stays. Digests
    are counted with partial sums before they are shuffled, so a line that a third of all documents hold is one row a task;
    the join back is a plain one of two written tables, whose hot digests adaptive execution splits, as the window over
    documents comes after an exchange of its own. Units are written once and read twice.
    """
    rows = materialize(units(docs, id_col, text_col), "units")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "fit", "at")
    first = materialize(rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "digests")
    out = materialize(rows.join(first.hint("merge"), ["h1", "h2"]).where(place != F.col("first")).select("id", "fit", "at", "start", "end", "size").distinct(), "repeated")
    release(rows, first)
    return out


def line_duplicates(docs: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_removed, removed_chars, spans) for every row of docs.

    spans: array of (start, end) of the removed passages in characters of the original text, in order. A passage is a run of
    consecutive units of which each has an earlier place, if they have at least least_bytes of normalised text together.

    Null and empty texts have none; an empty table gives no rows; extra columns are ignored; long texts are streamed unit by
    unit. A null id ranks last. Rows that repeat an id are texts of their own, those that repeat the text too share its spans.
    """
    found = repeated_units(docs, id_col, text_col)
    inside = Window.partitionBy("id", "fit").orderBy("at")
    runs = found.withColumn("run", F.col("at") - F.row_number().over(inside)).groupBy("id", "fit", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("size").alias("size")).where(F.col("size") >= least_bytes)
    gone = materialize(runs.groupBy("id", "fit").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")).select(F.col("id").alias("i"), F.col("fit").alias("f"), "spans"), "spans")
    release(found)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(whole(text_col)).cast("long").alias("n_chars"), F.xxhash64(whole(text_col)).alias("fit"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("fit") == F.col("f")), "left").select("doc_id", "n_chars", F.size(spans).cast("long").alias("n_removed"), F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("removed_chars"), spans.alias("spans"))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans."""
    at, out = 0, []
    for a, b in sorted(spans):
        out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines and passages of all documents."""
    return line_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
