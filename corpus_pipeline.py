"""From documents to packed training sequences: five stages, each the operator of the same name over all rows it gets.

Rows are told apart by doc_id and a hash of their text, so a text goes only for what it holds itself, also where an id is
missing or repeated. Rows that repeat both id and text share every decision. Empty tables give empty tables, extra columns
are carried along whatever their names, and null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.decontamination import contamination
from larkspur.llm.exact_dedup import exact_duplicates
from larkspur.llm.ngram_join import near_duplicates
from larkspur.llm.packing import pack
from larkspur.llm.shared import materialize, release, whole
from larkspur.llm.toxicity import keep_clean


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, fit) isn't in dropped, with the columns of docs; a missing id equals itself."""
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    gone = materialize(dropped.select(F.col("doc_id").alias(f"{mark}id"), F.col("fit").alias(f"{mark}fit")).distinct(), "dropped")
    rows = docs.withColumn(f"{mark}own", F.xxhash64(whole()))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col(f"{mark}id")) & (F.col(f"{mark}own") == F.col(f"{mark}fit")), "left_anti").drop(f"{mark}own")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go; it learns from the labels of the other four folds.

    Null and empty texts stay; without labels everything does. Equal texts share a score, so ties stay or go together.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; null and empty texts are one group.

    A row without an id stays only if all its group are without. Rows that repeat both id and text share its decision.
    """
    found = exact_duplicates(docs.select("doc_id", "text"), carry_fit=True)
    return _without(docs, found.where(~F.col("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of a similarity of 0.8 connect, the one with the smallest doc_id stays, and of texts that
    repeat that id the one with the smallest hash. Null, empty and blank texts are linked with nothing and stay."""
    return _without(docs, near_duplicates(docs).where(~F.col("stays")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go.

    Null texts and texts without words stay; so does everything if the benchmark is empty.
    """
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where(F.size("hits") > 0))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of at most 1024 tokens; null and empty texts are one end id each."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing)]

#: SQL can't express these stages; the tests compare them, and run(), with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, before = materialize(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
