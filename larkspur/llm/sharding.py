"""Minimax contiguous partition of documents into shards (native)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import gapless_rank, materialize, whole

#: Equal texts fall into one of so many atoms; their sizes are all that the driver gets (bounded, whatever the input).
ATOMS = 1 << 16


def smallest_capacity(sizes: list[int] | np.ndarray, shards: int) -> int:
    """The smallest capacity at which a greedy pass over the ordered sizes needs at most `shards` runs."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    total = int(ends[-1])
    low, high = max(int(np.max(sizes, initial=0)), -(-total // shards)), total
    while low < high:
        middle = (low + high) // 2
        if _runs(ends, middle, shards) is not None:
            high = middle
        else:
            low = middle + 1
    return low


def _runs(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts (the end of each run) at this capacity; None if more than `shards` runs are needed."""
    cuts, at = [], 0
    while at < len(ends) - 1:
        if len(cuts) == shards:
            return None
        at = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        cuts.append(at)
    return cuts


def assign(sizes: list[int] | np.ndarray, shards: int) -> np.ndarray:
    """A shard for each of the ordered atomic sizes.

    An atom at least as large as an even share of what is left gets a shard of its own and moves to the front of the
    order; the rest is cut contiguously at the smallest feasible capacity. So one hot group doesn't leave others empty.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    out, left, alone = np.full(len(sizes), -1, dtype=np.int32), int(sizes.sum()), 0
    for i in np.argsort(-sizes, kind="stable"):
        if alone < shards - 1 and int(sizes[i]) * (shards - alone) >= left and sizes[i]:
            out[i], left, alone = alone, left - int(sizes[i]), alone + 1
        else:
            break
    rest = np.flatnonzero(out < 0)
    if len(rest):
        ends = np.concatenate([[0], np.cumsum(sizes[rest])])
        capacity = smallest_capacity(sizes[rest], shards - alone)
        cuts = _runs(ends, capacity, shards - alone)
        out[rest] = alone + np.searchsorted(cuts, np.arange(len(rest)), side="right")
    return out


def shard_documents(docs: DataFrame, shards: int = 8, atoms: int = ATOMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its size (UTF-8 bytes + 1), crc32, shard and slot; equal texts share a shard.

    Nulls: a null text counts as empty (size 1); a null id is a row like others. Repeated rows each get a slot. An empty
    table gives no rows. Extra columns are ignored, whatever their names. The text is read once; what is shuffled is 30
    bytes a row. Long texts cost their bytes only.
    """
    spark = docs.sparkSession
    text = whole(text_col)
    slim = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(atoms)).cast("int").alias("atom"),
        ),
        "shard-sizes",
    )
    found = slim.groupBy("atom").agg(F.sum("size").alias("bytes")).orderBy("atom").collect()
    to = assign([r["bytes"] for r in found], shards)
    schema = "atom int, shard int"
    mapped = spark.createDataFrame([(r["atom"], int(s)) for r, s in zip(found, to)], schema)
    placed = slim.join(F.broadcast(mapped), "atom")
    return gapless_rank(placed, ["shard", "atom"], ["doc_id", "text_crc32", "size"], ["doc_id", "text_crc32"], "slot", ["shard"]).select("doc_id", "size", "text_crc32", "shard", "slot")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law `bytes`."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
