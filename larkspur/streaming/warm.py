"""Short queries answered in advance by a stream that can stop and go on: each trigger takes the next file of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_queue(queries: DataFrame, path: str, batch: int = 60) -> None:
    """The queries as files of about `batch` rows for answer_stream()."""
    parts = max(1, -(-queries.count() // batch))
    queries.select("q").repartitionByRange(parts, "q").write.mode("overwrite").parquet(path)


def answer_stream(spark: SparkSession, queue: str, answers: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files: int = 1) -> StreamingQuery:
    """A stream over the queue that appends answers(queries) to `target`, `files` files of queries a trigger, until none is left.

    The checkpoint holds which files are done, so a run that was stopped goes on where it was. Each batch overwrites its own
    folder, so one that is run again after a failure leaves no row twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        answers(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    rows = spark.readStream.schema("q string").option("maxFilesPerTrigger", files).parquet(queue)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
