"""Session settings that the address operators rely on."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

#: Malformed rows are dropped only if all columns are parsed; duplicate map keys keep the last value.
SETTINGS = {"spark.sql.csv.parser.columnPruning.enabled": "false", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.session.timeZone": "UTC"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(name: str = "larkspur", **conf: str) -> SparkSession:
    """A session with SETTINGS."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share, removed when the application ends.

    Where that is unset, as in tests, one of our own if driver and executors are one process; else an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    path = f"{base.rstrip('/')}/larkspur/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
