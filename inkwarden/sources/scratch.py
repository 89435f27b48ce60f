"""Folders that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; without that setting, a local session (tests) gets one of its own and any other is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(top or tempfile.mkdtemp(prefix='shared-')).rstrip('/')}/{uuid.uuid4().hex}"


def spread(rows: DataFrame, most_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """``rows`` over all cores if the optimiser takes them for at most ``most_bytes``; larger inputs have partitions enough and are not shuffled.

    The estimate comes from the plan's statistics, so that nothing runs for it.
    """
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= most_bytes else rows
