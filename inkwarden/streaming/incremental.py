"""Incremental scanning of arriving files with Structured Streaming.

A file is inspected when its content or the context (rules, policy) is new for
its path; the state of a path is the hash it was last inspected with and its
last status. The batch sink writes reports under the batch's number, so that a
batch that is run again replaces its own rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import VERSION
from ..operators.scan import scan_files
from ..plans import policy as pl
from ..sources.extract import MAX_BYTES as LONGEST

#: What one pass takes at most.
MAX_FILES, MAX_BYTES = 2000, 128 * 1024 * 1024
SEEN = "path string, sha256 string, decision string"


def context_hash(policy: dict = pl.POLICY, rules_version: str = VERSION) -> str:
    """Changes with whatever makes an earlier report stale."""
    return hashlib.sha256(json.dumps([policy, rules_version], sort_keys=True).encode()).hexdigest()


def arriving(spark: SparkSession, path: str, most_bytes: int = MAX_BYTES) -> DataFrame:
    """A stream of files, bounded for each trigger by number and bytes; one of those bounds at a time is Spark's, bytes here.

    Files over the size limit of a scan come without content and are reported as such.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    files = reader.option("maxBytesPerTrigger", most_bytes).load(path)
    return files.withColumn("content", F.when(F.col("length") <= LONGEST, F.col("content")))


def decisions(files: DataFrame, context: str) -> DataFrame:
    """path, sha256, decision: SCAN for new content or context, SKIP for what has been inspected."""
    return _decisions(files.select("path", F.sha2("content", 256).alias("sha256")), context, SEEN)


def _decisions(rows: DataFrame, context: str, schema: str) -> DataFrame:
    more = rows.columns[2:]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (None, None)
        out = []
        for b in batches:
            for sha, *rest in b[["sha256", *more]].itertuples(index=False, name=None):
                out.append((key[0], sha, "SKIP" if last == (sha, context) else "SCAN", *rest))
                last = (sha, context)
        state.update(last)
        yield pd.DataFrame(out, columns=["path", "sha256", "decision", *more])

    return rows.groupBy("path").applyInPandasWithState(run, schema, "sha256 string, context string", "append", GroupStateTimeout.NoTimeout)


def sink(reports_path: str, policy: dict = pl.POLICY):
    """A batch function that scans and writes under ``batch_id``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        named = batch.withColumn("filename", F.element_at(F.split("path", "/"), -1))
        scan_files(named, policy=policy).write.mode("overwrite").parquet(f"{reports_path}/batch_id={batch_id}")

    return write


def watch(spark: SparkSession, path: str, reports_path: str, checkpoint: str, policy: dict = pl.POLICY):
    """Scan what has arrived since the last run and stop; the checkpoint is the resumable queue."""
    stream = arriving(spark, path)
    return stream.writeStream.foreachBatch(sink(reports_path, policy)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decided_scan(files: DataFrame, reports_path: str, checkpoint: str, policy: dict = pl.POLICY):
    """Decisions on path and content by keyed state, with a report on each that is SCAN and none on those that are SKIP."""
    decided = _decisions(files.select("path", F.sha2("content", 256).alias("sha256"), "content"), context_hash(policy), SEEN + ", content binary")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read twice, and the state is to be asked once
        named = batch.withColumn("id", F.struct("path", "sha256", "decision")).withColumn("filename", F.lit("arrived.txt"))
        scanned = scan_files(named.filter("decision = 'SCAN'"), "id", policy=policy).drop("sha256").select("id.*", "*").drop("id")
        skipped = named.filter("decision = 'SKIP'").select("path", "sha256", "decision")
        scanned.unionByName(skipped, allowMissingColumns=True).write.mode("overwrite").parquet(f"{reports_path}/batch_id={batch_id}")
        batch.unpersist()

    return decided.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vanished(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Indexed paths that a complete listing hasn't got; run only after a complete cycle."""
    return index.join(listing.select("path"), "path", "left_anti")


def cycle(members: DataFrame, index: DataFrame) -> DataFrame:
    """One row: files, failed files, orphans of the index."""
    known = index.select("path", F.col("error").isNotNull().alias("_failed"), F.lit(True).alias("_indexed"))
    both = members.select("path", F.lit(True).alias("_member")).join(known, "path", "full")
    member = F.coalesce("_member", F.lit(False))
    return both.agg(F.count_if(member).alias("files"), F.count_if(member & F.coalesce("_failed", F.lit(False))).alias("failed_files"), F.count_if(~member).alias("orphans"))


def job_table(spark: SparkSession, query) -> DataFrame:
    """Progress of a streaming query as rows."""
    rows = [(p["batchId"], p["numInputRows"], p["timestamp"]) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch_id long, files long, started string")


#: Codes after which a file is not tried again until it changes.
PERMANENT = ("INPUT_SIZE_LIMIT", "UNSUPPORTED_FORMAT")


def to_retry(index: DataFrame, now: str, after_seconds: int = 3) -> DataFrame:
    """Failed paths (path, error, failed_at) whose turn has come: ``after_seconds`` on, and never for what stays as it is."""
    ripe = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("failed_at") >= after_seconds
    return index.filter(F.col("error").isNotNull() & ~F.col("error").isin(*PERMANENT) & ripe).select("path")


def job_status(passes: DataFrame) -> DataFrame:
    """The state of each job from its passes (job, cancelled, busy, failed, left): the first that applies."""
    state = F.when(F.max("cancelled"), "CANCELLED").when(F.max("busy"), "BUSY").when(F.max("failed"), "FAILED").when(F.sum("left") > 0, "PARTIAL").otherwise("COMPLETED")
    return passes.groupBy("job").agg(state.alias("status"), F.sum("left").alias("left"))
