"""A watched directory tree: passes of a listing, an index of what was inspected, reports, and what has vanished.

A run is one pass of :class:`sources.listing.Listing`, bounded by entries and bytes. For each
file the index says whether it has to be inspected: not if its length and time are those that the index
has, nor if its content is, as long as it was inspected in the same context (rules and policy) and
without an error. What failed is looked at again three seconds later, or when it
changes; what is too large only when it changes. When the walk is complete, and every folder of it
could be listed, paths that it has not met leave the index.

Index, reports and the pass's counts are one commit of :class:`operators.deltas.Deltas` under the
batch's number: a batch that is run again finds its number and does nothing.

Cases: an empty tree is a complete pass without files; a file that changes while it is read
is a failure that is tried again; equal contents under two paths are inspected each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.deltas import Deltas, Table
from ..operators.ordered import _checkpoint
from ..operators.scan import scan_files
from ..plans import policy as pl
from ..sources.listing import MAX_ENTRIES, PASS_BYTES, Listing
from .incremental import PERMANENT, context_hash

#: Fixed value: seconds from a failure to the next attempt.
RETRY_SECONDS = 3
TABLES = {
    "index": Table("path string, length long, modified timestamp, sha256 string, status string, error string, retry_after timestamp, context string, walk long", ("path",)),
    "reports": Table("path string, sha256 string, status string, verdict string, risk_score int, severity string, rules string, walk long, number long"),
    "passes": Table("number long, walk long, status string, files long, scanned long, unchanged long, failed long, removed long, bytes long", ("number",)),
}


class WatchedTree:
    def __init__(self, spark: SparkSession, root: str, path: str, policy: dict = pl.POLICY, entries: int = MAX_ENTRIES, most_bytes: int = PASS_BYTES):
        self.spark, self.root, self.path, self.policy, self.entries, self.bytes = spark, root, path.rstrip("/"), policy, entries, most_bytes
        self.store = Deltas(spark, f"{self.path}/store", TABLES)

    def index(self) -> DataFrame:
        return self.store.read("index")

    def reports(self) -> DataFrame:
        return self.store.read("reports")

    def passes(self) -> DataFrame:
        return self.store.read("passes")

    def run(self, now: str | None = None) -> str:
        """One pass; PARTIAL, or COMPLETE at the end of the walk. ``now`` stands for the time that retries are judged by."""
        self.spark.dataSource.register(Listing)
        stream = self.spark.readStream.format("listing").options(path=self.root, cursor=f"{self.path}/cursor", entries=self.entries, bytes=self.bytes, mark="true", slices=4 * self.spark.sparkContext.defaultParallelism).load()
        at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        stream.writeStream.foreachBatch(lambda batch, number: self._take(batch, at)).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start().awaitTermination()
        return self.passes().orderBy(F.desc("number")).first()["status"]

    def _outcome(self, now: Column, context: str) -> Column:
        known = F.col("i_context") == context
        still = known & F.col("length").eqNullSafe(F.col("i_length")) & F.col("modified").eqNullSafe(F.col("i_modified")) & (F.col("i_retry").isNull() | (now < F.col("i_retry")))
        same = known & F.col("i_error").isNull() & (F.col("sha256") == F.col("i_sha256"))
        return F.when(F.coalesce(still, F.lit(False)), "UNCHANGED").when(F.col("error").isNotNull(), "FAILED").when(F.coalesce(same, F.lit(False)), "SAME_CONTENT").otherwise("SCAN")

    def _take(self, batch: DataFrame, now: Column) -> None:
        batch.persist()  # read once
        mark = next(iter(batch.filter("length IS NULL AND error IS NULL").select("walk", "number", "status").collect()), None)  # one row at most; all slices are read at once
        if mark is None or not self.passes().filter(F.col("number") == mark["number"]).isEmpty():
            batch.unpersist()
            return
        walk, number, status = mark
        context = context_hash(self.policy)
        index = self.index()
        old = index.select("path", *[F.col(c).alias(f"i_{n}") for n, c in (("length", "length"), ("modified", "modified"), ("sha256", "sha256"), ("status", "status"), ("error", "error"), ("retry", "retry_after"), ("context", "context"))])
        listed = batch.filter("length IS NOT NULL OR error IS NOT NULL").withColumn("sha256", F.sha2("content", 256)).drop("content")
        met = _checkpoint(listed.join(old, "path", "left").withColumn("outcome", self._outcome(now, context)))
        # A pass has few paths, and the contents stay in the slices that they were read in: joined by a shuffle, they would be inspected in a few tasks.
        wanted = batch.join(F.broadcast(met.filter("outcome = 'SCAN'").select("path")), "path", "left_semi").select("path", "content", F.element_at(F.split("path", "/"), -1).alias("filename"))
        rules = F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["rule_id"]))))
        scanned = _checkpoint(scan_files(wanted, "path", policy=self.policy).select(F.col("id").alias("path"), "sha256", "status", "verdict", "risk_score", "severity", rules.alias("rules")))
        batch.unpersist()
        new = met.drop("sha256").join(scanned.select("path", F.col("sha256").alias("n_sha256"), F.col("status").alias("n_status")), "path", "left")
        kept, failed = F.col("outcome").isin("UNCHANGED", "SAME_CONTENT"), F.col("outcome") == "FAILED"
        retry = F.when(failed & ~F.col("error").isin(*PERMANENT), now + F.expr(f"INTERVAL {RETRY_SECONDS} SECONDS"))
        rows = new.select(
            "path", "length", "modified", F.when(kept, F.col("i_sha256")).otherwise(F.col("n_sha256")).alias("sha256"), F.when(kept, F.col("i_status")).when(failed, "BLOCKED").otherwise(F.col("n_status")).alias("status"),
            F.when(F.col("outcome") == "UNCHANGED", F.col("i_error")).when(failed, F.col("error")).alias("error"), F.when(F.col("outcome") == "UNCHANGED", F.col("i_retry")).otherwise(retry).alias("retry_after"), F.lit(context).alias("context"), F.lit(walk).alias("walk"), F.lit(False).alias("_gone"),
        )
        unlisted = F.coalesce(F.col("error").startswith("DIRECTORY_UNREADABLE"), F.lit(False))
        gone = index.filter(F.col("walk") < walk).join(met.select("path"), "path", "left_anti").withColumn("_gone", F.lit(True))
        whole = status == "COMPLETE" and rows.filter(unlisted).isEmpty() and index.filter((F.col("walk") == walk) & unlisted).isEmpty()
        if whole:
            rows = rows.unionByName(gone)
        has = lambda *x: F.count_if(F.col("outcome").isin(*x))
        counts = met.agg(F.count("*").alias("files"), has("SCAN").alias("scanned"), has("UNCHANGED", "SAME_CONTENT").alias("unchanged"), F.count_if((F.col("outcome") == "FAILED") | ((F.col("outcome") == "UNCHANGED") & F.col("i_error").isNotNull())).alias("failed"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
        done = counts.select(F.lit(number).alias("number"), F.lit(walk).alias("walk"), F.lit(status).alias("status"), "files", "scanned", "unchanged", "failed", F.lit(gone.count() if whole else 0).alias("removed"), "bytes")
        told = scanned.withColumn("walk", F.lit(walk)).withColumn("number", F.lit(number))
        self.store.commit({"index": rows, "reports": told, "passes": done})
