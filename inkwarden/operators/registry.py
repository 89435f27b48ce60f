"""The report registry: stored reports with their events; filters, literal search, pages and statistics in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.policy import VERDICTS, rank, severity_of
from . import ordered
from .deltas import Deltas, Table

SEARCHED = ("filename", "source_path", "sha256")
LONGEST_QUERY = 300


class Store:
    """Reports kept as Parquet, each batch under its number with an event for each report; a batch that is stored again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, reports: DataFrame, batch: int = 0) -> None:
        reports.write.mode("overwrite").parquet(stored := f"{self.path}/reports/batch={batch}")
        report = self.spark.read.parquet(stored)
        event = report.select(F.col("created_at").alias("timestamp"), F.lit("FILE_SCANNED").alias("event_type"), F.lit(None).cast("string").alias("component_id"), F.to_json(F.struct(F.col("id").alias("report_id"), "filename", "sha256", "status", "verdict")).alias("details"))
        event.write.mode("overwrite").parquet(f"{self.path}/events/batch={batch}")

    def reports(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/reports").drop("batch")

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/events").drop("batch")


class ContentStore:
    """Reports of which each content has one, whatever batches it comes in: known digests are left out by an anti-join inside the commit.

    Of one batch's rows with one content the smallest id's stays. Digests and reports are one
    commit of :class:`deltas.Deltas`; digests lie in folders by hash, of which a small batch reads its own.
    Null contents are one content.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, content: str = "sha256", order: str = "id"):
        kind = dict(x.strip().split(None, 1) for x in schema.split(","))[content]
        self.content, self.order = content, order
        self.store = Deltas(spark, path, {"reports": Table(schema), "digests": Table(f"{content} {kind}", (content,), True)})

    def append(self, reports: DataFrame) -> int:
        at = self.store.head()
        one = reports.groupBy(self.content).agg(F.min_by(F.struct(*reports.columns), self.order).alias("_r"))
        known = self.store.lookup("digests", one.select(self.content)).select(F.col(self.content).alias("_known"))
        new = one.join(known, F.col(self.content).eqNullSafe(F.col("_known")), "left_anti").select("_r.*")
        return self.store.commit({"reports": new, "digests": new.select(self.content)}, at)

    def reports(self) -> DataFrame:
        return self.store.read("reports")


def ascii_lower(c: Column) -> Column:
    """Lower case for A to Z only, as the registry's search folds."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def matching(verdict: str = "ALL", query: str = "") -> Column:
    """Reports of a verdict that hold ``query`` literally (its first 300 characters) in a searched column."""
    if verdict != "ALL" and verdict not in VERDICTS:
        raise ValueError("unknown verdict")
    out = F.lit(True) if verdict == "ALL" else F.col("verdict") == verdict
    if query:
        wanted = ascii_lower(F.lit(query[:LONGEST_QUERY]))
        found = F.lit(False)
        for c in SEARCHED:
            found = found | F.coalesce(F.contains(ascii_lower(F.col(c)), wanted), F.lit(False))
        out = out & found
    return out


def page(reports: DataFrame, limit: int = 100, offset: int = 0, verdict: str = "ALL", query: str = "", most: int = 500) -> DataFrame:
    """The newest reports first; ids part equal times."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError("limit or offset out of range")
    return reports.filter(matching(verdict, query)).orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def by_id(reports: DataFrame, wanted: object) -> DataFrame:
    return reports.filter(F.col("id") == wanted)


def in_order(reports: DataFrame, wanted: list) -> DataFrame:
    """The reports of some ids, in the order asked for."""
    order = reports.sparkSession.createDataFrame(list(enumerate(wanted)), f"_pos int, id {reports.schema['id'].dataType.simpleString()}")
    return reports.join(F.broadcast(order), "id").orderBy("_pos").drop("_pos")  # as many rows as were asked for


def stats(reports: DataFrame, verdict: str = "ALL", query: str = "") -> DataFrame:
    """One row: counts by verdict, blocked, different contents, the last scan, and how many match the filter."""
    names = {"INFECTED": "infected", "CORRUPTED": "corrupted", "VALID": "valid", "REVIEW_REQUIRED": "review_required", "UNSCANNABLE": "unscannable"}
    sha = F.when(F.col("sha256") != "", F.col("sha256"))
    return reports.agg(
        F.count("*").alias("analyzed"), *[F.count_if(F.col("verdict") == v).alias(n) for v, n in names.items()],
        F.count_if(F.col("status") == "BLOCKED").alias("blocked"), F.count_distinct(sha).alias("unique_files"),
        F.max("created_at").alias("last_scan_at"), F.count_if(matching(verdict, query)).alias("matched"),
    )


def status_counters(components: DataFrame) -> DataFrame:
    return components.agg(
        F.count_if(F.col("state") == "APPROVED").alias("approved"), F.count_if(F.col("state").isin("PENDING_APPROVAL", "REAPPROVAL_REQUIRED")).alias("pending"),
        F.count_if(F.col("state").isin("BLOCKED", "REVOKED", "QUARANTINED")).alias("blocked"),
    )


def histogram(reports: DataFrame) -> DataFrame:
    """One row with a map of counts by status."""
    return reports.groupBy("status").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "count")))).alias("statuses"))


def inconsistent(reports: DataFrame) -> DataFrame:
    """Reports that contradict themselves: severity isn't the worst finding's, or a score without a finding."""
    worst = F.coalesce(F.array_max(F.transform("findings", lambda f: rank(f["severity"]))), F.lit(0))
    bad = (F.col("severity") != severity_of(worst)) | ((F.size("findings") == 0) & (F.col("risk_score") != 0))
    return reports.filter(bad)


def deliverable(reports: DataFrame, extensions: tuple[str, ...] = ("txt", "md", "json", "yaml", "yml", "toml", "csv", "html", "htm", "xml"), most_bytes: int = 256 * 1024) -> DataFrame:
    """Reports whose exact bytes may be handed on."""
    return reports.filter((F.col("verdict") == "VALID") & (F.col("status") == "ALLOWED") & F.col("analysis_complete") & (F.col("size_bytes") <= most_bytes) & F.col("format").isin(*extensions))


def source_paths(components: DataFrame) -> DataFrame:
    return components.select("source_path").distinct().orderBy("source_path")


def search_components(components: DataFrame, state: str = "ALL", query: str = "") -> DataFrame:
    text = F.lower(F.concat_ws(" ", "name", "kind", "source_path"))
    keep = F.lit(True) if state == "ALL" else F.col("state") == state
    return components.filter(keep & text.contains(query.lower()))


def latency(samples: DataFrame, value: str) -> DataFrame:
    """Median, 95th percentile by nearest rank, least and most, by passes that count bins and keep no values."""
    return ordered.as_row(samples.sparkSession, ordered.percentiles(samples, value, {"p50": 0.5, "p95": 0.95, "least": 0.0, "most": 1.0}))


#: Columns of a report that may be shown to whoever asks.
PUBLIC = ("id", "filename", "created_at", "status", "verdict", "risk_score", "severity")


def public(reports: DataFrame) -> DataFrame:
    """The public columns, and ``valid``: whether the values are of those that there are; others are shown as null."""
    fine = F.coalesce(F.col("verdict").isin(*VERDICTS) & F.col("risk_score").between(0, 100) & rank(F.col("severity")).isNotNull(), F.lit(False))
    rows = reports.withColumn("valid", fine)
    return rows.select("id", *[F.when(F.col("valid"), F.col(c)).alias(c) for c in PUBLIC[1:]], "valid")


def summary(reports: DataFrame) -> DataFrame:
    """Counts without any source's name, and whether they agree with each other."""
    s = stats(reports)
    parts = F.col("infected") + F.col("corrupted") + F.col("valid") + F.col("review_required") + F.col("unscannable")
    return s.select("analyzed", "infected", "blocked", "unique_files", ((parts == F.col("analyzed")) & (F.col("blocked") <= F.col("analyzed")) & (F.col("unique_files") <= F.col("analyzed"))).alias("consistent"))


def counters(rows: DataFrame, status: str) -> DataFrame:
    """Done, succeeded, failed and skipped of a batch."""
    is_ = lambda *v: F.count_if(F.col(status).isin(*v))
    return rows.agg(F.count(status).alias("done"), is_("ALLOWED", "FLAGGED").alias("succeeded"), is_("BLOCKED", "QUARANTINED").alias("failed"), F.count_if(F.col(status).isNull()).alias("skipped"))


def manifest(files: DataFrame, by: str, entry: Column) -> DataFrame:
    """A fingerprint of each group's entries, whatever their order: entries are hashed by bucket, and the buckets' hashes in order.

    A bucket has a 4096th of a group, so that no list grows with it.
    """
    rows = files.select(by, F.sha2(entry, 256).alias("_h"))
    buckets = rows.groupBy(by, F.substring("_h", 1, 3).alias("_b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), "\n"), 256).alias("_x"), F.count("*").alias("_n"))
    return buckets.groupBy(by).agg(F.sum("_n").alias("entries"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_x"))), lambda x: F.concat(x["_b"], x["_x"])), "\n"), 256).alias("fingerprint"))


#: Entries of a leaf, and children of a node, of a manifest's tree.
LEAF, FAN_BITS = 64, 4


def tree_depth(entries: Column) -> Column:
    """How many hexadecimal digits part the entries so that a leaf has about ``LEAF`` of them."""
    return F.greatest(F.lit(0), F.ceil(F.log2(entries / LEAF) / FAN_BITS - 1e-9)).cast("int")


def manifest_tree(files: DataFrame, by: list[str], entry: Column) -> DataFrame:
    """entries and root of each group: a Merkle tree over the ranges of the entries' hashes, whatever their order.

    A leaf is the hash of its entries' hashes in order, a node that of its children's first digits and
    hashes; the depth follows from the number of entries alone. Levels combine upwards, so that no list has more than
    16 children or the entries of one leaf, and a group with all entries is as many tasks as it has leaves.
    Repeated entries count as often as they come; null entries are left out, as are groups without any other.
    """
    rows = files.select(*by, F.sha2(entry, 256).alias("_h")).filter("_h IS NOT NULL")
    counts = rows.groupBy(*by).agg(F.count("*").alias("entries"))
    deepest = counts.agg(F.max(tree_depth(F.col("entries")))).first()[0] or 0
    known = counts.select(*[F.col(c).alias(f"_k_{c}") for c in by], "entries", tree_depth(F.col("entries")).alias("_depth"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    placed = rows.join(known, same).select(*by, "entries", "_depth", F.expr("substring(_h, 1, _depth)").alias("_at"), "_h")
    nodes = placed.groupBy(*by, "entries", "_depth", "_at").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), "\n"), 256).alias("_x"))
    for level in range(deepest, 0, -1):
        children = nodes.filter(F.length("_at") == level).groupBy(*by, "entries", "_depth", F.expr(f"substring(_at, 1, {level - 1})").alias("_at"))
        parents = children.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.substring("_at", level, 1).alias("d"), "_x"))), lambda c: F.concat(c["d"], c["_x"])), "\n"), 256).alias("_x"))
        nodes = nodes.filter(F.length("_at") < level).unionByName(parents)
    return nodes.select(*by, "entries", F.col("_x").alias("root"))


def byte_budget(files: DataFrame, by: str, length: Column, most: int) -> DataFrame:
    """Total bytes of each group and whether they are within ``most``, after the fact; :func:`ordered.within_budget` stops at the row that goes beyond."""
    return files.groupBy(by).agg(F.sum(length).cast("long").alias("bytes")).withColumn("within", F.col("bytes") <= most)
