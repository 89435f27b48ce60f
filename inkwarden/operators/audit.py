"""The audit log: hash chains, their verification, and what the log says of a component."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ordered

GENESIS = "0" * 64
#: Events that move a component through its life.
LIFECYCLE = ("DISCOVERED", "VERSION_CHANGED", "SOURCE_UNAVAILABLE", "APPROVED", "REVOKED", "QUARANTINED")
PAYLOAD = ("sequence", "timestamp", "event_type", "component_id", "details", "previous_hash")


def link_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", previous, payload), 256)


def build_chains(events: DataFrame, chain_col: str, order: list[str], payload: Column) -> DataFrame:
    """chain, sequence, payload, previous_hash, hash for each event; a chain starts at GENESIS.

    A chain is sequential by nature: its events are sorted in one task and read
    once with the last hash at hand. Chains are independent, and none is held whole.
    """
    kind = events.schema[chain_col].dataType.simpleString()
    rows = events.select(F.col(chain_col).alias("chain"), payload.cast("string").alias("payload"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    rows = rows.repartition("chain").sortWithinPartitions("chain", *[f"_o{k}" for k in range(len(order))], "payload").select("chain", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, sequence, last, begun = None, 0, GENESIS, False
        for batch in batches:
            numbers, before, after = [], [], []
            for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or c != chain:
                    chain, sequence, last, begun = c, 0, GENESIS, True
                sequence += 1
                numbers.append(sequence)
                before.append(last)
                last = hashlib.sha256((last if p is None else f"{last}|{p}").encode("utf-8", "surrogatepass")).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32()), batch.column(1), pa.array(before, pa.string()), pa.array(after, pa.string())], names=["chain", "sequence", "payload", "previous_hash", "hash"])

    return rows.mapInArrow(run, f"chain {kind}, sequence int, payload string, previous_hash string, hash string")


def broken_links(log: DataFrame) -> DataFrame:
    """Rows of (chain, sequence, payload, previous_hash, hash) that don't follow from the row before; a self-join on the sequence, so that one long chain is verified in parallel."""
    before = log.select(F.col("chain").alias("_c"), (F.col("sequence") + 1).alias("_s"), F.col("hash").alias("_h"))
    joined = log.join(before, (F.col("chain") == F.col("_c")) & (F.col("sequence") == F.col("_s")), "left")
    expected = F.when(F.col("sequence") == 1, GENESIS).otherwise(F.col("_h"))
    reason = (
        F.when((F.col("sequence") > 1) & F.col("_h").isNull(), "GAP").when(F.col("previous_hash") != expected, "LINK")
        .when(F.col("hash") != link_hash(F.col("previous_hash"), F.col("payload")), "HASH")
    )
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select("chain", "sequence", "reason")


def verified(log: DataFrame) -> DataFrame:
    """chain, checked, valid."""
    bad = broken_links(log).groupBy("chain").agg(F.count("*").alias("_bad"))
    return log.groupBy("chain").agg(F.count("*").alias("checked")).join(bad, "chain", "left").select("chain", "checked", F.col("_bad").isNull().alias("valid"))


def suffix(log: DataFrame, sequence: int) -> DataFrame:
    """What a verified prefix leaves to verify: the rows from its head on."""
    return log.filter(F.col("sequence") >= sequence)


def gaps(log: DataFrame, chain_col: str = "chain") -> DataFrame:
    """Rows whose sequence isn't their place in the chain; one long chain is several tasks."""
    return ordered.running(log, [chain_col], ["sequence"]).withColumn("expected", F.col("place").cast("int")).drop("place").filter("sequence <> expected")


def latest(log: DataFrame, key: str, types: tuple[str, ...] = LIFECYCLE, kept: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """The last lifecycle event of each key, as one aggregate with partial results."""
    last = F.max_by(F.struct(*kept, "sequence"), "sequence").alias("_l")
    return log.filter(F.col("event_type").isin(*types)).groupBy(key).agg(last).select(key, "_l.*")


def versions(log: DataFrame, key: str) -> DataFrame:
    """version and previous_version by the order of a key's events; a key with many is several tasks."""
    placed = ordered.running(log, [key], ["sequence"]).withColumn("version", F.col("place").cast("int")).drop("place")
    return placed.withColumn("previous_version", F.when(F.col("version") > 1, F.col("version") - 1))


def calls_within(log: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """How many calls a key made in the ``seconds`` up to each call, refused ones as well."""
    return ordered.calls_within(log, key, ts, seconds)


def accepted_calls(log: DataFrame, key: str, ts: str, order: list[str], most: int = ordered.MOST_CALLS, seconds: int = ordered.CALL_SECONDS) -> DataFrame:
    """``log`` with ``accepted``: whether a limiter that forgets refused calls lets each call through."""
    return ordered.accepted(log, [key], ts, order, most, seconds)


def tail(log: DataFrame, n: int = 100_000) -> DataFrame:
    return log.orderBy(F.col("sequence").desc()).limit(min(n, 100_000))


def export(log: DataFrame, path: str, n: int = 100_000, verification: dict | None = None) -> None:
    """The last events as one JSON file; ``n`` is at most 100,000, so that one task writes them. With ``verification`` each says whether the log was whole."""
    rows = tail(log, n)
    if verification is not None:
        rows = rows.withColumns({"log_valid": F.lit(bool(verification["valid"])), "log_checked": F.lit(int(verification["checked"]))})
    rows.coalesce(1).write.mode("overwrite").json(path)


def event_types(log: DataFrame) -> DataFrame:
    return log.select("event_type").distinct().orderBy("event_type")


class Writer:
    """Appends events to a single chain kept as Parquet, with a signed head; one writer at a time.

    The head says where the chain ends, and a batch lies in a folder named by its first
    sequence, so that an append looks for one folder, which is there only if a
    crash has left a batch behind the head, and reads and lists nothing else, however long the log is. A batch (what one
    operation logs) is chained on the driver, appended, and the head renamed into place.
    """

    SCHEMA = "sequence long, timestamp string, event_type string, component_id string, details string, previous_hash string, hash string, signature string"

    def __init__(self, spark: SparkSession, path: str, key: bytes):
        self.spark, self.path, self._key = spark, path.rstrip("/"), key

    def _sign(self, value: dict) -> str:
        return hmac.new(self._key, json.dumps(value, sort_keys=True).encode(), hashlib.sha256).hexdigest()

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{self.SCHEMA}, first long").parquet(f"{self.path}/events").drop("first")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.SCHEMA)
            raise

    def stored_head(self) -> dict | None:
        """The head as it was signed, whether or not the signature is right; None before the first append."""
        path, fs = self._files("head")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def is_signed(self, head: dict) -> bool:
        return hmac.compare_digest(head["signature"], self._sign({k: head[k] for k in ("sequence", "head_hash")}))

    def head(self) -> tuple[int, str]:
        """Where the chain ends: the signed head, or beyond it what was appended when the head couldn't be replaced."""
        stored = self.stored_head()
        sequence, digest = (stored["sequence"], stored["head_hash"]) if stored and self.is_signed(stored) else (0, GENESIS)
        while True:
            path, fs = self._files(f"events/first={sequence + 1}")
            if not fs.exists(path):
                return sequence, digest
            last = self.spark.read.schema(self.SCHEMA).parquet(path.toString()).orderBy(F.col("sequence").desc()).select("sequence", "hash").first()
            if last is None:  # a folder that a crash left empty
                return sequence, digest
            sequence, digest = last

    def _put_head(self, sequence: int, digest: str) -> None:
        head = {"sequence": sequence, "head_hash": digest}
        path, fs = self._files("head")
        fresh, _ = self._files(f"head.{sequence}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(head | {"signature": self._sign(head)}).encode()))
        out.close()
        if not fs.rename(fresh, path):  # where a rename doesn't replace; the log itself says what a crash here leaves
            fs.delete(path, False)
            fs.rename(fresh, path)

    def append(self, events: list[tuple[str, str | None, dict]], timestamp: str) -> tuple[int, str]:
        sequence, previous = self.head()
        first, rows = sequence + 1, []
        for event_type, component_id, details in events:
            sequence += 1
            values = (sequence, timestamp, event_type, component_id, json.dumps(details, sort_keys=True), previous)
            digest = hashlib.sha256(json.dumps(dict(zip(PAYLOAD, values, strict=True)), sort_keys=True, ensure_ascii=False).encode()).hexdigest()
            rows.append((*values, digest, self._sign({"hash": digest, "sequence": sequence})))
            previous = digest
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/events/first={first}")
        self._put_head(sequence, previous)
        return sequence, previous

    def verify(self) -> dict:
        """valid, checked, head_hash and error; hashes and signatures are checked on the executors, links by join."""
        key = self._key
        log = self.log()

        def bad(batches):
            for b in batches:
                keep = []
                for r in b.to_dict("records"):
                    digest = hashlib.sha256(json.dumps({k: (None if r[k] != r[k] else r[k]) for k in PAYLOAD}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
                    sign = hmac.new(key, json.dumps({"hash": digest, "sequence": r["sequence"]}, sort_keys=True).encode(), hashlib.sha256).hexdigest()
                    keep.append(digest != r["hash"] or not hmac.compare_digest(sign, r["signature"]))
                yield b[keep][["sequence"]]

        forged = log.mapInPandas(bad, "sequence long").count()
        before = log.select((F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("_h"))
        unlinked = log.join(before, "sequence", "left").filter((F.coalesce("_h", F.lit(GENESIS)) != F.col("previous_hash")) | ((F.col("sequence") > 1) & F.col("_h").isNull())).count()
        last = log.orderBy(F.col("sequence").desc()).select("sequence", "hash").first() or (0, GENESIS)
        checked, stored = log.count(), self.stored_head()
        if forged:
            error = "hash or signature"
        elif unlinked:
            error = "link"
        elif stored and not self.is_signed(stored):
            error = "head signature"
        elif checked != last[0] or (stored or {}).get("sequence", 0) > last[0] or (stored and stored["sequence"] == last[0] and stored["head_hash"] != last[1]) or (checked and not stored):
            error = "truncated"
        else:
            error = None
        return {"valid": error is None, "checked": checked, "head_hash": last[1], "error": error}
