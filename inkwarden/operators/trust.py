"""Configuration trust: discovery, versions, approvals, the gate and policy changes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import config as cf
from ..plans import policy as pl
from .scan import findings_of, scan_files

COMPONENT = "source_path string, component_id string, name string, kind string, locator string, content string, raw_hash string, canonical_hash string, semantic_fingerprint string, error string"
CHANGE = "array<struct<path:string,old:string,new:string,severity:string,category:string,operation:string>>"
RISK = "array<struct<rule_id:string,title:string,severity:string,category:string,location:string,layer:string>>"


def parsed(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, canonical, error and the three hashes of each configuration file."""
    schema = "path string, canonical string, raw_hash string, canonical_hash string, semantic_fingerprint string, error string"

    def one(path: str, raw: bytes) -> tuple:
        try:
            text = cf.canonical(cf.parse(raw, path))
            return (path, text, *cf.fingerprints(raw, text), None)
        except cf.Invalid as e:
            return path, None, cf.sha256(raw), None, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(p, bytes(c or b"")) for p, c in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True)], columns=[x.split()[0] for x in schema.split(", ")])

    return files.select(F.col(path_col), F.col(content_col).cast("binary")).mapInPandas(run, schema)


@F.pandas_udf(T.StructType([T.StructField(h, T.StringType()) for h in ("raw_hash", "canonical_hash", "semantic_fingerprint")]))
def text_fingerprints(text: pd.Series) -> pd.DataFrame:
    """The three hashes of plain texts, each taken as a configuration value; a text without a canonical form has the first only."""

    def one(t: str | None) -> tuple:
        if t is None:
            return None, None, None
        raw = t.encode("utf-8", "surrogatepass")
        try:
            return cf.fingerprints(raw, cf.canonical(t))
        except cf.Invalid:
            return cf.sha256(raw), None, None

    return pd.DataFrame([one(t) for t in text], columns=["raw_hash", "canonical_hash", "semantic_fingerprint"])


def discovered(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """COMPONENT rows of each file; a file that can't be read gives one row with its error."""
    names = [x.split()[0] for x in COMPONENT.split(", ")]

    def of(path: str, raw: bytes) -> list[tuple]:
        try:
            found = cf.components(cf.parse(raw, path), path)
        except cf.Invalid as e:
            return [(path, None, None, None, None, None, cf.sha256(raw), None, None, str(e))]
        return [(path, c["component_id"], c["name"], c["kind"], c["locator"], c["content"], *cf.fingerprints(raw, c["content"]), None) for c in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, c in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True) for r in of(p, bytes(c or b""))], columns=names)

    return files.select(F.col(path_col), F.col(content_col).cast("binary")).mapInPandas(run, COMPONENT)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("path", "old", "new", "severity", "category", "operation")])))
def _changes(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([cf.differences(json.loads(a), json.loads(z)) if isinstance(a, str) and isinstance(z, str) else [] for a, z in zip(old, new, strict=True)])


def differences(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """``pairs`` with ``changes`` between two canonical texts (none where either is null); equal texts, and all other columns, don't go to Python."""
    apart = F.col(old) != F.col(new)
    return pairs.withColumn("changes", _changes(F.when(apart, F.col(old)), F.when(apart, F.col(new))))


def risks(components: DataFrame, content: str = "content") -> DataFrame:
    """``components`` with the risky settings in their content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["risks"] = [cf.risks(json.loads(c)) if isinstance(c, str) else [] for c in b[content]]
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in components.schema.fields)
    return components.mapInPandas(run, f"{schema}, risks {RISK}")


def text_findings(components: DataFrame) -> DataFrame:
    """component_id and the rules that match a component's canonical text; the evidence is withheld, as it may quote a secret."""
    named = components.select("component_id", "content", F.lit("configuration.txt").alias("filename"))
    found = findings_of(scan_files(named, "component_id", "content", "filename"))
    return found.select(F.col("id").alias("component_id"), "rule_id", "title", "severity", "category", F.lit("configuration").alias("location"), F.concat(F.lit("CONFIG_"), "layer").alias("layer"))


def mutation_findings(result: DataFrame, was_approved: Column) -> DataFrame:
    """Findings on what a reconciliation shows: content that left its approval, and protected configuration that changed."""
    changed = F.col("outcome") == "CHANGED"
    protected = F.col("kind").isin("server", "config") | F.exists("changes", lambda c: c["path"].startswith("server") | c["path"].startswith("configuration"))
    mutation = F.when(changed & was_approved, F.struct(F.lit("MCP-0042").alias("rule_id"), F.lit("Post-approval content mutation").alias("title"), F.lit("HIGH").alias("severity"), F.lit("INTEGRITY").alias("category")))
    write = F.when(changed & protected, F.struct(F.lit("MCP-0052").alias("rule_id"), F.lit("Protected configuration changed").alias("title"), F.col("severity").alias("severity"), F.lit("CONFIG_WRITE").alias("category")))
    gone = F.when(F.col("outcome") == "VANISHED", F.struct(F.lit("SOURCE_UNAVAILABLE").alias("rule_id"), F.lit("The source has no usable version").alias("title"), F.lit("HIGH").alias("severity"), F.lit("INTEGRITY").alias("category")))
    return result.select("component_id", F.explode(F.array_compact(F.array(mutation, write, gone))).alias("f")).select("component_id", "f.*")


def flat_differences(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of two flattened trees (keys, path, value): aligned by a full join on the path."""
    a, b = old.select(*keys, "path", F.col("value").alias("old")), new.select(*keys, "path", F.col("value").alias("new"))
    both = a.join(b, [*keys, "path"], "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    words = F.split(F.lower("path"), r"[./\[\]]+")
    security = F.arrays_overlap(words, F.array(*[F.lit(w) for w in sorted(cf.SECURITY)])) | F.col("path").rlike(cf.SECRET) | F.arrays_overlap(words, F.array(*[F.lit(w) for w in sorted(cf.SECRET_PLACES)]))
    operation = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").otherwise("replace")
    return both.withColumn("operation", operation).withColumn("category", F.when(security, "SECURITY_RELEVANT_CHANGE").otherwise("SEMANTIC_CHANGE"))


def reconciled(current: DataFrame, found: DataFrame, policy: dict = pl.POLICY) -> DataFrame:
    """The current components against those just discovered, by component_id: outcome, change_type, action, state, version, severity.

    ``current`` has component_id, the three hashes, state, version, source_valid and content.
    A component that is gone loses its approval; one that is the same keeps everything.
    """
    hashes = ["raw_hash", "canonical_hash", "semantic_fingerprint"]
    old = current.select("component_id", *[F.col(c).alias(f"old_{c}") for c in (*hashes, "state", "version", "source_valid", "content", "source_path")])
    both = old.join(found.filter("component_id IS NOT NULL"), "component_id", "full")
    is_new, gone = F.col("old_version").isNull(), F.col("raw_hash").isNull()
    same = F.coalesce(F.col("old_source_valid"), F.lit(False))
    for h in hashes:
        same = same & F.col(f"old_{h}").eqNullSafe(F.col(h))
    both = differences(both.withColumn("outcome", F.when(gone, "VANISHED").when(is_new, "NEW").when(same, "UNCHANGED").otherwise("CHANGED")), "old_content", "content")
    security = F.exists("changes", lambda c: c["category"] == "SECURITY_RELEVANT_CHANGE")
    restored = ~is_new & ~F.coalesce(F.col("old_source_valid"), F.lit(True)) & (F.size("changes") == 0)
    category = pl.change_category(is_new, restored, security, F.col("old_canonical_hash").eqNullSafe(F.col("canonical_hash")))
    moved = F.col("outcome").isin("NEW", "CHANGED")
    out = both.withColumn("change_type", F.when(moved, category))
    action = F.when(F.col("old_state").isin("REVOKED") & moved, "BLOCK").when(F.col("old_state").isin("QUARANTINED") & moved, "QUARANTINE").otherwise(pl.change_action(F.col("change_type"), policy))
    out = out.withColumn("action", F.when(moved, action).when(F.col("outcome") == "VANISHED", "BLOCK"))
    out = out.withColumn("state", F.when(moved, pl.change_state(F.col("change_type"), F.col("action"), F.col("old_state"))).when(F.col("outcome") == "VANISHED", "BLOCKED").otherwise(F.col("old_state")))
    out = out.withColumn("version", F.when(F.col("outcome") == "NEW", 1).when(F.col("outcome") == "CHANGED", F.col("old_version") + 1).otherwise(F.col("old_version")).cast("int"))
    out = out.withColumn("severity", F.when(F.col("outcome") == "VANISHED", "HIGH").when(moved, pl.change_severity(F.col("change_type"))))
    return out.withColumn("source_valid", ~gone).withColumn("source_path", F.coalesce("source_path", "old_source_path"))


def written_back(result: DataFrame) -> DataFrame:
    """The current-state table after a reconciliation; hashes and content of what vanished stay."""
    hashes = ["raw_hash", "canonical_hash", "semantic_fingerprint", "content"]
    return result.select("component_id", "source_path", *[F.coalesce(c, f"old_{c}").alias(c) for c in hashes], "state", "version", "source_valid")


def decision(current: Column, asked_hash: Column, asked_version: Column, approved: Column) -> tuple[Column, Column]:
    """(reason, allowed) of the gate for a component row."""
    reason = (
        F.when(~current["source_valid"], "Current source is unavailable or invalid").when(asked_hash.isNotNull() & (asked_hash != current["canonical_hash"]), "Requested content hash is stale")
        .when(asked_version.isNotNull() & (asked_version != current["version"]), "Requested version is stale").when(approved, "Exact current content version has a valid signed approval")
        .otherwise("Explicit approval for this content version and current policy is required")
    )
    return reason, reason == "Exact current content version has a valid signed approval"


def gate(components: DataFrame, approvals: DataFrame, lifecycle: DataFrame, requests: DataFrame, policy_version: int = 1) -> DataFrame:
    """Decisions for requests (component_id, canonical_hash, version; the last two may be null).

    A component passes if it is approved, its approval binds exactly these hashes, version, path and policy,
    and its last lifecycle event (``lifecycle``: component_id, event_type, approval_id) is that approval.
    """
    ask = requests.select("component_id", F.col("canonical_hash").alias("_hash"), F.col("version").alias("_version"))
    bound = approvals.select("approval_id", F.struct("component_id", "canonical_hash", "raw_hash", "semantic_fingerprint", "version", "source_path", "policy_version").alias("_bound"))
    life = lifecycle.select("component_id", F.col("event_type").alias("_event"), F.col("approval_id").alias("_last"))
    rows = ask.join(components, "component_id", "left").join(bound, "approval_id", "left").join(life, "component_id", "left")
    exact = F.lit(True)
    for c in ("component_id", "canonical_hash", "raw_hash", "semantic_fingerprint", "version", "source_path"):
        exact = exact & (F.col(f"_bound.{c}") == F.col(c))
    approved = F.coalesce((F.col("state") == "APPROVED") & exact & (F.col("_bound.policy_version") == policy_version) & (F.col("_event") == "APPROVED") & (F.col("_last") == F.col("approval_id")), F.lit(False))
    row = {c: F.col(c) for c in ("canonical_hash", "version")} | {"source_valid": F.coalesce("source_valid", F.lit(False))}
    reason, allowed = decision(row, F.col("_hash"), F.col("_version"), approved)
    stale = F.col("reason") == "Explicit approval for this content version and current policy is required"
    kept = F.when(F.col("action").isin("BLOCK", "QUARANTINE", "REQUIRE_REAPPROVAL"), F.col("action")).otherwise("REQUIRE_REAPPROVAL")
    out = rows.withColumn("reason", reason).withColumn("allowed", allowed)
    return out.select("component_id", "allowed", F.when(F.col("allowed"), "ALLOW").when(stale, kept).otherwise("BLOCK").alias("action"), "reason", "canonical_hash", "version")


def approve(components: DataFrame, component_id: str, canonical_hash: str, version: int, approver: str, approval_id: str, timestamp: str, policy_version: int = 1, note: str = "") -> tuple[DataFrame, DataFrame]:
    """The approval to append and the component table with it; only for the exact current content and version."""
    if not approver.strip() or len(approver) > 200 or len(note) > 2000:
        raise ValueError("an approver is required (200 characters at most; note 2000)")
    row = components.filter(F.col("component_id") == component_id).first()
    if row is None:
        raise KeyError(component_id)
    if not row["source_valid"] or row["canonical_hash"] != canonical_hash or row["version"] != version:
        raise ValueError("content or version changed, or the source is unavailable")
    mine = F.col("component_id") == component_id
    approval = components.filter(mine).select(F.lit(approval_id).alias("approval_id"), "component_id", "canonical_hash", "raw_hash", "semantic_fingerprint", "version", "source_path", F.lit(policy_version).alias("policy_version"), F.lit(approver.strip()).alias("approver"), F.lit(timestamp).alias("timestamp"), F.lit(str(cf.redacted(note))).alias("note"))
    put = lambda c, v: F.when(mine, F.lit(v)).otherwise(F.col(c)) if c in components.columns else F.when(mine, F.lit(v))
    return approval, components.withColumns({"state": put("state", "APPROVED"), "action": put("action", "ALLOW"), "approval_id": put("approval_id", approval_id)})


def set_state(components: DataFrame, component_id: str, state: str, reason: str) -> DataFrame:
    """REVOKED or QUARANTINED, with the approval gone."""
    if state not in ("REVOKED", "QUARANTINED") or not reason.strip() or len(reason) > 2000:
        raise ValueError("a state and a reason are required")
    mine = F.col("component_id") == component_id
    return components.withColumns({"state": F.when(mine, state).otherwise(F.col("state")), "action": F.when(mine, "QUARANTINE" if state == "QUARANTINED" else "BLOCK").otherwise(F.col("action")), "approval_id": F.when(~mine, F.col("approval_id"))})


def under_new_policy(components: DataFrame) -> DataFrame:
    """A policy change takes every approval back."""
    was = F.col("state") == "APPROVED"
    return components.withColumns({"state": F.when(was, "REAPPROVAL_REQUIRED").otherwise(F.col("state")), "action": F.when(was, "REQUIRE_REAPPROVAL").otherwise(F.col("action")), "approval_id": F.when(~was, F.col("approval_id"))})


def history_violations(versions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Versions and their logged hashes that don't agree, or have no partner; both have component_id, version and the three hashes."""
    hashes = ("raw_hash", "canonical_hash", "semantic_fingerprint")
    a = anchors.select("component_id", "version", *[F.col(h).alias(f"logged_{h}") for h in hashes])
    both = versions.join(a, ["component_id", "version"], "full")
    same = F.lit(True)
    for h in hashes:
        same = same & (F.col(h) == F.col(f"logged_{h}"))
    return both.filter(~F.coalesce(same, F.lit(False))).select("component_id", "version")


def numbered(changes: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return changes.withColumn("version", F.row_number().over(w))


SNAPSHOT_FAILED = "SNAPSHOT_INTEGRITY_FAILED"


def snapshot_integrity(components: DataFrame, events: DataFrame) -> DataFrame:
    """``components`` with ``integrity``: null, or SNAPSHOT_INTEGRITY_FAILED where a row isn't what its last DISCOVERED or VERSION_CHANGED event says.

    ``events`` has component_id, event_type, sequence, version and the three hashes. A component without such an event fails, too.
    """
    columns = ("version", "raw_hash", "canonical_hash", "semantic_fingerprint")
    last = events.filter(F.col("event_type").isin("DISCOVERED", "VERSION_CHANGED")).groupBy("component_id").agg(F.max_by(F.struct(*columns), "sequence").alias("_said"))
    both = components.join(last, "component_id", "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_said.{c}"))
    return both.withColumn("integrity", F.when(~(F.col("_said").isNotNull() & same), SNAPSHOT_FAILED)).drop("_said")


def due(components: DataFrame, changed: DataFrame, sources: DataFrame) -> DataFrame:
    """source_path, component_id of the first component of each path that changed or is a source, null where it has none; ``known`` if it is both."""
    first = components.groupBy("source_path").agg(F.min("component_id").alias("component_id"))
    paths = changed.select("source_path", F.lit(1).alias("_c"), F.lit(0).alias("_s")).unionByName(sources.select("source_path", F.lit(0).alias("_c"), F.lit(1).alias("_s")))
    paths = paths.groupBy("source_path").agg((F.max("_c") + F.max("_s") == 2).alias("known"))
    return paths.join(first, "source_path", "left").select("source_path", "component_id", "known")


def current_policy(history: DataFrame) -> DataFrame:
    """The policy of the largest version, one row; versions are appended and never rewritten."""
    return history.orderBy(F.col("version").desc()).limit(1)


def next_policy(history: DataFrame, policy: dict, timestamp: str) -> DataFrame:
    """The row to append for a checked policy: a version on from the current one."""
    checked = pl.check_policy(policy)
    last = current_policy(history).agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))
    return last.select((F.col("version") + 1).cast("int").alias("version"), F.lit(json.dumps({k: v for k, v in checked.items() if k != "version"}, sort_keys=True)).alias("policy"), F.lit(timestamp).alias("timestamp"))


def policy_violations(history: DataFrame, events: DataFrame) -> DataFrame:
    """Versions that no POLICY_CHANGED event (version, policy) or another one tells of, and events without a version."""
    said = events.select("version", F.col("policy").alias("_said"))
    both = history.join(said, "version", "full")
    return both.filter(~F.coalesce(F.col("policy") == F.col("_said"), F.lit(False))).select("version")
