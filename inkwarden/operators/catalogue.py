"""The stored catalogue of components: discovery, refresh, approvals, revocations and policies as commits.

A commit has the components that change, the events that say so and, for a policy, its
version, in one number of a :class:`deltas.Deltas` store: an approval writes one row, and one
that fails half way leaves nothing behind that anybody sees. A second writer of the same
number is refused.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import policy as pl
from . import trust
from .deltas import Conflict, Deltas, Table

HASHES = ("raw_hash", "canonical_hash", "semantic_fingerprint")
STATE = "component_id string, name string, kind string, source_path string, raw_hash string, canonical_hash string, semantic_fingerprint string, content string, state string, version int, source_valid boolean, action string, approval_id string"
EVENT = "component_id string, event_type string, sequence long, version int, raw_hash string, canonical_hash string, semantic_fingerprint string, approval_id string, reason string"
POLICY = "version int, policy string, timestamp string"
TABLES = {"state": Table(STATE, ("component_id",)), "events": Table(EVENT), "policies": Table(POLICY, ("version",))}
#: Events by what a reconciliation shows.
EVENTS = {"NEW": "DISCOVERED", "CHANGED": "VERSION_CHANGED", "VANISHED": "SOURCE_UNAVAILABLE"}


class Catalogue:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Deltas(spark, path, TABLES)

    def head(self) -> int:
        """The number of the last commit, 0 before the first."""
        return self.store.head()

    def current(self) -> DataFrame:
        """The components as they are now."""
        return self.store.read("state")

    def events(self) -> DataFrame:
        return self.store.read("events")

    def policies(self) -> DataFrame:
        """All versions of the policy; the current one is the largest."""
        return self.store.read("policies")

    def _commit(self, state: DataFrame, events: DataFrame, **more: DataFrame) -> int:
        """``state`` has the components that change."""
        at = self.head()
        return self.store.commit({"state": state, "events": events.withColumn("sequence", F.lit(at + 1)), **more}, at)

    def discover(self, files: DataFrame, policy: dict = pl.POLICY, scope: Column | None = None) -> int:
        """Take in files (path, content): new and changed components get versions, those that are gone lose their approval.

        ``scope`` is a condition on source_path outside of which components are left alone; a file
        with an error counts as gone. Returns the commit's number.
        """
        now = self.current()
        inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
        old = now.filter(inside)
        found = trust.reconciled(old.drop("action", "approval_id", "name", "kind"), trust.discovered(files), policy)
        kept = old.select("component_id", F.col("action").alias("_action"), F.col("approval_id").alias("_approval"), F.col("name").alias("_name"), F.col("kind").alias("_kind"))
        rows = found.join(kept, "component_id", "left")
        same = F.col("outcome") == "UNCHANGED"
        values = {h: F.coalesce(h, f"old_{h}") for h in (*HASHES, "content")} | {"name": F.coalesce("name", "_name"), "kind": F.coalesce("kind", "_kind"), "action": F.coalesce("action", "_action"), "approval_id": F.when(same, F.col("_approval"))}
        rows = rows.withColumns(values)
        names = [x.split()[0] for x in STATE.split(", ")]
        kind = F.element_at(F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair]), F.col("outcome"))
        events = rows.filter(~same).select("component_id", kind.alias("event_type"), "version", *HASHES, F.lit(None).cast("string").alias("approval_id"), F.col("change_type").alias("reason"))
        return self._commit(rows.select(*names).subtract(old.select(*names)), events)

    def refresh(self, path: str, files: DataFrame, policy: dict = pl.POLICY) -> int:
        """:meth:`discover` for one source."""
        return self.discover(files.filter(F.col("path") == path), policy, F.col("source_path") == path)

    def approve(self, component_id: str, canonical_hash: str, version: int, approver: str, approval_id: str, timestamp: str) -> int:
        """Approve exactly this content and version; anything else is refused."""
        approval, state = trust.approve(self.current(), component_id, canonical_hash, version, approver, approval_id, timestamp)
        mine = state.filter(F.col("component_id") == component_id)
        return self._commit(mine, approval.select("component_id", F.lit("APPROVED").alias("event_type"), "version", *HASHES, "approval_id", F.lit(None).cast("string").alias("reason")))

    def withdraw(self, component_id: str, state: str, reason: str) -> int:
        """REVOKED or QUARANTINED, with the reason."""
        now = trust.set_state(self.current(), component_id, state, reason)
        mine = now.filter(F.col("component_id") == component_id)
        return self._commit(mine, mine.select("component_id", F.lit(state).alias("event_type"), "version", *HASHES, F.lit(None).cast("string").alias("approval_id"), F.lit(reason).alias("reason")))

    def new_policy(self, policy: dict = pl.POLICY, timestamp: str = "") -> int:
        """Store the next version of the policy, take every approval back and say so in the log, in one commit.

        What ``policy`` doesn't name stays as it is; if it names the version that it was made from, that must be the current one.
        """
        history = self.policies()
        last = trust.current_policy(history).first()
        if last and policy.get("version", last["version"]) != last["version"] and policy is not pl.POLICY:
            raise Conflict("the policy has changed")
        row = trust.next_policy(history, (json.loads(last["policy"]) if last else {}) | policy, timestamp)
        none = F.lit(None).cast("string")
        told = row.select(none.alias("component_id"), F.lit("POLICY_CHANGED").alias("event_type"), "version", *[none.alias(h) for h in HASHES], none.alias("approval_id"), F.col("policy").alias("reason"))
        return self._commit(trust.under_new_policy(self.current().filter("state = 'APPROVED'")), told, policies=row)

    def policy_violations(self) -> DataFrame:
        """Versions of the policy that the log doesn't tell of, or tells of otherwise."""
        told = self.events().filter("event_type = 'POLICY_CHANGED'").select("version", F.col("reason").alias("policy"))
        return trust.policy_violations(self.policies(), told)

    def violations(self) -> DataFrame:
        """Components that aren't what their last event says."""
        return trust.snapshot_integrity(self.current().filter("source_valid"), self.events()).filter("integrity IS NOT NULL").select("component_id", "integrity")
