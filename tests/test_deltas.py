"""The delta store against a dictionary, with competing writers, and what stands on it."""

import os
import random

import pytest
from pyspark.sql import functions as F

from inkwarden.operators import registry
from inkwarden.operators.deltas import Conflict, Deltas, Table

TABLES = {"t": Table("k string, v long", ("k",)), "b": Table("k string, v long", ("k",), True), "log": Table("k string, v long")}


def rows(spark, values, gone=()):
    return spark.createDataFrame([(k, v, False) for k, v in values] + [(k, None, True) for k in gone], "k string, v long, _gone boolean")


def read(store, name, **kw):
    return sorted(map(tuple, store.read(name, **kw).collect()), key=repr)


def test_commits_equal_a_dictionary(spark, tmp_path, monkeypatch):
    rng, store, known, log, history = random.Random(1), Deltas(spark, str(tmp_path / "s"), TABLES), {}, [], {}
    assert store.head() == 0 and read(store, "t") == [] and read(store, "log") == []
    for k in range(7):
        new = {rng.choice([None, *map(str, range(12))]): rng.randrange(99) for _ in range(5)}
        gone = [x for x in known if x not in new and rng.random() < 0.3]
        batch = rows(spark, new.items(), gone)
        at = store.commit({"t": batch, "b": batch, "log": rows(spark, new.items())})
        known = {x: v for x, v in {**known, **new}.items() if x not in gone}
        log += new.items()
        history[at] = dict(known)
        if k == 3:
            store.compact()
    for name in ("t", "b"):
        assert read(store, name) == sorted(known.items(), key=repr)
    assert read(store, "log") == sorted(log, key=repr)
    assert all(read(store, "t", commit=at) == sorted(then.items(), key=repr) for at, then in history.items())
    before = {n: read(store, n) for n in TABLES}
    store.compact()
    assert before == {n: read(store, n) for n in TABLES} and store._state(store.head())["t"]["deltas"] == []
    # Many changed keys go by a join.
    monkeypatch.setattr("inkwarden.operators.deltas.BROADCAST_ROWS", 0)
    store.commit({"t": rows(spark, [("3", -1)])})
    assert dict(read(store, "t"))["3"] == -1


def test_a_second_writer_is_refused(spark, tmp_path):
    one, two = (Deltas(spark, str(tmp_path), TABLES) for _ in range(2))
    at = one.commit({"t": rows(spark, [("a", 1)])})
    two.commit({"t": rows(spark, [("b", 2)])}, at)
    with pytest.raises(Conflict):
        one.commit({"t": rows(spark, [("b", 3)]), "log": rows(spark, [("b", 3)])}, at)
    assert read(one, "t") == [("a", 1), ("b", 2)] and read(one, "log") == []
    os.remove(tmp_path / "hint")
    assert one.head() == 2
    with pytest.raises(ValueError):
        one.commit({"t": rows(spark, [("c", 1), ("c", 2)])})
    assert one.head() == 2


def test_commits_are_compacted_by_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("inkwarden.operators.deltas.MOST", 3)
    store = Deltas(spark, str(tmp_path), TABLES)
    for k in range(6):
        store.commit({"t": rows(spark, [(str(k), k)])})
    assert len(store._state(store.head())["t"]["deltas"]) <= 3 and read(store, "t") == [(str(k), k) for k in range(6)]


def test_lookup_reads_the_folders_of_its_keys(spark, tmp_path):
    store = Deltas(spark, str(tmp_path), TABLES)
    store.commit({"b": rows(spark, [(str(k), k) for k in range(500)])})
    wanted = rows(spark, [("7", 0), ("400", 0), ("nowhere", 0)])
    found = store.lookup("b", wanted)
    assert {"7", "400"} <= {r.k for r in found.collect()} and found.count() < 100
    assert store.lookup("b", wanted, few=1).count() == 500


def test_content_comes_once(spark, tmp_path):
    store = registry.ContentStore(spark, str(tmp_path), "id long, sha256 string, size long")
    frame = lambda *v: spark.createDataFrame([(i, s, 0) for i, s in v], "id long, sha256 string, size long")
    store.append(frame((5, "a"), (3, "a"), (4, "b"), (9, None)))
    store.append(frame((1, "a"), (2, "c"), (8, None)))
    store.append(frame((1, "a"), (2, "c")))
    assert sorted((r.id, r.sha256) for r in store.reports().collect()) == [(2, "c"), (3, "a"), (4, "b"), (9, None)]


def test_policy_versions_demotions_and_event_are_one_commit(spark, tmp_path):
    from inkwarden.operators.catalogue import STATE, Catalogue

    c = Catalogue(spark, str(tmp_path))
    names = [x.split()[0] for x in STATE.split(", ")]
    of = lambda i, state: tuple({"component_id": i, "state": state, "version": 1, "source_valid": True, "action": "ALLOW", "approval_id": "x"}.get(n) for n in names)
    c.store.commit({"state": spark.createDataFrame([of("a", "APPROVED"), of("b", "BLOCKED")], STATE)})
    at = c.new_policy({"scan_flag_score": 7}, "now")
    assert [(r.version, r.timestamp) for r in c.policies().collect()] == [(1, "now")] and c.policy_violations().count() == 0
    assert {r.component_id: (r.state, r.approval_id) for r in c.current().collect()} == {"a": ("REAPPROVAL_REQUIRED", None), "b": ("BLOCKED", "x")}
    assert [(r.event_type, r.version, r.sequence) for r in c.events().collect()] == [("POLICY_CHANGED", 1, at)]
    written = c.store.spark.read.parquet(c.store._state(at)["state"]["deltas"][-1]["folder"]).count()
    assert written == 1  # the approved one, whatever the catalogue holds
    with pytest.raises(ValueError):
        c.new_policy({"scan_flag_score": 99})
    c.new_policy({"scan_block_score": 95, "version": 1})
    with pytest.raises(Conflict):
        c.new_policy({"scan_block_score": 96, "version": 1})
    assert c.policies().filter("version = 2").selectExpr("get_json_object(policy, '$.scan_flag_score') as f", "get_json_object(policy, '$.scan_block_score') as b").first() == ("7", "95")
    c.store.commit({"policies": c.policies().filter("version = 1").withColumn("policy", F.lit("{}"))})
    assert [r.version for r in c.policy_violations().collect()] == [1]
