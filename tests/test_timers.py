"""Keyed timers against a fold over each path's rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from inkwarden.streaming import timers

SCHEMA = "path string, at timestamp, seq long, cancel boolean, sha256 string, error string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def changes(seed, n=300, paths=7):
    rng, at, out = random.Random(seed), 0, []
    for k in range(n):
        at += rng.choice([0, 1, 200, 400, 750, 1500, 3000, 4000])
        error = rng.choice([None, None, None, "SCAN_UNAVAILABLE", "INPUT_SIZE_LIMIT"])
        out.append((rng.choice([None, *(f"/in/{p}" for p in range(paths))]), START + timedelta(milliseconds=at), k, rng.random() < 0.15, None if error else rng.choice(["a", "b", None]), error))
    return out


def fold(rows, until, debounce=750, retry=3000):
    """A list of moments instead of a state: each window is looked up among the rows that follow it."""
    out = []
    for path in {r[0] for r in rows}:
        mine = sorted([(round((r[1] - START).total_seconds() * 1000), *r[2:]) for r in rows if r[0] == path])
        k, generation, known = 0, 0, None
        while k < len(mine):
            at, _, cancel, sha, error = mine[k]
            if cancel:
                generation, k = generation + 1, k + 1
                continue
            due, n, stopped = at + debounce, 1, None
            while k + n < len(mine) and mine[k + n][0] < due:
                if mine[k + n][2]:
                    stopped = mine[k + n][0]
                    break
                sha, error = mine[k + n][3:]
                n += 1
            k += n
            if stopped is not None:
                out.append((path, "CANCELLED", stopped, sha, error, generation, n))
                continue
            if due > until:
                break
            if error is None:
                out.append((path, "SKIP" if known == (sha,) else "SCAN", due, sha, None, generation, n))
                known = (sha,)
            else:
                out.append((path, "FAILED", due, sha, error, generation, n))
                known = None
                after = mine[k][0] if k < len(mine) else None
                if error == "SCAN_UNAVAILABLE" and due + retry <= until and (after is None or after >= due + retry):
                    out.append((path, "RETRY", due + retry, sha, error, generation, 0))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,files,restart", [(1, 1, False), (2, 6, False), (3, 6, True)])
def test_actions_equal_a_fold(spark, tmp_path, seed, files, restart):
    """Whatever the batches and restarts; decisions fall as far as the watermark has come."""
    rows = changes(seed)
    size = -(-len(rows) // files)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"f{k}"))
        next((tmp_path / f"f{k}").glob("part-*")).rename(tmp_path / "in" / f"{k}.parquet")
        if restart or k == files - 1:
            timers.run(stream, str(tmp_path / "out"), str(tmp_path / "state"), "context", late="1 millisecond")
    until = round((rows[-1][1] - START).total_seconds() * 1000) - 2  # before the watermark
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("path", "action", "unix_millis(at) as at", "sha256", "error", "generation", "changes").collect()
    begin = round(START.timestamp() * 1000)
    want = fold(rows, until)
    assert sorted(((r.path, r.action, r.at - begin, r.sha256, r.error, r.generation, r.changes) for r in got), key=repr) == want
    assert {w[1] for w in want} == {"SCAN", "SKIP", "FAILED", "RETRY", "CANCELLED"}


def test_a_new_context_makes_old_inspections_stale():
    first = timers.Schedule("p", None, "old", 750, 3000)
    first.change(0, "a", None)
    first.settle(10_000)
    again, changed = (timers.Schedule("p", dict(first.s), c, 750, 3000) for c in ("old", "new"))
    for s in (again, changed):
        s.change(20_000, "a", None)
        s.settle(30_000)
    assert [o[1] for s in (first, again, changed) for o in s.out] == ["SCAN", "SKIP", "SCAN"]
    assert again.next() is None


def test_a_stream_of_writes_does_not_postpone_an_inspection():
    s = timers.Schedule("p", None, "c", 750, 3000)
    for k in range(100):
        s.change(k * 100, f"v{k}", None)
    assert [(o[1], o[2].value // 10**6, o[6]) for o in s.out][:2] == [("SCAN", 750, 8), ("SCAN", 1550, 8)]
