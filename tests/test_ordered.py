"""Running totals, limits and percentiles against plain loops; one key with all rows is several tasks."""

import math
import random
from collections import defaultdict, deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from inkwarden.operators import ordered

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(autouse=True)
def several_partitions(spark):
    """Small partitions are put together by adaptive execution, which would hide what is tested."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(params=["many", "one", "few"])
def rows(request):
    rng = random.Random(4)
    keys = {"many": [None, *(f"k{k}" for k in range(40))], "one": ["hot"], "few": ["hot"] * 30 + [None, "cold"]}[request.param]
    return [(k, rng.choice(keys), rng.choice([None, 0, *range(1, 50)]), START + timedelta(seconds=rng.randrange(4000))) for k in range(3000)]


SCHEMA = "id long, key string, size long, ts timestamp"


@pytest.fixture
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def by_key(rows, order):
    out = defaultdict(list)
    for r in sorted(rows, key=order):
        out[r[1]].append(r)
    return out


def test_running(frame, rows):
    got = {r.id: (r.place, r.size_before) for r in ordered.running(frame, ["key"], ["id"], size=F.col("size")).collect()}
    want = {}
    for own in by_key(rows, lambda r: r[0]).values():
        total = 0
        for k, r in enumerate(own):
            want[r[0]] = (k + 1, total)
            total += r[2] or 0
    assert got == want


def test_a_hot_key_is_several_tasks(spark):
    df = spark.range(20_000).select("id", F.lit("hot").alias("key"))
    parts = ordered.ranged(df, ["key"], ["id"]).groupBy("_part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 20_000
    got = ordered.running(df, [], ["id"], n=F.lit(1))
    assert got.filter("place <> id + 1 or n_before <> id").isEmpty() and got.count() == 20_000


@pytest.mark.parametrize("most", [-1, 0, 700, 10**9])
def test_abort(frame, rows, most):
    got = {r.key: (r.rows, r.bytes, r.over_id) for r in ordered.aborted(frame, ["key"], ["id"], F.col("size"), most).collect()}
    want = {}
    for key, own in by_key(rows, lambda r: r[0]).items():
        total, n, over = 0, 0, None
        for r in own:
            if total + (r[2] or 0) > most:
                over = r[0]
                break
            total, n = total + (r[2] or 0), n + 1
        want[key] = (n, total, over)
    assert got == want


def test_calls_within(frame, rows):
    got = {r.id: r.calls for r in ordered.calls_within(frame, "key", "ts", 60).collect()}
    own = by_key(rows, lambda r: r[3])
    assert got == {r[0]: sum(timedelta(0) <= r[3] - x[3] <= timedelta(seconds=60) for x in own[r[1]]) for r in rows}


@pytest.mark.parametrize("most,seconds", [(1, 60), (5, 100), (60, 60), (3, 4000)])
def test_accepted_calls_only(frame, rows, most, seconds):
    got = {r.id: r.accepted for r in ordered.accepted(frame, ["key"], "ts", ["id"], most, seconds).collect()}
    want = {}
    for own in by_key(rows, lambda r: (r[3], r[0])).values():
        times = deque()
        for r in own:
            while times and times[0] < r[3] - timedelta(seconds=seconds):
                times.popleft()
            want[r[0]] = len(times) < most
            if want[r[0]]:
                times.append(r[3])
    assert got == want


def test_accepted_of_nothing_and_of_calls_without_a_time(spark):
    assert ordered.accepted(spark.createDataFrame([], SCHEMA), ["key"], "ts", ["id"]).count() == 0
    got = ordered.accepted(spark.createDataFrame([(1, "a", 0, None), (2, "a", 0, START)], SCHEMA), ["key"], "ts", ["id"]).collect()
    assert {r.id: r.accepted for r in got} == {1: False, 2: True}


@pytest.mark.parametrize("values", [[3.5], [1.0] * 50, [float(k) for k in range(1000)], [1e308, -1e308, 5e-324, 0.0, -0.0, 1e-300, 2e-300], [None, 2.0, float("nan"), 1.0], [], [None], [float("nan")] * 3, [math.ldexp(1, -k) for k in range(60)]])
@pytest.mark.parametrize("bins", [4096, 3])
def test_percentiles(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = ordered.percentiles(df, "v", shares, bins)
    some = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    for name, share in shares.items():
        want = some[max(1, math.ceil(share * len(some))) - 1] if some else None
        assert got[name] == want or (want is not None and math.isnan(want) and math.isnan(got[name]))
