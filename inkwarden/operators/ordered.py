"""Running totals, places and limits along an order, with no key in one task.

Rows are ranged over partitions by key and order, so that a key with all rows is as
many partitions as any other data of that size. What a partition holds of a key is summed
up in one row; prefix sums of those rows say what lies before each partition, and prefix
sums inside a partition say the rest. The order must tell all rows of a key apart, or
rows of one place count in any order.

The ranged rows are a checkpoint in ``spark.checkpoint.dir``: later steps read the same
partitions, whichever executor is lost.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator
from functools import reduce
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _checkpoint(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(top or tempfile.mkdtemp(prefix="ckpt-"))
    return df.select("*").checkpoint()


def ranged(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` ranged over partitions by key and order and sorted in them, with the number of its partition in ``_part``."""
    keys = [F.col(c) for c in (*by, *order)]
    return _checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"_k_{c}"]) for c in names))


def running(df: DataFrame, by: list[str], order: list[str], **values: Column) -> DataFrame:
    """``df`` with ``place`` (from 1 on) of each row of its key and, for each of ``values``, ``<name>_before``: the sum over the rows of the key before it."""
    rows = ranged(df.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in values.items()}), by, order)
    sums = {"_n": F.count("*"), **{f"_s_{n}": F.sum(f"_v_{n}") for n in values}}
    parts = rows.groupBy(*by, "_part").agg(*[c.alias(n) for n, c in sums.items()])
    # A row for each key and partition: as many as there are of both, and a key's in one task.
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_part").alias("_k_part"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o{n}") for n in sums])
    inside = Window.partitionBy("_part", *by).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"_place": F.row_number().over(inside), **{f"_b_{n}": F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)) for n in values}})
    both = placed.join(offsets, (placed["_part"] == offsets["_k_part"]) & _same(placed, offsets, by) if by else placed["_part"] == offsets["_k_part"])
    out = {"place": (F.col("_place") + F.col("_o_n")).cast("long"), **{f"{n}_before": F.col(f"_b_{n}") + F.col(f"_o_s_{n}") for n in values}}
    return both.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def within_budget(df: DataFrame, by: list[str], order: list[str], length: Column, most: int) -> DataFrame:
    """``df`` with ``total`` (of its key up to and with the row) and ``admitted``: whether it comes before the first row whose total is over ``most``.

    Lengths that are null count 0; lengths aren't negative, so totals rise and every
    row behind that first one is over, too.
    """
    rows = running(df, by, order, _length=length)
    total = F.col("_length_before") + F.coalesce(length, F.lit(0))
    return rows.withColumn("total", total.cast("long")).withColumn("admitted", F.col("total") <= most).drop("_length_before", "place")


def aborted(df: DataFrame, by: list[str], order: list[str], length: Column, most: int) -> DataFrame:
    """A row for each key: how many rows and bytes are admitted, and the first row over ``most`` (its order, null if none is)."""
    rows = within_budget(df, by, order, length, most)
    over = ~F.col("admitted")
    first = F.min(F.when(over, F.struct(*order))).alias("_first")
    done = rows.groupBy(*by).agg(F.count_if("admitted").alias("rows"), F.coalesce(F.max(F.when(F.col("admitted"), F.col("total"))), F.lit(0)).cast("long").alias("bytes"), first)
    return done.select(*by, "rows", "bytes", *[F.col(f"_first.{c}").alias(f"over_{c}") for c in order])


def calls_within(calls: DataFrame, by: str, ts: str, seconds: int = 60) -> DataFrame:
    """``calls`` with how many calls its key made in the ``seconds`` (whole) up to each, itself included, as a difference of two running counts."""
    boxed = _checkpoint(calls.select(F.struct(*[F.col(c) for c in calls.columns]).alias("_row"), F.col(by).alias("_key"), F.unix_seconds(F.col(ts).cast("timestamp")).alias("_s"), F.monotonically_increasing_id().alias("_id")))
    marks = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("_s") - back).alias("s")) for k, back in ((0, seconds), (1, 0), (2, 0))])
    # kind 0 counts what is older than the window, 1 is a call, 2 counts all up to its second.
    points = boxed.select("_key", "_id", F.explode(marks).alias("m")).select("_key", "_id", "m.kind", "m.s")
    counted = running(points, ["_key"], ["s", "kind", "_id"], calls=(F.col("kind") == 1).cast("long"))
    each = counted.filter("kind <> 1").groupBy("_id").agg(F.sum(F.when(F.col("kind") == 2, F.col("calls_before")).otherwise(-F.col("calls_before"))).alias("calls"))
    return boxed.join(each, "_id").select("_row.*", "calls")


#: How many calls are accepted in how many seconds.
MOST_CALLS, CALL_SECONDS = 60, 60


def accepted(calls: DataFrame, by: list[str], ts: str, order: list[str], most: int = MOST_CALLS, seconds: int = CALL_SECONDS) -> DataFrame:
    """``calls`` with ``accepted``: whether fewer than ``most`` accepted calls of its key lie in the ``seconds`` up to it; refused ones don't count.

    Whether a call is accepted hangs on those before it, so a block of calls needs to know
    the last ``most`` accepted ones before the block. All blocks are folded at once, at first as if there
    were none; a block whose predecessor ends otherwise than it was told is folded again,
    until all agree. A pause of ``seconds`` inside a block forgets what came in, so that
    this ends after two rounds mostly; a key that is refused without pause takes as many as it
    has blocks at worst, and never more than one block in a task. The driver holds
    ``most`` times for each block.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    key = F.to_json(F.array(*[F.col(c).cast("string") for c in by]))
    rows = ranged(calls.withColumn("_ts", micros), by, ["_ts", *order]).withColumn("_key", key)
    span = seconds * 1_000_000

    def fold(key: str, at: int | None, state: dict) -> bool:
        if key != state["key"]:
            state.update(key=key, times=deque())
        if at is None:
            return False
        times = state["times"]
        while times and times[0] < at - span:
            times.popleft()
        if len(times) >= most:
            return False
        times.append(at)
        return True

    def start(told: dict, part: int) -> dict:
        key, times = told.get(part, (None, ()))
        return {"key": key, "times": deque(times)}

    def ends(told: dict):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, part, first = None, None, None
            for b in batches:
                for p, k, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if state is None:
                        state, part, first = start(told, p), p, k
                    fold(k, at, state)
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([state["key"]]), pa.array([list(state["times"])], pa.list_(pa.int64()))], names=["part", "first", "last", "times"])

        return run

    told: dict[int, tuple] = {}
    known: dict[int, tuple] = {}
    asked = None
    while True:
        some = rows if asked is None else rows.filter(F.col("_part").isin(asked))
        for r in some.select("_part", "_key", "_ts").mapInArrow(ends(told), "part int, first string, last string, times array<long>").collect():
            known[r["part"]] = (r["first"], r["last"], tuple(r["times"]))
        fresh, before = {}, None
        for part in sorted(known):
            if before is not None and known[before][1] == known[part][0] and known[before][2]:
                fresh[part] = known[before][1:]
            before = part
        asked = sorted(p for p in known if fresh.get(p) != told.get(p))
        told = fresh
        if not asked:
            break

    names = calls.columns
    schema = rows.drop("_part", "_key", "_ts").schema.add("accepted", "boolean")

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            cols = {n: b.column(n) for n in ("_part", "_key", "_ts")}
            out = []
            for p, k, at in zip(*(c.to_pylist() for c in cols.values()), strict=True):
                state = start(told, p) if state is None else state
                out.append(fold(k, at, state))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.bool_())], names=[*names, "accepted"])

    return rows.mapInArrow(flags, schema)


BINS = 4096


def percentiles(df: DataFrame, value: str, shares: dict[str, float], bins: int = BINS) -> dict[str, float | None]:
    """The values at nearest ranks, exactly: a value is counted into ``bins`` equal bins between the least and the largest, and the bin with the rank is cut again, until it has one value.

    A pass is one scan for all ranks with ``bins`` counters each, however many values
    there are. Bins rise with the values, whatever is rounded, and a bin's least and largest
    value are in different bins of the next pass. Nulls don't count; NaN is the largest value.
    """
    v = F.col(value).cast("double")
    plain = ~F.isnan(v)
    n, least, most, every = df.agg(F.count_if(plain), F.min(F.when(plain, v)), F.max(F.when(plain, v)), F.count(v)).first()
    out: dict[str, float | None] = dict.fromkeys(shares)
    targets = []
    for name, share in shares.items():
        rank = max(1, ceil(share * every))
        if every:
            out[name] = float("nan")
        if every and rank <= n:
            targets.append((name, rank, least, most))
    while targets:
        for name, _, lo, hi in targets:
            if lo == hi:
                out[name] = lo
        targets = [t for t in targets if t[2] < t[3]]
        if not targets:
            break

        def part(lo: float, hi: float) -> Column:
            return (v - F.lit(lo)) / F.lit(hi - lo) if hi - lo < float("inf") else (v / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)

        ranges = F.array(*[F.when(v.between(lo, hi), F.struct(F.lit(k).alias("t"), F.least(F.floor(part(lo, hi) * (bins - 1)), F.lit(bins - 1)).alias("bin"))) for k, (_, _, lo, hi) in enumerate(targets)])
        counts = df.filter(plain).select(v.alias("v"), F.explode(F.array_compact(ranges)).alias("x")).groupBy("x.t", "x.bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        found = sorted(tuple(r) for r in counts.collect())
        narrowed = []
        for k, (name, rank, _, _) in enumerate(targets):
            for t, _, count, lo, hi in found:
                if t == k:
                    if rank <= count:
                        narrowed.append((name, rank, lo, hi))
                        break
                    rank -= count
        targets = narrowed
    return out


def as_row(spark: SparkSession, values: dict[str, float | None]) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} double" for n in values))
