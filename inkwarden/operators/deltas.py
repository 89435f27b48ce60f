"""Tables kept as commits of what has changed: merge on read, deletions as tombstones, compaction.

A commit writes the rows that it changes, of any of the store's tables, as files of its own,
and then one small file with its number, which says what each table is made of. That file is created and
never replaced: of two writers with one number the second is refused, and what it wrote is
seen by nobody. So several tables change at once or not at all, and an append costs what it
brings, whatever the store holds.

A keyed table is its base, without the keys that later commits have, and of those the newest
rows. Few changed keys are broadcast, as their number is known, so that the base isn't
shuffled; many meet it by a join. A table without a key is all its rows. Compaction writes a
table anew as a base; nobody who reads sees a difference. It follows a commit by itself
when ``MOST`` commits are behind the base, so that a reader opens that many folders at most.

Keyed tables are partitioned by a hash of the key into ``BUCKETS`` folders if they are asked to be;
:meth:`Deltas.lookup` then reads the folders that its few keys lie in, and no others.

Cases: null keys are keys of their own; a commit of an empty frame changes nothing and is a
commit; rows with one key in one commit are refused; a table that was never written is empty.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST, BUCKETS = 16, 32
BROADCAST_ROWS = 100_000
GONE = "_gone"


class Conflict(RuntimeError):
    """Another writer was first."""


@dataclass(frozen=True)
class Table:
    schema: str
    keys: tuple[str, ...] = ()
    bucketed: bool = False

    @property
    def names(self) -> list[str]:
        return [x.strip().split()[0] for x in self.schema.split(",")]


class Deltas:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables

    # ---- commits

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _told(self, name: str) -> dict | None:
        path, fs = self._file(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value: dict, anew: bool) -> bool:
        path, fs = self._file(name)
        try:
            out = fs.create(path, anew)
        except Exception as e:
            if not anew and "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        return True

    def head(self) -> int:
        """The number of the last commit, 0 before the first; ``hint`` is only where the search begins."""
        at = (self._told("hint") or {"commit": 0})["commit"]
        while True:
            path, fs = self._file(f"commits/{at + 1}")
            if not fs.exists(path):
                return at
            at += 1

    def _state(self, commit: int) -> dict:
        return (self._told(f"commits/{commit}") if commit else None) or {name: {"base": None, "deltas": []} for name in self.tables}

    # ---- reading

    def _bucket(self, t: Table) -> Column:
        return F.pmod(F.xxhash64(F.to_json(F.array(*[F.col(k).cast("string") for k in t.keys]))), F.lit(BUCKETS)).cast("int")

    def _folders(self, t: Table, folders: list[str], buckets: list[int] | None, gone: bool) -> DataFrame:
        schema = t.schema + (f", {GONE} boolean, _commit long" if gone else "") + (", _bucket int" if t.bucketed else "")
        if not folders:
            return self.spark.createDataFrame([], schema)
        if t.bucketed:
            parts = [self.spark.read.schema(schema).option("basePath", f).parquet(f) for f in folders]
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            return rows.filter(F.col("_bucket").isin(buckets)) if buckets is not None else rows
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self, name: str, commit: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table as of a commit, the last one if none is named."""
        t, of = self.tables[name], self._state(self.head() if commit is None else commit)[name]
        base = self._folders(t, [of["base"]] if of["base"] else [], buckets, False).select(*t.names)
        if not of["deltas"]:
            return base
        changed = self._folders(t, [d["folder"] for d in of["deltas"]], buckets, True)
        if not t.keys:
            return base.unionByName(changed.select(*t.names))
        newest = changed.groupBy(*t.keys).agg(F.max_by(F.struct(*[c for c in (*t.names, GONE) if c not in t.keys]), "_commit").alias("_r"))
        newest = newest.select(*t.keys, "_r.*")
        few = sum(d["rows"] for d in of["deltas"]) <= BROADCAST_ROWS
        keys = changed.select(*[F.col(k).alias(f"_k_{k}") for k in t.keys]).distinct()
        same = F.lit(True)
        for k in t.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        left = base.join(F.broadcast(keys) if few else keys, same, "left_anti")
        return left.unionByName(newest.filter(~F.col(GONE)).select(*t.names))

    def lookup(self, name: str, wanted: DataFrame, few: int = 10_000) -> DataFrame:
        """The table's rows that may have the keys of ``wanted``: those of their folders if there are few keys."""
        t = self.tables[name]
        some = wanted.select(self._bucket(t).alias("b")).limit(few + 1)
        buckets = None
        if t.bucketed and some.count() <= few:
            buckets = [r["b"] for r in some.distinct().collect()]  # at most BUCKETS
        return self.read(name, buckets=buckets)

    # ---- writing

    def _write(self, t: Table, rows: DataFrame, folder: str) -> None:
        if t.bucketed:
            # Small folders have a file each, large ones as many as they need.
            rows = rows.withColumn("_bucket", self._bucket(t)).hint("rebalance", F.col("_bucket"))
            rows.write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        else:
            rows.write.mode("overwrite").parquet(folder)

    def _named(self, t: Table, rows: DataFrame) -> DataFrame:
        kinds = {x.strip().split()[0]: x.strip().split()[1] for x in t.schema.split(",")}
        return rows.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], *([GONE] if GONE in rows.columns else [F.lit(False).alias(GONE)]))

    def commit(self, changes: dict[str, DataFrame], at: int | None = None) -> int:
        """Write ``changes`` (rows, with ``_gone`` true for keys that go) behind commit ``at``, the last if none is named; its number."""
        at = self.head() if at is None else at
        state, number = self._state(at), at + 1
        for name, rows in changes.items():
            t, folder = self.tables[name], f"{self.path}/{name}/{number}-{uuid.uuid4().hex}"
            self._write(t, self._named(t, rows).withColumn("_commit", F.lit(number).cast("long")), folder)
            stored = self._folders(t, [folder], None, True)
            n = stored.count()
            if t.keys and n != stored.select(*t.keys).distinct().count():
                raise ValueError(f"{name}: a key comes twice in one commit")
            state[name] = state[name] | {"deltas": [*state[name]["deltas"], {"folder": folder, "rows": n}]}
        if not self._put(f"commits/{number}", state, False):
            raise Conflict(f"commit {number} is another writer's")
        self._put("hint", {"commit": number}, True)
        if any(len(state[name]["deltas"]) > MOST for name in changes):
            return self.compact([name for name in changes if len(state[name]["deltas"]) > MOST])
        return number

    def compact(self, names: list[str] | None = None) -> int:
        """Write tables anew, each as a base; what is read stays the same."""
        at = self.head()
        state, number = self._state(at), at + 1
        for name in names or self.tables:
            folder = f"{self.path}/{name}/{number}-base-{uuid.uuid4().hex}"
            self._write(self.tables[name], self.read(name, at), folder)
            state[name] = {"base": folder, "deltas": []}
        if not self._put(f"commits/{number}", state, False):
            raise Conflict(f"commit {number} is another writer's")
        self._put("hint", {"commit": number}, True)
        return number
