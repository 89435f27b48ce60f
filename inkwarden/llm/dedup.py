"""Exact dedup with a cuckoo-filter index of live digests.

A text's digest is the SHA-256 of its UTF-8 bytes. Every task keeps a
:class:`CuckooIndex`: a digest is looked up in the filter, a hit is verified
against the full digests of that bucket, a miss is inserted; a filter that
overflows is rebuilt at twice the size from the stored keys. In the first pass
each partition folds its own rows, so that a group that holds a third of all
rows leaves a task as one row; an index that reaches ``max_live`` digests hands
them on and deletes them. In the second pass the folded rows meet by digest, a
bucket of digests at a time, and every group comes out once.

Groups with at least 1/``HOT_SHARE`` of all rows, of which there can be no more
than ``HOT_SHARE``, reach the rows by broadcast, the others by a join on the digest.

Cases: a null text counts as empty; a very long text is its digest like any other;
a null id is smaller than any id; of rows that are the same in id and text, one
stays; an empty table gives an empty result; columns of ``docs`` are boxed, so
their names clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, cut_lineage, shuffle_parts, tidily, unboxed

HOT_SHARE = 10_000
SCHEMA = "digest binary, keep_id long, keep_uid long, group_size long"
_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64())])


class CuckooIndex:
    """A cuckoo filter over SHA-256 digests with the digests themselves beside it, in buckets.

    Slots hold 16-bit fingerprints, four to a bucket. ``content`` has, for each
    fingerprint and unordered pair of buckets, the entries [digest, best, count].
    """

    SLOTS = 4
    KICKS = 200

    def __init__(self, buckets: int = 1024):
        self._start(buckets)
        self.content: dict[tuple[int, int], list[list]] = {}
        self.live = 0

    def _start(self, buckets: int) -> None:
        self.n = buckets
        self.table: list[list[int]] = [[] for _ in range(buckets)]

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(digest[10:12], "little") or 1
        i = int.from_bytes(digest[2:10], "little") & (self.n - 1)
        return fp, i, i ^ (fp * 0x5BD1E995 & (self.n - 1))

    def _put(self, fp: int, i: int, j: int) -> bool:
        for b in (i, j):
            if len(self.table[b]) < self.SLOTS:
                self.table[b].append(fp)
                return True
        b = i
        for k in range(self.KICKS):
            row = self.table[b]
            row[k % self.SLOTS], fp = fp, row[k % self.SLOTS]
            b ^= fp * 0x5BD1E995 & (self.n - 1)
            if len(self.table[b]) < self.SLOTS:
                self.table[b].append(fp)
                return True
        return False

    def _resize(self) -> None:
        entries = [e for es in self.content.values() for e in es]
        n = self.n
        while True:
            n *= 2
            self._start(n)
            if all(self._put(*self._place(e[0])) for e in entries):
                break
        self.content = {}
        for e in entries:
            fp, i, j = self._place(e[0])
            self.content.setdefault((fp, min(i, j)), []).append(e)

    def find(self, digest: bytes) -> list | None:
        fp, i, j = self._place(digest)
        if fp not in self.table[i] and fp not in self.table[j]:
            return None
        return next((e for e in self.content.get((fp, min(i, j)), ()) if e[0] == digest), None)

    def insert(self, digest: bytes, best: tuple, count: int = 1) -> bool:
        """Count rows of ``digest``, of which ``best`` is the largest; True if it was not live before."""
        if (e := self.find(digest)) is not None:
            e[1], e[2] = max(e[1], best), e[2] + count
            return False
        fp, i, j = self._place(digest)
        self.content.setdefault((fp, min(i, j)), []).append([digest, best, count])
        self.live += 1
        if not self._put(fp, i, j):
            self._resize()
        return True

    def delete(self, digest: bytes) -> list | None:
        """Forget a live digest; returns its entry."""
        if (e := self.find(digest)) is None:
            return None
        fp, i, j = self._place(digest)
        same = self.content[(fp, min(i, j))]
        same.remove(e)
        if not same:
            del self.content[(fp, min(i, j))]
        self.table[i if fp in self.table[i] else j].remove(fp)
        self.live -= 1
        return e

    def drain(self) -> list[list]:
        return [self.delete(d) for d in [e[0] for es in self.content.values() for e in es]]


def _rows(entries: list[list]) -> pa.RecordBatch:
    none = lambda x: None if x == -(2**63) else x
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in entries], pa.binary()), pa.array([none(e[1][0]) for e in entries], pa.int64()), pa.array([e[1][1] for e in entries], pa.int64()), pa.array([e[2] for e in entries], pa.int64())], schema=_ARROW)


def fold(max_live: int, by_bucket: bool):
    """Arrow batches of SCHEMA to batches of SCHEMA with equal digests folded."""

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, bucket = CuckooIndex(), None
        for batch in batches:
            for d, keep, uid, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "keep_id", "keep_uid", "group_size")), strict=True):
                if index.live and (d[:2] != bucket if by_bucket else index.live >= max_live):
                    yield _rows(index.drain())
                bucket = d[:2]
                index.insert(d, (-(2**63) if keep is None else keep, uid), n)
        if index.live:
            yield _rows(index.drain())

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_live: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))
    ids = cut_lineage(ids.withColumn("uid", F.monotonically_increasing_id()))
    first = ids.select("digest", F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.lit(1).cast("long").alias("group_size")).mapInArrow(fold(max_live, False), SCHEMA)
    met = first.repartition(shuffle_parts(spark), "digest").sortWithinPartitions(F.substring("digest", 1, 2))
    groups = cut_lineage(met.mapInArrow(fold(max_live, True), SCHEMA))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    is_hot = F.col("group_size") >= max(2, total // HOT_SHARE)
    hot = F.broadcast(groups.filter(is_hot))
    met_hot = ids.join(hot, "digest", "left")
    cold = ids.join(F.broadcast(groups.filter(is_hot).select("digest")), "digest", "left_anti").join(groups.filter(~is_hot), "digest")
    found = met_hot.filter("group_size IS NOT NULL").unionByName(cold)
    return found.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; the columns stay."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_kid"), F.col("text_sha256").alias("_ksha"))
    keyed = docs.select(boxed(docs), F.col(id_col).cast("long").alias("_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_sha"))
    rows = keyed.join(kept, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_sha") == F.col("_ksha")), "left_semi")
    # Only a row that comes twice with one id and text is left double.
    return unboxed(rows.dropDuplicates(["_id", "_sha"]), docs.columns)
