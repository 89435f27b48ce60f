"""Near copies by bottom-k sketches of one hash function.

A text's sketch are the ``K`` least hashes of its word shingles; the ``LISTS`` least of
them are its retained values.

1. Each retained value has an inverted list of the texts that have it. Of the least
   ``LISTS`` hashes in the union of two linked sets some number m at least lies in both,
   so that two linked texts share m retained values. A text may therefore leave the m - 1 longest of
   its lists, counting the values that it has for itself as the shortest: a passage that
   many texts have joins those texts only that hardly hold anything else.
2. Each list's first text is compared with all others of the list, which is linear in its
   length; the components of the links found join most of a large group.
3. In lists that hold texts of several components the pairs that are apart are compared
   by tasks of their own, long lists in blocks, a pair once for all the lists it is in.
   Sizes and bitmaps that bound the overlap go first.
4. Pairs whose union sketch, the ``K`` least values of both sketches, has enough values
   in common are confirmed on the full sets, which alone decide.

m, and the number of common values that the filter asks for, are such that a linked pair
falls short with a probability under ``MISS``; for sets of up to ``LISTS`` shingles they
are exact. Hashing alone decides that, not the data: no list is capped.

Cases: null or blank text has an empty set and links with nothing; fewer words than a
shingle form one; a null id is its own row, and a component's name only if all its ids
are null; ``kept`` compares null with null as equal; repeated rows are equal sets and
have one fate; a very long text is a set like any other; an empty table gives an empty
result; columns other than the two named are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, shuffle_parts, tidily
from .graph import components
from .jaccard import _batches, _bitmap, _digest, _named, dealt, in_runs, verified

K, LISTS = 128, 64
MISS = 1e-13
BLOCK = 16_384
STEP = 256


@lru_cache
def enough(k: int, num: int, den: int, miss: float = MISS) -> int:
    """The largest number that the common ones of ``k`` values of a union stay under with a probability of at most ``miss``."""
    t, below = num / den, 0.0
    for m in range(k + 1):
        below += comb(k, m) * t**m * (1 - t) ** (k - m)
        if below > miss:
            return m
    return k


def sketched(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """uid, doc_id, mark (of the text), n, digest, bitmap and sketch of each row."""
    arrow = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bitmap", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _batches(batch, 2, size):
                own = batch.slice(first, len(sets))
                least = [s[:K].view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([_bitmap(s).tobytes() for s in sets], pa.binary()), pa.array(least, pa.list_(pa.int64()))], schema=arrow)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, n long, digest binary, bitmap binary, sketch array<long>").withColumn("uid", F.monotonically_increasing_id())


def lists(texts: DataFrame, num: int, den: int) -> DataFrame:
    """token, size, pivot, uid, n: the inverted lists of more than one text, each text in as many as it must be in."""
    values = texts.select("uid", "n", F.explode(F.slice("sketch", 1, LISTS)).alias("token"))
    sizes = values.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    met = values.join(sizes, "token")
    retained = F.least(F.col("n"), F.lit(LISTS))
    common = F.least(F.lit(enough(LISTS, num, den)), F.ceil(F.lit(num) * retained / den))
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("size"), F.desc("token")))
    # The longest lists come first: the last of them is left where m - 1 have been.
    kept = cut_lineage(met.withColumn("place", place).filter(F.col("place") >= common).select("token", "uid", "n"))
    again = kept.groupBy("token").agg(F.count("*").alias("size"), F.min("uid").alias("pivot")).filter("size > 1")
    return cut_lineage(kept.join(again, "token").select("token", "size", "pivot", "uid", "n"))


def shared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of sketches, padded with the largest number: the size of each union sketch, and how many of it both have."""
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    pad = np.uint64(0xFFFFFFFFFFFFFFFF)
    new = np.ones(both.shape, dtype=bool)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    new &= both != pad
    inside = np.cumsum(new, axis=1) <= x.shape[1]
    twice = np.zeros(both.shape, dtype=bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != pad)
    return np.minimum(new.sum(1), x.shape[1]), (twice & inside).sum(1)


def _close(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of sketches may be of linked sets; sketches that hold all of both sets tell exactly."""
    union, common = shared(x, y)
    whole = (n <= x.shape[1]) & (m <= x.shape[1]) & (n + m - common <= x.shape[1])
    return np.where(whole, den * common >= num * union, common >= np.where(union < x.shape[1], 0, enough(x.shape[1], num, den)))


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(rows), K), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _fit(bits_x: np.ndarray, bits_y: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the bitmaps of the full sets leave room for a link; arrays of rows, or a column and a row of them."""
    inside = np.bitwise_count(bits_x & bits_y).sum(-1).astype(np.int64)
    own, other = (np.bitwise_count(b).sum(-1).astype(np.int64) for b in (bits_x, bits_y))
    return (num + den) * np.minimum(n - own + inside, m - other + inside) >= num * (n + m)


def estimated(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes, bitmaps and union sketches don't rule out."""
    of = lambda side: texts.select(F.col("uid").alias(side), F.col("n").alias(f"n_{side}"), F.col("bitmap").alias(f"bits_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    near = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
    both = pairs.join(of("a"), "a").join(of("b"), "b").filter(near).select("a", "b", "n_a", "n_b", "bits_a", "bits_b", "sketch_a", "sketch_b")

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
                bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(n), -1) for c in (4, 5)]
                some = np.flatnonzero(_fit(*bits, n, m, num, den))
                if len(some):
                    left = batch.take(pa.array(some))
                    x, y = (_padded([left.column(c)[k].values.to_numpy().view(np.uint64) for k in range(len(some))]) for c in (6, 7))
                    keep = pa.array(np.flatnonzero(_close(x, y, n[some], m[some], num, den)))
                    yield pa.RecordBatch.from_arrays([left.column(0).take(keep), left.column(1).take(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def candidates(rows: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Pairs (a < b) of different components from rows (token, uid, n, bitmap, comp) of the lists that hold several; a bitmap has the values behind it."""
    placed = dealt(rows, num, den, block).repartition(shuffle_parts(rows.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j")

    def join(token: int, run: list[tuple]) -> Iterator[pa.RecordBatch]:
        i, j = run[0][0], run[0][1]
        earlier = Counter(t for r in run for t in r[8] if t < token)
        bit = {t: 1 << k for k, (t, _) in enumerate(earlier.most_common(64))}
        sides = [[r for r in run if r[2] == b] for b in dict.fromkeys((i, j))]
        if len(run) < 2 or not all(sides) or (i != j and len(sides) < 2):
            return

        def columns(own: list[tuple]) -> tuple[np.ndarray, ...]:
            own = sorted(own, key=lambda r: (r[4], r[3]))
            raw = np.frombuffer(b"".join(r[5] for r in own), np.uint64).reshape(len(own), -1)
            bits = raw.shape[1] - LISTS
            return np.array([r[3] for r in own]), np.array([r[4] for r in own]), raw[:, :bits], raw[:, bits:], np.array([r[6] for r in own]), np.array([sum(bit.get(t, 0) for t in r[8]) for r in own], dtype=np.uint64)

        x, y = columns(sides[0]), columns(sides[-1])
        before = {r[3]: frozenset(t for t in r[8] if t < token) for r in run} if len(earlier) > len(bit) else None
        for p in range(0, len(x[0]), STEP):
            for q in range(p if i == j else 0, len(y[0]), STEP):
                s, t = slice(p, p + STEP), slice(q, q + STEP)
                n, m = x[1][s, None], y[1][None, t]
                # Rows are in the order of their sizes.
                if den * n[-1, 0] < num * m[0, 0] or den * m[0, -1] < num * n[0, 0]:
                    continue
                ok = (x[4][s, None] != y[4][None, t]) & (x[5][s, None] & y[5][None, t] == 0) & (den * n >= num * m) & (den * m >= num * n)
                if i == j and p == q:
                    ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
                a, b = np.nonzero(ok)
                for k in range(0, len(a), 16_384):
                    c, d = a[k : k + 16_384] + p, b[k : k + 16_384] + q
                    fit = _fit(x[2][c], y[2][d], x[1][c], y[1][d], num, den)
                    c, d = c[fit], d[fit]
                    near = _close(x[3][c], y[3][d], x[1][c], y[1][d], num, den)
                    found = [(min(u, v), max(u, v)) for u, v in zip(x[0][c[near]].tolist(), y[0][d[near]].tolist(), strict=True) if before is None or before[u].isdisjoint(before[v])]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return placed.mapInArrow(in_runs(join), "a long, b long").distinct()


def signatures(texts: DataFrame) -> DataFrame:
    """uid, and bitmap with the retained values behind it, padded with the largest number."""

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pad = np.full(LISTS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            values = [batch.column(2)[k].values.to_numpy().view(np.uint64)[:LISTS] for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b + np.concatenate([v, pad[len(v) :]]).tobytes() for b, v in zip(batch.column(1).to_pylist(), values, strict=True)], pa.binary())], names=["uid", "bitmap"])

    return texts.select("uid", "bitmap", "sketch").mapInArrow(run, "uid long, bitmap binary")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the row's id is its component's) for each row of ``docs``."""
    rows = cut_lineage(sketched(docs, id_col, text_col, size))
    first = cut_lineage(rows.filter("n > 0").groupBy("digest").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least_id")))
    texts = cut_lineage(rows.join(first.select("uid"), "uid", "left_semi").select("uid", "n", "bitmap", "sketch"))
    met = lists(texts.select("uid", "n", "sketch"), num, den)
    pairs = met.filter("uid <> pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct()
    pairs = cut_lineage(estimated(pairs, texts, num, den))
    links = cut_lineage(verified(pairs, docs, rows, id_col, text_col, size, num, den))
    comps = components(links)
    placed = met.filter("size > 2").join(comps.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("component", "uid"))
    placed = cut_lineage(placed.select("token", "uid", "n", "comp"))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    opened = cut_lineage(placed.join(mixed, "token", "left_semi"))
    some = signatures(texts.join(opened.select("uid").distinct(), "uid", "left_semi"))
    opened = cut_lineage(opened.join(some, "uid"))
    more = cut_lineage(candidates(opened, num, den, block).join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        more = cut_lineage(estimated(more, texts, num, den))
        comps = components(cut_lineage(links.unionByName(verified(more, docs, rows, id_col, text_col, size, num, den))))
    members = first.join(comps.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    names = members.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = members.join(names, "component").select("digest", "component_id", "component")
    return _named(rows.select("doc_id", "mark", "n", "digest"), named).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
