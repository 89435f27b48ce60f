"""N-gram Jaccard join with signature trees.

Two texts link when the Jaccard similarity of their sets of word shingles is at
least ``numerator / denominator``. No link is lost:

1. Texts with equal sets become one node.
2. A node's shingles are ordered by how common they are (the power of two of
   their count over all texts), then by hash. Linked sets share one of their first
   ``n - ceil(t n) + 1``, so nodes meet in the buckets of those of them that more
   than one text has; what is in a third of all texts comes last in that order.
3. Each bucket's smallest node is tested against the others, a number of tests
   linear in the rows; the links' components join most of a large group. Sizes
   and bitmaps drop most pairs before the whole sets are looked at.
4. Buckets that hold more than one component go through a signature tree: its
   nodes hold OR-combined bitmaps of shingles, size ranges and the component, if
   it is one; the traversal of the tree with itself drops pairs of nodes whose
   largest possible overlap is too small for their smallest sizes, or which are
   one component already. The pairs left are tested on the whole sets.

A linked pair that shares a rare shingle (under ``2 ** FREQUENT`` texts) meets in the
bucket of one. In a bucket of a frequent shingle only pairs count that share nothing
rare, so their overlap is at most the number of frequent shingles of either, f: the
partner of a set of n has at most ``hi = f (1 + t) / t - n`` shingles. A row whose hi is
below what its own size asks for leaves such a bucket, and rows whose hi is below
their own n ("low") link with others than low ones only: a bucket without any goes
whole, and blocks of low rows are never dealt to each other. Texts made from one
template with parts of their own, too far apart to link, therefore cost a row each and
not a pair for each two of them.

Counts come from shards of texts: a shard sends its shingles' hashes by range
and gets a level for each back.

A bucket over ``block`` rows is split by size, so that a row meets its own class and
the next ones only, and by being low, and what is still large into blocks; pairs of
blocks that may link are traversed by tasks of their own. A pair is given once, not in every bucket that it shares: each
row carries its first ``EARLY`` open tokens, and a bucket passes over pairs that
have an earlier one in common; the commonest of those are bits of the tree's nodes, so
that a bucket whose rows have all met before costs no pair.

Cases: null or blank text has an empty set and links with nothing; fewer words
than a shingle form one; a null id is its own row and never a component's name
unless all its ids are null; repeated rows are equal sets; a very long text is a
set like any other; an empty table gives an empty result; columns of ``docs`` other
than the two named are boxed, so their names don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, cut_lineage, in_shards, remove, shuffle_parts, small, tidily, unboxed
from .graph import components
from .shingles import shingle_sets

SHARD_BYTES = 2_000_000
BROADCAST_IDS = 200_000
BROADCAST_BUCKETS = 10_000
BITS = 1024
LEAF, FAN = 64, 8
EARLY = 32
#: A shingle is frequent from 2 ** FREQUENT texts on.
FREQUENT = 8
NO_BOUND = 1 << 62


def _batches(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sets of a batch's texts, some texts at a time, with the number of the first."""
    some, weight, first, texts = [], 0, 0, batch.column(column)
    for k in range(batch.num_rows):
        some.append(texts[k].as_py())
        weight += len(some[-1] or "")
        if weight > 1_000_000 or k == batch.num_rows - 1:
            yield first, shingle_sets(some, size)
            some, weight, first = [], 0, k + 1


def prefix_length(n: int, num: int, den: int) -> int:
    return n + (-num * n // den) + 1


def _shard_sets(table: pa.Table, size: int) -> list[np.ndarray]:
    return shingle_sets(table.column("text").to_pylist(), size)


def _cut(h: np.ndarray, width: int) -> np.ndarray:
    return h >> np.uint64(64 - 8 * width)


def nodes(texts: DataFrame, total: int, size: int, num: int, den: int, shard_bytes: int) -> DataFrame:
    """doc_id, mark (of the text), n, hi, digest, bitmap and tokens (those of the prefix that more than one text may have; negative ones are rare) of each row of :func:`in_shards`."""
    parts, width = max(1, total // (4 * shard_bytes)), 5
    while width < 8 and total > 1 << (8 * width - 6):
        width += 1
    rows = texts.withColumn("mark", F.xxhash64("text"))

    def ranges(short: np.ndarray) -> np.ndarray:
        cuts = np.array([(k << 8 * width) // parts for k in range(1, parts)], dtype=np.uint64)
        return np.concatenate([[0], np.searchsorted(short, cuts), [len(short)]])

    def known(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_cut(np.concatenate(sets), width), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    @tidily
    def first(table: pa.Table) -> pa.Table:
        short, counts = known(_shard_sets(table, size))
        cut, s = ranges(short), table.column("shard")[0].as_py()
        some = [k for k in range(parts) if cut[k] < cut[k + 1]]
        raw = [np.ascontiguousarray(short[cut[k] : cut[k + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes() for k in some]
        n = [zlib.compress(np.minimum(counts[cut[k] : cut[k + 1]], 65535).astype(np.uint16).tobytes(), 1) for k in some]
        return pa.table([pa.array(some, pa.int64()), pa.array([s] * len(some), pa.int64()), pa.array(raw, pa.binary()), pa.array(n, pa.binary())], names=["part", "shard", "raw", "n"])

    @tidily
    def level(table: pa.Table) -> pa.Table:
        shorts, sizes = [], []
        for raw in table.column("raw").to_pylist():
            out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
            out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
            shorts.append(out.view("<u8").ravel())
            sizes.append(len(out))
        n = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint16) for x in table.column("n").to_pylist()])
        _, which = np.unique(np.concatenate(shorts), return_inverse=True)
        levels = np.log2(np.bincount(which, weights=n)).astype(np.uint8)[which]
        back = [zlib.compress(x.tobytes(), 1) for x in np.split(levels, np.cumsum(sizes)[:-1])]
        return pa.table([table.column("part"), table.column("shard"), pa.array(back, pa.binary())], names=["part", "shard", "levels"])

    met = rows.groupBy("shard").applyInArrow(first, "part long, shard long, raw binary, n binary")
    levels = cut_lineage(met.groupBy("part").applyInArrow(level, "part long, shard long, levels binary"))
    arrow = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("digest", pa.binary()), ("bitmap", pa.binary()), ("tokens", pa.list_(pa.int64()))])

    @tidily
    def second(key, table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        sets = _shard_sets(table, size)
        short, _ = known(sets)
        cut, of = ranges(short), np.zeros(len(short), dtype=np.uint8)
        for part, raw in zip(told.column("part").to_pylist(), told.column("levels").to_pylist(), strict=True):
            of[cut[part] : cut[part + 1]] = np.frombuffer(zlib.decompress(raw), np.uint8)
        tokens, hi = [], []
        for s in sets:
            own = of[np.searchsorted(short, _cut(s, width))]
            first = np.lexsort((s, own))[: prefix_length(len(s), num, den) if len(s) else 0]
            first = first[own[first] > 0]
            token = (s[first] >> np.uint64(1)).view(np.int64)
            tokens.append(np.where(own[first] < FREQUENT, ~token, token))
            hi.append(int((own >= FREQUENT).sum()) * (num + den) // num - len(s))
        return pa.table([table.column("doc_id"), table.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi, pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([_bitmap(s).tobytes() for s in sets], pa.binary()), pa.array(tokens, pa.list_(pa.int64()))], schema=arrow)

    return rows.groupBy("shard").cogroup(levels.groupBy("shard")).applyInArrow(second, "doc_id long, mark long, n long, hi long, digest binary, bitmap binary, tokens array<long>")


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, dtype=bool)
    bits[(s % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits)


def whole_sets(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """digest and set (sorted uint64) of each row."""
    arrow = pa.schema([("digest", pa.binary()), ("set", pa.binary())])

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _batches(batch, 0, size):
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=arrow)

    return docs.select(text_col).mapInArrow(run, "digest binary, set binary")


def plausible(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps don't rule out; ``marks`` has uid, n and bitmap."""
    of = lambda side: marks.select(F.col("uid").alias(side), F.col("n").alias(f"n_{side}"), F.col("bitmap").alias(f"bits_{side}"))
    near = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
    both = pairs.join(of("a"), "a").join(of("b"), "b").filter(near).select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(n), -1) for c in (4, 5))
            inside = np.bitwise_count(x & y).sum(1).astype(np.int64)
            most = np.minimum(n - (np.bitwise_count(x).sum(1).astype(np.int64) - inside), m - (np.bitwise_count(y).sum(1).astype(np.int64) - inside))
            keep = pa.array(np.flatnonzero((num + den) * most >= num * (n + m)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; the sets are made anew, for the texts that have a pair."""
    wanted = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    wanted = cut_lineage(rows.select("uid", "doc_id", "mark", "digest").join(wanted, "uid", "left_semi"))
    ids = small(wanted.select(F.col("doc_id").alias("_wid"), F.col("mark").alias("_wmark")).distinct(), BROADCAST_IDS)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")).withColumn("_mark", F.xxhash64(F.coalesce(F.col("_t"), F.lit(""))))
    texts = texts.join(ids, F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_mark") == F.col("_wmark")), "left_semi")
    sets = cut_lineage(whole_sets(texts, "_t", size).join(wanted.select("digest", "uid"), "digest").dropDuplicates(["uid"]).select("uid", "set"))
    of = lambda side: sets.select(F.col("uid").alias(side), F.col("set").alias(f"set_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if den * common >= num * (len(x) + len(y) - common):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], schema=arrow)

    return both.mapInArrow(run, "a long, b long")


class SignatureTree:
    """Rows of a bucket, by size, under nodes with OR-combined bitmaps, size ranges, components, the largest size of a partner, and what other buckets all rows have been seen in (bits)."""

    def __init__(self, uid: np.ndarray, n: np.ndarray, bitmap: np.ndarray, comp: np.ndarray, hi: np.ndarray | None = None, seen: np.ndarray | None = None):
        hi = np.full(len(uid), NO_BOUND) if hi is None else hi
        seen = np.zeros(len(uid), np.uint64) if seen is None else seen
        order = np.lexsort((uid, n, comp, hi < n, seen))
        self.uid, self.n, self.comp, self.hi, self.seen = uid[order], n[order], comp[order], hi[order], seen[order]
        self.bits = np.ascontiguousarray(bitmap[order]).view(np.uint64)
        self.excess = self.n - np.bitwise_count(self.bits).sum(1).astype(np.int64)
        starts = np.arange(0, len(uid), LEAF)
        level = (np.bitwise_or.reduceat(self.bits, starts), np.minimum.reduceat(self.n, starts), np.maximum.reduceat(self.n, starts), np.maximum.reduceat(self.excess, starts), np.minimum.reduceat(self.comp, starts), np.maximum.reduceat(self.comp, starts), np.maximum.reduceat(self.hi, starts), np.bitwise_and.reduceat(self.seen, starts))
        self.levels = [level]
        while len(level[1]) > 1:
            starts = np.arange(0, len(level[1]), FAN)
            level = tuple(f.reduceat(x, starts) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum, np.maximum, np.bitwise_and), level, strict=True))
            self.levels.append(level)

    def leaf(self, k: int) -> slice:
        return slice(k * LEAF, min(len(self.uid), (k + 1) * LEAF))


def traverse(x: SignatureTree, y: SignatureTree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the two trees that may be similar and are of different components."""

    def hopeless(lx: int, i: int, ly: int, j: int) -> bool:
        a, b = x.levels[lx], y.levels[ly]
        if a[4][i] == a[5][i] == b[4][j] == b[5][j] or a[7][i] & b[7][j]:
            return True
        if den * a[2][i] < num * b[1][j] or den * b[2][j] < num * a[1][i] or a[6][i] < b[1][j] or b[6][j] < a[1][i]:
            return True
        most = int(np.bitwise_count(a[0][i] & b[0][j]).sum()) + int(min(a[3][i], b[3][j]))
        return (num + den) * most < num * int(a[1][i] + b[1][j])

    top = len(x.levels) - 1, len(y.levels) - 1
    stack = [(top[0], 0, top[1], 0)]
    while stack:
        lx, i, ly, j = stack.pop()
        if hopeless(lx, i, ly, j):
            continue
        if lx == 0 and ly == 0:
            s, t = x.leaf(i), y.leaf(j)
            n, m = x.n[s, None], y.n[None, t]
            inside = np.bitwise_count(x.bits[s, None] & y.bits[None, t]).sum(2).astype(np.int64)
            own, other = np.bitwise_count(x.bits[s]).sum(1).astype(np.int64)[:, None], np.bitwise_count(y.bits[t]).sum(1).astype(np.int64)[None]
            most = np.minimum(n - (own - inside), m - (other - inside))
            ok = (x.comp[s, None] != y.comp[None, t]) & (x.hi[s, None] >= m) & (y.hi[None, t] >= n) & (x.seen[s, None] & y.seen[None, t] == 0) & ((num + den) * most >= num * (n + m))
            if x is y and i == j:
                ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
            a, b = np.nonzero(ok)
            if len(a):
                yield x.uid[s][a], y.uid[t][b]
        elif lx >= ly:
            for k in range(i * FAN, min(len(x.levels[lx - 1][1]), (i + 1) * FAN)):
                if x is y and lx == ly:  # both go down together, each pair of children once
                    stack += [(lx - 1, k, ly - 1, h) for h in range(max(k, j * FAN) if i == j else j * FAN, min(len(y.levels[ly - 1][1]), (j + 1) * FAN))]
                else:
                    stack.append((lx - 1, k, ly, j))
        else:
            stack += [(lx, i, ly - 1, k) for k in range(j * FAN, min(len(y.levels[ly - 1][1]), (j + 1) * FAN))]


def _classed(rows: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Each row once for each pair of blocks of its bucket that it may find a partner in: token, i, j, mine, and its own columns."""
    # Sets that link are of one class or of neighbouring ones, and not both low.
    klass = F.floor(F.log("n") / math.log(den / num) * (1 - 1e-9)).cast("long") if num < den else F.col("n")
    kind = klass * 2 + (F.col("hi") < F.col("n")).cast("long")
    sizes = rows.withColumn("kind", kind).groupBy("token", "kind").agg(F.count("*").alias("k"))
    few = rows.groupBy("token").agg(F.count("*").alias("all"))
    blocks = sizes.join(few.filter(F.col("all") > block), "token").withColumn("blocks", F.ceil(F.col("k") / block).cast("long"))
    base = F.col("kind") * (1 << 20)
    codes = blocks.groupBy("token").agg(F.flatten(F.collect_list(F.sequence(base, base + F.col("blocks") - 1))).alias("codes"), F.map_from_entries(F.collect_list(F.struct("kind", "blocks"))).alias("of"))
    known = rows.withColumn("kind", kind).join(small(codes, BROADCAST_BUCKETS), "token", "left")
    own = F.col("kind") * (1 << 20) + F.pmod(F.xxhash64("uid"), F.element_at("of", F.col("kind")))
    apart = lambda c: F.abs(F.shiftright(c, 21) - F.shiftright(F.col("kind"), 1))
    near = F.filter("codes", lambda c: (apart(c) <= 1) & (F.shiftright(c, 20).bitwiseAND(1).bitwiseAND(F.col("kind")) == 0))
    dealt = known.withColumn("mine", F.coalesce(own, F.lit(0).cast("long"))).withColumn("other", F.explode(F.coalesce(near, F.array(F.lit(0).cast("long")))))
    return dealt.select("token", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "uid", "n", "bitmap", "comp", "hi", "early")


def dealt(rows: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """The rows (token, uid, n, bitmap, comp and maybe hi) with the first tokens of each, as tasks get them."""
    rows = rows if "hi" in rows.columns else rows.withColumn("hi", F.lit(NO_BOUND))
    early = rows.groupBy("uid").agg(F.slice(F.array_sort(F.collect_set("token")), 1, EARLY).alias("early"))  # of one row's prefix
    return _classed(rows.join(early, "uid"), num, den, block)


def candidates(rows: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Pairs (a < b) from rows (token, uid, n, bitmap, comp and maybe hi) of the buckets that hold several components."""
    placed = dealt(rows, num, den, block)
    placed = placed.repartition(shuffle_parts(rows.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(token: int, run: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(run) < 2:
            return
        i, j = run[0][0], run[0][1]
        earlier = Counter(t for r in run for t in r[8] if t < token)
        bit = {t: 1 << k for k, (t, _) in enumerate(earlier.most_common(64))}
        trees = []
        for b in dict.fromkeys((i, j)):
            own = [r for r in run if r[2] == b]
            if own:
                uid, n, bits, comp, hi, early = zip(*(r[3:9] for r in own), strict=True)
                seen = np.array([sum(bit.get(t, 0) for t in e) for e in early], dtype=np.uint64)
                trees.append(SignatureTree(np.array(uid), np.array(n), np.frombuffer(b"".join(bits), np.uint8).reshape(len(own), -1), np.array(comp), np.array(hi), seen))
        if len(trees) < (1 if i == j else 2):
            return
        before = {r[3]: frozenset(t for t in r[8] if t < token) for r in run} if len(earlier) > len(bit) else defaultdict(frozenset)
        for x, y in traverse(trees[0], trees[-1], num, den):
            found = [(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True) if before[a].isdisjoint(before[b])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], schema=arrow)

    return placed.mapInArrow(in_runs(join), "a long, b long").distinct()


def in_runs(join: Callable[[int, list[tuple]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for Arrow batches that gives ``join`` the rows with equal first three columns together, without the first of them."""

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, some = None, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for k in range(batch.num_rows):
                now = cols[0][k], cols[1][k], cols[2][k]
                if now != key and some:
                    yield from join(key[0], some)
                    some = []
                key = now
                some.append(tuple(c[k] for c in cols[1:]))
        if some:
            yield from join(key[0], some)

    return run


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100, block: int = 32_768, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, component (a number of the group, null without words) and mark (a hash of the text)."""
    spark = docs.sparkSession
    texts, folder, total = in_shards(docs, id_col, text_col, shard_bytes)
    rows = cut_lineage(nodes(texts, total, size, num, den, shard_bytes).withColumn("uid", F.monotonically_increasing_id()))
    remove(spark, folder)
    first = cut_lineage(rows.filter("n > 0").groupBy("digest").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least_id")))
    marks = rows.select("uid", "n", "bitmap")
    tokens = rows.join(first.select("uid"), "uid", "left_semi").select("uid", "n", F.explode("tokens").alias("token"), "hi")
    tokens = tokens.withColumn("hi", F.when(F.col("token") < 0, F.lit(NO_BOUND)).otherwise(F.col("hi"))).filter(F.col("hi") >= F.ceil(F.col("n") * num / den) - 1)
    pivot = F.min(F.struct((F.col("hi") < F.col("n")).alias("low"), F.col("uid"))).alias("pivot")
    buckets = cut_lineage(tokens.groupBy("token").agg(F.count("*").alias("size"), pivot).filter("size > 1 AND NOT pivot.low").withColumn("pivot", F.col("pivot.uid")))
    shared = cut_lineage(tokens.join(buckets, "token").select("token", "size", "pivot", "uid", "n", "hi"))
    pairs = shared.filter("uid <> pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct()
    pairs = cut_lineage(plausible(pairs, marks, num, den))
    links = cut_lineage(verified(pairs, docs, rows, id_col, text_col, size, num, den))
    comps = components(links)
    placed = shared.filter("size > 2").join(comps.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("component", "uid"))
    placed = cut_lineage(placed.select("token", "uid", "n", "hi", "comp"))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    open_rows = cut_lineage(placed.join(mixed, "token", "left_semi").join(marks.select("uid", "bitmap"), "uid").select("token", "uid", "n", "bitmap", "comp", "hi"))
    more = cut_lineage(candidates(open_rows, num, den, block).join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        comps = components(cut_lineage(links.unionByName(verified(more, docs, rows, id_col, text_col, size, num, den))))
    members = first.join(comps.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    names = members.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = members.join(names, "component").select("digest", "component_id", "component")
    return _named(rows.select("doc_id", "mark", "n", "digest"), named)


def _named(rows: DataFrame, named: DataFrame) -> DataFrame:
    """component_id for each row by its digest; digests of many rows go by broadcast."""
    total = rows.count()
    hot = rows.filter("n > 0").groupBy("digest").count().filter(F.col("count") >= max(2, total // 10_000)).select("digest")
    hot = F.broadcast(cut_lineage(hot.join(named, "digest")))  # at most 10,000 rows
    known = rows.filter("n > 0").join(hot, "digest", "left")
    cold = known.filter("component IS NULL").drop("component_id", "component").join(named, "digest", "left")
    warm = known.filter("component IS NOT NULL")
    none = rows.filter("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
    cols = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "component", "mark"]
    return warm.select(*cols).unionByName(cold.select(*cols)).unionByName(none.select(*cols))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of each group of linked texts, that with the smallest id; rows without words stay.

    Rows that are the same in id and text go or stay together.
    """
    linked = cut_lineage(link(docs, id_col, text_col, **kw).filter("n_shingles > 0"))
    order = F.struct(F.col("doc_id").isNull().alias("null_last"), "doc_id", "mark")
    best = linked.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("rows")).filter("rows > 1").select(F.struct("best.doc_id", "best.mark").alias("best"))
    stays = cut_lineage(best)
    single = linked.groupBy("component").agg(F.count("*").alias("rows")).filter("rows > 1").select("component")
    grouped = linked.join(single, "component", "left_semi").select("doc_id", "mark").distinct()
    drop = grouped.join(stays, F.struct("doc_id", "mark").eqNullSafe(F.col("best")), "left_anti").select(F.col("doc_id").alias("_did"), F.col("mark").alias("_dmark"))
    keyed = docs.select(boxed(docs), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_mark"))
    return unboxed(keyed.join(cut_lineage(drop), F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_mark") == F.col("_dmark")), "left_anti"), docs.columns)
