"""Suffix-array dedup: bytes of passages that an earlier document has too.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller id. The suffixes that matter are found first: every
window of ``LENGTH`` bytes holds an anchor, the place of the least hash of a
``GRAM``-byte string in it, and anchors depend on nothing outside the window.
Only anchors that occur in two documents can lie in a common window. For these
a shard keeps its distinct contexts: the ``SIDE`` bytes on either side.

A window around an anchor is ``SIDE`` neighbouring columns of its context, and
contexts of an anchor are aligned. Their Burrows-Wheeler transform is therefore
the positional one: column k is read in the order of the reversed prefixes in
front of it, within the anchor. Every shard makes its transform once, with one
stable partition a column. The shards' transforms meet by ranges of anchor
hashes and are merged by iterative interleave refinement: the interleave (which
shard comes next) starts with the shards one behind another; a step reads the
next column of each shard's transform through it and partitions it stably by
symbol, after which it is right for one symbol more. No context is compared or
sorted again. Along with it goes how far back neighbours agree, as the largest
such border between two that become neighbours; where neighbours agree over a
window's columns is a repeated interval, and the smallest id in it decides for
its windows.

Documents go to shards of about ``SHARD_BYTES`` by hash. Three passes over the
shards, which lie in a bucketed table, exchange hashes, transforms and verdicts,
one bit to a few bytes an anchor.

What stands for an anchor's own string is a hash of 64 bits; a window's other
bytes are compared themselves.

Cases: null text counts as empty; texts under ``LENGTH`` bytes lose nothing; a
very long text is read in place with its shard, a megabyte at a time; rows with
the same id take nothing from each other; a null id is smaller than any id;
repeated rows are judged alike; an empty table gives an empty result; columns of
``docs`` other than the two named are not read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, in_shards, tidily
from .shingles import _BYTES, _mix

LENGTH, GRAM = 50, 32
SIDE = LENGTH - GRAM  # bytes of context on either side, and one less than the anchor windows
SHARD_BYTES = 2_000_000
PAD = 0xFF
NULL_ID = -(2**63)
_FACTORS = [np.uint64(((2 * k + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1) | 1) for k in range(8)]


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[: -(width - step)], x[width - step :]) if width > step else x


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in documents laid end to end, each closed by a PAD byte at ``ends``."""
    n = len(data) - GRAM + 1
    if n <= SIDE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _BYTES[data]
    for k in range(5):  # strings of 1, 2, 4, 8, 16, 32 bytes
        h = h[: -(1 << k)] * _FACTORS[k] + h[1 << k :]
        h ^= h >> np.uint64(31)
    h = _mix(h) | np.uint64(1)
    closed = np.zeros(len(data) + 1, dtype=np.int32)
    closed[ends + 1] = 1
    closed = np.cumsum(closed)
    least = _slide(h, SIDE + 1, np.minimum)  # of the windows that start here
    least[closed[LENGTH : LENGTH + len(least)] != closed[: len(least)]] = 0
    edge = np.zeros(SIDE, dtype=np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), SIDE + 1, np.maximum)
    at = np.flatnonzero(most == h)
    return at, _mix(h[at])  # the least of several hashes are small; mixed again, they fill all ranges


class Shard:
    """The anchors of some documents, read in pieces of about a megabyte."""

    def __init__(self, ids: list[int | None], texts: list[bytes]):
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k]))
        self.order, self.texts = order, [texts[k] for k in order]
        self.ids = np.array([NULL_ID if ids[k] is None else ids[k] for k in order], dtype=np.int64)
        self.starts = np.cumsum([0] + [len(t) + 1 for t in self.texts])
        self.data = np.frombuffer(b"".join(t + b"\xff" for t in self.texts), dtype=np.uint8)
        at, hashes, k = [], [], 0
        while k < len(order):
            j = k + 1
            while j < len(order) and self.starts[j + 1] - self.starts[k] < 500_000:
                j += 1
            a, h = anchors(self.data[self.starts[k] : self.starts[j]], self.starts[k + 1 : j + 1] - 1 - self.starts[k])
            at.append(a + self.starts[k])
            hashes.append(h)
            k = j
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.starts, self.at, side="right") - 1

    def short(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes cut to ``width`` bytes, whether several ids here have them, and each anchor's number among them."""
        short, which = np.unique(self.hash >> np.uint64(64 - 8 * width), return_inverse=True)
        lo, hi = np.full(len(short), 2**63 - 1), np.full(len(short), NULL_ID)
        np.minimum.at(lo, which, self.ids[self.doc])
        np.maximum.at(hi, which, self.ids[self.doc])
        return short, lo < hi, which

    def contexts(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the anchors ``repeated``: distinct contexts in order of hash, their hashes, least ids; each anchor's number among them and whether windows are inside its document."""
        at, h, doc = self.at[repeated], self.hash[repeated], self.doc[repeated]
        padded = np.concatenate([np.full(SIDE, PAD, np.uint8), self.data, np.full(SIDE + GRAM, PAD, np.uint8)])
        span = np.lib.stride_tricks.sliding_window_view(padded, GRAM + 2 * SIDE)[at]
        left, right = span[:, :SIDE].copy(), span[:, SIDE + GRAM :].copy()
        before = np.minimum(at - self.starts[doc], SIDE)
        after = np.minimum(self.starts[doc + 1] - 1 - at - GRAM, SIDE)
        k = np.arange(SIDE)
        left[k[None] < SIDE - before[:, None]] = PAD
        right[k[None] >= after[:, None]] = PAD
        o = np.arange(SIDE + 1)
        inside = (o[None] >= SIDE - before[:, None]) & (o[None] <= after[:, None])
        rows = np.concatenate([h.astype(">u8").view(np.uint8).reshape(-1, 8), left, right], axis=1)
        rows, which = np.unique(np.ascontiguousarray(rows).view(f"V{8 + 2 * SIDE}").ravel(), return_inverse=True)
        rows = rows.view(np.uint8).reshape(-1, 8 + 2 * SIDE)
        least = np.full(len(rows), 2**63 - 1)
        np.minimum.at(least, which, self.ids[doc])
        return rows, np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64), least, which, inside


def ranges(h: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each of ``parts`` ranges of the sorted ``bits``-bit hashes begins and the last one ends."""
    cuts = np.array([(k << bits) // parts for k in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(h, cuts), [len(h)]])


def partition(group: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """A stable order by group and symbol, both of few bits, by counting."""
    order = np.argsort(symbol, kind="stable")
    return order[np.argsort(group[order], kind="stable")]


def transform(contexts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The columns of a shard's contexts (rows, by group), each in the order of the reversed prefixes in front of it."""
    out, order = np.empty(contexts.shape[::-1], dtype=np.uint8), np.arange(len(contexts))
    group = _narrow(group)
    for k in range(contexts.shape[1]):
        out[k] = contexts[order, k]
        order = order[partition(group, out[k])]
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """``x`` from 0 on, in the fewest bits."""
    least = int(x.min()) if len(x) else 0
    return (x - least).astype(np.min_scalar_type(int(x.max()) - least if len(x) else 0))


def _farthest(border: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest border of each range from behind ``start`` to ``end``."""
    size = end - start
    out, level, step = np.empty(len(size), dtype=border.dtype), border, 1
    left = np.arange(len(size))
    while len(left):
        now = size[left] < 2 * step
        some = left[now]
        out[some] = np.maximum(level[end[some]], level[start[some] + step])
        left = left[~now]
        level = np.concatenate([level[:step], np.maximum(level[step:], level[:-step])])
        step *= 2
    return out


def merge(columns: np.ndarray, shard: np.ndarray, group: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """A bit mask for each context: its windows that a context of its group with a smaller id has as well.

    ``columns`` are the shards' transforms side by side, ``shard`` and ``group`` say
    whose each context is; the contexts of a shard are in order of group.
    """
    n = columns.shape[1]
    shard, group = _narrow(shard), _narrow(group)
    origin = np.argsort(group, kind="stable")  # the interleave: by group, the shards one behind another
    edge = np.uint8(len(columns) + 1)
    border = np.where(np.concatenate([[True], np.diff(group[origin]) != 0])[:n], edge, 0).astype(np.uint8)
    of, masks = group[origin], np.zeros(n, dtype=np.uint32)
    for k, column in enumerate(columns):
        symbol = np.empty(n, dtype=np.uint8)
        symbol[np.argsort(shard[origin], kind="stable")] = column
        order = partition(of, symbol)
        origin, symbol = origin[order], symbol[order]
        same = np.flatnonzero((of[1:] == of[:-1]) & (symbol[1:] == symbol[:-1])) + 1
        new = np.full(n, k + 1, dtype=np.uint8)
        new[border == edge] = edge  # groups stay where they are
        new[same] = _farthest(border, order[same - 1], order[same])
        border = new
        if k + 1 >= window:
            first = np.flatnonzero(border > k + 1 - window)
            least = np.minimum.reduceat(ids[origin], first)
            later = ids[origin] > np.repeat(least, np.diff(np.append(first, n)))
            masks[origin[later]] |= np.uint32(1 << (k + 1 - window))
    return masks


def _bytes(column: pa.ChunkedArray) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _shard(table: pa.Table) -> Shard:
    return Shard(table.column("doc_id").to_pylist(), _bytes(table.column("text")))


def _cut(short: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _uncut(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes)."""
    rows, _, total = in_shards(docs, id_col, text_col, shard_bytes)
    parts = max(1, total // (4 * shard_bytes))
    width = 5
    while width < 8 and (total >> 3) > 1 << (8 * width - 8):
        width += 1
    hashes = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("several", pa.binary()), ("raw", pa.binary())])

    @tidily
    def first(table: pa.Table) -> pa.Table:
        shard = _shard(table)
        short, several, _ = shard.short(width)
        cut = ranges(short, parts, 8 * width)
        s = table.column("shard")[0].as_py()
        some = [k for k in range(parts) if cut[k] < cut[k + 1]]
        return pa.table([[k for k in some], [s] * len(some), [np.packbits(several[cut[k] : cut[k + 1]]).tobytes() for k in some], [_cut(short[cut[k] : cut[k + 1]], width) for k in some]], schema=hashes)

    @tidily
    def common(table: pa.Table) -> pa.Table:
        shorts = [_uncut(x, width) for x in table.column("raw").to_pylist()]
        sizes = [len(x) for x in shorts]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("several").to_pylist(), sizes, strict=True)]).astype(bool)
        _, which, count = np.unique(np.concatenate(shorts), return_inverse=True, return_counts=True)
        many = count > 1
        many[which[several]] = True
        bits = np.split(many[which], np.cumsum(sizes)[:-1])
        return pa.table([table.column("part"), table.column("shard"), [np.packbits(b).tobytes() for b in bits]], schema=pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("bits", pa.binary())]))

    met = rows.groupBy("shard").applyInArrow(first, "part long, shard long, several binary, raw binary")
    bits = cut_lineage(met.groupBy("part").applyInArrow(common, "part long, shard long, bits binary"))

    def known(shard: Shard, bits: list[tuple[int, bytes]]) -> np.ndarray:
        """Which anchors are repeated, by the bits of each part."""
        short, _, which = shard.short(width)
        cut, on = ranges(short, parts, 8 * width), np.zeros(len(short), dtype=bool)
        for k, raw in bits:
            on[cut[k] : cut[k + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=int(cut[k + 1] - cut[k])).astype(bool)
        return np.flatnonzero(on[which])

    sent = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("hashes", pa.binary()), ("columns", pa.binary()), ("ids", pa.binary())])

    @tidily
    def second(key, table: pa.Table, bits: pa.Table) -> pa.Table:
        if not table.num_rows or not bits.num_rows:
            return sent.empty_table()
        shard = _shard(table)
        ctx, h, least, _, _ = shard.contexts(known(shard, list(zip(bits.column("part").to_pylist(), bits.column("bits").to_pylist(), strict=True))))
        cut = ranges(h, parts, 64)
        columns = transform(ctx[:, 8:], np.cumsum(np.diff(h, prepend=h[:1]) != 0))
        some = [slice(cut[k], cut[k + 1]) for k in range(parts)]
        rows = [(k, key[0].as_py(), h[s].tobytes(), columns[:, s].tobytes(), least[s].tobytes()) for k, s in enumerate(some) if s.start < s.stop]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), sent, strict=True)], schema=sent) if rows else sent.empty_table()

    @tidily
    def decide(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
        sizes = [len(h) for h in hashes]
        columns = np.concatenate([np.frombuffer(x, np.uint8).reshape(2 * SIDE, -1) for x in table.column("columns").to_pylist()], axis=1)
        names, group, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        shard = np.repeat(np.arange(len(sizes)), sizes)
        masks = np.zeros(len(ids), np.uint32)
        # Some anchors at a time: a slice of every shard's transform, in which all contexts of an anchor are together.
        upto, at = np.concatenate([[0], np.cumsum(count)]), 0
        while at < len(names):
            end = min(len(names), at + 60_000, max(at + 1, int(np.searchsorted(upto, upto[at] + 400_000, side="right")) - 1))
            some = np.flatnonzero((group >= at) & (group < end))
            masks[some] = merge(columns[:, some], shard[some], group[some], ids[some], SIDE)
            at = end
        return pa.table([table.column("part"), table.column("shard"), [x.tobytes() for x in np.split(masks, np.cumsum(sizes)[:-1])]], schema=pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("masks", pa.binary())]))

    contexts = rows.groupBy("shard").cogroup(bits.groupBy("shard")).applyInArrow(second, "part long, shard long, hashes binary, columns binary, ids binary")
    masks = cut_lineage(contexts.groupBy("part").applyInArrow(decide, "part long, shard long, masks binary"))
    told = bits.join(masks, ["part", "shard"], "left")
    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    @tidily
    def last(key, table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result.empty_table()
        shard = _shard(table)
        told = sorted(zip(*(told.column(c).to_pylist() for c in ("part", "bits", "masks")), strict=True))
        repeated = known(shard, [(k, b) for k, b, _ in told])
        start = np.zeros(len(shard.data) + LENGTH + 1, dtype=np.int8)
        if len(repeated):
            _, h, least, which, inside = shard.contexts(repeated)
            mask = np.concatenate([np.frombuffer(m, np.uint32) for _, _, m in told if m is not None])
            later = shard.ids[shard.doc[repeated]] > least[which]
            hit = ((mask[which][:, None] >> np.arange(SIDE + 1)[None] & 1).astype(bool) | later[:, None]) & inside
            a, o = np.nonzero(hit)
            start[shard.at[repeated][a] - SIDE + o] = 1
        on = np.cumsum(start, dtype=np.int64)
        gone = (on[: len(shard.data)] - np.concatenate([np.zeros(LENGTH, np.int64), on])[: len(shard.data)]) > 0
        out = []
        for k, text in enumerate(shard.texts):
            g = gone[shard.starts[k] : shard.starts[k + 1] - 1]
            n = int(g.sum())
            spans = int((g[1:] & ~g[:-1]).sum() + g[0]) if n else 0
            kept = text if not n else np.frombuffer(text, np.uint8)[~g].tobytes()
            out.append((None if shard.ids[k] == NULL_ID else int(shard.ids[k]), len(text), n, spans, kept))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), result, strict=True)], schema=result)

    return rows.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(last, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digested(rows: DataFrame) -> DataFrame:
    """:func:`repeated_passages`'s rows with a SHA-256 instead of the bytes."""
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
