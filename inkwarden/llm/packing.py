"""Mixture-controlled packing of token ids into sequences.

Documents wait in one queue per source. Every window, which is a sequence of
``sequence`` tokens, is filled by deficit round-robin: a queue may send its
share by target proportion, counted in whole tokens, and the fraction of a token
it could not send is carried to its next turn; an empty queue leaves and the
rest share its part. A full sequence therefore has within two tokens of each
queue's share while the queues last. Queues with a share under ``QUANTUM``
tokens a window would be cut to crumbs: they form one stream among themselves,
by the same rule in windows of ``LONG`` tokens, and that stream is a queue of
the sequences. Queues with a target of 0 come when all others have run dry.

Seen over time what a queue has sent is ``min(total, share * v)`` for a clock v
that all queues have in common, and the clock at window j is where these sums
reach ``j * sequence``. Each task can therefore place its own documents with no
state from another: deficits carry across windows and partitions alike. Only the
end of the last window is not full; it is split into sequences of powers of two.

Without given proportions a queue's is its share of all tokens, and every
window mixes as the corpus does. Over ``MAX_QUEUES`` sources share queues by
hash; a shared queue's proportion is the sum of its sources'.

Texts are split at single spaces and line feeds that stand between other
characters, which are token boundaries of a byte-level BPE. The pieces of a
batch of texts are looked up together in a table of pieces (at most ``MEMO``),
by their bytes; texts with white space in a row are encoded whole.

Cases: null or empty text has the closing id only; null sources form one queue;
repeated rows are documents of their own; a very long text is cut freely like
any other; an empty table gives an empty result; ids may be null; columns of
``docs`` other than the three that are named are not read, so their names don't
matter.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, key_of, small, tidily

MEMO = 400_000
MAX_QUEUES = 65_536
QUANTUM, LONG = 16, 64 * 1024
BROADCAST_ROWS = 200_000
FLUSH_BYTES = 4_000_000
_TWO_SPACES = re.compile(r"\s\s")
_POINT, _LETTER = (np.array([chr(c) in some for c in range(256)]) for some in (",.;:!?", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several ranges, one range after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Pieces:
    """Token ids of pieces of text by their bytes: a hash table that whole arrays of pieces are looked up in.

    A piece of up to 16 bytes is compared by two words and its length; longer
    ones, and those whose few places are taken, are kept in a dictionary. Beyond
    ``most`` pieces those stay that came more than once since the last time.
    """

    PROBES = 4
    KINDS = (("lo", np.uint64), ("hi", np.uint64), ("length", np.int32), ("start", np.int32), ("count", np.int32), ("uses", np.int32))

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most
        self.bits = max(8, (2 * most).bit_length())
        self._start()

    def _start(self) -> None:
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        for name, kind in self.KINDS:
            setattr(self, name, np.zeros(1024, dtype=kind))
        self.ids, self.used, self.n = np.zeros(4096, dtype=np.uint32), 0, 0
        self.rest: dict[bytes, int] = {}

    def _hash(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = (lo ^ (hi * np.uint64(0x9E3779B97F4A7C15)) ^ length.astype(np.uint64)) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, h: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Put pieces where their hashes say; returns which of them found no place."""
        left = np.arange(len(h))
        for r in range(self.PROBES):
            at = (h[left] + r) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.table[at] < 0)
            self.table[at[free]] = numbers[left[free]]
            left = left[self.table[at] != numbers[left]]
        return left

    def _append(self, ids: np.ndarray, **columns: np.ndarray) -> int:
        first, columns["start"] = self.n, self.used + np.cumsum(columns["count"]) - columns["count"]
        for name, _ in self.KINDS:
            setattr(self, name, _put(getattr(self, name), first, columns[name]))
        self.ids = _put(self.ids, self.used, ids)
        self.used, self.n = self.used + len(ids), first + len(columns["count"])
        return first

    def trim(self) -> None:
        kept = np.flatnonzero(self.uses[: self.n] > 1)
        if len(kept) > self.most // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.most // 2]])
        columns = {name: getattr(self, name)[kept] for name, _ in self.KINDS}
        ids = self.ids[spread(columns["start"].astype(np.int64), columns["count"])]
        number = np.full(self.n, -1)
        number[kept] = np.arange(len(kept))
        rest = {piece: int(number[k]) for piece, k in self.rest.items() if number[k] >= 0}
        self._start()
        self._append(ids, **columns | {"uses": np.zeros(len(kept), np.int32)})
        self.rest, in_table = rest, np.ones(len(kept), dtype=bool)
        in_table[list(rest.values())] = False
        at = np.flatnonzero(in_table)
        self._place(self._hash(columns["lo"][at], columns["hi"][at], columns["length"][at]), at)

    def add(self, pieces: list[bytes], lo: np.ndarray, hi: np.ndarray, h: np.ndarray) -> None:
        """New pieces, with the words and places that :meth:`find` has made of them."""
        ids = [self.encode(p) for p in pieces]
        count, length = np.array([len(x) for x in ids]), np.array([len(p) for p in pieces])
        first = self._append(np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum())), lo=lo, hi=hi, length=length, count=count, uses=np.zeros(len(pieces)))
        short = np.flatnonzero(length <= 16)
        for k in np.concatenate([np.flatnonzero(length > 16), short[self._place(h[short], first + short)]]).tolist():
            self.rest[pieces[k]] = first + k

    def find(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece ``data[start:end]``, those that are new included; ``data`` ends in 16 bytes more."""
        if self.n > self.most:
            self.trim()
        words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        length = ends - starts
        lo = words[starts] & _MASKS[np.minimum(length, 8)]
        hi = words[np.minimum(starts + 8, len(words) - 1)] & _MASKS[np.clip(length - 8, 0, 8)]
        h = self._hash(lo, hi, length)
        out = np.full(len(starts), -1, dtype=np.int64)
        left = np.flatnonzero(length <= 16)
        for r in range(self.PROBES):
            k = self.table[(h[left] + r) & ((1 << self.bits) - 1)]
            hit = (k >= 0) & (self.lo[k] == lo[left]) & (self.hi[k] == hi[left]) & (self.length[k] == length[left])
            out[left[hit]] = k[hit]
            left = left[~hit]
            if not len(left):
                break
        new: dict[bytes, int] = {}
        missing = np.flatnonzero(out < 0).tolist()
        for j in missing:
            if (piece := data[starts[j] : ends[j]]) not in self.rest:
                new.setdefault(piece, j)
        if new:
            first, at = self.n, np.fromiter(new.values(), np.int64, len(new))
            self.add(list(new), lo[at], hi[at], h[at])
            new = dict(zip(new, range(first, self.n), strict=True))
        for j in missing:
            piece = data[starts[j] : ends[j]]
            out[j] = self.rest[piece] if piece in self.rest else new[piece]
        self.uses[: self.n] += np.bincount(out, minlength=self.n).astype(np.int32)
        return out


def _put(old: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """``new`` written at ``at``, in a longer array if it must be."""
    if at + len(new) > len(old):
        old = np.concatenate([old, np.zeros(max(len(old) // 2, at + len(new) - len(old)), dtype=old.dtype)])
    old[at : at + len(new)] = new
    return old


class Encoder:
    """Token ids of texts, many at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # A byte-level model sees printable bytes as themselves and the others as the characters from 256 on.
        shown = {b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = {b: 256 + k for k, b in enumerate(hidden)}
        self.space = chr(self.bytes[32])
        self.tokenize = self.tok.model.tokenize
        self.pieces = Pieces(self.piece, MEMO)

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def piece(self, raw: bytes) -> list[int]:
        """Ids of letters, maybe behind a space, which are one token to the pre-tokeniser; of anything else by the long way."""
        if raw.removeprefix(b" ").isalpha():  # of ASCII
            return [t.id for t in self.tokenize(raw.decode().replace(" ", self.space))]
        text = raw.decode("utf-8", "surrogatepass")
        if text.removeprefix(" ").isalpha():
            return [t.id for t in self.tokenize(raw.decode("latin-1").translate(self.bytes))]
        return self.whole(text)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if _TWO_SPACES.search(t):
                out[k] = np.array(self.whole(t), dtype=np.uint32)
            elif t:
                plain.append(k)
        if not plain:
            return out
        raw = [texts[k].encode("utf-8", "surrogatepass") for k in plain]
        data = b"\n".join(raw) + b"\n" + bytes(16)
        b = np.frombuffer(data, np.uint8)[:-16]
        at = np.flatnonzero((b == 32) | (b == 10))
        ends = np.cumsum([len(r) + 1 for r in raw]) - 1
        outer = np.zeros(len(at), dtype=bool)
        outer[np.searchsorted(at, ends)] = True
        # Behind each mark (the start is one) stands a word, with the mark if it is a space; a line feed in a text is a piece itself.
        mark, inner = np.concatenate([[-1], at[:-1]]), np.concatenate([[False], ~outer[:-1]])
        space = inner & (b[mark] == 32)
        feed = inner & ~space
        # A point between a letter and the end of a word is a token of its own.
        point = (at - mark > 2) & _POINT[b[at - 1]] & _LETTER[b[at - 2]]
        starts = np.stack([mark, mark + ~space, at - point], axis=1).ravel()
        stops = np.stack([mark + feed, at - point, at], axis=1).ravel()
        doc = np.repeat(np.concatenate([[0], np.cumsum(outer[:-1])]), 3)
        full = np.flatnonzero(stops > starts)
        k = self.pieces.find(data, starts[full], stops[full])
        n = self.pieces.count[k]
        ids = self.pieces.ids[spread(self.pieces.start[k].astype(np.int64), n)]
        sizes = np.bincount(doc[full], weights=n, minlength=len(plain)).astype(np.int64)
        for k, own in zip(plain, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            out[k] = own
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder, which its tasks share for the pieces it knows."""
    return Encoder(path)


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, queue, end_id: int) -> DataFrame:
    """doc_id, queue, part, before (tokens of that queue before it in this partition), n, ids."""
    schema = "doc_id long, queue string, part int, before long, n long, ids binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, sent = encoder_of(path), TaskContext.get().partitionId(), {}
        narrow = np.uint16 if encoder.tok.get_vocab_size() <= 65536 and end_id < 65536 else np.uint32
        end = np.array([end_id], narrow).tobytes()

        def encoded(some: list[tuple]) -> pa.RecordBatch:
            out = []
            for (doc, q, _), ids in zip(some, encoder.many([t for _, _, t in some]), strict=True):
                n, before = len(ids) + 1, sent.get(q, 0)
                sent[q] = before + n
                out.append((doc, q, part, before, n, ids.astype(narrow).tobytes() + end))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        some, weight = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                doc, q, text = (c[k].as_py() for c in batch.columns)
                some.append((doc, q, text or ""))
                weight += len(text or "")
                if weight > FLUSH_BYTES // 4:
                    yield encoded(some)
                    some, weight = [], 0
        if some:
            yield encoded(some)

    return docs.select(F.col(id_col).cast("long"), queue, F.col(text_col)).mapInArrow(run, schema)


class Clock:
    """Queues that send ``min(total, share * v)`` at clock v, those without a share once all others are dry."""

    def __init__(self, totals: np.ndarray, shares: np.ndarray):
        self.totals, has = totals.astype(float), shares > 0
        self.shares = np.where(has, shares, np.maximum(self.totals, 1.0)).astype(float)
        need = self.totals / self.shares
        self.begin = np.where(has, 0.0, need[has].max() if has.any() else 0.0)
        self.v = np.unique(np.concatenate([[0.0], self.begin, self.begin + need]))
        on, off = np.searchsorted(self.v, self.begin), np.searchsorted(self.v, self.begin + need)
        rate = np.cumsum(np.bincount(on, self.shares, len(self.v)) - np.bincount(off, self.shares, len(self.v)))
        self.sums = np.concatenate([[0.0], np.cumsum(np.maximum(rate[:-1], 0) * np.diff(self.v))])

    def at(self, tokens: np.ndarray) -> np.ndarray:
        """What each queue (a column) has sent, not rounded, when all together have sent each of ``tokens``."""
        return np.minimum(self.totals, self.shares * np.maximum(np.interp(tokens, self.sums, self.v)[:, None] - self.begin, 0))

    def when(self, q: int, x: float) -> float:
        """What all together have sent when queue q has sent x."""
        return float(np.interp(self.begin[q] + x / self.shares[q], self.v, self.sums))


class Folded:
    """A :class:`Clock` whose small queues are one queue, the last."""

    def __init__(self, clock: Clock, large: np.ndarray):
        self.clock, self.large, self.small = clock, np.flatnonzero(large), np.flatnonzero(~large)
        self.totals = np.append(clock.totals[self.large], clock.totals[self.small].sum())

    def at(self, tokens: np.ndarray) -> np.ndarray:
        sent = self.clock.at(tokens)
        return np.concatenate([sent[:, self.large], sent[:, self.small].sum(1, keepdims=True)], axis=1)

    def when(self, q: int, x: float) -> float:
        if q < len(self.large):
            return self.clock.when(int(self.large[q]), x)
        lo, hi = 0.0, float(self.clock.sums[-1])
        while hi - lo > 1:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self.at(np.array([mid]))[0, -1] <= x else (lo, mid)
        return lo


class Rounds:
    """Whole tokens that each queue has sent before each window of ``window`` tokens; what is left of a share is carried on."""

    def __init__(self, lines: Clock | Folded, window: int, full: bool):
        """``full``: every window is filled, by queues other than the last."""
        self.lines, self.window, self.full = lines, window, full
        self.totals = lines.totals.astype(np.int64)
        self.total = int(self.totals.sum())
        self.block = max(1, min(256, 200_000 // (1 + len(self.totals))))
        self._known: dict[int, tuple] = {}

    def before(self, windows: np.ndarray) -> np.ndarray:
        """Tokens sent before each of the windows, a column for each queue."""
        sent = self.lines.at(windows * float(self.window))
        whole = np.where(sent >= self.totals, self.totals, np.floor(sent * (1 - 1e-12))).astype(np.int64)
        whole[windows * self.window >= self.total] = self.totals
        if self.full:  # the fractions that all carry are whole tokens of these windows
            left, room = np.minimum(windows * self.window, self.total) - whole.sum(1), self.totals - whole
            takers = room > 2
            takers[:, -1] = False
            n = takers.sum(1)
            each, more = np.divmod(left, np.maximum(n, 1))
            whole += np.where(takers, each[:, None] + (np.cumsum(takers, axis=1) <= more[:, None]), 0)
            for r in np.flatnonzero((n == 0) & (left > 0)):
                for q in reversed(range(len(self.totals))):
                    take = min(int(left[r]), int(room[r, q]))
                    whole[r, q], left[r] = whole[r, q] + take, left[r] - take
        return whole

    def at(self, j: int) -> tuple[list[int], list[int], list[int]]:
        """Of window j: tokens sent before it and after it, and where each queue's part starts among all tokens."""
        k, r = divmod(j, self.block)
        if (x := self._known.get(k)) is None:
            if len(self._known) * self.block * len(self.totals) > 2_000_000:
                self._known.clear()
            sent = self.before(np.arange(k * self.block, (k + 1) * self.block + 1))
            part = np.diff(sent, axis=0)
            x = self._known[k] = sent.tolist(), (sent[:-1].sum(1, keepdims=True) + np.cumsum(part, axis=1) - part).tolist()
        return x[0][r], x[0][r + 1], x[1][r]

    def ranges(self, q: int, base: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(start, length, place among all tokens) for n tokens behind ``base`` others of their queue."""
        x, end = base, base + n
        j = max(0, int(self.lines.when(q, x) // self.window) - 1)
        while j and self.at(j)[0][q] > x:
            j -= 1
        while x < end:
            sent, then, starts = self.at(j)
            if then[q] > x:
                stop = min(end, then[q])
                yield x - base, stop - x, starts[q] + x - sent[q]
                x = stop
                j += 1
            else:  # nothing of this queue here, and maybe not for a long while
                j = max(j + 1, int(self.lines.when(q, x) // self.window) - 1)


class Schedule:
    """Where each queue's tokens stand in the sequences."""

    def __init__(self, totals: list[int], shares: list[float], sequence: int, long: int = LONG):
        totals, shares = np.array(totals, dtype=np.int64), np.array(shares, dtype=float)
        if (shares < 0).any() or not np.isfinite(shares).all():
            raise ValueError("proportions must be finite and not negative")
        self.sequence, self.total = sequence, int(totals.sum())
        self.tail = self.total - self.total % sequence
        self.large = (shares > 0) & (shares * sequence >= QUANTUM * max(shares.sum(), 1e-300))
        self.number = np.where(self.large, np.cumsum(self.large), np.cumsum(~self.large)) - 1
        self.outer = Rounds(Folded(Clock(totals, shares), self.large), sequence, full=True)
        self.inner = Rounds(Clock(totals[~self.large], shares[~self.large]), long, full=False)

    def sequence_of(self, g: int) -> tuple[int, int, int]:
        """Number, start and end of the sequence with token g."""
        if g < self.tail:
            return g // self.sequence, g - g % self.sequence, g - g % self.sequence + self.sequence
        k, start, rest = self.tail // self.sequence, self.tail, self.total - self.tail
        while True:
            size = 1 << (rest.bit_length() - 1)
            if g < start + size:
                return k, start, start + size
            k, start, rest = k + 1, start + size, rest - size

    def pieces(self, q: int, base: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) for a document of n tokens behind ``base`` others of its queue."""
        if self.large[q]:
            found = self.outer.ranges(int(self.number[q]), base, n)
        else:
            last = len(self.outer.totals) - 1
            found = ((s + t, m, g) for s, own, c in self.inner.ranges(int(self.number[q]), base, n) for t, m, g in self.outer.ranges(last, c, own))
        for start, length, g in found:
            while length:
                number, begin, end = self.sequence_of(g)
                take = min(length, end - g)
                yield start, take, number, g - begin
                start, length, g = start + take, length - take, g + take


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sequence: int = 1024, end_id: int = 0, proportions: dict[str | None, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (uint32, little-endian), doc_tokens, sequence_id, offset."""
    queue = key_of(source_col)
    wanted = None if proportions is None else {("n" if s is None else f"v{s}"): float(v) for s, v in proportions.items()}
    if docs.select(queue).distinct().limit(MAX_QUEUES + 1).count() > MAX_QUEUES:
        hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(MAX_QUEUES)).cast("string")
        queue = hashed(queue)
        if wanted is not None:
            given = docs.sparkSession.createDataFrame(list(wanted.items()), "source string, share double")
            wanted = {r[0]: r[1] for r in given.groupBy(hashed(F.col("source"))).agg(F.sum("share")).collect()}
    rows = cut_lineage(tokenised(docs, tokenizer, id_col, text_col, queue, end_id))
    sums = cut_lineage(rows.groupBy("queue", "part").agg(F.sum("n").alias("n")))
    totals = sorted((r[0], r[1]) for r in sums.groupBy("queue").agg(F.sum("n")).collect())  # at most MAX_QUEUES rows
    names = {q: k for k, (q, _) in enumerate(totals)}
    counts = [n for _, n in totals]
    shares = [float(n) if wanted is None else wanted.get(q, 0.0) for q, n in totals]
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("queue", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    placed = rows.join(small(bases, BROADCAST_ROWS), ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("base"), "n", "ids")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, out, weight = Schedule(counts, shares, sequence), [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                doc, q, base, n, raw = (batch.column(c)[k].as_py() for c in range(5))
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes()
                for start, length, seq, offset in plan.pieces(names[q], base, n):
                    out.append((doc, start, length, ids[4 * start : 4 * (start + length)], n, seq, offset))
                weight += len(ids)
                if weight > FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out, weight = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return placed.mapInArrow(run, schema)


def digested(pieces: DataFrame) -> DataFrame:
    """:func:`pack`'s rows with a CRC-32 instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
