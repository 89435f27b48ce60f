"""Exact top-k search by BM25 with block-max pruning (WAND on blocks of documents).

Every partition turns its documents, some thousands at a time, into shards of an
inverted index: terms, postings by document, frequencies. Document counts,
average length and document frequencies are those of all shards together, so a
score is the same whatever shard a document is in, and the shards' best k merge
into the exact best k.

In a shard documents stand by their most frequent word and length, so that those
of a block of ``BLOCK`` are alike, and a term's largest contribution in a block is
near all of them. As in WAND, a query's terms are taken by their reach: those of
few documents are followed through their postings; those that one document in
``COMMON`` has (at most ``MOST_COMMON``) reach everywhere, and count by their
largest contribution in each block until a block is needed. A block is pivot for
a query if what its documents have from the rare terms, and this bound for the
common ones, can reach the k-th best score so far. Pivot blocks are scored in
full, the most promising ones first, which sets the threshold for the rest; all
other blocks are passed over. The threshold goes on to the task's next shards. A
chunk of queries is judged together, block by block. A query's terms count once;
ties go to the smaller id.

Queries are broadcast in sets of at most ``SET_TERMS`` terms, each set searched
over all shards. A task gives its best k of each query; they are merged in two
rounds of groups, each of about the square root of the number of tasks.

Cases: null text counts as empty and is found by nothing; a null id can be found
but asks nothing; repeated rows are documents of their own; a query without a
term finds nothing; a very long text is a document of its own length, and as a
query has as many terms as it has; an empty table gives an empty result; columns
of ``docs`` other than the two named are not read, so their names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, tidily
from .shingles import word_hashes

BLOCK, AHEAD = 64, 4
SHARD_CHARS, SHARD_DOCS = 24_000_000, 16_000
SET_TERMS = 3_000_000
K1, B = 1.2, 0.75
CHUNK, CHUNK_SCORES = 256, 4_000_000
COMMON, MOST_COMMON = 16, 512
NO_ID, MOST_ID = -(2**63), 2**63 - 1
#: ASCII characters that are not letters or digits part words.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTS))


def postings(words: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Terms, their document counts, documents and frequencies; and the documents' order, by their most frequent term and length."""
    lengths = np.array([len(w) for w in words], dtype=np.int32)
    every, doc = np.concatenate(words), np.repeat(np.arange(len(words), dtype=np.int64), lengths)
    order = np.argsort(every, kind="stable")
    every, doc = every[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (every[1:] != every[:-1]) | (doc[1:] != doc[:-1])])[: len(every)])
    freqs, doc = np.diff(np.append(new, len(every))).astype(np.int32), doc[new]
    terms, which, counts = np.unique(every[new], return_inverse=True, return_counts=True)
    by_freq = np.argsort(freqs, kind="stable")
    top = np.full(len(words), -1)
    top[doc[by_freq]] = which[by_freq]  # the last one written has the largest frequency
    order = np.lexsort((lengths, top))
    place = np.empty(len(words), dtype=np.int64)
    place[order] = np.arange(len(words))
    again = np.argsort(which * len(words) + place[doc], kind="stable")
    return terms, counts.astype(np.int32), place[doc[again]].astype(np.int32), freqs[again], order


def index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Shards: ids, lengths, terms, their document counts, postings (document, frequency)."""
    fields = ("ids", "lengths", "terms", "counts", "docs", "freqs")
    arrow = pa.schema([(f, pa.binary()) for f in fields])

    def shard(ids: list[int], words: list[np.ndarray]) -> pa.RecordBatch:
        terms, counts, docs, freqs, order = postings(words)
        columns = (np.array(ids, np.int64)[order], np.array([len(w) for w in words], dtype=np.int32)[order], terms, counts, docs, freqs)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], schema=arrow)

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(NO_ID if i is None else i)
                words.append(terms_of(t))
                size += len(t or "")
                if size > SHARD_CHARS or len(ids) >= SHARD_DOCS:
                    yield shard(ids, words)
                    ids, words, size = [], [], 0
        if ids:
            yield shard(ids, words)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ", ".join(f"{f} binary" for f in fields))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several ranges, one range after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Best:
    """The k best (score, document) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((queries, k), -np.inf), np.full((queries, k), MOST_ID)

    def least(self, at: slice) -> np.ndarray:
        """The k-th best score of each query, or 0: only more than that is found."""
        return np.maximum(self.scores[at, -1], 0.0)

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in some documents, none of which is there already."""
        for q in np.unique(query):
            own = query == q
            s, i = np.concatenate([self.scores[q], scores[own]]), np.concatenate([self.ids[q], ids[own]])
            top = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[top], i[top]


class Shard:
    """A shard's postings; those of the terms in ``common`` as dense blocks (blocks by terms by documents) with their largest in each block."""

    def __init__(self, ids: bytes, lengths: bytes, terms: bytes, counts: bytes, docs: bytes, freqs: bytes, average: float, common: np.ndarray):
        self.ids, self.terms = np.frombuffer(ids, np.int64), np.frombuffer(terms, np.uint64)
        counts, self.docs, freqs = np.frombuffer(counts, np.int32), np.frombuffer(docs, np.int32), np.frombuffer(freqs, np.int32)
        relative = np.frombuffer(lengths, np.int32)[self.docs] / average
        self.impact = freqs * (K1 + 1) / (freqs + K1 * (1 - B + B * relative))
        self.ends = np.concatenate([[0], np.cumsum(counts)])
        self.n_blocks = max(1, -(-len(self.ids) // BLOCK))
        self.dense = np.zeros((self.n_blocks, len(common), BLOCK))
        for row, at in enumerate(np.searchsorted(self.terms, common)):
            if at < len(self.terms) and self.terms[at] == common[row]:
                d = self.docs[self.ends[at] : self.ends[at + 1]]
                self.dense[d // BLOCK, row, d % BLOCK] = self.impact[self.ends[at] : self.ends[at + 1]]
        self.most = self.dense.max(2) if len(common) else np.zeros((self.n_blocks, 0))
        self.scored = 0  # pairs of a query and a block that were scored in full

    def rare_scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What each document has from a query's rare terms."""
        n = self.n_blocks * BLOCK
        at = np.searchsorted(self.terms, terms)
        known = np.flatnonzero(self.terms[np.minimum(at, len(self.terms) - 1)] == terms) if len(self.terms) else np.zeros(0, np.int64)
        at = at[known]
        sizes = self.ends[at + 1] - self.ends[at]
        places = spread(self.ends[at], sizes)
        return np.bincount(self.docs[places], weights=self.impact[places] * np.repeat(weights[known], sizes), minlength=n) if len(places) else np.zeros(n)

    def search(self, rare: np.ndarray, weights: np.ndarray, best: Best, first: int) -> None:
        """Queries ``first``.. of ``best``, with what documents have from their rare terms and their weights of the common ones (a row for each query)."""
        at = slice(first, first + len(rare))
        rare = rare.reshape(len(rare), self.n_blocks, BLOCK)
        bound = (rare.max(2) + weights @ self.most.T) * (1 + 1e-9) + 1e-8
        done = np.zeros(bound.shape, dtype=bool)
        ahead = np.argsort(-bound, axis=1, kind="stable")[:, :AHEAD]
        now = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(now, ahead, True, axis=1)
        for wave in range(2):
            pivot = now & (bound >= best.least(at)[:, None]) & (bound > 1e-8)
            for b in np.flatnonzero(pivot.any(0)):
                least = best.least(at)
                q = np.flatnonzero(pivot[:, b] & (bound[:, b] >= least))
                if not len(q):
                    continue
                self.scored += len(q)
                raw = rare[q, b] + weights[q] @ self.dense[b]
                # Equal texts score alike, in whatever order their parts are added; what is too small for that isn't lost.
                scores = np.round(raw, 9)
                scores = np.where(scores > 0, scores, raw)
                hit, d = np.nonzero((scores > 0) & (scores >= least[q, None] - 1e-8))
                real = d + b * BLOCK < len(self.ids)
                hit, d = hit[real], d[real]
                if len(hit):
                    best.add(first + q[hit], scores[hit, d], self.ids[d + b * BLOCK])
            done |= now
            now = ~done


def packed(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    arrow = pa.schema([("id", pa.int64()), ("terms", pa.binary()), ("n", pa.int64())])

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [np.unique(terms_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.tobytes() for t in terms], pa.binary()), pa.array([len(t) for t in terms], pa.int64())], schema=arrow)

    return queries.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, terms binary, n long")


def _search(shards: DataFrame, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, n_docs: int, average: float, k: int) -> DataFrame:
    """One set of queries over all shards."""
    sc = shards.sparkSession.sparkContext
    every = np.unique(terms)
    asked = sc.broadcast(every)

    @tidily
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.value), dtype=np.int64)
        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t, c = np.frombuffer(t, np.uint64), np.frombuffer(c, np.int32)
                at = np.searchsorted(asked.value, t)
                hit = np.flatnonzero(asked.value[np.minimum(at, len(asked.value) - 1)] == t) if len(asked.value) else np.zeros(0, np.int64)
                total[at[hit]] += c[hit]
        some = np.flatnonzero(total)
        parts = np.split(some, np.searchsorted(some, np.arange(1 << 16, len(total), 1 << 16)))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([p.astype(np.int64).tobytes() for p in parts], pa.binary()), pa.array([total[p].tobytes() for p in parts], pa.binary())], names=["part", "at", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << 16, dtype=np.int64)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
            total[np.frombuffer(at, np.int64) & 0xFFFF] += np.frombuffer(n, np.int64)
        return pa.table([table.column("part")[:1], pa.array([total.astype(np.int64).tobytes()], pa.binary())], names=["part", "n"])

    found = shards.select("terms", "counts").mapInArrow(count, "part long, at binary, n binary").groupBy("part").applyInArrow(add, "part long, n binary").collect()
    df = np.zeros((len(every) >> 16) + 1 << 16, dtype=np.int64)
    for part, n in found:  # as many counters as the set has terms
        df[part << 16 : part + 1 << 16] = np.frombuffer(n, np.int64)
    weight = np.log1p((n_docs - df[: len(every)] + 0.5) / (df[: len(every)] + 0.5))
    often = np.argsort(-df[: len(every)], kind="stable")[:MOST_COMMON]
    common = np.sort(every[often[df[often] * COMMON >= n_docs]])
    asked_of = sc.broadcast((ids, np.concatenate([[0], np.cumsum(sizes)]), terms, weight[np.searchsorted(every, terms)], common))
    slots = max(1, math.isqrt(shards.rdd.getNumPartitions()))
    arrow = pa.schema([("chunk", pa.int64()), ("slot", pa.int64()), ("query", pa.binary()), ("doc", pa.binary()), ("score", pa.binary())])

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, cut, terms, weights, common = asked_of.value
        place = np.searchsorted(common, terms)
        is_common = common[np.minimum(place, len(common) - 1)] == terms if len(common) else np.zeros(len(terms), dtype=bool)
        owner = np.repeat(np.arange(len(ids)), np.diff(cut))
        best = Best(len(ids), k)
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard(*(batch.column(c)[r].as_py() for c in range(6)), average, common)
                size = max(1, min(CHUNK, CHUNK_SCORES // (shard.n_blocks * BLOCK)))
                for first in range(0, len(ids), size):
                    last = min(len(ids), first + size)
                    w = np.zeros((last - first, len(common)))
                    on = np.flatnonzero(is_common[cut[first] : cut[last]]) + cut[first]
                    w[owner[on] - first, place[on]] = weights[on]
                    scores = []
                    for q in range(first, last):
                        few = np.flatnonzero(~is_common[cut[q] : cut[q + 1]]) + cut[q]
                        scores.append(shard.rare_scores(terms[few], weights[few]))
                    shard.search(np.array(scores), w, best, first)
        slot = TaskContext.get().partitionId() % slots
        for first in range(0, len(ids), CHUNK):
            q, column = np.nonzero(best.scores[first : first + CHUNK] > 0)
            if len(q):
                q += first
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((first // CHUNK, pa.int64()), (slot, pa.int64()), (q.tobytes(), pa.binary()), (best.ids[q, column].tobytes(), pa.binary()), (best.scores[q, column].tobytes(), pa.binary()))], schema=arrow)

    result = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def merged(table: pa.Table) -> tuple[np.ndarray, ...]:
        q, d, s = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("query", np.int64), ("doc", np.int64), ("score", np.float64)))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        top = rank < k
        return q[top], rank[top], d[top], s[top]

    def some(table: pa.Table) -> pa.Table:
        q, _, d, s = merged(table)
        return pa.table([table.column("chunk")[:1], table.column("slot")[:1], *(pa.array([x.tobytes()], pa.binary()) for x in (q, d, s))], schema=arrow)

    def every_one(table: pa.Table) -> pa.Table:
        q, rank, d, s = merged(table)
        return pa.table([pa.array(asked_of.value[0][q]), pa.array((rank + 1).astype(np.int32)), pa.array(d, mask=d == NO_ID), pa.array(s)], schema=result)

    binary = "chunk long, slot long, query binary, doc binary, score binary"
    parts = shards.select("ids", "lengths", "terms", "counts", "docs", "freqs").mapInArrow(run, binary)
    halfway = parts.groupBy("chunk", "slot").applyInArrow(some, binary)
    out = cut_lineage(halfway.groupBy("chunk").applyInArrow(every_one, "query_id long, rank int, doc_id long, score double"))
    asked.destroy()
    asked_of.destroy()
    return out


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k best of ``docs`` for each row of ``queries``."""
    shards = cut_lineage(index(docs, id_col, text_col))
    n_docs = shards.select(F.sum(F.expr("octet_length(ids) div 8"))).first()[0] or 0

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(np.frombuffer(x, np.int32).sum()) for x in batch.column(0).to_pylist())], pa.int64())], names=["n"])

    length = shards.select("lengths").mapInArrow(lengths, "n long").agg(F.sum("n")).first()[0] or 0
    asked = cut_lineage(packed(queries.filter(F.col(id_col).isNotNull()), id_col, text_col))
    terms = asked.agg(F.sum("n")).first()[0] or 0
    out = None
    sets = max(1, -(-terms // SET_TERMS))
    for s in range(sets):
        rows = asked.filter(F.pmod(F.xxhash64("id", "terms"), F.lit(sets)) == s).collect()  # about SET_TERMS terms
        rows.sort(key=lambda r: (r[0], r[1]))
        found = _search(shards, np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64), int(n_docs), length / max(n_docs, 1) or 1.0, k)
        out = found if out is None else out.unionByName(found)
    return out


def every_nth(id_col: str = "doc_id", n: int = 50) -> Column:
    return F.pmod(F.col(id_col), F.lit(n)) == 0
