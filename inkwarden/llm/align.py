"""Alignment of two tokenizers' ids, counted over a corpus.

Every text is encoded with a byte-level model (side A, given the text behind a
space) and a piece model (side B, which adds that space itself). Their tokens
cover the same bytes; where both have a boundary a group ends, and an A token
and a B token whose byte ranges overlap are a link. How often an id pair is
linked in the whole corpus says which A id fits a B id best.

1. Texts are encoded once, and their ids are stored by shard.
2. A shard counts its distinct id pairs and sends them by stripe: the B ids with the
   same remainder. One stripe's counts are a dense matrix with a row for each of its
   B ids and a column for each A id; what up to ``SHARDS`` shards sent is added into a
   block of that shape first, and the blocks' sums into the stripe. The maxima of its
   rows are the best counts.
3. Each shard gets the counts of its own pairs back, in the order in which it sent
   them, and scores its links where they lie.

A block is of a size that the two vocabularies fix, whatever the corpus. A hot id is
one row of its stripe, and a shard sends it once for each partner that it has there.

Between two bytes that no piece of side B joins texts may be cut, so words are
encoded once and looked up afterwards.

Cases: a text that is null or empty, or whose ids don't give its bytes back (one that
holds U+2581, which side B takes for a space), has no tokens: zeros and an empty
digest. Null and repeated ids stay as they are, a row for each. A very long text is one
row of one shard, encoded whole. An empty table gives an empty result. Columns other
than the two named are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BUCKETS, cut_lineage, freeing_shuffles, remove, shared_folder, tidily
from .packing import Encoder, Pieces, spread

SHARD_BYTES = 2_000_000
FLUSH_BYTES = 1_000_000
STRIPES = 256
#: Shards whose pairs one block takes.
SHARDS = 2048
MEMO = 400_000
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabulary:
    """The bytes of every id, as one array with the place and length of each."""

    def __init__(self, entries: list[bytes]):
        self.length = np.array([len(x) for x in entries], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.shown = [[str(k).encode() + end for k in range(len(entries))] for end in (b",", b"|", b";")]

    def __len__(self) -> int:
        return len(self.length)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.start[ids], self.length[ids])]


class Side:
    """What both sides have: the vocabulary, and the ids of texts behind a space."""

    vocabulary: Vocabulary

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        raise NotImplementedError


class ByteSide(Side):
    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.tok.encode_special_tokens = True
        byte = {chr(b): b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)} | {chr(c): b for b, c in self.encoder.bytes.items()}
        known = self.encoder.tok.get_vocab()
        entries = [b""] * (max(known.values()) + 1)
        for entry, k in known.items():
            entries[k] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.vocabulary = Vocabulary(entries)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoder.many([" " + t for t in texts])


class PieceSide(Side):
    """Texts are cut in front of single marks that no piece has behind another character: spaces, and line feeds if the vocabulary allows it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(k) for k in range(n)]
        own = [k for k in range(n) if not (self.model.is_byte(k) or self.model.is_control(k) or self.model.is_unknown(k))]
        behind = {y for k in own for x, y in zip(names[k], names[k][1:], strict=False) if x != y}
        self.marks = [ord(m) for m, c in ((" ", "▁"), ("\n", "\n")) if c not in behind]
        self.vocabulary = Vocabulary([bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)])
        self.ahead = self.model.encode("a")
        self.pieces = Pieces(self._piece, MEMO)

    def _piece(self, raw: bytes) -> list[int]:
        return self.model.encode("a" + raw.decode())[len(self.ahead) :]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if not self.marks:
            return [np.array(self.model.encode(t) if t else [], dtype=np.uint32) for t in texts]
        raw = [b" " + t.encode() for t in texts]
        data = b"".join(raw)
        b = np.frombuffer(data, np.uint8)
        begins = np.cumsum([0, *(len(r) for r in raw)])
        cut = np.zeros(len(b) + 1, dtype=bool)
        for m in self.marks:
            cut[1:-1] |= (b[1:] == m) & (b[:-1] != m)
        cut[begins] = True
        at = np.flatnonzero(cut)
        k = self.pieces.find(data + bytes(16), at[:-1], at[1:])
        n = self.pieces.count[k].astype(np.int64)
        ids = self.pieces.ids[spread(self.pieces.start[k].astype(np.int64), n)]
        ends = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(at, begins)]
        out = np.split(ids, ends[1:-1])
        return [x if t else x[:0] for x, t in zip(out, texts, strict=True)]


@lru_cache(maxsize=1)
def sides(path_a: str, path_b: str) -> tuple[ByteSide, PieceSide]:
    """The worker's two encoders, which its tasks share."""
    return ByteSide(path_a), PieceSide(path_b)


def _width(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def _whole(v: Vocabulary, ids: list[np.ndarray], raw: list[bytes]) -> np.ndarray:
    """Which texts their ids give back."""
    size = np.array([int(v.length[x].sum()) for x in ids])
    same = size == [len(r) for r in raw]
    some = np.flatnonzero(same)
    if len(some):
        got, want = v.joined(np.concatenate([ids[k] for k in some])), np.frombuffer(b"".join(raw[k] for k in some), np.uint8)
        wrong = np.searchsorted(np.cumsum(size[some]), np.flatnonzero(got != want), side="right")
        same[some[np.unique(wrong)]] = False
    return same


def encoded(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, shard_bytes: int) -> tuple[DataFrame, str, int]:
    """doc_id, shard and the ids of both sides as a table bucketed by shard; its folder; the number of shards."""
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    buckets = min(MAX_BUCKETS, max(-(-shards // 8), min(shards, 2 * spark.sparkContext.defaultParallelism)))
    arrow = pa.schema([("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(path_a, path_b)
        kinds = [_width(len(s.vocabulary)) for s in both]

        def out(keys: list, texts: list[str]) -> pa.RecordBatch:
            found, good = [s.ids(texts) for s in both], np.array([bool(t) for t in texts])
            raw = [b" " + t.encode() for t in texts]
            for s, ids in zip(both, found, strict=True):
                good &= _whole(s.vocabulary, ids, raw)
            cols = [pa.array([x.astype(kind).tobytes() if ok else b"" for x, ok in zip(ids, good, strict=True)], pa.binary()) for ids, kind in zip(found, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *cols], schema=arrow)

        keys, texts, weight = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                keys.append(batch.column(0)[k].as_py())
                texts.append(batch.column(1)[k].as_py() or "")
                weight += len(texts[-1])
                if weight > FLUSH_BYTES:
                    yield out(keys, texts)
                    keys, texts, weight = [], [], 0
        if keys:
            yield out(keys, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, a binary, b binary")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)))
    name = f"aligned_{uuid.uuid4().hex}"
    remove(spark, folder := f"{shared_folder(spark)}/{name}", now=False)
    with freeing_shuffles(spark):
        rows.repartition(buckets, "shard").write.bucketBy(buckets, "shard").option("path", folder).option("compression", "zstd").saveAsTable(name, format="parquet")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return table, folder, shards


class Links:
    """Tokens, groups and links of the texts of a shard, laid one behind another."""

    def __init__(self, table: pa.Table, a: Vocabulary, b: Vocabulary):
        ids, self.n, ends = [], [], []
        for name, v in (("a", a), ("b", b)):
            raw = table.column(name).to_pylist()
            kind = _width(len(v))
            ids.append(np.frombuffer(b"".join(raw), kind).astype(np.int64))
            self.n.append(np.array([len(x) for x in raw], dtype=np.int64) // np.dtype(kind).itemsize)
            ends.append(np.cumsum(v.length[ids[-1]]))
        (self.a, self.b), (self.end_a, self.end_b) = ids, ends
        # Between two neighbouring ends lie bytes of one A token and one B token, and of no other such pair.
        last = int(self.end_a[-1]) if len(self.end_a) else 0
        in_a, in_b = np.zeros(last + 1, dtype=bool), np.zeros(last + 1, dtype=bool)
        in_a[self.end_a], in_b[self.end_b] = True, True
        cut = np.flatnonzero(in_a | in_b)
        self.common = np.flatnonzero(in_a & in_b)
        in_a, in_b = in_a[cut], in_b[cut]
        self.pair = self.b[np.cumsum(in_b) - in_b] << 32 | self.a[np.cumsum(in_a) - in_a]
        ends = np.concatenate([[0], self.end_a])[np.cumsum(self.n[0])]
        self.of_link, self.of_group = np.searchsorted(ends, cut), np.searchsorted(ends, self.common)

    def known(self, stripes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs, by stripe, then B and A id; the number of each link's pair; where stripes begin."""
        stripe = (self.pair >> 32) % stripes
        code = stripe << 55 | self.pair  # ids of up to 23 bits on side B, 256 stripes at most
        codes, which = np.unique(code, return_inverse=True)
        return codes & ((1 << 55) - 1), which, np.searchsorted(codes >> 55, np.arange(stripes + 1))

    def shown(self, a: Vocabulary, b: Vocabulary) -> list[str]:
        """A digest of each text's groups."""
        texts = len(self.n[0])
        ends_a, ends_b = np.isin(self.end_a, self.common, assume_unique=True), np.isin(self.end_b, self.common, assume_unique=True)
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        upto_a, upto_b = np.concatenate([[0], np.flatnonzero(ends_a) + 1]), np.concatenate([[0], np.flatnonzero(ends_b) + 1])
        order = np.zeros(len(self.a) + len(self.b), dtype=np.int64)
        order[np.arange(len(self.a)) + upto_b[group_a]] = self.a + ends_a * len(a)
        order[np.arange(len(self.b)) + upto_a[group_b + 1]] = 2 * len(a) + self.b + ends_b * len(b)
        of = [*a.shown[0], *a.shown[1], *b.shown[0], *b.shown[2]].__getitem__
        stops, out, at = np.cumsum(self.n[0] + self.n[1]).tolist(), [], 0
        for k in range(texts):
            out.append(hashlib.sha256(b"".join(map(of, order[at : stops[k]].tolist()))[:-1]).hexdigest() if stops[k] > at else "")
            at = stops[k]
        return out


def _packed(codes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Rising codes as steps, and counts, both compressed."""
    return zlib.compress(np.diff(codes, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1), zlib.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _number(raw: bytes) -> np.ndarray:
    x = zlib.decompress(raw)
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _unpacked(codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_number(codes)), _number(counts)


MET = "stripe long, shard long, codes binary, counts binary"


def counted(table: DataFrame, path_a: str, path_b: str, stripes: int) -> DataFrame:
    """The distinct pairs of each shard with their counts, a row for each stripe."""

    @tidily
    def count(rows: pa.Table) -> pa.Table:
        a, b = (s.vocabulary for s in sides(path_a, path_b))
        links, shard = Links(rows, a, b), rows.column("shard")[0].as_py()
        codes, which, cut = links.known(stripes)
        counts = np.bincount(which, minlength=len(codes))
        some = [k for k in range(stripes) if cut[k] < cut[k + 1]]
        packed = [_packed(codes[cut[k] : cut[k + 1]], counts[cut[k] : cut[k + 1]]) for k in some]
        return pa.table([pa.array(some, pa.int64()), pa.array([shard] * len(some), pa.int64()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], names=["stripe", "shard", "codes", "counts"])

    return table.filter(F.octet_length("a") > 0).groupBy("shard").applyInArrow(count, MET)


def matrix(met: DataFrame, n_a: int, n_b: int, stripes: int) -> DataFrame:
    """stripe, codes, counts and best (per code: whether its count is the largest of its B id) from rows with codes and counts."""
    height = -(-n_b // stripes)

    def added(rows: pa.Table) -> np.ndarray:
        block = np.zeros(height * n_a, dtype=np.int64)
        for codes, counts in zip(rows.column("codes").to_pylist(), rows.column("counts").to_pylist(), strict=True):
            c, n = _unpacked(codes, counts)
            np.add.at(block, (c >> 32) // stripes * n_a + (c & 0xFFFFFFFF), n)
        return block

    def told(block: np.ndarray, stripe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(block)
        return ((at // n_a * stripes + stripe) << 32) | (at % n_a), block[at], at

    @tidily
    def part(rows: pa.Table) -> pa.Table:
        stripe = rows.column("stripe")[0].as_py()
        codes, counts, _ = told(added(rows), stripe)
        packed = _packed(codes, counts)
        return pa.table([pa.array([stripe], pa.int64()), pa.array([packed[0]], pa.binary()), pa.array([packed[1]], pa.binary())], names=["stripe", "codes", "counts"])

    @tidily
    def whole(rows: pa.Table) -> pa.Table:
        stripe, block = rows.column("stripe")[0].as_py(), added(rows)
        best = block.reshape(height, n_a).max(axis=1)
        codes, counts, at = told(block, stripe)
        packed, is_best = _packed(codes, counts), np.packbits(counts == best[at // n_a])
        return pa.table([pa.array([stripe], pa.int64()), pa.array([packed[0]], pa.binary()), pa.array([packed[1]], pa.binary()), pa.array([is_best.tobytes()], pa.binary())], names=["stripe", "codes", "counts", "best"])

    parts = met.groupBy("stripe", "part").applyInArrow(part, "stripe long, codes binary, counts binary")
    return parts.groupBy("stripe").applyInArrow(whole, "stripe long, codes binary, counts binary, best binary")


def returned(met: DataFrame, sums: DataFrame, parts: int) -> DataFrame:
    """shard, stripe, and for each pair that the shard sent there its count and whether it is best."""

    @tidily
    def look(own: pa.Table, sums: pa.Table) -> pa.Table:
        codes, counts = _unpacked(sums.column("codes")[0].as_py(), sums.column("counts")[0].as_py()) if own.num_rows else (None, None)
        best = np.unpackbits(np.frombuffer(sums.column("best")[0].as_py(), np.uint8))[: len(codes)] if own.num_rows else None
        out = []
        for raw in own.column("codes").to_pylist():
            at = np.searchsorted(codes, np.cumsum(_number(raw)))
            out.append(zlib.compress((counts[at] << 1 | best[at]).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1))
        return pa.table([own.column("shard"), own.column("stripe"), pa.array(out, pa.binary())], names=["shard", "stripe", "told"])

    each = sums.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return met.groupBy("stripe", "part").cogroup(each.groupBy("stripe", "part")).applyInArrow(look, "shard long, stripe long, told binary")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, stripes: int = STRIPES, shards_each: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``, see ``SCHEMA``."""
    spark = docs.sparkSession
    n_a, n_b = (len(s.vocabulary) for s in sides(path_a, path_b))
    stripes = min(stripes, n_b)
    table, folder, shards = encoded(docs, path_a, path_b, id_col, text_col, shard_bytes)
    parts = -(-shards // shards_each)
    met = cut_lineage(counted(table, path_a, path_b, stripes).withColumn("part", F.pmod("shard", F.lit(parts).cast("long"))))
    sums = cut_lineage(matrix(met, n_a, n_b, stripes))
    back = returned(met, sums, parts)

    @tidily
    def score(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        a, b = (s.vocabulary for s in sides(path_a, path_b))
        links = Links(rows, a, b)
        codes, which, cut = links.known(stripes)
        known = np.zeros(len(codes), dtype=np.int64)
        for stripe, raw in zip(told.column("stripe").to_pylist(), told.column("told").to_pylist(), strict=True):
            known[cut[stripe] : cut[stripe + 1]] = _number(raw)
        texts, count = rows.num_rows, known[which] >> 1
        # Sums of whole numbers may pass what a double can hold.
        upto = np.concatenate([[0], np.cumsum(count)])
        ends = np.searchsorted(links.of_link, np.arange(texts + 1))
        cols = [links.n[0], links.n[1], np.bincount(links.of_group, minlength=texts), np.diff(ends), np.bincount(links.of_link, weights=known[which] & 1, minlength=texts).astype(np.int64), upto[ends[1:]] - upto[ends[:-1]]]
        return pa.table([rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols), pa.array(links.shown(a, b), pa.string())], names=[f.split()[0] for f in SCHEMA.split(", ")])

    scored = table.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(score, SCHEMA)
    remove(spark, folder, now=False)
    return scored
