"""Phrases whose words come together more often than their parts would, mined from position bitmaps.

All counts are per language, of whole texts. The words of a shard of texts stand at
the positions 0, 1, 2, ...; a word's places are a bitmap, of which only the blocks of
``BITS`` positions that have any are kept. The bitmap of a phrase, shifted by one and
cleared where a piece of text begins, is ANDed with those of the words that have the
same blocks; what is left are the places of the longer phrases, and their popcounts,
summed over the shards, are the frequencies. Phrases grow depth first, the first
words of a shard some at a time, so that few bitmaps of phrases exist at once.

A phrase is no more frequent than its parts, so shards go on from what is frequent in
the whole corpus only:

1. Words are cut out and counted per shard, and summed as rows of language and word;
   those with ``least`` occurrences get numbers.
2. Shards build bitmaps of these, extend them by one word and send the pairs' counts to
   the range of their hash; the range adds up and tells each shard which are frequent.
3. Shards extend frequent pairs by words that make one with the pair's last word, and
   send the counts of the triples. Longer phrases go on in the same way; the contract's
   longest has three words.

Numbers stand for words, two numbers for a pair: nothing is told by a hash alone. Scores
are whole-number arithmetic on decimals of 38 digits. What the driver sees is one count
for each partition of the numbered words.

Cases: null text is empty and has no words; a null language is ``und``, together with
rows that say ``und``; repeated rows count each; a very long text is
cut between pieces, which no phrase crosses, and counted whole; ties rank by frequency, then by the phrase's
bytes; an empty table gives an empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, freeing_shuffles, remove, shared_folder, tidily
from .packing import spread
from .shingles import _mix
from .wire import packed, packed_rising, unpacked, unpacked_rising

SHARD_BYTES = 4_000_000
#: Positions in a block of a bitmap.
BITS = 16
#: Parts of a language that are ranked apart before all are.
SALTS = 64
#: Pairs of blocks that are ANDed at once.
STEP = 2_000_000
_SIGN = re.compile("[.,;:!?\x0a-\x0d]")
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def lengths(text: str, most: int) -> Iterator[str]:
    """A text as one, or, if it has over ``most`` characters, cut behind signs that end a piece."""
    at = 0
    while len(text) - at > most and (end := _SIGN.search(text, at + most)):
        yield text[at : end.end()]
        at = end.end()
    if at < len(text):
        yield text[at:]


def words_of(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The words of texts, A-Z lower-cased, and which begin a piece."""
    b = np.frombuffer(b"\n".join(t.encode() for t in texts).lower() + b"\n", np.uint8)
    kind = _KIND[b]
    inside = kind == 0
    edge = np.diff(np.concatenate([[False], inside]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.cumsum(kind == 2)[starts]
    begins = np.diff(cuts, prepend=-1) != 0
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    data = b[inside]
    make = pa.LargeStringArray if len(data) > 2**31 - 1 else pa.StringArray
    kept = offsets.astype(np.int64 if make is pa.LargeStringArray else np.int32)
    return make.from_buffers(len(starts), pa.py_buffer(kept), pa.py_buffer(data)), begins


def sections(docs: DataFrame, lang_col: str, text_col: str, shard_bytes: int) -> tuple[DataFrame, str]:
    """shard, lang, n (words), words (distinct), counts, and the stream of all words as places in ``words``, twice, plus 1 where a piece begins; the table's folder."""
    spark = docs.sparkSession
    arrow = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("stream", pa.binary())])

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, texts, weight = TaskContext.get().partitionId() << 33, {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, some in texts.items():
                words, begins = words_of(some)
                if len(words):
                    coded = words.dictionary_encode()
                    at = coded.indices.to_numpy(zero_copy_only=False)
                    names = coded.dictionary.cast(pa.string())
                    counts = pa.array(np.bincount(at, minlength=len(names)), pa.int64())
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (names, counts)]
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([lang], pa.string()), pa.array([len(words)], pa.int64()), *lists, pa.array([(at.astype(np.uint32) * 2 + begins).astype("<u4").tobytes()], pa.binary())], schema=arrow)

        for batch in batches:
            for k in range(batch.num_rows):
                lang, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                for own in lengths(text or "", shard_bytes):
                    texts.setdefault(lang, []).append(own)
                    weight += len(own)
                    if weight > shard_bytes:
                        yield from out()
                        shard, texts, weight = shard + 1, {}, 0
        yield from out()

    remove(spark, folder := f"{shared_folder(spark)}/sections_{uuid.uuid4().hex}", now=False)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col))
    rows.mapInArrow(run, "shard long, lang string, n long, words array<string>, counts array<long>, stream binary").write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder), folder


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with whole numbers from 0 on in column ``name``, without a shuffle; the driver sees a count for each partition."""
    df = cut_lineage(df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row")))
    sizes = sorted((r["_part"], r["n"]) for r in df.groupBy("_part").agg(F.count("*").alias("n")).collect())
    first, total = {}, 0
    for part, n in sizes:
        first[part] = total
        total += n
    if total > 1 << 32:
        raise ValueError("more than 2^32 frequent words")
    if not sizes:
        return df.select(*[c for c in df.columns if c not in ("_part", "_row")], F.lit(0).cast("long").alias(name))
    begin = F.broadcast(df.sparkSession.createDataFrame([*first.items()], "_part int, _first long"))
    return df.join(begin, "_part").withColumn(name, F.col("_first") + F.col("_row")).drop("_part", "_row", "_first")


class Bitmaps:
    """The positions of a shard's words, by number, as blocks of bits."""

    def __init__(self, words: np.ndarray, begins: np.ndarray, n_words: int):
        """words: the number of each position's word, negative for none."""
        at = np.flatnonzero(words >= 0)
        self.blocks = len(words) // BITS + 1
        order = np.argsort(words[at], kind="stable")
        at, word = at[order], words[at[order]]
        bit = np.left_shift(1, at % BITS).astype(np.uint32)
        key = word * self.blocks + at // BITS
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.word, self.block = word[first], key[first] % self.blocks
        self.bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        self.of_word = np.searchsorted(self.word, np.arange(n_words + 1))
        order = np.argsort(self.block, kind="stable")
        self.word_there, self.bits_there = self.word[order], self.bits[order]
        self.of_block = np.searchsorted(self.block[order], np.arange(self.blocks + 1))
        goes_on = np.zeros(self.blocks * BITS, dtype=bool)
        goes_on[: len(begins)] = ~begins
        self.open = goes_on.reshape(-1, BITS) @ np.left_shift(1, np.arange(BITS)).astype(np.uint32)
        self.expected = np.cumsum(np.concatenate([[0], np.diff(self.of_block)[self.block]]))

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bitmaps of phrases by one word longer: number of the phrase, word, block, bits."""
        over = np.flatnonzero(bits >> (BITS - 1))
        phrase, block, bits = np.concatenate([phrase, phrase[over]]), np.concatenate([block, block[over] + 1]), np.concatenate([(bits << 1) & ((1 << BITS) - 1), np.ones(len(over), np.uint32)])
        inside = block < self.blocks
        bits = np.where(inside, bits & self.open[np.minimum(block, self.blocks - 1)], 0)
        some = np.flatnonzero(bits)
        phrase, block, bits = phrase[some], block[some], bits[some]
        n = self.of_block[block + 1] - self.of_block[block]
        there = spread(self.of_block[block], n)
        both = np.repeat(bits, n) & self.bits_there[there]
        hit = np.flatnonzero(both)
        own = np.repeat(np.arange(len(n)), n)[hit]
        return phrase[own], self.word_there[there[hit]], block[own], both[hit].astype(np.uint32)

    def parts(self) -> Iterator[slice]:
        """First words, some at a time, as the places of their blocks."""
        after = np.searchsorted(self.expected[self.of_word], np.arange(STEP, self.expected[-1], STEP))
        cuts = np.unique(np.concatenate([[0], self.of_word[after], [len(self.word)]]))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield slice(int(i), int(j))

    def seconds(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """First word, second word, block and bits of all pairs, some first words at a time."""
        for s in self.parts():
            yield self.extend(self.word[s], self.block[s], self.bits[s])


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def pair_counts(maps: Bitmaps, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising codes of the shard's pairs, and their frequencies."""
    codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for one, two, _, bits in maps.seconds():
        c, n = _summed(ids[one] << np.uint64(32) | ids[two], np.bitwise_count(bits))
        codes.append(c)
        counts.append(n)
    return np.concatenate(codes), np.concatenate(counts)


def triple_counts(maps: Bitmaps, ids: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of the first two words, third word and frequency of what extends a frequent pair to two; ``frequent`` rises."""
    pairs, thirds, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def place(code: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(frequent, code), max(0, len(frequent) - 1))
        return np.where(frequent[at] == code, at, -1) if len(frequent) else np.full(len(code), -1)

    for one, two, block, bits in maps.seconds() if len(frequent) else ():
        pair = place(ids[one] << np.uint64(32) | ids[two])
        some = np.flatnonzero(pair >= 0)
        for k in range(0, len(some), STEP // BITS):
            own = some[k : k + STEP // BITS]
            phrase, three, _, left = maps.extend(pair[own], block[own], bits[own])
            good = place((frequent[phrase] << np.uint64(32)) | ids[three]) >= 0
            phrase, three, left = phrase[good], three[good], left[good]
            code, n = _summed(phrase * len(ids) + three, np.bitwise_count(left))
            pairs.append(frequent[code // len(ids)])
            thirds.append(ids[code % len(ids)])
            counts.append(n)
    return np.concatenate(pairs), np.concatenate(thirds), np.concatenate(counts)


def _bitmaps(ids: bytes, stream: bytes) -> tuple[Bitmaps, np.ndarray]:
    ids, stream = np.frombuffer(ids, "<u8"), np.frombuffer(stream, "<u4")
    return Bitmaps((stream >> 1).astype(np.int64) - 1, (stream & 1).astype(bool), len(ids)), ids


PARTS = "kind int, part long, shard long, a binary, b binary, c binary"
_FIELDS = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("shard", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS) if rows else _FIELDS.empty_table()


def _dealt(codes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by part, which rises within each; where parts begin."""
    part = (_mix(codes) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def mined_pairs(table: DataFrame, known: DataFrame, parts: int) -> DataFrame:
    """Of each shard its words and stream by their numbers (kind 0), and pairs with their counts by part (kind 1)."""

    @tidily
    def mine(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _FIELDS.empty_table()
        shard = rows.column("shard")[0].as_py()
        found = {}
        langs = known.column("lang").combine_chunks().dictionary_encode()
        at = langs.indices.to_numpy(zero_copy_only=False)
        place, number = (known.column(c).to_numpy() for c in ("place", "number"))
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            found[lang] = np.flatnonzero(at == k)
        ids = np.unique(number).astype(np.uint64)
        streams = []
        order = np.argsort(np.array(rows.column("lang").to_pylist(), dtype=object), kind="stable").tolist()
        langs, raw = rows.column("lang").to_pylist(), rows.column("stream").to_pylist()
        for k in order:
            stream, own = np.frombuffer(raw[k], "<u4"), found.get(langs[k], np.zeros(0, np.int64))
            of = np.zeros(int(stream.max() >> 1) + 1, dtype=np.uint32)
            of[place[own]] = np.searchsorted(ids, number[own].astype(np.uint64)) + 1
            streams.append(of[stream >> 1] * 2 + (stream & 1))
        raw_ids, raw_stream = ids.astype("<u8").tobytes(), np.concatenate(streams).astype("<u4").tobytes()
        codes, counts = pair_counts(*_bitmaps(raw_ids, raw_stream))
        order, cut = _dealt(codes, parts)
        codes, counts = codes[order], counts[order]
        sent = [(1, k, shard, packed_rising(codes[cut[k] : cut[k + 1]]), packed(counts[cut[k] : cut[k + 1]]), None) for k in range(parts) if cut[k] < cut[k + 1]]
        return _table([(0, None, shard, raw_ids, raw_stream, None), *sent])

    return table.select("shard", "lang", "stream").groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(mine, PARTS)


def summed_pairs(mined: DataFrame, least: int) -> DataFrame:
    """For each part its frequent pairs with their sums (kind 2), and for each shard which of those that it sent are frequent (kind 3)."""

    @tidily
    def add(rows: pa.Table) -> pa.Table:
        part, shards = rows.column("part")[0].as_py(), rows.column("shard").to_pylist()
        codes = [unpacked_rising(x) for x in rows.column("a").to_pylist()]
        known, which = np.unique(np.concatenate(codes), return_inverse=True)
        sums = np.zeros(len(known), dtype=np.int64)
        np.add.at(sums, which, np.concatenate([unpacked(x) for x in rows.column("b").to_pylist()]).astype(np.int64))
        often = sums >= least
        told = np.split(often[which], np.cumsum([len(x) for x in codes])[:-1])
        rows = [(3, part, s, np.packbits(x).tobytes(), None, None) for s, x in zip(shards, told, strict=True)]
        return _table([(2, part, None, packed_rising(known[often]), packed(sums[often]), None), *rows])

    return mined.filter("kind = 1").groupBy("part").applyInArrow(add, PARTS)


def mined_triples(mined: DataFrame, told: DataFrame, parts: int) -> DataFrame:
    """Triples with their counts by part (kind 1)."""

    @tidily
    def mine(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _FIELDS.empty_table()
        maps, ids = _bitmaps(rows.column("a")[0].as_py(), rows.column("b")[0].as_py())
        codes, _ = pair_counts(maps, ids)
        order, cut = _dealt(codes, parts)
        often = np.zeros(len(codes), dtype=bool)
        for part, bits in zip(told.column("part").to_pylist(), told.column("a").to_pylist(), strict=True):
            own = order[cut[part] : cut[part + 1]]
            often[own] = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(own)].astype(bool)
        pairs, thirds, counts = triple_counts(maps, ids, codes[often])
        order, cut = _dealt(pairs ^ _mix(thirds), parts)
        pairs, thirds, counts = pairs[order], thirds[order], counts[order]
        shard = rows.column("shard")[0].as_py()
        return _table([(1, k, shard, *(packed(x[cut[k] : cut[k + 1]]) for x in (pairs, thirds, counts))) for k in range(parts) if cut[k] < cut[k + 1]])

    return mined.filter("kind = 0").groupBy("shard").cogroup(told.filter("kind = 3").groupBy("shard")).applyInArrow(mine, PARTS)


def pair_rows(told: DataFrame) -> DataFrame:
    """one, two, f."""

    @tidily
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, sums = unpacked_rising(batch.column(0)[k].as_py()), unpacked(batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array((codes >> np.uint64(32)).astype(np.int64)), pa.array((codes & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(sums.astype(np.int64))], names=["one", "two", "f"])

    return told.filter("kind = 2").select("a", "b").mapInArrow(run, "one long, two long, f long")


def triple_rows(mined: DataFrame, least: int) -> DataFrame:
    """one, two, three, f."""

    @tidily
    def add(rows: pa.Table) -> pa.Table:
        pairs, thirds, counts = (np.concatenate([unpacked(x) for x in rows.column(c).to_pylist()]) for c in ("a", "b", "c"))
        order = np.lexsort((thirds, pairs))
        pairs, thirds, counts = pairs[order], thirds[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (thirds[1:] != thirds[:-1])]))
        sums = np.add.reduceat(counts.astype(np.int64), first)
        own = first[sums >= least]
        return pa.table([pa.array(x.astype(np.int64)) for x in (pairs[own] >> np.uint64(32), pairs[own] & np.uint64(0xFFFFFFFF), thirds[own], sums[sums >= least])], names=["one", "two", "three", "f"])

    return mined.groupBy("part").applyInArrow(add, "one long, two long, three long, f long")


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Frequent words (number, lang, word, f), pairs (one, two, f) and triples (one, two, three, f); lang and n, all its words."""
    total = docs.select(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    parts = max(1, total // (4 * shard_bytes))
    table, folder = sections(docs, lang_col, text_col, shard_bytes)
    totals = cut_lineage(table.groupBy("lang").agg(F.sum("n").alias("n")))
    each = table.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    often = each.groupBy("lang", "word").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    words = cut_lineage(numbered(often, "number"))
    again = docs.sparkSession.read.parquet(folder)  # a frame of its own: both meet below
    placed = again.select("shard", "lang", F.posexplode("words").alias("place", "word"))
    known = placed.join(words.select("lang", "word", "number"), ["lang", "word"]).select("shard", "lang", "place", "number")
    mined = cut_lineage(mined_pairs(table, known, parts))
    remove(docs.sparkSession, folder)
    told = cut_lineage(summed_pairs(mined, least))
    triples = cut_lineage(triple_rows(mined_triples(mined, told, parts), least))
    return words, cut_lineage(pair_rows(told)), triples, totals


def _score(a: str, left: str, right: str) -> str:
    return f"(CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0))) DIV (CAST({left} AS DECIMAL(18,0)) * CAST({right} AS DECIMAL(18,0)))"


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, inside: int = 50, top: int = 2000, **kw) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases; a phrase goes if a longer one has ``inside`` per cent of its occurrences."""
    words, pairs, triples, totals = phrases(docs, lang_col, text_col, least, **kw)
    word = lambda k: words.select(F.col("number").alias(k), F.col("word").alias(f"word_{k}"), F.col("f").alias(f"f_{k}"), *([F.col("lang")] if k == "one" else []))
    longer = triples.select("one", "two", "f").unionByName(triples.select(F.col("two").alias("one"), F.col("three").alias("two"), "f")).groupBy("one", "two").agg(F.max("f").alias("most"))
    lone = pairs.join(longer, ["one", "two"], "left").filter(F.coalesce(100 * F.col("most") < inside * F.col("f"), F.lit(True)))
    two = lone.join(word("one"), "one").join(word("two"), "two").select("lang", F.concat_ws(" ", "word_one", "word_two").alias("phrase"), F.col("f").alias("a"), F.col("f_one").alias("l"), F.col("f_two").alias("r")).withColumn("score", F.expr(_score("a", "l", "r")))
    head, tail = pairs.select("one", "two", F.col("f").alias("f_head")), pairs.select(F.col("one").alias("two"), F.col("two").alias("three"), F.col("f").alias("f_tail"))
    three = triples.join(head, ["one", "two"]).join(tail, ["two", "three"]).join(word("one"), "one").join(word("two"), "two").join(word("three"), "three")
    cut = F.least(F.struct(F.expr(_score("f", "f_one", "f_tail")).alias("score"), F.lit(1).alias("k"), F.col("f_one").alias("l"), F.col("f_tail").alias("r")), F.struct(F.expr(_score("f", "f_head", "f_three")).alias("score"), F.lit(2).alias("k"), F.col("f_head").alias("l"), F.col("f_three").alias("r")))
    three = three.withColumn("cut", cut).select("lang", F.concat_ws(" ", "word_one", "word_two", "word_three").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # The best of each of ``SALTS`` parts of a language first: its best are among them, and no task gets more than those.
    dealt = two.unionByName(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).repartition("lang", "salt")  # else one deal by language serves both
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
