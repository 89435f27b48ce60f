"""Phrase mining against brute force."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwarden.llm import collocations, queries

SCHEMA = "doc_id long, lang string, text string, f int, word string, number long, n string"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=10, inside=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f.update((lang, *w[k : k + size]) for k in range(len(w) - size + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *s) for p, a in often.items() if len(p) == 4 for s in (p[1:3], p[2:4]) if 100 * a >= inside * f[(p[0], *s)]}
    out = {}
    for p, a in often.items():
        if p not in gone:
            cuts = [(1000000 * a * a // (f[p[: 1 + k]] * f[(p[0], *p[1 + k :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: 1 + k]], f[(p[0], *p[1 + k :])]))
    return sorted((lang, k + 1, phrase.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for k, (s, a, phrase, x, y) in enumerate(sorted(found)[:top]))


def sample(seed):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "and", "New", "york", "city", "été", "日本", "x", "\x00", "co-op", "a'b", " ", "\x85"]
    signs = [" ", " ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ;", "?!"]
    texts = ["".join(rng.choice(words) + rng.choice(signs) for _ in range(int(rng.integers(0, 120)))) for _ in range(60)]
    rows = [(None if k % 7 == 0 else "und" if k % 7 == 1 else ["en", "de", ""][k % 3], t) for k, t in enumerate(texts)]
    return [*rows, ("en", None), (None, None), ("fr", ""), ("fr", " .,\n"), ("en", "aa " * 3000), ("en", texts[3]), ("en", texts[3]), ("xx", "one two three " * 9), ("yy", "one two three, " * 10)]


@pytest.mark.parametrize("seed,shard_bytes,least,top", [(1, 10**9, 10, 2000), (2, 300, 10, 2000), (3, 900, 3, 7), (4, 100, 1, 2000)])
def test_collocations_equal_brute_force(spark, seed, shard_bytes, least, top):
    rows = sample(seed)
    docs = spark.createDataFrame([(k, g, t, 1, "clash", 5, "n") for k, (g, t) in enumerate(rows)], SCHEMA).repartition(3)
    got = collocations.collocations(docs, least=least, top=top, shard_bytes=shard_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least=least, top=top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, 1, "", 1, ""), (2, "a", " .", 1, "", 1, "")], SCHEMA)).count() == 0


def test_collocations_equal_their_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.SQL["op12_collocations"]).fetchall()
    assert len(want) > 100 and sorted(map(tuple, queries.op12_collocations(spark, sf).collect())) == sorted(want)


def test_bitmaps_across_blocks(monkeypatch):
    """Shifts carry from block to block, and small steps give the same counts."""
    rng = np.random.default_rng(0)
    words, begins = rng.integers(-1, 4, 1000), rng.random(1000) < 0.1
    want = Counter((int(a), int(b)) for a, b, s in zip(words, words[1:], begins[1:]) if a >= 0 and b >= 0 and not s)
    third = Counter((int(a), int(b), int(c)) for a, b, c, s, u in zip(words, words[1:], words[2:], begins[1:], begins[2:]) if min(a, b, c) >= 0 and not s and not u)
    for step in (10**6, 50, 1):
        monkeypatch.setattr(collocations, "STEP", max(step, collocations.BITS))
        maps, ids = collocations.Bitmaps(words, begins, 4), np.array([3, 5, 8, 9], np.uint64)
        codes, counts = collocations.pair_counts(maps, ids)
        assert (np.diff(codes.astype(np.int64)) > 0).all()
        number = {3: 0, 5: 1, 8: 2, 9: 3}
        assert {(number[int(c) >> 32], number[int(c) & 0xFFFFFFFF]): int(n) for c, n in zip(codes, counts)} == want
        pairs, thirds, n = collocations.triple_counts(maps, ids, codes)
        got = Counter()
        for p, t, k in zip(pairs, thirds, n):
            got[number[int(p) >> 32], number[int(p) & 0xFFFFFFFF], number[int(t)]] += int(k)
        assert got == third


def test_scores_pass_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_000)], "a long, l long, r long").select(F.expr(collocations._score("a", "l", "r")).alias("s")).first()
    assert row.s == 1000000 * 3_000_000_000_000**2 // (4_000_000_000_000 * 5_000_000_000_000)
