"""Bottom-k near-copy detection against brute force."""

import random
from collections import Counter
from math import comb

import numpy as np
import pytest
from test_buckets import near_texts
from test_ops import SCHEMA, awkward, brute_links

from inkwarden.llm import shingles, sketches


def expected(rows, size, num, den):
    return Counter({(i, n, c, i == c): k for (i, n, c), k in brute_links(rows, size, num, den).items()})


@pytest.mark.parametrize("size,num,block", [(4, 80, 16_384), (1, 60, 5), (2, 90, 40)])
def test_near_copies_equal_brute_force(spark, size, num, block):
    rows = awkward()
    got = sketches.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3), size=size, num=num, den=100, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == expected(rows, size, num, 100)


def test_near_copies_of_nothing(spark):
    assert sketches.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    got = sketches.near_copies(spark.createDataFrame([(1, None, "", "", 0, "", 0, 0), (None, " \n", "", "", 0, "", 0, 0)], SCHEMA))
    assert sorted(map(str, map(tuple, got.collect()))) == ["(1, 0, 1, True)", "(None, 0, None, True)"]


@pytest.mark.parametrize("block", [16_384, 30])
def test_a_common_passage_and_near_texts(spark, block):
    """Texts that share a passage, chains of links, and texts of one template that are near but not linked."""
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, passage + " " + " ".join(f"u{k}w{j}" for j in range(rng.randrange(0, 120)))) for k in range(150)]
    rows += [(1000 + k, t) for k, t in near_texts(200, 12, 2)] + [(2000 + k, t) for k, t in near_texts(150, 8, 4)] + [(3000 + k, t) for k, t in near_texts(80, 3, 5)]
    chain = [f"c{k}" for k in range(90)]
    for k in range(30):
        rows.append((4000 + k, " ".join(chain)))
        for j in rng.sample(range(90), 4):
            chain[j] = f"c{k}y{j}"
    rows += [(5000 + k, " ".join(f"s{j}" for j in range(k % 9 + 1))) for k in range(40)]
    rng.shuffle(rows)
    got = sketches.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=1, num=80, den=100, block=block)
    assert Counter(map(tuple, got.collect())) == expected(rows, 1, 80, 100)


def test_a_passage_of_many_texts_lists_few(spark):
    """A passage that all texts have, a third of each, costs no list entries."""
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(k, passage + " " + " ".join(f"u{k}w{j}" for j in range(100))) for k in range(400)]
    texts = sketches.sketched(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 4)
    assert sketches.lists(texts, 80, 100).count() < 400
    values = texts.selectExpr("explode(slice(sketch, 1, 64)) as v").groupBy("v").count().filter("count > 1")
    assert values.count() > 5


def test_union_sketches_lose_no_linked_pair():
    rng, texts = np.random.default_rng(7), []
    for n in [*range(1, 40), *rng.integers(40, 600, 60).tolist()]:
        s = rng.integers(0, 2**63, n).astype(np.uint64)
        part = int(rng.integers(int(0.7 * n), n + 1))
        t = np.concatenate([s[:part], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 10))).astype(np.uint64)])
        texts.append((np.unique(s), np.unique(t) if len(t) else np.unique(s)))
    for k in (sketches.LISTS, sketches.K):
        pad = lambda s: np.concatenate([s[:k], np.full(k, 2**64 - 1, np.uint64)])[:k]  # noqa: B023, E731
        x, y = np.stack([pad(s) for s, _ in texts]), np.stack([pad(t) for _, t in texts])
        near = sketches._close(x, y, np.array([len(s) for s, _ in texts]), np.array([len(t) for _, t in texts]), 80, 100)
        for (s, t), ok, union, common in zip(texts, near, *sketches.shared(x, y), strict=True):
            i = len(np.intersect1d(s, t))
            linked = 100 * i >= 80 * (len(s) + len(t) - i)
            assert ok or not linked
            whole = np.union1d(s, t)[:k]
            assert union == len(whole) and common == len(np.intersect1d(np.intersect1d(whole, s), t))
            if len(s) + len(t) <= k:
                assert ok == linked


def test_what_is_enough():
    for k in (64, 128):
        m = sketches.enough(k, 80, 100)
        tail = lambda m: sum(comb(k, j) * 0.8**j * 0.2 ** (k - j) for j in range(m))  # noqa: B023, E731
        assert tail(m) <= sketches.MISS < tail(m + 1)
    assert shingles.shingle_sets(["a b c d e"], 4)[0].dtype == np.uint64
