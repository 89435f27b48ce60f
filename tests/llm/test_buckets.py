"""What the Jaccard join deals out in buckets of near texts that don't link."""

import random
from collections import Counter

import numpy as np
import pytest
from test_ops import brute_links

from inkwarden.llm import jaccard


def near_texts(n, own, seed=1):
    """Texts of one template of 100 words, ``own`` of which each text has for itself."""
    rng, base = random.Random(seed), [f"t{k}" for k in range(100)]
    rows = []
    for k in range(n):
        w = list(base)
        for j in rng.sample(range(100), own):
            w[j] = f"own{k}x{j}"
        rows.append((k, " ".join(w)))
    return rows


def rows_dealt(spark, monkeypatch, rows, **kw):
    counts, deal = [], jaccard.dealt

    def counted(*a):
        out = deal(*a)
        counts.append(out.count())
        return out

    with monkeypatch.context() as m:
        m.setattr(jaccard, "dealt", counted)
        got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=1, num=80, den=100, **kw).collect()
    return counts[0], got


@pytest.mark.parametrize("own", [12, 8])
def test_near_texts_that_do_not_link_cost_rows_in_proportion(spark, monkeypatch, own):
    """With 12 words of their own texts can't reach the threshold by what they share; with 8 they might."""
    (some, _), (more, got) = (rows_dealt(spark, monkeypatch, near_texts(n, own)) for n in (10_000, 20_000))
    assert more <= 2.4 * some if some else more == 0
    sets, of = [set(t.split()) for _, t in near_texts(20_000, own)], {r.doc_id: r.component_id for r in got}
    assert len(got) == 20_000
    words = sorted({w for s in sets[:2000] for w in s})
    place = {w: k for k, w in enumerate(words)}
    table = np.zeros((2000, len(words)), dtype=np.float32)
    for k, s in enumerate(sets[:2000]):
        table[k, [place[w] for w in s]] = 1
    common = table @ table.T
    linked = np.argwhere(np.triu(100 * common >= 80 * (200 - common), 1))
    assert all(of[int(a)] == of[int(b)] for a, b in linked)
    assert (own == 8) or all(of[k] == k for k in range(2000))


@pytest.mark.parametrize("block", [32_768, 40])
def test_near_texts_equal_brute_force(spark, monkeypatch, block):
    """Low rows, high rows and rows that link by rare words only, in one bucket of frequent words."""
    rng = random.Random(3)
    rows = near_texts(250, 12, 2) + [(k + 1000, t) for k, t in near_texts(80, 8, 4)] + [(k + 2000, t) for k, t in near_texts(60, 3, 5)]
    rows += [(5000 + k, t.replace("t5 ", f"z{k} ")) for k, (_, t) in enumerate(rng.sample(rows, 60))]
    _, got = rows_dealt(spark, monkeypatch, rows, block=block)
    assert Counter(tuple(r)[:3] for r in got) == brute_links(rows, 1, 80, 100)
