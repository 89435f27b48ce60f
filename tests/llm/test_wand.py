"""Scores that are too small to be rounded."""

import numpy as np

from inkwarden.llm import search


def test_a_term_that_all_have_is_found():
    """Its weight, as in a very large corpus, is below what scores are rounded to."""
    words = [search.terms_of(t) for t in ["all"] * 5 + ["all other"]]
    terms, counts, docs, freqs, order = search.postings(words)
    lengths = np.array([len(w) for w in words], np.int32)[order]
    for common in (search.terms_of("all"), np.zeros(0, np.uint64)):
        shard = search.Shard(np.arange(6)[order].tobytes(), lengths.tobytes(), *(x.tobytes() for x in (terms, counts, docs, freqs)), float(lengths.mean()), common)
        rare = shard.rare_scores(search.terms_of("all"), np.full(1, 0.0 if len(common) else 5e-11))
        best = search.Best(1, 10)
        shard.search(rare[None], np.full((1, len(common)), 5e-11), best, 0)
        assert (best.scores[0][:6] > 0).all() and sorted(best.ids[0][:6].tolist()) == list(range(6))
