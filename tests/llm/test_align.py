"""Token alignment against brute force."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from inkwarden.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, a string, b int, shard string, stripe long"
TEXTS = [
    "The quick brown fox, jumps over 13 lazy dogs.", "The quick brown fox, jumps over 13 lazy dogs.", None, "", " ", "\n", "a\nb\n\n c", "  two  spaces  ", "tail \t\r\n", "<|endoftext|> <s> </s> <unk> <0x41>",
    "é́ ﬁ naïve Ünïcödé", "日本語😀 x 한국어", "a ▁b", "▁", "nul\x00byte", "w" * 700, "word " * 3000, "x", "der die das und nicht", "SELECT * FROM t WHERE a >= 1;", "a b 　 c",
]


def brute(rows):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    byte = {}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for b in range(256):
        byte[chr(b) if b in shown else chr(256 + sum(x not in shown for x in range(b)))] = b
    name = {k: x for x, k in tok.get_vocab().items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    docs, counts = [], Counter()
    for i, text in rows:
        a, b = (tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        raw_a = [bytes(byte[c] for c in name[x]) for x in a]
        raw_b = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            docs.append((i, [], [], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        links = []
        for x, e in enumerate(ends_a):
            for y, f in enumerate(ends_b):
                if max(e - len(raw_a[x]), f - len(raw_b[y])) < min(e, f):
                    links.append((a[x], b[y]))
        counts.update(links)
        groups, at_a, at_b = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        docs.append((i, a, b, links, groups, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return Counter((i, len(a), len(b), len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha) for i, a, b, links, g, sha in docs)


@pytest.mark.parametrize("shard_bytes,stripes,each", [(10**9, 256, 2048), (200, 7, 3)])
def test_alignment_equals_brute_force(spark, shard_bytes, stripes, each):
    rows = [*enumerate(t if t is None or len(t) < 2000 else t[:2000] for t in TEXTS), (None, "The lazy fox"), (3, "x")]
    docs = spark.createDataFrame([(i, t, "clash", 1, "s", 5) for i, t in rows], SCHEMA).repartition(3)
    got = align.align(docs, A, B, shard_bytes=shard_bytes, stripes=stripes, shards_each=each)
    assert got.columns == [f.split()[0] for f in align.SCHEMA.split(", ")]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_alignment_of_nothing(spark):
    for rows in ([], [(1, None, "", 0, "", 0), (2, "", "", 0, "", 0)]):
        got = align.align(spark.createDataFrame(rows, SCHEMA), A, B).collect()
        assert [tuple(r) for r in got] == [(i, 0, 0, 0, 0, 0, 0, "") for i, *_ in rows]


def test_sides_cut_texts_where_no_token_is_cut():
    a, b = align.sides(A, B)
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list(" \n\tab.,é日▁'<>|019"), 40)) for _ in range(2000)] + [t or "" for t in TEXTS]
    whole = [t for t in texts if "▁" not in t]  # texts with that sign have no tokens
    assert [x.tolist() for x in b.ids(whole)] == [sp.encode(t) for t in whole]
    assert [x.tolist() for x in a.ids(texts)] == [tok.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_a_hot_pair_and_a_text_of_megabytes(spark):
    """One id pair has nearly all links; a shard sends it once, and sums are exact beyond what fits 32 bits."""
    docs = spark.createDataFrame([(1, "x " * 1_500_000), *((k, "x x x x") for k in range(2, 300))], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in align.align(docs, A, B, shard_bytes=100_000).collect()}
    one = got[2]
    assert len(got) == 299 and all((r.n_links, r.n_best, r.count_sum) == (one.n_links, one.n_best, one.count_sum) for k, r in got.items() if k > 1)
    links = 1_500_000 + 298 * 4
    assert got[1].n_links >= 1_500_000 and got[1].count_sum >= 1_500_000 * links and one.count_sum == 4 * links
