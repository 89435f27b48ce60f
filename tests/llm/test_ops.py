"""The training-data operators against brute force on small and awkward tables."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from inkwarden.llm import dedup, graph, jaccard, langid, license, mixing, packing, quality, search, shingles, suffix_dedup, toxicity
from inkwarden.llm.common import boxed

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _row int, size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "eps", "zeta", "ÉTA", "theta", "日本", "x"]
    sentence = lambda n: " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(n))
    base, long = sentence(60), sentence(3000)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "en", None), (4, base.replace("a", "A", 1), "de", ""), (5, None, "en", "a"), (6, "", None, "b"), (7, " \n\t ", "en", "b"),
        (8, "one", "en", "c"), (8, "one", "en", "c"), (9, "one two", "fr", "c"), (None, base, "en", "a"), (None, None, None, None), (10, long, "en", "a"), (11, long[:9000] + " changed " + long[9000:], "en", "b"),
        (12, "ZZ " + base[:200], "en", "ü"), (13, sentence(200), "en", "a"), (14, "a\x0bb\x0cc d", "en", "c"), (15, "<|endoftext|> a  b\n\nc", "en", "c"), (16, sentence(40) + "\n" + base[:120], "es", "b"),
    ]
    for k in range(20, 60):
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{k}"
        rows.append((k, " ".join(w), "en", "hot"))
    return [(i, t, g, s, len(t or ""), "clash", 7, 9) for i, t, g, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    got = dedup.exact_dedup(docs, max_live=4).collect()
    groups = defaultdict(list)
    for i, t, *_ in awkward():
        groups[t or ""].append(i)
    assert len(got) == len(awkward()) and sum(r.kept for r in got) == len(groups)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = sha[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(ids), max((i for i in ids if i is not None), default=None))
        assert not r.kept or r.doc_id == r.keep_id
    left = dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted((r.text or "") for r in left.collect()) == sorted(groups)
    assert dedup.exact_dedup(empty).count() == 0 and dedup.drop_copies(empty).count() == 0


def test_cuckoo_index():
    index, digests = dedup.CuckooIndex(buckets=2), [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    assert all(index.insert(d, (k, k)) for k, d in enumerate(digests)) and not index.insert(digests[5], (9999, 1), 2)
    assert index.find(digests[5])[1:] == [(9999, 1), 3] and index.n > 2 and index.live == 3000
    for d in digests[::2]:
        assert index.delete(d)
    assert index.delete(digests[0]) is None and index.find(digests[0]) is None and all(index.find(d) for d in digests[1::2])
    assert len(index.drain()) == 1500 and index.live == 0 and not any(index.table)


def brute_links(rows, size, num, den):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * i >= num * (len(sets[a]) + len(sets[b]) - i):
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(sets)):
        members[find(k)].append(rows[k][0])
    return Counter((rows[k][0], len(sets[k]), min((i for i in members[find(k)] if i is not None), default=None)) for k in range(len(sets)))


@pytest.mark.parametrize("size,num,den,block", [(3, 90, 100, 2000), (5, 80, 100, 2000), (2, 70, 100, 5)])
def test_jaccard_join(docs, size, num, den, block):
    got = jaccard.link(docs, size=size, num=num, den=den, block=block, shard_bytes=5000)
    assert Counter(tuple(r)[:3] for r in got.collect()) == brute_links(awkward(), size, num, den)


def test_jaccard_join_of_a_large_bucket(spark):
    """5,000 near copies share their common words; pairs are given about once, not in every bucket."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(5000):
        w = list(base)
        for _ in range(3):  # similar to the base, and too far from most others
            w[rng.randrange(len(w))] = f"e{k}x{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=1, num=97, den=100, block=300).collect()
    # Linked are the few that share two edits or more; each component's smallest id is in it, and the sizes are those of the sets.
    sets = [set(t.split()) for _, t in rows]
    assert len(got) == 5000 and all(r.n_shingles == len(sets[r.doc_id]) for r in got)
    members = defaultdict(list)
    for r in got:
        members[r.component_id].append(r.doc_id)
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 97 * len(sets[a] | sets[b])
    of = {r.doc_id: r.component_id for r in got}
    assert all(c == min(ds) for c, ds in members.items())
    assert all(of[a] == of[b] for a in range(0, 5000, 50) for b in range(5000) if near(a, b))
    assert all(any(near(a, b) for b in ds if b != a) for ds in members.values() if len(ds) > 1 for a in ds[:3])


def test_candidates_come_once_for_all_buckets_of_a_pair(spark):
    rng = np.random.default_rng(6)
    common = rng.integers(1, 2**62, 40)
    rows = []
    for u in range(60):
        s = np.unique(np.concatenate([common, rng.integers(1, 2**62, 3)])).astype(np.uint64)
        rows += [(int(t), u, len(s), bytearray(jaccard._bitmap(s).tobytes()), u) for t in common]
    df = spark.createDataFrame(rows, "token long, uid long, n long, bitmap binary, comp long")
    for block in (500, 7):
        assert sorted(map(tuple, jaccard.candidates(df, 70, 100, block).collect())) == [(a, b) for a in range(60) for b in range(a + 1, 60)]


def test_jaccard_join_keeps_one_of_each_group(docs, empty):
    left = jaccard.drop_near_copies(docs)
    want = {i for i, n, c in brute_links(awkward(), 5, 80, 100) if n == 0 or i == c}
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == want
    assert [r.text for r in left.filter("doc_id IS NULL").collect()] == [None]
    assert jaccard.link(empty).count() == 0 and jaccard.drop_near_copies(empty).count() == 0


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(150):
        s = np.unique(rng.integers(0, 2**63, rng.integers(5, 300)).astype(np.uint64))
        sets += [s, np.sort(np.concatenate([s[: int(len(s) * 0.97)], rng.integers(0, 2**63, 2).astype(np.uint64)]))]
    tree = jaccard.SignatureTree(np.arange(len(sets)), np.array([len(s) for s in sets]), np.frombuffer(b"".join(jaccard._bitmap(s).tobytes() for s in sets), np.uint8).reshape(len(sets), -1), np.arange(len(sets)))
    found = {tuple(sorted(map(int, p))) for a, b in jaccard.traverse(tree, tree, 90, 100) for p in zip(a, b, strict=True)}
    for a in range(len(sets)):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * i < 90 * (len(sets[a]) + len(sets[b]) - i) or (b, a) in found
    assert len(found) < len(sets) * 5


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    best = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            best[a] = best[b] = min(best[a], best[b])
    assert got == {n: c for n, c in best.items() if any(n in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("shard_bytes", [2_000_000, 4000])
def test_suffix_dedup(docs, empty, shard_bytes):
    rows = sorted(((i, (t or "").encode()) for i, t, *_ in awkward()), key=lambda r: (r[0] is not None, r[0] or 0))
    first, want = {}, Counter()
    for i, b in rows:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] != i:
                gone[k : k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(b) else 0))
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    got = suffix_dedup.digested(suffix_dedup.repeated_passages(docs, shard_bytes=shard_bytes))
    assert Counter(map(tuple, got.collect())) == want
    assert suffix_dedup.repeated_passages(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_transforms_are_merged_without_their_contexts(seed):
    """Shards' positional transforms, merged by interleaving, give the windows that an earlier context of the anchor has."""
    rng = np.random.default_rng(seed)
    width, window, parts = 12, 6, []
    for s in range(1 + seed):
        n = int(rng.integers(1, 40))
        ctx, group = rng.integers(0, 2 if seed % 2 else 4, (n, width)).astype(np.uint8), np.sort(rng.integers(0, 4, n))
        parts.append((suffix_dedup.transform(ctx, group), np.full(n, s), group, rng.integers(0, 15, n), ctx))
    columns, shard, group, ids, ctx = (np.concatenate([p[k] for p in parts], axis=1 if k == 0 else 0) for k in range(5))
    masks = suffix_dedup.merge(columns, shard, group, ids, window)
    for i in range(len(ids)):
        for o in range(width - window + 1):
            earlier = any(group[j] == group[i] and ids[j] < ids[i] and (ctx[j, o : o + window] == ctx[i, o : o + window]).all() for j in range(len(ids)))
            assert bool(masks[i] >> o & 1) == earlier


def test_mixing(docs, empty):
    mixed = mixing.mix(mixing.measured(docs, boxed(docs, "doc_id")))
    rows = [(r._key, r._size, r._source_size, r._target, r._repeats * r._size + r._extra) for r in mixed.collect()]
    assert len(rows) == len(awkward()) and all(0 <= taken <= 3 * size for _, size, _, _, taken in rows)
    total, taken = sum(r[1] for r in rows), defaultdict(int)
    for key, _, _, target, t in rows:
        taken[key] += t
    target = {key: t for key, _, _, t, _ in rows}
    size = {key: n for key, _, n, _, _ in rows}
    assert all(abs(taken[k] - target[k]) <= 0.5 for k in target) and math.isclose(sum(target.values()), total)
    order = sorted((k for k in target if k != "n")) + ["n"]
    level = max(target[k] / (j % 3 + 1) for j, k in enumerate(order))
    for j, k in enumerate(order):
        assert target[k] <= 3 * size[k] and (math.isclose(target[k], (j % 3 + 1) * level) or math.isclose(target[k], 3 * size[k]))
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(mixing.measured(docs.repartition(7), boxed(docs, "doc_id"))).collect()))
    again = mixing.repeated(docs)
    assert again.columns == docs.columns and mixing.repeated(empty).count() == 0
    times = Counter(r.doc_id for r in again.collect())
    assert max(times[i] for i in (10, 11, 13)) <= 3 and times[5] == times[6] == 0


def test_packing(docs, empty):
    got = packing.digested(packing.pack(docs, BPE)).collect()
    tok = packing.Encoder(BPE).tok
    want = Counter()
    for i, t, *_ in awkward():
        want[i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    ids = {(i, len(x)): np.array(x, "<u4") for i, t, *_ in awkward() for x in [[*tok.encode(t or "", add_special_tokens=False).ids, 0]]}
    for key, rs in pieces.items():
        assert sum(r.length for r in rs) == key[1] * want[key]
        if key[0] is not None:
            assert all(r.ids_crc32 == zlib.crc32(ids[key][r.start : r.start + r.length].tobytes()) for r in rs)
        if want[key] == 1:
            at = 0
            for r in sorted(rs, key=lambda r: r.start):
                assert r.start == at
                at += r.length
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0
    assert sum(1 for rs in sequences.values() if sum(r.length for r in rs) < 1024) <= 10
    assert packing.pack(empty, BPE).count() == 0


def test_packing_mixes_within_sequences(spark, docs):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(60)), f"s{k % 4}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for proportions in (None, {"s0": 5.0, "s1": 2.0, "s2": 1.0, "s3": 0.0}):
        got = packing.pack(df, BPE, proportions=proportions).collect()
        totals, sequences = defaultdict(int), defaultdict(Counter)
        for r in got:
            totals[f"s{r.doc_id % 4}"] += r.length
            sequences[r.sequence_id][f"s{r.doc_id % 4}"] += r.length
        left, weight = dict(totals), proportions or dict(totals)
        full = 0
        for k in sorted(sequences):
            live = {s: weight[s] for s in left if left[s] > 0 and weight[s]} or {s: totals[s] for s in left if left[s] > 0}
            want = {s: 1024 * w / sum(live.values()) for s, w in live.items()}
            if all(left[s] > w + 3 for s, w in want.items()):  # while the queues last
                assert all(abs(sequences[k][s] - want.get(s, 0)) <= 2 for s in left), (k, sequences[k], want)
                full += 1
            for s in left:
                left[s] -= sequences[k][s]
        assert full > 10


def test_packing_keeps_proportions_of_many_sources(spark):
    n = 5000
    df = spark.range(n).selectExpr("id AS doc_id", "repeat('word ', 39) || 'end' AS text", "concat('s', id) AS source").repartition(4)
    heavy = {f"s{k}": 9.0 if k % 2 else 1.0 for k in range(n)}
    got = packing.pack(df, BPE, proportions=heavy).select("doc_id", "start", "length", "sequence_id").collect()
    total = sum(r.length for r in got)
    early = [sum(r.length for r in got if r.doc_id % 2 == odd and r.sequence_id < total // 1024 // 4) for odd in (0, 1)]
    assert 0.85 < early[1] / sum(early) < 0.95
    packing.MAX_QUEUES, old = 50, packing.MAX_QUEUES
    try:
        hashed = packing.pack(df, BPE, proportions={f"s{k}": 1.0 for k in range(n)})
        assert hashed.agg(F.sum("length")).first()[0] == total
    finally:
        packing.MAX_QUEUES = old


def place(schedule, number, offset):
    if number < schedule.tail // schedule.sequence:
        return number * schedule.sequence + offset
    at, rest = schedule.tail, schedule.total - schedule.tail
    for _ in range(number - schedule.tail // schedule.sequence):
        size = 1 << (rest.bit_length() - 1)
        at, rest = at + size, rest - size
    return at + offset


@pytest.mark.parametrize("seed", range(25))
def test_packing_schedule_places_every_token_once(seed):
    rng, cut = np.random.default_rng(seed), random.Random(seed)
    n = int(rng.integers(1, 12))
    totals, shares = rng.integers(0, 1500, n).tolist(), (rng.random(n) ** 6 * (rng.random(n) > 0.2)).tolist()
    s = packing.Schedule(totals, shares, int(rng.choice([1, 7, 64, 256])), int(rng.choice([64, 1000])))
    seen = np.zeros(sum(totals), dtype=int)
    for q, total in enumerate(totals):
        base = 0
        while base < total:
            m, at = min(total - base, cut.randrange(1, 90)), 0
            for start, length, number, offset in s.pieces(q, base, m):
                assert start == at and length > 0
                seen[place(s, number, offset) : place(s, number, offset) + length] += 1
                at += length
            assert at == m
            base += m
    assert (seen == 1).all()
    with pytest.raises(ValueError):
        packing.Schedule([1], [-1.0], 8)


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(BPE)
    texts = ["", " ", "a b", "a  b", "é\nb", "\n", "x \n", "it's, don't!", "12,345 a.b", "日本 語", "<|endoftext|> x", "a\tb c\r\nd", "word. Word? (x)", "naïve café", " a", "\nb", "b\n", "., ,.", "a\x00 b\x00\x00 c", "supercalifragilisticexpialidocious " * 3 + "x"]
    for _ in range(2):
        assert [x.tolist() for x in e.many(texts)] == [e.whole(t) for t in texts]
        assert all(e.many([t])[0].tolist() == e.whole(t) for t in texts)
    many = [f"w{k}x{k % 7}," for k in range(500)]
    text = " ".join(many)
    e.pieces.most = 100  # so that pieces go and come
    assert all(e.many([text, many[0]])[0].tolist() == e.whole(text) for _ in range(3))


def test_language_id(spark, empty):
    rng = random.Random(2)
    parts = {"en": "the ing tion er wh ou".split(), "de": "der ung keit sch ei zu".split(), "fr": "le eau tion ou ai é".split()}
    rows = [(k, " ".join("".join(rng.choices(parts[g], k=3)) for _ in range(40)), g) for k in range(400) for g in [list(parts)[k % 3]]]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, "the " * 5000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_id(df).collect()}
    want = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    assert {i: r.held_out for i, r in got.items()} == want and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].lang_pred, g) for i, _, g in rows[:400] if want[i]]
    assert np.mean([a == b for a, b in held]) > 0.95 and got[903].lang_pred == "en"
    assert all(got[i].lang_pred == "und" for i in (900, 901, 902))
    assert langid.language_id(empty).count() == 0


def test_language_id_equals_brute_force(spark):
    """The query's languages and scores against parsing by searching the training text."""
    rng = random.Random(12)
    parts = {"de": "der ung keit sch ei zu".split(), "en": "the ing tion er wh ou".split(), "fr": "le eau tion ou ai é".split()}
    rows = [(k, " ".join("".join(rng.choices(parts[g], k=3)) for _ in range(rng.randrange(1, 25))), g) for k in range(90) for g in [list(parts)[k % 3]]]
    rows += [(200, "", "en"), (201, "１ 。 😀", "de"), (None, "the ou", None), (202, "the ou", None), (202, "the ou", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = langid.learn(df.filter(~langid.held_out("doc_id", 4, 2)), "doc_id", "text", "lang", 6000)
    p = langid.Parser(texts)
    spelled = {g: p.squeeze(t).tolist() for g, t in texts.items()}

    def phrases(train, t):
        joined, n, k = "".join(map(chr, train)), 0, 0
        while k < len(t):
            j = k + 1
            while j < len(t) and "".join(map(chr, t[k : j + 1])) in joined:
                j += 1
            n, k = n + 1, j
        return n

    want = Counter()
    for i, t, _ in rows:
        symbols = p.squeeze(t).tolist()
        assert len(symbols) < langid.LANE
        lang, score = "und", 0.0
        if any(symbols):
            entropy = [phrases(spelled[g], symbols) * math.log2(max(2, len(spelled[g]))) / len(symbols) for g in texts]
            best = min(range(len(entropy)), key=lambda k: entropy[k])
            lang, score = list(texts)[best], 1 / sum(2 ** (-langid.SHARPNESS * (e - entropy[best])) for e in entropy)
        want[i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, lang, round(score, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in langid.language_id(df, sample_chars=6000).collect()) == want


def test_cross_parse_counts_longest_matches():
    p = langid.Parser({"x": "abcabd", "y": "zzzzab"})
    text = "abcabdabzz"

    def phrases(train, t):
        n, k = 0, 0
        while k < len(t):
            j = k + 1
            while j < len(t) and t[k : j + 1] in train:
                j += 1
            n, k = n + 1, j
        return n

    assert p.phrases([p.squeeze(text)]).tolist() == [[phrases("abcabd", text), phrases("zzzzab", text)]]


def test_language_id_beyond_the_basic_letters():
    p = langid.Parser({"en": "the weather is fine today and the sea is calm", "fr": "le temps est beau et la mer est calme"})
    # No letter anywhere: emoji, CJK punctuation, full-width digits and signs.
    assert p.judge(["😀🎉", "、。「」", "０１２", "！＄"]) == (["und"] * 4, [0.0] * 4)
    assert p.squeeze("a😀、０b").tolist() == p.squeeze("a .b").tolist()
    # More letters than the table has symbols: each stays itself.
    rng = random.Random(7)
    han = [chr(0x4E00 + k) for k in range(400)]
    a, b = han[::2], han[1::2]
    draw = lambda some, n: "".join(rng.choices(some, k=n))
    spoken = {g: [draw(some, 3) for _ in range(150)] for g, some in (("aa", a), ("bb", b))}
    talk = lambda g, n: "".join(rng.choices(spoken[g], k=n))
    texts = {"aa": talk("aa", 1000), "bb": talk("bb", 1000), "en": "the weather is fine today and the sea is calm " * 20}
    p = langid.Parser(texts)
    assert p.judge([talk("aa", 20), talk("bb", 20), "fine weather 😀", "Is The Sea"])[0] == ["aa", "bb", "en", "en"]

    def phrases(train, t):
        n, k = 0, 0
        while k < len(t):
            j = k + 1
            while j < len(t) and t[k : j + 1] in train:
                j += 1
            n, k = n + 1, j
        return n

    spelled = lambda t: "".join(chr(100 + int(c)) for c in p.squeeze(t))
    asked = [draw(han + ["x", "t"], 300), texts["aa"][500:700] + "the" + texts["bb"][:90], "一" * 5 + han[-1], "ı"]
    got = p.phrases([p.squeeze(t) for t in asked])
    assert got.tolist() == [[phrases(spelled(x), spelled(t)) for x in texts.values()] for t in asked]
    # A rare lower-case letter doesn't take the upper-case one of another.
    p = langid.Parser({"x": "iiii ı", "y": "zz"})
    assert p.squeeze("I").tolist() == p.squeeze("i").tolist() != p.squeeze("ı").tolist()


def test_toxicity(spark, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, labels = [], []
    for k in range(600):
        bad = k % 3 == 0
        rows.append((k, " ".join([word() for _ in range(30)] + (rng.sample(["idiot", "moron", "scum"], 2) if bad else []) + (["women"] if k % 7 == 0 else []))))
        labels.append((k, 1, int(bad)))
    rows += [(1000, "muslims and women met"), (1001, "what an idiot"), (1002, None), (1003, "")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(7777, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    held = [k for k in range(600) if got[k].held_out]
    assert held and all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(600))
    assert np.mean([got[k].predicted == (k % 3 == 0) for k in held]) > 0.98
    assert [got[k].predicted for k in (1000, 1001, 1002, 1003)] == [0, 1, 0, 0]
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    assert toxicity.toxicity(empty, lab).count() == 0 and toxicity.toxicity(df, lab.limit(0)).count() == len(rows)


def test_toxicity_scores_equal_the_sum_of_features(spark, docs):
    labels = spark.createDataFrame([(k, k % 3) for k in range(1, 60)] + [(4, 0), (4, 2), (None, 1)], "doc_id long, toxic int")
    learned = toxicity.labelled(docs, labels.filter(~langid.held_out("doc_id", 3, 1)), "doc_id", "text", "toxic", 3000)
    assert {y for _, y in learned} == {0, 1}
    weights, bias = toxicity.fit(learned)
    got = Counter((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in toxicity.toxicity(docs, labels).collect())
    want = Counter()
    for i, t, *_ in awkward():
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(weights.get(f, 0.0) for f in toxicity.features(toxicity.words_of(t)))))))
        want[i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, round(p, 9), int(p >= 0.7)] += 1
    assert got == want
    many = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "fine " * 300_000)], "doc_id long, text string")
    some = spark.createDataFrame([(1, 1)] * 40 + [(2, 0)], "doc_id long, toxic int")
    assert len(toxicity.labelled(many, some, "doc_id", "text", "toxic", 20)) < 40 and toxicity.toxicity(many, some).count() == 51


def test_toxicity_swaps_do_not_move_scores():
    rng = random.Random(1)
    rows = [(" ".join(["w%d" % rng.randrange(50) for _ in range(8)] + (["vile"] if k % 2 else []) + ([rng.choice(["muslims", "women"])] if k % 2 else [])), k % 2) for k in range(600)]
    score = lambda w, b, t: b + sum(w.get(f, 0) for f in toxicity.features(toxicity.words_of(t)))
    gap = {}
    for fairness in (0.0, 5.0):
        w, b = toxicity.fit(rows, fairness=fairness)
        gap[fairness] = abs(score(w, b, "muslims met") - score(w, b, "christians met"))
    assert gap[5.0] < 0.5 * gap[0.0]


def test_quality(spark, docs, empty):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(900):
        bad = k % 5 == 0
        w = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(60)]
        rows.append((k, " | ".join(w).upper() if bad else " ".join(w).capitalize() + ".", "en", f"s{k % 4}"))
        labels.append((k, int(not bad)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels[:600], "doc_id long, quality int")
    got = {r._row.doc_id: r for r in quality.judged(df, lab).collect()}
    assert np.mean([got[k].kept == (k % 5 > 0) for k in range(600, 900)]) > 0.98
    assert quality.judged(docs, lab).count() == docs.count() and quality.judged(empty, lab).count() == 0
    assert quality.judged(df, lab.limit(0)).count() == 900
    left = quality.drop_poor(df, lab)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {k for k, r in got.items() if r.kept}


def test_quality_shrinks_sparse_sites():
    assert quality._strength(0, 0.25, 0, 0, 20) == 20
    # Four hosts of 25 with equal rates, and half of them all good.
    assert quality._strength(100, 0.16, 0.0, 3, 20) == 1e5 and quality._strength(100, 0.25, 25.0, 3, 1) < 5


def test_quality_equals_brute_force(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    w, b, base = quality.learn(docs, labels, "doc_id", "text", "quality", 20_000)
    rows = [(i, t, g, s, 1 / (1 + math.exp(-float(np.clip(quality.expand(np.array([quality.statistics(t or "")])) @ w + b, -30, 30)[0])))) for i, t, g, s, *_ in awkward()]
    groups, hosts = defaultdict(list), defaultdict(list)
    for *_, g, s, p in rows:
        groups[s, g].append(p)
        hosts[s].append(p)
    n, total = len(rows), sum(r[4] for r in rows)
    rate = total / n
    spread = lambda gs: sum(sum(x) ** 2 / len(x) for x in gs.values())
    k1 = quality._strength(n, rate * (1 - rate), spread(hosts) - n * rate**2, len(hosts) - 1, 20.0)
    k2 = quality._strength(n, (total - spread(hosts)) / n, spread(groups) - spread(hosts), len(groups) - len(hosts), 20.0)
    want = []
    for i, _, g, s, p in rows:
        host = (sum(hosts[s]) + k1 * rate) / (len(hosts[s]) + k1)
        path = (sum(groups[s, g]) - p + k2 * host) / (len(groups[s, g]) - 1 + k2)
        odds = math.log(p / (1 - p)) + math.log(path / (1 - path)) - math.log(base / (1 - base))
        want.append((-1 if i is None else i, round(host, 6), round(path, 6), round(1 / (1 + math.exp(-odds)), 6)))
    for row in (None, boxed(docs, "doc_id")):
        got = [(-1 if r._row.doc_id is None else r._row.doc_id, round(r.host_rate, 6), round(r.path_rate, 6), round(r.score, 6)) for r in quality.judged(docs, labels, row).collect()]
        assert np.allclose(sorted(got), sorted(want), atol=2e-6)


def test_quality_statistics():
    s = quality.statistics("A|b É!\nA|b É!\n")
    count = lambda c: math.log1p(200.0 * c / 14)
    assert np.allclose(s, [count(2), count(2), 0, 0, 0, count(4), math.log1p(4) / 2, math.log1p(14 / 4), 2.0, 2 / 3 * 2])
    assert len(quality.statistics("")) == quality.N_STATISTICS and quality.statistics("x " * 300_000)[8] < 0.001


def test_license_scan(spark, empty):
    rows = [
        (1, "words here\nReleased under the MIT License.\nmore"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "The officer checked a license and left."),
        (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (7, "plain words " * 3000), (1, "words here\nReleased under the MIT License.\nmore"),
    ]
    got = [(r.doc_id, r.n_paragraphs, r.n_licensed, r.families) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 3, 1, "MIT"), (1, 3, 1, "MIT"), (2, 1, 1, "GPL"), (3, 1, 0, ""), (4, 0, 0, ""), (5, 0, 0, ""), (6, 2, 2, "Apache-2.0|CC-BY-NC"), (7, 1, 0, "")]
    assert license.scan(empty).count() == 0


def test_license_scan_equals_one_line_at_a_time(spark, docs):
    """Single-line notices among others, each line judged alone against every template."""
    rng = random.Random(3)
    lines = [t for ts in license.TEMPLATES.values() for t in ts] + license.NEAR_MISSES + ["a plain line of words", "another one", "0 1 2", "MIT", "license"]
    rows = [(k, "\n\n".join(rng.choices(lines, k=rng.randrange(1, 7)))) for k in range(60)] + [(None, lines[0]), (61, None), (62, "\n"), (63, "plain words here " * 60_000 + "\n\n" + lines[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = license.train(license.sampled(df, "doc_id", "text", 3000))
    common = lambda a, b: sum(m.size for m in license.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())

    def family(line):
        p = model.probabilities([line])[0]
        best = int(p.argmax())
        if best == len(model.families) - 1 or p[best] < 0.5:
            return None
        own = re.findall(r"[^\W_]+", line.lower())
        ts = [re.findall(r"[^\W_]+", t.lower()) for t in license.TEMPLATES[model.families[best]]]
        return model.families[best] if max(common(t, own) / len(t) for t in ts) >= 0.6 else None

    want = Counter()
    for i, t in rows:
        own = [x for x in (t or "").split("\n") if x.strip()]
        found = [f for f in map(family, own) if f]
        want[i, len(own), len(found), "|".join(sorted(set(found)))] += 1
    assert Counter((r.doc_id, r.n_paragraphs, r.n_licensed, r.families) for r in license.scan(df).collect()) == want
    assert license.scan(docs).count() == docs.count()


def test_license_model_is_calibrated_on_what_it_has_not_seen():
    plain = [f"line {k} of words that say nothing much about number {k}" for k in range(60)]
    rows, families = [(p, 1) for p in plain] + [("Released under the MIT License.", 0)] * 20, ["MIT", "unknown"]
    model = license.fitted(rows, families, 60)
    assert license.temperature(model, [(p, 0) for p in plain]) > license.temperature(model, rows) and license.temperature(model, []) == 1.0


def test_license_scan_joins_wrapped_notices(spark):
    prose = "\n".join("the quick brown fox went over the hill and saw a river below" for _ in range(12))
    rows, want = [], []
    for f, ts in license.TEMPLATES.items():
        for t in ts:
            if len(t.split()) >= 20:
                for width, mark in ((72, ""), (60, "# "), (34, " * ")):
                    notice = "\n".join(mark + x for x in textwrap.wrap(t, width))
                    rows += [(len(rows), notice), (len(rows) + 1, f"{prose}\n\n{notice}\n\n{prose}"), (len(rows) + 2, f"{prose}\n{notice}\n{prose}")]
                    want += [(1, f)] * 3
    rows.append((len(rows), prose + "\n\n" + prose))
    want.append((0, ""))
    # Lines of a wrapped notice that are confirmed by themselves are counted by themselves.
    got = {r.doc_id: (min(r.n_licensed, 1), r.families) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(k, got[k]) for k in range(len(rows)) if got[k] != want[k]] == []


def brute_search(rows, asked, k):
    """(query, rank, document, score) by the formula, over all documents."""
    words = [(i, Counter(w for w in (t or "").lower().encode().translate(search._PARTS).split())) for i, t, *_ in rows]
    n, average = len(words), sum(sum(c.values()) for _, c in words) / len(words)
    df = Counter(w for _, c in words for w in c)
    idf = {w: math.log1p((n - m + 0.5) / (m + 0.5)) for w, m in df.items()}
    out = []
    for q, (i, terms) in enumerate(words):
        if i in asked:
            scored = [(round(sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average)) for t in sorted(terms) if t in c), 7), search.NO_ID if d is None else d) for d, c in words]
            out += [(i, rank + 1, None if d == search.NO_ID else d, s) for rank, (s, d) in enumerate(sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1]))[:k])]
    return out


def found_by(frame):
    return [(r.query_id, r.rank, r.doc_id, round(r.score, 7)) for r in frame.collect()]


def test_search(docs, empty):
    rows, asked = awkward(), (1, 5, 10, 14, 50)
    key = lambda r: (r[0], r[1], -(2**63) if r[2] is None else r[2], r[3])
    got = sorted(found_by(search.top_k(docs, docs.filter(F.col("doc_id").isin(*asked)), k=6)), key=key)
    want = sorted(brute_search(rows, asked, 6), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])
    assert search.top_k(empty, empty).count() == 0 and search.top_k(docs, empty).count() == 0


def test_search_over_many_blocks(spark):
    """Ids, ranks and ties against all scores, over shards of many blocks, in which blocks are passed over."""
    rng = random.Random(9)
    tongues = [[f"{c}{k}" for k in range(300)] for c in "abcd"]
    rows = []
    for k in range(2600):
        own = tongues[rng.randrange(4)]
        rows.append((k, " ".join(own[min(int(rng.paretovariate(0.6)) - 1, 299)] for _ in range(rng.randrange(5, 60)))))
    rows += [(3000 + k, rows[7][1]) for k in range(15)]  # ties beyond the k-th
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    asked = {7, 50, 3001, *range(100, 130)}
    got = sorted(found_by(search.top_k(df, df.filter(F.col("doc_id").isin(*asked)), k=10)))
    want = sorted(brute_search(rows, asked, 10))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])

    words = [search.terms_of(t) for _, t in rows]
    terms, counts, docs, freqs, order = search.postings(words)
    lengths = np.array([len(w) for w in words], np.int32)[order]
    every, n = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
    common = every[n * search.COMMON >= len(rows)]
    shard = search.Shard(np.array([i for i, _ in rows])[order].tobytes(), lengths.tobytes(), *(x.tobytes() for x in (terms, counts, docs, freqs)), float(lengths.mean()), common)
    best, some = search.Best(20, 10), [np.unique(w) for w in words[:20]]
    idf = lambda t: np.log1p((len(rows) - n[np.searchsorted(every, t)] + 0.5) / (n[np.searchsorted(every, t)] + 0.5))
    weights = np.array([[idf(c) if c in t else 0.0 for c in common] for t in some])
    shard.search(np.array([shard.rare_scores(t[~np.isin(t, common)], idf(t[~np.isin(t, common)])) for t in some]), weights, best, 0)
    assert shard.n_blocks > 20 and shard.scored < 0.6 * 20 * shard.n_blocks


def test_shingles():
    low = lambda t: [w.encode() for w in WORD.findall(t)]
    for t in ["", " ", "a", "a b", "A b\tc\x0bd", "é ü  a b c a b c", "x " * 50]:
        own = low("".join(c.lower() if c.isascii() else c for c in t))
        n = len(own)
        want = len({tuple(own[k : k + 3]) for k in range(n - 2)}) if n >= 3 else min(n, 1)
        assert len(shingles.shingle_sets([t], 3)[0]) == want
    a, b = shingles.shingle_sets(["A B C d", "a b c d"], 3)
    assert (a == b).all() and len(shingles.word_hashes(b"ab ba a b")) == 4 and len(set(shingles.word_hashes(b"ab ba a b").tolist())) == 4


def test_license_runs_in_long_texts():
    """Twice the lines take about twice the time, with confirmed lines or without."""
    import time

    needed = sorted(license.needed_words(0.6))
    family = license._COUNTS[0][0]

    def seconds(n):
        lines = [f"line {k} {needed[k % len(needed)]}" for k in range(n)]
        began = time.process_time()
        found = license.runs(lines, set(needed), 0.6, [(k, family) for k in range(0, n, 9)])
        return time.process_time() - began, len(found)

    (short, few), (long, many) = seconds(15_000), seconds(30_000)
    assert many < 2.2 * few and long < 3 * short + 0.5


def test_mixing_of_rows_without_ids(spark):
    """They have one place in the order and are parts by their size; the mix is that of the plain order."""
    rows = [(None if k % 3 else k, "w " * (k % 40), "a" if k % 2 else "b") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    counted = mixing.measured(docs, boxed(docs))
    assert counted.filter("_row.doc_id IS NULL").select("_b").distinct().count() == 40
    mixed = mixing.mix(counted)
    got = mixed.groupBy("_row.source").agg(F.sum(F.col("_repeats") * F.col("_size") + F.col("_extra")).alias("taken"), F.max("_target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in got)
    rest = mixed.filter("_size > 0").orderBy("_row.source", "_u", "_size").select("_row.source", "_size", "_extra").collect()
    for source in "ab":
        whole = [r._extra / r._size for r in rest if r.source == source]
        assert whole == sorted(whole, reverse=True)


def test_language_training_sample_is_bounded(spark):
    """Rows without ids, and copies of one row, don't all come to the driver."""
    rows = [(None, f"text number {k} of this language here") for k in range(3000)] + [(7, "the same row again")] * 3000
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    learned = langid.learn(docs, "doc_id", "text", "lang", 5000, sample_docs=20)
    assert set(learned) == {"en"} and 0 < len(learned["en"]) <= 6000
