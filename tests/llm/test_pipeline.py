import math
from collections import Counter, defaultdict

import duckdb
import pytest
from test_ops import BPE, SCHEMA, awkward, brute_links

import corpus_pipeline
from inkwarden.llm import packing, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(repr, got[cols].values.tolist())) == sorted(map(repr, want[cols].values.tolist()))


def test_stages_feed_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k < 3:
            assert docs.columns == names and counts[-1] <= counts[-2]
        if name == "jaccard_join":
            assert docs.select("text").distinct().count() == docs.count()
    assert counts[1] < counts[0] and counts[2] < counts[1]
    again = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(awkward(), SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(k, int(k not in (9, 14, 30))) for k in range(1, 60)], "doc_id long, quality int").write.parquet(f"{top}/labels.parquet")
    return top


def test_each_stage_equals_brute_force(spark, folder, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns, each stage on what the one before it kept."""
    stages, rows = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    names, key = rows.columns, lambda r: (r.doc_id, r.text, r.lang, r.source)

    def through(name, docs):
        stages[name](spark, docs, folder).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        return docs.collect(), out.collect(), out

    judged = Counter(key(r._row) for r in quality.judged(rows, spark.read.parquet(f"{folder}/labels.parquet")).filter("kept").collect())
    _, got, docs = through("quality", rows)
    assert docs.columns == names and Counter(map(key, got)) == judged

    before, got, docs = through("exact_dedup", docs)
    groups = defaultdict(list)
    for r in before:
        groups[r.text or ""].append(r.doc_id)
    assert docs.columns == names and Counter((r.text or "", r.doc_id) for r in got) == Counter((t, max((i for i in ids if i is not None), default=None)) for t, ids in groups.items())

    before, got, docs = through("jaccard_join", docs)
    linked = brute_links([(r.doc_id, r.text) for r in before], 5, 80, 100)
    assert docs.columns == names and Counter(r.doc_id for r in got) == Counter(i for i, n, c in linked if n == 0 or i == c)

    before, got, docs = through("mixing", docs)
    size = lambda t: len((t or "").encode().split())
    sizes, times = defaultdict(int), Counter(map(key, got))
    for r in before:
        sizes[r.source] += size(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, cap = {s: k % 3 + 1 for k, s in enumerate(order)}, {s: 3 * sizes[s] for s in order}
    target, total = {}, sum(sizes.values())
    while True:  # clamp, share again, until none is above
        free = [s for s in order if s not in target]
        left = total - sum(target.values())
        over = [s for s in free if weight[s] * left / sum(weight[x] for x in free) > cap[s]]
        if not over:
            target |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: cap[s] for s in over}
    assert docs.columns == names and set(times) <= set(map(key, before)) and all(size(k[1]) and n <= 3 for k, n in times.items())
    for s in order:
        longest = max((size(r.text) for r in before if r.source == s), default=0)
        assert abs(sum(n * size(k[1]) for k, n in times.items() if k[3] == s) - target[s]) <= longest / 2 + 1

    before, got, _ = through("packing", docs)
    tok = packing.Encoder(BPE).tok
    want = Counter()
    for r in before:
        want[r.doc_id] += len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
    have, sequences = Counter(), Counter()
    for r in got:
        have[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert have == want and sum(math.ceil(n / 1024) for n in [sum(want.values())]) <= len(sequences) and all(n == 1024 or n & (n - 1) == 0 for n in sequences.values())


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
