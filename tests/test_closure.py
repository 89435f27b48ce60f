"""Closure of packages and manifests' trees against sets and plain hashing."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkwarden.operators import closure, registry


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_equals_sets(spark, seed):
    rng = random.Random(seed)
    packages = [None, *range(12)]
    parts = [(p, rng.choice([None, *"abcdefgh"])) for p in packages for _ in range(7)]
    edges = [(p, rng.choice([None, *"abcdefgh"]), rng.choice("abcdefghx")) for p in packages for _ in range(8)] * 2
    roots = [(p, rng.choice("ab")) for p in packages if rng.random() < 0.8]
    frame = lambda rows, names: spark.createDataFrame(rows, f"package long, {', '.join(n + ' string' for n in names)}").repartition(3)
    p, e, r = frame(parts, ["part"]), frame(edges, ["source", "target"]), frame(roots, ["part"])
    steps = {}
    for package in packages:
        new, k = {t for q, t in roots if q == package}, 0
        while new:
            steps |= {(package, t): k for t in new}
            new, k = {t for q, s, t in edges if q == package and s in new and (package, t) not in steps}, k + 1
    assert {(x.package, x.part): x.steps for x in closure.reached(e, r).collect()} == steps
    there = {x for x in parts if x[1] is not None}
    want = {q: ("VALID" if not (a := sum(x[0] == q for x in set(steps) - there)) + (b := sum(x[0] == q for x in there - set(steps))) else "INVALID", a, b) for q in packages}
    assert {x.package: (x.status, x.missing, x.unreferenced) for x in closure.closed(p, e, r).collect()} == want
    assert closure.closed(p.limit(0), e.limit(0), r.limit(0)).count() == 0


def root(hashes):
    n, depth = len(hashes), 0
    while n > registry.LEAF * 16**depth:
        depth += 1
    level = defaultdict(list)
    for h in sorted(hashes):
        level[h[:depth]].append(h)
    nodes = {at: hashlib.sha256("\n".join(hs).encode()).hexdigest() for at, hs in level.items()}
    while depth:
        depth -= 1
        up = defaultdict(list)
        for at in sorted(nodes):
            up[at[:depth]].append(at[depth] + nodes[at])
        nodes = {at: hashlib.sha256("\n".join(xs).encode()).hexdigest() for at, xs in up.items()}
    return nodes[""]


def test_manifest_trees(spark):
    """Groups of one entry, of exactly a leaf, of several levels, repeated and null entries, in any order."""
    rows = [("one", "x"), *(("leaf", str(k)) for k in range(64)), *(("two", str(k)) for k in range(65)), *(("deep", str(k % 2500)) for k in range(3000)), (None, "y"), ("one", None), ("none", None)]
    want = {}
    for g in {r[0] for r in rows}:
        if own := [hashlib.sha256(e.encode()).hexdigest() for h, e in rows if h == g and e is not None]:
            want[g] = (len(own), root(own))
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = registry.manifest_tree(spark.createDataFrame(rows, "g string, e string").repartition(3), ["g"], F.col("e"))
        assert {r.g: (r.entries, r.root) for r in got.collect()} == want
    assert registry.manifest_tree(spark.createDataFrame([], "g string, e string"), ["g"], F.col("e")).count() == 0
