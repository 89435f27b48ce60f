"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and of word starts (four and five
letters). Features are the ``max_features`` that labelled toxic documents have
most significantly more often, and all identity terms. For each training text
with an identity term a copy has it swapped for another of its group; a seeded
part of the other texts is given a neutral mention and its swap. The loss adds
the mean squared change of the logit between the two, so that naming a group
does not move a score.

The fit sees at most about ``max_rows`` labelled rows of either class, chosen by
hash of id and text; an id with several labels has its largest. Of these texts the
driver gets the words; texts are scored whole.

Cases: null or empty text scores as the bias alone; a very long text is a set of
words like any other; a null label teaches nothing, and any label over 0 is toxic;
with one class or none among the labels the model is its base rate; a null id is
never held out and has no label; repeated rows score alike; an empty table gives
an empty result; columns of ``docs`` other than the two named are not read, so
their names don't matter.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small
from .langid import held_out

#: Names of groups, by kind; the swaps stay within a kind.
IDENTITY = (
    "women men girls boys woman man female male transgender nonbinary frauen männer femmes hommes mujeres hombres".split(),
    "muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist atheist muslime christen juden musulmans chrétiens juifs musulmanes cristianos judíos".split(),
    "black white asian latino african european arab indian chinese mexican schwarze weiße noirs blancs negros blancos".split(),
    "gay lesbian bisexual straight queer heterosexual homosexual schwule lesben lesbiennes lesbianas".split(),
    "immigrants refugees foreigners natives immigrant refugee foreigner migrants einwanderer flüchtlinge ausländer immigrés réfugiés inmigrantes refugiados".split(),
    "disabled deaf blind autistic elderly young old behinderte handicapés discapacitados".split(),
)
KIND = {w: k for k, ws in enumerate(IDENTITY) for w in ws}
_WORDS = re.compile(r"[^\W\d_]+")
MIN_Z = 4.0
MIN_LIFT = 6.0


def features(words: set[str]) -> set[str]:
    return words | {f"4{w[:4]}" for w in words if len(w) > 5} | {f"5{w[:5]}" for w in words if len(w) > 6}


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def swapped(words: set[str], rng: random.Random) -> tuple[set[str], set[str]] | None:
    """The words with their identity terms and with others in their place; a text without any may get a mention."""
    terms = sorted(w for w in words if w in KIND)
    if not terms:
        if rng.random() > 0.3:
            return None
        kind = rng.choice(IDENTITY)
        a, b = rng.sample(kind, 2)
        return words | {a}, words | {b}
    other = {w: rng.choice([x for x in IDENTITY[KIND[w]] if x != w]) for w in terms}
    return words, {other.get(w, w) for w in words}


def fit(rows: list[tuple[str | set[str] | None, int]], max_features: int = 1024, l2: float = 1e-5, fairness: float = 1.0, steps: int = 400, seed: int = 3) -> tuple[dict[str, float], float]:
    """Weights by feature, and the bias."""
    rng = random.Random(seed)
    sets = [t if isinstance(t, set) else words_of(t) for t, _ in rows]
    y = np.array([float(v) for _, v in rows])
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return {}, math.log((n1 + 0.5) / (n0 + 0.5))
    count = [Counter(), Counter()]
    for s, v in zip(sets, y, strict=True):
        count[int(v)].update(features(s))
    scored = []
    for f, c1 in count[1].items():
        c0 = count[0][f]
        p = (c1 + c0) / (n1 + n0)
        z = (c1 / n1 - c0 / n0) / math.sqrt(max(1e-9, p * (1 - p) * (1 / n1 + 1 / n0)))
        if z >= MIN_Z and c1 >= 4 and c1 / n1 >= MIN_LIFT * c0 / n0:
            scored.append((-z, f))
    ident = sorted(features(set(KIND)))
    names = [f for _, f in sorted(scored)[:max_features] if f not in set(ident)] + ident
    at = {f: k for k, f in enumerate(names)}

    def matrix(many: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(many), len(names)), dtype=np.float32)
        for k, s in enumerate(many):
            x[k, [at[f] for f in features(s) if f in at]] = 1
        return x

    x = matrix(sets)
    pairs = [p for s in sets if (p := swapped(s, rng))]
    d = matrix([a for a, _ in pairs]) - matrix([b for _, b in pairs])
    # A copy of each toxic text keeps one of its plainest signs only, so that a word that mostly comes beside others counts alone too.
    odds = np.array([math.log((count[1][f] + 0.5) / (n1 + 1) * (n0 + 1) / (count[0][f] + 0.5)) for f in names[: len(names) - len(ident)]])
    alone = np.zeros_like(x[y > 0])
    for k, row in enumerate(x[y > 0]):
        if len(own := np.flatnonzero(row[: len(odds)])):
            alone[k, rng.choice(own[odds[own] >= 0.85 * odds[own].max()])] = 1
    alone = alone[alone.any(1)]
    x, y = np.concatenate([x, alone]), np.concatenate([y, np.ones(len(alone))])
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / n0)  # the classes weigh alike
    w, b, mw, mb, vw, vb = np.zeros(len(names), np.float32), 0.0, 0.0, 0.0, 0.0, 0.0
    for step in range(1, steps + 1):
        g = ((1 / (1 + np.exp(-(x @ w + b))) - y) * each).astype(np.float32)
        gw, gb = x.T @ g + l2 * w, float(g.sum())
        if len(pairs):
            gw += fairness * d.T @ (d @ w) / len(pairs)
        mw, mb, vw, vb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb, 0.99 * vw + 0.01 * gw**2, 0.99 * vb + 0.01 * gb**2
        r, m = 0.1 / (1 - 0.9**step), 1 - 0.99**step
        w = w - r * mw / (np.sqrt(vw / m) + 1e-6)
        b -= r * mb / (math.sqrt(vb / m) + 1e-6)
    return {f: float(w[k]) for f, k in at.items()}, float(b)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> list[tuple[set[str], int]]:
    """Words and label (0 or 1) of at most about ``max_rows`` texts of either class."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_y"))

    def share(rows: DataFrame, place: Column) -> DataFrame:
        few = F.lit(False)
        for v, n in ((r[0], r[1]) for r in rows.groupBy("_y").count().collect()):  # two classes
            few = few | ((F.col("_y") == v) & (F.pmod(place, F.lit(1 << 30)) < int(min(1.0, max_rows / n) * (1 << 30))))
        return rows.filter(few)

    @F.arrow_udf("array<string>")
    def words(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(words_of(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    chosen = small(share(known, F.xxhash64(F.lit(3), "_id")), 4 * max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(chosen, "_id").dropDuplicates(["_id", "_t"])
    found = share(rows, F.xxhash64(F.lit(4), "_id", "_t")).select("_id", words("_t").alias("_w"), "_y").collect()
    return [(set(r[1]), r[2]) for r in sorted(found, key=lambda r: (r[0], r[1], r[2]))]


def score(docs: DataFrame, weights: dict[str, float], bias: float, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, mod: int = 3, rest: int = 1) -> DataFrame:
    words = {f: w for f, w in weights.items() if not f[0].isdigit()}
    starts = [(n, {f[1:]: w for f, w in weights.items() if f[0] == str(n)}) for n in (4, 5)]
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, mod, rest).alias("held_out"), F.col(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.keys()
        for batch in batches:
            out, column = [], batch.column(2)
            for k in range(batch.num_rows):
                own = words_of(column[k].as_py())
                z = bias + sum(words[w] for w in sorted(own & known))
                for n, weight in starts:
                    z += sum(weight[s] for s in sorted({w[:n] for w in own if len(w) > n + 1} & weight.keys()))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.float64())], names=["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 3000, mod: int = 3, rest: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the labels of rows that aren't held out."""
    weights, bias = fit(labelled(docs, labels.filter(~held_out(id_col, mod, rest)), id_col, text_col, label_col, max_rows))
    return score(docs, weights, bias, id_col, text_col, mod=mod, rest=rest)
