"""Quality by document evidence and hierarchical empirical Bayes over sites.

A logistic model on surface statistics of the whole text gives each document a
log-odds of good quality. Its probabilities are summed by host and by path within
host. A host's rate is shrunk toward the global one, a path's toward its host's,
each with a prior strength of its own, fitted from the spread between hosts and
between the paths of a host (moments); the document's own share is left out of
its path's rate. Evidence and site prior add up as log-odds. Sites with few
documents stay near the rate above them.

The statistics are counted in an Arrow function on the text alone. The fit sees
at most about ``max_rows`` labelled texts, chosen by hash of id and text; an id
with several labels has its largest.

Cases: null text counts as empty; a very long text is counted like any other, in
time proportional to its length; hosts and paths may be null and are sites of
their own; null ids have no label; with one class or none among the labels the
model is its base rate; labels over 0 are good; repeated rows score alike; an
empty table gives an empty result; columns of ``docs`` are boxed, so their names
clash with nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, cut_lineage, key_of, small, tidily, unboxed

BROADCAST_PATHS = 100_000
#: Characters counted as symbols.
SYMBOLS = r"#$%&*@^~=<>{}[]\+_/"


_COUNTED = (b"|", b"!?", SYMBOLS.encode(), b"0123456789", b".,;:")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BEYOND = re.compile(r"[^\x00-\x7f]")
N_STATISTICS = 10


def statistics(text: str) -> list[float]:
    """Surface statistics, each about 0 to 8: characters of some kinds, capitals, words, repeated words and lines."""
    raw = text.encode("utf-8", "surrogatepass")
    n, size = max(len(text), 1), len(raw)
    capitals = size - len(raw.translate(None, _UPPER))
    if not raw.isascii():
        capitals += sum(unicodedata.category(c) == "Lu" for c in _BEYOND.findall(text))
    words, lines = raw.split(), raw.split(b"\n")
    n_words = max(len(words), 1)
    counts = [size - len(raw.translate(None, some)) for some in _COUNTED]
    return [*(math.log1p(200.0 * c / n) for c in (*counts, capitals)), math.log1p(n_words) / 2, math.log1p(len(text) / n_words), len(set(words)) / n_words * 4.0, len(set(lines)) / len(lines) * 2.0]


@tidily
def _measured(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t.as_py() or "") for t in texts]  # one at a time, as a batch may be long
    return np.array(rows).reshape(len(rows), N_STATISTICS)


def expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x**2], axis=1)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps on scaled columns; weights and bias for the unscaled ones."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return np.zeros(x.shape[1]), math.log((n1 + 0.5) / (n0 + 0.5))
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - mean) / sd, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], l2), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> tuple[np.ndarray, float, float]:
    """Weights, bias and the base rate."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    n = known.count()
    share = int(min(1.0, max_rows / max(n, 1)) * (1 << 30))
    chosen = small(known.filter(F.pmod(F.xxhash64(F.lit(8), "_id"), F.lit(1 << 30)) < share), 4 * max_rows)

    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array(list(_measured(texts)), pa.list_(pa.float64()))

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(chosen, "_id").dropDuplicates(["_id", "_t"])
    many = rows.select("_id").count()
    rows = rows.filter(F.pmod(F.xxhash64(F.lit(9), "_id", "_t"), F.lit(1 << 30)) < int(min(1.0, 2 * max_rows / max(many, 1)) * (1 << 30)))
    rows = sorted((tuple(r) for r in rows.select("_id", "_y", stats("_t").alias("_x")).collect()), key=lambda r: (r[0], r[1], r[2]))
    y = np.array([float(r[1] > 0) for r in rows])
    x = np.array([r[2] for r in rows]).reshape(len(rows), N_STATISTICS)
    w, b = fit(expand(x), y)
    return w, b, (y.sum() + 0.5) / (len(y) + 1)


def evidence(text: Column, w: np.ndarray, b: float) -> Column:
    """Log-odds of good quality by the text alone, from -30 to 30."""

    @F.arrow_udf("double")
    def logit(texts: pa.Array) -> pa.Array:
        return pa.array(np.clip(expand(_measured(texts)) @ w + b, -30.0, 30.0))

    return logit(text)


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def judged(docs: DataFrame, labels: DataFrame, row: Column | None = None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", max_rows: int = 20_000, threshold: float = 0.5, least_strength: float = 20.0) -> DataFrame:
    """_row (all columns, or ``row``), doc_logit, host_rate, path_rate, score (0 to 1, higher: better), kept.

    Rows that ``row`` makes narrow are kept in the shared folder, so that each text is measured once.
    """
    w, b, base = learn(docs, labels, id_col, text_col, label_col, max_rows)
    sites = [key_of(host_col).alias("_host"), key_of(path_col).alias("_path")]
    rows = docs.select((boxed(docs) if row is None else row).alias("_row"), *sites, evidence(F.col(text_col), w, b).alias("doc_logit"))
    rows = rows.withColumn("_p", 1 / (1 + F.exp(-F.col("doc_logit"))))
    if row is not None:
        rows = cut_lineage(rows)
    narrow = rows if row is not None else docs.select(*sites, evidence(F.col(text_col), w, b).alias("_z")).withColumn("_p", 1 / (1 + F.exp(-F.col("_z"))))
    paths = cut_lineage(narrow.groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.sum("_p").alias("_s")))
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_hn"), F.sum("_s").alias("_hs"), F.count("*").alias("_paths"), F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("_ps"))
    square = F.col("_hs") * F.col("_hs") / F.col("_hn")
    m = [float(v or 0) for v in hosts.agg(F.sum("_hs"), F.sum("_hn"), F.count("*"), F.sum(square), F.sum("_paths"), F.sum("_ps")).first()]
    rate = m[0] / m[1] if m[1] else 0.5
    strength = _strength(m[1], rate * (1 - rate), m[3] - m[1] * rate * rate, m[2] - 1, least_strength)
    within = (m[0] - m[3]) / m[1] if m[1] else 0.0
    path_strength = _strength(m[1], within, m[5] - m[3], m[4] - m[2], least_strength)
    hosts = hosts.withColumn("host_rate", (F.col("_hs") + strength * rate) / (F.col("_hn") + strength)).select("_host", "host_rate")
    known = small(paths.join(hosts, "_host"), BROADCAST_PATHS)
    rows = rows.join(known, ["_host", "_path"])
    path_rate = (F.col("_s") - F.col("_p") + path_strength * F.col("host_rate")) / (F.col("_n") - 1 + path_strength)
    rows = rows.withColumn("path_rate", F.round(path_rate, 9)).withColumn("host_rate", F.round("host_rate", 9))
    score = 1 / (1 + F.exp(-(F.col("doc_logit") + _logit(F.col("path_rate")) - _logit(F.lit(base)))))
    return rows.withColumn("score", score).withColumn("kept", F.col("score") >= threshold).drop("_host", "_path", "_n", "_s", "_p")


def _strength(n: float, sampling: float, squares: float, free: float, least: float) -> float:
    """How many documents' weight a prior has: the variance of a document against that between its groups.

    ``squares`` are the groups' squared deviations from their prior's mean, weighted
    by their documents; ``free`` of them come from sampling alone.
    """
    if n == 0 or sampling <= 0:
        return least
    between = max(1e-12, (squares - free * sampling) / n)
    return float(min(1e5, max(least, sampling / between - 1)))


def drop_poor(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """``docs`` without the rows judged poor."""
    return unboxed(judged(docs, labels, **kw).filter("kept"), docs.columns)
