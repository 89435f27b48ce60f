"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is a line. Its word unigrams, bigrams and trigrams are hashed into a
sparse vector of unit length; a multinomial logistic regression, trained on
variations of the template texts below and on paragraphs without licence terms
from a bounded sample of the corpus, gives the probability of each family and of
``unknown``. Its temperature is fitted on a model that has not seen one template of
each family and a sixth of the sample, by how sure that model is of those. A paragraph whose likeliest class is a family, with at least ``least``
probability, is compared with that family's templates: the share of the
template's words that it has, in order, must reach ``confirm``.

A notice may be wrapped over lines. Runs of joined lines that no blank line parts
(every start, several lengths, up to a run that has as many words as the longest
template before its last line) are judged the same way, if a line in them has a
word without which no template can be confirmed, and if the lines around it have
words enough of a template whose family isn't confirmed there already. A run counts as one paragraph,
numbered by its first line, unless it overlaps or adjoins a confirmed one of its family.

The unknown class is learned from at most ``sample`` lines of whole texts, of up to
2,000 characters each; of those that speak of licences it has the ones that are
like no template.

Cases: null or empty text has no paragraphs; a very long text is judged half a
megabyte of texts at a time, itself whole; null ids are scanned like others; ties
in probability go to the first family by name; repeated rows are scanned alike;
without corpus paragraphs the unknown class has the built-in ones; an empty table
gives an empty result; columns of ``docs`` other than the two named are not read,
so their names don't matter.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import _mix, word_hashes

#: Notices and opening paragraphs by licence family.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available for noncommercial use under the Creative Commons Attribution-NonCommercial licence.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "Proprietary": [
        "Copyright. All rights reserved. No part of this work may be reproduced without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Paragraphs that speak of like things and license nothing.
NEAR_MISSES = [
    "The driver showed a license to the officer and was free to go.", "They were granted permission to leave the room early.",
    "The public library is open to any person without charge.", "General rules of the game may change in later versions.",
    "Version 3 of the report was published by the foundation last year.", "The software is free for the first month, then costs a fee.",
]
#: Words by which sample paragraphs are kept out of the unknown class.
TERMS = re.compile(r"licen[cs]|copyright|permission|redistribut|public domain|creative commons|spdx", re.I)
DIM = 1 << 14
#: Joined lines that are judged at once.
RUNS = 4096
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
UNKNOWN = "unknown"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1-, 2- and 3-grams of all texts together, and the text each is of."""
    lines = [t.lower().encode("utf-8", "surrogatepass").translate(_PARTS) for t in texts]
    counts = np.array([len(x.split()) for x in lines], dtype=np.int64)
    w = word_hashes(b"\n".join(lines))
    doc = np.repeat(np.arange(len(texts)), counts)
    out, whose = [w], [doc]
    for k in (1, 2):
        if len(w) > k:
            same = np.flatnonzero(doc[k:] == doc[:-k])
            h = w[same]
            for j in range(1, k + 1):
                h = _mix(h * np.uint64(3) + w[same + j])
            out.append(h)
            whose.append(doc[same])
    return (np.concatenate(out) % np.uint64(DIM)).astype(np.int64), np.concatenate(whose)


def varied(text: str, rng: random.Random, fillers: list[str]) -> str:
    """A template with words dropped or replaced, in other words' company."""
    words = [w for w in text.split() if rng.random() > 0.08]
    words = [rng.choice(fillers) if rng.random() < 0.03 else w for w in words]
    before, after = ([rng.choice(fillers) for _ in range(rng.choice((0, 0, 0, 2, 6)))] for _ in range(2))
    return " ".join(before + words + after)


class Model:
    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.families, self.weights, self.bias, self.temperature = families, weights, bias, temperature

    def logits(self, texts: list[str]) -> np.ndarray:
        at, whose = grams(texts)
        n = np.maximum(np.bincount(whose, minlength=len(texts)), 1)
        z = np.stack([np.bincount(whose, weights=self.weights[at, c], minlength=len(texts)) for c in range(len(self.families))], axis=1)
        return (z / np.sqrt(n)[:, None] + self.bias) / self.temperature

    def probabilities(self, texts: list[str]) -> np.ndarray:
        z = self.logits(texts)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


_TOKEN = re.compile(r"[^\W_]+")
_WORDS = {f: [_TOKEN.findall(t.lower()) for t in ts] for f, ts in TEMPLATES.items()}
_COUNTS = [(f, Counter(t), len(t)) for f, ts in _WORDS.items() for t in ts]
_VOCABULARY = frozenset(w for _, count, _ in _COUNTS for w in count)
LONGEST = max(n for _, _, n in _COUNTS)


def closeness(paragraph: str, family: str) -> float:
    """The largest share of a template's words that the paragraph has in the same order."""
    own = _TOKEN.findall(paragraph.lower())
    return max(sum(m.size for m in SequenceMatcher(None, t, own, autojunk=False).get_matching_blocks()) / len(t) for t in _WORDS[family])


def fitted(rows: list[tuple[str, int]], families: list[str], steps: int) -> Model:
    """The regression by AdaGrad on rows (paragraph, class), the classes weighing alike."""
    y = np.array([c for _, c in rows])
    at, whose = grams([t for t, _ in rows])
    scale = 1 / np.sqrt(np.maximum(np.bincount(whose, minlength=len(rows)), 1))[whose]
    w, b = np.zeros((DIM, len(families))), np.zeros(len(families))
    hot = np.eye(len(families))[y]
    weight = (len(rows) / len(families) / np.maximum(hot.sum(0), 1))[y][:, None]
    w2, b2 = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(steps):
        z = np.stack([np.bincount(whose, weights=w[at, c] * scale, minlength=len(rows)) for c in range(len(families))], axis=1) + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - hot) * weight / len(rows)
        gw = np.stack([np.bincount(at, weights=g[whose, c] * scale, minlength=DIM) for c in range(len(families))], axis=1) + 1e-6 * w
        gb = g.sum(0)
        w2, b2 = w2 + gw**2, b2 + gb**2
        w -= 0.5 * gw / np.sqrt(w2)
        b -= 0.5 * gb / np.sqrt(b2)
    return Model(families, w.astype(np.float32), b, 1.0)


def temperature(model: Model, rows: list[tuple[str, int]]) -> float:
    """That under which the model is as sure of rows it hasn't seen as it is right."""
    if not rows:
        return 1.0
    z, own = model.logits([t for t, _ in rows]), np.array([c for _, c in rows])

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(own)), own]).mean())

    return min((0.25 * 1.15**k for k in range(25)), key=loss)


def train(sample: list[str], seed: int = 1, each: int = 60, steps: int = 150) -> Model:
    rng = random.Random(seed)
    plain = [p for p in sample if not TERMS.search(p) or max(closeness(p, f) for f in TEMPLATES) < 0.4] + NEAR_MISSES
    rng.shuffle(plain)
    fillers = sorted({w for p in plain for w in p.split()})[:5000]
    families = sorted(TEMPLATES) + [UNKNOWN]
    unknown = len(families) - 1

    def notices(chosen: dict[str, list[str]]) -> list[tuple[str, int]]:
        return [x for c, f in enumerate(families[:-1]) for t in chosen[f] for x in [(t, c)] * 5 + [(varied(t, rng, fillers), c) for _ in range(each)]]

    def others(some: list[str]) -> list[tuple[str, int]]:
        return [(p, unknown) for p in some] + [(varied(p, rng, fillers), unknown) for p in some if p in NEAR_MISSES for _ in range(10)]

    cut = len(plain) // 6
    seen, unseen = {f: ts[:-1] for f, ts in TEMPLATES.items()}, {f: ts[-1:] for f, ts in TEMPLATES.items()}
    calibrated = temperature(fitted(notices(seen) + others(plain[cut:]), families, steps), notices(unseen) + others(plain[:cut]))
    model = fitted(notices(TEMPLATES) + others(plain), families, steps)
    model.temperature = calibrated
    return model


def needed_words(confirm: float) -> set[str]:
    """Words of which a text has one if it has ``confirm`` of any template's words."""
    words: set[str] = set()
    for t in (t for ts in _WORDS.values() for t in ts):
        left = (1 - confirm) * len(t) + 1e-6
        for w in sorted(set(t), key=lambda w: (-len(w), w)):
            if left < 0:
                break
            words.add(w)
            left -= t.count(w)
    return words


def runs(lines: list[str], needed: set[str], confirm: float, sure: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """First and last line + 1 of the joined lines that are judged, counted over the lines that aren't blank.

    They lie around lines with a word that is needed, where lines together have enough words of a template;
    lines at or beside one in ``sure`` (line, family) are not joined for the templates of its family.
    """
    text = "\n".join(lines).lower()
    near = [w for w in needed if w in text]
    if not near:
        return []
    blocks, k = [[0, 0]], 0
    for p in lines:
        if p.strip():
            k += 1
            blocks[-1][1] = k
        else:
            blocks.append([k, k])
    low = [p.lower() for p in lines if p.strip()]
    known: dict[int, list[str]] = {}

    def words(k: int) -> list[str]:
        if k not in known:
            known[k] = _TOKEN.findall(low[k])
        return known[k]

    marks = [k for k, p in enumerate(low) if any(w in p for w in near) and not needed.isdisjoint(words(k))]
    regions: list[list[int]] = []
    for a, b in blocks:
        for p in marks[bisect_left(marks, a) : bisect_left(marks, b)] if b - a > 1 else ():
            lo, n = p, 0
            while lo > a and n < LONGEST:
                lo -= 1
                n += len(words(lo))
            hi, n = p + 1, 0
            while hi < b and n < LONGEST:
                n += len(words(hi))
                hi += 1
            lo, hi = max(a, lo - (p - lo) // 4 - 1), min(b, hi + (hi - p) // 4 + 1)  # runs grow by a quarter at a time
            if regions and lo < regions[-1][1] and regions[-1][0] >= a:
                regions[-1][1] = max(hi, regions[-1][1])
            else:
                regions.append([lo, hi])
    out: set[tuple[int, int]] = set()
    marked, done = set(marks), {}
    for k, family in sorted(sure):
        done.setdefault(family, []).append(k)
    for lo, hi in regions:
        own = [_VOCABULARY.intersection(words(k)) for k in range(lo, hi)]
        every = set().union(*own)
        spans = set()
        for family, count, size in _COUNTS:
            if sum(n for w, n in count.items() if w in every) < confirm * size - 1e-6:
                continue
            lines_of = done.get(family, [])
            near_by = lines_of[bisect_left(lines_of, lo - 1) : bisect_left(lines_of, hi + 1)]
            cuts = sorted({k for c in near_by for k in (c - 1, c, c + 1) if lo <= k < hi})
            for a, b in zip([lo, *[c + 1 for c in cuts]], [*cuts, hi], strict=True):
                if b - a > 1:
                    some = set().union(*own[a - lo : b - lo])
                    if sum(n for w, n in count.items() if w in some) >= confirm * size - 1e-6:
                        spans.add((a, b))
        for a, b in spans:
            has = [0, *accumulate(k in marked for k in range(a, b))]
            upto = [0, *accumulate(len(words(k)) for k in range(a, b))]
            for i in range(a, b - 1):
                n = 2
                while True:
                    j = min(i + n, b)
                    if has[j - a] > has[i - a]:
                        out.add((i, j))
                    if j == b or upto[j - 1 - a] - upto[i - a] >= LONGEST:
                        break
                    n += max(1, n // 4)
    return sorted(out)


def sampled(docs: DataFrame, id_col: str, text_col: str, most: int) -> list[str]:
    n = docs.count()
    place = F.pmod(F.xxhash64(F.lit(1), F.col(id_col)), F.lit(1 << 30))
    some = docs.filter(place < int(min(1.0, most / 4 / max(n, 1)) * (1 << 30))).select(F.split(F.col(text_col), "\n").alias("p"))
    lines = some.select(F.explode("p").alias("p")).filter("length(p) BETWEEN 1 AND 2000").orderBy(F.xxhash64("p"), "p").limit(most).collect()
    return [r[0] for r in lines]


def paragraphs(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, confirm: float = 0.6) -> DataFrame:
    """doc_id, n_paragraphs, and found: array of (paragraph, family, probability, similarity, confirmed)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t"))
    entry = pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])
    arrow = pa.schema([("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("found", pa.list_(entry))])

    needed = needed_words(confirm)

    def judge(texts: list[str | None]) -> tuple[list[int], list[list[dict]]]:
        raw = [(t or "").split("\n") for t in texts]
        lines = [[p for p in ps if p.strip()] for ps in raw]
        flat = [p for ps in lines for p in ps]
        found: list[list[dict]] = [[] for _ in texts]
        sure: list[list[tuple]] = [[] for _ in texts]
        if flat:
            p = model.probabilities(flat)
            best = p.argmax(1)
            whose = np.repeat(np.arange(len(lines)), [len(ps) for ps in lines])
            first = np.cumsum([0] + [len(ps) for ps in lines])
            for k in np.flatnonzero((best < len(model.families) - 1) & (p.max(1) >= least)):
                family = model.families[best[k]]
                near = closeness(flat[k], family)
                found[whose[k]].append({"paragraph": int(k - first[whose[k]]), "family": family, "probability": float(p[k, best[k]]), "similarity": near, "confirmed": near >= confirm})
        joined = [(d, i, j) for d, ps in enumerate(raw) for i, j in runs(ps, needed, confirm, [(x["paragraph"], x["family"]) for x in found[d] if x["confirmed"]])]
        for at in range(0, len(joined), RUNS):
            some = joined[at : at + RUNS]
            wrapped = [" ".join(lines[d][i:j]) for d, i, j in some]
            p = model.probabilities(wrapped)
            best = p.argmax(1)
            for k in np.flatnonzero((best < len(model.families) - 1) & (p.max(1) >= least)):
                d, i, j = some[k]
                near = closeness(wrapped[k], model.families[best[k]])
                if near >= confirm:
                    sure[d].append((-near, j - i, i, j, model.families[best[k]], float(p[k, best[k]])))
        for d, candidates in enumerate(sure):
            # Starts and ends of what is taken, by family; both rise, so the last that starts up to j is the one that may touch.
            taken: dict[str, tuple[list[int], list[int]]] = {}
            for k, family in sorted((x["paragraph"], x["family"]) for x in found[d] if x["confirmed"]):
                for x, own in zip((k, k + 1), taken.setdefault(family, ([], [])), strict=True):
                    own.append(x)
            for near, _, i, j, family, probability in sorted(candidates):
                starts, ends = taken.setdefault(family, ([], []))
                at = bisect_right(starts, j)
                if not at or ends[at - 1] < i:
                    starts.insert(at, i)
                    ends.insert(at, j)
                    found[d].append({"paragraph": i, "family": family, "probability": probability, "similarity": -near, "confirmed": True})
            found[d].sort(key=lambda x: (x["paragraph"], x["family"]))
        return [len(ps) for ps in lines], found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, some, size, counts, found = batch.column(1), [], 0, [], []
            for k in range(batch.num_rows):
                some.append(texts[k].as_py())
                size += len(some[-1] or "")
                if size > 500_000 or k == batch.num_rows - 1:
                    n, f = judge(some)
                    counts += n
                    found += f
                    some, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(entry))], schema=arrow)

    return rows.mapInArrow(run, "doc_id long, n_paragraphs long, found array<struct<paragraph:long,family:string,probability:double,similarity:double,confirmed:boolean>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 3000, **kw) -> DataFrame:
    """Per document: doc_id, n_paragraphs, n_licensed, families (sorted, joined by '|'), probability (the largest, 0 if none)."""
    rows = paragraphs(docs, train(sampled(docs, id_col, text_col, sample)), id_col, text_col, **kw)
    sure = F.filter("found", lambda x: x["confirmed"])
    return rows.select(
        "doc_id", "n_paragraphs", F.size(sure).cast("long").alias("n_licensed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), "|").alias("families"),
        F.coalesce(F.array_max(F.transform(sure, lambda x: x["probability"])), F.lit(0.0)).alias("probability"),
    )
