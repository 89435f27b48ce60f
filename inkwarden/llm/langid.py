"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text (``sample_chars`` characters shared by all languages, taken from the
documents with the smallest hashes). A text is parsed against a language by
longest matches: a phrase runs as far as the automaton can follow it. Few
phrases mean that the text is made of what the language has; the count is
normalised by log2 of the training length over the text's length, which is an
estimate of the cross entropy, and the language with the least wins. Every
letter of the samples is a symbol of its own: transitions of the commonest
``SYMBOLS`` symbols are a dense table, those of all others a sorted list. Texts are
parsed in lanes of ``LANE`` characters side by side (a phrase ends with its
lane, for every language alike), whole texts always.

The score is the winner's share of 2 ** (-SHARPNESS * entropy).

Cases: null text, or text without a letter, is ``und`` with score 0; a very long
text is as many lanes as it needs; ties go to the first language in code-point
order; rows without a language teach nothing; a null id is never held out; with no
language learned all is ``und``; repeated rows are judged alike; an empty table
gives an empty result; columns of ``docs`` other than those named are not read, so
their names don't matter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE = 512
SYMBOLS = 64
SHARPNESS = 8.0
BREAK = 1 << 30


def held_out(id_col: str, mod: int, rest: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_chars: int, sample_docs: int = 400) -> dict[str, str]:
    """Training text by language; about ``sample_docs`` documents of each are looked at."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # a row for each language
    if not counts:
        return {}
    each = max(1000, sample_chars // len(counts))
    place = F.pmod(F.xxhash64(F.lit(10), F.col(id_col), F.col(text_col)), F.lit(1 << 30))
    some = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, sample_docs / n) * (1 << 30))))])
    # Of a long document the training sample has a part only; scoring reads whole texts.
    rows = known.filter(place < some[F.col(lang_col)]).select(lang_col, F.substring(text_col, 1, each).alias("t"), place.alias("p"), id_col)
    # Rows that are repeated have one place: with many copies of one the sample stops here.
    rows = rows.orderBy("p", id_col, "t").limit(4 * sample_docs * len(counts)).collect()
    texts: dict[str, str] = dict.fromkeys(counts, "")
    for lang, t, _, _ in sorted(rows, key=lambda r: (r[2], r[3] is None, r[3], r[1])):
        if len(texts[lang]) < each:
            texts[lang] += t[: each - len(texts[lang])].lower() + "\n"
    return {k: v for k, v in sorted(texts.items()) if v}


def alphabet(texts: dict[str, str]) -> dict[str, int]:
    """Codes of all letters in the texts, the commonest first; 0 is for what isn't a letter, 1 for letters that no text has."""
    count: dict[str, int] = {}
    for t in texts.values():
        for c in t:
            if c.isalpha():
                count[c] = count.get(c, 0) + 1
    return {c: k + 2 for k, c in enumerate(sorted(count, key=lambda c: (-count[c], c)))}


@functools.cache
def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def automaton(codes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix automaton as a table of state and symbol: the next state, with BREAK added where a phrase ends and the next one starts.

    Transitions with symbols beyond the table's are rows of (state, symbol, next state).
    """
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    # A symbol that the language hasn't got is a phrase of its own; whatever follows it starts another.
    root = np.full(SYMBOLS, len(nxt), dtype=np.int32)
    for c, s in nxt[0].items():
        if c < SYMBOLS:
            root[c] = s
    table = np.tile(root + BREAK, (len(nxt) + 1, 1))
    table[0] = root
    beyond = []
    for s, out in enumerate(nxt):
        for c, t in out.items():
            if c < SYMBOLS:
                table[s, c] = t
            else:
                beyond.append((s, c, t))
    return table, np.array(beyond, dtype=np.int64).reshape(-1, 3)


class Parser:
    def __init__(self, texts: dict[str, str]):
        self.langs = list(texts)
        letters = alphabet(texts)
        self.size = len(letters) + 2
        self.codes = letter_table().astype(np.uint8 if self.size < 255 else np.int32)
        self.pad = np.iinfo(self.codes.dtype).max
        for c, k in letters.items():
            self.codes[ord(c)] = k
            if len(up := c.upper()) == 1 and up.lower() == c:
                self.codes[ord(up)] = k
        trained = [self.squeeze(t) for t in texts.values()]
        automata = [automaton(t.tolist()) for t in trained]
        tables = [t for t, _ in automata]
        self.roots = np.cumsum([0] + [len(t) for t in tables])[:-1].astype(np.int32)
        self.table = np.zeros(0, np.int32) if not tables else np.concatenate([t + r for t, r in zip(tables, self.roots, strict=True)]).ravel()
        self.bits = np.log2(np.array([max(2, len(t)) for t in trained]))
        # Symbols beyond the table: by state and symbol, and by language from the root (else its last state, which has no phrase).
        beyond = [x + [r, 0, r] for (_, x), r in zip(automata, self.roots, strict=True)]
        self.keys, self.next = np.zeros(0, np.int64), np.zeros(0, np.int32)
        if beyond:
            rows = np.concatenate(beyond)
            order = np.argsort(keys := rows[:, 0] * self.size + rows[:, 1])
            self.keys, self.next = keys[order], rows[order, 2].astype(np.int32)
        self.starts = np.repeat(np.array([r + len(t) - 1 for t, r in zip(tables, self.roots, strict=True)], dtype=np.int32)[:, None], max(self.size - SYMBOLS, 0), axis=1)
        for k, (x, r) in enumerate(zip(beyond, self.roots, strict=True)):
            first = x[x[:, 0] == r]
            self.starts[k, first[:, 1] - SYMBOLS] = first[:, 2]

    def step_beyond(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states (as in the table) of languages and lanes by symbols beyond the table."""
        key = state.astype(np.int64) * self.size + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        again = self.starts[:, symbol - SYMBOLS] + np.where(state == self.roots[:, None], 0, BREAK).astype(np.int32)
        return np.where(self.keys[at] == key, self.next[at], again)

    def squeeze(self, text: str) -> np.ndarray:
        """Symbols of a text, with runs of what isn't a letter as one."""
        x = self.codes[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
        keep = np.ones(len(x), dtype=bool)
        keep[1:] = (x[1:] > 0) | (x[:-1] > 0)
        return x[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text by each language."""
        lanes = [-(-len(t) // LANE) for t in texts]
        block = np.full((sum(lanes), LANE), self.pad, dtype=self.codes.dtype)
        k = 0
        for t, n in zip(texts, lanes, strict=True):
            block[k : k + n].reshape(-1)[: len(t)] = t
            k += n
        sizes = (block != self.pad).sum(1)
        order = np.argsort(-sizes, kind="stable")
        block, sizes = np.ascontiguousarray(block[order].T), sizes[order]
        # In the table, a symbol beyond it counts as one that no language has; step_beyond puts that right.
        near, rare = (block, None) if self.size <= SYMBOLS else (np.where(block < SYMBOLS, block, 1), (block >= SYMBOLS) & (block != self.pad))
        found = np.ones((len(self.roots), len(order)), dtype=np.int32)
        state = np.repeat(self.roots[:, None], len(order), axis=1)
        left = np.searchsorted(-sizes, -np.arange(LANE), side="left")  # lanes longer than each step
        for j in range(LANE):
            if not (m := left[j]):
                break
            step = self.table[state[:, :m] * SYMBOLS + near[j, :m]]
            if rare is not None and len(some := np.flatnonzero(rare[j, :m])):
                step[:, some] = self.step_beyond(state[:, some], block[j, some].astype(np.int64))
            found[:, :m] += step >= BREAK
            state[:, :m] = step & (BREAK - 1)
        by_lane = np.empty_like(found)
        by_lane[:, order] = found
        ends = np.cumsum(lanes)
        total = np.concatenate([np.zeros((len(self.roots), 1), dtype=np.int64), np.cumsum(by_lane, axis=1)], axis=1)
        return (total[:, ends] - total[:, ends - np.array(lanes)]).T

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        symbols = [(k, s) for k, t in enumerate(texts) if t and (s := self.squeeze(t)).any()]
        if not symbols:
            return langs, scores
        entropy = self.phrases([s for _, s in symbols]) * self.bits / np.array([[len(s)] for _, s in symbols])
        best = entropy.argmin(1)
        share = 1 / np.exp2(-SHARPNESS * (entropy - entropy.min(1, keepdims=True))).sum(1)
        for (k, _), b, p in zip(symbols, best, share, strict=True):
            langs[k], scores[k] = self.langs[b], float(p)
        return langs, scores


_PARSERS: dict[int, Parser] = {}


def identify(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text", more: list[Column] | None = None, chars: int = 2_000_000) -> DataFrame:
    """doc_id, ``more`` columns, lang_pred, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *(more or []), F.col(text_col).alias("_text"))
    names = rows.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(texts.items()))
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = Parser(texts)
        parser = _PARSERS[key]
        for batch in batches:
            all_langs, all_scores, some, size = [], [], [], 0
            column = batch.column(len(names))
            for k in range(batch.num_rows):
                some.append(column[k].as_py())
                size += len(some[-1] or "")
                if size > chars or k == batch.num_rows - 1:
                    langs, scores = parser.judge(some)
                    all_langs += langs
                    all_scores += scores
                    some, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(all_langs, pa.string()), pa.array(all_scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = 240_000, mod: int = 4, rest: int = 2) -> DataFrame:
    """Learn from the rows that aren't held out, judge all: doc_id, held_out, lang_pred, score."""
    out = held_out(id_col, mod, rest)
    return identify(docs, learn(docs.filter(~out), id_col, text_col, lang_col, sample_chars), id_col, text_col, [out.alias("held_out")])
