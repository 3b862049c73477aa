"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes disguises: letters are lower-cased, look-alikes of other scripts
and full-width forms become Latin letters, zero-width signs go, and digits and
signs used as letters are read as letters. A lexicon entry is the beginning of a
word (so inflected forms match); its weight is the log-odds of the labelled toxic
against the labelled clean documents that hold it, and an entry is kept only if
its excess is significant. An exception phrase (learned from clean documents, or
given) cancels the hits that it covers. The weighted hits are divided by the
document's number of words, and a logistic curve over that density and over the
absolute weight turns them into a score.

Entries are beginnings of PREFIX letters: shorter words are too common to be telling in any language, and
beyond sixteen letters a longer beginning tells no more. Hits inside a word are none ("grass").

Defined results: null or empty text has no hits and gets the curve's value at
zero; null labels are ignored; with no labelled rows of both kinds the lexicon is
empty and every score is 0; extra columns of any name are carried by `drop_toxic` and ignored
by `score`; repeated rows are each scored alike; a score at the threshold is rejected; very long texts are
matched whole, in time linear in their hits; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import bounded_sample

#: Documented bound: at most about this many labelled rows are learned from.
TRAIN_ROWS = 8000
PREFIX = (3, 16)
SIGNIFICANCE = 1e-6

# Signs read as letters, and look-alikes of Latin letters.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
_HIDDEN = "​‌‍⁠﻿­"
_RARE = {ord(a): b for a, b in _LOOKALIKES.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)} | {ord(c): None for c in _HIDDEN}
_HAS_RARE = re.compile("[Ͱ-ԯ！-～" + _HIDDEN + "]")
_ASCII = bytes(ord(_DIGITS.get(chr(i), chr(i))) for i in range(256))
_WORD = re.compile(r"[^\W_]+")


def fold_text(text: str) -> str:
    """Lower-case Latin text with disguised letters restored."""
    text = text.lower()
    if not text.isascii() and _HAS_RARE.search(text):
        text = text.translate(_RARE).lower()
    return text.encode("utf-8", "replace").translate(_ASCII).decode("utf-8")


@dataclass
class Lexicon:
    """entries: beginning of a word -> weight; exceptions: whole phrases; curve: (constant, density, weight)."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-35.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.entries:
            return None
        a = ahocorasick.Automaton()
        for word, weight in self.entries.items():
            a.add_word(word, (len(word), weight))
        for phrase in self.exceptions:
            if phrase not in self.entries:
                a.add_word(phrase, (len(phrase), 0.0))
        a.make_automaton()
        return a


def hits(automaton: ahocorasick.Automaton | None, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries at word beginnings, the longest of each place, without the excepted."""
    if automaton is None:
        return []
    best: dict[int, tuple[int, float]] = {}
    excepted: list[tuple[int, int]] = []
    for last, (size, weight) in automaton.iter(folded):
        start, end = last + 1 - size, last + 1
        if start and folded[start - 1].isalnum():
            continue
        if weight == 0.0:
            if end == len(folded) or not folded[end].isalnum():
                excepted.append((start, end))
        else:
            best[start] = (end, weight)  # a longer entry of the same place comes later
    if not excepted:
        return [(s, e, w) for s, (e, w) in best.items()]
    excepted.sort()
    out, k, reach = [], 0, -1
    for s in sorted(best):  # the furthest end among the exceptions that begin by here
        e, w = best[s]
        while k < len(excepted) and excepted[k][0] <= s:
            reach = max(reach, excepted[k][1])
            k += 1
        if e > reach:
            out.append((s, e, w))
    return out


def n_words(text: str) -> int:
    """White-space separated words, one at least."""
    return max(1, len(text.split()))


def measure(automaton: ahocorasick.Automaton | None, text: str) -> tuple[float, float]:
    """(log density, log weight) of a text's hits; both 0 without any."""
    found = hits(automaton, fold_text(text))
    if not found:
        return 0.0, 0.0
    total = sum(w for _, _, w in found)
    return math.log1p(1000.0 * total / n_words(text)), math.log1p(total)


def _tail(n: int, k: int, p: float) -> float:
    """P(X >= k) for X binomial(n, p), by its largest terms."""
    if k == 0:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return sum(math.exp(log(i)) for i in range(k, min(n, k + 60) + 1))


def learn(rows: list[tuple[str, int]], given_exceptions: frozenset[str] = frozenset()) -> Lexicon:
    """A lexicon from (text, toxic 0/1) rows."""
    toxic, clean = [fold_text(t) for t, y in rows if y], [fold_text(t) for t, y in rows if not y]
    if not toxic or not clean:
        return Lexicon()
    lo, hi = PREFIX

    def starts(text: str) -> set[str]:
        return {w[:k] for w in set(_WORD.findall(text)) for k in range(lo, min(hi, len(w)) + 1)}

    share = len(toxic) / (len(toxic) + len(clean))
    least = max(2, math.ceil(math.log(SIGNIFICANCE) / math.log(share)))
    first = Counter(w for t in toxic for w in set(_WORD.findall(t)) if len(w) >= lo)
    seen: Counter[str] = Counter()
    roots = Counter(w[:lo] for w in first.elements())
    for t in toxic:  # prefixes of rare beginnings can't reach the least count
        seen.update({w[:k] for w in set(_WORD.findall(t)) if len(w) >= lo and roots[w[:lo]] >= least for k in range(lo, min(hi, len(w)) + 1)})
    wanted = {p for p, c in seen.items() if c >= least}
    # copies of one text repeat its contexts: the support is the number of different ones, at most
    around: dict[str, set[tuple[str, str]]] = {p: set() for p in wanted}
    for t in toxic:
        own = ["", *_WORD.findall(t), ""]
        for k, w in enumerate(own[1:-1], 1):
            for n in range(lo, min(hi, len(w)) + 1):
                if (p := w[:n]) in around:
                    around[p].add((own[k - 1], own[k + 1]))
    seen = Counter({p: min(seen[p], len(around[p])) for p in wanted})
    wanted = {p for p in wanted if seen[p] >= least}
    against: Counter[str] = Counter()
    for t in clean:
        against.update(starts(t) & wanted)
    weights = {}
    for p in wanted:
        a, b = seen[p], against[p]
        w = math.log((a + 0.5) / (len(toxic) + 1)) - math.log((b + 0.5) / (len(clean) + 1))
        if w >= 2.5 and _tail(a + b, a, share) <= SIGNIFICANCE:
            weights[p] = w
    # of nested beginnings with about the same support only the most specific says something
    widest = {p[:-1]: 0 for p in weights}
    for p in weights:
        widest[p[:-1]] = max(widest[p[:-1]], seen[p])
    weights = {p: w for p, w in weights.items() if widest.get(p, 0) < 0.9 * seen[p]}
    entries: dict[str, float] = {}
    for p in sorted(weights, key=lambda x: (len(x), x)):  # the shortest beginning stands for its longer forms unless they tell clearly more
        held = [entries[p[:k]] for k in range(lo, len(p)) if p[:k] in entries]
        if not held or weights[p] > max(held) + 1.5:
            entries[p] = weights[p]
    lex = Lexicon(entries, given_exceptions)
    lex.exceptions = given_exceptions | _exceptions(lex, toxic, clean)
    auto = lex.automaton()
    x = np.array([[1.0, *measure(auto, t)] for t, _ in rows])
    lex.curve = _logistic(x, np.array([float(y) for _, y in rows]))
    return lex


def _exceptions(lex: Lexicon, toxic: list[str], clean: list[str]) -> frozenset[str]:
    """Words and word pairs around hits that several clean documents and no toxic one hold."""
    auto = lex.automaton()

    def phrases(text: str) -> set[str]:
        out = set()
        for s, e, _ in hits(auto, text):
            while e < len(text) and text[e].isalnum():
                e += 1
            out.add(text[s:e])
            if before := re.search(r"[^\W_]+ $", text[max(0, s - 40) : s]):
                out.add(before[0] + text[s:e])
            if after := re.match(r" [^\W_]+", text[e : e + 40]):
                out.add(text[s:e] + after[0])
        return out

    good = Counter(p for t in clean for p in phrases(t))
    bad = {p for t in toxic for p in phrases(t)} if good else set()
    return frozenset(p for p, c in good.items() if c >= 3 and p not in bad)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Newton's method for a small ridge-regularised logistic regression."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int = TRAIN_ROWS, exceptions: frozenset[str] = frozenset()) -> Lexicon:
    """The lexicon, learned in one task from the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t or "", y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(rows, exceptions))], pa.binary())], names=["m"])

    sample = bounded_sample(docs, labels, label, keep, most)
    got = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").mapInArrow(run, "m binary").collect()
    return pickle.loads(got[0].m) if got else Lexicon()


def score(docs: DataFrame, lexicon: Lexicon, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, score (0 to 1), n_hits and the words hit."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        auto, (c0, c1, c2) = lex.automaton(), lex.curve
        for batch in batches:
            out, number, words = [], [], []
            for cell in batch.column(batch.num_columns - 1):
                text = cell.as_py() or ""
                folded = fold_text(text)
                found = hits(auto, folded)
                x1 = x2 = 0.0
                if found:
                    total = sum(w for _, _, w in found)
                    x1, x2 = math.log1p(1000.0 * total / n_words(text)), math.log1p(total)
                out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, c0 + c1 * x1 + c2 * x2)))))
                number.append(len(found))
                words.append(sorted({folded[s:e] for s, e, _ in found}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64()), pa.array(number, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=[*carry, "score", "n_hits", "entries"])

    added = [("score", T.DoubleType()), ("n_hits", T.LongType()), ("entries", T.ArrayType(T.StringType()))]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in carry] + [T.StructField(n, t) for n, t in added])
    return docs.select(*carry, F.col("text").alias("text__")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score the threshold or more; all columns kept."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row__"), F.col("text"))
    return score(packed, lexicon, ("row__",)).where(F.col("score") < threshold).select("row__.*")
