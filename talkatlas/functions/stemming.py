"""The stemmed index profile: Unicode words, diacritics folded, Porter's 1980 stemmer.

Stemming has no built-in; it runs in Arrow batches with a cache of words, and gives
for each row its number of words and its hits for each stemmed query prefix."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkatlas.operators.ranking import B, K1

_WORD = re.compile(r"[^\W_]+")


def index_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits without diacritics; underscores separate."""
    flat = unicodedata.normalize("NFD", (text or "").lower())
    return _WORD.findall("".join(c for c in flat if not unicodedata.combining(c)))


def _shape(word: str) -> str:
    """c or v for each letter: y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    """Porter's m: the number of vowel-consonant changes."""
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


# The published suffix tables of steps 2, 3 and 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replace(word: str, table: tuple[tuple[str, str], ...]) -> str:
    for end, new in sorted(table, key=lambda t: -len(t[0])):
        if word.endswith(end):
            root = word[: -len(end)]
            return root + new if _measure(root) > 0 else word
    return word


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word of three to sixty-four letters; others stay."""
    if not 3 <= len(word) <= 64:
        return word
    # 1a
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    # 1b
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            root = word[: -len(end)]
            if word.endswith(end) and "v" in _shape(root):
                word = root
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    # 1c
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2), _STEP3)
    # 4
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            root = word[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
                word = root
            break
    # 5
    if word.endswith("e"):
        root = word[:-1]
        if _measure(root) > 1 or (_measure(root) == 1 and not _cvc(root)):
            word = root
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


def stemmed_bm25(rows: DataFrame, query: str, key: str, texts: list[str], within: DataFrame | None = None, match: list[str] | None = None) -> DataFrame:
    """key and score (higher is better): BM25 with each query word a prefix of stems.

    As ranking.bm25, with hits counted over stems; one pass and one single-row aggregate."""
    prefixes = list(dict.fromkeys(stem(w) for w in index_words(query) if len(w) > 1))
    if not prefixes:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    counts = [t in (match or texts) for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, hits = [], [[] for _ in prefixes]
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for cells in zip(*columns, strict=True):
                total, found = 0, [0] * len(prefixes)
                for cell, counted in zip(cells, counts, strict=True):
                    words = index_words(cell)
                    total += len(words)
                    if counted:
                        for w in map(stem, words):
                            for j, p in enumerate(prefixes):
                                found[j] += w.startswith(p)
                size.append(float(total))
                for j, n in enumerate(found):
                    hits[j].append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.float64()), *[pa.array(h, pa.int32()) for h in hits]], names=[key, "d", *[f"f{j}" for j in range(len(prefixes))]])

    kinds = ", ".join(f"f{j} int" for j in range(len(prefixes)))
    narrow = rows.select(key, *texts).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, d double, {kinds}")
    stats = narrow.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("avg"), *[F.count_if(F.col(f"f{j}") > 0).alias(f"n{j}") for j in range(len(prefixes))]).first()
    score, hit = F.lit(0.0), F.lit(False)
    for j in range(len(prefixes)):
        idf = math.log((stats.n - stats[f"n{j}"] + 0.5) / (stats[f"n{j}"] + 0.5)) if stats.n else 0.0
        f = F.col(f"f{j}")
        score = score + F.lit(idf if idf > 0 else 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.lit(stats.avg or 1.0)))
        hit = hit | (f > 0)
    out = narrow.where(hit).select(key, score.alias("score"))
    return out if within is None else out.join(within.select(key).distinct(), key, "left_semi")
