"""Retrieval: BM25, vector search, rank fusion, caps, sampling, interleaving."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkatlas.functions.text import dot, words

RRF_K = 60
OVER_FETCH = 6
K1, B = 1.2, 0.75


def query_prefixes(query: str) -> list[str]:
    """Distinct lower-cased query words of two signs or more; each is a prefix."""
    return list(dict.fromkeys(t for t in re.findall(r"[a-z0-9]+", query.lower()) if len(t) > 1))


def keyword_matches(rows: DataFrame, query: str, text: str = "text") -> DataFrame:
    """rows that hold a word beginning with a query word: the complete, unranked match set."""
    prefixes = query_prefixes(query)
    hit = F.exists(words(F.col(text)), lambda w: F.lit(False) if not prefixes else _any_prefix(w, prefixes))
    return rows.where(hit)


def _begins(prefix: str) -> Callable[[Column], Column]:
    return lambda word: word.startswith(prefix)


def _any_prefix(word: Column, prefixes: list[str]) -> Column:
    test = word.startswith(prefixes[0])
    for p in prefixes[1:]:
        test = test | word.startswith(p)
    return test


def bm25(rows: DataFrame, query: str, key: str, texts: list[str], within: DataFrame | None = None, match: list[str] | None = None) -> DataFrame:
    """key and score (higher is better) of the rows that match.

    texts: the indexed columns (all count for length); match: those in which hits count
    (all by default). Statistics are those of all rows; `within` (a frame of keys) only restricts what is
    returned. One pass counts, for every row, its words and each prefix's hits;
    one single-row aggregate gives the statistics: nothing else is shuffled."""
    prefixes = query_prefixes(query)
    if not prefixes:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    counted = rows
    for i, t in enumerate(texts):
        counted = counted.withColumn(f"w{i}", words(F.coalesce(F.col(t), F.lit(""))))
    length = sum((F.size(f"w{i}") for i in range(len(texts))), F.lit(0))
    at = [i for i, t in enumerate(texts) if match is None or t in match]
    hits = [sum((F.size(F.filter(f"w{i}", _begins(p))) for i in at), F.lit(0)).alias(f"f{j}") for j, p in enumerate(prefixes)]
    narrow = counted.select(key, length.cast("double").alias("d"), *hits)
    stats = narrow.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("avg"), *[F.count_if(F.col(f"f{j}") > 0).alias(f"n{j}") for j in range(len(prefixes))]).first()
    score = F.lit(0.0)
    any_hit = F.lit(False)
    for j in range(len(prefixes)):
        nj = stats[f"n{j}"]
        idf = math.log((stats.n - nj + 0.5) / (nj + 0.5)) if stats.n else 0.0
        idf = idf if idf > 0 else 1e-6
        f = F.col(f"f{j}")
        score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.lit(stats.avg or 1.0)))
        any_hit = any_hit | (f > 0)
    out = narrow.where(any_hit).select(key, score.alias("score"))
    return out if within is None else out.join(within.select(key).distinct(), key, "left_semi")


def nearest(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and score: inner product with the query vector (cosine, for unit vectors)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, dot(F.col(vector), q).alias("score"))


def top(rows: DataFrame, score: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(score), F.asc(key)).limit(n)


def ranked(rows: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n best with a column rank from 0. The window sees n rows: the limit is below it."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(score), F.asc(key))
    return top(rows, score, key, n).withColumn("rank", F.row_number().over(w) - 1)


def fuse(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of frames (key, rank): key and score."""
    both = lists[0].select(key, "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select(key, "rank"))
    return both.groupBy(key).agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def best_per_group(rows: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """Each group's best row, by pre-aggregation (no window over a hot group)."""
    best = rows.groupBy(group).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(score), -F.col(key))).alias("r"))
    return best.select("r.*")


def normalised(rows: DataFrame, score: str = "score", digits: int = 4) -> DataFrame:
    """Scores over the largest, rounded; for result lists, which are short."""
    most = F.max(score).over(Window.partitionBy(F.lit(0)))
    return rows.withColumn(score, F.round(F.col(score) / most, digits))


def cap_per_group(rows: DataFrame, group: str, order: list[Column], cap: int) -> DataFrame:
    """At most cap rows of each group in the given order. Spark pre-limits a row_number
    filter within each task, so a hot group shuffles cap rows a task."""
    return rows.withColumn("rn__", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn__") <= cap).drop("rn__")


def interleave(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows with columns round and lead: sorted by them, groups take turns in the order of their first rows."""
    inner = rows.withColumn("pos__", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    w = Window.partitionBy(group)
    return inner.withColumn("round", F.row_number().over(w.orderBy("pos__"))).withColumn("lead", F.min("pos__").over(w)).drop("pos__")


def evenly_sampled(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Up to `most` rows of each group, evenly spread, first and last included (only the first for 1)."""
    w = Window.partitionBy(group)
    r, c = F.col("r__"), F.col("c__")
    numbered = rows.withColumn("r__", F.row_number().over(w.orderBy(order)).cast("long")).withColumn("c__", F.count(F.lit(1)).over(w))
    step = F.expr(f"case when c__ > 1 then div((r__ - 1) * {most - 1}, c__ - 1) > div((r__ - 2) * {most - 1}, c__ - 1) else false end") if most > 1 else F.lit(False)
    return numbered.where((c <= most) | (r == 1) | step).drop("r__", "c__")


def blended(rows: DataFrame, key: str, relevance: str, recency: str, recency_first: bool = False) -> DataFrame:
    """rows with a column blend: reciprocal ranks of relevance and recency, one weighted double."""
    a, b = (1.0, 2.0) if recency_first else (2.0, 1.0)
    rel = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(relevance), F.asc(key))) - 1
    rec = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(recency), F.asc(key))) - 1
    return rows.withColumn("blend", F.lit(a) / (RRF_K + rel) + F.lit(b) / (RRF_K + rec))


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each group: positions are averaged by partial aggregation."""
    parts = vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def packed_by_size(rows: DataFrame, group: str, size: str, budget: int) -> DataFrame:
    """group, used, n: what a first-fit walk of each group takes, largest rows first. Rows of one size are
    counted together, so a group's array has at most budget + 1 entries, whatever its number of rows."""
    counts = rows.where(F.col(size).between(0, budget)).groupBy(group, size).agg(F.count(F.lit(1)).alias("c"))
    listed = counts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col(size)).cast("long").alias("o"), "c"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        one = -x["o"]
        fits = F.when(one == 0, x["c"]).otherwise(F.least(x["c"], F.floor((F.lit(budget) - acc["used"]) / one)))
        return F.struct((acc["used"] + fits * one).cast("long").alias("used"), (acc["n"] + fits).cast("long").alias("n"))

    taken = listed.select(group, F.aggregate("all", start, step).alias("p"))
    every = rows.select(group).distinct().join(taken.withColumnRenamed(group, "g__"), F.col(group).eqNullSafe(F.col("g__")), "left")
    zero = lambda c: F.coalesce(F.col("p")[c], F.lit(0).cast("long")).alias(c)
    return every.select(group, zero("used"), zero("n"))


def frequent_phrases(rows: DataFrame, key: str, text: str, most: int = 6, boost: float = 2.5) -> DataFrame:
    """key, term, score: each row's most frequent words (over two signs) and, with a boost, pairs of words used twice,
    over the best one's count. Counted row by row in Arrow batches: nothing is shuffled."""
    found = re.compile("[a-z0-9]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, scores = [], [], []
            for i, cell in enumerate(batch.column(1)):
                words_ = found.findall((cell.as_py() or "").lower())
                counts = {w: float(c) for w, c in Counter(words_).items() if len(w) > 2}
                pairs = Counter(zip(words_, words_[1:]))
                counts |= {f"{a} {b}": boost * c for (a, b), c in pairs.items() if c > 1}
                best = heapq.nsmallest(most, counts.items(), key=lambda x: (-x[1], x[0]))
                at += [i] * len(best)
                terms += [t for t, _ in best]
                scores += [c / best[0][1] for _, c in best]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(scores, pa.float64())], names=[key, "term", "score"])

    shape = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.select(key, text).mapInArrow(run, shape)
