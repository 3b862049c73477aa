"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its target share of the output divided by
its share of the input. Each document is repeated as often as the inverse of the
Poisson distribution with that mean says at a number in [0, 1) hashed from a seed
and its id; so the counts are independent of partitions, order and reruns. Means
over PIECE are split into equal parts with a hash of their own each (a sum of
Poisson numbers is a Poisson number), which keeps the probabilities far from
underflow without capping any count. Copies are then dealt to partitions and
ordered by another hash: a global shuffle in one exchange, without a sampling pass.

Everything is built from DataFrame functions. Only one row for each source is
aggregated (partially before its shuffle); that table is broadcast if it has at
most BROADCAST_SOURCES rows, otherwise it is joined by shuffle, where adaptive
execution splits a hot source.

Defined results: a null source is a source of its own; a null id hashes as the
empty string; repeated ids repeat alike; texts may be null, empty or long (they
are only carried); a source without a target weight, or with weight 0, goes; an
empty table stays empty; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 16.0
#: Largest count that one piece can give: beyond it less than 2**-52 is left.
TERMS = 90
BROADCAST_SOURCES = 50_000


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from md5(seed|part|part...)."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, total: float | None = None) -> DataFrame:
    """source, n_docs, rate: the mean number of copies of each source's documents.

    weights: target shares by source (normalised); without them a source's share
    is proportional to its number of documents to the power `temperature`.
    total: the expected number of output rows; the input's number by default."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n_docs"))
    if weights is None:
        share = F.pow("n_docs", F.lit(float(temperature)))
        wanted = counts.withColumn("w", share)
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, w double")
        wanted = counts.join(given, F.col("source").eqNullSafe(F.col("k")), "left").drop("k").fillna(0.0, ["w"])
    sums = wanted.agg(F.sum("n_docs").alias("n"), F.sum("w").alias("w")).first()
    if not sums.n or not sums.w:
        return wanted.select("source", "n_docs", F.lit(0.0).alias("rate"))
    out = float(sums.n if total is None else total)
    return wanted.select("source", "n_docs", (F.col("w") / F.lit(sums.w) * F.lit(out) / F.col("n_docs")).alias("rate"))


def _distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0..TERMS, as an array."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("s"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        s = acc["s"] + p
        return F.struct(p.alias("p"), s.alias("s"), F.array_append(acc["all"], s).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["all"])


def replicate(docs: DataFrame, by_source: DataFrame, seed: str = "mix", shuffle: bool = True) -> DataFrame:
    """docs with each row repeated, and columns rate and replica (from 0), which replace
    columns of these names."""
    table = by_source.select(F.col("source").alias("source__"), F.col("rate").alias("rate__"), F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int").alias("pieces__"))
    table = table.withColumn("cdf__", _distribution(F.col("rate__") / F.col("pieces__")))
    if by_source.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    joined = docs.join(table, docs["source"].eqNullSafe(F.col("source__"))).where(F.col("rate__") > 0)
    draws = F.transform(F.sequence(F.lit(0), F.col("pieces__") - 1), lambda piece: uniform(seed, F.col("doc_id"), piece))
    number = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("cdf__", lambda c: c <= u)))
    copies = (
        joined.withColumn("number__", number)
        .where(F.col("number__") > 0)
        .withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("number__") - 1)))
        .withColumn("rate", F.col("rate__"))
        .drop("number__", "cdf__", "pieces__", "source__", "rate__")
    )
    if not shuffle:
        return copies
    order = F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "replica")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.withColumn("order__", order).repartition(parts, "order__").sortWithinPartitions("order__", "doc_id", "replica").drop("order__")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, total: float | None = None, seed: str = "mix") -> DataFrame:
    """rates and replicate in one."""
    return replicate(docs, rates(docs, weights, temperature, total), seed)


def oracle(columns: str, table: str, seed: str = "mix", temperature: float = 0.5) -> str:
    """DuckDB SQL for mix(): the distribution in closed form."""
    return f"""
WITH per_source AS (SELECT source, CAST(count(*) AS DOUBLE) AS n_docs FROM {table} GROUP BY source),
sums AS (SELECT sum(n_docs) AS n, sum(pow(n_docs, {temperature})) AS w FROM per_source),
rates AS (SELECT source, pow(n_docs, {temperature}) / w * n / n_docs AS rate FROM per_source, sums),
pieces AS (SELECT *, CAST(greatest(1, ceil(rate / {PIECE})) AS BIGINT) AS m FROM rates),
terms AS (SELECT source, k, rate / m AS mean, exp(-(rate / m) + k * ln(rate / m) - lgamma(k + 1)) AS p
          FROM pieces, (SELECT unnest(range(0, {TERMS + 1})) AS k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
u AS (SELECT d.doc_id, d.source, i,
             CAST(CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || i), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52} AS u
      FROM {table} d JOIN pieces p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(0, p.m)) AS i)),
numbers AS (SELECT doc_id, CAST(sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND cdf.c <= u.u)) AS BIGINT) AS number FROM u GROUP BY doc_id)
SELECT {columns} FROM {table} d JOIN numbers x ON d.doc_id IS NOT DISTINCT FROM x.doc_id JOIN rates r ON d.source IS NOT DISTINCT FROM r.source,
     LATERAL (SELECT CAST(unnest(range(0, x.number)) AS INTEGER) AS replica)
"""
