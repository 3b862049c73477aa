"""Mutations as DataFrames: upsert, tombstones, skipping, collections, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, fresh: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """stored with fresh rows in place of those with the same key. Columns in `keep` hold
    the stored value where the fresh one is null."""
    columns = stored.columns
    old = stored.join(fresh.select(key), key, "left_anti")
    if keep:
        before = stored.select(key, *[F.col(c).alias(f"{c}__") for c in keep])
        fresh = fresh.join(before, key, "left").select(*[F.coalesce(c, f"{c}__").alias(c) if c in keep else F.col(c) for c in columns])
    return old.select(columns).unionByName(fresh.select(columns))


def unchanged(fresh: DataFrame, stored: DataFrame, key: str, signature: str) -> DataFrame:
    """fresh rows whose (key, signature) is stored already."""
    return fresh.join(stored.select(key, signature), [key, signature], "left_semi")


def changed(fresh: DataFrame, stored: DataFrame, key: str, signature: str) -> DataFrame:
    """fresh rows that must be ingested."""
    return fresh.join(stored.select(key, signature), [key, signature], "left_anti")


def not_buried(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """rows without a tombstone."""
    return rows.join(tombstones.select(key), key, "left_anti")


def members(rule: DataFrame, overrides: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """(rule or included) and not excluded, then visible. overrides: key, state."""
    included = overrides.where(F.col("state") == "include").select(key)
    excluded = overrides.where(F.col("state") == "exclude").select(key)
    return rule.select(key).unionByName(included).distinct().join(excluded, key, "left_anti").join(shown.select(key), key, "left_semi")


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key combination, by pre-aggregation."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def assemble_turns(rows: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """One row for each user message with the replies that follow it: session, turn_index,
    user_message, assistant_response. Rows before the first user message make turn 0."""
    w = Window.partitionBy(session).orderBy(order)
    turn = F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(w)
    marked = rows.withColumn("turn_index", turn.cast("long"))
    said = lambda who: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(role) == who, F.struct(order, text)))), lambda s: s[text]), "\n\n")
    return marked.groupBy(session, "turn_index").agg(said("user").alias("user_message"), said("assistant").alias("assistant_response"))


def write_ledger(calls: DataFrame) -> DataFrame:
    """Paths that one unambiguous, successful call wrote: exactly one start, one path and
    one end that succeeded, the end after the start. calls: session, call_id, pos, kind (start, path, end), path, ok."""
    start, end = F.col("kind") == "start", F.col("kind") == "end"
    per = calls.groupBy("session", "call_id").agg(
        F.count_if(start).alias("starts"),
        F.count_if(F.col("kind") == "path").alias("paths"),
        F.count_if(end).alias("ends"),
        F.bool_and(F.when(end, F.coalesce("ok", F.lit(False)))).alias("ok"),
        F.min(F.when(start, F.col("pos"))).alias("a"),
        F.min(F.when(end, F.col("pos"))).alias("b"),
        F.max("path").alias("path"),
    )
    return per.where("starts = 1 and paths = 1 and ends = 1 and ok and a < b").select("session", "path").distinct()
