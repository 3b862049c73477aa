"""Filters: visibility, session scopes, tags, dates, id sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Id lists up to this length go into the plan as literals; longer ones come as a DataFrame.
LITERAL_IDS = 1000


def visible(sessions: DataFrame, disabled: Iterable[str] = (), only_hidden: bool = False, adapter: str = "source_adapter", source: str = "source") -> DataFrame:
    """Sessions that listings show: not hidden, their adapter enabled (or, without one,
    their source). only_hidden shows the hidden ones of any source."""
    if only_hidden:
        return sessions.where("hidden")
    off = sorted(set(disabled))
    shown = ~F.coalesce(F.col("hidden"), F.lit(False))
    if off:
        a, s = F.col(adapter), F.col(source)
        shown = shown & ~F.coalesce(a.isin(off), F.lit(False)) & (a.isNotNull() | ~F.coalesce(s.isin(off), F.lit(False)))
    return sessions.where(shown)


def effective(updated: str = "updated_at", created: str = "created_at") -> Column:
    return F.coalesce(F.col(updated), F.col(created))


def between_days(when: Column, first: str | None = None, last: str | None = None) -> Column:
    """Instants from day first to day last, both included; nulls are out."""
    test = when.isNotNull()
    if first:
        test = test & (when >= F.lit(first).cast("timestamp"))
    if last:
        test = test & (when < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))
    return test


def with_all_tags(rows: DataFrame, tags: DataFrame, wanted: Iterable[str], key: str = "session_id") -> DataFrame:
    """rows that carry every wanted tag (trimmed, distinct): one pre-aggregated semi-join."""
    names = list(dict.fromkeys(t.strip() for t in wanted if t.strip()))
    if not names:
        return rows
    full = tags.where(F.col("tag").isin(names)).groupBy(key).agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(names))
    return rows.join(full.select(key), key, "left_semi")


def within_ids(rows: DataFrame, ids: DataFrame | list, key: str = "session_id") -> DataFrame:
    """rows whose key is in an id set; Spark picks the semi-join's strategy by size."""
    if isinstance(ids, list):
        if len(ids) <= LITERAL_IDS:
            return rows.where(F.col(key).isin(ids))
        ids = rows.sparkSession.createDataFrame([(i,) for i in ids], f"{key} {rows.schema[key].dataType.simpleString()}")
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def contains_text(column: Column, needle: str) -> Column:
    """Case-insensitive substring test; wild-cards in the needle are plain signs."""
    return F.lower(column).contains(needle.lower())
