"""Aggregates: facets, usage, trends, shares, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facet(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Values of a column with their counts, most frequent first."""
    out = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column))
    return out.limit(top) if top else out


def labelled(column: Column, label: str = "(unknown)") -> Column:
    """The value, or the label for null and empty."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(label))


def usage_by(rows: DataFrame, keys: list[Column | str], cost: str = "value", session: str = "user_id") -> DataFrame:
    """n_events, sessions and cost by keys."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(session).alias("sessions"), F.round(F.sum(cost), 2).alias("cost"))


def gap_filled(daily: DataFrame, day: str, measures: list[str]) -> DataFrame:
    """daily with a row for every day from the first to the last, zeros where there was none."""
    span = daily.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(day))
    return days.join(daily, day, "left").fillna(0, measures)


def share(rows: DataFrame, measure: str) -> DataFrame:
    """rows (a short, aggregated list) with percentages of the total and of the largest (2 at least)."""
    w = Window.partitionBy(F.lit(0))
    return rows.withColumn("of_total", F.round(100 * F.col(measure) / F.sum(measure).over(w), 2)).withColumn("of_max", F.round(F.greatest(F.lit(2.0), 100 * F.col(measure) / F.max(measure).over(w)), 2))


def trailing_average(daily: DataFrame, day: str, measure: str, points: int = 30, least: int = 7) -> DataFrame:
    """One row: the average of the last `points` points; null for fewer than `least`."""
    last = daily.orderBy(F.desc(day)).limit(points)
    n = F.count(F.lit(1))
    return last.agg(n.alias("points"), F.when(n >= least, F.round(F.avg(measure), 4)).alias("average"))
