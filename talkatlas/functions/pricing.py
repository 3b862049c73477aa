"""Model prices: a registry file, its validation, look-up by name, cost.

A registry is JSON: {"models": {name: {"provider", "status", "pricing": {"input", "output",
"cached_input", "cache_write_5m", "cache_write_1h"}, "aliases": []}}, "providers": {...}}
or simply {name: [input, output, cached[, write[, write one-hour]]]}; USD per million tokens."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a model costs that no entry matches.
DEFAULT = (3.0, 15.0, 0.30)
#: A registry is a small dimension; more rows than this are not broadcast.
MOST_ENTRIES = 10_000
_FIELDS = ("input", "output", "cached_input", "cache_write_5m", "cache_write_1h")


def normalise(name: str) -> str:
    """Lower case, dots and underscores as hyphens."""
    return name.strip().lower().replace(".", "-").replace("_", "-")


def parse(registry: Mapping) -> dict[str, tuple[float, ...]]:
    """name or alias -> prices; later entries win."""
    table: dict[str, tuple[float, ...]] = {}
    for name, spec in registry.get("models", registry).items():
        if isinstance(spec, Mapping):
            pricing = spec["pricing"]
            prices = [float(pricing[k]) for k in _FIELDS[:3]]
            for k in _FIELDS[3:]:
                if k not in pricing:
                    break
                prices.append(float(pricing[k]))
            names = [name, *spec.get("aliases", [])]
        else:
            prices, names = [float(x) for x in spec], [name]
        for n in names:
            table[n] = tuple(prices)
    return table


def load(path: str) -> dict[str, tuple[float, ...]]:
    with open(path, encoding="utf-8") as f:
        return parse(json.load(f))


def validate(registry: Mapping, today: date | None = None) -> list[str]:
    """What is wrong: name collisions after normalisation, prices, providers, freshness."""
    errors, seen = [], {}
    providers = set(registry.get("providers", {}))
    for name, spec in registry.get("models", registry).items():
        prices = list(spec["pricing"].values()) if isinstance(spec, Mapping) else list(spec)
        if not 3 <= len(prices) <= 5 or any(not isinstance(p, (int, float)) or isinstance(p, bool) or not math.isfinite(p) or p < 0 for p in prices):
            errors.append(f"{name}: prices must be three to five finite, non-negative numbers")
        if isinstance(spec, Mapping) and providers and spec.get("provider") not in providers:
            errors.append(f"{name}: unknown provider {spec.get('provider')}")
        for n in [name, *(spec.get("aliases", []) if isinstance(spec, Mapping) else [])]:
            if (key := normalise(n)) in seen:
                errors.append(f"{n}: collides with {seen[key]}")
            seen.setdefault(key, n)
    if "verified_at" in registry and today is not None:
        age = (today - date.fromisoformat(registry["verified_at"])).days
        if age > registry.get("fail_after_days", 10**6):
            errors.append(f"verified {age} days ago")
    return errors


def price_frame(spark: SparkSession, table: Mapping[str, tuple[float, ...]]) -> DataFrame:
    """key, p_in, p_out, p_cached, p_write, p_write_1h (1.25 and 2 times the input where not given)."""
    rows = {}
    for name, p in table.items():
        if name != "_default":
            rows[normalise(name)] = (*p[:3], p[3] if len(p) > 3 else p[0] * 1.25, p[4] if len(p) > 4 else p[0] * 2.0)
    return spark.createDataFrame([(k, *v) for k, v in sorted(rows.items())], "key string, p_in double, p_out double, p_cached double, p_write double, p_write_1h double")


def priced(rows: DataFrame, prices: DataFrame, model: str, default: tuple[float, ...] = DEFAULT) -> DataFrame:
    """rows with the prices of the longest key that their model's name contains; a mini
    model takes the key's own mini entry; the default where nothing matches.

    Only the distinct model names meet the price table, by the containment test."""
    names = rows.select(F.col(model).alias("name__")).distinct().where("name__ is not null")
    norm = F.lower(F.regexp_replace(F.trim("name__"), "[._]", "-"))
    table = F.broadcast(prices) if prices.count() <= MOST_ENTRIES else prices
    hits = names.withColumn("norm__", norm).join(table, F.expr("instr(norm__, key) > 0"))
    best = hits.groupBy("name__", "norm__").agg(F.max_by(F.struct(*prices.columns), F.struct(F.length("key"), "key")).alias("best"))
    mini = prices.select(F.col("key").alias("mini__"), F.struct(*prices.columns).alias("small"))
    wants = F.when(F.contains("norm__", F.lit("mini")) & ~F.contains("best.key", F.lit("mini")), F.concat("best.key", F.lit("-mini")))
    chosen = best.withColumn("mini__", wants).join(mini, "mini__", "left").select("name__", F.coalesce("small", "best").alias("p"))
    joined = rows.join(chosen, F.col(model).eqNullSafe(F.col("name__")), "left")
    base = (*default[:3], default[3] if len(default) > 3 else default[0] * 1.25, default[4] if len(default) > 4 else default[0] * 2.0)
    return joined.select(*rows.columns, *[F.coalesce(f"p.{c}", F.lit(d)).alias(c) for c, d in zip(prices.columns[1:], base, strict=True)])


def cost(includes_cache: bool = True):
    """USD from columns input, output, read, write, write_1h and the prices of priced()."""
    c = F.col
    fresh = F.greatest(F.lit(0), c("input") - c("read") - c("write") - c("write_1h")) if includes_cache else c("input")
    return (fresh * c("p_in") + c("read") * c("p_cached") + c("write") * c("p_write") + c("write_1h") * c("p_write_1h") + c("output") * c("p_out")) / 1_000_000


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """session, model (the most used), est_cost_usd: costs by model are summed, then rounded to 4.
    usage: session, model, input (without cache), output, read, write (all), write_1h."""
    split = usage.withColumn("write", F.greatest(F.lit(0), F.col("write") - F.col("write_1h")))
    each = priced(split, prices, "model").withColumn("usd", cost(includes_cache=False))
    return each.groupBy("session").agg(F.max_by("model", F.struct("output", "model")).alias("model"), F.round(F.sum("usd"), 4).alias("est_cost_usd"))
