"""The canonical session record, and how messages become turns and sessions.

Every reader yields messages: one row for each thing said or done, in order,

    session, pos, side (user or reply), text, thinking, tools, files, ts, fence_side

and shares the assembly below: a user message opens a turn (a running count in a
window), replies join it, and turns are collected into one row a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkatlas.functions import text as X

TURN = T.StructType(
    [
        T.StructField("turn_index", T.IntegerType()),
        T.StructField("user_message", T.StringType()),
        T.StructField("assistant_response", T.StringType()),
        T.StructField("thinking", T.StringType()),
        T.StructField("tools", T.ArrayType(T.StringType())),
        T.StructField("ts", T.StringType()),
        T.StructField("files", T.ArrayType(T.StringType())),
        T.StructField("urls", T.ArrayType(T.StringType())),
        T.StructField("code_blocks", T.ArrayType(T.StructType([T.StructField("language", T.StringType()), T.StructField("content", T.StringType())]))),
    ]
)
MESSAGE = "session string, pos bigint, side string, text string, thinking string, tools array<string>, files array<string>, ts string"


def _joined(rows: Column, separator: str) -> Column:
    """Texts of array<struct<pos, x>> in order, those with something in them."""
    kept = F.filter(F.transform(F.array_sort(rows), lambda r: r["x"]), lambda x: F.trim(x) != "")
    return F.trim(F.array_join(kept, separator))


def turns(messages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """One row for each turn that has a user message or a reply."""
    w = Window.partitionBy("session").orderBy("pos")
    opened = F.sum(F.when(F.col("side") == "user", 1).otherwise(0)).over(w)
    said = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("pos", F.col("text").alias("x"))))
    listed = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size(c) > 0, F.struct("pos", F.col(c).alias("x"))))), lambda r: r["x"])))
    grouped = (
        messages.withColumn("t", opened)
        .groupBy("session", "t")
        .agg(
            _joined(said("user"), "\n\n").alias("user_message"),
            _joined(said("reply"), separator).alias("assistant_response"),
            _joined(F.collect_list(F.struct("pos", F.col("thinking").alias("x"))), "\n\n").alias("thinking"),
            listed("tools").alias("tools"),
            F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("pos"))).alias("ts"),
            listed("files").alias("files"),
        )
        .where("user_message <> '' or assistant_response <> ''")
    )
    both = F.concat_ws(" ", "user_message", "assistant_response")
    numbered = F.row_number().over(Window.partitionBy("session").orderBy("t")) - 1
    strip = lambda c: X.strip_controls(F.col(c)).alias(c)
    return grouped.select(
        "session", numbered.alias("turn_index"), strip("user_message"), strip("assistant_response"), strip("thinking"), "tools", "ts", "files", X.urls(both).alias("urls"), X.code_fences(F.col("assistant_response")).alias("code_blocks")
    )


def estimated(per_turn: DataFrame) -> DataFrame:
    """session, turn_count, duration_seconds, est_in, est_out from the turns alone."""
    stamps = F.array_sort(F.collect_list(F.when(F.col("ts").isNotNull(), F.struct("turn_index", "ts"))))
    per = per_turn.groupBy("session").agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.sum(X.estimate_tokens(F.col("user_message"))).alias("est_in"),
        F.sum(X.estimate_tokens(F.col("assistant_response"))).alias("est_out"),
        stamps.alias("s"),
        F.min_by(X.title_from(F.col("user_message")), F.when(F.trim("user_message") != "", F.col("turn_index"))).alias("derived_title"),
    )
    first, last = X.instant(F.get("s", 0)["ts"]), X.instant(F.get("s", F.size("s") - 1)["ts"])
    seconds = F.when(F.size("s") >= 2, F.greatest(F.lit(0.0), (F.unix_micros(last) - F.unix_micros(first)) / 1e6))
    return per.select("session", "turn_count", "est_in", "est_out", seconds.alias("duration_seconds"), F.get("s", 0)["ts"].alias("first_ts"), F.get("s", F.size("s") - 1)["ts"].alias("last_ts"), F.coalesce("derived_title", F.lit("Untitled session")).alias("derived_title"))


def sessions(messages: DataFrame, head: DataFrame, source: str, separator: str = "\n\n") -> DataFrame:
    """Canonical sessions. head: session and any of title, repository, repo_path, workspace_id,
    requester, responder, created_at, updated_at, source_path, content_hash, model, input_tokens,
    output_tokens, cost; what it lacks or has as null is derived or estimated."""
    per_turn = turns(messages, separator)
    packed = per_turn.groupBy("session").agg(F.array_sort(F.collect_list(F.struct(*[f.name for f in TURN.fields]))).alias("turns"))
    joined = packed.join(estimated(per_turn), "session").join(head, "session", "left")
    have = set(head.columns)
    col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    real = F.coalesce(col("input_tokens", "long"), F.lit(0)) + F.coalesce(col("output_tokens", "long"), F.lit(0)) > 0
    return joined.select(
        F.col("session").alias("id"),
        F.lit(source).alias("source") if "source" not in have else F.col("source"),
        F.lit(source).alias("source_adapter"),
        F.substring(F.coalesce(F.nullif(F.trim(col("title")), F.lit("")), "derived_title"), 1, 200).alias("title"),
        col("workspace_id").alias("workspace_id"),
        col("repository").alias("repository"),
        col("repo_path").alias("repo_path"),
        col("requester").alias("requester"),
        col("responder").alias("responder"),
        F.coalesce(col("created_at"), "first_ts").alias("created_at"),
        F.coalesce(col("updated_at"), "last_ts", col("created_at")).alias("updated_at"),
        "turn_count",
        F.coalesce(col("duration", "double"), "duration_seconds").alias("duration_seconds"),
        col("model").alias("model"),
        F.when(real, F.coalesce(col("input_tokens", "long"), F.lit(0))).otherwise(F.col("est_in")).alias("input_tokens"),
        F.when(real, F.coalesce(col("output_tokens", "long"), F.lit(0))).otherwise(F.col("est_out")).alias("output_tokens"),
        col("premium_requests", "long").alias("premium_requests"),
        col("aiu", "double").alias("aiu"),
        F.when(real, col("cost", "double")).alias("est_cost_usd"),
        F.when(real, 0).otherwise(1).alias("tokens_estimated"),
        col("source_path").alias("source_path"),
        col("content_hash").alias("content_hash"),
        F.lit(False).alias("hidden"),
        "turns",
    )


def chunks(records: DataFrame) -> DataFrame:
    """session, turn_index, part, content: the indexed windows of user and reply texts (thinking is never indexed)."""
    each = records.select(F.col("id").alias("session"), F.explode("turns").alias("t"))
    text = F.concat_ws("\n\n", F.nullif(F.col("t.user_message"), F.lit("")), F.nullif(F.col("t.assistant_response"), F.lit("")))
    return each.select("session", "t.turn_index", F.posexplode(X.chunk_windows(text)).alias("part", "content"))
