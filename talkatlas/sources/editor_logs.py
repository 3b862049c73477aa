"""Editor chat logs: snapshots and append-only logs of requests and response parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkatlas.functions import text as X
from talkatlas.sources.canonical import sessions
from talkatlas.sources.readers import _stem, json_lines, repo_of, whole_files

_HEAD = "sessionId string, creationDate double, lastMessageDate double, customTitle string, requesterUsername string, responderUsername string, requests array<string>"


def _part_text(p: Column) -> Column:
    """What a response part says: markdown, a reference's name, a tool's message."""
    get = lambda path: F.get_json_object(p, path)
    kind = get("$.kind")
    value = F.coalesce(get("$.value.value"), get("$.value"))
    tool = F.coalesce(get("$.pastTenseMessage.value"), get("$.pastTenseMessage"), get("$.invocationMessage.value"), get("$.invocationMessage"))
    return (
        F.when(~F.ltrim(p).startswith("{"), p)
        .when(kind.isNull(), F.when(F.trim(value).rlike(r"^`{3,}[\w+-]*$"), F.lit("")).otherwise(value))
        .when(kind == "inlineReference", F.coalesce(get("$.inlineReference.name"), F.regexp_extract(F.coalesce(get("$.inlineReference.path"), get("$.inlineReference.uri.path"), F.lit("")), r"([^/]+)$", 1)))
        .when(kind.startswith("toolInvocation"), F.concat(F.lit("\n\n`▷ "), F.coalesce(get("$.toolId"), F.lit("tool")), F.lit("` "), F.coalesce(tool, F.lit("")), F.lit("\n\n")))
        .otherwise(F.lit(""))
    )


def _part_file(p: Column) -> Column:
    get = lambda path: F.get_json_object(p, path)
    path = F.coalesce(get("$.uri.path"), get("$.inlineReference.path"), get("$.inlineReference.uri.path"))
    return F.when(get("$.kind").isin("codeblockUri", "textEditGroup", "inlineReference"), path)


def requests_of_logs(lines: DataFrame) -> DataFrame:
    """session, rid, place, request (JSON), parts: from lines (session, pos, kind, v as JSON).

    Kind 0 is a snapshot, kind 2 appends requests or response parts for the request in
    flight; the longer of what was emitted and what was streamed counts."""
    head = F.from_json("v", "requests array<string>")["requests"]
    listed = F.when(F.col("kind") == 0, head).when(F.col("kind") == 2, F.from_json("v", "array<string>"))
    rows = lines.where("kind in (0, 2)").withColumn("items", listed).where("size(items) > 0 or kind = 0")
    is_request = lambda x: F.get_json_object(x, "$.requestId").isNotNull() & F.get_json_object(x, "$.message").isNotNull()
    first = F.get("items", 0)
    opens = (F.col("kind") == 2) & is_request(first)
    last_id = F.get_json_object(F.get(F.filter("items", is_request), F.size(F.filter("items", is_request)) - 1), "$.requestId")
    marked = rows.withColumn("flight", F.when(opens, last_id).when(F.col("kind") == 0, F.lit("")))
    current = F.last("flight", ignorenulls=True).over(Window.partitionBy("session").orderBy("pos"))
    marked = marked.withColumn("flight", current).withColumn("streams", (F.col("kind") == 2) & ~F.coalesce(is_request(first), F.lit(False)))
    asked = marked.where("not streams").select("session", "pos", F.posexplode("items").alias("i", "r")).where(is_request(F.col("r")))
    asked = asked.select("session", F.get_json_object("r", "$.requestId").alias("rid"), F.struct("pos", "i").alias("place"), "r", F.from_json(F.coalesce(F.get_json_object("r", "$.response"), F.lit("[]")), "array<string>").alias("response"))
    emitted = asked.groupBy("session", "rid").agg(F.min("place").alias("place"), F.max_by("r", "place").alias("request"), F.max_by("response", F.struct(F.size("response"), "place")).alias("response"))
    streamed = marked.where("streams and flight <> ''").groupBy("session", F.col("flight").alias("rid")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "items"))), lambda x: x["items"])).alias("more"))
    none = F.array().cast("array<string>")
    more = F.coalesce("more", none)
    parts = F.when(F.size("response") > F.size(more), F.col("response")).otherwise(more)
    return emitted.join(streamed, ["session", "rid"], "left").select("session", "rid", "place", "request", parts.alias("parts"))


def editor_logs(spark: SparkSession, path: str, source: str = "editor") -> DataFrame:
    """Sessions of *.jsonl logs and of *.json snapshots (one object with requests)."""
    raw = json_lines(spark, path, "kind int, v string").where("v.kind is not null")
    lines = raw.select(F.concat(F.lit(f"{source}-"), _stem(F.col("path"))).alias("session"), "path", "pos", "sha", "v.kind", "v.v")
    old = whole_files(spark, path, "*.json").select(F.concat(F.lit(f"{source}-"), _stem(F.col("path"))).alias("session"), "path", F.lit(0).cast("long").alias("pos"), "sha", F.lit(0).alias("kind"), F.col("text").alias("v"))
    lines = lines.unionByName(old)
    asked = requests_of_logs(lines)
    get = lambda p: F.get_json_object("request", p)
    parts = F.coalesce("parts", F.array().cast("array<string>"))
    kinds = lambda kind: F.filter(parts, lambda p: F.get_json_object(p, "$.kind").startswith(kind))
    order = F.row_number().over(Window.partitionBy("session").orderBy("place", "rid")) * 2
    stamp = F.date_format(X.epoch_instant(get("$.timestamp").try_cast("double")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    user = F.struct(F.lit(0).alias("i"), F.lit("user").alias("side"), F.trim(F.coalesce(get("$.message.text"), F.lit(""))).alias("text"), none.alias("thinking"), empty.alias("tools"), empty.alias("files"), stamp.alias("ts"))
    reply = F.struct(
        F.lit(1).alias("i"),
        F.lit("reply").alias("side"),
        F.trim(F.array_join(F.transform(parts, lambda p: F.coalesce(_part_text(p), F.lit(""))), "")).alias("text"),
        F.array_join(F.transform(kinds("thinking"), lambda p: F.trim(F.coalesce(F.get_json_object(p, "$.value"), F.get_json_object(p, "$.text"), F.lit("")))), "\n\n").alias("thinking"),
        F.array_compact(F.transform(kinds("toolInvocation"), lambda p: F.get_json_object(p, "$.toolId"))).alias("tools"),
        F.array_compact(F.transform(parts, _part_file)).alias("files"),
        none.alias("ts"),
    )
    messages = asked.withColumn("at", order).select("session", "at", F.explode(F.array(user, reply)).alias("m")).select("session", (F.col("at") + F.col("m.i")).cast("long").alias("pos"), "m.side", "m.text", "m.thinking", "m.tools", "m.files", "m.ts")
    snapshot = lines.where("kind = 0").withColumn("h", F.from_json("v", _HEAD))
    iso = lambda c: F.date_format(X.epoch_instant(c), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    first = snapshot.groupBy("session").agg(F.min_by("h", "pos").alias("h"), F.min("path").alias("source_path"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha")), ""), 256).alias("content_hash"))
    head = first.select("session", "source_path", "content_hash", F.col("h.customTitle").alias("title"), F.col("h.requesterUsername").alias("requester"), F.col("h.responderUsername").alias("responder"), iso(F.col("h.creationDate")).alias("created_at"), iso(F.col("h.lastMessageDate")).alias("updated_at"), F.nullif(F.regexp_extract("source_path", r"/([^/]+)/chatSessions/", 1), F.lit("")).alias("workspace_id"))
    return sessions(messages, head, source)


def workspaces(spark: SparkSession, path: str) -> DataFrame:
    """workspace_id, repo_path, repository from */workspace.json, to be joined to sessions (a small dimension)."""
    files = whole_files(spark, path, "workspace.json")
    uri = F.coalesce(F.get_json_object("text", "$.folder"), F.get_json_object("text", "$.workspace"))
    where = F.url_decode(F.regexp_replace(uri, r"^[a-z][a-z0-9+.-]*://[^/]*", ""))
    where = F.regexp_replace(where, r"/[^/]+\.code-workspace$", "")
    return files.select(F.regexp_extract("path", r"([^/]+)/workspace\.json$", 1).alias("workspace_id"), where.alias("repo_path"), repo_of(F.lit(None).cast("string"), where).alias("repository"))
