"""Readers of conversation logs: each turns files into canonical sessions.

JSON is read by schema and leniently: lines that are no objects are skipped, absent
keys are null. A line's place is its file block and its order in it, so files are
split over tasks; whole-file formats are read as single values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from talkatlas.functions import text as X
from talkatlas.sources.canonical import sessions

# Argument names that hold a written path, and tools that write.
FILE_ARGS = ("file_path", "filePath", "path", "notebook_path", "target_file")
WRITE_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit", "create", "edit", "str_replace_editor", "write_file", "edit_file")


def json_lines(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl") -> DataFrame:
    """path, pos, sha (of the line) and v (the object) of every line that holds an object."""
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id() % F.lit(1 << 33)).alias("pos"), "value"
    ).where(F.trim("value").startswith("{"))
    return lines.select("path", "pos", F.sha2("value", 256).alias("sha"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("v")).where("v is not null")


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, length, modified, sha and text of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha"), F.col("content").cast("string").alias("text"))


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def repo_of(repository: Column, cwd: Column) -> Column:
    """The repository's last part, else the working directory's."""
    last = lambda c: F.nullif(F.element_at(F.split(F.rtrim(F.regexp_replace(c, "/+$", "")), "/"), -1), F.lit(""))
    return F.coalesce(last(F.nullif(repository, F.lit(""))), last(F.nullif(cwd, F.lit(""))))


def trace(name: Column, label: Column) -> Column:
    """One line for a tool call; a label of several lines is fenced."""
    head = F.concat(F.lit("`▷ "), F.coalesce(name, F.lit("tool")), F.lit("`"))
    fence = F.lit("```")
    return F.when(F.coalesce(label, F.lit("")) == "", head).when(label.contains("\n"), F.concat(head, F.lit("\n"), fence, F.lit("\n"), label, F.lit("\n"), fence)).otherwise(F.concat(head, F.lit(" "), label))


def _label(args: Column) -> Column:
    """The most telling argument of a tool call, from its JSON."""
    keys = (*FILE_ARGS[:2], "command", "cmd", "query", "pattern", "url", "description", "prompt", "path")
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(args, f"$.{k}")), F.lit("")) for k in keys])


def _file(name: Column, args: Column) -> Column:
    return F.when(name.isin(*WRITE_TOOLS), F.coalesce(*[F.nullif(F.trim(F.get_json_object(args, f"$.{k}")), F.lit("")) for k in FILE_ARGS]))


# --- block transcripts: JSON lines of user and assistant messages with content blocks -----

_BLOCK = "struct<type:string,text:string,thinking:string,name:string,input:string,content:string>"
_TRANSCRIPT = "type string, timestamp string, cwd string, sessionId string, summary string, isMeta boolean, isSidechain boolean, message struct<role:string,model:string,content:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,cache_creation:struct<ephemeral_1h_input_tokens:bigint>>>"


def _blocks(content: Column) -> Column:
    """Content blocks; plain text is one text block."""
    plain = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))), _BLOCK))
    return F.when(F.ltrim(content).startswith("["), F.from_json(content, f"array<{_BLOCK}>")).otherwise(plain)


def _block_text(b: Column) -> Column:
    result = F.trim(F.regexp_replace(F.regexp_replace(b["content"], r'[\[\]{}"]|"?type"?:"?text"?,?|"?text"?:', " "), r"\s+", " "))
    return (
        F.when(b["type"] == "text", F.coalesce(b["text"], F.lit("")))
        .when(b["type"] == "tool_use", F.concat(F.lit("\n\n"), trace(b["name"], _label(b["input"])), F.lit("\n\n")))
        .when((b["type"] == "tool_result") & (F.coalesce(result, F.lit("")) != ""), F.concat(F.lit("  ⮑ "), F.substring(result, 1, 100), F.lit("\n")))
        .when(b["type"] == "image", F.lit("[image]"))
        .otherwise(F.lit(""))
    )


def _block_messages(rows: DataFrame) -> DataFrame:
    """Messages from rows (session, pos, role, content, ts). User rows without text are tool results: replies."""
    rows = rows.withColumn("b", F.explode(F.array(_blocks(F.col("content")))))
    real = F.exists("b", lambda b: (b["type"] == "text") & (F.trim(F.coalesce(b["text"], F.lit(""))) != ""))
    text = F.array_join(F.transform("b", _block_text), "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<(system-reminder|environment_details)>.*?</\1>", " "), r"</?(?:task|user_message|feedback|answer|user_query)>", ""))
    uses = F.filter("b", lambda b: b["type"] == "tool_use")
    return rows.select(
        "session",
        "pos",
        F.when((F.col("role") == "user") & real, "user").otherwise("reply").alias("side"),
        F.when((F.col("role") == "user") & real, clean).otherwise(text).alias("text"),
        F.array_join(F.transform(F.filter("b", lambda b: b["type"] == "thinking"), lambda b: F.coalesce(b["thinking"], F.lit(""))), "\n\n").alias("thinking"),
        F.array_compact(F.transform(uses, lambda b: b["name"])).alias("tools"),
        F.array_compact(F.transform(uses, lambda b: _file(b["name"], b["input"]))).alias("files"),
        "ts",
    )


def transcripts(spark: SparkSession, path: str, source: str = "agent") -> DataFrame:
    """Agent transcripts, one file a session. Side chains are no turns, but their usage counts."""
    lines = json_lines(spark, path, _TRANSCRIPT).withColumn("session", F.concat(F.lit(f"{source}-"), _stem(F.col("path"))))
    said = lines.where("v.type in ('user', 'assistant') and v.message is not null and not coalesce(v.isSidechain, false) and not (v.type = 'user' and coalesce(v.isMeta, false))")
    messages = _block_messages(said.select("session", "pos", F.col("v.type").alias("role"), F.col("v.message.content").alias("content"), F.col("v.timestamp").alias("ts")))
    usage = lines.where("v.type = 'assistant' and v.message is not null").select(
        "session",
        "pos",
        F.when((F.col("v.message.model") != "") & (F.col("v.message.model") != "<synthetic>"), F.col("v.message.model")).alias("model"),
        *[F.coalesce(F.col(f"v.message.usage.{c}"), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")],
        F.coalesce("v.message.usage.cache_creation.ephemeral_1h_input_tokens", F.lit(0)).alias("write_1h"),
    )
    spent = usage.groupBy("session").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    models = usage.where("model is not null").groupBy("session", "model").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("p")).groupBy("session").agg(F.max_by("model", F.struct("c", -F.col("p"))).alias("model"))
    instant = X.instant(F.col("v.timestamp"))
    head = lines.groupBy("session").agg(
        F.max_by(F.nullif(F.trim("v.summary"), F.lit("")), F.when(F.trim("v.summary") != "", F.col("pos"))).alias("title"),
        F.min_by("v.cwd", F.when(F.trim("v.cwd") != "", F.col("pos"))).alias("repo_path"),
        F.min_by("v.timestamp", instant).alias("created_at"),
        F.max_by("v.timestamp", instant).alias("updated_at"),
        F.min("path").alias("source_path"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sha"))), lambda r: r["sha"]), ""), 256).alias("content_hash"),
    )
    head = head.join(spent, "session", "left").join(models, "session", "left").withColumn("repository", repo_of(F.lit(None).cast("string"), F.col("repo_path")))
    return sessions(messages, head, source, "\n")


def transcript_usage(spark: SparkSession, path: str, source: str = "agent") -> DataFrame:
    """session, model and token sums (input, output, cache read, cache write, of it one-hour), for cost by model."""
    lines = json_lines(spark, path, _TRANSCRIPT).where("v.type = 'assistant'").withColumn("session", F.concat(F.lit(f"{source}-"), _stem(F.col("path"))))
    u = "v.message.usage."
    sums = {"input_tokens": "input", "output_tokens": "output", "cache_read_input_tokens": "read", "cache_creation_input_tokens": "write", "cache_creation.ephemeral_1h_input_tokens": "write_1h"}
    return lines.groupBy("session", F.col("v.message.model").alias("model")).agg(*[F.sum(F.coalesce(F.col(u + k), F.lit(0))).alias(v) for k, v in sums.items()])


# --- agent event logs: JSON lines {type, timestamp, data} ------------------------------

_EVENT = "type string, timestamp string, data string"


def _events(spark: SparkSession, path: str, source: str) -> DataFrame:
    lines = json_lines(spark, path, _EVENT).withColumn("session", F.concat(F.lit(f"{source}-"), _parent(F.col("path"))))
    return lines.select("session", "path", "pos", "sha", "v.type", "v.timestamp", F.col("v.data").alias("data"))


def event_writes(events: DataFrame) -> DataFrame:
    """session, call_id, pos, path of calls that wrote one path, started once and ended once, in that order, with success."""
    d = lambda k: F.get_json_object("data", f"$.{k}")
    calls = events.where("type in ('tool.execution_start', 'tool.execution_complete')").select(
        "session", "pos", d("toolCallId").alias("call_id"), (F.col("type") == "tool.execution_start").alias("start"), _file(d("toolName"), d("arguments")).alias("path"), (d("success") == "true").alias("ok")
    )
    per = calls.where("trim(call_id) <> ''").groupBy("session", "call_id").agg(
        F.count_if("start").alias("starts"), F.count("path").alias("paths"), F.count_if(~F.col("start")).alias("ends"), F.max(F.when(~F.col("start"), F.coalesce("ok", F.lit(False)))).alias("ok"),
        F.min(F.when(F.col("start"), F.col("pos"))).alias("a"), F.min(F.when(~F.col("start"), F.col("pos"))).alias("b"), F.max("path").alias("path"),
    )
    return per.where("starts = 1 and paths = 1 and ends = 1 and ok and a < b").select("session", "call_id", F.col("a").alias("pos"), "path")


def event_logs(spark: SparkSession, path: str, source: str = "cli") -> DataFrame:
    """Agent event logs, one folder a session, with metrics of the last shutdown."""
    events = _events(spark, path, source)
    d = lambda k: F.get_json_object("data", f"$.{k}")
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    requested = F.transform(F.from_json(d("toolRequests"), "array<struct<name:string>>"), lambda r: r["name"])
    kinds = "type in ('user.message', 'assistant.message', 'tool.execution_start') and not (type = 'user.message' and coalesce(trim(get_json_object(data, '$.content')), '') = '')"
    t = F.col("type")
    said = events.where(kinds).select(
        "session",
        "pos",
        F.when(t == "user.message", "user").otherwise("reply").alias("side"),
        F.when(t == "tool.execution_start", trace(d("toolName"), _label(d("arguments")))).otherwise(F.coalesce(F.trim(d("content")), F.lit(""))).alias("text"),
        F.when(t == "assistant.message", F.trim(d("reasoningText"))).otherwise(none).alias("thinking"),
        F.when(t == "tool.execution_start", F.array_compact(F.array(d("toolName")))).when(t == "assistant.message", F.array_compact(F.coalesce(requested, empty))).otherwise(empty).alias("tools"),
        F.col("timestamp").alias("ts"),
    )
    writes = event_writes(events).select("session", "pos", F.array("path").alias("files"))
    messages = said.join(writes, ["session", "pos"], "left").withColumn("files", F.coalesce("files", empty))
    last = F.max_by("data", F.when(t == "session.shutdown", F.col("pos")))
    model_of = F.coalesce(d("selectedModel"), d("newModel"))
    head = events.groupBy("session").agg(
        F.min("path").alias("source_path"),
        F.min_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("pos"))).alias("created_at"),
        F.max_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("pos"))).alias("updated_at"),
        last.alias("end"),
        F.max_by(model_of, F.when(t.isin("session.start", "session.model_change") & model_of.isNotNull(), F.col("pos"))).alias("chosen"),
        F.mode(F.when(t == "assistant.message", d("model"))).alias("said_model"),
        F.sum(F.when(t == "assistant.message", F.coalesce(d("outputTokens").try_cast("long"), F.lit(0))).otherwise(0)).alias("said_out"),
    )
    e = lambda k: F.get_json_object("end", f"$.{k}")
    metrics = F.from_json(e("modelMetrics"), "map<string, struct<usage: struct<inputTokens: bigint, outputTokens: bigint, cacheReadTokens: bigint, cacheWriteTokens: bigint>>>")
    total = lambda k: F.coalesce(F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["usage"][k], F.lit(0))), F.lit(0))
    head = head.withColumn("m", metrics)
    out = total("outputTokens")
    head = head.select(
        "session", "source_path", "created_at", "updated_at",
        F.coalesce(e("currentModel"), "chosen", F.get(F.map_keys("m"), 0), "said_model").alias("model"),
        total("inputTokens").alias("input_tokens"), F.when(out == 0, F.col("said_out")).otherwise(out).alias("output_tokens"), total("cacheReadTokens").alias("cache_read"), total("cacheWriteTokens").alias("cache_write"),
        e("totalPremiumRequests").try_cast("long").alias("premium_requests"), F.round(e("totalNanoAiu").try_cast("double") / 1e9, 3).alias("aiu"),
        F.greatest(F.lit(0.0), (F.unix_micros(X.instant(F.col("updated_at"))) - F.unix_micros(X.instant(F.col("created_at")))) / 1e6).alias("duration"),
    )
    return sessions(messages, head, source)


# --- chat exports -----------------------------------------------------------------------

_NODE = "struct<parent:string,message:struct<author:struct<role:string>,create_time:double,content:struct<content_type:string,parts:string,text:string>,metadata:struct<is_visually_hidden_from_conversation:boolean>>>"
_EXPORT = f"array<struct<title:string,conversation_id:string,id:string,create_time:double,update_time:double,current_node:string,mapping:map<string,{_NODE}>>>"


def tree_exports(spark: SparkSession, path: str, source: str = "chat-export", glob: str = "*.json") -> DataFrame:
    """Chat exports as trees of messages: the active branch is walked from its last node to the root."""
    files = whole_files(spark, path, glob)
    listed = F.when(F.ltrim("text").startswith("["), F.col("text")).otherwise(F.coalesce(F.get_json_object("text", "$.conversations"), F.concat(F.lit("["), F.col("text"), F.lit("]"))))
    each = files.select("path", F.explode(F.from_json(listed, _EXPORT)).alias("c")).where("c.mapping is not null and size(c.mapping) > 0")
    each = each.withColumn("session", F.concat(F.lit(f"{source}-"), F.coalesce("c.conversation_id", "c.id", F.substring(F.sha2(F.to_json("c"), 256), 1, 16))))
    # the chain, newest first: one step a node at most, so a cycle ends
    step = lambda chain, _: F.when(
        F.get(chain, F.size(chain) - 1).isNotNull() & ~F.array_contains(chain, F.coalesce(F.try_element_at("c.mapping", F.get(chain, F.size(chain) - 1))["parent"], F.lit(""))) & F.array_contains(F.map_keys("c.mapping"), F.coalesce(F.try_element_at("c.mapping", F.get(chain, F.size(chain) - 1))["parent"], F.lit(""))),
        F.concat(chain, F.array(F.try_element_at("c.mapping", F.get(chain, F.size(chain) - 1))["parent"])),
    ).otherwise(chain)
    known = F.array_contains(F.map_keys("c.mapping"), F.coalesce("c.current_node", F.lit("")))
    walked = F.reverse(F.aggregate(F.sequence(F.lit(1), F.size("c.mapping")), F.array("c.current_node"), step))
    chain = F.when(known, walked).otherwise(F.map_keys("c.mapping"))
    nodes = each.select("session", F.posexplode(chain).alias("pos", "node"), "c.mapping").withColumn("m", F.try_element_at("mapping", F.col("node"))["message"])
    kind = F.col("m.content.content_type")
    parts = F.from_json("m.content.parts", "array<string>")
    inner = lambda p: F.when(F.ltrim(p).startswith("{"), F.get_json_object(p, "$.text")).otherwise(p)
    text = F.when(kind == "text", F.array_join(F.filter(parts, lambda p: ~F.ltrim(p).startswith("{")), "\n")).when(kind.isin("code", "execution_output"), F.col("m.content.text")).when(kind == "multimodal_text", F.array_join(F.array_compact(F.transform(parts, inner)), "\n")).otherwise("")
    said = nodes.where("m.author.role in ('user', 'assistant') and not coalesce(m.metadata.is_visually_hidden_from_conversation, false)")
    empty = F.array().cast("array<string>")
    iso = lambda c: F.date_format(X.epoch_instant(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    messages = said.select("session", F.col("pos").cast("long").alias("pos"), F.when(F.col("m.author.role") == "user", "user").otherwise("reply").alias("side"), F.trim(text).alias("text"), F.lit(None).cast("string").alias("thinking"), empty.alias("tools"), empty.alias("files"), iso(F.col("m.create_time")).alias("ts")).where("text <> ''")
    head = each.select("session", "c.title", iso(F.col("c.create_time")).alias("created_at"), iso(F.col("c.update_time")).alias("updated_at"), F.sha2(F.to_json("c"), 256).alias("content_hash"), F.lit("assistant").alias("responder"))
    return sessions(messages, head, source)


_FLAT = "platform string, exportDate string, url string, conversation array<struct<speaker:string,content:string,mode:string,timestamp:string>>"


def flat_exports(spark: SparkSession, path: str, platform: str, source: str = "flat-export", glob: str = "*.json") -> DataFrame:
    """Chat exports as one list of {speaker, content, mode, timestamp}; unknown speakers are skipped, modes go to thinking."""
    files = whole_files(spark, path, glob).withColumn("v", F.from_json("text", _FLAT))
    files = files.where((F.lower(F.trim("v.platform")) == platform) & (F.size("v.conversation") > 0)).withColumn("session", F.concat(F.lit(f"{source}-"), F.substring("sha", 1, 16)))
    rows = files.select("session", F.posexplode("v.conversation").alias("pos", "m"))
    who = F.lower(F.trim("m.speaker"))
    side = F.when(who.isin("human", "user", "you"), "user").when(who.isin("assistant", "ai", "bot", platform), "reply")
    mode = F.trim("m.mode")
    stamp = F.coalesce(F.date_format(X.epoch_instant(F.col("m.timestamp").try_cast("double")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), F.date_format(X.instant(F.col("m.timestamp")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    empty = F.array().cast("array<string>")
    messages = rows.select("session", F.col("pos").cast("long").alias("pos"), side.alias("side"), F.trim("m.content").alias("text"), F.when((mode != "") & (mode != "standard"), F.concat(F.lit("mode: "), mode)).alias("thinking"), empty.alias("tools"), empty.alias("files"), stamp.alias("ts")).where("side is not null and text <> ''")
    head = files.select("session", F.col("v.exportDate").alias("updated_at"), F.col("v.url").alias("source_path"), F.col("sha").alias("content_hash"))
    return sessions(messages, head, source)


# --- task folders and notes --------------------------------------------------------------


def task_folders(spark: SparkSession, path: str, source: str = "tasks") -> DataFrame:
    """Folders with api_conversation_history.json, and optional history_item.json and ui_messages.json for tokens."""
    files = whole_files(spark, path, "*.json").withColumn("session", F.concat(F.lit(f"{source}-"), _parent(F.col("path")))).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    api = files.where("name = 'api_conversation_history.json'")
    rows = api.select("session", F.posexplode(F.from_json("text", "array<struct<role:string,content:string,ts:double>>")).alias("pos", "m")).where("m.role in ('user', 'assistant')")
    iso = lambda c: F.date_format(X.epoch_instant(c), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    messages = _block_messages(rows.select("session", F.col("pos").cast("long").alias("pos"), "m.role", "m.content", iso(F.col("m.ts")).alias("ts")))
    item = files.where("name = 'history_item.json'").select("session", F.from_json("text", "task string, workspace string, tokensIn double, tokensOut double, totalCost double, apiConfigName string").alias("h"))
    ui = files.where("name = 'ui_messages.json'").select("session", F.explode(F.from_json("text", "array<struct<say:string,text:string>>")).alias("u")).where("u.say = 'api_req_started'")
    number = lambda k: F.coalesce(F.get_json_object("u.text", f"$.{k}").try_cast("double"), F.lit(0.0))
    spent = ui.groupBy("session").agg(*[F.sum(number(k)).alias(a) for k, a in (("tokensIn", "ui_in"), ("tokensOut", "ui_out"), ("cost", "ui_cost"))])
    head = api.select("session", F.col("path").alias("source_path"), F.col("sha").alias("content_hash")).join(item, "session", "left").join(spent, "session", "left")
    known = F.coalesce(F.col("h.tokensIn"), F.lit(0.0)) + F.coalesce(F.col("h.tokensOut"), F.lit(0.0)) > 0
    pick = lambda a, b: F.when(known, F.col(a)).otherwise(F.col(b)).cast("long")
    config = F.trim("h.apiConfigName")
    return sessions(
        messages,
        head.select(
            "session", "source_path", "content_hash", F.get(F.split("h.task", "\n"), 0).alias("title"), F.col("h.workspace").alias("repo_path"), repo_of(F.lit(None).cast("string"), F.col("h.workspace")).alias("repository"),
            pick("h.tokensIn", "ui_in").alias("input_tokens"), pick("h.tokensOut", "ui_out").alias("output_tokens"), F.when(known, F.col("h.totalCost")).otherwise(F.col("ui_cost")).alias("cost"), F.when((config != "") & (F.lower(config) != "default"), config).alias("model"),
        ),
        source,
        "\n",
    )


def notes(spark: SparkSession, path: str, source: str = "notes", glob: str = "*.md") -> DataFrame:
    """Markdown notes; the folder they lie in is their scope (repo, a session's base64 name, or user)."""
    files = whole_files(spark, path, glob).where("length > 0")
    inside = F.regexp_extract("path", r"/memories/(.+)$", 1)
    folder = F.regexp_extract(inside, r"^([^/]+)/", 1)
    scope = F.when(folder == "", "user").when(folder == "repo", "repo").otherwise("session")
    owner = F.when(scope == "session", F.try_to_binary(folder, F.lit("base64")).cast("string"))
    heading = X.title_from(F.col("text"))
    iso = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return files.select(F.concat(F.lit(f"{source}-"), F.substring("sha", 1, 16)).alias("id"), scope.alias("scope"), owner.alias("owner_session"), F.coalesce(heading, _stem(F.col("path"))).alias("title"), "text", iso.alias("updated_at"), F.col("path").alias("source_path"), F.col("sha").alias("content_hash"))


# --- SQLite stores ------------------------------------------------------------------------


class SqliteSource(DataSource):
    """Tables of SQLite files: format("talkatlas_sqlite"), options path (files, comma-separated) and query.
    One partition a file; the file is copied (with its log) before it is read, so that a
    live store is never locked. Files must be visible to the executors."""

    @classmethod
    def name(cls) -> str:
        return "talkatlas_sqlite"

    def schema(self) -> str:
        return self.options.get("schema", "path string, row string")

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _SqliteReader(dict(self.options), [f.name for f in schema.fields])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.options, self.columns = options, columns

    def partitions(self):  # noqa: ANN201
        return [_File(p.strip()) for p in self.options["path"].split(",") if p.strip()]

    def read(self, partition):  # noqa: ANN001, ANN201
        import contextlib
        import json
        import shutil
        import sqlite3
        import tempfile
        from pathlib import Path

        with tempfile.TemporaryDirectory() as d:
            copy = Path(d, "store.db")
            shutil.copyfile(partition.path, copy)
            for tail in ("-wal", "-shm"):
                if Path(partition.path + tail).exists():
                    shutil.copyfile(partition.path + tail, f"{copy}{tail}")
            with contextlib.closing(sqlite3.connect(copy)) as con:
                cursor = con.execute(self.options["query"])
                names = [c[0] for c in cursor.description]
                for row in cursor:
                    yield (partition.path, json.dumps(dict(zip(names, row, strict=True)), default=str))


def sqlite_rows(spark: SparkSession, paths: list[str], query: str, schema: str) -> DataFrame:
    """path and the query's columns over all files."""
    spark.dataSource.register(SqliteSource)
    raw = spark.read.format("talkatlas_sqlite").option("path", ",".join(paths)).option("query", query).load()
    return raw.select("path", F.from_json("row", schema).alias("r")).select("path", "r.*")


def store_sessions(spark: SparkSession, paths: list[str], source: str = "store") -> DataFrame:
    """Agent stores with tables sessions and turns (user_message, assistant_response)."""
    heads = sqlite_rows(spark, paths, "SELECT * FROM sessions", "id string, cwd string, repository string, summary string, created_at string, updated_at string")
    rows = sqlite_rows(spark, paths, "SELECT * FROM turns", "session_id string, turn_index bigint, user_message string, assistant_response string, timestamp string")
    empty = F.array().cast("array<string>")
    side = lambda i, name, column: F.struct(F.lit(i).alias("i"), F.lit(name).alias("side"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    each = rows.select(F.concat(F.lit(f"{source}-"), "session_id").alias("session"), "turn_index", "timestamp", F.explode(F.array(side(0, "user", "user_message"), side(1, "reply", "assistant_response"))).alias("m"))
    messages = each.select("session", (F.col("turn_index") * 2 + F.col("m.i")).alias("pos"), "m.side", "m.text", F.lit(None).cast("string").alias("thinking"), empty.alias("tools"), empty.alias("files"), F.col("timestamp").alias("ts"))
    head = heads.select(F.concat(F.lit(f"{source}-"), "id").alias("session"), F.col("summary").alias("title"), repo_of(F.col("repository"), F.col("cwd")).alias("repository"), F.col("cwd").alias("repo_path"), "created_at", "updated_at", F.col("path").alias("source_path"))
    return sessions(messages, head, source)


_COMPOSER = "composerId string, name string, createdAt double, lastUpdatedAt double, modelConfig struct<modelName:string>, fullConversationHeadersOnly array<struct<bubbleId:string,type:int>>"
_BUBBLE = "type int, text string, isRefunded boolean, thinking struct<text:string>, tokenCount struct<inputTokens:bigint,outputTokens:bigint>, toolFormerData struct<name:string,rawArgs:string,result:string>"


def composer_sessions(spark: SparkSession, paths: list[str], source: str = "composer") -> DataFrame:
    """Key-value stores of composers and their bubbles: headers are exploded and joined on the bubble's key."""
    pairs = sqlite_rows(spark, paths, "SELECT key, value FROM cursorDiskKV WHERE key LIKE 'composerData:%' OR key LIKE 'bubbleId:%'", "key string, value string")
    composers = pairs.where("key like 'composerData:%'").select(F.substring("key", 14, 1 << 20).alias("cid"), F.from_json("value", _COMPOSER).alias("c")).where("c is not null")
    order = composers.select("cid", F.posexplode("c.fullConversationHeadersOnly").alias("pos", "h")).select("cid", "pos", F.concat(F.lit("bubbleId:"), "cid", F.lit(":"), "h.bubbleId").alias("key"))
    bubbles = order.join(pairs.select("key", F.from_json("value", _BUBBLE).alias("b")), "key").where("b is not null")
    session = F.concat(F.lit(f"{source}-"), "cid")
    tool, args = F.col("b.toolFormerData.name"), F.col("b.toolFormerData.rawArgs")
    result = F.trim(F.regexp_replace("b.toolFormerData.result", r"\s+", " "))
    line = F.concat(trace(tool, _label(args)), F.when(F.coalesce(result, F.lit("")) != "", F.concat(F.lit("\n\n  ⮑ "), F.substring(result, 1, 100))).otherwise(""))
    empty = F.array().cast("array<string>")
    user = F.col("b.type") == 1
    said = F.concat_ws("\n\n", F.nullif(F.trim("b.text"), F.lit("")), F.when(tool != "", line))
    path = F.coalesce(*[F.nullif(F.trim(F.get_json_object(args, f"$.{k}")), F.lit("")) for k in FILE_ARGS])
    messages = bubbles.where("not (b.type = 1 and coalesce(trim(b.text), '') = '')").select(
        session.alias("session"), F.col("pos").cast("long").alias("pos"), F.when(user, "user").otherwise("reply").alias("side"), F.when(user, F.trim("b.text")).otherwise(said).alias("text"), F.trim("b.thinking.text").alias("thinking"),
        F.when(~user, F.array_compact(F.array(tool))).otherwise(empty).alias("tools"), F.when(~user, F.array_compact(F.array(path))).otherwise(empty).alias("files"), F.lit(None).cast("string").alias("ts"),
    )
    good = ~F.coalesce(F.col("b.isRefunded"), F.lit(False))
    n_in, n_out = F.coalesce("b.tokenCount.inputTokens", F.lit(0)), F.coalesce("b.tokenCount.outputTokens", F.lit(0))
    spent = bubbles.where(good).groupBy("cid").agg(F.sum(n_in).alias("input_tokens"), F.sum(n_out).alias("output_tokens"), F.max(n_in).alias("peak"), F.nullif(F.count_if(n_out > 0), F.lit(0)).alias("premium_requests"))
    iso = lambda c: F.date_format(X.epoch_instant(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    name = F.trim("c.modelConfig.modelName")
    head = composers.join(spent, "cid", "left").select(session.alias("session"), F.col("c.name").alias("title"), iso("c.createdAt").alias("created_at"), iso("c.lastUpdatedAt").alias("updated_at"), F.when((name != "") & (F.lower(name) != "default"), name).alias("model"), "input_tokens", "output_tokens", "premium_requests")
    return sessions(messages, head, source)


#: name -> reader(spark, path or paths, ...): the registry of adapters.
READERS: dict[str, Callable[..., DataFrame]] = {
    "transcripts": transcripts,
    "event_logs": event_logs,
    "tree_exports": tree_exports,
    "flat_exports": flat_exports,
    "task_folders": task_folders,
    "notes": notes,
    "store_sessions": store_sessions,
    "composer_sessions": composer_sessions,
}
