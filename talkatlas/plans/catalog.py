"""The query catalogue: every operator bound to the driver's tables, with its SQL.

Roles: documents are sessions (source: repository facet, lang: source facet, labels: tags
quality and toxic), conversations are raw turns, embeddings chunk vectors (label:
session), events the usage log (user_id: session, event_type: model, value: cost),
benchmark holds query texts, pages hold links, the star schema gives further facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkatlas.functions import text as X
from talkatlas.operators import analytics as A
from talkatlas.operators import index as I
from talkatlas.operators import lifecycle as L
from talkatlas.operators import ranking as R
from talkatlas.operators import scope as S
from talkatlas.plans import ask as Q
from talkatlas.plans import collections as C
from talkatlas.session import table
from talkatlas.streaming import sync as Y

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_TAGS = "(SELECT doc_id AS session_id, 'quality' AS tag FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"
_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as a query, with its DuckDB SQL."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _tags(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "labels")
    each = F.array(F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic")))
    return labels.select(F.col("doc_id").alias("session_id"), F.explode(F.array_compact(each)).alias("tag"))


# --- facets and overview -------------------------------------------------------------


@query("facets_source", "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def _(s, d):
    return A.facet(table(s, d, "documents"), "source")


@query("facets_lang", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def _(s, d):
    return A.facet(table(s, d, "documents"), "lang")


@query("facet_top_tags", f"SELECT tag, count(*) AS n FROM {_TAGS} t JOIN documents d ON d.doc_id = t.session_id GROUP BY tag ORDER BY n DESC, tag LIMIT 40")
def _(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("session_id"))
    return A.facet(_tags(s, d).join(docs, "session_id", "left_semi"), "tag", 40)


@query(
    "overview_stats",
    f"""SELECT (SELECT count(*) FROM documents) AS sessions, (SELECT count(DISTINCT source) FROM documents) AS repositories,
    (SELECT count(DISTINCT tag) FROM {_TAGS}) AS tags, (SELECT CAST(coalesce(sum(n_chars), 0) AS BIGINT) FROM documents) AS chars,
    (SELECT count(*) FROM conversations) AS turns, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations""",
)
def _(s, d):
    docs = table(s, d, "documents").agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("source").alias("repositories"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
    turns = table(s, d, "conversations").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"))
    tags = _tags(s, d).agg(F.count_distinct("tag").alias("tags"))
    key = F.lit(1).alias("one__")  # three single rows
    return docs.withColumn("one__", key).join(turns.withColumn("one__", key), "one__").join(tags.withColumn("one__", key), "one__").drop("one__")


# --- usage ---------------------------------------------------------------------------


@query("usage_totals", "SELECT count(*) AS n_events, count(DISTINCT user_id) AS sessions, round(sum(value), 2) AS cost, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events")
def _(s, d):
    return table(s, d, "events").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("sessions"), F.round(F.sum("value"), 2).alias("cost"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"))


@query("usage_by_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_events, count(DISTINCT user_id) AS sessions, round(sum(value), 2) AS cost FROM events GROUP BY 1")
def _(s, d):
    return A.usage_by(table(s, d, "events"), [F.date_format("ts", "yyyy-MM-dd").alias("day")])


@query("usage_by_type", "SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS sessions, round(sum(value), 2) AS cost FROM events GROUP BY event_type ORDER BY cost DESC, sessions DESC, event_type LIMIT 12")
def _(s, d):
    return A.usage_by(table(s, d, "events"), ["event_type"]).orderBy(F.desc("cost"), F.desc("sessions"), "event_type").limit(12)


@query("usage_by_user_top12", "SELECT user_id, count(*) AS n_events, round(sum(value), 2) AS cost FROM events GROUP BY user_id ORDER BY n_events DESC, user_id LIMIT 12")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 2).alias("cost")).orderBy(F.desc("n_events"), "user_id").limit(12)


@query(
    "usage_null_bucket",
    """SELECT coalesce(nullif(raw, ''), '(unknown)') AS model, n FROM (SELECT raw, count(*) AS n FROM
    (SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '' ELSE event_type END AS raw FROM events) GROUP BY raw)""",
)
def _(s, d):
    raw = table(s, d, "events").select(F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 7 == 1, "").otherwise(F.col("event_type")).alias("raw"))
    return raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select(A.labelled(F.col("raw")).alias("model"), "n")


_DAILY = "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS cost FROM events GROUP BY 1"


@query(
    "usage_gapfill_day",
    f"""WITH daily AS ({_DAILY}), span AS (SELECT min(day) AS a, max(day) AS b FROM daily),
    days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span)
    SELECT strftime(days.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n, coalesce(cost, 0) AS cost FROM days LEFT JOIN daily ON days.day = daily.day""",
)
def _(s, d):
    daily = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("cost"))
    return A.gap_filled(daily, "day", ["n", "cost"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


for _unit in ("week", "month"):

    @query(f"usage_by_{_unit}", f"SELECT strftime(date_trunc('{_unit}', ts), '%Y-%m-%d') AS start, count(*) AS n_events, count(DISTINCT user_id) AS sessions, round(sum(value), 2) AS cost FROM events GROUP BY 1")
    def _(s, d, unit=_unit):
        return A.usage_by(table(s, d, "events"), [F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM-dd").alias("start")])


@query("busiest_weekday", "SELECT CAST(isodow(ts) AS INTEGER) AS weekday, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, weekday LIMIT 1")
def _(s, d):
    return table(s, d, "events").groupBy((F.weekday("ts") + 1).alias("weekday")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "weekday").limit(1)


@query("trailing_30_avg", "SELECT count(*) AS points, CASE WHEN count(*) >= 7 THEN round(avg(n), 4) END AS average FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY day DESC LIMIT 30)")
def _(s, d):
    daily = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return A.trailing_average(daily, "day", "n")


@query("insight_priciest_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 2) AS cost, round(sum(value) / count(DISTINCT user_id), 4) AS per_session FROM events GROUP BY 1 ORDER BY cost DESC, day LIMIT 1")
def _(s, d):
    by = table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return by.agg(F.round(F.sum("value"), 2).alias("cost"), F.round(F.sum("value") / F.count_distinct("user_id"), 4).alias("per_session")).orderBy(F.desc("cost"), "day").limit(1)


@query(
    "share_of_spend",
    "SELECT event_type, cost, round(100 * cost / sum(cost) OVER (), 2) AS of_total, round(greatest(2.0, 100 * cost / max(cost) OVER ()), 2) AS of_max FROM (SELECT event_type, round(sum(value), 2) AS cost FROM events GROUP BY event_type)",
)
def _(s, d):
    return A.share(table(s, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("cost")), "cost")


@query("metric_scope", "SELECT event_type, sum(value) > 0 AS reports_cost, count(*) FILTER (WHERE props IS NOT NULL) > 0 AS reports_props FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg((F.sum("value") > 0).alias("reports_cost"), (F.count("props") > 0).alias("reports_props"))


# --- browsing and paging --------------------------------------------------------------


@query("browse_recent", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(s, d):
    return table(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


_NULLED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS moment FROM orders)"


@query("browse_oldest_nulls_last", f"SELECT o_orderkey, coalesce(strftime(moment, '%Y-%m-%d'), '') AS day FROM {_NULLED} ORDER BY moment ASC NULLS LAST, o_orderkey LIMIT 100")
def _(s, d):
    rows = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("at"))
    return rows.orderBy(F.asc_nulls_last("at"), "o_orderkey").limit(100).select("o_orderkey", F.coalesce(F.date_format("at", "yyyy-MM-dd"), F.lit("")).alias("day"))


@query(
    "browse_duration",
    "SELECT user_id, duration, n FROM (SELECT user_id, CASE WHEN count(*) > 1 THEN date_diff('second', min(ts), max(ts)) END AS duration, count(*) AS n FROM events GROUP BY user_id) ORDER BY duration DESC NULLS LAST, n DESC, user_id LIMIT 50",
)
def _(s, d):
    per = table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = F.when(F.col("n") > 1, F.unix_seconds(F.date_trunc("second", F.col("b").cast("timestamp"))) - F.unix_seconds(F.date_trunc("second", F.col("a").cast("timestamp"))))
    return per.withColumn("duration", seconds).orderBy(F.desc_nulls_last("duration"), F.desc("n"), "user_id").limit(50).select("user_id", "duration", "n")


@query("browse_title_nocase", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 50")
def _(s, d):
    return table(s, d, "part").orderBy(F.lower("p_name"), "p_partkey").limit(50).select("p_partkey", "p_name")


@query("page_offset", "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def _(s, d):
    return table(s, d, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(40).limit(20)


@query("page_children", "SELECT conv_id, turn, role, total, turn < total - 1 AS has_more FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn BETWEEN 2 AND 3")
def _(s, d):
    rows = table(s, d, "conversations")
    totals = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
    page = rows.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("rn between 2 and 3")
    return page.join(totals, "conv_id").select("conv_id", "turn", "role", "total", (F.col("turn") < F.col("total") - 1).alias("has_more"))


# --- scopes --------------------------------------------------------------------------


@query(
    "scope_all_filters",
    f"""SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND lang = 'en' AND n_chars >= 200 AND doc_id % 11 <> 4
    AND doc_id IN (SELECT session_id FROM {_TAGS} WHERE tag IN ('quality') GROUP BY session_id HAVING count(DISTINCT tag) = 1)""",
)
def _(s, d):
    docs = table(s, d, "documents").withColumnsRenamed({"doc_id": "session_id"}).withColumn("hidden", F.col("session_id") % 11 == 4)
    docs = S.visible(docs.withColumn("source_adapter", F.lit(None).cast("string")), only_hidden=False).where("source = 'src3' and lang = 'en' and n_chars >= 200")
    return S.with_all_tags(docs, _tags(s, d), ["quality", " quality "]).select(F.col("session_id").alias("doc_id"), "source", "lang")


@query("scope_date_inclusive", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-03-16'")
def _(s, d):
    return table(s, d, "orders").where(S.between_days(F.col("o_orderdate").cast("timestamp"), "1995-03-01", "1995-03-15")).select("o_orderkey")


@query("visibility_scope", "SELECT doc_id FROM documents WHERE doc_id % 13 <> 5 AND CASE WHEN doc_id % 3 = 0 THEN source <> 'src1' ELSE source NOT IN ('src1', 'src2') END")
def _(s, d):
    adapter = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    docs = table(s, d, "documents").withColumn("hidden", F.col("doc_id") % 13 == 5).withColumn("source_adapter", adapter)
    own = S.visible(docs.where("source_adapter is not null"), ["src1", "src2"])
    return own.unionByName(S.visible(docs.where("source_adapter is null"), ["src1"])).select("doc_id")


@query("hidden_only", "SELECT doc_id FROM documents WHERE doc_id % 13 = 5")
def _(s, d):
    return S.visible(table(s, d, "documents").withColumn("hidden", F.col("doc_id") % 13 == 5), ["src1"], only_hidden=True).select("doc_id")


@query("tags_all_of", "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1")
def _(s, d):
    ids = table(s, d, "labels").select(F.col("doc_id").alias("session_id")).distinct()
    return S.with_all_tags(ids, _tags(s, d), ["quality", "toxic"]).select(F.col("session_id").alias("doc_id"))


@query("id_scope_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(s, d):
    return S.within_ids(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels").where("quality = 0"), "doc_id")


@query("missing_labels_anti", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
def _(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left_anti")


@query("not_in_delete", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(s, d):
    gone = table(s, d, "labels").select(F.col("doc_id").alias("vec_id"))
    return table(s, d, "embeddings").select("vec_id", "label").join(gone, "vec_id", "left_anti")


@query("substring_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an_') OR contains(lower(p_name), 'an')")
def _(s, d):
    return table(s, d, "part").where(S.contains_text(F.col("p_name"), "an_") | S.contains_text(F.col("p_name"), "AN")).select("p_partkey", "p_name")


@query("deferred_content", "SELECT doc_id, strlen(text) AS bytes, CASE WHEN strlen(text) <= 1500 THEN md5(text) END AS body FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.when(F.octet_length("text") <= 1500, F.md5(F.col("text").cast("binary"))).alias("body"))


# --- turns ---------------------------------------------------------------------------


@query("left_join_turns", "SELECT e.vec_id, e.label, c.role FROM embeddings e LEFT JOIN conversations c ON c.conv_id = e.label AND c.turn = e.vec_id % 5")
def _(s, d):
    turns = table(s, d, "conversations").select(F.col("conv_id").alias("label"), F.col("turn").alias("t"), "role")
    return table(s, d, "embeddings").withColumn("t", F.col("vec_id") % 5).join(turns, ["label", "t"], "left").select("vec_id", "label", "role")


@query(
    "neighbor_turns",
    "SELECT DISTINCT c.conv_id, c.turn, c.role FROM conversations c JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'user' AND turn % 3 = 1) h ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1",
)
def _(s, d):
    turns = table(s, d, "conversations")
    around = turns.where("role = 'user' and turn % 3 = 1").select("conv_id", F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("turn")).distinct()
    return turns.join(around, ["conv_id", "turn"], "left_semi").select("conv_id", "turn", "role")


@query(
    "turn_assembly",
    """WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS i FROM conversations)
    SELECT conv_id, CAST(i AS BIGINT) AS turn_index, coalesce(string_agg(CASE WHEN role = 'user' THEN text END, chr(10) || chr(10) ORDER BY turn), '') AS user_message,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) || chr(10) ORDER BY turn), '') AS assistant_response FROM g GROUP BY conv_id, i""",
)
def _(s, d):
    return L.assemble_turns(table(s, d, "conversations"), "conv_id", "turn", "role", "text")


@query(
    "first_user_title",
    r"""SELECT conv_id, CASE WHEN length(t) > 90 THEN substr(t, 1, 90) || '...' ELSE t END AS title FROM
    (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(arg_min(text, turn), '\r\n|\r|\n'), lambda x: trim(regexp_replace(trim(x), '^[#>*\-• ]+', ''))), lambda x: x <> '')[1] AS t
     FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id)""",
)
def _(s, d):
    said = table(s, d, "conversations").where("role = 'user' and trim(text) <> ''")
    return said.groupBy("conv_id").agg(F.min_by("text", "turn").alias("t")).select("conv_id", X.title_from(F.col("t")).alias("title"))


# --- windows and ranking helpers --------------------------------------------------------


@query(
    "even_sample_cap",
    """SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS c FROM documents)
    WHERE c <= 6 OR r = 1 OR (c > 1 AND ((r - 1) * 5) // (c - 1) > CASE WHEN r = 1 THEN -1 ELSE ((r - 2) * 5) // (c - 1) END)""",
)
def _(s, d):
    return R.evenly_sampled(table(s, d, "documents").select("source", "doc_id"), "source", "doc_id", 6)


@query("per_session_cap", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3 ORDER BY n_chars DESC, doc_id LIMIT 40")
def _(s, d):
    docs = table(s, d, "documents").select("source", "doc_id", "n_chars")
    return R.cap_per_group(docs, "source", [F.desc("n_chars"), F.asc("doc_id")], 3).orderBy(F.desc("n_chars"), "doc_id").limit(40)


@query(
    "interleave_rr",
    """WITH p AS (SELECT doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents ORDER BY pos LIMIT 80),
    q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS round, min(pos) OVER (PARTITION BY source) AS lead FROM p)
    SELECT row_number() OVER (ORDER BY round, lead) AS place, doc_id, source FROM q""",
)
def _(s, d):
    best = table(s, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(80)
    order = [F.desc("n_chars"), F.asc("doc_id")]
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("round", "lead")).cast("long")
    return R.interleave(best, "source", order).select(place.alias("place"), "doc_id", "source")


@query("first_occurrence", "SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return L.first_seen(docs, ["digest"], "doc_id")


@query(
    "rank_blend",
    """WITH c AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100)
    SELECT doc_id, round(2.0 / (60 + row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) + 1.0 / (60 + row_number() OVER (ORDER BY doc_id DESC) - 1), 8) AS blend FROM c""",
)
def _(s, d):
    best = table(s, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    return R.blended(best.withColumn("at", F.col("doc_id")), "doc_id", "n_chars", "at").select("doc_id", F.round("blend", 8).alias("blend"))


# --- text ------------------------------------------------------------------------------


@query(
    "chunk_windows",
    """SELECT doc_id, CAST(i AS INTEGER) AS chunk, md5(substr(text, i * 1800 + 1, 2000)) AS digest, length(substr(text, i * 1800 + 1, 2000)) AS n
    FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 2000 THEN range(0, 1) ELSE range(0, (length(text) - 1) // 1800 + 1) END) AS i FROM documents WHERE length(text) > 0)""",
)
def _(s, d):
    chunks = table(s, d, "documents").select("doc_id", F.posexplode(X.chunk_windows(F.col("text"))).alias("chunk", "c"))
    return chunks.select("doc_id", "chunk", F.md5(F.col("c").cast("binary")).alias("digest"), F.length("c").cast("long").alias("n"))


@query("token_estimate", "SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN length(text) // 4 ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END) AS BIGINT) AS output_tokens FROM conversations GROUP BY conv_id")
def _(s, d):
    n = X.estimate_tokens(F.col("text"))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", n).otherwise(0)).alias("input_tokens"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("output_tokens"))


@query(
    "plain_text",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[#>*_~|]+', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""",
)
def _(s, d):
    return table(s, d, "pages").select("page_id", X.plain_text(F.col("html")).alias("plain"))


@query("topic_words", f"SELECT lang, w AS word, count(*) AS n FROM (SELECT lang, unnest({_WORDS.format('text')}) AS w FROM documents) WHERE length(w) > 2 GROUP BY ALL")
def _(s, d):
    each = table(s, d, "documents").select("lang", F.explode(X.words(F.col("text"))).alias("word")).where(F.length("word") > 2)
    return each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "topic_bigrams",
    f"""SELECT b AS bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM (SELECT {_WORDS.format('text')} AS w FROM documents)) GROUP BY b HAVING count(*) >= 2""",
)
def _(s, d):
    w = table(s, d, "documents").select(F.explode(F.array(X.words(F.col("text")))).alias("w"))
    each = w.select(F.explode(X.bigrams(F.col("w"))).alias("bigram"))
    return each.groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query(
    "keyphrase_scores",
    f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
    uni AS (SELECT doc_id, unnest(w) AS term, 1.0 AS k FROM w), bi AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w),
    raw AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS c FROM uni WHERE length(term) > 2 GROUP BY ALL UNION ALL SELECT doc_id, term, count(*) * 2.5 FROM bi GROUP BY ALL HAVING count(*) >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, term) AS rn, max(c) OVER (PARTITION BY doc_id) AS m FROM raw)
    SELECT doc_id, term, round(c / m, 3) AS score FROM r WHERE rn <= 6""",
)
def _(s, d):
    return R.frequent_phrases(table(s, d, "documents"), "doc_id", "text").withColumn("score", F.round("score", 3))


@query("jaccard_pairs", f"WITH w AS (SELECT item_id, list_distinct({_WORDS.format('text')}) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity FROM w a JOIN w b ON b.item_id = a.item_id + 1")
def _(s, d):
    w = table(s, d, "benchmark").select("item_id", X.words(F.col("text")).alias("w"))
    following = w.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return w.join(following, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(X.jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


@query("page_links", r"""SELECT page_id, len(list_distinct(list_transform(regexp_extract_all(html, 'https?://[^\s"''<>\]]+'), lambda u: regexp_replace(u, '[.,);]+$', '')))) AS links FROM pages""")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.size(X.urls(F.col("html"))).cast("long").alias("links"))


@query("url_strip", r"""SELECT DISTINCT u AS url FROM (SELECT unnest(list_transform(regexp_extract_all(html, 'https?://[^\s"''<>\]]+'), lambda x: regexp_replace(x, '[.,);]+$', ''))) AS u FROM pages)""")
def _(s, d):
    return table(s, d, "pages").select(F.explode(X.urls(F.col("html"))).alias("url")).distinct()


@query("events_json_prop", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query(
    "code_fences",
    """SELECT * FROM (VALUES (1, 0, 'python', 'x = 1'), (1, 1, '', 'plain'), (3, 0, 'sh', 'ls')) t(id, i, language, content)""",
)
def _(s, d):
    texts = [(1, "a\n```python\nx = 1\n```\nb\n```\nplain\n\n```"), (2, "no fence"), (3, "```sh title\nls\n```\n```js\n\n```")]
    rows = s.createDataFrame(texts, "id int, text string")
    return rows.select("id", F.posexplode(X.code_fences(F.col("text"))).alias("i", "b")).select("id", "i", "b.language", "b.content")


@query("dup_titles", "SELECT lower(trim(p_name)) AS title, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return table(s, d, "part").groupBy(F.lower(F.trim("p_name")).alias("title")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


@query("content_hash", "SELECT doc_id, sha256(concat_ws('|', source, lang, text)) AS hash FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(F.concat_ws("|", "source", "lang", "text").cast("binary"), 256).alias("hash"))


# --- search -----------------------------------------------------------------------------

_Q = "anon est"


def _bm25_sql(query: str, match: str = "w", where: str = "true", n: int = 20) -> str:
    ps = R.query_prefixes(query)
    hits = ", ".join(f"len(list_filter({match}, lambda x: starts_with(x, '{p}'))) AS f{j}" for j, p in enumerate(ps))
    stat = ", ".join(f"count(*) FILTER (WHERE f{j} > 0) AS n{j}" for j in range(len(ps)))
    idf = [f"CASE WHEN ln((n - n{j} + 0.5) / (n{j} + 0.5)) > 0 THEN ln((n - n{j} + 0.5) / (n{j} + 0.5)) ELSE 1e-6 END" for j in range(len(ps))]
    score = " + ".join(f"({idf[j]}) * f{j} * 2.2 / (f{j} + 1.2 * (0.25 + 0.75 * d / a))" for j in range(len(ps)))
    any_hit = " OR ".join(f"f{j} > 0" for j in range(len(ps)))
    return f"""(WITH w AS (SELECT doc_id, source, {_WORDS.format('text')} AS w, {_WORDS.format('source')} AS v FROM documents),
    c AS (SELECT doc_id, source, CAST(len(w) + len(v) AS DOUBLE) AS d, {hits} FROM w), s AS (SELECT count(*) AS n, avg(d) AS a, {stat} FROM c)
    SELECT doc_id, round({score}, 6) AS score FROM c, s WHERE ({any_hit}) AND {where} ORDER BY {score} DESC, doc_id LIMIT {n})"""


def _index(s: SparkSession, d: str) -> I.Index:
    """The documents' index: written at first use, kept under the files' fingerprint, asked by every search query."""
    return I.of_table(table(s, d, "documents"), "doc_id", ["text", "source"])


@query("keyword_match_ids", f"SELECT doc_id FROM documents WHERE len(list_filter({_WORDS.format('text')}, lambda x: starts_with(x, 'anon') OR starts_with(x, 'est'))) > 0")
def _(s, d):
    return _index(s, d).matches(_Q, ["text"])


@query("bm25_topk", f"SELECT * FROM {_bm25_sql(_Q, 'list_concat(w, v)')}")
def _(s, d):
    return R.top(_index(s, d).bm25(_Q), "score", "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_content_only", f"SELECT * FROM {_bm25_sql(_Q + ' src3')}")
def _(s, d):
    scored = _index(s, d).bm25(_Q + " src3", match=["text"])
    return R.top(scored, "score", "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_scoped", f"SELECT * FROM {_bm25_sql(_Q, where=chr(39).join(['source IN (', 'src3', ', ', 'src4', ')']))}")
def _(s, d):
    within = table(s, d, "documents").where("source in ('src3', 'src4')")
    scored = _index(s, d).bm25(_Q, within, ["text"])
    return R.top(scored, "score", "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


_KNN = "list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def _vector(s: SparkSession, d: str, vec_id: int) -> list[float]:
    return table(s, d, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


@query("knn_topk", f"SELECT e.vec_id, round({_KNN}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_KNN} DESC, e.vec_id LIMIT 10")
def _(s, d):
    return R.top(R.nearest(table(s, d, "embeddings"), _vector(s, d, 0)), "score", "vec_id", 10).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_best_per_label", f"SELECT label, vec_id, round(s, 6) AS score FROM (SELECT label, e.vec_id, {_KNN} AS s, row_number() OVER (PARTITION BY label ORDER BY {_KNN} DESC, e.vec_id) AS rn FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE rn = 1")
def _(s, d):
    vectors = table(s, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in _vector(s, d, 0)])
    scored = vectors.select("label", "vec_id", X.dot(F.col("embedding"), q).alias("score"))
    return R.best_per_group(scored, "label", "score", "vec_id").select("label", "vec_id", F.round("score", 6).alias("score"))


@query("centroids", "SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(x), 6) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def _(s, d):
    return R.centroids(table(s, d, "embeddings"), "label").select("label", F.posexplode("centroid").alias("i", "m")).withColumn("m", F.round("m", 6))


@query(
    "related_sessions",
    """WITH p AS (SELECT label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT i, avg(x) AS c FROM p WHERE label = 3 GROUP BY i), n AS (SELECT sqrt(sum(c * c)) AS norm FROM m),
    s AS (SELECT p.label, p.vec_id, sum(x * c) / any_value(norm) AS s FROM p JOIN m USING (i), n WHERE p.label <> 3 GROUP BY ALL)
    SELECT label, round(max(s), 5) AS score FROM s GROUP BY label ORDER BY max(s) DESC, label LIMIT 8""",
)
def _(s, d):
    vectors = table(s, d, "embeddings")
    mean = R.centroids(vectors.where("label = 3"), "label").select(X.unit(F.col("centroid")).alias("u")).first().u
    scored = vectors.where("label <> 3").select("label", X.dot(F.col("embedding"), F.array(*[F.lit(x) for x in mean])).alias("score"))
    return scored.groupBy("label").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "label").limit(8).select("label", F.round("score", 5).alias("score"))


_LEX = _bm25_sql(_Q, "list_concat(w, v)", n=180)
_SEM = f"(SELECT e.vec_id AS doc_id, {_KNN} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_KNN} DESC, e.vec_id LIMIT 180)"
_FUSED = f"""(SELECT doc_id, sum(1.0 / (60 + r)) AS score FROM (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM {_LEX}
    UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 FROM {_SEM}) GROUP BY doc_id)"""


def _fused(s: SparkSession, d: str) -> DataFrame:
    lexical = _index(s, d).bm25(_Q).withColumn("score", F.round("score", 6))
    semantic = R.nearest(table(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), _vector(s, d, 7), "doc_id")
    return R.fuse([R.ranked(x, "score", "doc_id", 30 * R.OVER_FETCH) for x in (lexical, semantic)], "doc_id")


@query("rrf_fusion", f"SELECT doc_id, round(score, 8) AS score FROM {_FUSED} ORDER BY round(score, 8) DESC, doc_id LIMIT 30")
def _(s, d):
    return R.top(_fused(s, d).withColumn("score", F.round("score", 8)), "score", "doc_id", 30)


@query(
    "hybrid_search",
    f"""WITH f AS (SELECT source, f.doc_id, round(score, 8) AS score FROM {_FUSED} f JOIN documents d ON d.doc_id = f.doc_id),
    b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn FROM f)
    SELECT source, doc_id, round(score / max(score) OVER (), 4) AS score FROM b WHERE rn = 1 ORDER BY b.score DESC, source LIMIT 30""",
)
def _(s, d):
    # chunks are documents here, sessions their sources; the ranked side is at most 2 * 180 rows
    scored = _fused(s, d).withColumn("score", F.round("score", 8)).join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    best = R.best_per_group(scored.select("source", "doc_id", "score"), "source", "score", "doc_id")
    return R.normalised(R.top(best, "score", "source", 30))


@query("ranked_sessions_capped", f"WITH f AS (SELECT source, max(round(score, 8)) AS score FROM {_FUSED} f JOIN documents d ON d.doc_id = f.doc_id GROUP BY source) SELECT source, score, (SELECT count(*) FROM f) > 10 AS truncated FROM f ORDER BY score DESC, source LIMIT 10")
def _(s, d):
    scored = _fused(s, d).join(table(s, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.round(F.max("score"), 8).alias("score"))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return scored.orderBy(F.desc("score"), "source").limit(11).withColumn("truncated", n > 10).orderBy(F.desc("score"), "source").limit(10)


@query(
    "passages_capped",
    f"""WITH f AS (SELECT source, f.doc_id, round(score, 8) AS score FROM {_FUSED} f JOIN documents d ON d.doc_id = f.doc_id),
    b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn FROM f)
    SELECT source, doc_id, score FROM b WHERE rn <= 2 ORDER BY score DESC, doc_id LIMIT 40""",
)
def _(s, d):
    scored = _fused(s, d).withColumn("score", F.round("score", 8)).join(table(s, d, "documents").select("doc_id", "source"), "doc_id").select("source", "doc_id", "score")
    return R.top(R.cap_per_group(scored, "source", [F.desc("score"), F.asc("doc_id")], 2), "score", "doc_id", 40)


# --- collections and lifecycle ------------------------------------------------------------

_RULE = "SELECT doc_id FROM documents WHERE source = 'src2'"
_MEMBERS = f"((({_RULE}) UNION (SELECT doc_id FROM documents WHERE doc_id % 101 = 7)) EXCEPT (SELECT doc_id FROM documents WHERE doc_id % 7 = 3))"


def _member_ids(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "source")
    state = F.when(F.col("doc_id") % 7 == 3, "exclude").when(F.col("doc_id") % 101 == 7, "include")
    return L.members(docs.where("source = 'src2'"), docs.select("doc_id", state.alias("state")), docs.where("doc_id % 13 <> 5"), "doc_id")


@query("collection_membership", f"SELECT doc_id FROM {_MEMBERS} WHERE doc_id % 13 <> 5")
def _(s, d):
    return _member_ids(s, d)


@query("collection_overview", f"SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM documents WHERE doc_id IN (SELECT doc_id FROM {_MEMBERS} WHERE doc_id % 13 <> 5) GROUP BY lang")
def _(s, d):
    own = table(s, d, "documents").join(_member_ids(s, d), "doc_id", "left_semi")
    return own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"))


@query(
    "merge_lanes",
    "SELECT doc_id, min(lane) AS lane FROM (SELECT doc_id, 0 AS lane FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30) UNION ALL SELECT doc_id, 1 FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 30)) GROUP BY doc_id",
)
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars")
    long_ = docs.orderBy(F.desc("n_chars"), "doc_id").limit(30).select("doc_id", F.lit(0).alias("lane"))
    late = docs.orderBy(F.desc("doc_id")).limit(30).select("doc_id", F.lit(1).alias("lane"))
    return long_.unionByName(late).groupBy("doc_id").agg(F.min("lane").alias("lane"))


def _stored_fresh(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(s, d, "documents").select("doc_id", "source", F.col("n_chars").alias("hash"))
    return docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 3 = 0").withColumn("hash", F.when(F.col("doc_id") % 2 == 0, F.col("hash")).otherwise(-F.col("hash"))).withColumn("source", F.when(F.col("doc_id") % 5 != 0, F.col("source")))


@query(
    "upsert_merge",
    """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 AND d.doc_id % 5 = 0 AND d.doc_id % 4 = 0 THEN NULL ELSE source END AS source,
    CASE WHEN d.doc_id % 3 = 0 AND d.doc_id % 2 <> 0 THEN -n_chars ELSE n_chars END AS hash FROM documents d WHERE d.doc_id % 4 <> 0 OR d.doc_id % 3 = 0""",
)
def _(s, d):
    stored, fresh = _stored_fresh(s, d)
    return L.upsert(stored, fresh, "doc_id", ["source"])


@query("skip_unchanged", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND NOT (doc_id % 4 <> 0 AND doc_id % 2 = 0)")
def _(s, d):
    stored, fresh = _stored_fresh(s, d)
    return L.changed(fresh, stored, "doc_id", "hash").select("doc_id")


@query("tombstone_filter", "SELECT doc_id FROM documents WHERE doc_id % 9 <> 2")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id")
    return L.not_buried(docs, docs.where("doc_id % 9 = 2"), "doc_id")


@query("carry_vectors", "SELECT d.doc_id, max(e.vec_id) AS vec_id FROM documents d JOIN documents o ON md5(o.text) = md5(d.text) JOIN embeddings e ON e.vec_id = o.doc_id GROUP BY d.doc_id")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    known = docs.join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id").groupBy("digest").agg(F.max("doc_id").alias("vec_id"))
    return docs.join(known, "digest").select("doc_id", "vec_id")


@query("write_ledger", "SELECT * FROM (VALUES ('s1', '/a'), ('s2', '/c')) t(session, path)")
def _(s, d):
    rows = [
        ("s1", "c1", 0, "start", None, None), ("s1", "c1", 1, "path", "/a", None), ("s1", "c1", 2, "end", None, True),
        ("s1", "c2", 3, "start", None, None), ("s1", "c2", 4, "path", "/b", None), ("s1", "c2", 5, "end", None, False),
        ("s1", "c3", 6, "end", None, True), ("s1", "c3", 7, "start", None, None), ("s1", "c3", 8, "path", "/d", None),
        ("s2", "c1", 0, "start", None, None), ("s2", "c1", 1, "path", "/c", None), ("s2", "c1", 2, "end", None, True),
        ("s2", "c4", 3, "start", None, None), ("s2", "c4", 4, "start", None, None), ("s2", "c4", 5, "path", "/e", None), ("s2", "c4", 6, "end", None, True),
    ]
    return L.write_ledger(s.createDataFrame(rows, "session string, call_id string, pos int, kind string, path string, ok boolean"))


# --- cost -------------------------------------------------------------------------------

_PRICES = {"alpha": (2.0, 8.0, 0.5), "alpha-pro": (10.0, 30.0, 1.0, 12.0), "alpha-mini": (0.2, 0.8, 0.02), "beta": (1.0, 4.0, 0.1, 1.5, 2.5)}
_MODELS = ("Alpha_Pro.2", "alpha-v1", "alpha-x-mini", "beta", "gamma", None)
_MODEL_SQL = "CASE event_id % 6 WHEN 0 THEN 'Alpha_Pro.2' WHEN 1 THEN 'alpha-v1' WHEN 2 THEN 'alpha-x-mini' WHEN 3 THEN 'beta' WHEN 4 THEN 'gamma' END"
_PRICE_SQL = """(VALUES ('Alpha_Pro.2', 10.0, 30.0, 1.0, 12.0, 20.0), ('alpha-v1', 2.0, 8.0, 0.5, 2.5, 4.0), ('alpha-x-mini', 0.2, 0.8, 0.02, 0.25, 0.4),
    ('beta', 1.0, 4.0, 0.1, 1.5, 2.5), ('gamma', 3.0, 15.0, 0.3, 3.75, 6.0), (NULL, 3.0, 15.0, 0.3, 3.75, 6.0)) p(m, i, o, c, w, w1)"""


def _usage(s: SparkSession, d: str) -> DataFrame:
    model = F.get(F.array(*[F.lit(m) for m in _MODELS]), (F.col("event_id") % 6).cast("int"))
    n = lambda k: (F.col("event_id") % k).cast("long")
    return table(s, d, "events").select("event_id", model.alias("model"), (n(1000) * 10).alias("input"), n(300).alias("output"), (n(500) * 3).alias("read"), n(70).alias("write"), n(11).alias("write_1h"))


@query("price_longest_match", f"SELECT DISTINCT model, CAST(i AS DOUBLE) AS p_in, CAST(w1 AS DOUBLE) AS p_write_1h FROM (SELECT {_MODEL_SQL} AS model FROM events) JOIN {_PRICE_SQL} ON model IS NOT DISTINCT FROM m")
def _(s, d):
    from talkatlas.functions import pricing as P

    return P.priced(_usage(s, d).select("model").distinct(), P.price_frame(s, _PRICES), "model").select("model", "p_in", "p_write_1h")


@query(
    "cost_by_model",
    f"""SELECT model, count(*) AS n, round(sum((greatest(0, inp - r - w5 - w60) * CAST(i AS DOUBLE) + r * CAST(c AS DOUBLE) + w5 * CAST(w AS DOUBLE) + w60 * CAST(w1 AS DOUBLE) + outp * CAST(o AS DOUBLE)) / 1000000), 6) AS cost FROM
    (SELECT {_MODEL_SQL} AS model, event_id % 1000 * 10 AS inp, event_id % 300 AS outp, event_id % 500 * 3 AS r, event_id % 70 AS w5, event_id % 11 AS w60 FROM events) JOIN {_PRICE_SQL} ON model IS NOT DISTINCT FROM m GROUP BY model""",
)
def _(s, d):
    from talkatlas.functions import pricing as P

    each = P.priced(_usage(s, d), P.price_frame(s, _PRICES), "model").withColumn("usd", P.cost())
    return each.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("usd"), 6).alias("cost"))


@query(
    "cache_cost",
    f"""SELECT event_id, round((inp * CAST(i AS DOUBLE) + r * CAST(c AS DOUBLE) + w5 * CAST(w AS DOUBLE) + w60 * CAST(w1 AS DOUBLE) + outp * CAST(o AS DOUBLE)) / 1000000, 9) AS cost FROM
    (SELECT event_id, {_MODEL_SQL} AS model, event_id % 1000 * 10 AS inp, event_id % 300 AS outp, event_id % 500 * 3 AS r, event_id % 70 AS w5, event_id % 11 AS w60 FROM events) JOIN {_PRICE_SQL} ON model IS NOT DISTINCT FROM m""",
)
def _(s, d):
    from talkatlas.functions import pricing as P

    return P.priced(_usage(s, d), P.price_frame(s, _PRICES), "model").select("event_id", F.round(P.cost(includes_cache=False), 9).alias("cost"))


# --- summaries and packing (no SQL: stateful folds) -------------------------------------


@query("summary_fast")
def _(s, d):
    turns = L.assemble_turns(table(s, d, "conversations"), "conv_id", "turn", "role", "text")
    lead = F.min_by(X.plain_text(F.col("user_message")), F.when(F.trim("user_message") != "", F.col("turn_index")))
    body = F.max_by(X.plain_text(F.col("assistant_response")), F.when(F.length(X.plain_text(F.col("assistant_response"))) > 40, F.col("turn_index")))
    per = turns.groupBy("conv_id").agg(lead.alias("lead"), body.alias("body"))
    first = X.clip_words(F.get(F.split("lead", r"\. "), 0), 160)
    two = F.array_join(F.slice(X.sentences(F.col("body")), 1, 2), " ")
    text = F.concat_ws(" ", first, F.when(two != "", two).otherwise(F.col("body")))
    return per.select("conv_id", F.when(F.length(text) > 380, F.concat(X.clip_words(text, 377), F.lit("..."))).otherwise(text).alias("summary"))


@query(
    "greedy_pack",
    """WITH RECURSIVE o AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
    p(source, r, used, n) AS (SELECT source, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT source FROM documents) UNION ALL
    SELECT p.source, o.r, CASE WHEN used + n_chars <= 16384 THEN used + n_chars ELSE used END, CASE WHEN used + n_chars <= 16384 THEN n + 1 ELSE n END
    FROM p JOIN o ON o.source IS NOT DISTINCT FROM p.source AND o.r = p.r + 1)
    SELECT source, max(used) AS used, max(n) AS n FROM p GROUP BY source""",
)
def _(s, d):
    return R.packed_by_size(table(s, d, "documents"), "source", "n_chars", 16384)


# --- evidence, collections and synchronising -----------------------------------------------

_HITS = "(SELECT vec_id AS chunk_id, label AS session_id, CASE WHEN vec_id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role, CAST(vec_id % 7 AS VARCHAR) AS content, CAST(vec_id % 50 AS DOUBLE) AS score, CASE WHEN vec_id % 4 > 0 THEN CAST(vec_id % 21 AS DOUBLE) - 15 END AS rerank FROM embeddings)"


def _hits(s: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return table(s, d, "embeddings").select(
        v.alias("chunk_id"), F.col("label").alias("session_id"), F.when(v % 3 == 0, "user").otherwise("assistant").alias("role"), (v % 7).cast("string").alias("content"),
        (v % 50).cast("double").alias("score"), F.when(v % 4 > 0, (v % 21).cast("double") - 15).alias("rerank"),
    )


@query("relevance_floor", f"SELECT chunk_id, rerank FROM {_HITS} WHERE rerank IS NULL OR rerank >= -8")
def _(s, d):
    return Q.relevant(_hits(s, d)).select("chunk_id", "rerank")


@query("rerank_order", f"SELECT chunk_id, row_number() OVER (ORDER BY rerank DESC NULLS LAST, score DESC, chunk_id) AS place FROM {_HITS} WHERE (rerank IS NULL OR rerank >= -8) AND session_id < 4")
def _(s, d):
    hits = _hits(s, d).where("session_id < 4")
    return Q.reranked(hits.drop("rerank"), "chunk_id", lambda rows: hits.where("rerank is not null").select("chunk_id", "rerank")).select("chunk_id", F.col("order").cast("long").alias("place"))


@query("distinct_passages", f"SELECT session_id, role, content, max(score) AS score FROM {_HITS} GROUP BY ALL")
def _(s, d):
    return Q.distinct_passages(_hits(s, d)).select("session_id", "role", "content", "score")


@query("best_sessions", f"SELECT session_id, max(coalesce(rerank, score)) AS score FROM {_HITS} GROUP BY session_id ORDER BY score DESC, session_id LIMIT 5")
def _(s, d):
    return Q.best_sessions(_hits(s, d), 5)


@query("collection_overlap", f"WITH a AS (SELECT doc_id FROM {_MEMBERS}), b AS (SELECT doc_id FROM documents WHERE lang = 'en') SELECT (SELECT count(*) FROM a) AS first, (SELECT count(*) FROM b) AS second, (SELECT count(*) FROM a JOIN b USING (doc_id)) AS shared, round((SELECT count(*) FROM a JOIN b USING (doc_id)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), 6) AS similarity")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", "lang")
    state = F.when(F.col("doc_id") % 7 == 3, "exclude").when(F.col("doc_id") % 101 == 7, "include")
    own = L.members(docs.where("source = 'src2'"), docs.select("doc_id", state.alias("state")), docs, "doc_id")
    ids = lambda df: df.select(F.col("doc_id").alias("id"))
    out = C.overlap(ids(own), ids(docs.where("lang = 'en'")))
    return out.withColumn("similarity", F.round("similarity", 6))


@query("sync_changed_files", "SELECT doc_id AS path FROM documents WHERE doc_id % 5 = 0 OR doc_id % 6 = 1")
def _(s, d):
    found = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(0).alias("changed_at"))
    stored = found.where("path % 5 <> 0").withColumn("size", F.when(F.col("path") % 6 == 1, F.col("size") + 1).otherwise(F.col("size")))
    return Y.changed_files(found, stored).select("path")


@query("sync_vanished_files", "SELECT doc_id AS path FROM documents WHERE doc_id % 8 = 3")
def _(s, d):
    stored = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    return Y.vanished_files(stored.where("path % 8 <> 3"), stored).select("path")


# --- event-time extensions (no counterpart in the archive's own engine) ---------------------


@query("stream_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def _(s, d):
    from talkatlas.streaming import ingest as I

    out = I.tumbling(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "v")


@query(
    "stream_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    h AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM h GROUP BY user_id, i""",
)
def _(s, d):
    from talkatlas.streaming import ingest as I

    out = I.sessions(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", "user_id")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


# --- feature hashing in SQL (md5 for the hash, the sign from the bucket) -------------------


@query(
    "hash_embed_md5",
    f"""WITH t AS (SELECT item_id, list_filter({_WORDS.format('text')}, lambda w: length(w) > 1) AS w FROM benchmark),
    k AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS t FROM t),
    b AS (SELECT item_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS bucket, count(*) AS c FROM k GROUP BY ALL),
    v AS (SELECT item_id, bucket, CASE WHEN CAST('0x' || substr(md5(CAST(bucket AS VARCHAR)), 1, 2) AS BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END * (1 + ln(c)) AS x FROM b)
    SELECT item_id, bucket, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS value FROM v""",
)
def _(s, d):
    w = table(s, d, "benchmark").select("item_id", F.explode(F.array(F.filter(X.words(F.col("text")), lambda x: F.length(x) > 1))).alias("w"))
    pairs = F.transform(X.bigrams(F.col("w")), lambda p: F.replace(p, F.lit(" "), F.lit("_")))
    tokens = w.select("item_id", F.explode(F.concat("w", pairs)).alias("t"))
    hexed = lambda c, n: F.conv(F.substring(F.md5(c.cast("binary")), 1, n), 16, 10).cast("long")
    counts = tokens.groupBy("item_id", (hexed(F.col("t"), 8) % 64).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    sign = F.when(hexed(F.col("bucket").cast("string"), 2) % 2 == 1, 1.0).otherwise(-1.0)
    x = counts.withColumn("x", sign * (1 + F.log("c")))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("item_id")))
    return x.select("item_id", "bucket", F.round(F.col("x") / norm, 6).alias("value"))
