"""What leaves the archive as text: Markdown of sessions, lists of hits, JSON, events."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _if(value: Column, *parts: Column | str) -> Column:
    """The parts joined where value has something in it, else an empty string."""
    joined = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", joined).otherwise("")


def _turn(t: Column) -> Column:
    user, think, reply = t["user_message"], t["thinking"], t["assistant_response"]
    tools = F.array_join(F.coalesce(t["tools"], F.array().cast("array<string>")), ", ")
    return F.concat(
        F.concat(F.lit("## Turn "), (t["turn_index"] + 1).cast("string"), F.lit("\n\n")),
        _if(user, "**You:**\n\n", F.trim(user), "\n\n"),
        _if(think, "**Reasoning:**\n\n> ", F.replace(F.trim(think), F.lit("\n"), F.lit("\n> ")), "\n\n"),
        _if(reply, "**Assistant:**\n\n", _if(tools, "_tools: ", tools, "_\n\n"), F.trim(reply), "\n\n"),
        F.lit("---\n\n"),
    )


def markdown(sessions: DataFrame) -> DataFrame:
    """id and markdown of canonical sessions, built JVM-side."""
    c = F.col
    when = F.coalesce("updated_at", "created_at")
    facts = F.array_join(
        F.filter(
            F.array(
                _if(c("source"), "- **Source:** ", c("source")),
                _if(c("repository"), "- **Repository:** ", c("repository")),
                _if(c("model"), "- **Model:** ", c("model")),
                _if(when, "- **Date:** ", when),
                F.when(c("turn_count") > 0, F.concat(F.lit("- **Turns:** "), c("turn_count").cast("string"))).otherwise(""),
                F.when(c("est_cost_usd").isNotNull(), F.concat(F.lit("- **Est. cost:** ~$"), F.format_string("%.2f", "est_cost_usd"))).otherwise(""),
            ),
            lambda x: x != "",
        ),
        "\n",
    )
    body = F.array_join(F.transform("turns", _turn), "")
    text = F.concat(F.lit("# "), F.coalesce(F.nullif(c("title"), F.lit("")), F.lit("Untitled conversation")), F.lit("\n\n"), _if(facts, facts, "\n\n"), F.lit("---\n\n"), body)
    return sessions.select("id", F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n")).alias("markdown"))


def write_markdown(sessions: DataFrame, path: str) -> None:
    """One directory of text, partitioned by session, each session's text in one record."""
    markdown(sessions).select("id", F.col("markdown").alias("value")).write.partitionBy("id").option("lineSep", "\n").text(path)


def hit_lines(hits: DataFrame) -> DataFrame:
    """line: one entry for each hit (id, title, source, repository, date, score, snippet), for agents."""
    day = F.substring(F.coalesce("updated_at", "created_at"), 1, 10)
    score = F.when(F.col("score").isNotNull(), F.concat(F.lit("score "), F.col("score").cast("string")))
    facts = F.array_join(F.filter(F.array("source", "repository", day, score), lambda x: F.coalesce(x, F.lit("")) != ""), " · ")
    plain = F.trim(F.regexp_replace("snippet", "<[^>]+>", ""))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    head = F.concat(F.lit("- ["), "id", F.lit("] "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")))
    return hits.select(F.concat(head, _if(facts, "  · ", facts), _if(plain, "\n  ", plain)).alias("line"))


def search_text(hits: DataFrame, query: str) -> str:
    """The answer to an agent's search: at most 25 hits."""
    lines = [r.line for r in hit_lines(hits.limit(25)).collect()]
    return f"{len(lines)} conversation(s) matching {query!r}:\n\n" + "\n\n".join(lines) if lines else f"No conversations found for: {query!r}"


def json_rows(rows: DataFrame) -> DataFrame:
    """value: each row as JSON, angle brackets neutralised."""
    text = F.to_json(F.struct(*rows.columns))
    return rows.select(F.replace(F.replace(text, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")).alias("value"))


def event_stream(sources: DataFrame, tokens: Iterable[str]) -> Iterator[str]:
    """Server-sent events: the sources, an answer's tokens, then done."""
    import json

    yield "data: " + json.dumps({"type": "sources", "sources": [json.loads(r.value) for r in json_rows(sources).collect()]}) + "\n\n"
    for t in tokens:
        yield "data: " + json.dumps({"type": "token", "text": t}) + "\n\n"
    yield 'data: {"type": "done"}\n\n'
