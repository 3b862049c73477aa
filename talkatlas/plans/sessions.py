"""A session in full, and short lists of sessions.

Sessions are the canonical records: their turns, files, URLs, code blocks and attachments are
nested, so a page of them is a filter on one row's arrays and never a scan of child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkatlas.operators import scope as S
from talkatlas.plans.archive import Archive

FILE_LIMIT = LINK_LIMIT = ATTACHMENT_LIMIT = 200
# Fixed value: names of shells in code fences.
SHELLS = ("bash", "sh", "shell", "shellscript", "zsh", "console", "shell-session", "sh-session", "shellsession", "powershell", "ps1")


def _size(turn: Column) -> Column:
    """Bytes of a turn's texts."""
    fields = [F.coalesce(F.octet_length(turn[f]), F.lit(0)) for f in ("user_message", "assistant_response", "thinking")]
    return sum(fields[1:], fields[0])


def _page(items: Column, offset: int, limit: int | None) -> Column:
    return F.slice(items, F.lit(offset + 1), F.lit(2**31 - 1 if limit is None else limit))


def turns(archive: Archive, session_id: str, offset: int = 0, limit: int | None = None, defer_above: int | None = None) -> DataFrame:
    """A page of a session's turns in order: turn_index, texts, tools, timestamp, content_chars, total, has_more. Texts of
    turns of more than defer_above bytes are left out, to be asked for one by one."""
    ordered = F.array_sort("turns", lambda a, b: F.when(a["turn_index"] < b["turn_index"], -1).when(a["turn_index"] > b["turn_index"], 1).otherwise(0))
    one = archive.sessions.where(F.col("id") == session_id).select(ordered.alias("turns"))
    total = F.size("turns")
    t = F.col("t")
    shown = F.lit(True) if defer_above is None else _size(t) <= defer_above
    page = one.select(total.alias("total"), F.posexplode(_page(F.col("turns"), offset, limit)).alias("place", "t"))
    texts = [F.when(shown, t[f]).alias(f) for f in ("user_message", "assistant_response", "thinking")]
    return page.select(t["turn_index"].alias("turn_index"), *texts, t["tools"].alias("tools"), t["ts"].alias("timestamp"), _size(t).alias("content_chars"), "total", (F.lit(offset) + F.col("place") + 1 < F.col("total")).alias("has_more"))


def turn(archive: Archive, session_id: str, turn_index: int) -> DataFrame:
    """One whole turn."""
    return turns(archive, session_id).where(F.col("turn_index") == turn_index)


def children(archive: Archive, session_id: str, field: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """value, turn_index, total of what the turns hold in `field` (files, urls), each value once, by turn and value."""
    each = archive.sessions.where(F.col("id") == session_id).select(F.explode("turns").alias("t")).select(F.explode(F.col("t")[field]).alias("value"), F.col("t.turn_index").alias("turn_index"))
    first = each.groupBy("value").agg(F.min("turn_index").alias("turn_index"))
    listed = first.agg(F.array_sort(F.collect_list(F.struct("turn_index", "value"))).alias("all"))
    return listed.select(F.size("all").alias("total"), F.explode(_page(F.col("all"), offset, limit)).alias("x")).select("x.value", "x.turn_index", "total")


def detail(archive: Archive, session_id: str, turns_offset: int = 0, turns_limit: int | None = None, defer_above: int | None = None, attachments: DataFrame | None = None) -> dict | None:
    """Everything that a session's page shows, as one record; None for an unknown id. Child lists are cut to their
    limits and come with their whole numbers. attachments: session_id, filename, ... of uploads."""
    found = archive.sessions.where(F.col("id") == session_id).drop("turns").limit(1).collect()
    if not found:
        return None
    out = found[0].asDict(recursive=True)
    page = turns(archive, session_id, turns_offset, turns_limit, defer_above).collect()
    out["turns"] = [{k: v for k, v in r.asDict(recursive=True).items() if k not in ("total", "has_more")} for r in page]
    out["turns_total"] = page[0].total if page else 0
    out["turns_has_more"] = bool(page and page[-1].has_more)
    for name, field, limit in (("files", "files", FILE_LIMIT), ("refs", "urls", LINK_LIMIT)):
        rows = children(archive, session_id, field, 0, limit).collect()
        out[name] = [{"value": r.value, "turn_index": r.turn_index} for r in rows]
        out[f"{name}_total"] = rows[0].total if rows else 0
    tags = archive.tags.where(F.col("session_id") == session_id).orderBy(F.desc("manual"), F.desc("score"), "tag").collect()
    out["tags"], out["manual_tags"] = [r.tag for r in tags], [r.tag for r in tags if r.manual]
    if attachments is not None:
        own = attachments.where(F.col("session_id") == session_id)
        out["attachments"] = [r.asDict() for r in own.orderBy("filename").limit(ATTACHMENT_LIMIT).collect()]
        out["attachments_total"] = own.count()
    return out


def with_tags(rows: DataFrame, tags: DataFrame, key: str = "id", most: int = 6) -> DataFrame:
    """rows (a short list) with a column tags: manual ones first, then by score."""
    own = tags.join(rows.select(F.col(key).alias("session_id")), "session_id", "left_semi")
    order = F.struct((-F.col("manual")).alias("m"), (-F.col("score")).alias("s"), "tag")
    listed = own.groupBy(F.col("session_id").alias(key)).agg(F.transform(F.slice(F.array_sort(F.collect_list(order)), 1, most), lambda t: t["tag"]).alias("tags"))
    return rows.join(listed, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def list_recent(archive: Archive, limit: int = 10, source: str | None = None, repo: str | None = None) -> DataFrame:
    """The newest visible sessions, 1 to 50, with their tags."""
    rows = archive.browse("recent", max(1, min(limit, 50)), source=source, repo=repo)
    when = S.effective()
    return with_tags(rows, archive.tags).orderBy(when.desc(), "id")


def snippet_languages(archive: Archive, most: int = 40) -> DataFrame:
    """language, n of visible sessions' code blocks; the shells' names count together as shell, too."""
    code = S.visible(archive.sessions, archive.disabled).select(F.explode("turns").alias("t")).select(F.explode("t.code_blocks").alias("c"))
    named = code.select(F.lower(F.trim("c.language")).alias("language")).where(F.coalesce("language", F.lit("")) != "")
    each = named.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    shells = each.where(F.col("language").isin(*SHELLS)).agg(F.sum("n").alias("n")).where("n is not null").select(F.lit("*shell").alias("language"), "n")
    return each.unionByName(shells).orderBy(F.desc("n"), "language").limit(most)


def stats(archive: Archive) -> DataFrame:
    """One row: visible sessions, turns, words of the texts, repositories, sources, tags, code blocks, first and last day."""
    shown = S.visible(archive.sessions, archive.disabled)
    said = F.concat_ws(" ", F.flatten(F.transform("turns", lambda t: F.array(t["user_message"], t["assistant_response"]))))
    code = F.aggregate("turns", F.lit(0), lambda n, t: n + F.coalesce(F.size(t["code_blocks"]), F.lit(0)))
    day = F.substring(S.effective(), 1, 10)
    per = shown.select("id", "repository", "source", F.size("turns").alias("t"), F.size(F.split(F.trim(said), r"\s+")).alias("w"), code.alias("c"), day.alias("day"))
    whole = per.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("t"), F.lit(0)).alias("turns"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"), F.coalesce(F.sum("c"), F.lit(0)).alias("code_blocks"), F.count_distinct("repository").alias("repositories"), F.count_distinct("source").alias("sources"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    tags = archive.tags.join(shown.select(F.col("id").alias("session_id")), "session_id", "left_semi").agg(F.count_distinct("tag").alias("tags"))
    key = F.lit(1).alias("one__")  # two single rows
    return whole.withColumn("one__", key).join(tags.withColumn("one__", key), "one__").drop("one__")
