"""Questions about the archive: what is asked for, of when and where, and how evidence is made.

Planning is a pure function on the driver. A question becomes a row of words. A small grammar
reads it from the left: a head (a request and what it is for) gives the intent, scopes (days, recency,
a repository) are marked wherever they stand, and the words that are left over, without the
ones that say nothing, are the topic. Evidence is gathered by DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkatlas.functions import text as X


@dataclass(frozen=True)
class Plan:
    query: str
    repository: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    recency: str = "none"
    intent: str = "lookup"


# Words that say nothing about a topic.
_STOP = frozenset(
    """a about an and are did do for from he her hers him his how i in is it its me my of on our please session sessions she show tell
    the their theirs them they this to took us was we were what when where which who why you your""".split()
)

# --- the grammar: a rule is a row of steps, a step a set of words; "?" after a step makes it optional ---

_THINGS = "conversation|conversations|session|sessions|chat|chats"
_LINK = "about|on|matching|related to"


def _step(words: str, optional: bool = False) -> tuple[tuple[tuple[str, ...], ...], bool]:
    return tuple(tuple(w.split()) for w in words.split("|")), optional


def _rule(*steps: str) -> list[tuple[tuple[tuple[str, ...], ...], bool]]:
    return [_step(s.rstrip("?"), s.endswith("?")) for s in steps]


_POLITE = [_rule("please"), _rule("can|could|would|will", "you")]
_AND = _rule("and")
_OUT = _rule("find out")
_SEEK = "find|search for|search|look up|look for|look-up|lookup"
_FINDS = [_rule(_SEEK, "me?", "my?", _THINGS, _LINK), _rule(_SEEK), _rule("show|list", "me?", "my?", _THINGS, _LINK)]
_NOUN = "summary of|overview of|summary|overview"
_SUMMARIES = [
    _rule("summarize|summarise", "my?"),
    _rule("give|show", "me", "a|an|the?", _NOUN),
    _rule("a|an|the?", _NOUN),
    _rule("what", "were|are", "the", "main", "topics", "in this collection|in the collection?"),
]
_WORKED = "work on|worked on|do|done"
_ACTIVITIES = [
    _rule("tell me|show me?", "what", "did|have", "i", _WORKED),
    _rule("tell me|show me?", "what", "i ve|i have|i", "worked on|did|done"),
]
_JOBS = "problem|problems|session|sessions|conversation|conversations"
_LONGEST = [
    _rule("which|what", "recent|latest?", _JOBS, "took|take", "me?", "the?", "longest|most time", "to solve?"),
    _rule("show|list", "me?", "the?", "recent|latest?", "longest", _JOBS),
]
#: Scope words and the recency that they ask for.
_RECENCY = [(_rule("most recent|latest|newest"), "latest"), (_rule("recent|recently"), "boost")]
_TAIL = ("archive", "collection", "conversation", "conversations", "history", "session", "sessions")
_MOST_DAYS = 365

#: Fixed value: what counts as one word of a question.
_WORD = re.compile(r"[A-Za-z0-9_./-]+")


def _read(rule: list, words: list[str], at: int) -> int | None:
    """Where the rule's match that begins at this place ends; the longest alternatives first."""
    if not rule:
        return at
    options, optional = rule[0]
    for phrase in sorted(options, key=len, reverse=True):
        if tuple(words[at : at + len(phrase)]) == phrase:
            end = _read(rule[1:], words, at + len(phrase))
            if end is not None:
                return end
    return _read(rule[1:], words, at) if optional else None


def _first(rules: list, words: list[str], at: int) -> int | None:
    """The furthest end among the rules that match at this place."""
    ends = [e for r in rules if (e := _read(r, words, at)) is not None and e > at]
    return max(ends) if ends else None


def _request(words: list[str]) -> tuple[str, int, list[int], bool]:
    """(intent, where the topic begins, further words of the request, whether own work is asked for)."""
    at = 0
    while (end := _first(_POLITE, words, at)) is not None:
        at = end
    out = _read(_OUT, words, at)
    begun = at
    while _read(_OUT, words, at) is None:
        end = _first(_FINDS, words, at)
        if end is None and at > begun and (skipped := _read(_AND, words, at)) is not None:
            end = _first(_FINDS, words, skipped)
        if end is None:
            break
        at = end
    if at > begun:
        return "find", at, [], False
    at = begun if out is None else out
    for place in range(at, len(words)):
        if (end := _first(_LONGEST, words, place)) is not None:
            return "duration", at, list(range(place, end)), False
    if (end := _first(_SUMMARIES, words, at)) is not None:
        return "summary", end, [], False
    if (end := _first(_ACTIVITIES, words, at)) is not None:
        return "lookup", end, [], True
    return "lookup", at, [], False


def _days(words: list[str], today: date) -> tuple[tuple[str, str] | None, set[int]]:
    """(first and last day, the words that say so); of several scopes the nearest day wins."""
    found: list[tuple[int, tuple[str, str] | None]] = []
    marked: set[int] = set()
    back = lambda n: (today - timedelta(days=n)).isoformat()
    for i, w in enumerate(words):
        one, two = (words[i + 1 : i + 2] or [""])[0], (words[i + 2 : i + 3] or [""])[0]
        if w in ("today", "yesterday"):
            day = back(int(w == "yesterday"))
            found.append((int(w == "yesterday"), (day, day)))
            marked.add(i)
        elif w in ("past", "last") and one == "week":
            found.append((2, (back(6), back(0))))
            marked |= {i, i + 1}
        elif w in ("past", "last") and one.isdecimal() and two in ("day", "days"):
            found.append((3, (back(min(max(int(one), 1), _MOST_DAYS) - 1), back(0))))
            marked |= {i, i + 1, i + 2}
        elif w == "since" and re.fullmatch(r"\d{4}-\d{2}-\d{2}", one):
            marked |= {i, i + 1}
            try:
                found.append((4, (date.fromisoformat(one).isoformat(), back(0))))
            except ValueError:
                found.append((5, None))
    return (min(found, key=lambda f: f[0])[1] if found else None), marked


def _repository(question: str, names: list[str]) -> tuple[str | None, set[int]]:
    """The only repository that the question names, and the signs that do; a name inside a longer
    named one doesn't count."""
    low = question.lower()
    places: dict[str, set[int]] = {}
    taken: set[int] = set()
    edge = re.compile(r"[\w-]")
    for name in sorted(set(names), key=lambda n: (-len(n), n)):
        at = low.find(name.lower())
        while at >= 0 and name:
            end = at + len(name)
            free = not (at and edge.match(low[at - 1])) and not (end < len(low) and edge.match(low[end]))
            if free and not taken >= set(range(at, end)):
                places.setdefault(name, set()).update(range(at, end))
            at = low.find(name.lower(), at + 1)
        taken |= places.get(name, set())
    if len(places) != 1:
        return None, set()
    return places.popitem()


def plan(question: str, now: datetime | None = None, repositories: list[str] = ()) -> Plan:
    """Intent (find, duration, summary, lookup), topic words, dates, recency, repository."""
    today = (now or datetime.now(timezone.utc)).astimezone(timezone.utc).date()
    repository, signs = _repository(question, list(repositories))
    spans = [(m.start(), m[0]) for m in _WORD.finditer(question)]
    words = [w.lower().rstrip(".-") for _, w in spans]
    intent, begin, request, own_work = _request(words)
    days, said = _days(words, today)
    recency = "none"
    for i in range(len(words)):
        for rule, kind in _RECENCY:
            if (end := _read(rule, words, i)) is not None:
                said |= set(range(i, end))
                recency = "latest" if "latest" in (kind, recency) else kind
    dropped = said | set(range(begin)) | set(request) | {i for i, (a, w) in enumerate(spans) if signs & set(range(a, a + len(w)))}
    left = []
    for i, (_, w) in enumerate(spans):
        empty = words[i] in _STOP and w not in ("IT", "US")
        if i in dropped or empty or (intent in ("summary", "duration") and words[i] in _TAIL):
            continue
        left.append(w.lower())
    if own_work and not left:
        intent = "summary"
    first, last = days or (None, None)
    return Plan(" ".join(left), repository, first, last, recency, intent)


def scope_of(p: Plan) -> dict[str, str | None]:
    """The plan's filters as arguments of the archive's operations."""
    return {"repo": p.repository, "date_from": p.date_from, "date_to": p.date_to}


def without_dates(p: Plan) -> Plan:
    return replace(p, date_from=None, date_to=None)


# --- evidence ---------------------------------------------------------------------------


def longest(sessions: DataFrame, n: int = 5) -> DataFrame:
    """The answer to a duration question: the sessions that took longest, as list lines."""
    top = sessions.where("duration_seconds is not null").orderBy(F.desc("duration_seconds"), "id").limit(n)
    return top.select("id", "title", "duration_seconds", F.concat(F.lit("- "), "title", F.lit(": "), X.duration_label(F.col("duration_seconds"))).alias("line"))


def relevant(rows: DataFrame, floor: float = -8.0, score: str = "rerank") -> DataFrame:
    """rows that a reranker scored at least the floor; rows that it didn't score stay."""
    return rows.where(F.col(score).isNull() | (F.col(score) >= floor))


def reranked(rows: DataFrame, key: str, scorer: Callable[[DataFrame], DataFrame] | None, floor: float = -8.0) -> DataFrame:
    """rows in a column order, best first: by the scorer's (key, rerank), or, without one, by the score they have."""
    if scorer is None:
        return rows.withColumn("rerank", F.lit(None).cast("double")).withColumn("order", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc(key))))
    scored = relevant(rows.join(scorer(rows), key, "left"), floor)
    return scored.withColumn("order", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("rerank"), F.desc("score"), F.asc(key))))


def best_sessions(passages: DataFrame, n: int) -> DataFrame:
    """session_id, score: sessions by their best passage, n at most."""
    score = F.coalesce("rerank", "score") if "rerank" in passages.columns else F.col("score")
    return passages.groupBy("session_id").agg(F.max(score).alias("score")).orderBy(F.desc("score"), "session_id").limit(n)


def with_neighbours(passages: DataFrame, sessions: DataFrame, radius: int = 1, cap: int = 800) -> DataFrame:
    """passages (session_id, turn_index) with column around: the turns within radius, in order, clipped."""
    turns = sessions.select(F.col("id").alias("session_id"), F.explode("turns").alias("t")).select("session_id", F.col("t.turn_index").alias("near"), F.concat_ws("\n", "t.user_message", "t.assistant_response").alias("said"))
    wanted = passages.select("session_id", "turn_index", F.explode(F.sequence(F.col("turn_index") - radius, F.col("turn_index") + radius)).alias("near")).distinct()
    found = wanted.join(turns, ["session_id", "near"]).groupBy("session_id", "turn_index").agg(F.array_sort(F.collect_list(F.struct("near", X.truncate(F.col("said"), cap).alias("said")))).alias("x"))
    return passages.join(found.select("session_id", "turn_index", F.transform("x", lambda r: r["said"]).alias("around")), ["session_id", "turn_index"], "left")


def distinct_passages(passages: DataFrame) -> DataFrame:
    """Of passages with the same text in a session and role, the best."""
    best = F.max_by(F.struct(*passages.columns), F.struct("score", -F.col("chunk_id")))
    return passages.groupBy("session_id", "role", F.md5(F.col("content").cast("binary")).alias("digest__")).agg(best.alias("r")).select("r.*")


def session_context(sessions: DataFrame, ids: DataFrame, turns: int = 6, cap: int = 600) -> DataFrame:
    """One record a session of ids (session_id): title, repository, source, day, summary, and its first and last turns, clipped."""
    chosen = sessions.join(ids.select(F.col("session_id").alias("id")).distinct(), "id", "left_semi")
    n = F.size("turns")
    head, tail = (turns + 1) // 2, turns // 2
    some = F.when(n <= turns, F.col("turns")).otherwise(F.concat(F.slice("turns", F.lit(1), F.lit(head)), F.slice("turns", n - tail + 1, F.lit(tail))))
    said = F.transform(some, lambda t: F.struct(t["turn_index"].alias("turn"), X.truncate(t["user_message"], cap).alias("user"), X.truncate(t["assistant_response"], cap).alias("assistant")))
    extra = [F.col(c) for c in ("summary",) if c in sessions.columns]
    return chosen.select("id", "title", "repository", "source", F.substring(F.coalesce("updated_at", "created_at"), 1, 10).alias("day"), *extra, n.alias("turns_total"), said.alias("turns"))


def encoded_size(record: dict) -> int:
    """Bytes of a record as JSON that is safe inside a page."""
    return len(json.dumps(record, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").encode())


def context_budget(window: int = 16384, answer: int = 2048, overhead: int = 512, bytes_per_token: int = 3) -> int:
    """Bytes of evidence that fit a model's window beside its answer and the instructions."""
    return max(0, window - answer - overhead) * bytes_per_token


def shortened(record: dict, field: str, budget: int) -> dict | None:
    """record with the longest beginning of a text field that fits the budget (found by bisection); None if none does."""
    if encoded_size(record) <= budget:
        return record
    text, low, high = record[field], 0, len(record[field])
    while low < high:
        middle = (low + high + 1) // 2
        if encoded_size(record | {field: text[:middle] + " …"}) <= budget:
            low = middle
        else:
            high = middle - 1
    return record | {field: text[:low] + " …"} if low else None


def pack(records: list[dict], budget: int, shorten: str | None = None) -> list[dict]:
    """Records in order whose encoded sizes fit the budget; one that doesn't fit is skipped, later ones may.
    With a field to shorten, the first record that doesn't fit whole is cut to what is left."""
    left, out = budget, []
    for r in records:
        fits = r if encoded_size(r) <= left else None
        if fits is None and shorten:
            fits, shorten = shortened(r, shorten, left), None
        if fits is not None:
            out.append(fits | {"citation": len(out) + 1})
            left -= encoded_size(fits)
    return out

