"""Saved collection rules: validation and resolution."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date

MODES = ("hybrid", "semantic", "keyword")
SORTS = ("recent", "oldest", "turns", "title")
MOST_TAGS, TAG_CHARS = 20, 40
#: Ranked rules keep this many sessions and say if there were more.
RANKED_CAP = 500


class RuleError(ValueError):
    """A rule that can't be stored; the message says why."""


@dataclass(frozen=True)
class Rule:
    q: str | None = None
    mode: str = "hybrid"
    repo: str | None = None
    source: str | None = None
    tags: tuple[str, ...] = ()
    date_from: date | None = None
    date_to: date | None = None
    sort: str = "recent"

    @property
    def empty(self) -> bool:
        return not (self.q or self.repo or self.source or self.tags or self.date_from or self.date_to)

    @property
    def ranked(self) -> bool:
        """Whether membership is a capped ranking; filters and keywords give complete sets."""
        return bool(self.q) and self.mode != "keyword"


def _day(value: object, name: str) -> date | None:
    if value in (None, ""):
        return None
    try:
        return value if isinstance(value, date) else date.fromisoformat(str(value))
    except ValueError:
        raise RuleError(f"{name} is no date") from None


def parse(raw: dict) -> Rule:
    """A validated rule; the old key limit is ignored, other unknown keys are errors."""
    own = {k: v.strip() if isinstance(v, str) else v for k, v in raw.items() if k != "limit"}
    if unknown := set(own) - {f.name for f in fields(Rule)}:
        raise RuleError(f"unknown keys: {', '.join(sorted(unknown))}")
    tags: list[str] = []
    for tag in own.get("tags") or ():
        clean = " ".join(str(tag).lower().split())
        if len(clean) > TAG_CHARS:
            raise RuleError(f"a tag has at most {TAG_CHARS} characters")
        if clean and clean not in tags:
            tags.append(clean)
    if len(tags) > MOST_TAGS:
        raise RuleError(f"at most {MOST_TAGS} tags")
    rule = Rule(own.get("q") or None, own.get("mode") or "hybrid", own.get("repo") or None, own.get("source") or None, tuple(tags), _day(own.get("date_from"), "date_from"), _day(own.get("date_to"), "date_to"), own.get("sort") or "recent")
    if rule.mode not in MODES or rule.sort not in SORTS:
        raise RuleError("unknown mode or sort")
    if rule.date_from and rule.date_to and rule.date_from > rule.date_to:
        raise RuleError("date_from must not be after date_to")
    return rule
