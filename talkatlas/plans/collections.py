"""Saved collections: a table of them, a table of hand-made members, and what an archive makes of both.

Each operation gives new tables (nothing is changed in place); `write` of the caller's
choice keeps them. Collections are few; their members are DataFrames of any size."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkatlas.functions import text as X
from talkatlas.operators import scope as S
from talkatlas.plans.archive import Archive
from talkatlas.plans.rules import Rule, parse
from talkatlas.plans.sessions import with_tags

SCHEMA = "id string, name string, description string, icon string, color string, rule string, pinned boolean, created_at string, updated_at string"
MEMBERS = "collection_id string, session_id string, state string, changed_at string"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def _encoded(raw: dict | None) -> str | None:
    """A rule as stored: validated JSON, or null for a rule that asks for nothing."""
    rule = parse(raw or {})
    if rule.empty:
        return None
    return json.dumps({k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in asdict(rule).items() if v not in (None, ())})


@dataclass
class Collections:
    table: DataFrame
    members_by_hand: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Collections:
        return cls(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], MEMBERS))

    def _spark(self) -> SparkSession:
        return self.table.sparkSession

    def create(self, name: str, rule: dict | None = None, description: str | None = None, icon: str | None = None, color: str | None = None, pinned: bool = False) -> tuple[Collections, str]:
        """(with one more collection, its id). A bad rule is a RuleError."""
        new, now = uuid4().hex, _now()
        row = (new, (name or "").strip() or "Untitled collection", description, icon, color, _encoded(rule), pinned, now, now)
        return replace(self, table=self.table.unionByName(self._spark().createDataFrame([row], SCHEMA))), new

    def update(self, cid: str, **fields) -> Collections:
        """Given fields changed; the others stay. An unknown id changes nothing."""
        if "rule" in fields:
            fields["rule"] = _encoded(fields["rule"])
        if unknown := set(fields) - {"name", "description", "icon", "color", "rule", "pinned"}:
            raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
        own = F.col("id") == cid
        changed = {k: F.when(own, F.lit(v).cast(self.table.schema[k].dataType)).otherwise(F.col(k)) for k, v in fields.items()}
        return replace(self, table=self.table.withColumns(changed | {"updated_at": F.when(own, F.lit(_now())).otherwise(F.col("updated_at"))}))

    def delete(self, cid: str) -> Collections:
        """Without the collection and its hand-made members."""
        return Collections(self.table.where(F.col("id") != cid), self.members_by_hand.where(F.col("collection_id") != cid))

    def set_member(self, cid: str, session_id: str, state: str = "include") -> Collections:
        row = self._spark().createDataFrame([(cid, session_id, "exclude" if state == "exclude" else "include", _now())], MEMBERS)
        rest = self.members_by_hand.where(~((F.col("collection_id") == cid) & (F.col("session_id") == session_id)))
        return replace(self, members_by_hand=rest.unionByName(row))

    def remove_member(self, cid: str, session_id: str) -> Collections:
        """A session that a rule would bring back is excluded; otherwise its row goes."""
        if not self.rule(cid).empty:
            return self.set_member(cid, session_id, "exclude")
        return replace(self, members_by_hand=self.members_by_hand.where(~((F.col("collection_id") == cid) & (F.col("session_id") == session_id))))

    def rule(self, cid: str) -> Rule:
        found = self.table.where(F.col("id") == cid).select("rule").first()
        return parse(json.loads(found.rule)) if found and found.rule else Rule()

    def overrides(self, cid: str) -> DataFrame:
        return self.members_by_hand.where(F.col("collection_id") == cid).select(F.col("session_id").alias("id"), "state")

    def members(self, archive: Archive, cid: str) -> DataFrame:
        """id of every member: the rule's and the included, without the excluded, visible ones only."""
        return archive.members(self.rule(cid), self.overrides(cid))

    def cards(self, archive: Archive, cid: str, offset: int = 0, limit: int | None = None, sort: str = "recent") -> DataFrame:
        """A page of the members' sessions with tags and the summary's beginning as snippet."""
        own = archive.sessions.join(self.members(archive, cid), "id", "left_semi")
        when = S.effective()
        order = {"oldest": [when.asc_nulls_last()], "turns": [F.desc("turn_count")], "title": [F.lower("title").asc()]}.get(sort, [when.desc_nulls_last()])
        page = own.orderBy(*order, "id").offset(offset)
        page = page if limit is None else page.limit(limit)
        lead = F.col("summary") if "summary" in page.columns else F.lit(None).cast("string")
        return with_tags(page, archive.tags).withColumns({"score": F.lit(None).cast("double"), "snippet": X.html_escape(F.substring(F.coalesce(lead, F.lit("")), 1, 240))}).orderBy(*order, "id")

    def containing(self, archive: Archive, session_id: str) -> list[dict]:
        """Every collection, and whether it holds the session, by rule or by hand. Rules are resolved one by one; only the one id is looked for."""
        hand = {(r.collection_id, r.state) for r in self.members_by_hand.where(F.col("session_id") == session_id).collect()}
        out = []
        for row in self.listed().collect():
            inside = not self.members(archive, row.id).where(F.col("id") == session_id).isEmpty()
            out.append({"id": row.id, "name": row["name"], "icon": row.icon, "color": row.color, "member": inside, "manual_include": (row.id, "include") in hand, "manual_exclude": (row.id, "exclude") in hand})
        return out

    def listed(self, kind: str = "all", text: str | None = None) -> DataFrame:
        """Collections, pinned first, then by the last change, then by name. kind: all, auto (with a rule) or manual; text: in name or description."""
        rows = self.table
        if kind in ("auto", "manual"):
            rows = rows.where(F.col("rule").isNotNull() if kind == "auto" else F.col("rule").isNull())
        if text:
            rows = rows.where(S.contains_text(F.coalesce("name", F.lit("")), text) | S.contains_text(F.coalesce("description", F.lit("")), text))
        return rows.orderBy(F.desc("pinned"), F.desc("updated_at"), F.lower("name"), "id")


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: sizes of two member sets, of what they share, and their Jaccard similarity."""
    both = first.select("id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(second.select("id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = both.groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("first"), F.coalesce(F.sum("b"), F.lit(0)).alias("second"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("shared"), (F.count_if((F.col("a") == 1) & (F.col("b") == 1)) / F.count(F.lit(1))).alias("similarity"))

