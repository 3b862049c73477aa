"""The archive: its tables, and the operations that a user calls.

An Archive holds DataFrames: sessions (canonical records), tags, chunks, vectors,
collections' overrides. Every operation composes the operators and returns a DataFrame;
only texts for display (an export, a list of hits) are made of few collected rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkatlas.functions import embed as E
from talkatlas.functions import stemming
from talkatlas.functions import text as X
from talkatlas.functions import topics as T
from talkatlas.operators import analytics as A
from talkatlas.operators import index as I
from talkatlas.operators import lifecycle as L
from talkatlas.operators import ranking as R
from talkatlas.operators import scope as S
from talkatlas.plans.rules import RANKED_CAP, Rule
from talkatlas.sources.canonical import chunks as chunk_windows

_INDEXED = ("content", "title", "tags")


@dataclass
class Archive:
    sessions: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    tags: DataFrame
    disabled: tuple[str, ...] = ()
    dim: int = E.DIM
    tombstones: DataFrame | None = field(default=None)
    index: I.Index | None = field(default=None)

    @classmethod
    def build(cls, sessions: DataFrame, dim: int = E.DIM, most: int = 40, disabled: tuple[str, ...] = ()) -> Archive:
        """Chunks, vectors (of `most` chunks a session, evenly sampled) and tags of sessions."""
        parts = chunk_windows(sessions).withColumnRenamed("session", "session_id")
        place = F.col("turn_index") * 1_000_000 + F.col("part")
        chunks = parts.withColumn("chunk_id", F.xxhash64("session_id", "turn_index", "part")).withColumn("place", place)
        sampled = R.evenly_sampled(chunks, "session_id", "place", most)
        vectors = E.embed(sampled, "chunk_id", "content", dim).join(sampled.select("chunk_id", "session_id"), "chunk_id")
        tags = T.keyphrases(T.segments(sessions)).select(F.col("id").alias("session_id"), "tag", "score", F.lit(0).alias("manual"))
        return cls(sessions, chunks, vectors, tags, disabled, dim)

    # --- scopes ---------------------------------------------------------------------

    def scoped(self, repo: str | None = None, source: str | None = None, tags: tuple[str, ...] = (), date_from: str | None = None, date_to: str | None = None, only_ids: DataFrame | list | None = None, only_hidden: bool = False) -> DataFrame:
        rows = S.visible(self.sessions, self.disabled, only_hidden)
        if repo:
            rows = rows.where(F.col("repository") == repo)
        if source:
            rows = rows.where(F.col("source") == source)
        if date_from or date_to:
            rows = rows.where(S.between_days(X.instant(S.effective()), date_from, date_to))
        if tags:
            rows = S.with_all_tags(rows, self.tags.withColumnRenamed("session_id", "id"), tags, "id")
        return rows if only_ids is None else S.within_ids(rows, only_ids, "id")

    def browse(self, sort: str = "recent", limit: int = 50, **scope) -> DataFrame:
        when = S.effective()
        orders = {
            "recent": [when.desc(), F.asc("id")],
            "oldest": [when.asc_nulls_last(), F.asc("id")],
            "turns": [F.desc("turn_count"), F.asc("id")],
            "duration": [F.desc_nulls_last("duration_seconds"), F.desc("turn_count"), when.asc(), F.asc("id")],
            "title": [F.lower("title").asc(), F.asc("id")],
        }
        return self.scoped(**scope).orderBy(*orders.get(sort, orders["recent"])).limit(limit)

    # --- search -----------------------------------------------------------------------

    def _indexed_texts(self) -> DataFrame:
        """chunk_id, content, title, tags (joined by blanks): what the keyword index holds of each chunk."""
        tags = self.tags.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"))
        titles = self.sessions.select(F.col("id").alias("session_id"), "title").join(tags, "session_id", "left")
        return self.chunks.join(titles, "session_id").select("chunk_id", "content", "title", "tags")

    def indexed(self, path: str) -> Archive:
        """With a stemmed keyword index of content, titles and tags, written at path (or found there). Mutations
        of chunks, titles or tags want a new path."""
        return replace(self, index=I.write(self._indexed_texts(), "chunk_id", list(_INDEXED), path, "stemmed"))

    def _keyword(self, query: str, within: DataFrame | None, content_only: bool) -> DataFrame:
        """chunk_id and score; without an index each call reads all texts."""
        match = ["content"] if content_only else None
        if self.index is not None:
            return self.index.bm25(query, within, match)
        return stemming.stemmed_bm25(self._indexed_texts(), query, "chunk_id", list(_INDEXED), within=within, match=match)

    def _ranked_lanes(self, query: str, mode: str, within: DataFrame, n: int, content_only: bool = False) -> list[DataFrame]:
        """Ranked chunks (chunk_id, rank) of `within` (frame of sessions) by words and by vectors, as the mode has it.
        The scope comes before the cut: a chunk outside it takes no place."""
        ids = within.select(F.col("id").alias("session_id"))
        lanes = []
        if mode in ("hybrid", "keyword"):
            allowed = self.chunks.join(ids, "session_id", "left_semi").select("chunk_id")
            lanes.append(self._keyword(query, allowed, content_only))
        if mode in ("hybrid", "semantic"):
            own = self.vectors.join(ids, "session_id", "left_semi")
            lanes.append(R.nearest(own, E.vector(query, self.dim).tolist(), "chunk_id"))
        return [R.ranked(x, "score", "chunk_id", n) for x in lanes]

    def _lanes(self, query: str, mode: str, within: DataFrame, n: int) -> DataFrame:
        """chunk_id and fused score of the chunks of `within`."""
        return R.fuse(self._ranked_lanes(query, mode, within, n), "chunk_id")

    def search(self, query: str, mode: str = "hybrid", limit: int = 30, sort: str = "recent", **scope) -> DataFrame:
        """Sessions by their best chunk: the session's columns, score (1 for the best) and snippet."""
        if not (query or "").strip():
            return self.browse(sort, limit, **scope).withColumns({"score": F.lit(None).cast("double"), "snippet": F.lit("")})
        within = self.scoped(**scope)
        hits = self._lanes(query, mode, within, limit * R.OVER_FETCH).join(self.chunks.select("chunk_id", "session_id", "content"), "chunk_id")
        best = R.best_per_group(hits.select("session_id", "chunk_id", "score", "content"), "session_id", "score", "chunk_id")
        top = R.normalised(R.top(best, "score", "session_id", limit))
        out = within.join(F.broadcast(top.withColumnRenamed("session_id", "id")), "id").withColumn("snippet", X.snippet(F.col("content"), query)).drop("chunk_id", "content")
        when = S.effective()
        order = {"oldest": [when.asc_nulls_last()], "turns": [F.desc("turn_count")], "title": [F.lower("title").asc()]}.get(sort, [F.desc("score")])
        return out.orderBy(*order, F.asc("id"))

    def passages(self, query: str, limit: int = 40, per_session: int = 3, recency: str = "none", recent_sessions: int = 20, mode: str = "hybrid", **scope) -> DataFrame:
        """Chunks for answering: capped a session; with recency a further lane over the newest sessions."""
        within = self.scoped(**scope)
        n = limit * R.OVER_FETCH
        lanes = self._ranked_lanes(query, mode, within, n, content_only=True)
        if recency != "none":
            newest = within.orderBy(S.effective().desc_nulls_last(), "id").limit(recent_sessions)
            recent = R.fuse(self._ranked_lanes(query, mode, newest, n, content_only=True), "chunk_id")
            lanes.append(R.ranked(recent, "score", "chunk_id", 2 * n))
        scored = R.fuse(lanes, "chunk_id")
        hits = scored.join(self.chunks, "chunk_id").join(within.select(F.col("id").alias("session_id"), S.effective().alias("at")), "session_id")
        order = [F.desc("score"), F.asc("chunk_id")]
        if recency == "latest":  # time comes before the cap and the limit
            order = [F.desc_nulls_last("at"), *order]
        picked = R.cap_per_group(hits, "session_id", order, per_session).orderBy(*order).limit(limit)
        return R.normalised(picked).orderBy(*order)

    def related(self, session_id: str, limit: int = 8) -> DataFrame:
        """Other visible sessions by their best chunk's likeness to the session's mean vector."""
        mean = R.centroids(self.vectors.where(F.col("session_id") == session_id), "session_id").select(X.unit(F.col("centroid")).alias("u")).first()
        shown = S.visible(self.sessions, self.disabled).select(F.col("id").alias("session_id"))
        others = self.vectors.where(F.col("session_id") != session_id).join(shown, "session_id", "left_semi")
        q = F.array(*[F.lit(x) for x in mean.u]) if mean else F.array(*[F.lit(0.0)] * self.dim)
        return others.select("session_id", X.dot(F.col("embedding"), q).alias("score")).groupBy("session_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "session_id").limit(limit if mean else 0)

    # --- collections --------------------------------------------------------------------

    def resolve(self, rule: Rule) -> tuple[DataFrame, bool]:
        """(id of the rule's sessions, whether a ranking was cut)."""
        scope = {"repo": rule.repo, "source": rule.source, "tags": rule.tags, "date_from": rule.date_from and rule.date_from.isoformat(), "date_to": rule.date_to and rule.date_to.isoformat()}
        rows = self.scoped(**scope)
        if rule.empty:
            return rows.select("id").limit(0), False
        if not rule.q:
            return rows.select("id"), False
        if not rule.ranked:
            found = self.index.matches(rule.q) if self.index is not None else self._keyword(rule.q, None, False)
            hit = self.chunks.join(found, "chunk_id", "left_semi").select(F.col("session_id").alias("id")).distinct()
            return rows.join(hit, "id", "left_semi").select("id"), False
        scored = self._lanes(rule.q, rule.mode, rows, (RANKED_CAP + 1) * R.OVER_FETCH).join(self.chunks.select("chunk_id", "session_id"), "chunk_id")
        per = scored.groupBy(F.col("session_id").alias("id")).agg(F.max("score").alias("score"))
        top = R.top(per, "score", "id", RANKED_CAP + 1)
        return R.top(per, "score", "id", RANKED_CAP).select("id"), top.count() > RANKED_CAP

    def members(self, rule: Rule, overrides: DataFrame) -> DataFrame:
        return L.members(self.resolve(rule)[0], overrides, S.visible(self.sessions, self.disabled), "id")

    # --- reports --------------------------------------------------------------------------

    def facets(self) -> dict[str, DataFrame]:
        shown = S.visible(self.sessions, self.disabled)
        own = self.tags.join(shown.select(F.col("id").alias("session_id")), "session_id", "left_semi")
        dates = shown.agg(F.min(F.coalesce("created_at", "updated_at")).alias("first"), F.max(F.coalesce("updated_at", "created_at")).alias("last"))
        return {"repositories": A.facet(shown, "repository"), "sources": A.facet(shown, "source"), "tags": A.facet(own, "tag", 40), "dates": dates}

    def usage(self, by: str = "day") -> DataFrame:
        rows = S.visible(self.sessions, self.disabled)
        keys = {"day": F.substring(S.effective(), 1, 10).alias("day"), "model": F.col("model"), "repository": F.col("repository"), "source": F.col("source")}
        sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("turn_count", "input_tokens", "output_tokens", "premium_requests")]
        per = rows.groupBy(keys[by]).agg(F.count(F.lit(1)).alias("sessions"), *sums, F.round(F.sum(F.coalesce("est_cost_usd", F.lit(0.0))), 2).alias("cost"))
        if by == "day":
            return per.where("day is not null").orderBy("day")
        return per.withColumn(by, A.labelled(F.col(by))).orderBy(F.desc("cost"), F.desc("sessions"), by).limit(12)

    def snippets(self, language: str | None = None, needle: str | None = None, limit: int = 100) -> DataFrame:
        shown = S.visible(self.sessions, self.disabled)
        turns = shown.select("id", S.effective().alias("at"), F.explode("turns").alias("t"))
        code = turns.select("id", "at", "t.turn_index", F.explode("t.code_blocks").alias("c")).select("id", "at", "turn_index", F.lower("c.language").alias("language"), "c.content")
        if language:
            code = code.where(F.col("language") == language.lower())
        if needle:
            code = code.where(S.contains_text(F.col("content"), needle))
        return code.orderBy(F.desc_nulls_last("at"), "id", F.desc("turn_index"), "content").limit(max(1, min(limit, 300)))

    # --- mutations: each gives a new archive -------------------------------------------------

    def hide(self, ids: list[str], hidden: bool = True) -> Archive:
        return replace(self, sessions=self.sessions.withColumn("hidden", F.when(F.col("id").isin(ids), hidden).otherwise(F.col("hidden"))))

    def purge(self, ids: list[str]) -> Archive:
        gone = self.sessions.where(F.col("id").isin(ids)).select("id", "source", "content_hash")
        buried = gone if self.tombstones is None else self.tombstones.unionByName(gone)
        keep = lambda df, key: df.where(~F.col(key).isin(ids))
        return replace(self, sessions=keep(self.sessions, "id"), chunks=keep(self.chunks, "session_id"), vectors=keep(self.vectors, "session_id"), tags=keep(self.tags, "session_id"), tombstones=buried, index=None)

    def tag(self, session_id: str, name: str) -> Archive:
        new = self.tags.sparkSession.createDataFrame([(session_id, name, 100.0, 1)], "session_id string, tag string, score double, manual int").withColumn("tag", X.normalise_tag(F.col("tag")))
        return replace(self, tags=L.upsert(self.tags, new.select(self.tags.columns), ["session_id", "tag"]), index=None)

    def untag(self, session_id: str, name: str) -> Archive:
        """Without the tag; the index is made anew at need, so that it doesn't find the session by it."""
        clean = X.normalise_tag(F.lit(name))
        return replace(self, tags=self.tags.where(~((F.col("session_id") == session_id) & (F.col("tag") == clean))), index=None)
