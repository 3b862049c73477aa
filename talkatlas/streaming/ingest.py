"""Incremental ingest and event-time extensions on Structured Streaming."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkatlas.operators import lifecycle as L


def retry_delay(attempt: int, base: float = 5.0, cap: float = 300.0, jitter: Callable[[], float] = lambda: random.uniform(0.9, 1.1)) -> float:
    """Capped exponential back-off."""
    return min(cap, base * 2 ** max(0, attempt - 1)) * jitter()


@dataclass
class Manifest:
    """The vector index's state: a fingerprint is the target until its vectors are complete, then active."""

    active: str | None = None
    target: str | None = None
    generation: int = 0
    pending: int = 0
    signatures: dict[str, str] = field(default_factory=dict)

    def dirty(self) -> None:
        self.target = self.target or self.active

    def prepare(self, fingerprint: str) -> bool:
        """True if vectors must be written for this fingerprint."""
        if self.active == fingerprint and self.target is None:
            return False
        self.target = fingerprint
        return True

    def activate(self, fingerprint: str, chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> int:
        """Makes the target active if every chunk has its vector; returns the new generation."""
        if self.target not in (None, fingerprint):
            raise ValueError("another fingerprint is the target")
        own = vectors.where(F.col("fingerprint") == fingerprint)
        missing = chunks.join(own, key, "left_anti").count()
        if missing:
            raise ValueError(f"{missing} chunks lack a vector")
        self.active, self.target, self.pending = fingerprint, None, 0
        self.generation += 1
        return self.generation

    def to_json(self) -> str:
        return json.dumps(self.__dict__)


def sync(fresh: DataFrame, stored: DataFrame, tombstones: DataFrame, key: str = "id", signature: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """(the new table, counts by status): buried and unchanged rows are skipped, others upserted."""
    live = L.not_buried(fresh, tombstones, key)
    new = L.changed(live, stored, key, signature)
    known = stored.select(key, F.lit(True).alias("known__"))
    status = live.join(new.select(key, F.lit(True).alias("new__")), key, "left").join(known, key, "left")
    label = F.when(F.col("new__").isNull(), "skipped").when(F.col("known__").isNull(), "added").otherwise("updated")
    return L.upsert(stored, new, key), status.groupBy(label.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def watch(spark: SparkSession, path: str, schema: str, into: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, fmt: str = "json") -> StreamingQuery:
    """Files that appear under path, in micro-batches handed to `into` (exactly once by
    checkpoint). Without `every` what is there is processed and the query ends."""
    stream = spark.readStream.format(fmt).schema(schema).load(path)
    writer = stream.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Extension: counts and sums of `value` by window; batch or stream."""
    events = events.withWatermark(ts, late) if events.isStreaming else events
    out = events.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "v")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str = "1 day") -> DataFrame:
    """Extension: runs of a key's events no further apart than gap."""
    events = events.withWatermark(ts, late) if events.isStreaming else events
    out = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def turn_builder(events: DataFrame, session: str = "session") -> DataFrame:
    """Extension: turns from a stream of (session, pos, role, text): a user message closes the
    turn before it. State is one open turn for each session."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    schema = f"{session} string, turn_index int, user_message string, assistant_response string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, user, reply = state.get if state.exists else (0, None, "")
        done = []
        rows = pd.concat(list(frames)).sort_values("pos")
        for role, text in zip(rows["role"], rows["text"], strict=True):
            if role == "user":
                if user is not None or reply:
                    done.append((key[0], index, user or "", reply))
                    index += 1
                user, reply = text, ""
            elif role == "assistant":
                reply = f"{reply}\n\n{text}" if reply else text
        state.update((index, user, reply))
        yield pd.DataFrame(done, columns=[x.split()[0] for x in schema.split(", ")])

    return events.groupBy(session).applyInPandasWithState(step, schema, "i int, user string, reply string", "append", GroupStateTimeout.NoTimeout)
