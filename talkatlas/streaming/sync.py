"""Synchronising sources: what changed, one source at a time, and when to look again.

Three levels are skipped: a source whose fingerprint (a digest of its files' names, sizes and times) is the
acknowledged one, a file whose signature is stored, and a session whose content hash is. A
fingerprint is acknowledged only after its source has been written, so a source that fails is
read again, and does not hold up the others."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkatlas.operators import lifecycle as L

SIGNATURES = "path string, size long, changed_at timestamp"


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size, changed_at of a folder's files; contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed_at"))


def fingerprint(signatures: DataFrame) -> str:
    """A digest of a source's files that doesn't depend on their order: counts and sums of hashes, aggregated."""
    h = F.xxhash64("path", "size", "changed_at").cast("decimal(38,0)")
    g = F.xxhash64(F.lit(1), "path", "size", "changed_at").cast("decimal(38,0)")
    r = signatures.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h"), F.sum(g).alias("g")).first()
    return hashlib.sha256(f"{r.n}|{r.h}|{r.g}".encode()).hexdigest()


def changed_files(found: DataFrame, stored: DataFrame) -> DataFrame:
    """found files whose (path, size, changed_at) isn't stored."""
    return found.join(stored, ["path", "size", "changed_at"], "left_anti")


def vanished_files(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored files that are no longer there."""
    return stored.join(found.select("path"), "path", "left_anti")


@dataclass(frozen=True)
class Source:
    """key; files() lists its signatures; read(files) gives sessions (id, content_hash, ...) of the given files."""

    key: str
    files: Callable[[], DataFrame]
    read: Callable[[DataFrame], DataFrame]
    enabled: bool = True


@dataclass
class State:
    """What has been acknowledged: each source's fingerprint, each file's signature, and each session's hash (tombstones included)."""

    fingerprints: dict[str, str] = field(default_factory=dict)
    signatures: dict[str, DataFrame] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"fingerprints": self.fingerprints}, sort_keys=True)


def sync(sources: list[Source], stored: DataFrame, tombstones: DataFrame | None, state: State, write: Callable[[str, DataFrame], None], rebuild: bool = False) -> dict[str, dict]:
    """Status and counts (added, updated, skipped) of each source. write(key, fresh sessions) keeps what is new;
    state is brought up to date source by source, only where its write came through.

    stored: id, content_hash. Sessions with a tombstone are never written again."""
    out: dict[str, dict] = {}
    for source in sources:
        if not source.enabled:
            out[source.key] = {"status": "disabled"}
            continue
        try:
            found = source.files()
            now = fingerprint(found)
            if not rebuild and state.fingerprints.get(source.key) == now:
                out[source.key] = {"status": "unchanged"}
                continue
            before = state.signatures.get(source.key)
            wanted = found if rebuild or before is None else changed_files(found, before)
            fresh = source.read(wanted)
            if tombstones is not None:
                fresh = L.not_buried(fresh, tombstones, "id")
            new = fresh if rebuild else L.changed(fresh, stored, "id", "content_hash")
            known = stored.select("id", F.lit(True).alias("known__"))
            both = fresh.select("id", "content_hash").join(known, "id", "left")
            told = both.join(new.select("id", F.lit(True).alias("new__")).distinct(), "id", "left")
            n = told.agg(F.count_if(F.expr("new__ is not null and known__ is null")).alias("added"), F.count_if(F.expr("new__ is not null and known__ is not null")).alias("updated"), F.count_if(F.expr("new__ is null")).alias("skipped")).first()
            write(source.key, new)
            state.fingerprints[source.key], state.signatures[source.key] = now, found
            out[source.key] = {"status": "ok", "added": n.added, "updated": n.updated, "skipped": n.skipped}
        except Exception as error:  # noqa: BLE001  one source's fault is its own
            state.fingerprints.pop(source.key, None)
            out[source.key] = {"status": "error", "error": str(error).splitlines()[0] if str(error) else type(error).__name__}
    return out


@dataclass
class Debounce:
    """When to synchronise: a change is acted on once it has been stable for `quiet` seconds, and at the latest
    `most` seconds after it was first seen. A failed pass is tried again after a growing delay."""

    quiet: float = 2.0
    most: float = 30.0
    base_delay: float = 5.0
    most_delay: float = 300.0
    clock: Callable[[], float] = time.monotonic
    acknowledged: str | None = None
    seen: str | None = None
    first_at: float = 0.0
    last_at: float = 0.0
    failures: int = 0
    failed_at: float = 0.0

    def observe(self, value: str) -> bool:
        """Whether a pass is due, given the fingerprint of now."""
        now = self.clock()
        if value == self.acknowledged:
            self.seen = None
            return False
        if self.seen is None:
            self.first_at = now
        if value != self.seen:
            self.seen, self.last_at = value, now
        if self.failures and now < self.failed_at + min(self.base_delay * 2 ** (self.failures - 1), self.most_delay):
            return False
        return now - self.last_at >= self.quiet or now - self.first_at >= self.most

    def succeeded(self, value: str) -> None:
        """Acknowledges the fingerprint that was taken before the pass: later changes stay due."""
        self.acknowledged, self.seen, self.failures = value, None, 0

    def failed(self) -> None:
        self.failures, self.failed_at = self.failures + 1, self.clock()


@dataclass
class Requests:
    """Requests for a pass while one runs become one further pass; a rebuild among them makes it a rebuild."""

    running: bool = False
    waiting: bool = False
    rebuild: bool = False

    def ask(self, rebuild: bool = False) -> bool:
        """True if the caller shall run now."""
        if self.running:
            self.waiting, self.rebuild = True, self.rebuild or rebuild
            return False
        self.running = True
        return True

    def done(self) -> tuple[bool, bool]:
        """(whether another pass is wanted, whether it is a rebuild); that pass counts as running."""
        again, rebuild = self.waiting, self.rebuild
        self.running, self.waiting, self.rebuild = again, False, False
        return again, rebuild
