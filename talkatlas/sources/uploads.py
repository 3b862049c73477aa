"""Uploads, attachments and imports of exported files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkatlas.functions import text as X
from talkatlas.operators import lifecycle as L

MOST_CHARS = 5_000_000
MOST_BYTES = 512 * 1024


def documents(spark: SparkSession, path: str, glob: str = "*", recent: bool = False) -> DataFrame:
    """Text files as documents: UTF-8, or Latin-1 where the bytes are no UTF-8; clipped to MOST_CHARS."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf8, F.decode("content", "ISO-8859-1"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select(F.sha2("content", 256).alias("sha256"), name.alias("filename"), F.col("length").alias("size_bytes"), F.substring(X.strip_controls(text), 1, MOST_CHARS).alias("content"), F.col("modificationTime").alias("modified"))
    return rows.select(F.concat(F.lit("doc-"), F.substring("sha256", 1, 16)).alias("id"), "sha256", "filename", "size_bytes", "content", "modified", X.title_from(F.col("content")).alias("title"))


def document_chunks(docs: DataFrame) -> DataFrame:
    """id, turn_index (the chunk's number) and content of documents."""
    return docs.select("id", F.posexplode(X.chunk_windows(F.col("content"))).alias("turn_index", "content"))


def attachments(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """Files up to `most` bytes by content address: one row for equal contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most)
    rows = files.select(F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content")
    return rows.groupBy("sha256").agg(F.min("size_bytes").alias("size_bytes"), F.min("filename").alias("filename"), F.any_value("content").alias("content"))


def verified(stored: DataFrame) -> DataFrame:
    """stored attachments whose bytes still have their digest and size."""
    return stored.where((F.sha2("content", 256) == F.col("sha256")) & (F.octet_length("content") == F.col("size_bytes")))


def orphans(blobs: DataFrame, used: DataFrame, key: str = "sha256") -> DataFrame:
    """blobs that no record uses."""
    return blobs.join(used.select(key), key, "left_anti")


def import_exports(stored: DataFrame, parsed: list[Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, int]]:
    """(the new table, counts): the first reader that yields sessions wins; known contents are skipped."""
    counts = {"matched": 0, "added": 0, "updated": 0, "skipped": 0, "imported": 0}
    for read in parsed:
        fresh = read().where("turn_count > 0")
        n = fresh.count()
        if not n:
            continue
        new = L.changed(fresh, stored, "id", "content_hash")
        changed = new.count()
        updated = new.join(stored.select("id"), "id", "left_semi").count()
        counts = {"matched": 1, "added": changed - updated, "updated": updated, "skipped": n - changed, "imported": changed}
        return L.upsert(stored, new, "id"), counts
    return stored, counts
