"""Feature-hash embeddings: words, word pairs and parts of words, hashed to signed buckets.

The vectors equal those of a given public convention (blake2b of eight bytes: the first four
name the bucket, the fifth's lowest bit the sign, the last token of a bucket wins), so
they are made in Arrow batches; there is no such hash in SQL."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DIM = 1024
_WORD = re.compile(r"[a-z0-9_]+")


def tokens(text: str, stop: frozenset[str] = frozenset()) -> Iterator[str]:
    """Words of two signs or more, adjacent pairs, and every second 3-, 4- and 5-gram of the joined words."""
    words = [w for w in _WORD.findall(text.lower()) if len(w) > 1 and w not in stop]
    yield from words
    yield from ("_".join(p) for p in pairwise(words))
    line = " ".join(words)
    for size in (3, 4, 5):
        for at in range(0, len(line) - size + 1, 2):
            yield "#" + line[at : at + size]


def vector(text: str | None, dim: int = DIM, stop: frozenset[str] = frozenset()) -> np.ndarray:
    """A unit vector, or zeros for a text without tokens."""
    bucket, sign = [], {}
    for t in tokens(text or "", stop):
        digest = hashlib.blake2b(t.encode(), digest_size=8).digest()
        b = int.from_bytes(digest[:4], "little") % dim
        bucket.append(b)
        sign[b] = 1.0 if digest[4] & 1 else -1.0
    out = np.zeros(dim)
    if bucket:
        at, count = np.unique(bucket, return_counts=True)
        out[at] = [sign[b] for b in at.tolist()]
        out[at] *= 1.0 + np.log(count)
        out /= np.linalg.norm(out)
    return out.astype(np.float32)


def embed(rows: DataFrame, key: str, text: str, dim: int = DIM, stop: frozenset[str] = frozenset()) -> DataFrame:
    """key and embedding of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.concatenate([vector(t.as_py(), dim, stop) for t in batch.column(1)]) if batch.num_rows else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), pa.array(flat, pa.float32()))], names=[key, "embedding"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def fingerprint(dim: int = DIM, version: int = 1) -> str:
    """What a stored vector depends on, as canonical JSON."""
    import json

    return json.dumps({"schema": 1, "kind": "builtin", "backend": "feature-hash", "dim": dim, "algorithm": version}, sort_keys=True)


