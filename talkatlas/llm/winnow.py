"""Document fingerprints by winnowing, with positions.

Every k consecutive code points have a rolling hash; of every w consecutive
hashes the smallest is chosen, the rightmost of equals. Any common run of at
least w + k - 1 code points thus shares a chosen hash, and the kept positions
say where. A text shorter than k code points is one gram.

The fingerprint string is base64 of the chosen hashes (32 bits, little-endian)
followed by their positions (32 bits). Likeness is the Jaccard similarity of the
sets of chosen hashes; two empty fingerprints are alike (1), one empty is not (0).

`neighbours` also fingerprints each document's edited text, for which it needs
the next document in ascending id: documents are dealt into ranges of ids, each
range's first document is also sent to the range before it, and each task walks
its ranges in order. One shuffle of the texts, and nothing is gathered but one
id for each range.

Defined results: null text counts as empty; documents with equal ids are ordered
by text (null ids come first); a single document is its own next; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

GRAM = 32
WINDOW = 64
#: Ranges of ids that one task walks, on average.
RANGES_PER_TASK = 8
_PASS = 1 << 19
_B = 0xD6E8FEB86659FD93
_BI = pow(_B, -1, 1 << 64)
_UP = np.cumprod(np.full(_PASS + 1, _B, dtype=K.U64)) * K.U64(_BI)
_DOWN = np.cumprod(np.full(_PASS + 1, _BI, dtype=K.U64)) * K.U64(_B)
_TOP = (1 << 32) - 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def chosen(points: np.ndarray, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing selects, by position."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    k = min(k, n)
    grams = n - k + 1
    parts = []
    # windows of w grams; consecutive passes overlap by w - 1 grams
    step = _PASS - k - w
    for a in range(0, max(1, grams - w + 1), step):
        b = min(grams, a + step + w - 1)
        x = K.mix64(points[a : b + k - 1].astype(K.U64) + K.U64(1))
        sums = np.zeros(len(x) + 1, dtype=K.U64)
        np.cumsum(x * _UP[: len(x)], out=sums[1:])
        h = K.mix64((sums[k:] - sums[:-k]) * _DOWN[: b - a])
        # ties go right: of equal hashes the later has the smaller second half
        key = (h & K.U64(_TOP << 32)) | (K.U64(_TOP) - np.arange(b - a, dtype=K.U64))
        low = np.unique(K.sliding_min(key, min(w, b - a)))
        parts.append((low >> K.U64(32), K.U64(_TOP) - (low & K.U64(_TOP)) + K.U64(a)))
    hashes, places = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    places, first = np.unique(places, return_index=True)
    return hashes[first].astype(np.uint32), places.astype(np.uint32)


def pack(hashes: np.ndarray, places: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u4").tobytes() + places.astype("<u4").tobytes()).decode()


def unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")
    return both[: len(both) // 2], both[len(both) // 2 :]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets given as sorted distinct arrays."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    k = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[k] == a).sum())
    return both / (len(a) + len(b) - both)


def common_passages(a: str, b: str) -> list[tuple[int, int]]:
    """Position pairs at which two fingerprints share a gram."""
    ha, pa_ = unpack(a)
    hb, pb = unpack(b)
    where: dict[int, list[int]] = {}
    for h, p in zip(hb.tolist(), pb.tolist(), strict=True):
        where.setdefault(h, []).append(p)
    return [(p, q) for h, p in zip(ha.tolist(), pa_.tolist(), strict=True) for q in where.get(h, ())]


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """doc_id and fingerprint of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pack(*chosen(code_points(t.as_py() or ""), k, w)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """text whose last half (rounded down) is replaced by as much of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, k: int = GRAM, w: int = WINDOW, rows_per_range: int = 256) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    total = rows.count()
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not total:
        return docs.sparkSession.createDataFrame([], schema)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(total // rows_per_range, RANGES_PER_TASK * parts))
    cuts = rows.select(key.cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    bounds = np.unique(np.array(cuts, dtype=np.float64))

    def range_of(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, ids.astype(np.float64), "right").astype(np.int32)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for r, i in zip(range_of(ids).tolist(), ids.tolist(), strict=True):
                low[r] = min(i, low.get(r, i))
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array(list(low.values()), pa.int64())], names=["r", "m"])

    heads = sorted((x.r, x.m) for x in rows.select(key.alias("k")).mapInArrow(smallest, "r int, m long").groupBy("r").agg(F.min("m").alias("m")).collect())
    # each range's first document also ends the range before; the very first ends the last
    to = {m: heads[i - 1][0] for i, (_, m) in enumerate(heads)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2).to_numpy()
            columns, names = batch.columns[:2], ["doc_id", "text", "r", "tail"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range_of(ids)), pa.array(np.zeros(len(ids), np.int32))], names=names)
            if ends := [k for k, i in enumerate(ids.tolist()) if i in to]:
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(ends)) for c in columns), pa.array([to[int(ids[k])] for k in ends], pa.int32()), pa.array([1] * len(ends), pa.int32())], names=names)

    dealt = rows.select("doc_id", "text", key.alias("k")).mapInArrow(deal, "doc_id long, text string, r int, tail int")
    ordered = dealt.repartition(parts, "r").sortWithinPartitions("r", "tail", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, id, text, points, hashes, places, set)
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        closed = None  # the range that has already got its tail
        for batch in batches:
            for i, text, r, tail in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if tail and closed == r:
                    continue  # equal ids at a range's start: only the first of them follows
                text = text.as_py()
                points = code_points(text)
                hashes, places = chosen(points, k, w)
                own = np.unique(hashes)
                if held is not None and held[0] == r:
                    _, hi, htext, hh, hp, hset = held
                    half = len(htext) // 2
                    new = htext[: len(htext) - half] + text[:half]
                    eh, ep = chosen(code_points(new), k, w)
                    out.append((hi, len(htext), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), pack(hh, hp), pack(eh, ep), likeness(hset, np.unique(eh)), likeness(hset, own)))
                closed = r if tail else None
                held = None if tail else (r, i, text, hashes, places, own)
                if len(out) >= 500:
                    yield flush()
        yield flush()

    return ordered.mapInArrow(run, schema)

