"""Quality classifier: logistic regression on hashed word n-grams, by FTRL.

Words are runs of letters, digits or other signs, case-folded. A document's
features are its word unigrams and bigrams and the trigrams of word shapes
(kind of run, case, whether it ends a line), each hashed to one of 2**bits
weights and counted relative to the number of words. Training is
follow-the-regularised-leader (proximal, per-coordinate rates, L1 and L2) over a
bounded sample of labelled rows; scoring is one sparse dot product a document.

Defined results: null or empty text has no features and scores the sigmoid of
the bias; labels that are null or without a document are ignored; of several
labels for a document each counts; with no labelled rows at all every score is
0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Documented bound: at most about this many labelled rows are learned from.
TRAIN_ROWS = 6000
BITS = 18

_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[33:128] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 1
_CLASS[128:] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1


@dataclass(frozen=True)
class FtrlConfig:
    alpha: float = 0.5
    beta: float = 0.1
    l1: float = 1e-4
    l2: float = 1e-4
    epochs: int = 4
    scale: float = 32.0


def features(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(three feature numbers for each word, rows + 1 word offsets). Grams that
    would cross a row's end take the number of a row end instead."""
    kind = _CLASS[buf]
    n = len(buf)
    if not n:
        return np.zeros((3, 0), np.int64), np.zeros(len(offs), np.int64)
    edge = np.ones(n, dtype=bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offs[:-1][offs[:-1] < n]] = True
    bounds = np.flatnonzero(edge)
    stops = np.append(bounds[1:], n)
    real = kind[bounds] > 0
    starts, ends = bounds[real], stops[real]
    at = np.searchsorted(starts, offs)
    word = K.word_hashes(buf, starts, ends, K.FOLDED)
    ups = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    capital = ups[ends] - ups[starts]
    case = np.where(capital == 0, 0, np.where((capital == 1) & (_UPPER[buf[starts]] == 1), 1, 2))
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    after = np.append(starts[1:], n)
    broken = (lines[after] > lines[np.minimum(ends, n)]).astype(np.int64)
    glued = (np.append(starts[1:], n + 1) == ends).astype(np.int64)
    shape = K.mix64((kind[starts].astype(np.int64) * 16 + case * 4 + broken * 2 + glued + 1).astype(K.U64))
    row = np.searchsorted(at, np.arange(len(starts)), "right")
    end = K.mix64(np.array([7], dtype=K.U64))[0]

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        y = np.full(len(x), end, dtype=K.U64)
        if len(x) > by:
            y[:-by] = np.where(row[by:] == row[:-by], x[by:], end)
        return y

    base = K.U64(0x9E3779B97F4A7C15)
    two = K.mix64(word * base + ahead(word, 1))
    three = K.mix64((shape * base + ahead(shape, 1)) * base + ahead(shape, 2))
    top = K.U64(64 - bits)
    return np.stack([(word >> top).astype(np.int64), (two >> top).astype(np.int64), (three >> top).astype(np.int64)]), at


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, cfg: FtrlConfig) -> tuple[np.ndarray, float]:
    """Weights and bias after cfg.epochs passes over (features, values, label) rows."""
    z = np.zeros((1 << bits) + 1)
    s = np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * cfg.l1) / ((cfg.beta + np.sqrt(s[i])) / cfg.alpha + cfg.l2)
        return np.where(np.abs(zi) <= cfg.l1, 0.0, w)

    order = np.random.default_rng(17)
    for _ in range(cfg.epochs):
        for k in order.permutation(len(rows)):
            i, v, label = rows[k]
            i, v = np.append(i, bias), np.append(v, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - label) * v
            sigma = (np.sqrt(s[i] + g * g) - np.sqrt(s[i])) / cfg.alpha
            z[i] += g - sigma * w
            s[i] += g * g
    w = weights(np.arange(len(z)))
    return w[:-1].astype(np.float32), float(w[-1])


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int) -> DataFrame:
    """(doc_id, text, y): labelled rows under `keep`, thinned by a hash of the id
    to about `most`. The hash filter comes before the join, so only sampled
    documents are shuffled."""
    marked = labels.where(F.col(label).isNotNull() & keep).select("doc_id", F.col(label).cast("int").alias("y"))
    total = marked.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, most / max(total, 1))) + 1)
    return docs.select("doc_id", "text").where(part).join(marked.where(part), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int = TRAIN_ROWS, bits: int = BITS, cfg: FtrlConfig = FtrlConfig()) -> tuple[np.ndarray, float]:
    """The model, trained in one task on the bounded sample; 2**bits floats come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            buf, offs = K.text_buffer(batch.column("text"))
            ys = batch.column("y").to_pylist()
            for r0, r1 in K.doc_blocks(offs, 1 << 20):
                f, at = features(buf[offs[r0] : offs[r1]], offs[r0 : r1 + 1] - offs[r0], bits)
                for k in range(r1 - r0):
                    own = f[:, at[k] : at[k + 1]].ravel()
                    i, c = np.unique(own, return_counts=True)
                    rows.append((i.astype(np.int32), (c * (cfg.scale / max(1, len(own)))).astype(np.float32), ys[r0 + k]))
        if rows:
            w, b = train_ftrl(rows, bits, cfg)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b], pa.float64())], names=["w", "b"])

    sample = bounded_sample(docs, labels, label, keep, most)
    # one task, rows in a fixed order: the same sample gives the same weights
    got = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").mapInArrow(run, "w binary, b double").collect()
    if not got:
        return np.zeros(1 << bits, dtype=np.float32), 0.0
    return np.frombuffer(got[0].w, dtype=np.float32), got[0].b


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS, cfg: FtrlConfig = FtrlConfig()) -> DataFrame:
    """(doc_id, score): the model's probability of label 1 for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            buf, offs = K.text_buffer(batch.column(1))
            out = np.zeros(batch.num_rows)
            for r0, r1 in K.doc_blocks(offs, 2 << 20):
                f, at = features(buf[offs[r0] : offs[r1]], offs[r0 : r1 + 1] - offs[r0], bits)
                each = np.concatenate([[0.0], np.cumsum(w[f].sum(0, dtype=np.float64))])
                out[r0:r1] = (each[at[1:]] - each[at[:-1]]) * cfg.scale / np.maximum(1, 3 * (at[1:] - at[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out + b, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
