"""LM scoring by subword lattice likelihood.

Tokens are the words of a text, A-Z lower-cased, and one end. A word's lattice has the pieces of
an existing vocabulary and, as arcs over the whole word, what the training texts know of it:

* s(w): the summed probability of all segmentations into pieces (forward recursion in log
  space). The pieces' probabilities start from the vocabulary's own scores and are fitted by EM to
  all distinct training words.
* p(w) = max(c - D, 0)/N + (D*V/N) * s(w), for c uses among N training tokens of V kinds.
* p_k(w) = max(c_k - D, 0)/N_k + (D*V_k/N_k) * p(w), the same within a component k of the training
  texts. COMPONENTS mixture components are learned without labels, by EM over BUCKETS hashed
  word counts of every training text; languages and kinds of text come out of it.

A text's probability is the sum over the components of pi_k times the probability of its words in
order, each drawn from p_k or repeated from the text's own earlier words: the i-th (from 0)
has probability (STRENGTH * p_k(w) + earlier uses of w) / (STRENGTH + i). Each of these
sums to at most one, so the probabilities of all texts do.

Dataflow. One pass makes each training text's hashed counts; the components' EM returns BUCKETS
rows a round. A second pass cuts each batch of documents to its own sorted vocabulary and
rewrites the documents as numbers in it (the text is not moved). Counts are aggregated by word;
each word is scored once; the scores go back to the batches by a join in which the MOST_HOT words of
most batches are broadcast, so that no key of the shuffle is held by most of the batches.
Nothing else of the vocabulary is broadcast or gathered in one row.

Defined results: null text counts as empty (one token, the end); rows with repeated
or null ids are each scored, and a null id belongs to the training fold; with no
training rows N is 0 and both scores are null; an empty table gives no rows; very long texts are
counted like others, very long words are walked byte by byte (lattice.LONG);
extra columns of any name are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .lattice import LONG, Lattice, by_length, existing_vocabulary
from .scratch import drop, store
from .tables import held_out

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
DISCOUNT = 0.75
EM_ROUNDS = 3
COMPONENTS, BUCKETS, COMPONENT_ROUNDS = 8, 1024, 12
STRENGTH = 3000.0
#: Words in most batches, which are broadcast to them.
MOST_HOT = 4096
_LOWER = bytes(i + 32 if 65 <= i < 91 else i for i in range(256))
_FIXED = float(1 << 20)


def _planes(x: np.ndarray) -> bytes:
    """Little-endian 32-bit numbers, byte by byte position, so that high zeros compress."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _blocks(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, word starts, ends, rows' first words, word hashes) of blocks of a batch."""
    whole, offs = K.text_buffer(batch.column(column))
    for r0, r1 in K.doc_blocks(offs, most):
        buf, own = whole[offs[r0] : offs[r1]], offs[r0 : r1 + 1] - offs[r0]
        starts, ends, at = K.word_spans(buf, own, K.SPACED)
        yield r0, r1, buf, starts, ends, at, K.word_hashes(buf, starts, ends, K.FOLDED)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> K.U64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def profiles(docs: DataFrame) -> DataFrame:
    """at, idx, n: the hashed word counts of a block of training documents (text, held_out) with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, _, at, hashes in _blocks(batch, 0, 1 << 20):
                bucket = _bucket(hashes)
                idx, n, size = [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if b > a:
                        c = np.bincount(bucket[a:b], minlength=BUCKETS)
                        used = np.flatnonzero(c)
                        idx.append(used)
                        n.append(c[used])
                        size.append(len(used))
                if size:
                    cells = [_planes(np.array(size)), _planes(np.concatenate(idx)), _planes(np.concatenate(n))]
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["size", "idx", "n"])

    return docs.where(~F.col("held_out")).select("text").mapInArrow(run, "size binary, idx binary, n binary")


def likelihoods(idx: np.ndarray, n: np.ndarray, at: np.ndarray, log_theta: np.ndarray, log_pi: np.ndarray) -> np.ndarray:
    """Log probability of each row's hashed counts and component (rows x components)."""
    out = np.zeros((len(at) - 1, len(log_pi)))
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(log_theta[idx] * n[:, None], at[full], axis=0)
    return out + log_pi


def fit_components(rows: DataFrame, components: int = COMPONENTS, rounds: int = COMPONENT_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(log theta: buckets x components, log pi) by EM over profiles(); sums are fixed-point numbers, so they don't
    depend on the order of tasks. Stops when a token's likelihood gains less than a thousandth."""
    sc = rows.sparkSession.sparkContext
    theta, pi, before = np.full((BUCKETS, components), 1.0 / BUCKETS), np.full(components, 1.0 / components), -np.inf
    mean = None
    for _ in range(rounds + 1):
        shared = sc.broadcast((np.log(theta), np.log(pi)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            log_theta, log_pi = shared.value
            sums, weight, total = np.zeros((BUCKETS, components)), np.zeros(components), 0.0
            for batch in batches:
                for cells in zip(*batch.columns, strict=True):
                    size, idx, n = (_unplanes(c.as_py()).astype(np.int64) for c in cells)
                    like = likelihoods(idx, n, np.concatenate([[0], np.cumsum(size)]), log_theta, log_pi)
                    norm = np.logaddexp.reduce(like, axis=1)
                    share = np.exp(like - norm[:, None])
                    total += norm.sum()
                    weight += share.sum(0)
                    each = np.repeat(share, size, axis=0) * n[:, None]
                    for k in range(components):
                        sums[:, k] += np.bincount(idx, weights=each[:, k], minlength=BUCKETS)
            out = np.rint(np.vstack([sums, weight, np.full(components, total)]) * _FIXED).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 2))] + [pa.array(out[:, k].copy()) for k in range(components)], names=["b"] + [f"s{k}" for k in range(components)])

        names = [f"s{k}" for k in range(components)]
        mapped = rows.mapInArrow(run, "b long, " + ", ".join(f"{x} long" for x in names))
        got = np.zeros((BUCKETS + 2, components))
        for r in mapped.groupBy("b").agg(*[F.sum(x).alias(x) for x in names]).collect():
            got[r.b] = [r[x] / _FIXED for x in names]
        shared.unpersist()
        tokens = got[:BUCKETS].sum()
        if not tokens:
            break
        if mean is None:  # the first round counts; components start from the mean, reweighted by a seeded draw
            mean = got[:BUCKETS].sum(1) / tokens
            drawn = mean[:, None] * np.random.default_rng(5).gamma(1.0, size=(BUCKETS, components))
            theta = 0.5 * drawn / drawn.sum(0) + 0.5 * mean[:, None]
            theta = (theta + 1e-12) / (theta + 1e-12).sum(0)
            continue
        now = got[BUCKETS + 1, 0] / tokens
        theta = got[:BUCKETS] + 10 * mean[:, None] + 1e-9
        theta /= theta.sum(0)
        pi = (got[BUCKETS] + 1) / (got[BUCKETS] + 1).sum()
        if now - before < 1e-3:
            break
        before = now
    return np.log(theta), np.log(pi)


def _cut(docs: DataFrame, log_theta: np.ndarray, log_pi: np.ndarray) -> DataFrame:
    """kind 0: a batch's vocabulary, a row for each word and component whose training texts use it (a row for a
    word that none uses; the first row of each word is marked); kind 1: its documents as (sorted numbers, counts)."""
    components = len(log_pi)
    fields = [("kind", T.IntegerType()), ("chunk", T.LongType()), ("doc_id", docs.schema["doc_id"].dataType), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("codes", T.BinaryType()), ("word", T.StringType()), ("idx", T.IntegerType()), ("part", T.IntegerType()), ("uses", T.LongType()), ("first", T.BooleanType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    names = schema.names
    shared = docs.sparkSession.sparkContext.broadcast((log_theta, log_pi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 24
        theta, pi = shared.value
        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for r0, r1, buf, starts, ends, at, hashes in _blocks(batch, 1):
                serial += 1
                kinds, first, number = np.unique(hashes, return_index=True, return_inverse=True)
                number = number.astype(np.int32)
                text = buf.tobytes().translate(_LOWER)
                words = [text[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                bucket = _bucket(kinds)
                m, rows = len(words) + 1, r1 - r0
                words.append("")  # the end, which no word equals
                train = np.zeros((components, m), np.int64)
                codes = []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    k, c = np.unique(number[a:b], return_counts=True)
                    codes.append(_planes(np.diff(k, prepend=0)) + _planes(c))
                    if not held[r0 + i]:
                        z = int(np.argmax(likelihoods(bucket[k], c, np.array([0, len(k)]), theta, pi)[0]))
                        train[z, k] += c
                        train[z, -1] += 1
                at_word, part = np.nonzero(train.T)
                unused = np.flatnonzero(~train.any(0))
                place = np.concatenate([at_word, unused])
                part = np.concatenate([part, np.zeros(len(unused), np.int64)])
                first_row = np.concatenate([np.diff(at_word, prepend=-1) != 0, np.ones(len(unused), bool)])
                n = len(place)
                blank = lambda n, t: pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, serial)), blank(n, batch.column(0).type), blank(n, pa.bool_()), blank(n, pa.int64()), blank(n, pa.binary()), pa.array(words, pa.string()).take(pa.array(place)), pa.array(place.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(train[part, place]), pa.array(first_row)],
                    names=names,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(rows, np.int32)), pa.array(np.full(rows, serial)), batch.column(0).slice(r0, rows), batch.column(2).slice(r0, rows), pa.array(np.diff(at) + 1), pa.array(codes, pa.binary()), blank(rows, pa.string()), blank(rows, pa.int32()), blank(rows, pa.int32()), blank(rows, pa.int64()), blank(rows, pa.bool_())],
                    names=names,
                )

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Larger batches of about `most` rows or 8 MB, with the first column's texts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most or sum(b.nbytes for b in held) >= 8 << 20:
            yield _joined(held)
            held = []
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, list[bytes]]:
    one = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 and sum(b.num_rows for b in held) else held[0]
    return one, one.column(0).cast(pa.binary()).to_pylist()


def fit_pieces(kinds: DataFrame, pieces: list[bytes], logp: np.ndarray, rounds: int = EM_ROUNDS) -> Lattice:
    """EM over all distinct training words (column word), each once; long ones in parts."""
    end = float(np.log(0.2))
    sc = kinds.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast((pieces, logp, end))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shared.value)
            counts, n = np.zeros(len(lattice.logp)), 0
            for _, words in _gathered(batches):
                n += len(words)
                if any(len(w) > LONG for w in words):
                    words = [w[a : a + LONG] for w in words for a in range(0, max(1, len(w)), LONG)]
                for _, block in by_length(words):
                    if block.shape[1]:
                        lattice.expected(block, counts)
            counts[-1] = n
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.rint(counts[used] * _FIXED).astype(np.int64))], names=["piece", "uses"])

        got = kinds.select("word").mapInArrow(run, "piece long, uses long").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        counts = np.full(len(pieces) + 1, 0.01)
        for r in got:
            counts[r.piece] += r.uses / _FIXED
        counts /= counts.sum()
        logp, end = np.log(counts[:-1]), float(np.log(counts[-1]))
        shared.unpersist()
    return Lattice(pieces, logp, end)


def text_score(model: np.ndarray, c: np.ndarray, log_pi: np.ndarray, strength: float) -> float:
    """Log probability of a text whose kinds have the log probabilities model (kinds x components) and c uses each."""
    total = np.log(strength) * len(c) + model.sum(0, dtype=np.float64)
    again = np.flatnonzero(c > 1)
    n = int(c.sum())
    for a in range(0, len(again), 1 << 12):
        rows = again[a : a + (1 << 12)]
        base = strength * np.exp(model[rows].astype(np.float64))
        for lo in range(1, int(c[rows].max()), 1 << 12):  # a very frequent word in parts
            own = np.clip(c[rows] - lo, 0, 1 << 12)
            j = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + lo
            total = total + np.log(np.repeat(base, own, axis=0) + j[:, None]).sum(0)
    total = total + math.lgamma(strength) - math.lgamma(strength + n) + log_pi
    return float(np.logaddexp.reduce(total))


def score(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = EM_ROUNDS, components: int = COMPONENTS, strength: float = STRENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. docs needs
    doc_id, text and held_out (true: not learned from)."""
    spark = docs.sparkSession
    counted = store(profiles(docs), "profiles")
    log_theta, log_pi = fit_components(counted, components)
    drop(counted)
    cut = store(_cut(docs, log_theta, log_pi), "cut")
    uses = [f"t{k}" for k in range(components)]
    vocab = cut.where("kind = 0")
    of = [F.sum(F.when(F.col("part") == k, F.col("uses")).otherwise(0)).alias(t) for k, t in enumerate(uses)]
    words = store(vocab.groupBy("word").agg(F.count_if("first").alias("batches"), *of), "words")
    total = words.agg(*[F.sum(t).alias(t) for t in uses], *[F.count_if(F.col(t) > 0).alias(f"v{t}") for t in uses], F.count_if(sum((F.col(t) for t in uses), F.lit(0)) > 0).alias("v")).first()
    nk = np.array([total[t] or 0 for t in uses], dtype=np.float64)
    vk = np.array([total[f"v{t}"] or 0 for t in uses], dtype=np.float64)
    n, v = int(nk.sum()), int(total.v or 0)
    pieces, logp = existing_vocabulary(vocabulary)
    lattice = fit_pieces(words.where(sum((F.col(t) for t in uses), F.lit(0)) > 0), pieces, logp, rounds)
    shared = spark.sparkContext.broadcast((pieces, lattice.logp[:-1], lattice.end))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch, texts in _gathered(batches):
            c = sum(batch.column(2 + k).to_numpy() for k in range(components)).astype(np.float64)
            sub = lattice.score(texts)
            with np.errstate(divide="ignore"):
                whole = np.logaddexp(np.log(np.maximum(c - DISCOUNT, 0) / max(n, 1)), math.log(max(DISCOUNT * v, 1e-300) / max(n, 1)) + sub)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole.astype(np.float32))], names=["word", "batches", *uses, "whole"])

    facts = [*uses, "whole"]
    weighed = store(words.select("word", "batches", *uses).mapInArrow(weigh, "word string, batches long, " + ", ".join(f"{t} long" for t in uses) + ", whole float"), "weighed")
    drop(words)
    hot = F.broadcast(weighed.where("batches > 1").orderBy(F.desc("batches"), "word").limit(MOST_HOT).drop("batches"))
    asked = vocab.where("first").select("chunk", "idx", "word")
    found = asked.join(hot, "word").unionByName(asked.join(hot.select("word"), "word", "left_anti").join(weighed.drop("batches"), "word"))

    blank = lambda t, c: F.lit(None).cast(t).alias(c)
    id_type = docs.schema["doc_id"].dataType
    left = found.select("chunk", F.lit(0).alias("kind"), "idx", blank(id_type, "doc_id"), blank("boolean", "held_out"), blank("long", "n_tokens"), blank("binary", "codes"), *facts)
    right = cut.where("kind = 1").select("chunk", "kind", F.lit(0).alias("idx"), "doc_id", "held_out", "n_tokens", "codes", *[blank("long", t) for t in uses], blank("float", "whole"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = left.unionByName(right).repartition(parts, "chunk").withColumn("chunk", F.col("chunk") * 2 + F.col("kind")).sortWithinPartitions("chunk")

    kept = np.maximum(nk, 1)
    spread = np.log(np.where(nk > 0, np.maximum(DISCOUNT * vk, 1e-300) / kept, 1.0))

    def inside(own: list[np.ndarray], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """known, base, and log probability in each component, of words with these counts by component."""
        c = sum(own).astype(np.float64)
        model = (spread + whole[:, None]).astype(np.float32)
        for k, ck in enumerate(own):
            used = np.flatnonzero(ck)
            model[used, k] = np.logaddexp(model[used, k], np.log((ck[used] - DISCOUNT) / kept[k]))
        return (c > 0).astype(np.int64), np.log10((c + 0.5) / (n + 0.5 * (v + 1))), model

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables, parts_ = None, None, []
        for batch in batches:
            order = batch.column(0).to_numpy()
            chunk, kind = order >> 1, order & 1
            edges = np.flatnonzero(np.diff(order, prepend=order[:1] - 1))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(chunk)], strict=True):
                if chunk[a] != now:
                    now, tables, parts_ = chunk[a], None, []
                if kind[a] == 0:
                    parts_.append([batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in (2, *range(7, 8 + components))])
                    continue
                if tables is None:
                    place, *own, whole = (np.concatenate(x) for x in zip(*parts_, strict=True))
                    place = np.argsort(place)
                    own, whole = [x[place] for x in own], whole[place]
                    tables, parts_ = inside(own, whole), []
                known, base, model = tables
                out = [[], [], []]
                for cell in batch.column(6).slice(a, b - a):
                    raw = cell.as_py()
                    k = np.append(np.cumsum(_unplanes(raw[: len(raw) // 2]).astype(np.int64)), len(base) - 1)
                    c = np.append(_unplanes(raw[len(raw) // 2 :]).astype(np.int64), 1)
                    out[0].append(int(known[k] @ c))
                    out[1].append(float(base[k] @ c))
                    out[2].append(text_score(model[k], c, log_pi, strength) / math.log(10))
                ids, held, size = (batch.column(i).slice(a, b - a) for i in (3, 4, 5))
                yield pa.RecordBatch.from_arrays(
                    [ids, held, size, pa.array(out[0], pa.int64()), pa.array(np.full(b - a, n)), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64())],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    result = T.StructType([T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType())] + [T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(x, T.DoubleType()) for x in ("base_score", "score")])
    scored = together.mapInArrow(add, result)
    if not n:
        scored = scored.withColumns({"base_score": F.lit(None).cast("double"), "score": F.lit(None).cast("double")})
    return scored


def score_documents(docs: DataFrame, parts: int = 5, remainder: int = 1, vocabulary: str = VOCABULARY) -> DataFrame:
    """score() with the fold crc32(doc_id) mod parts = remainder held out."""
    return score(docs.select("doc_id", "text", held_out("doc_id", parts, remainder).alias("held_out")), vocabulary)
