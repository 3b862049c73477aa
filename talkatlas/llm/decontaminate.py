"""Benchmark decontamination by a stored, distributed positional inverted index.

1. Postings. Every training token goes into the index: documents are dealt into blocks as they lie,
   and a row of the index holds a term, a block, the number of its occurrences there and their positions
   (word numbers of the block, delta coded). A further row for each block keeps its documents and where
   they begin. The index is a table in the shared folder; `build_index` may be kept and asked again.
2. Windows. The benchmark's distinct windows are rows with their terms and offsets, and a table of
   their owners. The index's rows of benchmark terms are selected by a semi-join.
3. The rarest term of a window, by occurrences in the whole index, is found by an aggregate;
   windows with a term that the index lacks go. Joining the rarest term's rows, and then those of the next
   rarest (TOLD in all), gives, for each window, the blocks that can hold it: no others ever see it.
4. In a block, the positions of the rarest term, less its offset, are intersected with the
   offset-adjusted lists of the other terms in order of rarity: exact phrase matches. Proximity
   matches are the positions of the rarest term around which some `n + slop` consecutive words of one
   document hold every term of the window.

Every step is a join or an aggregate whose strategy Spark picks by size; nothing of the benchmark or of
the index comes to the driver or is broadcast by hand. A term of all blocks has one bounded row in
each of them, so a hot term is spread over as many rows as there are blocks.

Defined results: a null or empty text has no words and no hits; rows of the benchmark that are
null or have no words are ignored; repeated item_ids count once, a null one counts as the empty
text; repeated documents (equal or null ids) are each judged; a very long text is a block of its own;
columns of any name are carried by `drop_contaminated` and ignored by `find_overlaps`; an
empty benchmark gives no hits, an empty document table no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .scratch import store

#: Bytes of text in one block of the index.
BLOCK = 4 << 20
#: So many of a window's rarest terms are looked up before a block is asked.
TOLD = 3
#: Proximity: every term within n + SLOP consecutive words.
SLOP = 4


def _decoded(code: bytes) -> np.ndarray:
    """Ascending numbers from 32-bit deltas that lie byte by byte position (so that high zeros compress)."""
    return np.cumsum(np.frombuffer(code, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64))


def _index_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("term", T.LongType()),
            T.StructField("uses", T.LongType()),
            T.StructField("positions", T.BinaryType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("at", T.ArrayType(T.LongType())),
        ]
    )


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text): postings (block, term, uses, positions) and, with a null
    term, each block's documents (ids, at: word number where each begins, and the end)."""
    schema = _index_schema(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 24
        for batch in batches:
            whole, offs = K.text_buffer(batch.column(1))
            for r0, r1 in K.doc_blocks(offs, BLOCK):
                serial += 1
                starts, ends, at = K.word_spans(whole[offs[r0] : offs[r1]], offs[r0 : r1 + 1] - offs[r0], K.ALNUM)
                hashes = K.word_hashes(whole[offs[r0] : offs[r1]], starts, ends, K.FOLDED)
                order = np.argsort(hashes, kind="stable")
                sorted_ = hashes[order]
                edges = np.flatnonzero(np.diff(sorted_, prepend=~sorted_[:1])) if len(sorted_) else np.zeros(0, np.int64)
                stops = np.append(edges, len(sorted_))[1:]
                # deltas of all lists at once; a list's first number is itself
                gaps = np.diff(order, prepend=0)
                gaps[edges] = order[edges]
                planes = gaps.astype("<u4").view(np.uint8).reshape(-1, 4)
                cells = [planes[a:b].T.tobytes() for a, b in zip(edges.tolist(), stops.tolist(), strict=True)]
                m = len(edges)
                if m:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, serial)), pa.array(sorted_[edges].view(np.int64)), pa.array(stops - edges), pa.array(cells, pa.binary()), pa.nulls(m, pa.list_(batch.column(0).type)), pa.nulls(m, pa.list_(pa.int64()))],
                        names=schema.names,
                    )
                ids = pa.ListArray.from_arrays(pa.array([0, r1 - r0], pa.int32()), batch.column(0).slice(r0, r1 - r0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([serial]), pa.nulls(1, pa.int64()), pa.array([len(hashes)], pa.int64()), pa.nulls(1, pa.binary()), ids, pa.array([at.tolist()], pa.list_(pa.int64()))],
                    names=schema.names,
                )

    return store(docs.select("doc_id", "text").mapInArrow(run, schema), "postings")


def windows_of(bench: DataFrame, n: int) -> DataFrame:
    """(w, terms, item) of every window of n consecutive words of the benchmark, all words of a shorter item;
    w identifies the terms (two hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            whole, offs = K.text_buffer(batch.column(1))
            for r0, r1 in K.doc_blocks(offs, 1 << 20):
                starts, ends, at = K.word_spans(whole[offs[r0] : offs[r1]], offs[r0 : r1 + 1] - offs[r0], K.ALNUM)
                words = K.word_hashes(whole[offs[r0] : offs[r1]], starts, ends, K.FOLDED)
                for name, a, b in zip(names[r0:r1], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if b == a:
                        continue
                    size = min(n, b - a)
                    m = b - a - size + 1
                    flat = np.lib.stride_tricks.sliding_window_view(words[a:b], size).ravel().view(np.int64)
                    terms = K.list_array(flat, np.arange(m + 1) * size, pa.int64())
                    key = [K.gram_hashes(words[a:b], size, salt).view(np.int64) for salt in (size, size + 1000)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1]), terms, pa.array([name] * m, pa.string())], names=["w1", "w2", "terms", "item"])

    texts = bench.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return texts.mapInArrow(run, "w1 long, w2 long, terms array<long>, item string")


class Lists:
    """The selected postings of one block."""

    def __init__(self, lists: dict[int, np.ndarray], at: np.ndarray):
        self.lists, self.at = lists, at

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """First positions of the exact occurrences of these terms in a row, inside one document."""
        order = sorted(range(len(terms)), key=lambda j: len(self.lists.get(int(terms[j]), ())))
        at = self.lists.get(int(terms[order[0]]), np.zeros(0, np.int64)) - order[0]
        doc = np.searchsorted(self.at, at + order[0], "right") - 1
        at = at[(at >= self.at[doc]) & (at + len(terms) <= self.at[doc + 1])] if len(at) else at
        for j in order[1:]:
            if not len(at):
                break
            own = self.lists.get(int(terms[j]), np.zeros(0, np.int64))
            k = np.searchsorted(own, at + j)
            at = at[(k < len(own)) & (own[np.minimum(k, len(own) - 1)] == at + j)] if len(own) else at[:0]
        return at

    def near(self, terms: np.ndarray, reach: int) -> np.ndarray:
        """Positions of the rarest term around which `reach` consecutive words of one document hold all the terms."""
        kinds = sorted({int(t) for t in terms}, key=lambda t: (len(self.lists.get(t, ())), t))
        lists = [self.lists.get(t, np.zeros(0, np.int64)) for t in kinds]
        if not len(lists[0]):
            return lists[0]
        at = lists[0]
        doc = np.searchsorted(self.at, at, "right") - 1
        lo, hi = np.maximum(at - reach + 1, self.at[doc]), np.minimum(at + reach, self.at[doc + 1])
        for own in lists[1:]:  # each term somewhere around: thins out most
            ok = np.searchsorted(own, lo) < np.searchsorted(own, hi)
            at, lo, hi = at[ok], lo[ok], hi[ok]
            if not len(at):
                return at
        # every stretch that holds the rarest place and begins within reach before it
        out = np.zeros(len(at), dtype=bool)
        for back in range(reach):
            begin = at - back
            fits = (begin >= lo) & ~out
            for own in lists[1:]:
                if not fits.any():
                    break
                fits &= np.searchsorted(own, begin) < np.searchsorted(own, np.minimum(begin + reach, hi))
            out |= fits
        return at[out]


def find_overlaps(docs: DataFrame, bench: DataFrame, n: int = 10, slop: int | None = SLOP, index: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurring window), item_ids (sorted as strings),
    hits (array of spans [start, end) in words), and near_item_ids by proximity (none if slop is null)."""
    spark = docs.sparkSession
    index = build_index(docs) if index is None else index
    id_type = index.schema["ids"].dataType.elementType
    postings = index.where("term is not null").select("block", "term", "uses", "positions")
    every = windows_of(bench, n)
    key = ["w1", "w2"]
    windows = store(every.groupBy(*key).agg(F.first("terms").alias("terms")), "windows")
    owners = every.select(*key, "item").distinct()
    wanted = windows.select(F.explode("terms").alias("term")).distinct()
    lists = store(postings.join(wanted, "term", "left_semi"), "lists")
    often = lists.groupBy("term").agg(F.sum("uses").alias("f"))
    placed = windows.select(*key, F.posexplode("terms").alias("i", "term")).join(often, "term", "left")
    ranked = placed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("f", "i", "term"))).alias("all"), F.count_if(F.col("f").isNull()).alias("absent")).where("absent = 0")
    kinds = F.array_distinct(F.transform("all", lambda x: x["term"]))
    rarest = ranked.select(*key, *[F.get(kinds, j).alias(f"r{j}") for j in range(TOLD)])
    # the blocks that hold a window's rarest term, and those that follow
    held = lists.select("block", "term")
    where = held.withColumnRenamed("term", "r0").join(rarest, "r0")
    for j in range(1, TOLD):
        told = where.withColumn("term", F.coalesce(f"r{j}", "r0"))
        where = told.join(held, ["block", "term"], "left_semi").drop("term")
    where = where.select("block", *key)
    candidates = where.join(windows, key).select("block", F.lit(2).alias("kind"), "terms", *key)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    shape = [("term", "long"), ("positions", "binary"), ("terms", "array<long>"), ("w1", "long"), ("w2", "long"), ("ids", T.ArrayType(id_type)), ("at", "array<long>")]
    touched = candidates.select("block").distinct()

    def row(df: DataFrame, kind: int) -> DataFrame:
        return df.select("block", F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else none(t, c) for c, t in shape])

    blocks = index.where("term is null").select("block", "ids", "at")
    asked = row(blocks.join(touched, "block", "left_semi"), 0).unionByName(row(lists.join(touched, "block", "left_semi"), 1)).unionByName(row(candidates, 2))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = asked.repartition(parts, "block").sortWithinPartitions("block", "kind")
    result = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc", T.IntegerType()), T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), T.StructField("start", T.LongType()), T.StructField("size", T.IntegerType())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, held = None, {}, None
        out: list[tuple] = []
        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            term, code, terms, w1, w2, at = (batch.column(i) for i in (2, 3, 4, 5, 6, 8))
            for i in range(batch.num_rows):
                if block[i] != now:
                    now, own, held = block[i], {}, None
                if kind[i] == 0:
                    begins = np.array(at[i].as_py(), dtype=np.int64)
                elif kind[i] == 1:
                    own[term[i].as_py()] = _decoded(code[i].as_py())
                else:
                    held = held or Lists(own, begins)
                    wanted_ = np.array(terms[i].as_py(), dtype=np.int64)
                    a, b = w1[i].as_py(), w2[i].as_py()
                    found = held.phrase(wanted_)
                    for p, d in zip(found.tolist(), (np.searchsorted(begins, found, "right") - 1).tolist(), strict=True):
                        out.append((now, d, a, b, p - int(begins[d]), len(wanted_)))
                    if slop is not None:
                        close = held.near(wanted_, len(wanted_) + slop)
                        for d in np.unique(np.searchsorted(begins, close, "right") - 1).tolist():
                            out.append((now, d, a, b, None, len(wanted_)))
                if len(out) >= 1 << 14:
                    yield _rows(out)
                    out = []
        if out:
            yield _rows(out)

    hits = store(together.mapInArrow(match, result), "hits")
    span = F.struct(F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    # runs of overlapping or touching windows, by the furthest end so far
    spans = hits.where("start is not null").select("block", "doc", span.alias("s")).distinct()
    runs = spans.groupBy("block", "doc").agg(F.array_sort(F.collect_list("s")).alias("s"))
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def join_runs(acc, s):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= s["a"]), longer).otherwise(F.concat(acc, F.array(s)))

    runs = runs.select("block", "doc", F.aggregate("s", empty, join_runs).alias("runs"))
    named = hits.join(owners, key).groupBy("block", "doc").agg(
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.col("item")))).alias("item_ids"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNull(), F.col("item")))).alias("near_item_ids"),
    )
    each = blocks.select("block", F.posexplode("ids").alias("doc", "doc_id"), "at")
    size = F.get("at", F.col("doc") + 1) - F.get("at", F.col("doc"))
    found = each.select("block", "doc", "doc_id", size.alias("n_words")).join(named, ["block", "doc"], "left").join(runs, ["block", "doc"], "left")
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    n_hit = F.aggregate(F.coalesce("runs", empty), F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), texts("item_ids"), F.transform(F.coalesce("runs", empty), lambda s: F.array(s["a"], s["b"])).alias("hits"), texts("near_item_ids"))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "doc", "w1", "w2", "start", "size"])


def drop_contaminated(docs: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; all columns kept.

    A verdict depends on the text alone, so rows are told by two hashes of the text:
    repeated or null doc_ids are no matter."""
    print_ = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    found = find_overlaps(docs.where("text is not null").select(print_.alias("doc_id"), "text"), bench, n, None)
    gone = found.where("n_hit > 0").select("doc_id").distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), print_.alias("print"))
    return row.join(gone, (F.col("print.a") == F.col("doc_id.a")) & (F.col("print.b") == F.col("doc_id.b")), "left_anti").select("row.*")
