"""Substring dedup by repeated-phrase automata.

A window is `size` consecutive words of one document. All occurrences of a window
but the first (smallest doc_id, then earliest start) are removed.

0. Copies. Of equal texts (two 64-bit hashes) the first stands for all; of the others
   nothing is left, if they have a window at all.
1. Screen. Every window has an anchor, the GRAM words inside it with the smallest
   hash; equal windows have equal anchors. Anchors are aggregated over all documents
   (about two for every 16 words). A window can recur only if its anchor stands in
   two different texts, or twice in one, so texts without such an anchor are finished.
2. Confirm. Runs of windows with a recurring anchor become segments, dealt by
   anchor to shards of about SHARD segments. A shard enters all windows into a trie over
   words, which counts them and keeps their first occurrence: a recurring passage is
   confirmed by its words, not by a hash.
3. Locate. The trie is compiled to the shard's Aho-Corasick automaton (pyahocorasick)
   and all the shard's segments stream through it. What is found anywhere but at the
   first occurrence is removed. Of an anchor with more than MOST segments equal ones are
   counted before the shuffle, and its rows are salted over shards that each get the
   counts and first occurrences; with more than MOST different ones the segments are
   cut to windows, which then are the keys.

A task holds one shard and one batch of rows. Intermediate tables are
written to the shared folder.

Defined results: null text has no words; texts shorter than a window stay whole;
rows with equal doc_id and equal text are one document (both keep the same words);
a null doc_id comes before all others; extra columns are carried by
`remove_repeats`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import store

SIZE = 20
GRAM = 6
#: Segments in one shard, on average (each has about six windows of 20 trie nodes).
SHARD = 2000
#: Segments of one anchor that go to one shard. Beyond, equal ones are counted before the
#: shuffle and the rows are salted; with more different ones they are cut to windows first.
MOST = 4000
_RUN = 64
_POS = K.U64((1 << 24) - 1)
#: A null id sorts first.
_NULL = -(1 << 63)


def anchors(hashes: np.ndarray, at: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows that lie in one document, position of each one's anchor)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = K.gram_hashes(hashes, gram)
    inside = np.zeros(len(hashes) + 1, np.int32)
    a, b = at[:-1], at[1:] - size + 1
    real = b > a
    np.add.at(inside, a[real], 1)
    np.add.at(inside, b[real], -1)
    starts = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    step = int(_POS) - size
    place = np.empty(n, np.int64)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        own = grams[lo : hi + size - gram]
        key = (own & ~_POS) | (_POS - np.arange(len(own), dtype=K.U64))
        place[lo:hi] = (_POS - (K.sliding_min(key, size - gram + 1) & _POS)).astype(np.int64)[: hi - lo] + lo
    return starts, place[starts]


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, word starts, ends, hashes, rows' first words) for each block of a batch."""
    whole, offs = K.text_buffer(column)
    for r0, r1 in K.doc_blocks(offs, 4 << 20):
        buf, own = whole[offs[r0] : offs[r1]], offs[r0 : r1 + 1] - offs[r0]
        starts, ends, at = K.word_spans(buf, own, K.SPACED)
        yield r0, r1, buf, starts, ends, K.word_hashes(buf, starts, ends, K.RAW), at


def _keyed(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "text", key.alias("k"), F.xxhash64("text").alias("th"), F.xxhash64(F.lit(2), "text").alias("th2"))


def _pairs(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchor hash, row) of every anchor's place in a batch of (text, th)."""
    for r0, _, _, _, _, hashes, at in _blocks(batch.column(0)):
        place = np.unique(anchors(hashes, at, size)[1])
        yield K.gram_hashes(hashes, GRAM)[place].view(np.int64), np.searchsorted(at, place, "right") - 1 + r0


def recurring_anchors(keyed: DataFrame, size: int) -> DataFrame:
    """(h) of the anchors that stand in two different texts, or twice in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ths = batch.column(1).to_numpy()
            for h, row in _pairs(batch, size):
                if not len(h):
                    continue
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                same = h[1:] == h[:-1]
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                twice = np.concatenate([[False], same & (row[1:] == row[:-1])]).astype(np.int32)
                th = ths[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[first]), pa.array(np.minimum.reduceat(th, first)), pa.array(np.maximum.reduceat(th, first)), pa.array(np.maximum.reduceat(twice, first))],
                    names=["h", "low", "high", "twice"],
                )

    found = keyed.select("text", "th").mapInArrow(run, "h long, low long, high long, twice int")
    return found.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("twice").alias("twice")).where("low <> high or twice > 0").select("h")


def _anchor_rows(keyed: DataFrame, size: int) -> DataFrame:
    """(h, th): the distinct anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ths = batch.column(1).to_numpy()
            for h, row in _pairs(batch, size):
                th = ths[row]
                order = np.lexsort((h, th))
                h, th = h[order], th[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (th[1:] != th[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(th[new])], names=["h", "th"])

    return keyed.select("text", "th").mapInArrow(run, "h long, th long")


_SPLIT = "kind int, doc_id {id}, k long, th long, n_words long, n_removed long, kept string, text string, h long, start long"


def _split(keyed: DataFrame, size: int, whole_text: bool) -> DataFrame:
    """kind 0: finished documents; 1: documents with segments; 2: their segments (text: words joined by one space)."""
    recurring = recurring_anchors(keyed, size)
    marked = _anchor_rows(keyed, size).join(recurring, "h").groupBy("th").agg(F.collect_set("h").alias("hs"))
    copies = keyed.groupBy("th", "th2").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = copies.groupBy("th").agg(F.collect_list(F.struct("th2", "first")).alias("copies"))
    joined = keyed.join(marked.join(copies, "th", "full"), "th", "left")
    first = F.get(F.filter("copies", lambda c: c["th2"] == F.col("th2")), 0)["first"]
    joined = joined.select("doc_id", "text", "k", "th", "hs", first.alias("first"))
    schema = _SPLIT.format(id=keyed.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hs, firsts = batch.column(0), batch.column(1), batch.column(4), batch.column(5).to_pylist()
            ks, ths = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for r0, r1, buf, starts, ends, hashes, at in _blocks(texts):
                rows = r1 - r0
                kind, kept, removed = [0] * rows, [None] * rows, [0] * rows
                seg: list[tuple[int, int, int, str]] = []
                window, place = anchors(hashes, at, size)
                gram = K.gram_hashes(hashes, GRAM).view(np.int64)
                cut = np.searchsorted(window, at)
                for i in range(rows):
                    a, b = int(at[i]), int(at[i + 1])
                    marked = hs[r0 + i]
                    copy = firsts[r0 + i] is not None and firsts[r0 + i] != ks[r0 + i] and b - a >= size
                    if copy:  # of an earlier document: every window recurs
                        removed[i], a = b - a, b
                    elif marked.is_valid and cut[i + 1] > cut[i]:
                        own, h = window[cut[i] : cut[i + 1]], gram[place[cut[i] : cut[i + 1]]]
                        hit = np.isin(h, marked.values.to_numpy(zero_copy_only=False))
                        if hit.any():
                            words = buf[starts[a] : ends[b - 1]].tobytes().split()
                            edge = np.ones(len(h), bool)
                            edge[1:] = (h[1:] != h[:-1]) | (hit[1:] != hit[:-1])
                            first = np.flatnonzero(edge)
                            for x, y in zip(first.tolist(), [*first[1:].tolist(), len(h)], strict=True):
                                if hit[x]:
                                    for z in range(x, y, _RUN):
                                        s, e = int(own[z]) - a, int(own[min(y, z + _RUN) - 1]) - a + size
                                        seg.append((r0 + i, int(h[x]), s, b" ".join(words[s:e]).decode("utf-8", "replace")))
                            kind[i] = 1
                    if not kind[i]:
                        clean = b" ".join(buf[starts[a] : ends[b - 1]].tobytes().split()) if b > a else b""
                        kept[i] = clean.decode("utf-8", "replace") if whole_text else hashlib.sha256(clean).hexdigest()
                at_row = [s[0] for s in seg]
                none = lambda t: pa.nulls(rows, t)
                suspects = texts.take(pa.array([r0 + i if x else None for i, x in enumerate(kind)], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(kind, pa.int32()), ids.slice(r0, rows), pa.array(ks[r0:r1]), pa.array(ths[r0:r1]), pa.array(at[1:] - at[:-1], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                        suspects, none(pa.int64()), none(pa.int64()),
                    ],
                    names=names,
                )
                if seg:
                    m = len(seg)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([2] * m, pa.int32()), pa.nulls(m, ids.type), pa.array(ks[at_row]), pa.array(ths[at_row]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()),
                            pa.array([s[3] for s in seg], pa.string()), pa.array([s[1] for s in seg], pa.int64()), pa.array([s[2] for s in seg], pa.int64()),
                        ],
                        names=names,
                    )

    return joined.mapInArrow(run, schema)


def _single_windows(rows: DataFrame, size: int) -> DataFrame:
    """Segments cut to their windows, each under a key of its own."""
    rows = rows.withColumn("words", F.explode(F.array(F.split("text", " "))))
    cut = F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("words", i + 1, size), " ").alias("w")))
    rows = rows.withColumn("x", F.explode(cut)).drop("words")
    return rows.withColumn("start", F.col("start") + F.col("x.i")).withColumn("text", F.col("x.w")).withColumn("h", F.xxhash64("h", "text")).drop("x")


def _locate(segments: DataFrame, size: int, most: int = MOST) -> DataFrame:
    """(k, th, a, b): words [a, b) of a document that automata found to repeat an earlier passage."""
    spark = segments.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = segments.select("h", "k", "th", "start", "text")

    def counted(each: DataFrame) -> DataFrame:
        """Distinct segments with first occurrence and count, for each of the anchor's salts."""
        return each.select("h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "first.k", F.col("c").alias("th"), "first.start", "text")

    def salted(rows: DataFrame) -> DataFrame:
        return rows.select("h", F.pmod(F.xxhash64("k", "start"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "k", "th", "start", "text")

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h", "text").agg(F.min(F.struct("k", "start")).alias("first"), F.count(F.lit(1)).alias("c"))

    def salts(each: DataFrame) -> DataFrame:
        return each.groupBy("h").agg(F.ceil(F.sum("c") / most).cast("int").alias("salts"))

    sizes = segments.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    hot = store(sizes.where(f"c > {most}").select("h"), "hot")
    total = segments.count()
    # ordinary anchors: their segments are counted and located in one shard
    everything = texts
    if not hot.isEmpty():
        everything = texts.join(hot, "h", "left_anti")
    everything = everything.select("h", F.lit(0).alias("salt"), F.lit(2).alias("kind"), "k", "th", "start", "text")
    if not hot.isEmpty():
        # hot anchors: equal segments are counted before the shuffle, their rows are salted
        rows = texts.join(hot, "h", "left_semi")
        each = store(distinct(rows), "distinct")
        dense = store(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(f"n > {most}").select("h"), "dense")
        plain = each.join(dense, "h", "left_anti")
        by = salts(plain)
        everything = everything.unionByName(counted(plain.join(by, "h"))).unionByName(salted(rows.join(by, "h")))
        if not dense.isEmpty():
            # too many different segments: their windows become the keys
            windows = store(_single_windows(rows.join(dense, "h", "left_semi"), size), "windows")
            own = distinct(windows)
            by = salts(own)
            everything = everything.unionByName(counted(own.join(by, "h"))).unionByName(salted(windows.join(by, "h")))
    shards = parts * max(1, -(-total // (parts * SHARD)))
    shard = F.pmod(F.xxhash64("h", "salt"), F.lit(shards)).cast("int")
    rows = everything.select(shard.alias("shard"), "kind", "k", "th", "start", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, automaton, held = None, {}, None, []
        out: list[tuple[int, int, int, int]] = []

        def enter(own: tuple, k: int, p: int, count: int) -> None:
            for i in range(len(own) - size + 1):
                window = own[i : i + size]
                seen = automaton.get(window, None)
                if seen is None:
                    automaton.add_word(window, [count, k, p + i])
                else:
                    seen[0] += count
                    if (k, p + i) < (seen[1], seen[2]):
                        seen[1], seen[2] = k, p + i

        def stream(own: tuple, k: int, th: int, p: int) -> None:
            a = b = -1
            for end, (c, fk, fp) in automaton.iter(own):
                s = p + end + 1 - size
                if c < 2 or (fk == k and fp == s):
                    continue
                if s > b:
                    if b > a:
                        out.append((k, th, a, b))
                    a = s
                b = s + size
            if b > a:
                out.append((k, th, a, b))

        def close() -> None:
            if len(automaton):
                automaton.make_automaton()
                for row in held:
                    stream(*row)
            held.clear()

        for batch in batches:
            for shard_, kind, k, th, p, text in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if shard_ != now:
                    if automaton is not None:
                        close()
                    now, number, automaton = shard_, {}, ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                own = tuple([number.setdefault(w, len(number) + 1) for w in text.split(" ")])
                if kind != 1:
                    enter(own, k, p, th if kind == 0 else 1)
                if kind != 0:
                    held.append((own, k, th, p))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["k", "th", "a", "b"])
                out.clear()
        if automaton is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["k", "th", "a", "b"])

    return rows.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(run, "k long, th long, a long, b long")


def find_repeats(docs: DataFrame, size: int = SIZE, whole_text: bool = False) -> DataFrame:
    """doc_id, k, th (key of the row), n_words, n_removed, kept: the kept words joined by
    one space, or their SHA-256, and ranges: removed word ranges [a, b)."""
    split = store(_split(_keyed(docs), size, whole_text), "split")
    segments = split.where("kind = 2").select("h", "k", "th", "start", "text")
    ranges = _locate(segments, size).groupBy("k", "th").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    suspects = split.where("kind = 1").select("doc_id", "k", "th", "n_words", "text").join(ranges, ["k", "th"], "left").select("doc_id", "k", "th", "n_words", "text", "ranges")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k long, th long, n_words long, n_removed long, kept string, ranges array<array<long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, spans = [], [], []
            for text, ranges in zip(batch.column(4), batch.column(5), strict=True):
                words = text.as_py().encode("utf-8", "replace").split()
                merged: list[list[int]] = []
                for r in sorted((x["a"], x["b"]) for x in ranges.as_py() or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append([*r])
                out, last = [], 0
                for a, b in merged:
                    out += words[last:a]
                    last = b
                clean = b" ".join(out + words[last:])
                removed.append(sum(b - a for a, b in merged))
                kept.append(clean.decode("utf-8", "replace") if whole_text else hashlib.sha256(clean).hexdigest())
                spans.append(merged)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=[x.split()[0] for x in schema.split(", ")])

    done = split.where("kind = 0").select("doc_id", "k", "th", "n_words", "n_removed", "kept", F.when(F.col("n_removed") > 0, F.array(F.array(F.lit(0).cast("long"), "n_words"))).otherwise(F.array().cast("array<array<long>>")).alias("ranges"))
    return done.unionByName(suspects.mapInArrow(run, schema))


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs with each text's kept words joined by one space (null stays null); all columns kept."""
    found = find_repeats(docs, size, whole_text=True).select("k", "th", "kept").dropDuplicates(["k", "th"])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    joined = keyed.join(found, ["k", "th"], "left")
    return joined.select(*[F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
