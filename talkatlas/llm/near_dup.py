"""MinHash near-duplicates, with odd sketches before exact verification.

1. Each text becomes the set of its distinct five-word shingles (64-bit hashes),
   SAMPLES MinHash values, the hashes of BANDS bands of them, and an odd sketch:
   the parity bitmap into which the MinHash values fold. The population count of
   two sketches' XOR estimates a high similarity precisely.
2. Texts with equal sets are one class, represented by its smallest id; only
   representatives go on.
3. Band buckets of up to SMALL members give all their pairs. The members of larger
   buckets are joined exactly instead: shingles are ordered by rarity among these
   members (counted in a sketch of fixed size), and prefix, length and positional filters make the candidates. Every
   shingle's most central member is paired with the others first; after the
   links so found have been contracted, only members outside a shingle's main
   component are still paired. So a large group costs a few rows for each member, and no
   pair that could link different components is left out.
4. Candidates whose sketches differ far more than the threshold allows go (the
   bound lies over five standard deviations off); all others are confirmed on the full
   sets. 5. Links are contracted to components.

The bands miss a pair at the threshold with probability (1 - 0.85**4)**32, about
6e-11. Nothing is collected; groups are aggregated or joined, where adaptive
execution splits hot keys.

Defined results: null text, empty text and text without words have an empty set,
are linked with nothing and are kept; rows with the same doc_id count as one
document; a null doc_id is linked with nothing, has a null component and is kept;
extra columns are carried by `keep_one` and ignored otherwise; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .scratch import store

SHINGLE = 5
SAMPLES, BANDS, BITS = 128, 32, 512
SMALL = 16
#: Counters of the rarity sketch, as a power of two.
SKETCH = 16
_WORDS64 = BITS // 64
_ODD = (K.mix64(np.arange(1, SAMPLES + 1, dtype=K.U64)) | K.U64(1))[:, None]
_ADD = K.mix64(np.arange(1001, 1001 + SAMPLES, dtype=K.U64))[:, None]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes; fewer than k words are one shingle."""
    starts, ends, at = K.word_spans(buf, offs, K.SPACED)
    words = K.word_hashes(buf, starts, ends, K.FOLDED)
    grams = K.gram_hashes(words, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield K.gram_hashes(words[a:b], b - a, salt=b - a)
        else:
            yield np.zeros(0, dtype=K.U64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima; the set is walked in parts that stay in cache."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=K.U64)
    for a in range(0, len(shingles), 1024):
        part = shingles[a : a + 1024][None, :] * _ODD
        part += _ADD
        np.minimum(low, part.min(1), out=low)
    return K.mix64(low)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (number, value) pairs of the samples."""
    bit = (K.mix64(samples + np.arange(SAMPLES, dtype=K.U64)) % K.U64(BITS)).astype(np.int64)
    odd = np.bincount(bit, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def estimate(flips: int) -> float:
    """Similarity that odd sketches with so many different bits estimate."""
    inner = 1 - 2 * flips / BITS
    return 1 + BITS / (4 * SAMPLES) * float(np.log(inner)) if inner > 0 else 0.0


def most_flips(similarity: float, deviations: float = 6.0) -> int:
    """Different bits beyond which a pair of that similarity all but never lies."""
    low = similarity - deviations * float(np.sqrt(similarity * (1 - similarity) / SAMPLES))
    apart = 2 * SAMPLES * (1 - max(low, 0.0))
    mean = BITS / 2 * (1 - float(np.exp(-2 * apart / BITS)))
    return int(mean + 3 * np.sqrt(mean)) + 1


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n, set_a, set_b (identity of the set), bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.arange(BANDS, dtype=K.U64)
        for batch in batches:
            whole, offs = K.text_buffer(batch.column(1))
            for r0, r1 in K.doc_blocks(offs, 4 << 20):
                rows = r1 - r0
                n, ident = np.zeros(rows, np.int64), np.zeros((rows, 2), np.uint64)
                bands, sketch = np.zeros((rows, BANDS), np.uint64), np.zeros((rows, _WORDS64), np.int64)
                for i, s in enumerate(shingle_sets(whole[offs[r0] : offs[r1]], offs[r0 : r1 + 1] - offs[r0], k)):
                    n[i] = len(s)
                    if len(s):
                        ident[i] = K.mix64(s).sum(dtype=K.U64), K.mix64(s ^ K.U64(0x5DEECE66D)).sum(dtype=K.U64)
                        m = minhash(s)
                        bands[i] = K.gram_hashes_rows(m.reshape(BANDS, -1)) + rank
                        sketch[i] = odd_sketch(m)
                flat = lambda x, w: pa.FixedSizeListArray.from_arrays(pa.array(_long(x.ravel()) if x.dtype == np.uint64 else x.ravel()), w).cast(pa.list_(pa.int64()))
                bands = K.mix64(bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(r0, rows), pa.array(n), pa.array(_long(ident[:, 0].copy())), pa.array(_long(ident[:, 1].copy())), flat(bands, BANDS), flat(sketch, _WORDS64)],
                    names=["doc_id", "n", "set_a", "set_b", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, set_a long, set_b long, bands array<long>, sketch array<long>")


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, offs = K.text_buffer(batch.column(1))
            for r0, r1 in K.doc_blocks(offs, 2 << 20):
                sets = list(shingle_sets(whole[offs[r0] : offs[r1]], offs[r0 : r1 + 1] - offs[r0], k))
                at = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, r1 - r0), K.list_array(_long(np.concatenate(sets)), at, pa.int64())], names=["id", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "id long, items array<long>")


def _flips(a: str, b: str) -> Column:
    total = F.lit(0)
    for i in range(_WORDS64):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def _could_link(na: str, nb: str, sa: str, sb: str, percent: int) -> Column:
    """Length filter and odd sketches."""
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (_flips(sa, sb) <= most_flips(percent / 100))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach percent; sketches decide first."""
    thin = sets.select("id", "n", "sketch")
    left = thin.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = thin.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    likely = pairs.join(left, "a").join(right, "b").where(_could_link("na", "nb", "sa", "sb", percent)).select("a", "b", "na", "nb")
    full = likely.join(sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
    common = F.size(F.array_intersect("ia", "ib"))
    return full.withColumn("common", common).where(F.col("common") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b").distinct()


def _open_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, main): keys whose rows (key, id, comp) lie in several components, with the most frequent one."""
    each = rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy(key).agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("main")).where("comps > 1").select(key, "main")


def link(docs: DataFrame, percent: int = 85, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(members, components): members has doc_id, n, rep (null for an empty set);
    components has (v, component) of the representatives that aren't their component's smallest."""
    sig = store(signatures(docs, k), "signatures")
    own = ["set_a", "set_b", "n"]
    classes = sig.where("n > 0").groupBy(*own).agg(F.min("doc_id").alias("rep"))
    members = store(sig.select("doc_id", *own).join(classes, own, "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "members")
    reps = sig.where("n > 0").join(members.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "set_a", "set_b"])
    in_bands = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    shared = in_bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = store(in_bands.join(shared, "band"), "buckets")
    wanted = buckets.select("id").distinct()
    described = sig.join(wanted, sig["doc_id"] == wanted["id"], "left_semi").select(F.col("doc_id").alias("id"), "n", "sketch").dropDuplicates(["id"])
    texts = docs.join(wanted, docs["doc_id"].cast("long") == wanted["id"], "left_semi")
    sets = store(_full_sets(texts, k).withColumn("n", F.size("items").cast("long")).join(described.drop("n"), "id"), "sets")

    few = buckets.where(F.col("size") <= SMALL).select("band", "id")
    close = few.join(few.withColumnRenamed("id", "b"), "band").where("id < b").select(F.col("id").alias("a"), "b").distinct()
    hot = buckets.where(F.col("size") > SMALL).select("id").distinct()
    links = _verify(close, sets, percent)
    if hot.isEmpty():
        links = store(links, "links")
    else:
        prefix = store(_prefixes(sets.join(hot, "id", "left_semi"), percent), "prefixes")
        first = prefix.groupBy("item").agg(F.min_by(F.struct("id", "n", "pos", "sketch"), F.struct("pos", "id")).alias("c"))
        star = prefix.join(first, "item").where("id != c.id").where(_places("n", "pos", "c.n", "c.pos", percent) & _could_link("n", "c.n", "sketch", "c.sketch", percent))
        links = store(links.unionByName(_verify(star.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct(), sets, percent)), "links")
        comps = connected_components(links)
        placed = prefix.join(comps.withColumnRenamed("v", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        placed = store(placed.join(_open_keys(placed, "item"), "item"), "open")
        minor = placed.where("comp != main").select("item", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("sketch").alias("sx"), F.col("comp").alias("cx"))
        rest = placed.join(minor, "item").where("comp != cx and (comp = main or x < id)").where(_places("n", "pos", "nx", "px", percent) & _could_link("n", "nx", "sketch", "sx", percent))
        more = _verify(rest.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct(), sets, percent)
        links = comps.select(F.col("v").alias("a"), F.col("component").alias("b")).unionByName(more)
    return members, connected_components(links)


def _rarity(sets: DataFrame) -> np.ndarray:
    """Counts of the items in a sketch of 2**SKETCH buckets: a fixed size, counted once a task
    and bucket before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH, np.int64)
        for batch in batches:
            items = batch.column(0).flatten().to_numpy().view(np.uint64)
            counts += np.bincount((items >> K.U64(64 - SKETCH)).astype(np.int64), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["b", "c"])

    out = np.zeros(1 << SKETCH, np.int64)
    for r in sets.select("items").mapInArrow(run, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).collect():
        out[r.b] = r.c
    return out


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(item, id, n, pos, sketch): the prefix of each set in order of rarity. Any one order of all
    items makes the join exact; the sketch's puts the items of few sets first, and what
    it counts once only one set has."""
    shared = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            column = batch.column(1)
            at, flat = column.offsets.to_numpy(), column.flatten().to_numpy()
            at = at - at[0]
            row, pos, item, size = [], [], [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = flat[a:b]
                often = counts[(own.view(np.uint64) >> K.U64(64 - SKETCH)).astype(np.int64)]
                order = np.lexsort((own, often))[: b - a - -(-(b - a) * percent // 100) + 1]
                keep = np.flatnonzero(often[order] > 1)
                row.append(np.full(len(keep), i))
                pos.append(keep)
                item.append(own[order[keep]])
                size.append(np.full(len(keep), b - a))
            if row:
                ids = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(row)]), pa.array(np.concatenate(size)), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.concatenate(item))], names=["id", "n", "pos", "item"])

    return sets.select("id", "items").mapInArrow(run, "id long, n long, pos int, item long").join(sets.select("id", "sketch"), "id")


def _places(na: str, pa_: str, nb: str, pb: str, percent: int) -> Column:
    """Positional filter for the first common item at these places."""
    left = F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb))
    return left * (100 + percent) >= (F.col(na) + F.col(nb)) * percent


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    members, comps = link(docs, percent, k)
    found = members.join(comps, members["rep"] == comps["v"], "left")
    component = F.coalesce("component", "rep", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """docs with one document (the smallest id) of each group; all columns kept. Of rows
    with equal ids that stay, all stay."""
    gone = near_duplicates(docs, percent, k).where(~F.col("kept")).select(F.col("doc_id").alias("gone__")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("gone__"), "left_anti")
