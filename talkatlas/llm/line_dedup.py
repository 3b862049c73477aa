"""Line dedup: an exact set-similarity join of all lines, in DataFrame functions only.

A line's tokens are its distinct five-word shingles (a shorter line is one token);
a line is removed if an earlier line (smaller doc_id, or the same document and an
earlier place) has the same words or a Jaccard similarity of at least `percent`.
Words are split at spaces, tabs, CR, FF and VT, A-Z lower-cased. Every line is judged
on the input. Lines without words are never matched.

1. Words are counted over the whole corpus in a sketch of 2**SKETCH counters. A token's
   rarity is its rarest word's count there (in powers of two, ties by hash): one order
   of all tokens, rare ones first, which is all that a prefix filter needs to be exact.
2. Each line becomes the identity of its words (two 64-bit hashes) and the prefix of its
   tokens in that order. Equal lines are grouped: all but the first go.
3. Two similar lines share a token within their prefixes. Tokens that only equal lines
   have are dropped by one count that is aggregated before its shuffle.
4. Prefix, length and positional filters make pairs, 128-bit parity bitmaps (a bound on the
   difference) thin them out, and the full token sets verify them. Each token's earliest and most central lines are tried first; only lines
   that have not matched yet are paired with the token's other earlier lines, so
   that a large group of similar lines costs a few pairs for each line.

Defined results: null text stays null and has no lines; empty text is one line without
words; rows with equal doc_id and equal text are one document (equal results); rows
with equal doc_id and different texts are ordered by a hash of the text; a null doc_id
comes first; very long lines are ordinary lines; extra columns of any name are carried
by `dedup_lines`; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, store

SHINGLE = 5
#: Counters of the word sketch, as a power of two.
SKETCH = 14
_NULL = -(1 << 63)
_ID = ["k", "th", "no"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, inside one expression."""
    return F.get(F.transform(F.array(value), body), 0)


def _folded(docs: DataFrame) -> DataFrame:
    """docs with text folded for comparison: A-Z lower-cased, the words of a line parted by single spaces, as many lines
    as before. The costlier clean-up only where a text needs it."""
    text = F.col("text")
    # of bytes as Latin-1, lower() changes A-Z and some first bytes of UTF-8 sequences; as it keeps the bytes
    # that follow, and a first byte tells how many do, different texts stay different
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.lower(F.decode(text.cast("binary"), "ISO-8859-1")))
    docs = docs.withColumn("text", low)
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\f")) | F.contains(text, F.lit("\x0b"))
    docs = docs.withColumn("text", F.when(odd, F.translate(text, "\t\r\f\x0b", "    ")).otherwise(text))
    gaps = F.contains(text, F.lit("  ")) | F.contains(text, F.lit(" \n")) | F.contains(text, F.lit("\n ")) | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    single = F.trim(F.regexp_replace(F.regexp_replace(text, " {2,}", " "), " ?\n ?", "\n"))
    return docs.withColumn("text", F.when(gaps, single).otherwise(text))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - SKETCH).cast("int")


def _word_hashes(line: Column) -> Column:
    """Of a folded line."""
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


def rarity_classes(docs: DataFrame) -> list[int]:
    """For each of 2**SKETCH buckets of word hashes, the power of two of its count over all
    texts: 0 for the rarest. A fixed size, whatever the corpus."""
    # explode_outer: explode makes the optimizer add a filter that cuts the text once more
    flat = _folded(docs.select("text")).select(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("text"))
    words = flat.select(F.explode_outer(F.split("text", " ")).alias("w")).where("w <> ''")
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()
    out = [0] * (1 << SKETCH)
    for r in counts:
        out[r.b] = int(math.log2(r.c))
    return out


def _tokens(h: Column, k: int = SHINGLE, classes: Column | None = None) -> Column:
    """Distinct tokens of an array of word hashes. With the sketch's classes a token begins with
    its rarity, so that sorting puts rare ones first."""

    def many(x: Column, ranks: Column | None) -> Column:
        def one(i: Column) -> Column:
            value = F.shiftrightunsigned(F.xxhash64(*[F.get(x, i + j) for j in range(k)]), 6)
            return value if ranks is None else value.bitwiseOR(F.shiftleft(F.least(*[F.get(ranks, i + j) for j in range(k)]).cast("long"), 58))

        return F.transform(F.sequence(F.lit(0), F.size(x) - k), one)

    whole = F.array(F.shiftrightunsigned(F.xxhash64(F.size(h), h), 6))
    if classes is None:
        return F.array_distinct(F.when(F.size(h) >= k, many(h, None)).otherwise(whole))
    ranked = _let(F.transform(h, lambda w: F.get(classes, _bucket(w))), lambda ranks: many(h, ranks))
    return F.array_distinct(F.when(F.size(h) >= k, ranked).otherwise(whole))


def _prefix_size(n: Column, percent: int) -> Column:
    return (n - F.ceil(n * percent / 100) + 1).cast("int")


def _line_table(keyed: DataFrame, percent: int) -> DataFrame:
    """k, th, no, c1, c2 (identity of the words), n (number of tokens), head (their prefix) of every line with words."""
    classes = F.split(F.lit(",".join(map(str, rarity_classes(keyed)))), ",").cast("array<tinyint>")
    # lines without words go by a test of the line itself: a filter on what is described below would be
    # pushed under it and describe every line twice
    folded = _folded(keyed.select("k", "th", "text"))
    lines = folded.select("k", "th", F.posexplode_outer(F.split("text", "\n")).alias("no", "line")).where("line <> ''")

    def prefix(items: Column) -> Column:
        # a line of fewer words than a token has only equal lines
        return F.struct(F.size(items).alias("n"), F.slice(F.sort_array(items), F.lit(1), _prefix_size(F.size(items), percent)).alias("head"))

    described = _let(
        _word_hashes(F.col("line")),
        lambda h: F.struct(F.size(h).alias("size"), F.xxhash64(h).alias("c1"), F.xxhash64(F.lit(1), h).alias("c2"), _let(_tokens(h, SHINGLE, classes), prefix).alias("p")),
    )
    none = F.array().cast("array<bigint>")
    return lines.select(*_ID, described.alias("x")).select(*_ID, "x.c1", "x.c2", "x.p.n", F.when(F.col("x.size") >= SHINGLE, F.col("x.p.head")).otherwise(none).alias("head"))


def _shared_tokens(table: DataFrame) -> DataFrame:
    """item, c1, n, pos: the prefix tokens that two different lines or more have. These are found and stored first, so
    that the shuffle which counts is gone before the tokens are shuffled with what else they carry."""
    each = table.select(F.explode("head").alias("item"), "c1")
    shared = store(each.groupBy("item").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).where("a < b").select("item"), "twice")
    rows = table.select("c1", "n", F.posexplode("head").alias("pos", "item"))
    # n and pos go through the shuffle as one number
    rows = rows.select("item", "c1", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("at"))
    kept = rows.join(shared, "item").select("item", "c1", "at").distinct()
    return kept.select("item", "c1", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))


def _fits(x: str, y: str, percent: int) -> Column:
    """Length, positional and bitmap filters for lines (n, pos, b0, b1, under these prefixes)
    that share a token; all three are bounds, so no similar pair is lost."""
    nx, px, ny, py = F.col(f"{x}n"), F.col(f"{x}pos"), F.col(f"{y}n"), F.col(f"{y}pos")
    lengths = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent
    places = F.least(nx - px, ny - py) * (100 + percent) >= (nx + ny) * percent
    flips = F.bit_count(F.col(f"{x}b0").bitwiseXOR(F.col(f"{y}b0"))) + F.bit_count(F.col(f"{x}b1").bitwiseXOR(F.col(f"{y}b1")))
    # |x & y| >= percent / (100 + percent) * (nx + ny), and flips <= nx + ny - 2 |x & y|
    return lengths & places & ((nx + ny - flips) * (100 + percent) >= (nx + ny) * (2 * percent))


_ROW = ("id", "n", "pos", "b0", "b1")


def _led(prefix: DataFrame, percent: int) -> DataFrame:
    """id, y: each line with its tokens' earliest and most central lines, if earlier and fitting."""
    row = F.struct(*_ROW)
    leaders = prefix.groupBy("item").agg(F.min(row).alias("a"), F.min_by(row, F.struct("pos", "id")).alias("b"))
    led = prefix.join(leaders, "item").withColumn("y", F.explode(F.array("a", "b"))).where("y.id < id")
    return led.where(_fits("", "y.", percent)).select("id", F.col("y.id").alias("y")).distinct()


def _others(prefix: DataFrame, matched: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """id, y: lines that have not matched, with all other earlier lines of their tokens that fit."""
    open_ = prefix.join(matched, "id", "left_anti")
    rest = prefix.select("item", *[F.col(c).alias(f"y{c}") for c in _ROW])
    pairs = open_.join(rest, "item").where("yid < id").where(_fits("", "y", percent))
    return pairs.select("id", F.col("yid").alias("y")).distinct().join(tried, ["id", "y"], "left_anti")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id) of the pairs whose full token sets are similar enough."""
    x = sets.select("id", F.col("items").alias("ix"))
    y = sets.select(F.col("id").alias("y"), F.col("items").alias("iy"))
    common = F.size(F.array_intersect("ix", "iy"))
    full = pairs.join(x, "id").join(y, "y")
    return full.where(common * (100 + percent) >= (F.size("ix") + F.size("iy")) * percent).select("id").distinct()


def _sets(asked: DataFrame) -> DataFrame:
    """id and items of the asked lines (numbers and ids by document); a text is cut once."""
    own = _folded(asked.select("text", "asked")).select(F.split("text", "\n").alias("own"), "asked")
    each = own.select(F.explode_outer(F.transform("asked", lambda a: F.struct(a["id"].alias("id"), F.get("own", a["no"]).alias("line")))).alias("x"))
    return each.select("x.id", _let(_word_hashes(F.col("x.line")), lambda h: _tokens(h)).alias("items"))


def _bits(sets: DataFrame) -> DataFrame:
    """id and 128 parity bits b0 and b1 of its tokens. A token flips one bit, so two lines' bits
    differ in no more places than their token sets in tokens. A line's tokens are in one task: one
    row a line is shuffled."""
    flip = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t").bitwiseAND(F.lit(63)).cast("int"))
    high = F.shiftright("t", 6).bitwiseAND(F.lit(1)) == 1
    none = F.lit(0).cast("long")
    each = sets.select("id", F.explode("items").alias("t"))
    return each.groupBy("id").agg(F.bit_xor(F.when(high, none).otherwise(flip)).alias("b0"), F.bit_xor(F.when(high, flip).otherwise(none)).alias("b1"))


def _without(text: Column, gone: Column) -> Column:
    """text without the lines of these numbers."""
    left = _let(F.split(text, "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)), "\n"))
    return F.when(F.size(gone) == 0, text).otherwise(left)


def _judge(docs: DataFrame, percent: int, digest: bool) -> DataFrame:
    """row (the other columns), n_lines, n_removed, kept (or its SHA-256), words (whether any is left)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*others).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("k"), F.xxhash64("text").alias("th"))
    table = store(_line_table(keyed, percent), "lines")
    own = F.struct(*_ID)
    classes = table.groupBy("c1", "c2").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("c"))
    copies = table.drop("head", "n").join(classes.where("c > 1"), ["c1", "c2"]).where(own != F.col("first"))
    later = store(copies.groupBy("k", "th").agg(F.collect_set("no").alias("later")), "later")
    shared = store(_shared_tokens(table), "shared")
    # candidates get dense numbers in the order of their places: short keys for what follows
    found = classes.join(shared.select("c1").distinct(), "c1").select("c1", "first.k", "first.th", "first.no")
    numbered = store(found.orderBy("k", "th", "no").withColumn("id", F.monotonically_increasing_id()), "numbered")
    drop(table)  # before the texts are shuffled
    asked = numbered.groupBy("k", "th").agg(F.collect_list(F.struct("no", "id")).alias("asked"))
    marked = keyed.join(later.join(asked, ["k", "th"], "full"), ["k", "th"], "left")
    none = F.array().cast("array<int>")
    is_open = F.col("asked").isNotNull()

    def verdict(gone: Column) -> list[Column]:
        lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
        kept = _without(F.col("text"), gone)
        done = _let(kept, lambda x: F.struct((F.sha2(F.coalesce(x, F.lit("")).cast("binary"), 256) if digest else x).alias("kept"), (x.rlike(r"\S")).alias("words")))
        return [lines.alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), done.alias("done")]

    gone = F.coalesce("later", none)
    first = [F.when(~is_open, c).alias(n) for c, n in zip(verdict(gone), ("n_lines", "n_removed", "done"), strict=True)]
    # a document without candidate lines is finished here; only the others' texts go on
    split = store(marked.select("row", "k", "th", *first, F.when(is_open, F.col("text")).alias("text"), "later", "asked"), "split")
    drop(later)
    open_ = split.where(is_open).select("row", "k", "th", "text", "later", "asked")
    sets = store(_sets(open_), "sets")
    prefix = store(shared.join(numbered.select("c1", "id"), "c1").join(_bits(sets), "id").select("item", *_ROW).distinct(), "prefix")
    drop(shared)
    led = store(_led(prefix, percent), "led")
    matched = store(_verified(led, sets, percent), "matched")
    similar = store(matched.unionByName(_verified(_others(prefix, matched, led, percent), sets, percent)).distinct(), "similar")
    drop(sets, prefix, led, matched)
    near = numbered.join(similar, "id").groupBy("k", "th").agg(F.collect_set("no").alias("near"))
    some = open_.join(near, ["k", "th"], "left").withColumn("gone", F.array_union(F.coalesce("later", none), F.coalesce("near", none)))
    both = split.where(~is_open).select("row", "n_lines", "n_removed", "done").unionByName(some.select("row", *verdict(F.col("gone"))))
    return both.select("row", "n_lines", "n_removed", "done.kept", "done.words")


def dedup_lines(docs: DataFrame, percent: int = 80, drop_emptied: bool = True) -> DataFrame:
    """docs with the remaining lines as text; all columns kept. A document that had words
    and lost all of them goes, unless drop_emptied is false."""
    out = _judge(docs, percent, False)
    if drop_emptied:
        out = out.where((F.col("n_removed") == 0) | F.coalesce("words", F.lit(False)))
    return out.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every row of docs."""
    return _judge(docs.select("doc_id", "text"), percent, True).select("row.doc_id", "n_lines", "n_removed", F.col("kept").alias("kept_sha256"))


def oracle(table: str, percent: int = 80, k: int = SHINGLE) -> str:
    """DuckDB SQL for line_report() (unique, non-null ids)."""
    return f"""
WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {table} WHERE text IS NOT NULL)),
worded AS (SELECT doc_id, no, list_filter(string_split(translate(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(9) || chr(13) || chr(12) || chr(11), '    '), ' '), lambda x: x <> '') AS w FROM lines),
classes AS (SELECT w, min(struct_pack(d := doc_id, n := no)) AS id FROM worded WHERE len(w) > 0 GROUP BY w),
tokens AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k} - 1], ' ')) END) AS t,
           CASE WHEN len(w) < {k} THEN len(w) ELSE {k} END AS kind FROM classes),
sizes AS (SELECT id, count(*) AS n FROM tokens GROUP BY id),
common AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.kind = b.kind AND b.id < a.id GROUP BY ALL),
alike AS (SELECT DISTINCT x AS id FROM common JOIN sizes sx ON sx.id = x JOIN sizes sy ON sy.id = y WHERE c * {100 + percent} >= (sx.n + sy.n) * {percent}),
gone AS (SELECT w.doc_id, w.no FROM worded w JOIN classes c ON w.w = c.w LEFT JOIN alike s ON s.id = c.id WHERE s.id IS NOT NULL OR struct_pack(d := w.doc_id, n := w.no) <> c.id),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.no) AS n_removed, coalesce(string_agg(CASE WHEN g.no IS NULL THEN l.line END, chr(10) ORDER BY l.no), '') AS t
         FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.no = l.no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM {table} d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
