"""Personal data: exact base patterns, and bootstrapped contextual extraction.

DataFrame functions only. The base finds e-mail addresses, IP addresses, card and
phone numbers by regular expressions whose failing matches are dropped. Then the
method bootstraps:

1. Base spans are seed entities, and so, of a further kind (secret), are tokens that look like keys: LONG_KEY signs or
   more in which letters and digits alternate. The words around them are lexical patterns: two words before, two
   words after, one on either side (words that lie within CONTEXT characters and, at the other side of a
   neighbouring match of the same expression, aren't seen).
2. Tokens with digits are candidate identifiers, of any length; they stand in the same kinds of patterns. What has no
   digit is a name or a word, not an identifier, and never a candidate. Tokens that touch a base span, or a match
   that its check rejected (of cards: one of 12 digits or more), aren't candidates.
3. Distinct (pattern, instance) pairs form a graph, aggregated before it is joined.
   A pattern's confidence for a kind is the sum of its instances' scores over their
   number plus one, if at least MIN_SEEDS different seeds support it; a
   candidate's score is that of its best pattern. ROUNDS rounds of this are run.
4. Candidates that stand in a pattern with a confidence of at least ACCEPT are spans of its kind. A key's
   looks alone make no span: it must stand in such a pattern, too.

Offsets come from the lengths of what lies between matches, summed in a window for
each document and kind, so a text with very many matches costs a sort, not a square.

Defined results: null text counts as empty; rows with equal id and text have equal
results; a null id is kept; an empty table gives no rows; very long texts are matched whole;
extra columns of any name are ignored by `find` and carried by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import store

KINDS = ("email", "ip", "card", "phone", "secret")
#: Number of the expression of tokens; of spans, the kind of this number is a secret.
TOKEN = SECRET = 4
LONG_KEY = 20
MIN_SEEDS = 5
ACCEPT = 0.8
ROUNDS = 3
CONTEXT = 60
_NULL = -(1 << 63)

# The contract's expressions. Where a run of one class of signs must come first, only the
# run's beginning (or the end of the last match, \G) can start a match, and possessive
# quantifiers take what greedy ones would end up with: same matches, linear time, no recursion.
_LOCAL = r"A-Za-z0-9._%+-"
_REGEX = (
    rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
    r"(?:(?<!\S)|\G)[^\s0-9]*+[0-9]\S*+",
)
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string (at most 19) is a multiple of 10."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    card = F.when((n >= 14) & (n <= 19), _luhn(F.when((n >= 14) & (n <= 19), digits).otherwise(F.lit("0")))).otherwise(F.lit(False))
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == 2, card)
        .when(kind == 3, (n >= 10) & (n <= 15))
        .otherwise(F.lit(True))
    )


def _matches(keyed: DataFrame) -> DataFrame:
    """k, th, kind, start, end, match, left, right (context) of every match of every expression."""
    text = F.col("text")
    gap = "struct<size:int,tail:string,head:string>"
    tests = (text.contains("@"), *[text.rlike("[0-9]")] * 4)

    def found(i: int) -> Column:
        parts = F.transform(F.split(text, _REGEX[i], -1), lambda p: F.struct(F.length(p).alias("size"), F.substring(p, -CONTEXT, CONTEXT).alias("tail"), F.substring(p, 1, CONTEXT).alias("head")))
        empty = F.array()
        return F.struct(
            F.lit(i).alias("kind"),
            F.when(tests[i], parts).otherwise(empty.cast(f"array<{gap}>")).alias("gaps"),
            F.when(tests[i], F.regexp_extract_all(text, F.lit(_REGEX[i]), 0)).otherwise(empty.cast("array<string>")).alias("hits"),
        )

    all_kinds = keyed.select("k", "th", F.explode(F.array(*[found(i) for i in range(5)])).alias("f")).where(F.size("f.hits") > 0)
    n = F.size("f.hits")
    zipped = F.arrays_zip(F.slice("f.gaps", F.lit(1), n).alias("g"), F.col("f.hits").alias("m"), F.slice("f.gaps", F.lit(2), n).alias("a"))
    rows = all_kinds.select("k", "th", "f.kind", F.posexplode(zipped).alias("i", "z"))
    rows = rows.select("k", "th", "kind", "i", F.col("z.g.size").alias("gap"), F.col("z.g.tail").alias("left"), F.col("z.m").alias("match"), F.col("z.a.head").alias("right"))
    rows = rows.repartition("k", "th", "kind").dropDuplicates(["k", "th", "kind", "i"])
    w = Window.partitionBy("k", "th", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(w).cast("long")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    return rows.select("k", "th", "kind", "start", "end", "match", "left", "right", _valid(F.col("kind"), F.col("match")).alias("ok"))


def _candidates(matches: DataFrame) -> DataFrame:
    """Tokens (punctuation at the ends taken off) that touch no base match, valid or rejected;
    of short runs of digits, which are no cards, nothing follows."""
    lead = F.length(F.regexp_extract("match", r"^[^\p{L}0-9]*+", 0))
    core = F.regexp_replace("match", r"^[^\p{L}0-9]++|[^\p{L}0-9]++$", "")
    cut = matches.where(F.col("kind") == TOKEN).withColumn("start", F.col("start") + lead).withColumn("match", core).withColumn("end", F.col("start") + F.length("match"))
    telling = F.col("ok") | (F.col("kind") != 2) | (F.length(F.regexp_replace("match", "[^0-9]", "")) >= 12)
    both = cut.unionByName(matches.where((F.col("kind") < TOKEN) & telling))
    order = Window.partitionBy("k", "th").orderBy("start", "kind")
    base = F.col("kind") < TOKEN
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = both.withColumn("before", before).withColumn("after", after).where(~base)
    return free.where((F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.col("after").isNull() | (F.col("after") >= F.col("end"))) & (F.length("match") > 0)).drop("before", "after")


def _patterns(rows: DataFrame) -> DataFrame:
    """rows with a column pattern: one row for each pattern that the match stands in."""
    left = F.array_remove(F.split(F.lower("left"), r"\s+"), "")
    right = F.array_remove(F.split(F.lower("right"), r"\s+"), "")
    rows = rows.withColumn("l", F.explode(F.array(left))).withColumn("r", F.explode(F.array(right)))
    l1, l2, r1, r2 = F.try_element_at("l", F.lit(-1)), F.try_element_at("l", F.lit(-2)), F.try_element_at("r", F.lit(1)), F.try_element_at("r", F.lit(2))
    each = F.array(F.concat(F.lit("L "), l2, F.lit(" "), l1), F.concat(F.lit("R "), r1, F.lit(" "), r2), F.concat(F.lit("B "), l1, F.lit(" _ "), r1))
    return rows.withColumn("pattern", F.explode(F.filter(each, lambda p: p.isNotNull()))).drop("l", "r", "left", "right")


def _like_key(token: Column) -> Column:
    """Whether a token looks like a key: long, of a key's signs, with letters and digits in turns."""
    return token.rlike(rf"^[A-Za-z0-9_+/=-]{{{LONG_KEY},}}$") & token.rlike("(?:[A-Za-z]+[0-9]+){4}")


def bootstrap(matches: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, accept: float = ACCEPT) -> DataFrame:
    """k, th, kind, start, end of identifiers that the base doesn't know."""
    seeds = matches.where((F.col("kind") < TOKEN) & F.col("ok"))
    free = _candidates(matches).withColumn("key", _like_key(F.col("match")))
    candidates = store(_patterns(free).select("k", "th", "start", "end", F.lower("match").alias("item"), "pattern", "key"), "candidates")
    keys = candidates.where("key").select("pattern", F.lit(SECRET).alias("kind"), "item")
    known = _patterns(seeds).select("pattern", "kind", F.lower("match").alias("item")).unionByName(keys).distinct()
    support = known.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    total_known = known.select("pattern", "item").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    edges = store(candidates.where("not key").select("pattern", "item").distinct(), "edges")
    unknown = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("u"))
    strong = store(support.where(F.col("seeds") >= min_seeds).join(total_known, "pattern").join(unknown, "pattern", "left").fillna(0, ["u"]), "strong")
    scores = None
    if strong.isEmpty():
        return candidates.select("k", "th", F.lit(0).alias("kind"), "start", "end").limit(0)
    live = edges.join(strong.select("pattern").distinct(), "pattern", "left_semi")
    for _ in range(rounds):
        gained = F.lit(0.0)
        table = strong
        if scores is not None:
            extra = live.join(scores, "item").groupBy("pattern", "kind").agg(F.sum("score").alias("extra"))
            table = strong.join(extra, ["pattern", "kind"], "left")
            gained = F.coalesce("extra", F.lit(0.0))
        trust = store(table.select("pattern", "kind", ((F.col("seeds") + gained) / (F.col("n") + F.col("u") + 1)).alias("trust")), "trust")
        scores = store(live.join(trust, "pattern").groupBy("item", "kind").agg(F.max("trust").alias("score")), "scores")
    good = trust.where(F.col("trust") >= accept)
    place = candidates.join(good, "pattern").groupBy("k", "th", "start", "end").agg(F.max_by("kind", F.struct("trust", -F.col("kind"))).alias("kind"))
    return place.select("k", "th", "kind", "start", "end")


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_added, n_private (all spans) for every row of docs."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("k"), F.xxhash64("text").alias("th"))
    matches = store(_matches(keyed), "matches")
    base = matches.where((F.col("kind") < TOKEN) & F.col("ok")).select("k", "th", "kind", "start", "end", F.lit(True).alias("base"))
    rows = base.unionByName(bootstrap(matches).withColumn("base", F.lit(False)))
    span = F.struct("start", "kind", "end")
    counts = [F.count_if((F.col("kind") == i) & F.col("base")).alias(f"n_{name}") for i, name in enumerate(KINDS[:SECRET])]
    per = rows.groupBy("k", "th").agg(*counts, F.collect_list(F.when(F.col("base"), span)).alias("b"), F.collect_list(span).alias("s"), F.count_if(~F.col("base")).alias("n_added"), F.count(F.lit(1)).alias("n_private"))
    joined = keyed.select("doc_id", "k", "th").join(per, ["k", "th"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    text = lambda c: F.coalesce(_listed(F.col(c)), F.lit(""))
    return joined.select("doc_id", *[zero(f"n_{x}") for x in KINDS[:SECRET]], F.sha2(text("b").cast("binary"), 256).alias("base_sha256"), text("s").alias("spans"), zero("n_added"), zero("n_private"))


def redact(docs: DataFrame, spans: DataFrame, mark: str = "[private]") -> DataFrame:
    """docs (unique ids) with every span of find()'s result replaced by mark; all columns kept."""
    wanted = spans.select(F.col("doc_id").alias("id"), "spans")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(wanted, F.col("row.doc_id") == F.col("id"), "left")
    cuts = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), F.split(s, ":")[2].cast("int").alias("b")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("row.text")

    def step(acc: Column, c: Column) -> Column:
        fresh = c["a"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, c["a"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], c["b"]).alias("at"), out.alias("out"))

    done = F.aggregate(cuts, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return df.select(*[F.when(F.coalesce("spans", F.lit("")) == "", text).otherwise(done).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
