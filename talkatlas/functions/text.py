"""Scalar text, date and cost functions as Column expressions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_CHARS, CHUNK_OVERLAP = 2000, 200
TAG_CHARS = 40
_BAD = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f�]"


def strip_controls(text: Column) -> Column:
    """Without control signs (but tab, LF, CR) and replacement characters."""
    return F.regexp_replace(text, _BAD, "")


def chunk_windows(text: Column, cap: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping windows of at most cap characters, one every cap - overlap; the short
    last one stays even if its predecessor contains it. Empty text has none."""
    if cap <= overlap:
        raise ValueError("cap must exceed overlap")
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(cap - overlap))
    many = F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(cap)))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, none).when(F.length(text) <= cap, F.array(text)).otherwise(many)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs of an array of words."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def plain_text(markdown: Column) -> Column:
    """Markdown without fences, inline code, link targets and syntax signs; one space between words."""
    text = F.regexp_replace(markdown, r"(?s)```.*?```", " ")
    text = F.regexp_replace(text, r"`[^`]*`", " ")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    text = F.regexp_replace(text, r"[#>*_~|]+", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip_words(text: Column, cap: int) -> Column:
    """At most cap characters, cut at a word's end."""
    text = F.trim(text)
    cut = F.substring(text, 1, cap)
    at_word = F.regexp_replace(F.regexp_extract(cut, r"(?s)^(.*) ", 1), r"[ ,.;:-]+$", "")
    return F.when(F.length(text) <= cap, text).when(at_word != "", at_word).otherwise(F.rtrim(cut))


def sentences(text: Column) -> Column:
    """Sentences of 25 to 320 characters; a new one begins with a capital or a digit."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s).between(25, 320))


def code_fences(text: Column) -> Column:
    """array<struct<language, content>> of fenced code blocks with a body."""
    pattern = r"(?s)```([\w+#.-]*)[^\n]*\n(.*?)```"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("language"), F.transform(F.regexp_extract_all(text, F.lit(pattern), 2), lambda b: F.trim(F.regexp_replace(b, r"^\s+|\s+$", ""))).alias("content"))
    return F.filter(both, lambda b: b["content"] != "")


def urls(text: Column) -> Column:
    """Distinct URLs in order of appearance, trailing punctuation stripped."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<>\]]+"), 0)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,);]+$", "")))


def title_from(message: Column, cap: int = 90) -> Column:
    """The first line with something in it, without list and heading signs, clipped."""
    lines = F.transform(F.split(F.coalesce(message, F.lit("")), r"\r\n|\r|\n"), lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[#>*\-• ]+", "")))
    first = F.get(F.filter(lines, lambda s: s != ""), 0)
    return F.when(F.length(first) > cap, F.concat(F.substring(first, 1, cap), F.lit("..."))).otherwise(first)


def slug(text: Column, fallback: str = "untitled") -> Column:
    """Lower-case words joined by hyphens."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def normalise_tag(tag: Column) -> Column:
    """Trimmed, lower-cased, inner white space single, at most TAG_CHARS."""
    return F.substring(F.regexp_replace(F.lower(F.trim(tag)), r"\s+", " "), 1, TAG_CHARS)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def snippet(text: Column, query: str, width: int = 240) -> Column:
    """A window around the first query word found, escaped, with the words marked."""
    import re

    tokens = [t for t in re.findall(r"[A-Za-z0-9_]+", query.lower()) if len(t) > 1]
    place = F.lit(0)
    for t in reversed(tokens):
        at = F.locate(t, F.lower(text))
        place = F.when(at > 0, at).otherwise(place)
    start = F.greatest(F.lit(0), place - 1 - width // 3)
    start = F.when(place == 0, F.lit(0)).otherwise(start)
    out = html_escape(F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), F.substring(text, start + 1, F.lit(width))))
    if tokens:
        longest = "|".join(re.escape(t) for t in sorted(set(tokens), key=lambda t: (-len(t), t)))
        out = F.regexp_replace(out, f"(?i)({longest})", "<mark>$1</mark>")
    return F.concat(out, F.when(F.length(text) > width, F.lit("...")).otherwise(F.lit("")))


def truncate(text: Column, cap: int) -> Column:
    return F.when(F.length(text) > cap, F.concat(F.rtrim(F.substring(text, 1, cap)), F.lit(" …"))).otherwise(text)


def duration_label(seconds: Column) -> Column:
    """1h 2m 3s, without leading zero parts."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    parts = F.array(F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))), F.when(m > 0, F.concat(m.cast("string"), F.lit("m"))), F.when((r > 0) | (s == 0), F.concat(r.cast("string"), F.lit("s"))))
    return F.array_join(parts, " ")


def instant(text: Column) -> Column:
    """ISO text (with Z, an offset, or naive UTC) as a timestamp; null if it is none."""
    return F.try_to_timestamp(text)


def epoch_instant(number: Column) -> Column:
    """Seconds or, from 1e11 on, milliseconds since 1970 as a timestamp."""
    n = number.cast("double")
    return F.timestamp_micros((F.when(n >= 1e11, n * 1000).otherwise(n * 1_000_000)).cast("long"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if one is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def valid_vector(vector: Column, dim: int) -> Column:
    return (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))


def cost_usd(inp: Column, out: Column, read: Column, write: Column, write_1h: Column, prices: dict[str, Column], includes_cache: bool = True) -> Column:
    """Model cost in USD. prices: input, output, cached, and optional write, write_1h (USD per million)."""
    fresh = F.greatest(F.lit(0), inp - read - write - write_1h) if includes_cache else inp
    w5 = F.coalesce(prices.get("write", F.lit(None)), prices["input"] * 1.25)
    w60 = F.coalesce(prices.get("write_1h", F.lit(None)), prices["input"] * 2.0)
    return (fresh * prices["input"] + read * prices["cached"] + write * w5 + write_1h * w60 + out * prices["output"]) / 1_000_000
