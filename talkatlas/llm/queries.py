"""The registered queries opN_<name> of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, lm_score, mixing, near_dup, oracles, pii, quality, repeats, toxicity, winnow
from .tables import fold, held_out, read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted: quality of every document."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, "quality", fold("doc_id", 4) != 2)
    return quality.score(docs, model).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every document and of its edited text."""
    return winnow.neighbours(read(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the subword lattice model, and the word unigram base."""
    return lm_score.score_documents(read(spark, sf_dir, "documents"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets overlap by 85 % or more."""
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), 85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted: toxicity of every document."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels, "toxic", fold("doc_id", 3) != 1)
    return toxicity.score(docs, lexicon).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits", "entries"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document repeated to its source's target rate, globally shuffled."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars", F.round("rate", 6).alias("rate"), "replica")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark's windows of ten words; also the items with a window all of
    whose words lie within ten words and decontaminate.SLOP more."""
    found = decontaminate.find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_item_ids").cast("long").alias("n_near_items"),
        F.sha2(F.concat_ws(",", "near_item_ids").cast("binary"), 256).alias("near_items_sha256"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines similar to an earlier line."""
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans."""
    return pii.find(read(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without later occurrences of windows of twenty words."""
    found = repeats.find_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_fingerprints": op2_fingerprints,
    "op3_lm_score": op3_lm_score,
    "op4_near_dup": op4_near_dup,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii": op9_pii,
    "op10_repeats": op10_repeats,
}

ORACLE_SQL: dict[str, str] = {
    "op4_near_dup": oracles.near_duplicates("documents"),
    "op7_decontaminate": oracles.overlaps("documents", "benchmark"),
    "op10_repeats": oracles.repeats("documents"),
    "op8_line_dedup": line_dedup.oracle("documents"),
    "op6_mixing": mixing.oracle("d.doc_id, d.text, d.lang, d.source, d.n_chars, round(r.rate, 6) AS rate, replica", "documents"),
}
