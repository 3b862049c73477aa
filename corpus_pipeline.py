"""The corpus pipeline: five stages over documents, each written and read again.

Rejects toxic documents, removes lines that repeat, keeps one document of each
group of near-duplicates, drops documents that hold benchmark passages, and
repeats what is left to the sources' target weights.

Defined results, of every stage: a null or empty text is never toxic, similar or contaminated and stays; rows with
equal or null ids are each judged, by their text; very long texts are read whole; an empty table gives an
empty one; extra columns of any name are carried along (the last stage replaces columns named rate and replica).
A stage's tables go when the next stage begins; tables of other queries are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkatlas.llm import decontaminate, line_dedup, mixing, near_dup, scratch, toxicity
from talkatlas.llm.tables import fold, read

TOXIC_AT = 0.7
SIMILAR_PERCENT = 80
WINDOW = 10


def _own_tables(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose intermediate tables replace those of the stage before."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch.scope("pipeline stage"):
            return stage(spark, docs, sf_dir)

    return run_stage


@_own_tables
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC_AT, by a lexicon learned from the training fold's labels."""
    lexicon = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic", fold("doc_id", 3) != 1)
    return toxicity.drop_toxic(docs, lexicon, TOXIC_AT)


@_own_tables
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines like an earlier line; n_chars counts what is left. Documents
    of which nothing is left go."""
    kept = line_dedup.dedup_lines(docs, SIMILAR_PERCENT)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_own_tables
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.keep_one(docs, SIMILAR_PERCENT)


@_own_tables
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), WINDOW)


@_own_tables
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target rate, globally shuffled; columns rate and replica added."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: SQL can't express the learned toxicity stage; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to the table documents."""
    docs = before = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            scratch.drop(before)
        before = docs
    return docs
