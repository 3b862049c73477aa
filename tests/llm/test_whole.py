"""Operators do the whole of their method by default."""

from pyspark.sql import functions as F

from talkatlas.llm import lm_score


def test_pieces_are_fitted_in_three_rounds(documents, corpus):
    docs = documents(corpus)
    of = lambda frame: {r.doc_id: round(r.score, 9) for r in frame.collect()}
    held = docs.withColumn("held_out", F.col("doc_id") % 5 == 1)
    by = {k: of(lm_score.score(held, rounds=k)) for k in (2, 3)}
    assert by[2] != by[3] and of(lm_score.score(held)) == by[3]
