"""The registered queries and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from talkatlas.llm import decontaminate, line_dedup, near_dup, queries, toxicity
from talkatlas.llm.tables import fold, read

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).fetchall()
    names = [c[0] for c in con.sql(queries.ORACLE_SQL[name]).description]
    got = queries.QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    """Each stage keeps what its operator keeps, judged on its own input; the last only repeats rows."""
    docs = read(spark, SF, "documents")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    lexicon = toxicity.fit(docs, read(spark, SF, "labels"), "toxic", fold("doc_id", 3) != 1)
    left = toxicity.drop_toxic(docs, lexicon, corpus_pipeline.TOXIC_AT)
    left = line_dedup.dedup_lines(left, corpus_pipeline.SIMILAR_PERCENT)
    left = near_dup.keep_one(left, corpus_pipeline.SIMILAR_PERCENT)
    left = decontaminate.drop_contaminated(left, read(spark, SF, "benchmark"))
    want = {r.doc_id: r.text for r in left.collect()}
    assert set(got) <= set(want) and all(want[i] == r.text and r.n_chars == len(r.text) for i, r in got.items())
    assert len(got) > 0.5 * len(want)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
