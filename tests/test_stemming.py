"""The stemmed profile against SQLite's full-text index."""

import random
import sqlite3

import pytest

from talkatlas.functions.stemming import stem, stemmed_bm25

WORDS = "run runs running runner ran relational rational conditional valency hesitancy digitizer conformably radically differently vilely analogously vietnamization predication operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility triplicate formative formalize electricity electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologous communism activate angularity effective bowdlerize probate rate cease controll roll agreed plastered motoring conflated troubled sized hopping falling hissing failing filing happy sky caresses ponies ties cats feed bled sing café naïve foo_bar".split()


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(content, title, tokenize='porter unicode61')")
        con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this SQLite")
    return con


def test_stems(fts):
    fts.execute("DELETE FROM t")
    for w in WORDS:
        fts.execute("INSERT INTO t VALUES(?, '')", (w,))
    terms = {r[0] for r in fts.execute("SELECT term FROM v")}
    from talkatlas.functions.stemming import index_words

    assert {stem(x) for w in WORDS for x in index_words(w)} == terms


def test_scores(spark, fts):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(3, 40))), " ".join(rng.choices(WORDS, k=3))) for i in range(60)]
    fts.execute("DELETE FROM t")
    for i, content, title in rows:
        fts.execute("INSERT INTO t(rowid, content, title) VALUES(?, ?, ?)", (i, content, title))
    frame = spark.createDataFrame(rows, "id long, content string, title string")
    for query, match in (("running", None), ("formal sensit", None), ("hope", ["content"])):
        text = " OR ".join(f'"{w}"*' for w in query.split())
        want = dict(fts.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", (f"content : ({text})" if match else text,)).fetchall())
        got = {r.id: r.score for r in stemmed_bm25(frame, query, "id", ["content", "title"], match=match).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
