"""Known answers of scalar functions, pricing, scopes, lifecycle and streaming."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from talkatlas.functions import pricing as P
from talkatlas.functions import text as X
from talkatlas.operators import lifecycle as L
from talkatlas.operators import ranking as R
from talkatlas.operators import scope as S
from talkatlas.streaming import ingest as I


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (X.estimate_tokens, "x" * 43, 10),
        (X.title_from, "\n  ## - Hello there\nmore", "Hello there"),
        (X.title_from, "y" * 95, "y" * 90 + "..."),
        (X.slug, "  A b/C! ", "a-b-c"),
        (X.normalise_tag, "  Big   TAG ", "big tag"),
        (X.plain_text, "# T\n`code` [link](u) **b**", "T link b"),
        (X.strip_controls, "a\x00b\tc", "ab\tc"),
        (lambda c: X.clip_words(c, 10), "hello brave world", "hello"),
        (lambda c: X.truncate(c, 3), "abcdef", "abc …"),
        (lambda c: X.snippet(c, "brave"), "hello <b> brave world", "hello &lt;b&gt; <mark>brave</mark> world"),
        (lambda c: F.size(X.chunk_windows(c)), "z" * 3700, 3),
        (lambda c: F.size(X.chunk_windows(c)), "", 0),
        (X.urls, "see https://a.b/c). and https://a.b/c, https://d.e", ["https://a.b/c", "https://d.e"]),
        (X.sentences, "Short. This sentence is long enough to stay. Ok?", ["This sentence is long enough to stay."]),
    ],
)
def test_text(spark, fn, value, want):
    assert one(spark, value, fn) == want


def test_chunk_lengths(spark):
    got = one(spark, "z" * 3700, lambda c: F.transform(X.chunk_windows(c), lambda x: F.length(x)))
    assert got == [2000, 1900, 100]


def test_durations_and_times(spark):
    assert one(spark, 3723.4, X.duration_label, "double") == "1h 2m 3s"
    assert one(spark, 0.0, X.duration_label, "double") == "0s"
    assert one(spark, "2025-01-01T02:00:00+02:00", lambda c: F.unix_seconds(X.instant(c))) == 1735689600
    assert one(spark, "junk", X.instant) is None
    assert one(spark, 1.7e12, lambda c: F.unix_seconds(X.epoch_instant(c)), "double") == 1_700_000_000


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0])], "i int, v array<double>")
    assert [r.u for r in rows.select(X.unit(F.col("v")).alias("u")).limit(2).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r.i for r in rows.where(X.valid_vector(F.col("v"), 2)).collect()] == [1, 2]


def test_cost(spark):
    row = spark.createDataFrame([(1000, 500, 400, 0, 0)], "input long, output long, read long, write long, write_1h long")
    prices = row.withColumns({"p_in": F.lit(1.25), "p_out": F.lit(10.0), "p_cached": F.lit(0.125), "p_write": F.lit(1.5), "p_write_1h": F.lit(2.5)})
    assert prices.select(F.round(P.cost(), 4)).first()[0] == 0.0058


def test_registry(tmp_path):
    good = {"providers": {"p": {}}, "verified_at": "2025-01-01", "fail_after_days": 30, "models": {"a": {"provider": "p", "pricing": {"input": 1, "output": 2, "cached_input": 0.1, "cache_write_5m": 1.25}, "aliases": ["a-one"]}}}
    path = tmp_path / "prices.json"
    path.write_text(json.dumps(good))
    assert P.load(str(path)) == {"a": (1.0, 2.0, 0.1, 1.25), "a-one": (1.0, 2.0, 0.1, 1.25)}
    assert P.validate(good, date(2025, 1, 10)) == []
    assert P.validate(good, date(2026, 1, 10)) == ["verified 374 days ago"]
    assert len(P.validate({"m_1": [1, 2], "m.1": [1, 2, -3], "m-1": [1, 2, float("nan")]})) == 5


def test_price_rules(spark):
    prices = P.price_frame(spark, {"base": (1.0, 2.0, 0.1), "base-pro": (5.0, 6.0, 0.5), "base-mini": (0.1, 0.2, 0.01), "_default": (9.0, 9.0, 9.0)})
    names = spark.createDataFrame([("Base.PRO-x",), ("base-x-mini",), ("base-mini-pro",), ("none",), (None,)], "m string")
    got = {r.m: r.p_in for r in P.priced(names, prices, "m").collect()}
    assert got == {"Base.PRO-x": 5.0, "base-x-mini": 0.1, "base-mini-pro": 0.1, "none": 3.0, None: 3.0}


@pytest.mark.parametrize(("count", "most", "rows"), [(24, 6, 6), (5, 6, 5), (9, 1, 1), (2, 2, 2), (100, 7, 7)])
def test_even_sampling(spark, count, most, rows):
    got = [r.i for r in R.evenly_sampled(spark.range(count).select(F.lit(1).alias("g"), F.col("id").alias("i")), "g", "i", most).orderBy("i").collect()]
    assert len(got) == rows and got[0] == 0 and (most == 1 or got[-1] == count - 1)


def test_fusion_starts_at_rank_zero(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id int, rank int")
    b = spark.createDataFrame([(2, 0)], "id int, rank int")
    assert {r.id: round(r.score, 10) for r in R.fuse([a, b], "id").collect()} == {1: round(1 / 60, 10), 2: round(1 / 61 + 1 / 60, 10)}


def test_bm25_statistics_are_global(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alphabet soup soup"), (3, "gamma"), (4, None), (5, "delta x"), (6, "eps")], "id int, text string")
    everything = {r.id: r.score for r in R.bm25(rows, "alpha", "id", ["text"]).collect()}
    some = {r.id: r.score for r in R.bm25(rows, "alpha", "id", ["text"], within=rows.where("id = 2")).collect()}
    assert set(everything) == {1, 2} and some == {2: everything[2]}
    assert R.bm25(rows, "?", "id", ["text"]).count() == 0


def test_visibility(spark):
    rows = spark.createDataFrame([(1, "a", "a", False), (2, "a", None, False), (3, "b", "b", False), (4, "b", None, True)], "id int, source string, source_adapter string, hidden boolean")
    assert [r.id for r in S.visible(rows, ["a"]).orderBy("id").collect()] == [3]
    assert [r.id for r in S.visible(rows, ["a"], only_hidden=True).collect()] == [4]


def test_sync(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, content_hash string")
    fresh = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")], "id string, content_hash string")
    table, counts = I.sync(fresh, stored, spark.createDataFrame([("d",)], "id string"))
    assert sorted(map(tuple, table.collect())) == [("a", "1"), ("b", "2"), ("c", "1")]
    assert {r.status: r.n for r in counts.collect()} == {"skipped": 1, "updated": 1, "added": 1}


def test_manifest(spark):
    m = I.Manifest()
    chunks = spark.range(3).withColumnRenamed("id", "chunk_id")
    assert m.prepare("f1")
    with pytest.raises(ValueError, match="1 chunks"):
        m.activate("f1", chunks, chunks.limit(2).withColumn("fingerprint", F.lit("f1")))
    assert m.activate("f1", chunks, chunks.withColumn("fingerprint", F.lit("f1"))) == 1
    assert not m.prepare("f1") and json.loads(m.to_json())["active"] == "f1"


def test_retry_delay():
    assert [I.retry_delay(n, jitter=lambda: 1.0) for n in (1, 2, 3, 20)] == [5.0, 10.0, 20.0, 300.0]


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "x", "content_hash": "1"}\n{"id": "y", "content_hash": "2"}\n')
    seen = []
    I.watch(spark, str(tmp_path / "in"), "id string, content_hash string", lambda df, n: seen.append((n, df.count())), str(tmp_path / "cp")).awaitTermination()
    I.watch(spark, str(tmp_path / "in"), "id string, content_hash string", lambda df, n: seen.append((n, df.count())), str(tmp_path / "cp")).awaitTermination()
    assert seen == [(0, 2)]


def test_streamed_turns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    talk = [("s", 0, "user", "a"), ("s", 1, "assistant", "b"), ("s", 2, "assistant", "c"), ("s", 3, "user", "d")]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("session", "pos", "role", "text"), r, strict=True))) for r in talk))
    stream = spark.readStream.schema("session string, pos int, role string, text string").json(str(tmp_path / "in"))
    q = I.turn_builder(stream).writeStream.format("memory").queryName("turns_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("turns_out").collect()] == [("s", 0, "a", "b\n\nc")]


def test_members(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    states = spark.createDataFrame([(3, "include"), (2, "exclude"), (9, "include")], "id int, state string")
    assert sorted(r.id for r in L.members(ids(1, 2), states, ids(1, 2, 3, 4), "id").collect()) == [1, 3]
