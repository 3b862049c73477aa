"""Queries over small written tables of which no row may be left out."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq

from talkatlas.plans import catalog


def rows_of(spark, folder, query, **tables):
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return catalog.QUERIES[query](spark, str(folder)).collect()


def test_gap_filled_days_count_every_user(spark, tmp_path):
    at = [dt.datetime(2024, 2, 27, 9), dt.datetime(2024, 2, 27, 23, 59), dt.datetime(2024, 3, 1, 1), dt.datetime(2024, 3, 1, 2)]
    events = {"ts": pa.array(at, pa.timestamp("us")), "user_id": [3, 4, 5, 100], "value": [0.5, 1.25, 2.0, 4.0]}
    got = rows_of(spark, tmp_path, "usage_gapfill_day", events=events)
    assert sorted((r.day, r.n, r.cost) for r in got) == [("2024-02-27", 2, 1.75), ("2024-02-28", 0, 0.0), ("2024-02-29", 0, 0.0), ("2024-03-01", 2, 6.0)]


def test_every_event_has_its_cache_cost(spark, tmp_path):
    got = rows_of(spark, tmp_path, "cache_cost", events={"event_id": [0, 1, 13, 20, 27]})
    assert sorted(r.event_id for r in got) == [0, 1, 13, 20, 27]
    # beta: 270 in at 1.0, 27 out at 4.0, 81 read at 0.1, 27 written at 1.5, 5 for an hour at 2.5
    assert {r.event_id: r.cost for r in got}[27] == round((270 * 1.0 + 27 * 4.0 + 81 * 0.1 + 27 * 1.5 + 5 * 2.5) / 1000000, 9)


def test_oldest_orders_are_those_of_all_customers(spark, tmp_path):
    n = 130
    orders = {"o_orderkey": list(range(1, n + 1)), "o_custkey": list(range(n)), "o_orderdate": pa.array([dt.datetime(2024, 1, 1) + dt.timedelta(days=n - k) for k in range(n)], pa.timestamp("us"))}
    got = rows_of(spark, tmp_path, "browse_oldest_nulls_last", orders=orders)
    # every fifth date is made null and comes last, here beyond the page of 104 dated orders
    assert [r.o_orderkey for r in got] == [k for k in range(n, 0, -1) if k % 5][:100]


def test_neighbours_beyond_the_first_sixty_items(spark, tmp_path):
    ids = [0, 1, 58, 59, 60, 61, 500, 501, 700]
    got = rows_of(spark, tmp_path, "jaccard_pairs", benchmark={"item_id": ids, "text": ["a b" if i % 2 else "b c" for i in ids]})
    assert sorted((r.a, r.b, r.similarity) for r in got) == [(a, a + 1, round(1 / 3, 6)) for a in (0, 58, 59, 60, 500)]


def test_topics_have_all_words_and_bigrams(spark, tmp_path):
    words = [f"word{i}" for i in range(250)]
    documents = {"lang": ["en", "en", "de"], "text": [" ".join(words), " ".join(words), "selten"]}
    got = {(r.lang, r.word): r.n for r in rows_of(spark, tmp_path, "topic_words", documents=documents)}
    assert got == {("en", w): 2 for w in words} | {("de", "selten"): 1}
    pairs = {r.bigram: r.n for r in rows_of(spark, tmp_path, "topic_bigrams", documents=documents)}
    assert pairs == {f"{a} {b}": 2 for a, b in zip(words, words[1:])}
