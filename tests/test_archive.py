"""The archive end to end: build, search, collections, exports, questions."""

from datetime import datetime, timezone

import numpy as np
import pytest

from talkatlas.functions import embed
from talkatlas.plans import ask, rules
from talkatlas.plans.archive import Archive
from talkatlas.sources import exports
from talkatlas.sources.canonical import MESSAGE, sessions


@pytest.fixture(scope="module")
def archive(spark):
    talk = [
        ("a", "How do we rotate the cluster certificate?", "Use the renewal job.\n```sh\nrotate --all\n```", "2025-01-05T10:00:00Z"),
        ("b", "Write a parser for durations", "Here is a duration parser.", "2025-01-06T10:00:00Z"),
        ("c", "Certificate expiry alerts", "Alert when a certificate expires soon.", "2025-02-01T10:00:00Z"),
        ("d", "Bake bread", "Flour and water.", None),
    ]
    rows = []
    for i, user, reply, ts in talk:
        rows += [(i, 0, "user", user, None, [], [], ts), (i, 1, "reply", reply, None, ["edit"], [], None)]
    head = spark.createDataFrame([("a", "infra", "Certs"), ("b", "tools", None), ("c", "infra", None), ("d", None, None)], "session string, repository string, title string")
    records = sessions(spark.createDataFrame(rows, MESSAGE), head, "test").cache()
    return Archive.build(records, dim=256)


def ids(df):
    return [r.id for r in df.collect()]


def test_search(archive):
    assert set(ids(archive.search("certificate", mode="keyword"))) == {"a", "c"}
    best = archive.search("duration parser").collect()[0]
    assert (best.id, best.score) == ("b", 1.0) and "<mark>" in best.snippet
    assert ids(archive.search("certificate", mode="keyword", repo="infra", date_from="2025-01-20", date_to="2025-02-01")) == ["c"]
    assert ids(archive.search("")) == ["c", "b", "a", "d"]
    assert ids(archive.search("certificate", mode="keyword", only_ids=["c", "d"])) == ["c"]


def test_browse_and_reports(archive):
    assert ids(archive.browse("oldest")) == ["a", "b", "c", "d"]
    assert {r.repository: r.n for r in archive.facets()["repositories"].collect()} == {"infra": 2, "tools": 1}
    assert {r.repository: r.sessions for r in archive.usage("repository").collect()} == {"infra": 2, "tools": 1, "(unknown)": 1}
    (code,) = archive.snippets("SH", "ROTATE").collect()
    assert (code.id, code.language, code.content) == ("a", "sh", "rotate --all")
    assert [r.session_id for r in archive.related("a", 1).collect()] == ["c"]
    assert archive.passages("certificate", recency="latest").collect()[0].session_id == "c"


def test_mutations(archive):
    assert "a" not in ids(archive.hide(["a"]).browse())
    less = archive.purge(["b"])
    assert set(ids(less.browse())) == {"a", "c", "d"} and ids(less.tombstones) == ["b"]
    assert ids(archive.tag("d", "  Home   Baking ").scoped(tags=("home baking",))) == ["d"]


def test_collections(spark, archive):
    none = spark.createDataFrame([], "id string, state string")
    states = spark.createDataFrame([("d", "include"), ("c", "exclude")], "id string, state string")
    rule = rules.parse({"repo": " infra ", "limit": 5})
    assert sorted(ids(archive.members(rule, none))) == ["a", "c"]
    assert sorted(ids(archive.members(rule, states))) == ["a", "d"]
    assert sorted(ids(archive.resolve(rules.parse({"q": "certificate", "mode": "keyword"}))[0])) == ["a", "c"]
    found, cut = archive.resolve(rules.parse({"q": "certificate"}))
    assert "a" in ids(found) and not cut
    assert ids(archive.members(rules.Rule(), states)) == ["d"]


@pytest.mark.parametrize("bad", [{"x": 1}, {"mode": "fuzzy"}, {"date_from": "2025-02-02", "date_to": "2025-01-01"}, {"tags": ["t" * 41]}, {"date_to": "soon"}, {"tags": [str(i) for i in range(21)]}])
def test_bad_rules(bad):
    with pytest.raises(rules.RuleError):
        rules.parse(bad)


def test_exports(archive):
    text = {r.id: r.markdown for r in exports.markdown(archive.sessions).collect()}["a"]
    assert text.startswith("# Certs\n\n- **Source:** test\n- **Repository:** infra\n") and "## Turn 1\n\n**You:**\n\nHow do we" in text and "_tools: edit_" in text
    said = exports.search_text(archive.search("certificate", mode="keyword"), "certificate")
    assert said.startswith("2 conversation(s)") and "- [a] Certs  · test · infra · 2025-01-05" in said
    assert exports.search_text(archive.search("nosuchword", mode="keyword"), "x") == "No conversations found for: 'x'"
    assert next(exports.event_stream(archive.browse().select("id"), [])).startswith('data: {"type": "sources"')


def test_embedding():
    v = embed.vector("Rotate the cluster", 64)
    assert v.shape == (64,) and abs(float(np.linalg.norm(v)) - 1) < 1e-6 and not embed.vector("", 64).any()
    assert float(v @ embed.vector("rotate clusters", 64)) > float(v @ embed.vector("bake bread", 64))


NOW = datetime(2025, 3, 10, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    ("question", "intent", "query", "recency"),
    [
        ("find chats about tokens", "find", "tokens", "none"),
        ("Could you please look up token refresh?", "find", "token refresh", "none"),
        ("search for and find sessions on tokens", "find", "tokens", "none"),
        ("show me conversations about US", "find", "us", "none"),
        ("find sessions about which sessions took the longest", "find", "longest", "none"),
        ("Which sessions took the longest?", "duration", "", "none"),
        ("find out which sessions took the longest", "duration", "", "none"),
        ("Summarize my recent refactoring sessions", "summary", "refactoring", "boost"),
        ("What did I work on this past week?", "summary", "", "none"),
        ("find out what I worked on last week", "summary", "", "none"),
        ("How did we rotate the cluster CA?", "lookup", "rotate cluster ca", "none"),
        ("What is the latest on parsing?", "lookup", "parsing", "latest"),
    ],
)
def test_plan(question, intent, query, recency):
    p = ask.plan(question, NOW)
    assert (p.intent, p.query, p.recency) == (intent, query, recency)


def test_plan_scopes():
    p = ask.plan("what failed in web-shop yesterday", NOW, ["shop", "web-shop"])
    assert (p.repository, p.date_from, p.date_to) == ("web-shop", "2025-03-09", "2025-03-09")
    assert ask.plan("errors in the last 3 days", NOW).date_from == "2025-03-08"
    assert ask.plan("errors since 2025-01-02", NOW).date_to == "2025-03-10"
    assert ask.plan("shop and tools", NOW, ["shop", "tools"]).repository is None


def test_packing(archive):
    kept = ask.pack([{"t": "a" * 50}, {"t": "b" * 500}, {"t": "c" * 20}], 200)
    assert [r["citation"] for r in kept] == [1, 2] and kept[1]["t"].startswith("c")
    near = ask.with_neighbours(archive.passages("bread", mode="keyword"), archive.sessions).collect()
    assert near[0].around[0].startswith("Bake bread")
    assert ask.longest(archive.sessions).count() == 0
