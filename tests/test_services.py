"""The index, session detail, saved collections, evidence and synchronising."""

import pytest
from pyspark.sql import functions as F

from talkatlas.functions import stemming
from talkatlas.functions import text as X
from talkatlas.operators import index as I
from talkatlas.operators import ranking as R
from talkatlas.plans import ask, rules, sessions
from talkatlas.plans.archive import Archive
from talkatlas.plans.collections import Collections
from talkatlas.sources.canonical import MESSAGE
from talkatlas.sources.canonical import sessions as canonical
from talkatlas.streaming import sync as Y


@pytest.fixture(scope="module")
def archive(spark):
    rows = []
    for i, (user, reply) in enumerate([("Rotating certificates", "Renew them."), ("Parse durations", "Here is a parser."), ("Certificate alerts", "Alert early.")]):
        for t in range(3):
            rows += [(f"s{i}", 2 * t, "user", f"{user} {t}", None, [], [], f"2025-0{i + 1}-01T0{t}:00:00Z"), (f"s{i}", 2 * t + 1, "reply", f"{reply}\n```{'Bash' if i else 'python'}\nrun {t}\n```", None, ["edit"], [], None)]
    head = spark.createDataFrame([("s0", "infra", "Certs"), ("s1", "tools", "Durations"), ("s2", "infra", None)], "session string, repository string, title string")
    return Archive.build(canonical(spark.createDataFrame(rows, MESSAGE), head, "test").cache(), dim=128)


def test_index_has_the_scores_of_a_full_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Rotate the cluster", "infra"), (2, "clusters rotated twice, cluster", None), (3, None, "tools"), (4, "", ""), (5, "bake bread", "cluster")], "id long, body string, place string")
    for analyzer, full in (("plain", R.bm25), ("stemmed", stemming.stemmed_bm25)):
        own = I.write(rows, "id", ["body", "place"], str(tmp_path / analyzer), analyzer)
        for q, match in (("cluster", None), ("cluster rotat", ["body"]), ("nosuch", None), ("", None)):
            want = {r.id: r.score for r in full(rows, q, "id", ["body", "place"], match=match).collect()}
            assert {r.id: r.score for r in own.bm25(q, match=match).collect()} == pytest.approx(want)
        assert own.rows == 5
        assert sorted(r.id for r in own.bm25("cluster", within=rows.where("id > 1")).collect()) == [2, 5]
    again = I.write(rows.limit(0), "id", ["body", "place"], str(tmp_path / "plain"))
    assert again.rows == 5  # a finished index is used as it is


def test_archive_search_is_stemmed_and_scoped(archive, tmp_path):
    for own in (archive, archive.indexed(str(tmp_path / "index"))):
        assert {r.id for r in own.search("rotates", mode="keyword").collect()} == {"s0"}
        assert {r.id for r in own.search("durations", mode="keyword", repo="infra").collect()} == set()
        assert {r.id for r in own.resolve(rules.parse({"q": "certificates", "mode": "keyword"}))[0].collect()} == {"s0", "s2"}
        tagged = own.tag("s1", "kitchen sink")
        assert {r.id for r in tagged.search("kitchen", mode="keyword").collect()} == {"s1"}
        assert not tagged.untag("s1", "Kitchen  Sink").search("kitchen", mode="keyword").collect()
        latest = own.passages("certificate", recency="latest", per_session=2, limit=3).collect()
        assert [r.session_id for r in latest][:2] == ["s2", "s2"] and max(r.score for r in latest) == 1.0


def test_session_detail(archive):
    page = sessions.turns(archive, "s1", 1, 1).collect()
    assert [(r.turn_index, r.total, r.has_more) for r in page] == [(1, 3, True)]
    (short,) = sessions.turns(archive, "s1", 2, 5, defer_above=3).collect()
    assert short.user_message is None and short.content_chars > 3 and not short.has_more
    assert sessions.turn(archive, "s1", 0).collect()[0].user_message == "Parse durations 0"
    record = sessions.detail(archive, "s1", turns_limit=2)
    assert record["turns_total"] == 3 and record["turns_has_more"] and len(record["turns"]) == 2 and record["title"] == "Durations"
    assert sessions.detail(archive, "none") is None
    assert [r.id for r in sessions.list_recent(archive, 2).collect()] == ["s2", "s1"]
    assert {r.language: r.n for r in sessions.snippet_languages(archive).collect()} == {"bash": 6, "*shell": 6, "python": 3}
    (one,) = sessions.stats(archive).collect()
    assert (one.sessions, one.turns, one.code_blocks, one.repositories, one.first_day, one.last_day) == (3, 9, 9, 2, "2025-01-01", "2025-03-01")


def test_collections(spark, archive):
    c, infra = Collections.empty(spark).create(" Infra ", {"repo": "infra"}, pinned=True)
    c, hand = c.create("", description="By hand")
    c = c.set_member(hand, "s1").set_member(infra, "s1")
    ids = lambda cid: sorted(r.id for r in c.members(archive, cid).collect())
    assert ids(infra) == ["s0", "s1", "s2"] and ids(hand) == ["s1"]
    c = c.remove_member(infra, "s0").remove_member(hand, "s1")
    assert ids(infra) == ["s1", "s2"] and ids(hand) == [] and c.overrides(hand).isEmpty()
    assert [r.name for r in c.listed().collect()] == ["Infra", "Untitled collection"]
    assert [r.id for r in c.listed("manual", "HAND").collect()] == [hand] and [r.id for r in c.listed("auto").collect()] == [infra]
    assert [r["member"] for r in c.containing(archive, "s2")] == [True, False]
    assert [r.id for r in c.cards(archive, infra, 1, 5, "turns").collect()] == ["s2"]
    c = c.update(hand, name="Kept", rule={"q": "parser", "mode": "keyword"})
    assert ids(hand) == ["s1"] and c.rule(hand).mode == "keyword"
    assert [r.id for r in c.delete(infra).listed().collect()] == [hand]
    with pytest.raises(rules.RuleError):
        c.update(hand, rule={"mode": "fuzzy"})
    with pytest.raises(ValueError):
        c.update(hand, size=3)


def test_evidence(archive):
    long = {"t": "x" * 400}
    assert ask.shortened(long, "t", 100)["t"].endswith(" …") and ask.encoded_size(ask.shortened(long, "t", 100)) <= 100
    assert ask.shortened(long, "t", 5) is None and ask.shortened({"t": "a"}, "t", 50) == {"t": "a"}
    kept = ask.pack([{"t": "a" * 20}, long, {"t": "b"}], 100, shorten="t")
    assert [len(r["t"]) > 1 for r in kept][:2] == [True, True] and sum(ask.encoded_size({"t": r["t"]}) for r in kept) <= 100
    assert ask.context_budget(100, 200) == 0 and ask.context_budget() > 10_000
    context = ask.session_context(archive.sessions, archive.chunks.where("session_id = 's1'"), turns=2, cap=10).collect()
    assert [t.turn for t in context[0].turns] == [0, 2] and context[0].turns_total == 3


def test_sentences_need_a_beginning(spark):
    text = "This takes e.g. the first of the two ways. Then it goes on for a while! 3 of them are left over here."
    (r,) = spark.createDataFrame([(text,)], "t string").select(X.sentences(F.col("t")).alias("s")).collect()
    assert r.s == ["This takes e.g. the first of the two ways.", "Then it goes on for a while!", "3 of them are left over here."]


def test_sync(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "one.txt").write_text(n)
    written, reads = {}, []

    def source(key, broken=False):
        def read(files):
            reads.append((key, files.count()))
            if broken:
                raise ValueError("no such store")
            return files.select(F.concat(F.lit(key), F.regexp_extract("path", "[a-z]+[.]txt$", 0)).alias("id"), F.col("size").cast("string").alias("content_hash"))

        return Y.Source(key, lambda: Y.files(spark, str(tmp_path / key)), read)

    stored = spark.createDataFrame([("bone.txt", "9")], "id string, content_hash string")
    buried = spark.createDataFrame([("atwo.txt",)], "id string")
    state, keep = Y.State(), lambda key, rows: written.__setitem__(key, sorted(r.id for r in rows.collect()))
    out = Y.sync([source("a"), source("b"), source("b", True)], stored, buried, state, keep)
    assert out["a"] == {"status": "ok", "added": 1, "updated": 0, "skipped": 0} and written == {"a": ["aone.txt"], "b": ["bone.txt"]}
    assert out["b"]["status"] == "unchanged" and Y.sync([source("a")], stored, buried, state, keep)["a"] == {"status": "unchanged"}
    (tmp_path / "a" / "two.txt").write_text("buried")
    (tmp_path / "a" / "three.txt").write_text("new")
    assert Y.sync([source("a")], stored, buried, state, keep)["a"]["added"] == 1 and written["a"] == ["athree.txt"] and reads[-1] == ("a", 2)
    bad = Y.sync([source("b", True), source("a")], stored, buried, Y.State(), keep, rebuild=True)
    assert bad["b"] == {"status": "error", "error": "no such store"} and bad["a"]["status"] == "ok"


def test_debounce_and_requests():
    now = [0.0]
    d = Y.Debounce(quiet=2, most=5, base_delay=10, clock=lambda: now[0])
    due = []
    for at, value in [(0, "x"), (1, "y"), (2.5, "y"), (3, "y")]:
        now[0] = at
        due.append(d.observe(value))
    assert due == [False, False, False, True]
    d.succeeded("y")
    assert not d.observe("y")
    now[0] = 10
    d.observe("z")
    d.failed()
    now[0] = 15
    assert not d.observe("z")
    now[0] = 20
    assert d.observe("z")
    r = Y.Requests()
    assert r.ask() and not r.ask() and not r.ask(rebuild=True)
    assert r.done() == (True, True) and r.done() == (False, False)
