"""Operators on documents against brute force, with odd rows."""

import hashlib
import re

import pytest

from talkatlas.llm import decontaminate, line_dedup, near_dup, repeats, winnow

SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sets_of(rows, k=5):
    out = {}
    for i, t in rows:
        w = SPACE.findall(low(t))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("small", [16, 2])
def test_near_duplicates(documents, corpus, small, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", small)  # 2: nearly all buckets go the exact way
    got = {r.doc_id: r for r in near_dup.near_duplicates(documents(corpus), 85).collect()}
    sets = sets_of(corpus)
    want = components(sets, 85)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_near_duplicates_odd_rows(spark, documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "")]
    got = near_dup.near_duplicates(documents(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in got) == [(False, 1, True), (False, 1, True), (False, 2, True), (False, 3, True), (True, 0, True)]
    assert near_dup.keep_one(documents([])).count() == 0
    clash = documents([(5, "q w e r t y"), (6, "q w e r t y")]).withColumnsRenamed({"lang": "kept", "source": "rep"})
    assert [r.doc_id for r in near_dup.keep_one(clash).collect()] == [5]


def test_odd_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(3)
    for share in (0.7, 0.85, 0.95):
        shared, n = rng.integers(0, 2**63, 4000, dtype=np.uint64), 4000
        extra = int(n * (1 - share) / (1 + share))
        a = np.unique(np.concatenate([shared[extra:], rng.integers(0, 2**63, extra, dtype=np.uint64)]))
        flips = int(np.unpackbits((near_dup.odd_sketch(near_dup.minhash(np.unique(shared))) ^ near_dup.odd_sketch(near_dup.minhash(a))).view(np.uint8)).sum())
        assert abs(near_dup.estimate(flips) - len(np.intersect1d(a, shared)) / len(np.union1d(a, shared))) < 0.15
        if share >= 0.85:
            assert flips <= near_dup.most_flips(0.85)


def test_line_dedup(documents, corpus):
    rows = [*corpus, (500, "first\n\nfirst\n\n"), (501, "\n"), (502, "first")]
    got = {r.doc_id: r for r in line_dedup.line_report(documents(rows)).collect()}
    seen, want = [], {}
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = []
        for line in lines:
            w = tuple(re.findall("[^\x20\t\r\f\x0b]+", low(line)))
            s = {w[j : j + 5] for j in range(len(w) - 4)} if len(w) >= 5 else {w}
            if w and any(w == v or 100 * len(s & u) >= 80 * len(s | u) for v, u in seen):
                pass
            else:
                kept.append(line)
            if w:
                seen.append((w, s))
        want[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert {i: (r.n_lines, r.n_removed, r.kept_sha256) for i, r in got.items()} == want


def test_line_dedup_documents(documents):
    rows = [(1, "keep this line of five\nand another one"), (2, "keep this line of five"), (3, None), (4, ""), (None, "null ids come first"), (5, "null ids come first"), (6, "x"), (6, "x")]
    docs = documents(rows).withColumnsRenamed({"lang": "k", "source": "row"})
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect() if r.text) == [(0, "null ids come first"), (1, "keep this line of five\nand another one"), (6, "x"), (6, "x")]
    assert {r.doc_id for r in out.collect() if not r.text} == {3, 4}
    assert line_dedup.dedup_lines(documents([])).count() == 0


@pytest.mark.parametrize("most", [4000, 3])
def test_repeats(documents, corpus, most, monkeypatch):
    monkeypatch.setattr(repeats._locate, "__defaults__", (most,))  # 3: hot anchors are cut and salted
    got = {r.doc_id: r for r in repeats.find_repeats(documents(corpus)).collect()}
    seen, want = set(), {}
    for i, t in corpus:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for j in range(len(w) - 19):
            x = tuple(w[j : j + 20])
            if x in seen:
                gone[j : j + 20] = b"\1" * 20
            seen.add(x)
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in got.items()} == want


def test_repeats_odd_rows(documents):
    long = " ".join(f"w{i}" for i in range(25))
    rows = [(1, long), (1, long), (None, long), (2, None), (3, f"{long} tail"), (4, "short")]
    out = sorted((r.doc_id or 0, r.text) for r in repeats.remove_repeats(documents(rows).withColumnsRenamed({"lang": "kept"})).collect() if r.text is not None)
    assert out == [(0, long), (1, ""), (1, ""), (3, "tail"), (4, "short")]
    assert repeats.find_repeats(documents([])).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontaminate(spark, documents, corpus, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)  # 300: a block of the index holds a document or two
    items = [(i, " ".join((t or "").split()[5:25])) for i, t in corpus[:30:3]] + [(900, "one"), (901, None), (902, "..."), (903, "A B c"), (900, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_overlaps(documents(corpus), bench).collect()}
    windows = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(str(i))
    for i, t in corpus:
        w = ALNUM.findall(low(t))
        hit, own = set(), set()
        for win, names in windows.items():
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    own |= names
        r = got[i]
        near = set()
        for win, names in windows.items():
            reach = len(win) + decontaminate.SLOP
            if set(win) <= set(w) and any(set(win) <= set(w[j : j + reach]) for j in range(max(1, len(w) - reach + 1))):
                near |= names
        assert (r.n_words, r.n_hit, r.item_ids, r.near_item_ids) == (len(w), len(hit), sorted(own), sorted(near))
        assert sum(e - b for b, e in r.hits) == len(hit)


def test_proximity_and_drop(spark, documents):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = documents([(1, "blue x green y red"), (2, "red green blue"), (3, "red 1 2 3 4 5 6 7 8 9 green blue"), (4, None)]).withColumnsRenamed({"lang": "n_hit"})
    near = {r.doc_id: r.near_item_ids for r in decontaminate.find_overlaps(docs, bench, slop=4).collect()}
    assert near == {1: ["1"], 2: ["1"], 3: [], 4: []}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert decontaminate.drop_contaminated(documents([]), bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 4
    odd = docs.withColumnsRenamed({"source": "my source", "n_chars": "a__"})
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns


def test_decontaminate_odd_rows(spark, documents):
    bench = spark.createDataFrame([(None, "red green"), (2, "Blue"), (2, None)], "item_id long, text string")
    rows = [(1, "red GREEN " * 50_000), (1, "red GREEN " * 50_000), (None, "red, green"), (None, "blue"), (3, "")]
    got = decontaminate.find_overlaps(documents(rows), bench, slop=None).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.item_ids) for r in got) == [(0, 1, 1, ["2"]), (0, 2, 2, [""]), (1, 100_000, 100_000, [""]), (1, 100_000, 100_000, [""]), (3, 0, 0, [])]


def brute_winnow(text, k=winnow.GRAM, w=winnow.WINDOW):
    import numpy as np

    p = winnow.code_points(text)
    k = min(k, len(p))
    h = [int(winnow.chosen(p[i : i + k], k, 1)[0][0]) for i in range(len(p) - k + 1)] if len(p) else []
    picked = set()
    for a in range(max(1, len(h) - w + 1) if h else 0):
        part = h[a : a + w]
        low_ = min(part)
        picked.add(a + max(j for j, x in enumerate(part) if x == low_))
    return np.array([h[i] for i in sorted(picked)]), np.array(sorted(picked))


def test_winnowing(documents, corpus):
    rows = [(i * 3, t) for i, t in corpus]
    got = {r.doc_id: r for r in winnow.neighbours(documents(rows), rows_per_range=8).collect()}
    for n, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        edited = winnow.edited(t, nxt)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if n % 4 == 0:
            for text, f in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
                h, p = brute_winnow(text)
                hashes, places = winnow.unpack(f)
                assert places.tolist() == p.tolist() and hashes.tolist() == h.tolist()
            a, b = set(winnow.unpack(r.fingerprint)[0].tolist()), set(winnow.unpack(r.edited_fingerprint)[0].tolist())
            assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a and b else float(a == b))


def test_winnowing_guarantee():
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = word(winnow.GRAM + winnow.WINDOW - 1)
    a, b = word(300) + shared + word(200), word(150) + shared + word(400)
    pairs = winnow.common_passages(winnow.pack(*winnow.chosen(winnow.code_points(a))), winnow.pack(*winnow.chosen(winnow.code_points(b))))
    assert any(p - q == 150 for p, q in pairs)


def test_winnowing_odd_rows(documents):
    assert winnow.neighbours(documents([])).count() == 0
    (r,) = winnow.neighbours(documents([(1, "ab")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"aa").hexdigest() and r.near_next == 1.0
    rows = winnow.neighbours(documents([(2, "b"), (2, "a"), (None, "n"), (3, None)])).collect()
    assert len(rows) == 4
