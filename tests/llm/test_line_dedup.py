"""Line dedup: lines that share passages, odd letters, and the form of its plans."""

import hashlib
import random
import re

from talkatlas.llm import line_dedup


def removed(rows, percent=80):
    """Brute force: {doc_id: (lines, removed, digest)}."""
    seen, want = [], {}
    for i, t in rows:
        kept, lines = [], t.split("\n")
        for line in lines:
            w = tuple(re.findall("[^\x20\t\r\f\x0b]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
            s = {w[j : j + 5] for j in range(len(w) - 4)} if len(w) >= 5 else {w}
            if not w or not any(w == v or 100 * len(s & u) >= percent * len(s | u) for v, u in seen):
                kept.append(line)
            if w:
                seen.append((w, s))
        want[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return want


def test_lines_around_common_passages(documents):
    rng = random.Random(3)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(200)) for _ in range(n)]
    passage, twice, rows = words(30), words(9), []
    for i in range(60):
        lines = [words(rng.randint(1, 40)) + passage[rng.randint(0, 6) :] + words(rng.randint(0, 12)), twice * rng.randint(2, 5) + words(rng.randint(0, 3)), [*passage, *words(rng.randint(0, 4))]]
        if i % 3:
            lines.append([*rng.choice(rows)[1].split("\n")[0].split(), *words(rng.randint(0, 3))])
        rows.append((i, "\n".join(map(" ".join, lines))))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.line_report(documents(rows)).collect()}
    assert got == removed(rows)


def test_only_a_to_z_are_folded(documents):
    texts = ["un É deux trois quatre", "un é deux trois quatre", "UN é DEUX trois quatre", "ÀÞ 日本 × x y z", "àþ 日本 × x y z", "ÀÞ 日本 × X Y Z", " un\té  deux trois\rquatre ", "İ i ǅ ß K", "i̇ i ǆ ß k", "é\n\n \n un é deux trois quatre", "é"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.line_report(documents(rows)).collect()}
    assert got == removed(rows)


def test_tokens_are_counted_before_their_rows_are_shuffled(documents, corpus):
    """Both shuffles at once were more disk than is allowed."""
    keyed = documents(corpus).selectExpr("text", "doc_id AS k", "xxhash64(text) AS th")
    shared = line_dedup._shared_tokens(line_dedup._line_table(keyed, 80))
    assert "min(c1" not in shared._jdf.queryExecution().executedPlan().toString()
    assert {r.c for r in shared.groupBy("item").agg({"c1": "count"}).toDF("item", "c").collect()} - {1}
