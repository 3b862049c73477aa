"""Learned operators by held-out accuracy, scores and mixing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkatlas.llm import kernels, lm_score, mixing, pii, quality, toxicity
from talkatlas.llm.lattice import Lattice, existing_vocabulary
from talkatlas.llm.tables import fold, held_out


@pytest.fixture(scope="module")
def labelled(spark, documents):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    rows, marks = [], []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        bad, toxic = i % 6 == 0, i % 5 == 0
        if bad:
            w = [f"{x}!!" for x in w]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgling", "ZORGLED", "zоrg1ess", "kwexify"]))  # one with a Cyrillic o and a digit
        rows.append((i, " ".join(w)))
        marks.append((i, 0 if bad else 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "no id")]
    marks += [(1001, None, None), (4000, 1, 1)]
    return documents(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column, parts, remainder):
    rows = scored.join(labels, "doc_id").where(held_out("doc_id", parts, remainder) & F.col(column).isNotNull()).collect()
    return sum((r.score >= 0.7) == (r[column] == 1) for r in rows) / len(rows)


def test_quality(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels, "quality", fold("doc_id", 4) != 2)
    scored = quality.score(docs, model)
    assert accuracy(scored, labels, "quality", 4, 2) > 0.95
    by = {r.doc_id: r.score for r in scored.collect()}
    assert len(by) == 603 and by[1000] == by[1001] and all(0 <= s <= 1 for s in by.values())
    again = quality.fit(docs.repartition(7), labels, "quality", fold("doc_id", 4) != 2)
    assert np.array_equal(model[0], again[0])
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0), "quality", F.lit(True))).collect()} == {0.5}


def test_toxicity(labelled):
    docs, labels = labelled
    lex = toxicity.fit(docs, labels, "toxic", fold("doc_id", 3) != 1)
    assert "zorg" in {e[:4] for e in lex.entries}
    scored = toxicity.score(docs, lex)
    assert accuracy(scored, labels, "toxic", 3, 1) > 0.95
    assert toxicity.drop_toxic(docs.withColumnRenamed("source", "my lang"), lex).columns[3] == "my lang"
    kept = toxicity.drop_toxic(docs.withColumnRenamed("lang", "score"), lex)
    assert kept.columns[2] == "score" and kept.where("doc_id is null").count() == 1
    empty = toxicity.fit(docs, labels.limit(0), "toxic", F.lit(True))
    assert toxicity.drop_toxic(docs, empty).count() == docs.count()


def test_folding_and_exceptions():
    assert toxicity.fold_text("ІDI0Т") == "idiot"
    assert toxicity.fold_text("ｉｄ​ｉｏｔ") == "idiot"
    lex = toxicity.Lexicon({"scum": 2.0}, frozenset({"scumble", "pond scum"}), (0.0, 1.0, 1.0))
    auto = lex.automaton()
    found = [w for w in ("scum here", "scumbag", "scumble on", "pond scum", "obscum") if toxicity.hits(auto, w)]
    assert found == ["scum here", "scumbag"]


def brute_lattice(lattice, word):
    log = dict(zip(lattice.pieces, lattice.logp, strict=False))
    alpha = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - lattice.longest), j):
            if word[i:j] in log:
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + log[word[i:j]])
    return alpha[-1] + lattice.end


def test_lattice():
    pieces = sorted({bytes([c]) for c in range(256)} | {b"ab", b"abc", b"ca", "é".encode()})
    lattice = Lattice(pieces, np.log(np.full(len(pieces), 0.9 / len(pieces))), math.log(0.1))
    words = [b"", b"a", b"abcab", b"cabcabca" * 40, "éé".encode(), b"zz"]
    assert lattice.score(words) == pytest.approx([brute_lattice(lattice, w) for w in words])
    counts = np.zeros(len(pieces) + 1)
    from talkatlas.llm.lattice import by_length

    for _, block in by_length(words[1:]):
        lattice.expected(block, counts)
    spelled = sum(len(p) * c for p, c in zip(pieces, counts, strict=False))
    assert spelled == pytest.approx(sum(map(len, words)))  # every segmentation spells its word


def test_lm_score(documents, corpus):
    got = {r.doc_id: r for r in lm_score.score_documents(documents(corpus)).collect()}
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for i, t in corpus}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    count: dict = {}
    for i in train:
        for w in tokens[i]:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score < 0
    assert lm_score.score_documents(documents([])).count() == 0
    assert [r.score for r in lm_score.score(documents([(1, "a")]).withColumn("held_out", F.lit(True))).collect()] == [None]


def naive_lm(spark, docs, rows, held):
    """Scores by plain dictionaries; the learned tables (components, pieces) are the operator's."""
    marked = docs.withColumn("held_out", F.col("doc_id").isin(sorted(held)))
    log_theta, log_pi = lm_score.fit_components(lm_score.profiles(marked))
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""] for i, t in rows}
    bucket = lambda w: int(lm_score._bucket(kernels.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]), kernels.FOLDED))[0])
    each = [Counter() for _ in log_pi]
    for i, own in tokens.items():
        if i not in held:
            like = [log_pi[k] + sum(log_theta[bucket(w), k] for w in own[:-1]) for k in range(len(log_pi))]
            each[int(np.argmax(like))].update(own)
    count = sum(each, Counter())
    kinds = spark.createDataFrame([(w,) for w in count], "word string")
    lattice = lm_score.fit_pieces(kinds, *existing_vocabulary(lm_score.VOCABULARY))
    n, d = sum(count.values()), lm_score.DISCOUNT
    sub, out = {}, {}
    for i, own in tokens.items():
        total = []
        for k, c in enumerate(each):
            nk, log, seen = sum(c.values()), float(log_pi[k]), Counter()
            for j, w in enumerate(own):
                if w not in sub:
                    sub[w] = math.exp(brute_lattice(lattice, w.encode()))
                p = max(count[w] - d, 0) / n + d * len(count) / n * sub[w]
                if nk:
                    p = max(c[w] - d, 0) / nk + d * len(c) / nk * p
                log += math.log((lm_score.STRENGTH * p + seen[w]) / (lm_score.STRENGTH + j))
                seen[w] += 1
            total.append(log)
        out[i] = float(np.logaddexp.reduce(total)) / math.log(10)
    return out


def test_lm_score_is_the_naive_probability(spark, documents, corpus):
    rows = [(i, t) for i, t in corpus if t is None or len(t) < 700] + [(900, "x y " * 40), (901, "Z")]
    docs, held = documents(rows), {i for i, _ in rows if i % 5 == 1}
    got = {r.doc_id: r.score for r in lm_score.score(docs.withColumn("held_out", F.col("doc_id").isin(sorted(held)))).collect()}
    want = naive_lm(spark, docs, rows, held)
    assert got == {i: pytest.approx(s, rel=1e-5, abs=1e-5) for i, s in want.items()}


def test_lm_score_odd_rows(documents):
    word = "ab" * 40_000
    rows = [(1, "a b " * 30_000), (1, "a b " * 30_000), (2, word), (None, "a c"), (None, "a c"), (3, ""), (6, word)]
    docs = documents(rows).withColumnsRenamed({"lang": "score", "source": "word"})
    got = lm_score.score(docs.withColumn("held_out", F.col("doc_id").eqNullSafe(F.lit(6)))).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_tokens, r.score))
    assert all(len(x) == 1 for x in by.values()) and {n for n, _ in by[1]} == {60_001}


def test_long_words_have_the_same_probability():
    lattice = Lattice(*existing_vocabulary(lm_score.VOCABULARY), math.log(0.2))
    for word in (b"x", b"the", "naïveté".encode() * 30, b"abcde" * 20):
        assert lattice.forward_long(word) == pytest.approx(brute_lattice(lattice, word))
    assert lattice.score([b"ab" * 70_000, b"ab"])[0] == pytest.approx(70_000 * lattice.forward_long(b"ab" * 4000) / 4000, rel=1e-2)


def test_mixing(documents):
    rows = [(i, f"t{i}", "big" if i % 3 else ("small" if i % 2 else None)) for i in range(300)] + [(7, "again", "big"), (None, None, "big")]
    docs = documents(rows).withColumnsRenamed({"lang": "rate", "n_chars": "replica"})
    weights = {"big": 1.0, "small": 40.0, None: 2.0, "absent": 5.0}
    out = mixing.mix(docs, weights, total=3000)
    counts = {r.source: r.n_docs for r in mixing.rates(docs, weights, total=3000).collect()}
    rate = {s: weights[s] / sum(weights[k] for k in counts) * 3000 / c for s, c in counts.items()}

    def copies(i, s):
        pieces = max(1, math.ceil(rate[s] / mixing.PIECE))
        mean, total = rate[s] / pieces, 0
        for p in range(pieces):
            u = int(hashlib.md5(f"mix|{'' if i is None else i}|{p}".encode()).hexdigest()[:13], 16) / 2**52
            c, term, k = math.exp(-mean), math.exp(-mean), 0
            while c <= u and k < mixing.TERMS + 1:
                k += 1
                term *= mean / k
                c += term
            total += k
        return total

    want = sorted((str(i), t or "", str(s), r) for i, t, s in rows for r in range(copies(i, s)))
    assert sorted((str(r.doc_id), r.text or "", str(r.source), r.replica) for r in out.collect()) == want
    assert out.where("source = 'small'").count() > 1500
    assert mixing.mix(documents([])).count() == 0


def test_mixing_rates_hold(spark, documents):
    docs = documents([(i, "x", "a" if i % 4 else "b") for i in range(4000)])
    by = {r.source: r.c for r in mixing.mix(docs, {"a": 1.0, "b": 1.0}).groupBy("source").agg(F.count("*").alias("c")).collect()}
    assert by["a"] == pytest.approx(2000, abs=200) and by["b"] == pytest.approx(2000, abs=200)


_PII = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")), ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))]


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        t += d - 9 if d > 9 else d
    return t % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(d) <= 15


def spans(text):
    return sorted((m.start(), n, k, m.end()) for n, (k, r) in enumerate(_PII) for m in r.finditer(text or "") if valid(k, m[0]))


def test_pii_base(documents):
    rng = random.Random(2)
    texts = ["a@b.co a@b.c@d.e x_y@z-1.w.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 40000000000000000002", "+1 (415) 555-0100 +12 +1-2-3-4-5-6-7-8-9-0-1 + 44", "é@b.co ü 10.0.0.1", None, "", "@.@", "9" * 30_000, "a" * 30_000 + "@", "1 " * 9_000, "a@b.co " * 300]
    texts += ["".join(rng.choice("a1.@+- (9\n") for _ in range(400)) for _ in range(80)]
    rows = list(enumerate(texts)) + [(None, "n@m.org"), (3, texts[3])]
    got = pii.find(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else "n@m.org"
        want = spans(text)
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in want) for k, _ in _PII)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r.spans.split(",")) or not listed
    assert pii.find(documents([])).count() == 0


def test_pii_bootstrap(documents):
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(rng.randint(3, 9)))
    rows = [(i, f"{filler()} reach me under user{i}@mail.example.org any time {filler()}") for i in range(40)]
    rows += [(100, f"{filler()} reach me under user77#example any time {filler()}"), (101, f"{filler()} in 2024abc of {filler()}"), (102, "order 12345-678 shipped")]
    got = {r.doc_id: r for r in pii.find(documents(rows)).collect()}
    text = dict(rows)[100]
    at = text.index("user77")
    assert got[100].spans == f"email:{at}:{at + len('user77#example')}" and got[100].n_added == 1
    assert got[101].spans == "" and got[102].spans == "" and all(got[i].n_email == 1 for i in range(40))
    docs = documents(rows)
    clean = {r.doc_id: r.text for r in pii.redact(docs, pii.find(docs)).collect()}
    assert "user77" not in clean[100] and "[private]" in clean[0] and clean[102] == "order 12345-678 shipped"
    odd = docs.withColumnsRenamed({"lang": "spans", "source": "my source"})
    assert pii.redact(odd, pii.find(docs)).columns == odd.columns


def test_pii_hidden_seeds_come_back(documents):
    """Half of the seeds are disguised so that the base misses them; their context brings them back, and nothing else."""
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta 7 x9".split()) for _ in range(rng.randint(3, 9)))
    rows = [(i, f"{filler()} write to box{i}{'@' if i % 2 else '(at)'}mail.example.org , {filler()}") for i in range(80)]
    found = {r.doc_id: r for r in pii.find(documents(rows)).collect()}
    back = sum(found[i].n_added for i in range(0, 80, 2))
    assert back == 40 and sum(r.n_added for r in found.values()) == back and all(found[i].n_email == 1 for i in range(1, 80, 2))


def test_pii_secrets_need_a_context(documents):
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, f'{word()} {word()} token = "{key()}" {word()}') for i in range(20)] + [(50, f'token = "ab1" {word()}'), (51, f"{word()} {word()} {key()} {word()}")]
    found = {r.doc_id: r for r in pii.find(documents(rows)).collect()}
    text = dict(rows)[3]
    at = text.index('"') + 1
    assert found[3].spans == f"secret:{at}:{at + 40}" and found[3].n_private == 1
    assert found[50].spans == "" or found[50].spans.startswith("secret:9:")
    assert found[51].spans == ""
