import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from terranet.llm import labelled as L, line_crf as C, toxicity as X, words
from tests.llm.fixtures import documents, prose, rows


def brute_marginals(unary, links):
    n, total, good = len(unary), 0.0, np.zeros(len(unary))
    for code in range(2 ** n):
        y = [code >> i & 1 for i in range(n)]
        p = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(links[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    return good / total, np.log(total)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    links = rng.normal(size=(2, 2))
    sizes = [3, 0, 1, 7, 2]
    unary = rng.normal(size=(sum(sizes), 2))
    ends = np.append(0, np.cumsum(sizes))
    got, pairs, log_z = C.forward_backward(unary, links, ends)
    total = 0.0
    for a, b in zip(ends, ends[1:]):
        if b > a:
            want, z = brute_marginals(unary[a:b], links)
            assert np.allclose(got[a:b, 1], want)
            total += z
    assert np.isclose(log_z, total)
    assert np.isclose(pairs.sum(), sum(n - 1 for n in sizes if n))


def quality_rows(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = [prose(rng, rng.randrange(5, 20)).capitalize() + "." for _ in range(rng.randrange(1, 8))]
        bad = i % 4 == 0
        if bad:
            lines = [random.Random(i + k).choice([x.upper().replace(" ", "!! "), " | ".join(x.split()), (x.split()[0] + " ") * 20]) for k, x in enumerate(lines)]
        out.append((i, "\n".join(lines), 1 - bad))
    return out


def frames(spark, found):
    rest = rows()[0][2:]
    docs = spark.createDataFrame([(d, t, *rest) for d, t, _ in found], documents(spark).schema)
    return docs, spark.createDataFrame([(d, y, y) for d, _, y in found], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_documents(spark):
    found = quality_rows(400)
    docs, labels = frames(spark, found)
    sample = L.sample(docs, labels, "quality", 5, 0, 300)
    assert len(sample) <= 300 and all(zlib.crc32(str(d).encode()) % 5 for d in sample["doc_id"])
    model = C.train(sample)
    got = {r["doc_id"]: r["score"] for r in C.scored(docs.unionByName(documents(spark)), model).collect() if r["doc_id"] is not None}
    truth = {d: y for d, _, y in found if zlib.crc32(str(d).encode()) % 5 == 0 and d >= 200}
    assert np.mean([(got[d] >= C.CUT) == y for d, y in truth.items()]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    kept = C.good_documents(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _, _ in found if {r["doc_id"]: r["score"] for r in C.scored(docs, model).collect()}[d] >= C.CUT}


def test_quality_without_text_or_labels(spark):
    docs, labels = frames(spark, quality_rows(40))
    model = C.train(L.sample(docs, labels, "quality", 5, 0, 300))
    scores = model.scores(pa.array([None, "", "\n\n", "x"]))
    assert scores[0] == scores[1] == scores[2] == model.share
    assert C.train(L.sample(docs, labels.limit(0), "quality", 5, 0, 300)) == 0.5
    assert {r["score"] for r in C.scored(docs, 0.5).collect()} == {0.5}
    assert C.scored(docs.limit(0), model).count() == 0
    assert C.good_documents(docs.limit(0), model).count() == 0


def test_line_features_do_not_depend_on_the_batch():
    texts = [t for _, t, _ in quality_rows(30)] + ["", None, "one line", "é" * 5000 + "\n" + "ab " * 3000]
    whole, _, ends = C.line_features(*words.buffers(texts))
    for k, t in enumerate(texts):
        own, _, _ = C.line_features(*words.buffers([t]))
        assert np.allclose(own, whole[ends[k]:ends[k + 1]])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distances():
    rng = random.Random(6)
    letters = "abc"
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(2, 12))).encode() for _ in range(25)})
    lexicon = X.Lexicon(terms, np.arange(1.0, len(terms) + 1), [], np.zeros(0), [X.allowed_edits(t) for t in terms])
    tried = [w for w in ("".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(1500))]
    data, offsets = words.buffers(pa.array(tried, pa.large_string()))
    weight, term, edits = lexicon.match(data, offsets[:-1], offsets[1:])
    for w, x, k, e in zip(tried, weight, term, edits):
        near = [(distance(w.encode(), t), i) for i, t in enumerate(terms) if distance(w.encode(), t) <= X.allowed_edits(t)]
        assert (k >= 0) == bool(near) and (x > 0) == bool(near)
        if near:
            assert e == min(near)[0] == distance(w.encode(), terms[k])


def toxic_rows(n):
    rng = random.Random(3)
    bad = ["scumbag", "nitwitted", "loathsome", "grubhead"]
    out = []
    for i in range(n):
        text = prose(rng, 40).split()
        if i % 5 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        out.append((i, " ".join(text), int(i % 5 == 0)))
    return out


def test_toxic_documents(spark):
    docs, labels = frames(spark, toxic_rows(500))
    model = X.train(L.sample(docs, labels, "toxic", 3, 1, 1000))
    got = {r["doc_id"]: r["score"] for r in X.scored(docs, model).collect()}
    assert all((got[d] >= X.CUT) == y for d, _, y in toxic_rows(500))
    tests = ["you are a scumbag and a grubhead, scumbag", "you are a scumbbag and a grabhead, scunbag", "you SC*MBAG, gr@bhead! Loathsome",
             "He wrote “you scumbag and grubhead, scumbag” to them", "plain words of nothing", "", None]
    scores = model.scores(pa.array(tests))
    assert (scores[:3] >= X.CUT).all() and (scores[3:] < X.CUT).all() and scores[5] == scores[6]
    assert X.scored(docs.limit(0), model).count() == 0
    assert X.scored(documents(spark), model).count() == len(rows())


def test_toxic_without_labels(spark):
    docs, labels = frames(spark, toxic_rows(30))
    assert X.train(L.sample(docs, labels.limit(0), "toxic", 3, 1, 1000)) == 0.0
    assert {r["score"] for r in X.scored(docs, 0.0).collect()} == {0.0}
    assert isinstance(X.train(pd.DataFrame({"doc_id": [1, 2], "text": ["a", "b"], "label": [1, 1]})), float)


def test_context():
    text = 'they "said scum loudly" to you'
    at = text.index("scum")
    assert X.context(text, at, at + 4) == (True, True)
    assert X.context("scum of the earth", 0, 4) == (False, False)


def test_context_of_whole_lines():
    rng = random.Random(4)
    long = prose(rng, 200)
    cases = [(f'„{long}“ and then scum “is” here', False), (f'he “{long} scum {long}” to them', True), (f'“{long} scum {long}', False),
             (f'“{long}\nscum” {long}', False), ("é" * 900 + '" scum ' + "é" * 900 + '"', True), ("scum", False)]
    cases += [(f"{prose(rng, rng.randrange(9))} {rng.choice(X._QUOTES)} {prose(rng, 150)} you said scum {prose(rng, 99)} {rng.choice(X._QUOTES + chr(10))} x »", None) for _ in range(40)]
    data, offsets = words.buffers([t for t, _ in cases])
    start = np.array([int(o) + len(t[:t.index("scum")].encode()) for o, (t, _) in zip(offsets, cases)])
    got = X.contexts(data, offsets, start, start + 4)
    assert got == [X.context(t, t.index("scum"), t.index("scum") + 4) for t, _ in cases]
    assert [q for q, _ in got[:6]] == [want for _, want in cases[:6]]
    lexicon = X.Lexicon([b"scum"], np.ones(1), [], np.zeros(0), [0])
    sums = X.text_features(lexicon, pa.array([t for t, _ in cases[:6]], pa.large_string()))
    assert [s[1] > 0 for s in sums] == [want for _, want in cases[:6]]


def swapped_distance(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            n = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                n = min(n, rows[i - 2][j - 2] + 1)
            rows[i].append(n)
    return rows[-1][-1]


def test_automaton_over_letters_with_swaps():
    rng = random.Random(7)
    terms = sorted({"".join(rng.choice("aéж") for _ in range(rng.randrange(2, 12))) for _ in range(25)})
    most = [X.allowed_edits(t.encode()) for t in terms]
    assert all(m == (0 if len(t) < 4 else 1 if len(t) < 10 else 2) for t, m in zip(terms, most))
    lexicon = X.Lexicon([t.encode() for t in terms], np.arange(1.0, len(terms) + 1), [], np.zeros(0), most, swaps=True)
    tried = ["".join(rng.choice("aéж𝔞" if k % 9 else "b") for _ in range(rng.randrange(1, 14))) for k in range(1500)]
    for t in terms:
        k = rng.randrange(len(t) - 1)
        tried.append(t[:k] + t[k + 1] + t[k] + t[k + 2:])
    data, offsets = words.buffers(pa.array(tried, pa.large_string()))
    _, term, edits = lexicon.match(data, offsets[:-1], offsets[1:])
    for w, k, e in zip(tried, term, edits):
        near = min((d, i) for i, t in enumerate(terms) for d in [swapped_distance(w, t)] if d <= most[i]) if any(
            swapped_distance(w, t) <= m for t, m in zip(terms, most)) else None
        assert (k >= 0) == (near is not None) and (near is None or e == near[0] == swapped_distance(w, terms[k]))


def test_misspelt_short_and_accented_terms():
    rng = random.Random(5)
    found = [(prose(rng, 40) + (f" {rng.choice(['scum', 'idiot'])} {prose(rng, 5)}" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(600)]
    lexicon = X.learn_lexicon([t for t, _ in found], np.array([y for _, y in found]))
    assert {b"scum", b"idiot"} <= {*lexicon.terms}
    tried = ["scvm", "sc*m", "sucm", "scüm", "idiöt", "idоit", "idoit", "scum", "idiot", "scv", "idöït", "the"]
    data, offsets = words.buffers(pa.array(tried, pa.large_string()))
    assert (lexicon.match(data, offsets[:-1], offsets[1:])[0] > 0).tolist() == [True] * 5 + [False] + [True] * 3 + [False] * 3
