import random

import numpy as np
import pytest

from terranet.llm import near as N
from tests.llm.fixtures import documents, jaccard, prose, rows, shingles, thue_morse


def expected(found, threshold=0.8):
    texts = {}
    for r in found:
        texts.setdefault(r[1] or "", []).append(r[0])
    keys = list(texts)
    sets = [shingles(t) for t in keys]
    linked = {i: [j for j in range(len(keys)) if j != i and sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= threshold] for i in range(len(keys))}
    out = {}
    for i, key in enumerate(keys):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [d for j in seen for d in texts[keys[j]] if d is not None]
        own = [d for d in texts[key] if d is not None]
        out[key] = (min(ids, default=None), min(own, default=None), len(texts[key]), len(linked[i]))
    return out


@pytest.mark.parametrize("blocks", [(1024, 256), (4, 3)])
def test_against_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(N, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(N, "CLUSTER_BLOCK", blocks[1])
    want = expected(rows())
    by_id = {r[0]: want[r[1] or ""] for r in rows()}
    got = N.near_links(documents(spark)).collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r["class_id"], r["copy_of"], r["copies"], r["n_links"]) == by_id[r["doc_id"]]


def test_one_of_each(spark):
    kept = N.one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns
    want = expected(rows())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(w[0]) for w in want.values()})
    assert N.one_of_each(documents(spark).limit(0)).count() == 0
    assert N.near_links(documents(spark).limit(0)).count() == 0


def test_pruning_bound_keeps_pairs_above_the_threshold():
    rng = random.Random(5)
    least = N.least_matches(0.8, 1e-6)
    assert least == sorted(least) and least[-1] < N.VALUES
    lost = 0
    for _ in range(300):
        size = rng.randrange(40, 400)
        a = np.unique(np.random.default_rng(rng.randrange(1 << 30)).integers(0, 1 << 63, size, dtype=np.uint64))
        b = a[: int(len(a) * 0.81) + 1]
        equal = (N.minhash(a) == N.minhash(b)).astype(int).cumsum()[N.STEP - 1::N.STEP]
        lost += any(e < m for e, m in zip(equal, least))
    assert lost == 0


def test_common_counts_of_many_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 80))).astype(np.uint64) for _ in range(30)]
    got = N.common_counts(sets)
    assert np.array_equal(got, [[len(np.intersect1d(a, b)) for b in sets] for a in sets])


def test_links_through_a_hot_passage(spark):
    rng = random.Random(2)
    passage = prose(rng, 30)
    found = [(i, passage + " " + prose(rng, 60, 9000)) for i in range(60)]
    frame = spark.createDataFrame(found, "doc_id long, text string")
    assert {r["n_links"] for r in N.near_links(frame).collect()} == {0}


def test_words_that_polynomials_confuse(spark):
    found = [(k, " ".join([*"abcdefgh", w, *"ijkl"])) for k, w in enumerate(w for n in (1024, 2048, 4096, 8192) for w in thue_morse(n))]
    got = N.near_links(spark.createDataFrame(found, "doc_id long, text string")).collect()
    assert all(r["n_links"] == 0 and r["class_id"] == r["doc_id"] for r in got)
