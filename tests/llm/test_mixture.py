import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terranet.llm import mixture as M
from tests.llm.fixtures import documents, rows


def fair(sizes):
    """Targets by dealing again and again what is above the cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return {s: share.get(s, 2.0 * sizes[s]) for s in order}
        capped |= over


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_taken(spark):
    got = M.mixed_documents(documents(spark, n=80), shards=5, block_words=500).collect()
    assert len(got) == len(rows(n=80))
    sizes = defaultdict(int)
    for r in rows(n=80):
        sizes[r[3]] += size_of(r[1])
    want = fair(sizes)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert (r["first_shard"] is not None) >= (r["first_part"] > 0) and (r["second_shard"] is not None) >= (r["second_part"] > 0)
        taken[r["source"]] += r["taken"]
    assert taken == {s: math.floor(t) for s, t in want.items()}
    again = M.mixed_documents(documents(spark, n=80).repartition(7), shards=5, block_words=500).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # brute force of what is taken: the first words in hash order, then from the start again
    for source in sizes:
        own = sorted((hashlib.md5(((r[1] or "") if r[0] is None else str(r[0])).encode()).hexdigest(), -1 if r[0] is None else r[0], size_of(r[1]))
                     for r in rows(n=80) if r[3] == source)
        begin, expected = 0, []
        for _, doc, size in own:
            n = sum(max(0, min(size, math.floor(want[source]) - p * sizes[source] - begin)) for p in (0, 1))
            expected.append((doc, n))
            begin += size
        assert sorted(expected) == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["taken"]) for r in got if r["source"] == source)


@pytest.mark.parametrize("case", [(10, 30, 12), (1, 5, 5), (0, 9, 4), (7, 7, 3), (400, 1000, 500)])
def test_hypergeometric_quantiles(spark, case):
    k, total, drawn = case
    steps = 400
    got = spark.range(steps).select(M.hypergeometric(F.lit(k), F.lit(total), F.lit(drawn), (F.col("id") + 0.5) / steps).alias("x")).collect()
    low, high = max(0, drawn + k - total), min(k, drawn)
    mass = [math.comb(k, x) * math.comb(total - k, drawn - x) / math.comb(total, drawn) for x in range(low, high + 1)]
    for i, r in enumerate(got):
        u, x, below = (i + 0.5) / steps, low, 0.0
        while x < high and below + mass[x - low] < u - 1e-9:
            below += mass[x - low]
            x += 1
        assert r["x"] == x


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("a", 100), ("b", 7), (None, 41), ("", 1)], "source string, blocks long")
    shares = M.split_quotas(quotas, 6).collect()
    total, by_shard = defaultdict(int), defaultdict(int)
    for r in shares:
        assert r["blocks"] >= 0
        total[r["source"]] += r["blocks"]
        by_shard[r["shard"]] += r["blocks"]
    assert total == {"a": 100, "b": 7, None: 41, "": 1}
    assert len(by_shard) == 6 and max(by_shard.values()) - min(by_shard.values()) <= 3
    assert M.split_quotas(quotas, 6, seed=1).collect() != shares


def test_mixture_rows(spark):
    frame = documents(spark, n=80)
    mixed = M.mixture(frame, shards=4, block_words=500)
    assert mixed.columns == frame.columns
    words = defaultdict(int)
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"]) and size_of(r["text"]) > 0
        words[r["source"]] += size_of(r["text"])
    sizes = defaultdict(int)
    for r in rows(n=80):
        sizes[r[3]] += size_of(r[1])
    assert words == {s: math.floor(t) for s, t in fair(sizes).items() if t}
    whole = {(r[0], r[1]) for r in rows(n=80)}
    short = [r for r in mixed.collect() if (r["doc_id"], r["text"]) not in whole]
    assert len(short) <= len(sizes)
    texts = {d: t for d, t in whole}
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in short)


def test_no_documents_no_words(spark):
    assert M.mixed_documents(documents(spark).limit(0)).count() == 0
    assert M.mixture(documents(spark).limit(0)).count() == 0
    empty = documents(spark).filter("text is null or text = ''")
    assert {r["taken"] for r in M.mixed_documents(empty).collect()} == {0}
    assert M.mixture(empty).count() == 0


def test_taken_is_counted_in_the_mix(spark, monkeypatch):
    frame = documents(spark)
    want = sorted(M.mixed_documents(frame, 4, block_words=500).select("doc_id", "source", "key", "no", "size", "taken").collect(), key=str)
    assert sorted(M.counted(frame, 4, block_words=500).select("doc_id", "source", "key", "no", "size", "taken").collect(), key=str) == want
    drawn = M._drawn
    monkeypatch.setattr(M, "_drawn", lambda *a: drawn(*a).filter("_id <> 3"))  # a row lost in the draw shows
    lost = M.counted(frame, 4, block_words=500)
    assert lost.filter("doc_id = 3").agg(F.sum("taken")).first()[0] == 0 < sum(r["taken"] for r in want if r["doc_id"] == 3)


def test_copies_without_id_and_odd_names(spark):
    """Equal rows where the target cuts, rows without an id, and columns named like those used inside."""
    found = [(None, "s", "one two three", 13, k, "x", "y") for k in range(30)] + [(5, "s", " a b\tc d", 8, k, "x", "y") for k in range(20)]
    found += [(k, "t", "w " * k, 2 * k, k, "x", "y") for k in range(40)]
    frame = spark.createDataFrame(found, "doc_id long, source string, text string, n_chars int, `_no` int, `a.b` string, _mix_id string").repartition(5)
    got = M.counted(frame, 3, block_words=20).collect()
    want = {(r["doc_id"], r["source"], r["key"], r["no"]): r["taken"] for r in M.mixed_documents(frame, 3, block_words=20).collect()}
    assert {(r["doc_id"], r["source"], r["key"], r["no"]): r["taken"] for r in got} == want and len(got) == 90
    taken, size = defaultdict(int), defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
    assert taken == {s: math.floor(t) for s, t in fair(size).items()}
    mixed = M.mixture(frame, 3, block_words=20)
    assert mixed.columns == frame.columns and sum(size_of(r["text"]) for r in mixed.collect()) == sum(taken.values())


def test_texts_are_shuffled_once(spark):
    """The plan of the mix has one exchange with texts and no other that holds a document column, but for cut blocks."""
    frame = documents(spark, n=80)
    plan = M._drawn(frame, M.planned(frame, 4, block_words=500))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionById") + plan.count("RepartitionByExpression") == 1
