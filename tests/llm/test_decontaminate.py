import random

import numpy as np
import pyarrow as pa

from terranet.llm import decontaminate as D
from tests.llm.fixtures import documents, prose, rows


def greedy(text, item, least):
    """Longest unmarked common run, again and again, by comparing everything."""
    free_t, free_p, found = [True] * len(text), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and free_p[p + n] and free_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        if best[0] < least:
            return found
        n, p, t = best
        free_p[p:p + n] = free_t[t:t + n] = [False] * n
        found += n


def test_tiles_against_brute_force():
    rng = random.Random(1)
    for k in range(150):
        item = np.array([rng.randrange(4 if k % 2 else 40) for _ in range(rng.randrange(1, 60))], np.uint64)
        text = np.array([rng.randrange(4 if k % 2 else 40) for _ in range(rng.randrange(1, 80))], np.uint64)
        for _ in range(3):
            a, n = rng.randrange(len(item)), rng.randrange(1, 20)
            at = rng.randrange(len(text))
            text = np.concatenate([text[:at], item[a:a + n], text[at:]])
        got = D.tiles(text, item, 3)
        marked_p, marked_t = set(), set()
        for p, t, n in got:
            assert n >= 3 and np.array_equal(item[p:p + n], text[t:t + n])
            assert not marked_p & {*range(p, p + n)} and not marked_t & {*range(t, t + n)}
            marked_p |= {*range(p, p + n)}
            marked_t |= {*range(t, t + n)}
        lengths = sorted((n for _, _, n in got), reverse=True)
        want = greedy(text.tolist(), item.tolist(), 3)
        assert lengths[:1] == ([max(lengths)] if lengths else [])
        if k % 2 == 0:  # with few ties every order of marking covers as much
            assert abs(sum(lengths) - want) <= 3
        assert bool(lengths) == bool(want)


def items(rng):
    whole = prose(rng, 40, 9000)
    other = prose(rng, 44, 9000)
    return [(1, whole), (2, other), (3, None), (4, ""), (5, "zeta eta theta"), (6, whole)]


def test_contaminated_documents(spark):
    rng = random.Random(8)
    benchmark = items(rng)
    whole, other = benchmark[0][1].split(), benchmark[1][1].split()
    planted = {
        100: prose(rng, 50) + " " + " ".join(whole) + " " + prose(rng, 50),                      # exact
        101: prose(rng, 30) + " " + " ".join(whole).upper().replace(" ", ",\n") + ".",            # case and punctuation
        102: " ".join(whole[25:]) + " " + prose(rng, 9) + " " + " ".join(whole[:25]),             # parts in another order
        103: " ".join(other[:24]) + " " + prose(rng, 300),                                         # a good half
        104: " ".join(other[:14]) + " " + prose(rng, 300),                                         # a third: clean
        105: " ".join(w for k, w in enumerate(whole) if k % 4),                                    # no run of five: clean
        106: "and zeta eta theta iota",                                                            # a short item
    }
    extra = spark.createDataFrame([(d, t, *rows()[0][2:]) for d, t in planted.items()], documents(spark).schema)
    frame, bench = documents(spark).unionByName(extra), spark.createDataFrame(benchmark, "item_id long, text string")
    got = D.contaminated(frame, bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {
        (100, 1), (100, 6), (101, 1), (101, 6), (102, 1), (102, 6), (103, 2), (106, 5)}
    kept = D.clean_documents(frame, bench)
    assert kept.columns == frame.columns
    assert kept.count() == frame.count() - 5


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    benchmark = [(i, prose(rng, 20, 9000)) for i in range(12)]
    frame = spark.createDataFrame([(i, prose(rng, 30) + " " + t) for i, t in benchmark], "doc_id long, text string")
    bench = spark.createDataFrame(benchmark, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    assert sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(frame, bench).collect()) == [(i, i) for i in range(12)]


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert D.contaminated(documents(spark).limit(0), bench).count() == 0
    assert D.contaminated(documents(spark), bench.limit(0)).count() == 0
    assert D.clean_documents(documents(spark), bench.limit(0)).count() == len(rows())


def test_seeds_cover_every_tile():
    words, ends = D.plain_words(["one two three four five six seven", "b c d e f"])
    seeds = D._seeds(words, ends, 5)
    doc, doc_ends = D.plain_words(pa.array(["x one two three four five six y b c d e f"]))
    found = D._hits(seeds[0], doc, doc_ends)
    assert sorted(zip(found[1].tolist(), found[2].tolist())) == [(0, 0), (0, 1), (1, 0)]


def test_case_and_punctuation_outside_ascii(spark):
    item = "Müßige Äpfel, Élan — “Ñandú” und l’été: Größe in Straßen… Ὀδυσσεὺς, ДОМ и Ёлка « ça va » über Öl"
    other = item.upper().replace("—", "-").replace("“", '"').replace("”", '" ').replace("’", "'").replace("… ", "...\u00a0").replace("«", "„").replace("ÄPFEL", "ÄP\u00adFEL")
    got, ends = D.plain_words([item, other, item.lower(), "", "été\u2009\u2028,—été", "\u00ad", "plain ASCII", "a" + "\U0001F600"])
    assert np.array_equal(got[:ends[1]], got[ends[1]:ends[2]]) and np.array_equal(got[:ends[1]], got[ends[2]:ends[3]])
    assert np.diff(ends).tolist() == [18, 18, 18, 0, 2, 0, 2, 1] and got[ends[4]] == got[ends[4] + 1]
    assert np.array_equal(D.plain_words(["plain ASCII"])[0], got[ends[6]:ends[7]])
    frame = spark.createDataFrame([(1, f"vor {other} nach"), (2, "etwas ganz anderes")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in D.contaminated(frame, bench).collect()] == [(1, 7, 1.0)]
