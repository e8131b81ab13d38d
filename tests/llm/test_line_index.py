import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import SCHEMA, rows
from terranet.llm import line_index as L

WHITE = " \t\n\v\f\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))


def brute(found, least_chars, least_documents):
    holders = defaultdict(list)
    for doc, text in found:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                holders[k].append(doc)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= least_documents}
    out = []
    for doc, text in found:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc]
        out.append((str(doc), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def documents():
    """Odd documents, and some made of few lines, one of them in a third of all."""
    rng = random.Random(5)
    pool = ["é" * 40, "e" * 39, "Shared Line " * 5, "ÄÖ shared " * 5, "  padded\t" + "x" * 40 + "\f ", " " + "y" * 39, "z" * 30 + " " + "z" * 10, "same " * 9]
    found = [(r[0], r[1]) for r in rows()]
    for i in range(100, 190):
        lines = [rng.choice([str.upper, str.lower, str])(rng.choice(pool)) if rng.random() < 0.7 else f"own line {i} " * 5 for _ in range(rng.randrange(1, 9))]
        found.append((i, "\n".join([*lines, "hot line " * 6] if i % 3 == 0 else lines)))
    return [*found, (None, pool[2] + "\n\n" + pool[0]), (150, found[70][1]), *((None, "only without an id " * 3) for _ in range(6)), (7, "\n\n")]


def frame(spark, found):
    """Rows of the table with every other column as well, some named like columns used inside."""
    filler = rows()[0]
    return spark.createDataFrame([(d, t, *filler[2:], 1, None, 2, 3, "x") for d, t in found],
                                 SCHEMA + ", shard int, h string, rest int, keys int, `a.b c` string")


@pytest.mark.parametrize("everywhere", [1 << 20, 3])
def test_equals_brute_force(spark, monkeypatch, everywhere):
    """With three entries everywhere all others are probed in their shards."""
    monkeypatch.setattr(L, "SHARD", 4)
    found = documents()
    got = L.without_recurring_lines(frame(spark, found), everywhere=everywhere)
    assert {"shard", "h", "rest", "a.b c", "lang"} <= set(got.columns)
    want = brute(found, 40, 5)
    assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == want
    assert sum(w[3] for w in want) > 100
    assert {r["a.b c"] for r in got.collect()} == {"x"}


def test_perfect_hash_numbers_every_key():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        hashed = L.PerfectHash.of(keys)
        again = L.PerfectHash.from_bytes(hashed.to_bytes())
        assert sorted(again.numbers(keys)) == list(range(len(keys)))
        assert all(-1 <= x < len(keys) for x in again.numbers(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)))


def test_equal_first_halves_and_strangers():
    """Keys that share 64 bits are told apart by their fingerprints."""
    table = L.pa.table([[7] * 5, [11, 11, 11, 12, 13], [1, 2, 3, 1, 1], [5, 6, 7, 8, 9], [50, 60, None, 80, 90]],
                       schema=L.pa.schema([(c, L.pa.int64()) for c in ("shard", "key", "fingerprint", "documents", "last")]))
    index = L.Index([tuple(r.values()) for r in L._build(table).to_pylist()], 1)
    index.parts = {0: index.parts[7]}
    found, lasts, known = index.probe(np.array([11, 11, 11, 11, 12, 14, 0], np.uint64), np.array([1, 2, 3, 4, 1, 1, 0], np.uint64))
    assert found.tolist() == [True, True, True, False, True, False, False]
    assert lasts[found].tolist() == [50, 60, 0, 80] and known[found].tolist() == [True, True, False, True]


def test_no_documents_and_no_recurring_lines(spark):
    empty = frame(spark, documents()).limit(0)
    assert L.without_recurring_lines(empty).count() == 0
    alone = spark.createDataFrame([(1, "x" * 50), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, L.without_recurring_lines(alone).collect())) == [(1, "x" * 50, 1, 0), (2, "", 1, 0)]
