import hashlib

import numpy as np
import pytest

from terranet.llm import sketches as S
from tests.llm.fixtures import documents, jaccard, rows, shingles


def test_edited_texts_and_likeness(spark):
    got = {r["doc_id"]: r for r in S.edited_pairs(documents(spark)).collect() if r["doc_id"] != 3}
    order = sorted({r[:2] for r in rows()}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    order = [(d, t or "") for d, t in order]
    assert len(got) == len(order) - 1
    for (doc, text), (_, behind) in zip(order, order[1:] + order[:1]):
        if doc in (3, 4):  # 3 is repeated, 4 is before a repeated row
            continue
        half = len(text) // 2
        edited = text[:len(text) - half] + behind[:half]
        row = got[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(row["near_edited"] - jaccard(shingles(text), shingles(edited))) < 0.1
        assert abs(row["near_next"] - jaccard(shingles(text), shingles(behind))) < 0.1
    same = {}
    for doc, text in order:
        if doc != 3:
            assert same.setdefault(text, got[doc]["fingerprint"]) == got[doc]["fingerprint"]


def test_repeated_rows_all_come_out(spark):
    assert S.edited_pairs(documents(spark)).count() == len(rows())


def test_one_block_one_document_no_document(spark):
    one = documents(spark).filter("doc_id = 5")
    assert S.edited_pairs(one).collect()[0]["near_next"] == 1.0
    assert S.edited_pairs(one.limit(0)).count() == 0
    blocks = S.with_next(documents(spark), 50).select("block").distinct().count()
    assert blocks > 10


def test_estimates_and_merging():
    rng = np.random.default_rng(0)
    a = [f"w{x}" for x in rng.integers(0, 5000, 6000)]
    b = a[:3000] + [f"v{x}" for x in rng.integers(0, 5000, 3000)]
    ta, tb = " ".join(a), " ".join(b)
    sa, sb = S.sketch_texts([ta, tb])
    A, B = shingles(ta), shingles(tb)
    assert S.distinct_count(sa) == pytest.approx(len(A), rel=0.2)
    assert S.resemblance(sa, sb) == pytest.approx(jaccard(A, B), abs=0.1)
    assert S.containment(sa, sb) == pytest.approx(len(A & B) / len(A), abs=0.15)
    parts = S.sketch_texts([" ".join(a[:3002]), " ".join(a[2998:])])
    assert np.array_equal(S.merged(parts), sa)
    assert np.array_equal(S.from_text(S.to_text(sa)), sa)


def test_fingerprints_keep_columns(spark):
    found = S.fingerprints(documents(spark))
    assert found.columns == [*documents(spark).columns, "fingerprint", "n_shingles"]
    assert found.filter("text is null").first()["fingerprint"] == ""
    assert S.fingerprints(documents(spark).limit(0)).count() == 0
