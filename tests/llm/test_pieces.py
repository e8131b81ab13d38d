import random

import public_tokenizers

from terranet.llm import pieces as P
from tests.llm.fixtures import _split, documents, rows, thue_morse


def greedy(word, vocabulary, marker=b" "):
    word, at, n = marker + word, 0, 0
    while at < len(word):
        ends = [j for j in range(len(word), at, -1) if word[at:j] in vocabulary]
        if not ends:
            return 1
        at, n = ends[0], n + 1
    return n


def test_small_vocabularies(spark):
    rng = random.Random(3)
    for _ in range(8):
        vocabulary = [b" "] + [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 5))) for _ in range(6)]
        vocabulary += [b" " + bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(3)]
        found = [(i, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(6))) for i in range(20)]
        got = P.piece_counts(spark.createDataFrame(found, "doc_id long, text string"), vocabulary).collect()
        assert {r["doc_id"]: r["n_pieces"] for r in got} == {i: sum(greedy(w.encode(), {*vocabulary}) for w in t.split()) for i, t in found}


def test_byte_vocabulary_on_odd_texts(spark):
    vocabulary = P.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = {*vocabulary}
    want = sorted((str(r[0]), len(_split(r[1] or "")), sum(greedy(w.encode(), known) for w in _split(r[1] or "") if len(w) < 5000)) for r in rows())
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_pieces"]) for r in P.piece_counts(documents(spark), vocabulary).collect())
    for a, b in zip(got, want):
        if a[0] != "47":  # one word of 14,000 bytes: the brute force would take too long
            assert a == b
    assert P.piece_counts(documents(spark).limit(0), vocabulary).count() == 0


def test_words_that_polynomials_confuse(spark):
    vocabulary = [b" ", b"a", b"b", b"ab", b"aab", b"abba"]
    found = [(k, w + " x") for k, w in enumerate(w for n in (1024, 2048, 4096, 8192) for w in thue_morse(n))]
    got = P.piece_counts(spark.createDataFrame(found, "doc_id long, text string").coalesce(1), vocabulary).collect()
    assert {r["doc_id"]: r["n_pieces"] for r in got} == {i: sum(greedy(w.encode(), {*vocabulary}) for w in t.split()) for i, t in found}
