import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from terranet.llm import token_file as T
from terranet.plans.scratch import scratch_path
from tests.llm.fixtures import documents, rows, thue_morse

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(FILE)
    found.encode_special_tokens = True
    return found


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(4)
    some = ["a", "b", "é", " ", "  ", "\n", " ", " ", "　", "\x1c", "\x85", "12", "'s", "'", "!", "?!", "word", "Über", "日本",
            "😀", "\t", "\r\n", "<|endoftext|>", " the", "don't", " 's", "​"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(5000)] + ["x" * 50_000, " " * 3000, "a b " * 20_000]
    ids, ends = T.Encoder(open(FILE).read()).encode(pa.array(texts))
    for text, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text[:80])


@pytest.mark.parametrize("widths", [None, [8, 8], [3, 5, 9], [16], [4, 4, 4, 4, 4]])
def test_codes_round_trip_and_access(widths):
    for n in (1, 2, 511, 512, 513, 70_001):
        ids = np.random.default_rng(n).zipf(1.3, n) % 50_000
        levels = T.encode(ids, widths)
        assert np.array_equal(T.decode(levels, n), ids)
        for i in {0, n // 2, n - 1, *range(0, n, 397)}:
            assert T.access(levels, i) == ids[i]


def test_file_set(spark, tokenizer):
    path = scratch_path(spark, "tokens")
    got = sorted(T.encoded_documents(documents(spark), FILE, path).collect(), key=lambda r: r["start"])
    want, start = [], 0
    everything = []
    for doc, text in sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is not None, r)):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        everything += ids
    assert [tuple(r) for r in got] == want
    places = spark.createDataFrame([(i * 131 % start,) for i in range(100)], "place long")
    assert all(r["token"] == everything[r["place"]] for r in T.token_at(spark, path, places).collect())


def test_no_documents(spark):
    assert T.encoded_documents(documents(spark).limit(0), FILE).count() == 0


def test_words_that_polynomials_confuse(tokenizer):
    texts = [w for n in (1024, 2048, 4096, 8192) for w in thue_morse(n)]
    ids, ends = T.Encoder(open(FILE).read()).encode(pa.array(texts))
    for text, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_what_is_learnt_stays_in_the_worker(spark):
    """Later tasks of a worker meet the encoder of its first task."""
    shared = spark.sparkContext.broadcast(open(FILE).read())

    def run(batches):
        for batch in batches:
            encoder = T.encoder_of(shared.value)
            before = encoder.filled
            encoder.encode(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([before])], ["before"])

    texts = spark.range(64).repartition(64).selectExpr("concat('word', id) as text")
    assert sum(r["before"] > 0 for r in texts.mapInArrow(run, "before long").collect()) > 20


def test_order_of_the_input_stays(spark, tokenizer):
    """A mix that is written in shards keeps its order in the token files."""
    texts = [(k * 37 % 100, f"text {k} " * (k % 7)) for k in range(100)]
    path = scratch_path(spark, "ordered")
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = sorted(T.encoded_documents(spark.read.parquet(path), FILE, by_id=False).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [d for d, _ in texts]
    assert [r["n_tokens"] for r in got] == [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts]
