"""Document fingerprints: bottom-k sketches of word shingles.

A sketch holds the k smallest distinct 48-bit hashes of a text's five-word
shingles, ascending.  Sketches of parts merge into the sketch of the whole, and
two sketches estimate resemblance, containment and the number of distinct
shingles.  Below k shingles all figures are exact.

Null and white-space texts have an empty sketch; two empty sketches resemble
each other fully, an empty and a filled one not at all.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from terranet.llm import words
from terranet.llm.tables import read

K = 256
_BITS = 48


def sketch_texts(texts, k: int = K, size: int = words.SHINGLE) -> list[np.ndarray]:
    """Bottom-k sketch of every text."""
    shingles, ends = words.shingle_hashes(*words.word_hashes(texts), size)
    shingles >>= np.uint64(64 - _BITS)
    return [_smallest(shingles[a:b], k) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _smallest(values: np.ndarray, k: int) -> np.ndarray:
    if len(values) > 8 * k:  # repeated shingles may leave fewer than k, then sort all
        some = np.unique(np.partition(values, 4 * k)[:4 * k])
        if len(some) >= k:
            return some[:k]
    return np.unique(values)[:k]


def merged(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    """Sketch of the union of what the sketches were made of."""
    return np.unique(np.concatenate([*sketches, np.zeros(0, np.uint64)]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of two shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    distinct = np.concatenate([both[:1], both[1:][~twice]])[:k]
    return float(np.count_nonzero(both[1:][twice] <= distinct[-1]) / len(distinct))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    if len(a) < k:
        return float(len(a))
    return (k - 1) / ((float(a[k - 1]) + 1.0) / 2.0 ** _BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that are also in ``b``."""
    if not len(a):
        return 1.0
    union = distinct_count(merged([a, b], k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_count(a, k))


def to_text(sketch: np.ndarray) -> str:
    """Base64 of the 48-bit big-endian values."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, _BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def fingerprints(documents: DataFrame, k: int = K, text: str = "text") -> DataFrame:
    """All columns of ``documents`` and ``fingerprint`` (base64), ``n_shingles`` (estimate).

    One pass without a shuffle.  Columns of these names are replaced.
    """
    kept = [c for c in documents.columns if c not in ("fingerprint", "n_shingles")]
    rows = documents.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in words.slices(batch.column(at)):
                part = batch.slice(i, j - i)
                found = sketch_texts(part.column(at), k)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(map(to_text, found), pa.string()), pa.array([distinct_count(s, k) for s in found])],
                    [*kept, "fingerprint", "n_shingles"])

    return rows.mapInArrow(fill, T.StructType([*rows.schema.fields, T.StructField("fingerprint", T.StringType()), T.StructField("n_shingles", T.DoubleType())]))


def _blocks(ids: DataFrame, most: int) -> list[int]:
    """At most ``most - 1`` cuts that divide the ids into blocks of about as many rows."""
    cuts = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / most) for i in range(1, most)]), 20_000)).first()[0]
    return sorted(set(cuts or []))


def with_next(documents: DataFrame, blocks: int) -> DataFrame:
    """(block, guest, doc_id, text): the documents, and behind each block a copy of the one that follows it.

    Order: descending doc_id, nulls last, equal ids by text; after the last comes
    the first.  Only the cuts and one id per block reach the driver.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = _blocks(rows.select("doc_id"), blocks)
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c < F.col("doc_id")))
    rows = rows.withColumn("block", F.coalesce(-place, F.lit(1)))  # null ids have a block of their own, the last
    heads = rows.groupBy("block").agg(F.max("doc_id").alias("head")).orderBy("block").collect()
    before = {heads[i]["head"]: heads[i - 1]["block"] for i in range(len(heads))}
    known = [(h, b) for h, b in before.items() if h is not None]
    target = F.lit(None).cast("int")
    if known:
        table = F.create_map(*[F.lit(v) for pair in known for v in pair])
        target = F.try_element_at(table, F.col("doc_id"))
    if None in before:
        target = F.when(F.col("doc_id").isNull(), F.lit(before[None])).otherwise(target)
    copies = F.array(F.struct(F.col("block"), F.lit(False).alias("guest")), F.struct(target.alias("block"), F.lit(True).alias("guest")))
    return rows.withColumn("copy", F.explode(copies)).filter("copy.block is not null").select(
        "copy.block", "copy.guest", "doc_id", "text").repartition("block").sortWithinPartitions(
        "block", "guest", F.col("doc_id").desc_nulls_last(), "text")


_EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, n_shingles double, in_next double")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of each document and of its edited text, in blocks sorted by ``with_next``."""
    held: tuple | None = None  # (block, doc_id, text, sketch) of the row that waits for the next one
    for batch in batches:
        for i, j in words.slices(batch.column(3)):
            part = batch.slice(i, j - i)
            found = sketch_texts(part.column(3))
            first: list[tuple] = []
            second: list[tuple] = []
            for block, guest, doc, text, own in zip(*[c.to_pylist() for c in part.columns], found):
                if held is not None and held[0] == block:
                    first.append(held)
                    second.append((text, own))
                held = None if guest else (block, doc, text, own)
            if not first:
                continue
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, _, t, _), (n, _) in zip(first, second)]
            changed = [s for lo, hi in words.slices(pa.array(edited, pa.large_string())) for s in sketch_texts(edited[lo:hi])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([d for _, d, _, _ in first], pa.int64()),
                "n_chars": pa.array([len(t) for _, _, t, _ in first], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": [to_text(s) for _, _, _, s in first],
                "edited_fingerprint": [to_text(s) for s in changed],
                "near_edited": [resemblance(f[3], s) for f, s in zip(first, changed)],
                "near_next": [resemblance(f[3], n) for f, (_, n) in zip(first, second)],
                "n_shingles": [distinct_count(f[3]) for f in first],
                "in_next": [containment(f[3], n) for f, (_, n) in zip(first, second)]})


def edited_pairs(documents: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness (see README, op1).

    The text moves once, into blocks of neighbouring ids.  An empty table gives an empty result.
    """
    blocks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_next(documents, max(2, blocks)).mapInArrow(_edit, _EDITED)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(read(spark, sf_dir, "documents"))
