"""Hard negatives of anchors by exact integer scores.

Scores are inner products of integer vectors.  They are computed by matrix products
of residues modulo several primes below 512: with residues centred on zero, a sum of
256 products stays below 2^24, so single precision holds it exactly.  The number of
primes follows from the largest components met, and balanced mixed-radix digits give
the signed score back.

Anchors and rows are dealt to a grid: a cell holds one group of anchors and one
stripe of rows, both of bounded size, and returns the best few rows for each of its
anchors; a ranked window over these few merges the stripes.  A first pass finds the
positives and with them the score windows, a second one the negatives in the windows.

Defined cases.  Rows with a null id, label or vector, or a null or non-finite
component take no part.  Repeated rows count as often as they occur, but a repeated
anchor is one anchor, and no row is a positive or negative of its own id.  Shorter
vectors are filled up with zeros.  Components are limited to +-2^27 after scaling, so
that scores of 512 components fit a long.  Ties go to the smaller id.  Anchors
without positives, positives without negatives and empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from terranet.llm.tables import read
from terranet.plans.scratch import cut

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
ANCHORS, STRIPE = 8192, 65536  # rows of a grid cell, about
TILE = (512, 4096)  # anchors and rows scored at once
COMPONENT = 1 << 27
_CHUNK = 256  # products that single precision adds exactly
_LEAST = np.iinfo(np.int64).min


def primes_below(top: int) -> Iterator[int]:
    """Primes under ``top``, largest first."""
    for n in range(top - 1, 2, -1):
        if all(n % d for d in range(2, int(n ** 0.5) + 1)):
            yield n


def moduli(bound: int) -> list[int]:
    """Primes whose product tells all integers of absolute value up to ``bound`` apart."""
    found, product = [], 1
    for p in primes_below(512):
        if product > 2 * bound + 1:
            break
        found.append(p)
        product *= p
    return found


def _centred(values: np.ndarray, p: int) -> np.ndarray:
    return (values + p // 2) % p - p // 2


def _residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p``, centred."""
    ra, rb = (_centred(x, p).astype(np.float32) for x in (a, b))
    total = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], _CHUNK):
        total += (ra[:, k:k + _CHUNK] @ rb[:, k:k + _CHUNK].T).astype(np.int64)
    return _centred(total, p)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integer matrices by residues and Chinese remaindering."""
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    total, product = np.zeros((len(a), len(b)), np.int64), 1
    for p in moduli(min(a.shape[1] * most[0] * most[1], 1 << 63)):  # eight primes at most
        lacking = _centred(_residue_product(a, b, p) - total, p)
        total += _centred(lacking * pow(product, -1, p), p) * np.int64(product)  # the digit of the next place
        product *= p
    return total


def first_columns(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Per row the positions of the ``k`` highest allowed scores, leftmost first among equals; -1 where there are fewer."""
    left, rows = np.where(allowed, scores, _LEAST), np.arange(len(scores))
    found = np.full((len(scores), k), -1)
    for j in range(min(k, scores.shape[1])):
        at = left.argmax(1)
        found[:, j] = np.where(left[rows, at] > _LEAST, at, -1)
        left[rows, at] = _LEAST
    return found


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(lists.flatten())
    return out


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Grid cell: the first ``k`` rows of the stripe for every window (``low``, ``high``, ``same``) of every anchor."""
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts = []
        if len(anchors) and len(rows):
            rows = rows.sort_by([("id", "ascending")])
            width = max(int(np.asarray(t["vector"].combine_chunks().value_lengths()).max()) for t in (anchors, rows))
            ids, labels, vectors = np.asarray(rows["id"]), np.asarray(rows["label"]), _matrix(rows["vector"], width)
            for i in range(0, len(anchors), TILE[0]):
                parts.append(_tile(anchors.slice(i, TILE[0]), width, ids, labels, vectors, k))
        return pa.concat_tables(parts) if parts else _FOUND.empty_table()

    return cell


_FOUND = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
_FOUND_DDL = "anchor long, window int, score long, id long"


def _tile(anchors: pa.Table, width: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int) -> pa.Table:
    a_id, a_label = np.asarray(anchors["anchor_id"])[:, None], np.asarray(anchors["anchor_label"])[:, None]
    same = np.asarray(anchors["same"])[:, None]
    low, high = (_windows(anchors[name]) for name in ("low", "high"))
    a = _matrix(anchors["vector"], width)
    n, windows = len(anchors), low.shape[1]
    best = np.full((windows, n, k), _LEAST)
    best_id = np.zeros((windows, n, k), np.int64)
    for j in range(0, len(ids), TILE[1]):
        part = slice(j, j + TILE[1])
        scores = exact_products(a, vectors[part])
        fits = (a_id != ids[part]) & ((a_label == labels[part]) == same)
        for w in range(windows):
            at = first_columns(scores, fits & (scores >= low[:, w:w + 1]) & (scores <= high[:, w:w + 1]), k)
            found = np.where(at >= 0, np.take_along_axis(scores, np.maximum(at, 0), 1), _LEAST)
            # rows come by id: what was found before stands left of what is found now
            both = np.concatenate([best[w], found], 1)
            names = np.concatenate([best_id[w], ids[part][np.maximum(at, 0)]], 1)
            keep = first_columns(both, both > _LEAST, k)
            best[w] = np.where(keep >= 0, np.take_along_axis(both, np.maximum(keep, 0), 1), _LEAST)
            best_id[w] = np.take_along_axis(names, np.maximum(keep, 0), 1)
    w, row, _ = there = np.nonzero(best > _LEAST)
    return pa.table([np.asarray(anchors["anchor"])[row], w.astype(np.int32), best[there], best_id[there]], schema=_FOUND)


def _windows(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of bounds as a matrix; bounds that an anchor lacks are the least integer, as a high bound above no score."""
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists))), _LEAST)
    for row, bounds in zip(out, lists):
        row[:len(bounds)] = bounds
    return out


def _merged(anchors: DataFrame, rows: DataFrame, k: int, n_anchors: int, n_rows: int) -> DataFrame:
    """anchor, window, score, id, rank: the first ``k`` rows of every window over all stripes."""
    spark = anchors.sparkSession
    groups = max(1, -(-n_anchors // ANCHORS))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stripes = max(-(-n_rows // STRIPE), -(-parallel // groups))
    dealt = rows.withColumn("stripe", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(stripes))).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    blocks = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")).withColumn(
        "stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
    found = blocks.groupBy("group", "stripe").cogroup(dealt.groupBy("group", "stripe")).applyInArrow(_best(k), _FOUND_DDL)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def scaled(rows: DataFrame, vector: str, factor: int = 256) -> DataFrame:
    """``vector`` as integers floor(factor * x); rows that take no part are left out."""
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-COMPONENT), F.least(F.lit(COMPONENT), F.floor(factor * v.cast("double")))).cast("int"))
    return rows.filter(sound).withColumn(vector, whole)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Negatives of ``rows`` (id, label, integer vector) for the anchors that the condition ``is_anchor`` names.

    An anchor's positives are its first ``positives`` other rows of the same label; its negatives for
    a positive of score p the first ``negatives`` rows of other labels with
    low * p <= 100 * score <= high * p.  Returns anchor_id, positive_id, positive_rank, rank,
    negative_id, positive_score, negative_score.
    """
    rows = cut(rows.select(F.col("id").cast("long"), F.col("label").cast("long"), "vector").dropna(subset=["id", "label"]), "rows")
    anchors = rows.filter(is_anchor).distinct().select(F.monotonically_increasing_id().alias("anchor"), F.col("id").alias("anchor_id"),
                                                       F.col("label").alias("anchor_label"), "vector")
    anchors = cut(anchors, "anchors")
    n_rows, n_anchors = rows.count(), anchors.count()
    everything = anchors.withColumns({"same": F.lit(True), "low": F.array(F.lit(_LEAST + 1)), "high": F.array(F.lit(-(_LEAST + 1)))})
    near = cut(_merged(everything, rows, positives, n_anchors, n_rows).select(
        "anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")
    bounds = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(
        "window", F.ceil(share(low)).cast("long").alias("low"), F.floor(share(high)).cast("long").alias("high")))).alias("b"))
    narrowed = anchors.join(bounds, "anchor").select("*", F.lit(False).alias("same"), F.col("b.low").alias("low"), F.col("b.high").alias("high")).drop("b")
    found = _merged(narrowed, rows, negatives, n_anchors, n_rows)
    return found.join(near, ["anchor", "window"]).join(anchors.select("anchor", "anchor_id"), "anchor").select(
        "anchor_id", "positive_id", (F.col("window") + 1).alias("positive_rank"), "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 50 == 0)
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows a JOIN rows b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
