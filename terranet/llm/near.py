"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; two different texts are linked from a
similarity of 0.8 on.  The steps:

1. Equal texts are one class (MD5 of the text); the rest works on one text per class.
2. 128 MinHash values per class, in 32 bands of four.  A pair at the threshold
   shares no band with a chance of 5e-8, and that is the only source of loss
   besides the pruning tolerance.
3. Classes that share a band are compared value by value, 16 at a time.  A pair
   is dropped once the posterior probability of reaching the threshold, with a
   uniform prior, falls below the tolerance.
4. Pairs that remain join classes into clusters.  Each cluster meets once, whole
   texts included, and all its pairs are verified exactly.

Nothing emits the pairs of a group: comparisons run inside tasks, which return a
spanning forest and the number of links of each text.  Large buckets and
clusters are split into pairs of blocks, so that no task holds more than two
blocks of one group.

Null texts count as empty.  Texts without a word have no links to different
texts; equal texts are one class, empty ones too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terranet.llm import words
from terranet.llm.tables import read
from terranet.plans.components import components
from terranet.plans.scratch import cut

VALUES, ROWS, STEP = 128, 4, 16
THRESHOLD, TOLERANCE = 0.8, 1e-6
BUCKET_BLOCK, CLUSTER_BLOCK = 1024, 256
_rng = np.random.default_rng(7)
_TIMES = _rng.integers(1, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """128 MinHash values of 16 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i:i + 2048, None] * _TIMES + _PLUS).min(axis=0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """Fewest equal values after 16, 32, ... compared ones with which a pair stays.

    With a uniform prior the posterior of n values, m of them equal, is
    Beta(m + 1, n - m + 1), and P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    least = []
    for n in range(STEP, VALUES + 1, STEP):
        reached, m = 0.0, -1
        while reached < tolerance:
            m += 1
            reached += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        least.append(m)
    return least


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in words.slices(batch.column(2)):
            part = batch.slice(i, j - i)
            shingles, ends = words.shingle_hashes(*words.word_hashes(part.column(2)))
            signs = [minhash(shingles[a:b]).tobytes() if b > a else None for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(signs, pa.binary())], ["key", "doc_id", "sign"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int = 4096) -> Iterator[pa.Table]:
    """Runs of whole groups from rows sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for i in range(0, len(batch), most):
            part = batch.slice(i, most)
            tail = part.slice(len(part) - 1)
            same = np.ones(len(part), bool)
            for k in range(keys):
                same &= np.asarray(part.column(k)) == np.asarray(tail.column(k))[0]
            begin = len(part) - int(np.argmin(same[::-1])) if not same.all() else 0
            if begin == 0 and held and all(held[-1].column(k)[len(held[-1]) - 1] == part.column(k)[0] for k in range(keys)):
                held.append(part)
                continue
            if held or begin:
                yield pa.Table.from_batches([*held, part.slice(0, begin)])
            held = [part.slice(begin)]
    if held:
        yield pa.Table.from_batches(held)


def _group_starts(rows: pa.Table, keys: int) -> np.ndarray:
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = False
        for k in range(keys):
            column = rows.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), len(rows))


def _pairs(starts: np.ndarray, side: np.ndarray, cross: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside groups, some ``most`` at a time; across the two sides only where ``cross``."""
    group_end = np.repeat(starts[1:], np.diff(starts))
    later = group_end - np.arange(len(group_end)) - 1  # partners behind each row
    total = np.cumsum(later)
    i = 0
    while i < len(later):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        n = later[i:j]
        a = np.repeat(np.arange(i, j), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        keep = ~cross[a] | (side[a] != side[b])
        yield a[keep], b[keep]
        i = j


def lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected with each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(label[label], label):
            label = label[label]


def _prune(threshold: float, tolerance: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            signs = np.frombuffer(b"".join(rows["sign"].to_pylist()), np.uint16).reshape(len(rows), VALUES)
            lo, hi = rows["lo"].to_numpy(), rows["hi"].to_numpy()
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in _pairs(_group_starts(rows, 3), rows["part"].to_numpy() == lo, lo != hi):
                equal = np.zeros(len(a), np.int16)
                for step, m in enumerate(least):
                    at = slice(step * STEP, (step + 1) * STEP)
                    equal += np.count_nonzero(signs[a, at] == signs[b, at], axis=1).astype(np.int16)
                    stay = equal >= m
                    if not stay.all():
                        a, b, equal = a[stay], b[stay], equal[stay]
                left.append(a)
                right.append(b)
            label = lowest(len(rows), np.concatenate(left), np.concatenate(right))
            child = np.flatnonzero(label != np.arange(len(rows)))
            if len(child):
                key = rows["key"].combine_chunks()
                yield pa.RecordBatch.from_arrays([key.take(pa.array(child)), key.take(pa.array(label[child]))], ["a", "b"])

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes of sorted distinct arrays."""
    n = len(sets)
    common = np.diag([float(len(s)) for s in sets])
    if n == 2:
        both = np.sort(np.concatenate(sets))
        common[0, 1] = common[1, 0] = np.count_nonzero(both[1:] == both[:-1])
        return common
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    everything = np.concatenate(sets)
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    new = np.append(True, everything[1:] != everything[:-1]) if len(everything) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else new
    owner, column = owner[shared], column[shared]
    if not len(column):
        return common
    column = np.unique(column, return_inverse=True)[1]
    off = np.zeros((n, n), np.float32)
    for begin in range(0, int(column[-1]) + 1, 4096):
        a, b = np.searchsorted(column, [begin, begin + 4096])
        block = np.zeros((n, int(column[b - 1]) - begin + 1), np.float32)
        block[owner[a:b], column[a:b] - begin] = 1
        off += block @ block.T
    np.fill_diagonal(off, 0)
    return common + off


def _verify(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3, 512):
            texts = rows["text"].combine_chunks()
            sets: list[np.ndarray] = []
            for i, j in words.slices(texts):
                shingles, ends = words.shingle_hashes(*words.word_hashes(texts.slice(i, j - i)))
                sets += [np.unique(shingles[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            starts = _group_starts(rows, 3)
            first = rows["part"].to_numpy() == rows["lo"].to_numpy()
            apart = rows["lo"].to_numpy() != rows["hi"].to_numpy()
            links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                common = common_counts(sets[a:b])
                size = np.diag(common)
                linked = common >= threshold * (size[:, None] + size - common) - 1e-9
                np.fill_diagonal(linked, False)
                if apart[a]:
                    linked &= first[a:b, None] != first[a:b]
                links[a:b] = linked.sum(axis=1)
                label[a:b] = a + lowest(b - a, *np.nonzero(np.triu(linked)))
            key = rows["key"].combine_chunks()
            root = key.take(pa.array(label, mask=label == np.arange(len(rows))))
            yield pa.RecordBatch.from_arrays([key, root, pa.array(links)], ["key", "root", "links"])

    return run


def _split(rows: DataFrame, group: str, size: Column, block: int) -> DataFrame:
    """Columns lo, hi, part: groups of more than ``block`` rows become all pairs of smaller blocks."""
    rows = rows.withColumn("_n", F.ceil(size / block).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", group), F.col("_n")).cast("int"))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumns({"lo": F.least("part", "_k"), "hi": F.greatest("part", "_k")}).drop("_n", "_k")


def _clusters(edges: DataFrame) -> DataFrame:
    """(key, cluster) of every class that has an edge."""
    found = components(edges.select(F.lit(0).alias("frame_id"), "a", "b"))
    return found.select(F.col("id").alias("key"), F.col("component").alias("cluster"))


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.unhex(F.md5(text)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _pick(doc_id: str) -> Column:
    """A key that is never null, for joins on doc_id."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("pick")


def classes_of(documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Classes of equal texts: key, copy_of (smallest doc_id), copies, cluster (key), n_links, class_id.

    ``n_links`` counts the different texts linked with the class; ``class_id`` is
    the smallest doc_id of all texts connected by links.
    """
    rows = _keyed(documents)
    signed = rows.mapInArrow(words.lean(_sign), "key binary, doc_id long, sign binary")
    classes = cut(signed.groupBy("key").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"), F.min("sign").alias("sign")), "classes")
    bands = classes.filter("sign is not null").select("key", F.explode(F.sequence(F.lit(0), F.lit(VALUES // ROWS - 1))).alias("band"), "sign")
    bands = bands.select(F.xxhash64("band", F.expr(f"substring(sign, {2 * ROWS} * band + 1, {2 * ROWS})")).alias("bucket"), "key")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = bands.join(shared, "bucket").join(classes.select("key", "sign"), "key")
    met = _split(met, "bucket", F.col("n"), BUCKET_BLOCK).select("bucket", "lo", "hi", "part", "key", "sign")
    pruned = met.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(
        words.lean(_prune(threshold, tolerance)), "a binary, b binary")
    clusters = cut(_clusters(pruned.distinct()), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    members = clusters.join(sizes, "cluster").join(classes.select("key", _pick("copy_of")), "key")
    texts = members.join(rows.select("key", _pick("doc_id"), "text"), ["key", "pick"]).dropDuplicates(["key", "pick"])
    meet = _split(texts, "cluster", F.col("n"), CLUSTER_BLOCK)
    checked = cut(meet.select("cluster", "lo", "hi", "part", "key", "text").repartition("cluster", "lo", "hi").sortWithinPartitions(
        "cluster", "lo", "hi", "key").mapInArrow(words.lean(_verify(threshold)), "key binary, root binary, links long"), "checked")
    links = checked.groupBy("key").agg(F.sum("links").alias("n_links"))
    joined = _clusters(checked.filter("root is not null").select(F.col("key").alias("a"), F.col("root").alias("b")).distinct())
    linked = classes.select("key", "copy_of", "copies").join(links, "key", "left").join(joined, "key", "left")
    linked = cut(linked.withColumns({"n_links": F.coalesce("n_links", F.lit(0)), "cluster": F.coalesce("cluster", "key")}), "linked")
    smallest = linked.filter("n_links > 0").groupBy("cluster").agg(F.min("copy_of").alias("class_id"))
    return linked.join(smallest, "cluster", "left").withColumn("class_id", F.when(F.col("n_links") > 0, F.col("class_id")).otherwise(F.col("copy_of")))


def near_links(documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: doc_id, class_id, copy_of, copies, n_links.

    Rows with one ``class_id`` are connected by links; ``copy_of`` is the smallest
    doc_id with the same text.  Other columns of ``documents`` are not used.
    """
    classes = classes_of(documents, threshold, tolerance)
    return _keyed(documents).select("key", "doc_id").join(classes, "key").select("doc_id", "class_id", "copy_of", "copies", "n_links")


def one_of_each(documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents without near copies: of each group the one with the smallest doc_id stays, once."""
    classes = classes_of(documents, threshold, tolerance)
    kept = classes.filter("copy_of <=> class_id").select("key", "cluster", _pick("copy_of"))
    # texts of one cluster can share the smallest doc_id only if that id is repeated
    kept = kept.groupBy("cluster", "pick").agg(F.min("key").alias("_key")).select("_key", F.col("pick").alias("_pick"))
    names = [f"c{k}" for k in range(len(documents.columns))]
    name = dict(zip(documents.columns, names))
    keyed = documents.toDF(*names).withColumns({"_key": F.unhex(F.md5(F.coalesce(name["text"], F.lit("")))), "_pick": _pick(name["doc_id"])})
    return keyed.join(kept, ["_key", "_pick"]).dropDuplicates(["_key", "_pick"]).select(*names).toDF(*documents.columns)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, md5(coalesce(text, '')) AS k, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
cls AS (SELECT k, min(doc_id) AS copy_of, count(*) AS copies, any_value(w) AS w FROM words GROUP BY k),
sh AS (SELECT DISTINCT k, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s
       FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM cls WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
common AS (SELECT a.k AS ka, b.k AS kb, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.k <> b.k GROUP BY ALL),
link AS (SELECT ka, kb FROM common JOIN n x ON x.k = ka JOIN n y ON y.k = kb WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT ka AS k, ka AS r FROM link UNION SELECT reach.k, link.kb FROM reach JOIN link ON link.ka = reach.r),
grp AS (SELECT reach.k, min(copy_of) AS class_id FROM reach JOIN cls ON cls.k = reach.r GROUP BY reach.k),
deg AS (SELECT ka AS k, count(*) AS n_links FROM link GROUP BY ka)
SELECT doc_id, coalesce(class_id, copy_of) AS class_id, copy_of, copies, coalesce(n_links, 0) AS n_links
FROM words JOIN cls USING (k) LEFT JOIN grp USING (k) LEFT JOIN deg USING (k)
"""
