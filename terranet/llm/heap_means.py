"""Centroid clustering with heap-ordered bounds.

Vectors are integers and lie in blocks of bounded size.  For each block and cluster a
binary heap orders the cluster's vectors by the gap between a lower bound of the distance
to any other centroid and an upper bound of the distance to their own.  Gaps are stored
plus the cluster's accumulated drift at that time (how far its centroid moved plus the
farthest move of any other), so a round touches no vector whose gap has not expired: it
pops heap entries up to today's drift, measures these vectors against all centroids in
exact integers and pushes them onto the heap of their nearest centroid.

Vectors are written once, bucketed by block; a round reads them next to the heaps of the
round before without a shuffle and writes the new heaps, which also carry each cluster's
exact sums.  Only sums and centroids, ``k`` rows each, meet on the driver.

Defined cases.  Vectors without exactly the wanted number of components, or with a null
or non-finite one, or without an id, are left out.  Repeated rows count as often as they
occur.  Components are limited to +-2^27 after scaling, so that a squared distance of 64
components fits a long.  Ties go to the smaller cluster number.  With fewer vectors than
clusters there are as many clusters as vectors; an empty table gives no rows.  Inertia
beyond a long is null.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from terranet.llm.negatives import scaled
from terranet.llm.tables import read
from terranet.plans.scratch import cut, scratch_path

CLUSTERS, ROUNDS, DIMENSIONS, SEED = 40, 5, 64, 2
BLOCK = 8192  # vectors of a block, about; far more than clusters, as a block carries the sums of each cluster
_BUCKETS = 50_000
_SLACK = 1e-9  # covers the rounding of square roots and drifts
_HEAPS = pa.schema([("block", pa.int64()), ("cluster", pa.int32()), ("gaps", pa.binary()), ("places", pa.binary()),
                    ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("rescanned", pa.int64())])
_HEAPS_DDL = "block long, cluster int, gaps binary, places binary, n long, sums array<long>, rescanned long"
_FOUND = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    most = int(np.abs(vectors).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    if vectors.shape[1] * most * most < 1 << 52:  # doubles hold every term
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)


class Heaps:
    """Heaps of one block.  ``drift`` is what every cluster's gaps have lost since the first round."""

    def __init__(self, vectors: np.ndarray, centroids: np.ndarray, drift: np.ndarray):
        self.vectors, self.centroids, self.drift = vectors, centroids, drift
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in centroids]
        self.sums = np.zeros(centroids.shape, np.int64)
        self.rescanned = 0

    def load(self, cluster: int, gaps: bytes, places: bytes, sums: list[int]) -> None:
        self.heaps[cluster] = list(zip(np.frombuffer(gaps).tolist(), np.frombuffer(places, np.int32).tolist()))
        self.sums[cluster] = sums

    def rescan(self) -> None:
        """Pop what has expired, measure it exactly and push it again."""
        popped, owners = [], []
        for cluster, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= self.drift[cluster]:
                popped.append(heapq.heappop(heap)[1])
                owners.append(cluster)
        self._place(np.array(popped, np.int64), np.array(owners, np.int64))

    def fill(self) -> None:
        self._place(np.arange(len(self.vectors)), None)

    def _place(self, places: np.ndarray, owners: np.ndarray | None) -> None:
        if not len(places):
            return
        self.rescanned += len(places)
        found = self.vectors[places]
        distances = squared_distances(found, self.centroids)
        nearest = distances.argmin(1)  # the first of equals
        upper = np.sqrt(distances[np.arange(len(places)), nearest].astype(np.float64))
        lower = np.sqrt(np.partition(distances, 1, 1)[:, 1].astype(np.float64)) if len(self.centroids) > 1 else np.full(len(places), np.inf)
        now = self.drift[nearest]
        keys = now + (lower - upper) - _SLACK * (1 + upper + np.where(np.isinf(lower), 0, lower) + now)
        if owners is None:
            np.add.at(self.sums, nearest, found)
        else:
            moved = owners != nearest
            np.add.at(self.sums, nearest[moved], found[moved])
            np.subtract.at(self.sums, owners[moved], found[moved])
        order = np.argsort(nearest, kind="stable")
        cuts = np.searchsorted(nearest[order], np.arange(len(self.centroids) + 1))
        for cluster, heap in enumerate(self.heaps):
            here = order[cuts[cluster]:cuts[cluster + 1]]
            entries = list(zip(keys[here].tolist(), places[here].tolist()))
            if len(entries) * 4 > len(heap):
                heap += entries
                heapq.heapify(heap)
            else:
                for entry in entries:
                    heapq.heappush(heap, entry)

    def rows(self, block: int) -> pa.Table:
        out = []
        for cluster, heap in enumerate(self.heaps):
            gaps, places = zip(*heap) if heap else ((), ())
            out.append((block, cluster, np.array(gaps, np.float64).tobytes(), np.array(places, np.int32).tobytes(), len(heap), self.sums[cluster].tolist(),
                        self.rescanned if cluster == 0 else 0))
        return pa.table(list(map(list, zip(*out))), schema=_HEAPS)

    def assigned(self) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of every vector."""
        cluster = np.zeros(len(self.vectors), np.int64)
        for k, heap in enumerate(self.heaps):
            cluster[[place for _, place in heap]] = k
        most = int(np.abs(self.vectors).max(initial=0)) + int(np.abs(self.centroids).max(initial=0))
        kind = np.int64 if most < 1 << 31 else object
        return cluster, ((self.vectors - self.centroids[cluster]).astype(kind) ** 2).sum(1).astype(np.int64)


def _vectors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, in the fixed order of their row numbers."""
    rows = rows.sort_by("row")
    flat = np.asarray(rows["vector"].combine_chunks().flatten())
    return np.asarray(rows["id"]), flat.reshape(len(rows), -1).astype(np.int64)


def _first(centroids: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        heaps = Heaps(_vectors(rows)[1], centroids, np.zeros(len(centroids)))
        heaps.fill()
        return heaps.rows(rows["block"][0].as_py())

    return run


def _next(centroids: np.ndarray, drift: np.ndarray, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        ids, vectors = _vectors(rows)
        heaps = Heaps(vectors, centroids, drift)
        for r in state.to_pylist():
            heaps.load(r["cluster"], r["gaps"], r["places"], r["sums"])
        heaps.rescan()
        if not last:
            return heaps.rows(rows["block"][0].as_py())
        cluster, distance = heaps.assigned()
        return pa.table([ids, cluster.astype(np.int32), distance], schema=_FOUND)

    return run


class _Bucketed:
    """Tables bucketed by block in the checkpoint folder; their names go from the catalog at the end, as does nothing else."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, df: DataFrame, name: str, dealt: bool = False) -> DataFrame:
        table = f"terranet_{name}_{uuid.uuid4().hex[:12]}"
        rows = df if dealt else df.repartition(self.buckets, "block")
        rows.write.format("parquet").bucketBy(self.buckets, "block").option("path", scratch_path(self.spark, name)).saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def forget(self) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def _drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much a gap of every cluster may have shrunk: its own move and the farthest move of another, rounded up."""
    own = np.array([float(sum((int(a) - int(b)) ** 2 for a, b in zip(x, y))) ** 0.5 for x, y in zip(old, new)]) * (1 + _SLACK)
    others = np.array([max([0.0, *np.delete(own, k)]) for k in range(len(own))])
    return (own + others) * (1 + _SLACK)


def clustered(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scans: list[int] | None = None) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of ``rows`` (id, integer vector), and the centroids.

    The first centroids are the vectors with the smallest sha256 of ``seed:id``.  ``scans``
    receives the number of vectors measured in each round after the first.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), "vector").dropna()
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = rows.orderBy(order, "row").limit(clusters).select("vector").collect()
    empty = spark.createDataFrame([], "id long, cluster int, distance long")
    if not start:
        return empty, np.zeros((0, 0), np.int64)
    centroids = np.array([r["vector"] for r in start], np.int64)
    blocks = -(-rows.count() // BLOCK)
    tables = _Bucketed(spark, min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 16)), _BUCKETS))
    try:
        vectors = tables.write(rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))), "blocks")
        state, drift = None, np.zeros(len(centroids))
        for k in range(rounds):
            if state is None:
                new = vectors.groupBy("block").applyInArrow(_first(centroids), _HEAPS_DDL)
            else:
                new = vectors.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(_next(centroids, drift, False), _HEAPS_DDL)
            state = tables.write(new, "heaps", dealt=True)
            moved = _means(state, centroids)
            if scans is not None:
                scans.append(state.agg(F.sum("rescanned")).first()[0])
            drift = drift + _drifts(centroids, moved)
            centroids = moved
        if state is None:
            state = tables.write(vectors.groupBy("block").applyInArrow(_first(centroids), _HEAPS_DDL), "heaps", dealt=True)
        found = vectors.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(_next(centroids, drift, True), "id long, cluster int, distance long")
        return cut(found, "clustered"), centroids
    finally:
        tables.forget()


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of every cluster; an empty one keeps its centroid."""
    counts = dict(state.groupBy("cluster").agg(F.sum("n")).collect())
    parts = state.select("cluster", F.posexplode("sums").alias("axis", "x")).groupBy("cluster", "axis").agg(F.sum(F.col("x").cast("decimal(38,0)")))
    out = centroids.copy()
    for cluster, axis, total in parts.collect():
        if counts[cluster]:
            out[cluster, axis] = int(total) // counts[cluster]
    return out


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "vector")
    found, centroids = clustered(rows.filter(F.size("vector") == DIMENSIONS))
    sums = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # a row for each cluster
    fits = lambda n: int(n) if n < 1 << 63 else None
    whole = fits(sum(sums.values()))
    rows = [(k, fits(sums.get(k, 0)), whole, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(per_cluster, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(k: int) -> str:
    """SQL of round ``k``: nearest centroid of every vector, then the new centroids."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT r.row, arg_min(c.cluster, (list_sum(list_transform(list_zip(r.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cluster)) AS cluster
  FROM rows r CROSS JOIN c{k} c GROUP BY r.row),
s{k} AS (
  SELECT cluster, axis, sum(x) AS total, count(*) AS n
  FROM (SELECT a.cluster, unnest(r.v) AS x, generate_subscripts(r.v, 1) AS axis FROM a{k} a JOIN rows r ON r.row = a.row) GROUP BY cluster, axis),
m{k} AS (
  SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY axis) AS v FROM s{k} GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.cluster = c.cluster)"""


OP12_SQL = f"""
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster, v
  FROM rows QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) <= {CLUSTERS}),
{",".join(_round_sql(k) for k in range(ROUNDS))},
last AS (
  SELECT r.vec_id, min((list_sum(list_transform(list_zip(r.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cluster)) AS best
  FROM rows r CROSS JOIN c{ROUNDS} c GROUP BY r.row, r.vec_id)
SELECT l.vec_id, CAST(l.best[2] AS INTEGER) AS cluster, CAST(l.best[1] AS BIGINT) AS distance,
       CAST(sum(l.best[1]) OVER (PARTITION BY l.best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(l.best[1]) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM last l JOIN c{ROUNDS} c ON c.cluster = l.best[2]
"""
