"""Removing lines that recur in many documents, by a sharded minimal perfect hash.

A line's key is the line without ASCII white space at both ends, in ASCII lower case,
named by a 128-bit hash.  One aggregation counts the documents of every long key and
notes the largest doc_id.  Keys of enough documents go, shard by shard, into an index:
cascading bit arrays give every key a number of its own from 0 to n - 1 (a key takes
the first level where it meets no other; its number is the rank of its bit), and arrays
at these numbers hold a 64-bit fingerprint, the count and the largest doc_id.  A line
that is not indexed lands on a number whose fingerprint differs.

Documents probe the arrays.  The shards of the most frequent keys go to every task:
keys of more than a 2^20th of all indexed occurrences, so 2^20 entries at most whatever
the input.  Occurrences of other keys, none of which is frequent enough to fill a task,
are sent to the shard of their key and probe it there; only hits go back to their
documents.

Defined cases.  A null or empty text is one empty line.  Every row is a document: rows
that repeat a doc_id are counted one by one, and all rows of the largest doc_id keep the
line.  A null doc_id is smaller than any other.  Columns other than doc_id and text pass
through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from terranet.llm.tables import read
from terranet.llm.words import lean, mixed, slices
from terranet.plans.scratch import cut, is_empty

LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
EVERYWHERE = 1 << 20  # entries of the index that every task holds, at most
SHARD = 1 << 15  # keys of a shard, about
_WHITE = " \t\n\v\f\r"
_LEVEL = 0x9E3779B97F4A7C15


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: bit arrays of falling size, one level each."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bits of a level, as booleans
        counts = [int(x.sum()) for x in levels]
        self.size = sum(counts)
        self._ranks = [before + np.cumsum(bits) - bits for before, bits in zip(np.cumsum([0, *counts]), levels)]

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level + 1) * _LEVEL % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys)
        while len(left):
            at = cls._slots(left, len(levels), 2 * len(left))
            bits = np.bincount(at, minlength=2 * len(left)) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of every key from 0 to ``size`` - 1; -1, or that of another, for keys that were not given."""
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._slots(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self._ranks[level][at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return b"".join(len(x).to_bytes(8, "little") + np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        levels, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at:at + 8], "little")
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at + 8), count=n).astype(bool))
            at += 8 + -(-n // 8)
        return cls(levels)


class Shard:
    """Perfect hash of a shard's keys and the arrays at its numbers."""

    def __init__(self, hashed: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, lasts: np.ndarray, has_last: np.ndarray):
        self.hashed, self.fingerprints, self.counts, self.lasts, self.has_last = hashed, fingerprints, counts, lasts, has_last

    @classmethod
    def of(cls, keys: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray, lasts: pa.Array) -> Shard:
        """Keys that share their 64 bits keep the entries after the first in a shard of their own (``Index`` puts them there)."""
        hashed = PerfectHash.of(keys)
        order = np.argsort(hashed.numbers(keys))
        known = ~np.asarray(lasts.is_null())
        return cls(hashed, fingerprints[order], counts[order], np.asarray(lasts.fill_null(0))[order], known[order])

    def to_row(self) -> list:
        return [self.hashed.to_bytes(), *(x.tobytes() for x in (self.fingerprints, self.counts, self.lasts, self.has_last))]

    @classmethod
    def from_row(cls, hashed: bytes, fingerprints: bytes, counts: bytes, lasts: bytes, has_last: bytes) -> Shard:
        return cls(PerfectHash.from_bytes(hashed), np.frombuffer(fingerprints, np.uint64), np.frombuffer(counts, np.int64),
                   np.frombuffer(lasts, np.int64), np.frombuffer(has_last, bool))

    def probe(self, keys: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
        """Number of every indexed line, -1 for others."""
        at = self.hashed.numbers(keys)
        if not self.hashed.size:
            return at
        return np.where((at >= 0) & (self.fingerprints[at] == fingerprints), at, -1)


_SHARD_DDL = "shard long, hashed binary, fingerprints binary, counts binary, lasts binary, has_last binary"
_SHARD = pa.schema([("shard", pa.int64()), *((name, pa.binary()) for name in ("hashed", "fingerprints", "counts", "lasts", "has_last"))])


def _build(rows: pa.Table) -> pa.Table:
    """Shard of the given keys; of keys with equal first halves (one pair in 2^64) all but one go to a second row."""
    keys = np.asarray(rows["key"]).view(np.uint64)
    out = []
    while len(keys):
        _, first = np.unique(keys, return_index=True)
        taken = rows.take(pa.array(first))
        shard = Shard.of(keys[first], np.asarray(taken["fingerprint"]).view(np.uint64), np.asarray(taken["documents"]),
                         taken["last"].combine_chunks())
        out.append([rows["shard"][0].as_py(), *shard.to_row()])
        rest = np.setdiff1d(np.arange(len(keys)), first)
        keys, rows = keys[rest], rows.take(pa.array(rest))
    return pa.table([list(c) for c in zip(*out)], schema=_SHARD)


def sharded_index(lines: DataFrame, shards: int) -> DataFrame:
    """Rows of the index, one for each shard, from key, fingerprint, documents and last."""
    return lines.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInArrow(_build, _SHARD_DDL)


class Index:
    """Shards that a task holds."""

    def __init__(self, rows: list, shards: int):
        self.shards, self.parts = shards, {}
        for number, *arrays in rows:
            self.parts.setdefault(number, []).append(Shard.from_row(*arrays))

    def probe(self, keys: np.ndarray, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Is every line indexed; the largest doc_id that holds it, and is there one."""
        found, known = np.zeros((2, len(keys)), bool)
        lasts = np.zeros(len(keys), np.int64)
        which = keys.view(np.int64) % self.shards
        for number in np.unique(which):
            here = np.flatnonzero(which == number)
            for part in self.parts.get(int(number), ()):
                at = part.probe(keys[here], fingerprints[here])
                hit = at >= 0
                found[here[hit]] = True
                lasts[here[hit]], known[here[hit]] = part.lasts[at[hit]], part.has_last[at[hit]]
        return found, lasts, known


class Lines:
    """Lines of a column of texts; ``long`` are the positions of those with a key that counts, ``keys`` their 128-bit hashes."""

    def __init__(self, texts: pa.Array, least_chars: int):
        split = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), "\n")
        self.offsets = np.asarray(split.offsets).astype(np.int64)
        self.lines = split.flatten()
        trimmed = pc.ascii_lower(pc.utf8_trim(self.lines, characters=_WHITE))
        self.long = np.flatnonzero(np.asarray(pc.greater_equal(pc.utf8_length(trimmed), least_chars)))
        digest = b"".join(xxhash.xxh3_128_digest(x) for x in trimmed.take(pa.array(self.long)).cast(pa.large_binary()).to_pylist())
        self.keys = np.frombuffer(digest, np.uint64).reshape(-1, 2)
        self.row = np.searchsorted(self.offsets, self.long, "right") - 1

    def distinct(self) -> np.ndarray:
        """Positions in ``keys`` of the first line of each key of each text."""
        fields = (self.keys[:, 1], self.keys[:, 0], self.row)
        order = np.lexsort(fields)
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in fields], 0)
        return order[new]

    def without(self, dropped: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Texts without the lines at the given positions, lines before, lines dropped."""
        keep = np.ones(len(self.lines), bool)
        keep[dropped] = False
        before = np.append(0, np.cumsum(keep))
        kept = pa.LargeListArray.from_arrays(pa.array(before[self.offsets]), self.lines.filter(pa.array(keep)))
        total = np.diff(self.offsets)
        return pc.binary_join(kept, pa.scalar("\n", pa.large_string())), total, total - np.diff(before[self.offsets])


def _count_lines(least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch["text"]):
                lines = Lines(batch["text"].slice(i, j - i), least_chars)
                first = lines.distinct()
                keys = lines.keys[first].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch["doc_id"].slice(i, j - i).take(pa.array(lines.row[first]))],
                                                 ["key", "fingerprint", "doc_id"])

    return run


def recurring_lines(documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """key, fingerprint, documents, last of every line key that enough documents hold."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInArrow(lean(_count_lines(least_chars)), "key long, fingerprint long, doc_id long")
    return found.groupBy("key", "fingerprint").agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("last")).filter(F.col("documents") >= least_documents)


def _others(shared, shards: int, least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines that the shared index does not hold, once per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, shards)
        for batch in batches:
            for i, j in slices(batch["text"]):
                lines = Lines(batch["text"].slice(i, j - i), least_chars)
                first = lines.distinct()
                keys = lines.keys[first]
                other = ~index.probe(np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]))[0]
                keys = keys[other].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch["doc_id"].slice(i, j - i).take(pa.array(lines.row[first][other]))],
                                                 ["key", "fingerprint", "doc_id"])

    return run


_HIT = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fingerprint", pa.int64())])


def _probe_shard(lines: pa.Table, shard: pa.Table) -> pa.Table:
    """Lines of a shard that are to go from their document."""
    if not len(shard) or not len(lines):
        return _HIT.empty_table()
    index = Index([tuple(r[name] for name in _SHARD.names) for r in shard.to_pylist()], 1)
    index.parts = {0: [p for parts in index.parts.values() for p in parts]}
    keys, marks = (np.asarray(lines[c]) for c in ("key", "fingerprint"))
    found, lasts, known = index.probe(keys.view(np.uint64), marks.view(np.uint64))
    ids = lines["doc_id"].combine_chunks()
    last_holder = np.where(np.asarray(ids.is_null()), ~known, known & (np.asarray(ids.fill_null(0)) == lasts))
    return pa.table([ids, pa.array(keys), pa.array(marks)], schema=_HIT).filter(pa.array(found & ~last_holder))


def _drop_lines(shared, shards: int, least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts without indexed lines; ``keys`` and ``marks`` name the lines that probing their shards found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, shards)
        for batch in batches:
            for i, j in slices(batch["text"]):
                part = batch.slice(i, j - i)
                lines = Lines(part["text"], least_chars)
                found, lasts, known = index.probe(*(np.ascontiguousarray(lines.keys[:, k]) for k in (0, 1)))
                ids = part["doc_id"]
                own, has_id = np.asarray(ids.fill_null(0))[lines.row], ~np.asarray(ids.is_null())[lines.row]
                dropped = found & ~np.where(has_id, known & (own == lasts), ~known)
                hits = pc.list_value_length(part["keys"]).fill_null(0)
                if pc.sum(hits).as_py():
                    row = np.repeat(np.arange(len(part)), np.asarray(hits))
                    fields = [row, *(np.asarray(part[c].flatten()).view(np.uint64) for c in ("keys", "marks"))]
                    dropped |= np.isin(np.rec.fromarrays([lines.row, lines.keys[:, 0], lines.keys[:, 1]]), np.rec.fromarrays(fields))
                texts, n, gone = lines.without(lines.long[dropped])
                yield pa.RecordBatch.from_arrays([part["rest"], ids, texts.cast(pa.string()) if texts.nbytes < 1 << 31 else texts, pa.array(n), pa.array(gone)],
                                                 ["rest", "doc_id", "text", "n_lines", "n_dropped"])

    return run


def without_recurring_lines(documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, everywhere: int = EVERYWHERE) -> DataFrame:
    """``documents`` with the recurring lines gone from ``text``, and n_lines, n_dropped.

    A recurring line stays in the documents with the largest doc_id that holds it.
    """
    spark = documents.sparkSession
    rest = [c for c in documents.columns if c not in ("doc_id", "text")]
    docs = documents.select(F.struct(*([F.col(f"`{c}`") for c in rest] or [F.lit(0)])).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce("text", F.lit("")).alias("text"))
    recurring = cut(recurring_lines(documents, least_chars, least_documents), "lines")
    total, entries = recurring.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.count(F.lit(1))).first()
    often = F.col("documents") * everywhere > total
    top = -(-min(entries, everywhere) // SHARD) or 1
    shared = spark.sparkContext.broadcast([tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r))
                                           for r in sharded_index(recurring.filter(often), top).collect()])
    seldom = recurring.filter(~often)
    if is_empty(seldom):
        probed = docs.withColumns({c: F.lit(None).cast("array<long>") for c in ("keys", "marks")})
    else:
        shards = -(-entries // SHARD)
        lines = docs.select("doc_id", "text").mapInArrow(lean(_others(shared, top, least_chars)), "key long, fingerprint long, doc_id long")
        hits = lines.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").cogroup(sharded_index(seldom, shards).groupBy("shard")).applyInArrow(
            _probe_shard, "doc_id long, key long, fingerprint long")
        marked = cut(hits.distinct().groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("key", "fingerprint")).alias("h")), "hits")
        probed = docs.join(marked, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
            "rest", "doc_id", "text", F.col("h.key").alias("keys"), F.col("h.fingerprint").alias("marks"))
    schema = StructType([docs.schema["rest"], *StructType.fromDDL("doc_id long, text string, n_lines long, n_dropped long")])
    out = probed.mapInArrow(lean(_drop_lines(shared, top, least_chars)), schema)
    return out.select("doc_id", "text", *[F.col(f"rest.`{c}`") for c in rest if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_recurring_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs)),
often AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
marked AS (SELECT l.*, o.key IS NOT NULL AND o.last IS DISTINCT FROM l.doc_id AS gone FROM lines l LEFT JOIN often o ON o.key = l.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
