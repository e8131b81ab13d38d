"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, marks, digits and signs of any alphabet, in folded
case; white space, punctuation, control and format characters of all of Unicode are gaps
or (soft hyphens, joiners and the like) nothing, so case, punctuation and spacing do not
matter.  A document and a benchmark item that share a run of five words (the whole
item if it is shorter) are compared: the longest common run of words that are not
yet marked becomes a tile and is marked in both, again and again, down to runs of
five words.  Running Karp-Rabin finds the runs of one length at a time.  A
document is contaminated by an item if the tiles cover enough of the item's
words, in whatever order its parts stand.

Null and empty texts or items match nothing.  Repeated items and documents are
compared one by one.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from terranet.llm import words
from terranet.llm.tables import read
from terranet.plans.scratch import cut

LEAST, COVERAGE = 5, 0.5
BLOCK_WORDS = 1_000_000  # benchmark words compared in one pass over the documents
_FIRST_LENGTH = 20
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@cache
def _kinds() -> np.ndarray:
    """Per code point: 1 for a gap, 2 for a character that counts for nothing, else 0."""
    kind = np.zeros(0x110000 + (1 << 20), np.uint8)  # broken UTF-8 may give any number of 21 bits
    for code in (*range(0x80, 0x20000), *range(0xE0000, 0xE1000)):
        category = unicodedata.category(chr(code))
        kind[code] = 1 if category[0] in "PZ" or category in ("Cc", "Sk") else 2 if category == "Cf" else 0
    kind[[0x200B, 0x2212]] = 1  # zero-width space, minus
    return kind


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in folded case, with blanks for gaps outside ASCII."""
    raw, ends = data.tobytes(), offsets.tolist()
    parts = []
    for a, b in zip(ends, ends[1:]):
        part = raw[a:b]
        parts.append(part.lower() if part.isascii() else part.decode(errors="surrogateescape").casefold().encode(errors="surrogateescape"))
    offsets = np.append(0, np.cumsum([len(x) for x in parts], dtype=np.int64))
    data = np.frombuffer(b"".join(parts), np.uint8).copy()
    first = np.flatnonzero(data >= 0xC0)
    b0, b1, b2, b3 = (np.append(data, np.zeros(3, np.uint8))[first + k].astype(np.int64) & (0xFF if k == 0 else 63) for k in range(4))
    size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
    code = np.select([size == 2, size == 3], [(b0 & 31) << 6 | b1, (b0 & 15) << 12 | b1 << 6 | b2], (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)
    kind = _kinds()[code]
    drop = np.zeros(len(data) + 3, bool)
    for k in range(4):
        own = (size > k) & (kind > 0)
        at, gap = first[own] + k, kind[own] == 1
        data[at[gap & (at < len(data))]] = 0x20
        drop[at[~gap]] = True
    drop = drop[:len(data)]
    if drop.any():
        data, offsets = data[~drop], offsets - np.append(0, np.cumsum(drop))[offsets]
    return data, offsets


def plain_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text in folded case, and the texts' offsets in them."""
    data, offsets = words.buffers(texts)
    data, offsets = (_LOWER[data], offsets) if not len(data) or data.max() < 0x80 else _folded(data, offsets)
    start, stop = words.spans(data, offsets, _GAP)
    return words.run_hashes(data, start, stop), np.searchsorted(start, offsets)


def _equal_runs(text: np.ndarray, item: np.ndarray, free_text: np.ndarray, free_item: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """All longest common runs of unmarked words of ``length`` or more: (length, item place, text place)."""
    def windows(values: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marked = np.append(0, np.cumsum(~free))
        at = np.flatnonzero(marked[length:] == marked[:-length])
        # rolling hash as a difference of prefix sums, scaled back to the window's first place
        up, down = words._powers(len(values) + 1)
        total = np.append(np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64))
        return at, (total[at + length] - total[at]) * down[at]

    if min(len(text), len(item)) < length:
        return []
    t, t_hash = windows(text, free_text)
    p, p_hash = windows(item, free_item)
    order = np.argsort(t_hash, kind="stable")
    t, t_hash = t[order], t_hash[order]
    first, last = np.searchsorted(t_hash, p_hash, "left"), np.searchsorted(t_hash, p_hash, "right")
    n = last - first
    if not n.any():
        return []
    a = np.repeat(p, n)
    b = t[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    order = np.lexsort((a, a - b))
    a, b = a[order], b[order]
    new = np.append(True, (np.diff(a) != 1) | (np.diff(b) != 1))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(a))) + length - 1
    return list(zip(size.tolist(), a[begin].tolist(), b[begin].tolist()))


def tiles(text: np.ndarray, item: np.ndarray, least: int = LEAST, free_text: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiling of word hashes: (item place, text place, length), longest first."""
    free_text = np.ones(len(text), bool) if free_text is None else free_text.copy()
    free_item = np.ones(len(item), bool)
    found: list[tuple[int, int, int]] = []
    length = max(least, min(_FIRST_LENGTH, len(item), len(text)))
    while True:
        runs = _equal_runs(text, item, free_text, free_item, length)
        longest = max(runs, default=(0,))[0]
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-n, p, t) for n, p, t in runs]
        heapq.heapify(queue)
        while queue:
            n, p, t = heapq.heappop(queue)
            free = free_item[p:p - n] & free_text[t:t - n]
            if free.all():
                free_item[p:p - n] = free_text[t:t - n] = False
                found.append((p, t, -n))
                continue
            # a longer tile covers a part: what is left of the run competes again
            edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= length:
                    heapq.heappush(queue, (a - b, p + a, t + a))
        if length <= least:
            return found
        length = max(least, length // 2)


@dataclass
class _Seeds:
    size: int            # words of a seed
    values: np.ndarray   # distinct seed hashes, sorted
    begin: np.ndarray    # of each in ``item`` and ``place``
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray    # bit set of the seeds' low bits, to skip most searches


def _seeds(item_words: np.ndarray, ends: np.ndarray, least: int) -> list[_Seeds]:
    n = np.diff(ends)
    out = []
    for size in range(1, least + 1):
        items = np.flatnonzero(n == size if size < least else n >= least)
        if not len(items):
            continue
        hashes, own, place = [], [], []
        for i in items.tolist():
            h, _ = words.shingle_hashes(item_words[ends[i]:ends[i + 1]], np.array([0, n[i]]), size)
            hashes.append(h)
            own.append(np.full(len(h), i))
            place.append(np.arange(len(h)))
        h, own, place = np.concatenate(hashes), np.concatenate(own), np.concatenate(place)
        order = np.argsort(h, kind="stable")
        values, begin = np.unique(h[order], return_index=True)
        maybe = np.zeros(1 << 22, bool)
        maybe[(values & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        out.append(_Seeds(size, values, np.append(begin, len(h)), own[order], place[order], maybe))
    return out


def _hits(seeds: _Seeds, doc_words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of seeds in documents: document, item, place in the item, word in the batch."""
    hashes, starts = words.shingle_hashes(doc_words, ends, seeds.size)
    at = np.flatnonzero(seeds.maybe[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
    which = np.minimum(np.searchsorted(seeds.values, hashes[at]), len(seeds.values) - 1)
    real = seeds.values[which] == hashes[at]
    at, which = at[real], which[real]
    doc = np.searchsorted(starts, at, "right") - 1
    long = np.diff(ends)[doc] >= seeds.size
    at, which, doc = at[long], which[long], doc[long]
    n = seeds.begin[which + 1] - seeds.begin[which]
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(seeds.begin[which], n)
    return np.repeat(doc, n), seeds.item[k], seeds.place[k], np.repeat(at - starts[doc] + ends[doc], n)


def _compare(block, least: int, coverage: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = block.value
        item_words, item_ends = plain_words(texts)
        lengths = np.diff(item_ends)
        prepared = _seeds(item_words, item_ends, least)
        for batch in batches:
            for i, j in words.slices(batch.column(1)):
                doc_words, ends = plain_words(batch.column(1).slice(i, j - i))
                rows: list[tuple] = []
                for seeds in prepared:
                    doc, item, place, word = _hits(seeds, doc_words, ends)
                    order = np.lexsort((place, item, doc))
                    doc, item, place, word = doc[order], item[order], place[order], word[order]
                    new = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(item) != 0))[:len(doc)])
                    for a, b in zip(new.tolist(), np.append(new[1:], len(doc)).tolist()):
                        size, n = seeds.size, int(lengths[item[a]])
                        # words of the item in any seed: tiles cannot cover more
                        if np.minimum(np.diff(place[a:b]), size).sum() + size < coverage * n:
                            continue
                        # of the text only words in a seed can be in a tile
                        near = np.unique((np.unique(word[a:b])[:, None] + np.arange(size)).ravel())
                        near = near[near < ends[doc[a] + 1]]
                        gaps = np.flatnonzero(np.diff(near) > 1) + 1
                        text = np.insert(doc_words[near], gaps, 0)
                        free = np.insert(np.ones(len(near), bool), gaps, False)
                        found = tiles(text, item_words[item_ends[item[a]]:item_ends[item[a] + 1]], size, free)
                        covered = sum(x for _, _, x in found)
                        if covered >= coverage * n:
                            rows.append((i + int(doc[a]), ids[int(item[a])], covered, n, len(found)))
                if rows:
                    at, item, covered, n, k = zip(*rows)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(at)), pa.array(item, pa.int64()), pa.array(covered, pa.int32()),
                        pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array([c / m for c, m in zip(covered, n)])],
                        ["doc_id", "item_id", "covered_words", "item_words", "tiles", "coverage"])

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a benchmark item it contains: doc_id, item_id, covered_words, item_words, tiles, coverage.

    The benchmark goes to the tasks in blocks of about BLOCK_WORDS words, one pass
    over the documents for each, so that a benchmark of any size is compared whole.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // (6 * BLOCK_WORDS)))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = None
    for k in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        block = spark.sparkContext.broadcast(([x["item_id"] for x in some], [x["text"] for x in some]))
        part = rows.mapInArrow(words.lean(_compare(block, least, coverage)), "doc_id long, item_id long, covered_words int, item_words int, tiles int, coverage double")
        found = part if found is None else found.unionByName(part)
    return found


def clean_documents(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The documents that contain no benchmark item.  A document with a null doc_id goes if any such one is contaminated."""
    bad = cut(contaminated(documents, benchmark, least, coverage).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
