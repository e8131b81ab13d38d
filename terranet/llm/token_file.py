"""Token ids in directly addressable codes.

An id is cut into chunks, lowest bits first.  Level 0 holds the first chunk of
every id; a bitmap per level tells which ids go on, and a rank directory counts
the set bits before every 512th, so that the place of an id in the next level,
and with it any single id, is found without decoding a block.  The widths of the
levels, 4 or 8 bits, are those that store the segment's ids in the fewest bits.

A file set is a Parquet table with one row per segment of whole documents: ids of
the documents, their numbers of ids, and the levels.  ``part`` and ``first``
(ids before the segment in its part) order the segments.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from terranet.llm import words
from terranet.llm.tables import read
from terranet.plans.scratch import scratch_path

RANK_STEP = 512
SEGMENT_IDS = 1 << 18
MEMO_BITS = 22  # 4 million slots for cached white-space-and-word units per worker; only speed depends on it
END_ID = 0


@dataclass
class Level:
    width: int
    chunks: bytes  # ``width`` bits for each id that reaches this level
    more: bytes    # one bit each: the id goes on in the next level; empty on the last
    ranks: bytes   # uint32: set bits before every RANK_STEP-th


def _packed(values: np.ndarray, width: int) -> bytes:
    if width == 4:
        half = np.append(values, values[:len(values) % 2] * 0).astype(np.uint8)
        return (half[::2] | half[1::2] << np.uint8(4)).tobytes()
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    out = [np.packbits(((values[i:i + 65536, None] >> np.arange(width, dtype=values.dtype)) & values.dtype.type(1)).astype(np.uint8), bitorder="little")
           for i in range(0, len(values), 65536)]  # 65,536 values of any width end on a byte
    return b"".join(x.tobytes() for x in out)


def _unpacked(raw: bytes, width: int, n: int) -> np.ndarray:
    if width == 4:
        data = np.frombuffer(raw, np.uint8)
        both = np.empty(2 * len(data), np.uint32)
        both[::2], both[1::2] = data & 15, data >> 4
        return both[:n]
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", n).astype(np.uint32)
    out = np.empty(n, np.uint32)
    data = np.frombuffer(raw, np.uint8)
    weights = np.uint32(1) << np.arange(width, dtype=np.uint32)
    for i in range(0, n, 65536):
        m = min(65536, n - i)
        bits = np.unpackbits(data[i * width // 8:(i + m) * width // 8 + 1], count=m * width, bitorder="little").reshape(m, width)
        out[i:i + m] = (bits * weights).sum(axis=1, dtype=np.uint32)
    return out


def best_widths(ids: np.ndarray, choices: tuple[int, ...] = (4, 8)) -> list[int]:
    """Level widths with the fewest bits in all, bitmaps included, from the histogram of id lengths."""
    lengths = np.bincount(np.maximum(1, np.frexp(ids.astype(np.float32))[1]), minlength=2)
    top = len(lengths) - 1
    reach = np.append(np.cumsum(lengths[::-1])[::-1], 0)  # reach[b]: ids of b bits or more
    cost: list[tuple[int, list[int]]] = [(0, [])] * (top + 1)  # cost[b]: bits above b, for ids longer than b
    for b in range(top - 1, -1, -1):
        n = int(reach[b + 1])
        cost[b] = min((n * (w + (b + w < top)) + cost[min(b + w, top)][0], [w, *cost[min(b + w, top)][1]]) for w in choices)
    return cost[0][1] or [choices[0]]


def encode(ids: np.ndarray, widths: list[int] | None = None) -> list[Level]:
    left = ids.astype(np.uint32)
    levels = []
    for k, width in enumerate(widths := widths or best_widths(ids)):
        last = k == len(widths) - 1
        chunk, rest = left & np.uint32((1 << width) - 1), left >> np.uint32(width) if width < 32 else left * 0
        more = rest > 0
        bits = b"" if last else np.packbits(more, bitorder="little").tobytes()
        ranks = b"" if last else (np.cumsum(more)[RANK_STEP - 1::RANK_STEP].astype("<u4").tobytes())
        levels.append(Level(width, _packed(chunk, width), bits, ranks))
        left = rest[more]
    return levels


def decode(levels: list[Level], n: int) -> np.ndarray:
    """All ids of a segment."""
    out = np.zeros(n, np.uint32)
    at, shift = np.arange(n), 0
    for level in levels:
        out[at] |= _unpacked(level.chunks, level.width, len(at)) << np.uint32(shift)
        if not level.more:
            break
        at = at[np.unpackbits(np.frombuffer(level.more, np.uint8), count=len(at), bitorder="little").astype(bool)]
        shift += level.width
    return out


def access(levels: list[Level], i: int) -> int:
    """The id at place ``i``, from one chunk, one bit and one rank per level."""
    value, shift = 0, 0
    for level in levels:
        first, end = i * level.width, (i + 1) * level.width
        word = int.from_bytes(level.chunks[first // 8:(end + 7) // 8], "little")
        value |= (word >> first % 8 & (1 << level.width) - 1) << shift
        if not level.more or not level.more[i // 8] >> i % 8 & 1:
            return value
        block = i // RANK_STEP
        before = int.from_bytes(level.ranks[4 * block - 4:4 * block], "little") if block else 0
        start = block * RANK_STEP // 8
        tail = int.from_bytes(level.more[start:i // 8 + 1], "little") & (1 << i % RANK_STEP) - 1
        i = before + tail.bit_count()
        shift += level.width
    return value


class Encoder:
    """Byte-level BPE of whole texts, with a memo of units (white space and the word behind it).

    A pre-token never reaches from a word into the white space behind it, so the
    ids of a text are the ids of its units, and units can be encoded in bulk: the
    byte lengths of the ids tell the units apart.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # one character stands for one byte
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(1 << MEMO_BITS, np.uint64)  # 0: free slot
        self.begin = np.zeros(1 << MEMO_BITS, np.uint32)
        self.count = np.zeros(1 << MEMO_BITS, np.uint32)
        self.filled, self.used = 0, 0
        self.pool = np.zeros(1 << 20, np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of every hash: its own, or the free one where it belongs."""
        mask = np.uint64((1 << MEMO_BITS) - 1)
        slot = (hashes & mask).astype(np.int64)
        seen = self.keys[slot]
        todo = np.flatnonzero((seen != hashes) & (seen != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(mask)
            seen = self.keys[slot[todo]]
            todo = todo[(seen != hashes[todo]) & (seen != 0)]
        return slot

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, units: list[str]) -> None:
        """Ids of new units, into the memo."""
        odd = [k for k, u in enumerate(units) if u[-1].isspace() or u[0].isspace() and u[0] not in " \t\n\r\v\f"]
        alone = dict(zip(odd, self._ids([units[k] for k in odd])))
        regular = [k for k in range(len(units)) if k not in alone]
        for i in range(0, len(regular), 4096):
            some = regular[i:i + 4096]
            bare = np.array([not units[k][0].isspace() for k in some])
            joined = ["\n" + units[k] if b else units[k] for k, b in zip(some, bare)]
            ids = np.array(self._ids(["".join(joined)])[0], np.uint32)
            last = np.cumsum([len(u.encode()) for u in joined])
            cut = np.searchsorted(np.cumsum(self.bytes_of[ids]), last) + 1
            begin = np.append(0, cut[:-1]) + bare
            drop = np.zeros(len(ids), bool)
            drop[(begin - 1)[bare]] = True
            self._store(hashes[some], ids[~drop], cut - begin)
        for k, ids in alone.items():
            self._store(hashes[[k]], np.array(ids, np.uint32), np.array([len(ids)]))

    def _store(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        begin = self.used + np.cumsum(counts) - counts
        left = np.arange(len(hashes))
        while len(left):  # of several hashes that want one free slot the last gets it
            slot = self._slots(hashes[left])
            self.keys[slot] = hashes[left]
            got = self.keys[slot] == hashes[left]
            self.begin[slot[got]], self.count[slot[got]] = begin[left[got]], counts[left[got]]
            left = left[~got]
        self.used += len(ids)
        self.filled += len(hashes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the texts' offsets in them."""
        data, offsets = words.buffers(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        for i in range(0, len(data), 4 << 20):  # three bytes of overlap: a character and the byte behind it
            part = data[max(0, i - 3):i + (4 << 20)]
            found = _unit_starts(part)
            cut[i:max(0, i - 3) + len(part)] = found[i - max(0, i - 3):]
        cut[offsets] = True
        at = np.flatnonzero(cut)
        start, stop = at[:-1], at[1:]
        counts, ids = [], []
        for i in range(0, len(start), 1 << 20):
            n, x = self._encode_units(data, start[i:i + (1 << 20)], stop[i:i + (1 << 20)])
            counts.append(n)
            ids.append(x)
        return np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(counts)))[np.searchsorted(start, offsets)]

    def _encode_units(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = words.run_hashes(data, start, stop) | np.uint64(1)  # never 0
        if self.filled > len(self.keys) // 2:
            self._forget()
        slot = self._slots(hashes)
        unknown = np.flatnonzero(self.keys[slot] != hashes)
        if len(unknown):
            distinct, where = np.unique(hashes[unknown], return_index=True)
            where = unknown[where]
            units = [data[x:y].tobytes().decode() for x, y in zip(start[where].tolist(), stop[where].tolist())]
            self._learn(distinct, units)
            slot[unknown] = self._slots(hashes[unknown])
        begin, count = self.begin[slot].astype(np.int64), self.count[slot].astype(np.int64)
        total = np.cumsum(count)
        return count, self.pool[np.arange(total[-1]) + np.repeat(begin - (total - count), count)].astype(np.uint32)


def _unit_starts(data: np.ndarray) -> np.ndarray:
    """Where ASCII white space follows a character that is surely none: there a pre-token ends."""
    white = words.WHITE[data]
    doubt = white | (data >= 0x1C) & (data <= 0x1F)
    # characters outside ASCII that are white space start with C2, or with E1 to E3 and have three bytes
    high = data >= 0x80
    doubt[1:] |= high[1:] & (data[:-1] == 0xC2)
    doubt[2:] |= high[2:] & (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
    starts = np.zeros(len(data), bool)
    starts[1:] = white[1:] & ~doubt[:-1]
    return starts


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(file: str) -> Encoder:
    """Encoder of a tokenizer file's content, kept while the Python worker lives, with all that it has learnt.

    Tasks must call this by its module: what a nested function refers to directly is copied into every task.
    """
    if file not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


SEGMENTS = ("part int, first long, n_ids long, doc_ids array<long>, counts array<long>, widths array<int>, "
            "chunks array<binary>, more array<binary>, ranks array<binary>")


def _segment(part: int, first: int, docs: list[int | None], counts: list[int], ids: np.ndarray) -> pa.RecordBatch:
    levels = encode(ids)
    return pa.RecordBatch.from_arrays([
        pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
        pa.array([docs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
        pa.array([[x.width for x in levels]], pa.list_(pa.int32())), pa.array([[x.chunks for x in levels]], pa.list_(pa.binary())),
        pa.array([[x.more for x in levels]], pa.list_(pa.binary())), pa.array([[x.ranks for x in levels]], pa.list_(pa.binary()))],
        ["part", "first", "n_ids", "doc_ids", "counts", "widths", "chunks", "more", "ranks"])


def _write(file, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, first = encoder_of(file.value), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for i, j in words.slices(batch.column(1)):
                ids, ends = encoder.encode(batch.column(1).slice(i, j - i))
                n = np.diff(ends)
                ids = np.insert(ids, ends[1:], end_id)
                docs += batch.column(0).slice(i, j - i).to_pylist()
                counts += (n + 1).tolist()
                held.append(ids)
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield _segment(part, first, docs, counts, np.concatenate(held))
                    first, docs, counts, held, size = first + size, [], [], [], 0
        if docs:
            yield _segment(part, first, docs, counts, np.concatenate(held))

    return run


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, by_id: bool = True) -> None:
    """Encode ``text`` and write the file set to ``path``, in ascending doc_id order.

    Without ``by_id`` documents stay in the partitions and the order they come in, as
    those of a shuffled mix should, and are not moved.

    Nulls count as empty texts and as the smallest ids; equal ids are ordered by
    text.  ``tokenizer`` is a file of the tokenizers library; every document ends
    with ``end_id``.  Other columns are ignored.
    """
    with open(tokenizer) as f:
        file = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if by_id:
        rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows.mapInArrow(words.lean(_write(file, end_id)), SEGMENTS).write.parquet(path)


def _levels(row: dict) -> list[Level]:
    return [Level(*x) for x in zip(row["widths"], row["chunks"], row["more"], row["ranks"])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            row = batch.slice(k, 1).to_pylist()[0]
            ids = decode(_levels(row), row["n_ids"]).astype("<u4")
            ends = np.append(0, np.cumsum(row["counts"])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["part"]] * len(row["counts"]), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                pa.array(row["first"] + ends[:-1]), pa.array(row["counts"], pa.int64()),
                pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64())],
                ["part", "doc_id", "first", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a file set: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per written part
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = segments.mapInArrow(words.lean(_read), "part int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return rows.join(before, "part").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The ids at given places (``place`` long, ids of all documents counted from 0), each read on its own."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    heads = segments.select("part", "first", "n_ids").join(before, "part").select(
        "part", "first", (F.col("before") + F.col("first")).alias("low"), "n_ids")
    step = F.lit(SEGMENT_IDS)
    spread = heads.withColumn("cell", F.explode(F.sequence((F.col("low") / step).cast("long"), ((F.col("low") + F.col("n_ids") - 1) / step).cast("long"))))
    found = places.select("place", (F.col("place") / step).cast("long").alias("cell")).join(spread, "cell").filter(
        "place >= low and place < low + n_ids").select("place", "part", "first", (F.col("place") - F.col("low")).alias("at"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                yield pa.RecordBatch.from_arrays([pa.array([row["place"]]), pa.array([access(_levels(row), row["at"])])], ["place", "token"])

    return found.join(segments, ["part", "first"]).select("place", "at", "widths", "chunks", "more", "ranks").mapInArrow(
        pick, "place long, token long")


def encoded_documents(documents: DataFrame, tokenizer: str | None = None, path: str | None = None, by_id: bool = True) -> DataFrame:
    """Write the token file set of ``documents`` and read it back, one row per document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = path or scratch_path(documents.sparkSession, "tokens")
    write_tokens(documents, path, tokenizer, by_id=by_id)
    return read_documents(documents.sparkSession, path)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(read(spark, sf_dir, "documents"))
