"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes.  A node knows where the match goes on when no
child fits (its failure link: the rest of its string after greedy pieces were cut
off) and how many pieces that cuts off, so that counting the greedy longest-match
pieces of a word takes a number of steps linear in its length and never builds a
piece.  Distinct words of a batch run through the automaton together, one byte at a
time.

Words are separated by ASCII white space and start with a marker (a space in the
byte-level vocabularies), as pieces at the start of a word do.  A word with a byte
that no piece can match counts as one unknown piece.  Null and empty texts have no
words and no pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from terranet.llm import words
from terranet.llm.tables import read

MARKER = b" "


@dataclass
class Automaton:
    keys: np.ndarray   # sorted (node << 8 | byte)
    child: np.ndarray
    fail: np.ndarray   # -1: no way on
    popped: np.ndarray
    start: int         # node of the marker
    root: np.ndarray   # child of the root by byte, -1: none

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child of every node by its byte, -1: none."""
        key = node.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = np.where(self.keys[at] == key, self.child[at], -1)
        return np.where(node == 0, self.root[byte], found)

    def counts(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Pieces of every marked word ``data[start:stop]``."""
        n = len(start)
        count, node = np.zeros(n, np.int64), np.full(n, self.start, np.int64)
        order = np.argsort(start - stop, kind="stable")  # long words first: those still running are a prefix
        lengths = (stop - start)[order]
        unknown = np.zeros(n, bool)
        for i in range(int(lengths[0]) if n else 0):
            run = order[:np.searchsorted(-lengths, -i, "left")]
            run = run[~unknown[run]]
            byte = data[start[run] + i].astype(np.int64)
            while len(run):
                to = self.step(node[run], byte)
                stuck = to < 0
                node[run[~stuck]] = to[~stuck]
                run, byte = run[stuck], byte[stuck]
                self._fall(run, node, count, unknown)
                go = ~unknown[run]
                run, byte = run[go], byte[go]
        run = np.flatnonzero((node != 0) & ~unknown)
        while len(run):
            self._fall(run, node, count, unknown)
            run = run[(node[run] != 0) & ~unknown[run]]
        count[unknown] = 1
        return count

    def _fall(self, run: np.ndarray, node: np.ndarray, count: np.ndarray, unknown: np.ndarray) -> None:
        to = self.fail[node[run]]
        unknown[run[to < 0]] = True
        count[run] += self.popped[node[run]]
        node[run] = np.maximum(to, 0)


def automaton(vocabulary: list[bytes], marker: bytes = MARKER) -> Automaton:
    """Trie of the pieces with failure links and popped counts, in one breadth-first pass."""
    children: list[dict[int, int]] = [{}]
    whole = [False]
    for piece in {*vocabulary} - {b""}:
        node = 0
        for byte in piece:
            to = children[node].get(byte)
            if to is None:
                to = children[node][byte] = len(children)
                children.append({})
                whole.append(False)
            node = to
        whole[node] = True
    if marker and (len(marker) != 1 or marker[0] not in children[0]):
        raise ValueError("the vocabulary has no piece that starts with the marker")
    fail, popped = [-1] * len(children), [0] * len(children)
    level = [0]
    while level:
        below = []
        for node in level:
            for byte, to in children[node].items():
                below.append(to)
                if whole[to]:
                    fail[to], popped[to] = 0, 1
                    continue
                at, n = fail[node], popped[node]
                while at >= 0 and byte not in children[at]:
                    n += popped[at]
                    at = fail[at]
                if at >= 0:
                    fail[to], popped[to] = children[at][byte], n
        level = below
    edges = sorted((node << 8 | byte, to) for node, own in enumerate(children) for byte, to in own.items())
    root = np.full(256, -1, np.int64)
    root[list(children[0])] = list(children[0].values())
    return Automaton(np.array([k for k, _ in edges], np.int64), np.array([v for _, v in edges], np.int64), np.array(fail),
                     np.array(popped), children[0][marker[0]] if marker else 0, root)


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a file of base64 strings and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def _count(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Automaton = shared.value
        for batch in batches:
            for i, j in words.slices(batch.column(1)):
                data, offsets = words.buffers(batch.column(1).slice(i, j - i))
                start, stop = words.spans(data, offsets)
                _, first, which = np.unique(words.run_hashes(data, start, stop), return_index=True, return_inverse=True)
                total = np.append(0, np.cumsum(machine.counts(data, start[first], stop[first])[which]))
                ends = np.searchsorted(start, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(ends).astype(np.int64)),
                                                  pa.array(np.diff(total[ends]).astype(np.int64))], ["doc_id", "n_words", "n_pieces"])

    return run


def piece_counts(documents: DataFrame, vocabulary: list[bytes], marker: bytes = MARKER) -> DataFrame:
    """doc_id, n_words, n_pieces of every row, in one pass.  The vocabulary's size does not grow with the documents."""
    shared = documents.sparkSession.sparkContext.broadcast(automaton(vocabulary, marker))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_count(shared), "doc_id long, n_words long, n_pieces long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_counts(read(spark, sf_dir, "documents"), read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
