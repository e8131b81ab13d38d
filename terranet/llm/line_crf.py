"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a document is good or bad.  A line is seen through its own
features and those of the lines before and behind it (characters, words,
repetitions, none of them the label, language or source); neighbouring labels have
weights too.  Forward-backward gives each line's probability of being good, and the
mean of these, weighted by length, gives the document's score after a logistic
calibration.

Training takes a bounded sample of labelled documents (SAMPLE), whose lines have the
document's label; one in four of them is kept for the calibration.  Texts without a
line get the share of good documents in the sample.  Null texts count as empty.
Without labels of both kinds every score is that share, 0.5 if there are none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from terranet.llm import labelled, words
from terranet.llm.tables import read

SAMPLE = 3000
FOLDS, FOLD = 5, 0
CUT = 0.3
ROUNDS, RATE, L2 = 80, 0.1, 1e-4
_LINE_GAP = np.zeros(256, bool)
_LINE_GAP[10] = True


def _class(*parts) -> np.ndarray:
    out = np.zeros(256, bool)
    for p in parts:
        out[p if isinstance(p, int) else list(p)] = True
    return out


_UPPER, _LOWER, _DIGIT = _class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58))
_SYMBOL = _class(b"*&%#$@^~=<>\\/_+{}[]")
_CLASSES = [_DIGIT, _SYMBOL, _class(b"!?"), _class(b"|\t"), _class(b",;:"), _class(b"."), words.WHITE, _class(b"\"'()-"), _class(range(0, 9), range(14, 32), 127)]


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line that is not empty, bytes of each, and the texts' offsets in the lines."""
    start, stop = words.spans(data, offsets, _LINE_GAP)
    ends = np.searchsorted(start, offsets)
    size = (stop - start).astype(np.float64)

    def counted(flag: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flag, dtype=np.int64))
        return (total[stop] - total[start]).astype(np.float64)

    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3  # Latin-1 letters in two bytes: capitals, then small letters
    upper = counted(_UPPER[data] | after_c3 & (data <= 0x9E))
    lower = counted(_LOWER[data] | after_c3 & (data > 0x9E))
    shares = [counted(c[data]) / np.maximum(size, 1) for c in _CLASSES]
    word_start, word_stop = words.spans(data, offsets)
    hashes = words.run_hashes(data, word_start, word_stop)
    line = np.searchsorted(start, word_start, "right") - 1
    n = np.bincount(line, minlength=len(start)).astype(np.float64)
    many = np.maximum(n, 1)
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1]))[:len(hashes)]
    _, first = np.unique(hashes ^ words.mixed(line.astype(np.uint64)), return_index=True)
    distinct = np.bincount(line[first], minlength=len(start))
    tail = data[np.minimum(word_stop - 1, max(len(data) - 1, 0))]
    odd_end = np.bincount(line, weights=(_SYMBOL | _class(b"!"))[tail], minlength=len(start))
    # lines, words and runs of three words that the document has more than once
    doc = np.searchsorted(offsets, start, "right") - 1
    line_hash = words.run_hashes(data, start, stop) ^ words.mixed(doc.astype(np.uint64))
    _, which, times = np.unique(line_hash, return_inverse=True, return_counts=True)
    triples, triple_ends = words.shingle_hashes(hashes, np.searchsorted(word_start, offsets), 3)
    owner = np.searchsorted(triple_ends, np.arange(len(triples)), "right") - 1
    _, at, seen = np.unique(triples ^ words.mixed(owner.astype(np.uint64)), return_inverse=True, return_counts=True)
    place = np.arange(len(triples)) - triple_ends[owner] + np.searchsorted(word_start, offsets)[owner]
    twice = np.bincount(line[place], weights=seen[at] > 1, minlength=len(start)) if len(triples) else np.zeros(len(start))
    last = data[np.maximum(stop - 1, 0)] if len(start) else np.zeros(0, np.uint8)
    features = np.column_stack([
        np.log1p(size), np.log1p(n), upper / np.maximum(upper + lower, 1), (upper + lower) / np.maximum(size, 1), *shares,
        size / many / 10, np.bincount(line, weights=same, minlength=len(start)) / many, distinct / many, odd_end / many,
        (times[which] > 1) * 1.0, twice / many, _class(b".!?\"'")[last] * 1.0])
    return features, size, ends


def with_neighbours(features: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before and of the line behind; at the borders zeros and a mark."""
    n = len(features)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[ends[:-1][np.diff(ends) > 0]] = True
    last[ends[1:][np.diff(ends) > 0] - 1] = True
    before, behind = np.roll(features, 1, axis=0), np.roll(features, -1, axis=0)
    before[first], behind[last] = 0, 0
    return np.column_stack([features, before, behind, first, last])


def forward_backward(unary: np.ndarray, links: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of all lines, expected label pairs, log-likelihood's log Z.  ``unary`` and ``links`` are scores."""
    n = np.diff(ends)
    order = np.argsort(-n, kind="stable")
    sorted_n = n[order]
    top = unary.max(axis=1, keepdims=True)
    psi, pair = np.exp(unary - top), np.exp(links)
    alpha, beta, scale = np.empty_like(psi), np.ones_like(psi), np.empty(len(psi))
    steps = int(sorted_n[0]) if len(n) else 0
    active = [order[:np.searchsorted(-sorted_n, -t, "left")] for t in range(steps)]
    for t in range(steps):
        at = ends[active[t]] + t
        a = psi[at] if t == 0 else (alpha[at - 1] @ pair) * psi[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at][:, None]
    for t in range(steps - 2, -1, -1):
        at = ends[active[t + 1]] + t
        beta[at] = (psi[at + 1] * beta[at + 1]) @ pair.T / scale[at + 1][:, None]
    inner = np.ones(len(psi), bool)
    inner[ends[:-1][n > 0]] = False
    at = np.flatnonzero(inner)
    pairs = pair * (alpha[at - 1].T @ (psi[at] * beta[at] / scale[at][:, None]))
    return alpha * beta, pairs, float(np.log(scale).sum() + top.sum())


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray   # feature and constant, to the score of "good"
    links: np.ndarray
    calibration: np.ndarray
    share: float          # of good documents in the sample

    def document_means(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Length-weighted probability that a document's text is good; NaN without a line."""
        features, size, ends = line_features(data, offsets)
        x = (with_neighbours(features, ends) - self.mean) / self.spread
        good, _, _ = forward_backward(_unary(x, self.weights), self.links, ends)
        total = np.append(0, np.cumsum(good[:, 1] * size))
        weight = np.append(0, np.cumsum(size))
        with np.errstate(invalid="ignore"):
            return (total[ends[1:]] - total[ends[:-1]]) / (weight[ends[1:]] - weight[ends[:-1]])

    def scores(self, texts) -> np.ndarray:
        means = self.document_means(*words.buffers(texts))
        out = labelled.probability(_logit(means)[:, None], self.calibration)
        return np.where(np.isnan(means), self.share, out)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _unary(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.column_stack([np.zeros(len(x)), x @ weights[:-1] + weights[-1]])


def train(sample: pd.DataFrame, rounds: int = ROUNDS) -> Model | float:
    """Model of a sample (text, label); only the share of good documents if there is one kind."""
    y = sample["label"].to_numpy()
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2 or len(y) < 8:
        return share
    fit = np.arange(len(y)) % 4 != 3
    data, offsets = words.buffers(sample["text"][fit].tolist())
    features, _, ends = line_features(data, offsets)
    x = with_neighbours(features, ends)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / spread
    label = np.repeat(y[fit], np.diff(ends))
    inner = np.ones(len(x), bool)
    inner[ends[:-1][np.diff(ends) > 0]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
    # every document counts alike, however many lines it has
    theta, m, v = np.zeros(x.shape[1] + 5), np.zeros(x.shape[1] + 5), np.zeros(x.shape[1] + 5)
    for k in range(1, rounds + 1):
        weights, links = theta[:-4], theta[-4:].reshape(2, 2)
        good, pairs, _ = forward_backward(_unary(x, weights), links, ends)
        wrong = label - good[:, 1]
        slope = np.concatenate([x.T @ wrong, [wrong.sum()], (seen - pairs).ravel()]) / len(x) - L2 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope ** 2
        theta = theta + RATE * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    model = Model(mean, spread, theta[:-4], theta[-4:].reshape(2, 2), np.array([1.0, 0.0]), share)
    means = model.document_means(*words.buffers(sample["text"][~fit].tolist()))
    known = ~np.isnan(means)
    if len(set(y[~fit][known].tolist())) == 2:
        model.calibration = labelled.logistic(_logit(means[known])[:, None], y[~fit][known], 1e-1)
    return model


def _score(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j in words.slices(batch.column(0)):
                part = batch.slice(i, j - i)
                score = np.full(len(part), model) if isinstance(model, float) else model.scores(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(score)], [*batch.schema.names[1:], "score"])

    return run


def scored(documents: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score (0 to 1) of every row, in one pass."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(words.lean(_score(shared)), "doc_id long, score double")


def good_documents(documents: DataFrame, model: Model | float, cut: float = CUT) -> DataFrame:
    """The documents with a score of ``cut`` or more, all columns, in one pass."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = [f"c{k}" for k in range(len(documents.columns))]
    rows = documents.toDF(*names)
    whole = rows.select(F.coalesce(names[documents.columns.index("text")], F.lit("")).alias("text"), *names)
    kept = whole.mapInArrow(words.lean(_score(shared)), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])).filter(F.col("score") >= cut)
    return kept.select(*names).toDF(*documents.columns)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(labelled.sample(documents, labels, "quality", FOLDS, FOLD, SAMPLE))
    return scored(documents, model).select(
        "doc_id", labelled.held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
