"""Operator 2: document quality from a linear-chain conditional random field on lines.

Every line is good or bad. Training takes the label of a document as that of all its
lines; scoring takes forward-backward marginals of each line, weighted by its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyscape.llm import lean
from keyscape.llm.line_features import NAMES, line_features, with_neighbours
from keyscape.llm.words import STEP, row_slices
from keyscape.session import materialize

TRAIN_DOCS = 3000
TRAIN_CHARS = 200_000
ROUNDS = 150
RATE = 0.1
PENALTY = 1e-3


@dataclass
class Crf:
    """Weights of good against bad by feature, transition scores [from, to], and the
    mean and scale of the features."""

    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def good(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights


def marginals(good: np.ndarray, off: np.ndarray, moves: np.ndarray):
    """(P(line is good), expected moves [from, to] summed over all texts, sum of the
    logarithms of the normalisers).

    Forward-backward with scaling, one step for all texts at a time: state 0 is bad with
    score 0, state 1 good with score ``good``.
    """
    count = np.diff(off)
    lines = len(good)
    peak = np.maximum(good, 0)
    local = np.column_stack((np.exp(-peak), np.exp(good - peak)))
    top = moves.max() if moves.size else 0.0
    step = np.exp(moves - top)
    order = np.argsort(-count, kind="stable")
    starts, count = off[:-1][order], count[order]
    longest = int(count[0]) if len(count) else 0
    alive = np.searchsorted(-count, -np.arange(longest), "left")
    alpha, norm = np.zeros((lines, 2)), np.ones(lines)
    for t in range(longest):
        at = starts[: alive[t]] + t
        here = local[at] if t == 0 else (alpha[at - 1] @ step) * local[at]
        norm[at] = here.sum(axis=1)
        alpha[at] = here / norm[at][:, None]
    beta = np.ones((lines, 2))
    moved = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        ahead = local[at + 1] * beta[at + 1] / norm[at + 1][:, None]
        moved += np.einsum("ni,nj->ij", alpha[at], ahead) * step
        beta[at] = ahead @ step.T
    both = alpha * beta
    return (
        both[:, 1] / both.sum(axis=1), moved,
        float((np.log(norm) + peak).sum() + top * np.maximum(count - 1, 0).sum()))


def fit(features: np.ndarray, off: np.ndarray, labels: np.ndarray) -> Crf:
    """Penalised maximum likelihood by Adam, from zero weights. ``labels`` are those of
    the texts. Without texts all weights are zero."""
    width = 3 * len(NAMES) + 1
    if not len(labels):
        return Crf(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width))
    mean, scale = features.mean(axis=0), features.std(axis=0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    x = (features - mean) / scale
    count = np.diff(off)
    y = np.repeat(labels, count).astype(float)
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (count[labels == k] - 1).sum()
    theta = np.zeros(width + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, ROUNDS + 1):
        p, moved, _ = marginals(x @ theta[:width], off, theta[width:].reshape(2, 2))
        grad = np.concatenate((x.T @ (y - p), (seen - moved).ravel())) / len(y)
        grad -= PENALTY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += RATE * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return Crf(theta[:width], theta[width:].reshape(2, 2), mean, scale)


def _sliced(column: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of ``STEP`` bytes at most, or one longer text: what is read in one
    piece does not depend on the neighbours of a text."""
    for a, b in row_slices(column, STEP):
        yield column.slice(a, b - a)


def train(
    docs: DataFrame,
    labels: DataFrame,
    learns: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = TRAIN_DOCS,
) -> Crf:
    """The field learnt from labelled texts for which ``learns``, an expression of the
    id, is true: the ``sample`` labels of the smallest hash of the id, of texts of
    at most ``TRAIN_CHARS`` characters. These two bounds are those of the driver."""
    chosen = materialize(
        labels.where(learns & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64("i"), "i").limit(sample), "crf-labels")
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(
        F.length("t") <= TRAIN_CHARS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in _sliced(batch.column(0)):
                found, _, off = line_features(part)
                found = found.astype("<f4")
                rows += [found[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.binary()), batch.column(1)], names=["x", "y"])

    # as many rows as the sample has
    got = rows.join(F.broadcast(chosen), "i").select("t", "y").mapInArrow(
        lean.batches(encode), "x binary, y int").collect()
    lines = [np.frombuffer(bytes(r.x), "<f4").reshape(-1, len(NAMES)).astype(float) for r in got]
    off = np.concatenate(([0], np.cumsum([len(x) for x in lines]))).astype(np.int64)
    joined = np.concatenate(lines) if lines else np.zeros((0, len(NAMES)))
    x = with_neighbours(joined, off) if lines else np.zeros((0, 3 * len(NAMES) + 1))
    return fit(x, off, np.array([r.y for r in got], int))


def score(text: Column, model: Crf) -> Column:
    """The chance that a byte of the text stands in a good line, 0 to 1. A null or empty
    text is one empty line, scored as such. Only the text decides."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        lean.forget()
        out = [np.zeros(0)]
        for part in _sliced(texts):
            features, size, off = line_features(part)
            p, _, _ = marginals(model.good(with_neighbours(features, off)), off, model.moves)
            weight = size + 1.0
            out.append(
                np.add.reduceat(p * weight, off[:-1]) / np.add.reduceat(weight, off[:-1]))
        lean.give_back()
        return pa.array(np.clip(np.concatenate(out), 0, 1))

    return run(text.cast("string"))


def good_documents(
    docs: DataFrame, model: Crf, text_col: str = "text", least: float = 0.5
) -> DataFrame:
    """Rows of ``docs``, all columns, with a score of ``least`` or more. Repeated rows
    share their fate; an empty table stays empty."""
    return docs.where(score(docs[text_col], model) >= least)
