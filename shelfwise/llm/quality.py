"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are binned counts of its characters and
words and those of the lines beside it; a transition potential ties neighbouring labels.
Forward and backward passes give each line's probability of being good, and the mean of
these weighted by line length, calibrated, is the document's quality.

Only documents are labelled, so training starts with every line as its document, moves
lines of bad documents that look good to the other side (each keeps its worst line), and
then fits the chain to these line labels by gradient of the exact likelihood.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.tables import labelled_sample
from shelfwise.llm.textscan import Chunk, chunks, words

#: Training rows of each label at most.
ROWS_PER_CLASS = 3000
THRESHOLD = 0.3

_CODES = np.arange(256)
_CLASS = np.full(256, 6)  # other symbols
_CLASS[(_CODES >= 97) & (_CODES <= 122)] = 0
_CLASS[(_CODES >= 65) & (_CODES <= 90)] = 1
_CLASS[(_CODES >= 48) & (_CODES <= 57)] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"!?()-"]] = 4
_CLASS[(_CODES >= 128) & (_CODES < 192)] = 7  # inside a character
_CLASS[_CODES >= 192] = 5
_LETTERS = (0, 1, 5)

_SHARES = [0.001, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75]
#: Bounds of the bins of each line feature, by name.
BINS = {
    "upper": _SHARES,
    "digit": _SHARES,
    "space": _SHARES,
    "mark": _SHARES,
    "symbol": _SHARES,
    "repeat": _SHARES,
    "distinct": [0.1, 0.25, 0.4, 0.55, 0.7, 0.8, 0.9, 0.98],
    "word": [2, 3, 4, 5, 6, 8, 10, 15],
    "words": [1, 2, 4, 8, 16, 32, 64, 128],
    "chars": [2, 10, 30, 80, 160, 320, 640, 1280],
}
#: Features that a line also takes from the line before and the line after it.
BESIDE = ("upper", "mark", "symbol", "repeat", "distinct", "word")
_WIDTH = 10  # bins of a feature, with one for "no such line"
N_FEATURES = len(BINS) + 2 * len(BESIDE) + 1
N_WEIGHTS = N_FEATURES * _WIDTH


class Lines(NamedTuple):
    """Feature indexes and lengths of the lines of a chunk, and each row's first line."""

    features: np.ndarray
    lengths: np.ndarray
    rows: np.ndarray


def lines(chunk: Chunk) -> Lines:
    """The lines of each row; an empty text has none."""
    size = len(chunk.data)
    newline = np.flatnonzero(chunk.data == 10) + 1
    bounds = np.unique(np.concatenate((chunk.offsets, newline)))
    rows = np.searchsorted(bounds, chunk.offsets)
    n = len(bounds) - 1
    if not size:
        return Lines(np.empty((0, N_FEATURES), np.int16), np.empty(0), np.zeros_like(rows))
    line_of = np.repeat(np.arange(n), np.diff(bounds))
    kinds = np.bincount(line_of * 8 + _CLASS[chunk.data], minlength=8 * n).reshape(n, 8)
    chars = kinds[:, :7].sum(axis=1)
    found = words(chunk)
    of_word = np.searchsorted(bounds, found.starts, "right") - 1
    n_words = np.bincount(of_word, minlength=n)
    again = (found.hashes[1:] == found.hashes[:-1]) & (of_word[1:] == of_word[:-1])
    repeats = np.bincount(of_word[1:][again], minlength=n)
    marked = found.hashes ^ (of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(marked, return_index=True)
    distinct = np.bincount(of_word[first], minlength=n)
    some, letters = np.maximum(chars, 1), np.maximum(kinds[:, _LETTERS].sum(axis=1), 1)
    values = {
        "upper": kinds[:, 1] / letters,
        "digit": kinds[:, 2] / some,
        "space": kinds[:, 3] / some,
        "mark": kinds[:, 4] / some,
        "symbol": kinds[:, 6] / some,
        "repeat": repeats / np.maximum(n_words, 1),
        "distinct": distinct / np.maximum(n_words, 1),
        "word": letters / np.maximum(n_words, 1),
        "words": n_words,
        "chars": chars,
    }
    own = {name: np.searchsorted(BINS[name], value, "right") for name, value in values.items()}
    columns = list(own.values())
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    filled = rows[:-1] < rows[1:]
    is_first[rows[:-1][filled]] = True
    is_last[rows[1:][filled] - 1] = True
    for name in BESIDE:
        columns.append(np.where(is_first, _WIDTH - 1, np.roll(own[name], 1)))
        columns.append(np.where(is_last, _WIDTH - 1, np.roll(own[name], -1)))
    columns.append(2 * is_first + is_last)
    index = np.stack(columns, axis=1) + np.arange(N_FEATURES) * _WIDTH
    return Lines(index.astype(np.int16), chars.astype(float), rows)


def forward_backward(emission: np.ndarray, transition: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line marginals and expected transition counts of many chains at once.

    ``emission`` are log potentials (lines, 2), ``transition`` log potentials (2, 2); chain
    i holds the lines from rows[i] to rows[i + 1]. Step t is taken by all chains longer
    than t together.
    """
    potential = np.exp(emission - emission.max(axis=1, keepdims=True))
    move = np.exp(transition - transition.max())
    sizes = np.diff(rows)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = rows[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), "left")  # chains longer than t
    forward, backward = potential.copy(), np.ones_like(potential)
    for t in range(longest):
        at = starts[: alive[t]] + t
        if t:
            forward[at] *= forward[at - 1] @ move
        forward[at] /= forward[at].sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        after = potential[at + 1] * backward[at + 1]
        backward[at] = after @ move.T
        backward[at] /= backward[at].sum(axis=1, keepdims=True)
        joint = forward[at][:, :, None] * move * after[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    marginal = forward * backward
    return marginal / marginal.sum(axis=1, keepdims=True), pairs


class Chain(NamedTuple):
    weights: np.ndarray  # (N_WEIGHTS, 2)
    transition: np.ndarray
    scale: float
    shift: float
    empty: float

    def line_marginals(self, own: Lines) -> np.ndarray:
        """Probability of each line to be good."""
        return forward_backward(self.weights[own.features].sum(axis=1), self.transition, own.rows)[0][:, 1]

    def qualities(self, own: Lines) -> np.ndarray:
        """Mean line marginal by length, per row; rows without lines get NaN."""
        good = self.line_marginals(own)
        sizes = np.diff(own.rows)
        at = np.repeat(np.arange(len(sizes)), sizes)
        total = np.bincount(at, own.lengths, minlength=len(sizes))
        share = np.bincount(at, own.lengths * good, minlength=len(sizes))
        with np.errstate(invalid="ignore", divide="ignore"):
            return share / total

    def scores(self, own: Lines) -> np.ndarray:
        quality = self.qualities(own)
        clipped = np.clip(np.nan_to_num(quality, nan=0.5), 1e-4, 1 - 1e-4)
        logit = self.scale * np.log(clipped / (1 - clipped)) + self.shift
        return np.where(np.isnan(quality), self.empty, 1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def _fit_lines(own: Lines, target: np.ndarray, weight: np.ndarray, steps: int, chain: bool, start=None):
    """Weights and transitions by Adagrad on the log likelihood of the line labels."""
    weights, move = start or (np.zeros((N_WEIGHTS, 2)), np.zeros((2, 2)))
    seen_w, seen_m = np.full(weights.shape, 1e-8), np.full((2, 2), 1e-8)
    inside = np.ones(len(target), bool)
    inside[own.rows[:-1][np.diff(own.rows) > 0]] = False
    counts = np.zeros((2, 2))
    follow = np.flatnonzero(inside)
    np.add.at(counts, (target[follow - 1], target[follow]), 1)
    flat = own.features.ravel().astype(np.int64)
    for _ in range(steps):
        emission = weights[own.features].sum(axis=1)
        marginal, pairs = forward_backward(emission, move, own.rows)
        error = (np.eye(2)[target] - marginal) * weight[:, None] / len(target)
        spread = np.repeat(error, N_FEATURES, axis=0)
        gradient = np.stack([np.bincount(flat, spread[:, k], minlength=N_WEIGHTS) for k in (0, 1)], axis=1)
        gradient -= 1e-5 * weights
        seen_w += gradient**2
        weights = weights + 0.1 * gradient / np.sqrt(seen_w)
        if chain:
            slope = (counts - pairs) / len(target) - 1e-4 * move
            seen_m += slope**2
            move = move + 0.05 * slope / np.sqrt(seen_m)
    return weights, move


def train(own: Lines, labels: np.ndarray, good_share: float) -> Chain:
    """A chain from documents' lines and labels (1 good), with scores calibrated to the labels."""
    share = min(max(good_share, 1e-3), 1 - 1e-3)
    weights, move, at = np.zeros((N_WEIGHTS, 2)), np.zeros((2, 2)), np.empty(0, np.int64)
    if len(own.lengths) and len(set(labels.tolist())) == 2:
        sizes = np.diff(own.rows)
        at = np.repeat(np.arange(len(sizes)), sizes)
        target = labels[at]
        weight = np.clip(own.lengths, 1, 400) / 200
        for steps in (40, 40):
            weights, _ = _fit_lines(own, target, weight, steps, False)
            margin = (weights[own.features].sum(axis=1) @ np.array([-1.0, 1.0]))
            worst = np.full(len(sizes), np.inf)
            np.minimum.at(worst, at, margin)
            target = np.where((labels[at] == 0) & ((margin < 0) | (margin == worst[at])), 0, 1)
        weights, move = _fit_lines(own, target, weight, 60, True, (weights, np.zeros((2, 2))))
    chain = Chain(weights, move, 1.0, 0.0, share)
    if not len(at):
        return chain
    quality = chain.qualities(own)
    use = ~np.isnan(quality)
    clipped = np.clip(quality[use], 1e-4, 1 - 1e-4)
    x, y = np.log(clipped / (1 - clipped)), labels[use]
    counts = np.maximum(np.bincount(labels, minlength=2), 1)
    row_weight = np.where(y == 1, share / counts[1], (1 - share) / counts[0]) * len(y)
    scale, shift = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(scale * x + shift, -40, 40)))
        error, curve = row_weight * (p - y), row_weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(curve * x * x).sum() + 1, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1]])
        step = np.linalg.solve(h, [(error * x).sum() + scale - 1, error.sum() + shift])
        scale, shift = scale - 0.5 * step[0], shift - 0.5 * step[1]
    return chain._replace(scale=float(max(scale, 0.05)), shift=float(shift))


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(0)):
            own = lines(chunk)
            for k, (a, b) in enumerate(zip(own.rows[:-1], own.rows[1:])):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own.features[a:b].tobytes()], pa.binary()),
                        pa.array([own.lengths[a:b].tobytes()], pa.binary()),
                        batch.column(1).slice(chunk.first + k, 1),
                    ],
                    names=["features", "lengths", "label"],
                )


def trained_chain(
    documents: DataFrame, labels: DataFrame, training: Column, per_class: int = ROWS_PER_CLASS
) -> Chain:
    """A chain fitted to at most ``per_class`` labelled rows of each label.

    ``training`` selects the usable label rows. Only line features of that bounded sample
    reach the driver. Without rows of both labels every text scores the share of good rows.
    """
    shares = {
        row["quality"]: row["n"]
        for row in labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & training)
        .groupBy("quality")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    sample = labelled_sample(documents, labels, "quality", training, per_class)
    found = sorted(
        sample.select(F.col("text").cast("string"), "label")
        .mapInArrow(_sample_batches, "features binary, lengths binary, label int")
        .collect(),
        key=lambda r: (len(r["features"]), bytes(r["features"]), r["label"]),
    )
    features = [np.frombuffer(r["features"], np.int16).reshape(-1, N_FEATURES) for r in found]
    lengths = [np.frombuffer(r["lengths"]) for r in found]
    rows = np.concatenate(([0], np.cumsum([len(x) for x in lengths]))).astype(np.int64)
    own = Lines(
        np.concatenate(features) if found else np.empty((0, N_FEATURES), np.int16),
        np.concatenate(lengths) if found else np.empty(0),
        rows,
    )
    total = sum(shares.values())
    return train(own, np.array([r["label"] for r in found], dtype=np.int64), shares.get(1, 0) / total if total else 0.5)


def _score_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                own = lines(chunk)
                scores = chain.scores(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, len(scores)),
                        pa.array(scores),
                        pa.array(np.diff(own.rows).astype(np.int64)),
                    ],
                    names=["doc_id", "score", "n_lines"],
                )

    return run


def quality(documents: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, score, predicted, n_lines): the probability that a text is good.

    One row per input row. Null and empty texts have no line and score the share of good
    training rows. Null and repeated ids pass through; other columns play no part; an empty
    table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(chain)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = own.mapInArrow(_score_batches(shared), "doc_id long, score double, n_lines long")
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines")
