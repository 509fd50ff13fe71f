"""Toxicity with a factorization machine over hashed terms.

Terms are words and their first four and five bytes, hashed to buckets. The buckets that
separate the classes best on a bounded sample of labelled rows form the vocabulary. The
machine gives each a weight and a vector; the product of the vectors of two terms that
occur in one text is the weight of that pair, so an insult next to a group mention can
count for more, or less, than the two alone:

    logit = b + sum w_i + 1/2 * sum_f ((sum v_if)^2 - sum v_if^2)

Scoring is one narrow pass over the texts; the model is a few hundred kilobytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.tables import labelled_sample, stage
from shelfwise.llm.textscan import ALNUM, Chunk, chunks, prefix_hashes, ragged, words

#: Training rows of each label at most.
ROWS_PER_CLASS = 5000
BUCKET_BITS = 20
TERMS = 3000
FACTORS = 6
LEAST_CHI = 6.6
THRESHOLD = 0.3
PREFIXES = (4, 5)

SCORE_SCHEMA = "doc_id long, score double"


def term_buckets(chunk: Chunk) -> list[np.ndarray]:
    """The distinct buckets of each row of a chunk, sorted."""
    found = words(chunk, ALNUM)
    long_enough = found.ends - found.starts
    parts = [found.hashes] + [
        np.where(long_enough >= size, prefix_hashes(chunk, found, size), found.hashes) for size in PREFIXES
    ]
    buckets = [(p >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) for p in parts]
    out = []
    for a, b in zip(found.rows[:-1], found.rows[1:]):
        out.append(np.unique(np.concatenate([p[a:b] for p in buckets])))
    return out


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(0)):
            rows = term_buckets(chunk)
            values = np.concatenate(rows) if rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ragged(values, [len(r) for r in rows], pa.int32()),
                    batch.column(1).slice(chunk.first, len(rows)),
                ],
                names=["buckets", "label"],
            )


class Machine(NamedTuple):
    """``place`` maps a bucket to its row of ``weights`` and ``vectors``; the last row is empty."""

    place: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    bias: float
    scale: float
    shift: float

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """Raw outputs for bucket lists; a row without a known term gets the bias."""
        out = np.full(len(rows), self.bias)
        known = [self.place[r] for r in rows]
        known = [k[k < len(self.weights) - 1] for k in known]
        filled = [i for i, k in enumerate(known) if len(k)]
        if filled:
            at = np.concatenate([known[i] for i in filled])
            begins = np.concatenate(([0], np.cumsum([len(known[i]) for i in filled])[:-1]))
            vectors = self.vectors[at]
            total = np.add.reduceat(vectors, begins)
            squares = np.add.reduceat(vectors**2, begins)
            out[filled] += np.add.reduceat(self.weights[at], begins) + 0.5 * (total**2 - squares).sum(axis=1)
        return out

    def knows(self, rows: list[np.ndarray]) -> np.ndarray:
        """Whether a row has a known term."""
        return np.array([bool((self.place[r] < len(self.weights) - 1).any()) for r in rows], dtype=bool)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        logits = np.clip(self.scale * self.logits(rows) + self.shift, -40, 40)
        return 1 / (1 + np.exp(-logits))


def chosen_terms(sample: DataFrame, n: list[int]) -> np.ndarray:
    """The buckets of a sample (buckets, label) that separate the labels best.

    The measure is the chi-square of a bucket's presence; ``n`` are the rows of each label.
    At most ``TERMS`` bucket numbers reach the driver.
    """
    share = F.col("n") / (n[0] + n[1])
    chi = F.lit(0.0)
    for held, rows in ((F.col("n") - F.col("toxic"), n[0]), (F.col("toxic"), n[1])):
        expected = share * rows
        chi = chi + (held - expected) * (held - expected) / (expected * (1 - share))
    counts = (
        sample.select(F.explode("buckets").alias("bucket"), "label")
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
    )
    best = (
        counts.filter((F.col("n") >= 3) & (share < 1))
        .withColumn("chi", chi)
        .filter(F.col("chi") > LEAST_CHI)
        .orderBy(F.desc("chi"), "bucket")
        .limit(TERMS)
    )
    return np.sort(np.array([r["bucket"] for r in best.select("bucket").collect()], dtype=np.int64))


def _known_batches(terms: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bucket lists cut to the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, offsets = lists.flatten().to_numpy(), np.concatenate(
                ([0], np.cumsum(np.diff(lists.offsets.to_numpy())))
            )
            keep = np.isin(values, terms)
            before = np.concatenate(([0], np.cumsum(keep)))
            yield pa.RecordBatch.from_arrays(
                [ragged(values[keep], np.diff(before[offsets]), pa.int32()), batch.column(1)],
                names=["buckets", "label"],
            )

    return run


def _fitted_line(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits by logistic regression on rows kept out of the fit."""
    scale, shift = 1.0, 0.0
    x = np.clip(logits, -30, 30)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(scale * x + shift, -40, 40)))
        error = weight * (p - labels)
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(curve * x * x).sum() + 1, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1]])
        step = np.linalg.solve(h, [(error * x).sum() + (scale - 1), error.sum() + shift])
        scale, shift = scale - 0.5 * step[0], shift - 0.5 * step[1]
    return (scale, shift) if scale > 0.05 else (1.0, 0.0)


def _fitted(
    known: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, n_terms: int, share: float, epochs: int
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, vectors and bias by full-gradient Adagrad on weighted logistic loss.

    ``known`` are the vocabulary places of each row's terms.
    """
    rng = np.random.default_rng(7)
    w, v = np.zeros(n_terms + 1), rng.normal(0, 0.02, (n_terms + 1, FACTORS))
    v[-1] = 0
    bias, seen_w, seen_v = float(np.log(share / (1 - share))), np.full(len(w), 1e-3), np.full(v.shape, 1e-3)
    use = [i for i in range(len(known)) if len(known[i])]
    if not use:
        return w, v, bias
    at = np.concatenate([known[i] for i in use])
    sizes = np.array([len(known[i]) for i in use])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    y, row_weight = labels[use], weight[use] / len(use)
    for _ in range(epochs):
        vectors = v[at]
        total = np.add.reduceat(vectors, begins)
        pairs = 0.5 * (total**2 - np.add.reduceat(vectors**2, begins)).sum(axis=1)
        logit = np.clip(bias + np.add.reduceat(w[at], begins) + pairs, -30, 30)
        error = row_weight * (1 / (1 + np.exp(-logit)) - y)
        spread = np.repeat(error, sizes)
        grad_w = np.bincount(at, spread, minlength=len(w)) + 3e-5 * w
        grad_v = np.empty_like(v)
        # a factor at a time: all at once, the terms of the sample would be held several times over
        for f in range(FACTORS):
            slope = spread * (np.repeat(total[:, f], sizes) - vectors[:, f])
            grad_v[:, f] = np.bincount(at, slope, minlength=len(w))
        grad_v += 1e-3 * v
        seen_w += grad_w**2
        seen_v += grad_v**2
        w -= 0.3 * grad_w / np.sqrt(seen_w)
        v -= 0.05 * grad_v / np.sqrt(seen_v)
        w[-1], v[-1] = 0, 0
        bias -= 0.2 * error.sum()
    return w, v, bias


def train(
    terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, positive_share: float, epochs: int = 100
) -> Machine:
    """A machine fitted to all rows, calibrated by one that did not see a fifth of them.

    ``terms`` are the buckets of the vocabulary, ``rows`` those of each text.
    ``positive_share`` is that of all labelled training rows, which the row weights restore.
    """
    place = np.full(1 << BUCKET_BITS, len(terms), dtype=np.int32)
    if not len(labels):
        return Machine(place, np.zeros(len(terms) + 1), np.zeros((len(terms) + 1, FACTORS)), -2.0, 1.0, 0.0)
    place[terms] = np.arange(len(terms))
    share = min(max(positive_share, 1e-4), 1 - 1e-4)
    counts = np.maximum(np.bincount(labels, minlength=2), 1)
    weight = np.where(labels == 1, share / counts[1], (1 - share) / counts[0]) * len(labels)
    known = [place[r] for r in rows]
    known = [k[k < len(terms)] for k in known]

    scale, shift = 1.0, 0.0
    held = np.arange(0, len(rows), 5)
    if len(rows) >= 50 and len(set(labels[held].tolist())) == 2:
        seen = np.setdiff1d(np.arange(len(rows)), held)
        part = _fitted([known[i] for i in seen], labels[seen], weight[seen], len(terms), share, epochs)
        trial = Machine(place, *part, 1.0, 0.0)
        scale, shift = _fitted_line(trial.logits([rows[i] for i in held]), labels[held], weight[held])
    return Machine(place, *_fitted(known, labels, weight, len(terms), share, epochs), scale, shift)


def trained_machine(
    documents: DataFrame, labels: DataFrame, training: Column, per_class: int = ROWS_PER_CLASS
) -> Machine:
    """A machine fitted to at most ``per_class`` labelled rows of each label.

    ``training`` selects the usable label rows. Only hashed terms of that bounded sample
    reach the driver. Without usable rows every text gets the same low score.
    """
    shares = {
        row["toxic"]: row["n"]
        for row in labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & training)
        .groupBy("toxic")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    picked = labelled_sample(documents, labels, "toxic", training, per_class)
    sample = stage(
        picked.select(F.col("text").cast("string"), "label").mapInArrow(
            _sample_batches, "buckets array<int>, label int"
        ),
        "toxicity-sample",
    )
    rows_of = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    terms = chosen_terms(sample, [rows_of.get(0, 0), rows_of.get(1, 0)]) if rows_of else np.empty(0, np.int64)
    found = sample.mapInArrow(_known_batches(terms), "buckets array<int>, label int").toArrow()
    rows = [np.asarray(r.values.to_numpy(zero_copy_only=False)) for r in found.column("buckets")]
    values = found.column("label").to_numpy().astype(np.int64)
    # partitions come in any order: fix it, so that the same rows give the same model
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i][:8].tolist(), int(rows[i].sum()), int(values[i])))
    total = sum(shares.values()) or 1
    return train(terms, [rows[i] for i in order], values[order], shares.get(1, 0) / total)


def _score_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                rows = term_buckets(chunk)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, len(rows)), pa.array(machine.scores(rows))],
                    names=["doc_id", "score"],
                )

    return run


def toxicity(documents: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score, predicted): the probability that a text is toxic, and whether it is at least 0.3.

    One row per input row; texts of any length are read whole. Null and empty texts and texts
    without a known term get the score of the bias. Null and repeated ids pass through; other columns play no part; an
    empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = own.mapInArrow(_score_batches(shared), SCORE_SCHEMA)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _clean_batches(shared, place: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(place)):
                rows = term_buckets(chunk)
                toxic = (machine.scores(rows) >= THRESHOLD) & machine.knows(rows)
                yield batch.slice(chunk.first, len(rows)).filter(pa.array(~toxic))

    return run


def without_toxic(documents: DataFrame, machine: Machine) -> DataFrame:
    """The rows scored below 0.3, with the columns of the input, in one narrow pass.

    Texts that say nothing to the machine, null and empty ones and those without a term it
    knows, stay whatever score the share of toxic rows gives them.
    """
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    place = documents.columns.index("text")
    return documents.mapInArrow(_clean_batches(shared, place), documents.schema)
