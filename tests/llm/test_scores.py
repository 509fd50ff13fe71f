"""Toxicity and quality: held-out accuracy, and the parts against plain forms."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import quality, toxicity
from shelfwise.llm.tables import doc_fold, table
from shelfwise.llm.textscan import chunks


def held_out_counts(scored, labels, label, fold):
    rows = scored.join(labels, "doc_id").filter(fold & F.col(label).isNotNull()).select(label, "predicted").collect()
    right = {y: sum(r["predicted"] == r[label] for r in rows if r[label] == y) for y in (0, 1)}
    return right, {y: sum(r[label] == y for r in rows) for y in (0, 1)}


def test_toxicity_on_held_out_documents(spark, documents):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    documents([])
    machine = toxicity.trained_machine(docs, labels, doc_fold(4) != 2)
    right, n = held_out_counts(toxicity.toxicity(docs, machine), labels, "toxic", doc_fold(4) == 2)
    assert right[0] >= 0.97 * n[0] and right[1] >= 0.9 * n[1]


def test_quality_on_held_out_documents(spark, documents):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    documents([])
    chain = quality.trained_chain(docs, labels, doc_fold(5) != 0)
    right, n = held_out_counts(quality.quality(docs, chain), labels, "quality", doc_fold(5) == 0)
    assert right[0] >= 0.95 * n[0] and right[1] >= 0.95 * n[1]


def test_pairs_of_terms_are_learned():
    """Two terms that mean nothing alone: only the product of their vectors can tell."""
    rng = random.Random(1)
    rows, labels = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted({10 + a, 20 + b, 1000 + rng.randrange(40)}), dtype=np.int32))
        labels.append(int(a == b))
    chosen = np.unique(np.concatenate(rows))
    machine = toxicity.train(chosen, rows, np.array(labels), 0.5, epochs=400)
    assert np.mean((machine.scores(rows) >= 0.5) == np.array(labels)) > 0.95


def test_texts_that_say_nothing_are_never_removed(spark, documents):
    rows = [(i, f"nice word{i % 7} here" if i % 4 else f"awful thing{i % 7}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0 or i % 8 == 1)) for i in range(400)], "doc_id long, toxic int")
    docs = documents([*rows, (1000, None), (1001, ""), (1002, " \n"), (1003, "zzz qqq"), (None, "awful thing1")], score=F.lit(1), label=F.lit(2))
    machine = toxicity.trained_machine(docs, labels, F.lit(True))._replace(shift=3.0)
    kept = toxicity.without_toxic(docs, machine)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1000, 1001, 1002, 1003} <= ids and 0 not in ids and None not in ids


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    place = np.full(1 << toxicity.BUCKET_BITS, 5, dtype=np.int32)
    place[:5] = np.arange(5)
    w, v = rng.normal(size=6), rng.normal(size=(6, toxicity.FACTORS))
    w[5], v[5] = 0, 0
    machine = toxicity.Machine(place, w, v, 0.3, 1.0, 0.0)
    rows = [np.array([0, 2, 4, 99]), np.array([], dtype=int), np.array([77]), np.array([1])]
    expected = [
        0.3 + sum(w[i] for i in r if i < 5) + sum(v[i] @ v[j] for i, j in itertools.combinations([i for i in r if i < 5], 2))
        for r in rows
    ]
    assert np.allclose(machine.logits(rows), expected)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    rows = np.array([0, 3, 3, 4, 9])
    emission, move = rng.normal(size=(9, 2)) * 3, rng.normal(size=(2, 2))
    got, pairs = quality.forward_backward(emission, move, rows)
    expected_pairs = np.zeros((2, 2))
    for a, b in zip(rows[:-1], rows[1:]):
        total, marginal, both = 0.0, np.zeros((b - a, 2)), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            p = np.exp(sum(emission[a + t, y] for t, y in enumerate(labels)) + sum(move[x, y] for x, y in zip(labels, labels[1:])))
            if not labels:
                continue
            total += p
            for t, y in enumerate(labels):
                marginal[t, y] += p
            for x, y in zip(labels, labels[1:]):
                both[x, y] += p
        if b > a:
            assert np.allclose(got[a:b], marginal / total)
            expected_pairs += both / total
    assert np.allclose(pairs, expected_pairs)


def test_lines_of_rows():
    import pyarrow as pa

    texts = ["a b\nC! C!\n", None, "", "\n\n", "x"]
    for chunk in chunks(pa.array(texts)):
        own = quality.lines(chunk)
        assert np.diff(own.rows).tolist() == [2, 0, 0, 2, 1]
        assert own.lengths.tolist() == [4, 6, 1, 1, 1]


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_edge_rows(spark, documents, clashing, name):
    rows = [(k, f"good plain words number {k}\nand more of them" if k % 2 else "JUNK!! awful scum ### awful") for k in range(60)]
    rows += [(100, None), (101, ""), (None, "awful scum"), (102, "a " * 200_000), (102, "a " * 200_000), (103, "\n\n")]
    docs = documents(rows, **{c: F.lit("x") for c in clashing})
    labels = spark.createDataFrame(
        [(k, int(k % 2 == (name == "quality"))) for k in range(60)] + [(None, 1), (100, None), (1, 7)], f"doc_id long, {name} int"
    )

    def scored(docs, labels):
        if name == "toxic":
            return toxicity.toxicity(docs, toxicity.trained_machine(docs, labels, F.lit(True)))
        return quality.quality(docs, quality.trained_chain(docs, labels, F.lit(True)))

    found = scored(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert sorted((str(r["doc_id"]) for r in found)) == sorted(str(i) for i, _ in rows)
    first = {r["doc_id"]: r["score"] for r in found}
    assert first == {r["doc_id"]: r["score"] for r in scored(docs, labels).collect()}
    assert scored(docs.limit(0), labels).count() == 0
    same = {r["score"] for r in scored(docs, labels.limit(0)).collect()}
    assert len(same) == 1


def test_without_toxic_keeps_clean_rows_and_columns(spark, documents):
    rows = [(k, f"plain words {k}" if k % 2 else f"awful scum {k}") for k in range(80)] + [(None, "plain"), (200, None)]
    docs = documents(rows)
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(80)], "doc_id long, toxic int")
    machine = toxicity.trained_machine(docs, labels, F.lit(True))
    kept = toxicity.without_toxic(docs, machine)
    assert kept.columns == docs.columns
    assert {r["text"] for r in kept.collect() if r["doc_id"] is not None and r["doc_id"] < 80} == {f"plain words {k}" for k in range(1, 80, 2)}
