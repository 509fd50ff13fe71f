from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwise.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    """The stated patterns by the regular expression engine."""
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text)
        if valid(kind, m.group())
    ]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.@- +()9_%0É\n4", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_on_values_between_words():
    rng = random.Random(3)
    card = lambda: next(s for s in (str(rng.randrange(10**15, 10**16)) for _ in range(999)) if luhn(s))
    makers = [
        lambda: f"{rng.choice('abc')}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
        lambda: ".".join(str(rng.randrange(300)) for _ in range(rng.randrange(3, 10))),
        card,
        lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10**4):04d}",
        lambda: rng.choice(["a@b", "a@b.c_d@e.f", "+12", "1-2-3", "0000.1.2.3", "é@x.y", "@", "4111 1111 1111 1111"]),
    ]
    for _ in range(400):
        text = " ".join(rng.choice(makers)() if rng.random() < 0.6 else "word" for _ in range(12))
        assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" + " (" * 100_000, "a@" * 50_000):
        pii.base_spans(text)
        pii.tokens(text)


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(2)
    k = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(pii.BUCKETS + 1, k)), rng.normal(size=k), rng.normal(size=(k, k)), np.zeros((k, k)))
    field.weights[pii.BUCKETS] = 0
    field = field._replace(chain=field.chain + field.chain.T)
    graph = pii.Graph([[1, 2], [3], [4]], [[5], [], [6]], [(0, 1), (1, 2)], [])
    got = pii.marginals(field, [graph], rounds=60)
    unary = np.array([field.weights[a + b].sum(axis=0) for a, b in zip(graph.own, graph.place)]) + field.bias
    joint = np.exp(
        unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :]
        + field.chain[:, :, None] + field.chain[None, :, :]
    )
    joint /= joint.sum()
    expected = [joint.sum(axis=(1, 2)), joint.sum(axis=(0, 2)), joint.sum(axis=(0, 1))]
    assert np.allclose(got, expected, atol=1e-6)


def test_evidence_reaches_every_repeat():
    """One occurrence in a telling place, 200 that say nothing themselves."""
    k, secret = len(pii.LABELS), pii.LABELS.index("secret")
    weights = np.zeros((pii.BUCKETS + 1, k))
    weights[1, secret] = 12.0
    skip, hub = pii._pair_potential([(0, 0)] * 300 + [(secret, secret)] * 300, 5.0)
    field = pii.Field(weights, hub.copy(), np.zeros((k, k)), skip, hub)
    graph = pii.Graph([[1]] + [[2]] * 200, [[]] * 201, [], [(i, i + 1) for i in range(200)])
    got = pii.marginals(field, [graph])
    assert (got[:, secret] >= pii.ADD_FROM).all()
    alone = pii.marginals(field, [pii.Graph([[2]] * 201, [[]] * 201, [], graph.skip)])
    assert (alone[:, secret] < pii.ADD_FROM).all()


def test_a_value_repeated_200_times_is_found_each_time(documents, corpus):
    secret = "9f" * 20
    text = f'token = "{secret}" ' + " ".join(f"lorem {secret} ipsum" for _ in range(200))
    rows = [*corpus, (1000, text)]
    found = pii.personal_data(documents(rows)).filter("doc_id = 1000").first()
    assert found["n_added"] == 201


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(400):
        secret = "%040x" % rng.randrange(16**40)
        words = [rng.choice(["lorem", "ipsum", "dolor", "sit", "version 2.0,", "in 1999", "3rd"]) for _ in range(30)]
        words.insert(5, f'token = "{secret}"' if i % 2 else f"password={secret[:18]}")
        words.insert(12, f"u.{rng.randrange(99)}@mail.example.com")
        words.insert(20, f"+1 (555) 555-{rng.randrange(10**4):04d}")
        if i % 4 == 1:
            words.append(f"again {secret} there")
        rows.append((i, " ".join(words)))
    return rows


def test_skip_edges_add_repeated_secrets_and_leave_plain_numbers(documents, corpus):
    found = {r["doc_id"]: r for r in pii.personal_data(documents(corpus)).collect()}
    texts = dict(corpus)
    for i, row in found.items():
        base = brute(texts[i])
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row["spans"].split(","))]
        assert set(base) <= set(spans)
        assert row["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest()
        assert row["n_email"] == 1 and row["n_phone"] == sum(s[0] == "phone" for s in base)
        added = [texts[i][a:b] for k, a, b in spans if k == "secret"]
        assert len(added) == row["n_added"] == (2 if i % 4 == 1 else 1)
        assert not any(w in a for a in added for w in ("2.0", "1999", "3rd"))


def test_masked_texts_keep_rows_and_columns(documents, corpus):
    frame = documents([*corpus, (None, None), (5000, ""), (5001, "clean words only")])
    out = pii.masked(frame)
    assert out.columns == frame.columns
    rows = out.collect()
    assert len(rows) == len(corpus) + 3
    for row in rows:
        if row["text"]:
            assert not brute(row["text"]) and row["n_chars"] == len(row["text"])
    assert {r["text"] for r in rows} >= {None, "", "clean words only"}


def test_overlapping_spans_become_one():
    assert pii.mask("ab12cd", [("card", 2, 4), ("phone", 3, 5)]) == "ab[CARD]d"


def test_edge_rows(documents, clashing):
    rows = [(1, None), (2, ""), (None, "a@b.c"), (3, "a@b.c"), (3, "a@b.c"), (4, "x " * 100_000 + "1.2.3.4")]
    frame = documents(rows, **{c: F.lit(1) for c in clashing})
    found = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["spans"]) for r in pii.personal_data(frame).collect())
    assert found == [
        ("1", 0, 0, ""), ("2", 0, 0, ""), ("3", 1, 0, "email:0:5"), ("3", 1, 0, "email:0:5"),
        ("4", 0, 1, "ip:200000:200007"), ("None", 1, 0, "email:0:5"),
    ]
    assert pii.personal_data(documents([])).count() == 0
    assert pii.masked(documents([])).count() == 0
