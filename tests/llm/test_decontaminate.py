from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, size=13):
    out = []
    for doc_id, text in rows:
        w = words(text)
        hit, found = set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(size, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(item_id)
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(["the", "of", "Été", "x1", "Red", "sea", "a-b", "go"]) for _ in range(n))
    items = [(k, some(rng.choice([1, 5, 12, 13, 14, 30]))) for k in range(14)] + [(90, None), (91, "..."), (92, "sea  RED")]
    rows = []
    for i in range(80):
        part = rng.choice(items)[1] or ""
        cut = part.split()
        piece = " ".join(cut[rng.randrange(3) :])
        rows.append((i, f"{some(rng.randrange(60))} {piece}, {some(rng.randrange(200))}"))
    return rows, items


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("per_pass, segment", [(10**6, 1 << 20), (20, 200)])
def test_equals_all_windows(spark, documents, case, monkeypatch, per_pass, segment):
    """Also with many passes over the test set and segments of one text."""
    monkeypatch.setattr(d, "WORDS_PER_PASS", per_pass)
    monkeypatch.setattr(d, "SEGMENT_BYTES", segment)
    rows, items = case
    assert got(d.contamination(documents(rows), benchmark(spark, items))) == brute(rows, items)


def test_whole_vocabulary_gives_the_same(spark, documents, case, monkeypatch):
    monkeypatch.setattr(d, "MAX_VOCABULARY", 2)
    rows, items = case
    assert got(d.contamination(documents(rows), benchmark(spark, items))) == brute(rows, items)


def test_edge_rows(spark, documents, clashing):
    passage = " ".join(f"p{k}" for k in range(13))
    rows = [
        (1, None), (2, ""), (3, "!?"), (4, passage), (4, passage), (None, passage), (5, passage + " x" * 300),
        (6, "q " * 50_000 + passage), (7, " ".join(f"p{k}" for k in range(12))),
    ]
    frame = documents(rows, **{c: F.lit("x") for c in clashing})
    items = [(1, passage), (2, passage), (3, "")]
    assert got(d.contamination(frame, benchmark(spark, items))) == brute(rows, items)
    kept = d.decontaminated(frame, benchmark(spark, items))
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5, 6, 7]


def test_empty_tables(spark, documents):
    assert d.contamination(documents([]), benchmark(spark, [(1, "a b")])).count() == 0
    assert got(d.contamination(documents([(1, "a b")]), benchmark(spark, []))) == [(1, 2, 0, [], False)]
    assert d.proximity_matches(documents([(1, "a b")]), benchmark(spark, [])).count() == 0


def test_item_without_id_hits_but_is_not_listed(spark, documents):
    assert got(d.contamination(documents([(1, "a b")]), benchmark(spark, [(None, "a b")]))) == [(1, 2, 2, [], True)]


def test_proximity(spark, documents):
    rows = [(1, "z red z sea z"), (2, "sea red"), (3, "red " + "z " * 30 + "sea"), (4, "red"), (5, "red sea z z red z z z z z sea")]
    found = d.proximity_matches(documents(rows), benchmark(spark, [(7, "red sea")]), slop=2)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 7, 1, 3), (2, 7, 0, 1), (5, 7, 0, 1), (5, 7, 1, 4)]
