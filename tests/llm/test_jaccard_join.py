from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import jaccard_join as op


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset({tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})


def brute(rows, size, percent):
    """Sorted (doc_id, n_shingles, component_id, class_id, n_links), by all pairs."""
    known = [(i, shingles(t, size)) for i, t in rows]
    sets = {s for i, s in known if s and i is not None}
    similar = {s: {t for t in sets if t != s and 100 * len(s & t) >= percent * len(s | t)} for s in sets}
    ids = {i for i, _ in known if i is not None}
    holders = {s: sorted(i for i, t in known if t == s and i is not None) for s in sets}
    label = {i: i for i in ids}
    edges = [(holders[s][0], i) for s in sets for i in holders[s]] + [(holders[s][0], holders[t][0]) for s in sets for t in similar[s]]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    out = [
        (i, len(s), label.get(i), i if not s or i is None else holders[s][0], len(similar[s]) if s and i is not None else 0)
        for i, s in known
    ]
    return sorted(out, key=str)


def result(found):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["class_id"], r["n_links"]) for r in found.collect()), key=str)


def corpus(seed, groups=10, size=12, words=(6, 90), edits=14):
    """Texts with groups of near copies around the threshold, and copies of copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(*words))]
        texts.append(" ".join(base))
        for _ in range(size):
            copy = list(base if rng.random() < 0.7 else texts[-1].split())
            for _ in range(rng.randint(0, max(1, len(copy) // edits))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size, percent, seed", [(4, 85, 1), (4, 85, 2), (2, 80, 3), (1, 60, 4), (3, 100, 5)])
def test_equals_all_pairs(documents, size, percent, seed):
    rows = corpus(seed, edits=14 if size > 2 else 6)
    assert result(op.jaccard_join(documents(rows), size, percent)) == brute(rows, size, percent)


def test_small_blocks_and_few_earlier_shingles(documents, monkeypatch):
    """The same when buckets fall into many blocks, and postings carry little of what came before."""
    rows = corpus(6, groups=3, size=40, words=(40, 60), edits=25)
    monkeypatch.setattr(op, "POSTING_BLOCK", 7)
    monkeypatch.setattr(op, "SET_BLOCK", 150)
    assert result(op.jaccard_join(documents(rows), 2, 80)) == brute(rows, 2, 80)


def test_full_sets_of_near_copies_travel_packed(documents, monkeypatch):
    """Blocks of near copies hold each shingle about once, before any block meets another."""
    rows = corpus(11, groups=1, size=60, words=(200, 200), edits=100)
    stored, table = [], op.Staging.table

    def noted(self, df, name):
        out = table(self, df, name)
        if name == "blocks" and "shingles" in out.columns:
            stored.extend((r["n_blocks"], len(r["cls"]), len(r["shingles"])) for r in out.collect())
        return out

    monkeypatch.setattr(op.Staging, "table", noted)
    monkeypatch.setattr(op, "SET_BLOCK", 4000)
    assert result(op.jaccard_join(documents(rows), 2, 80)) == brute(rows, 2, 80)
    assert any(n > 1 for n, _, _ in stored)
    full = [(n, size) for _, n, size in stored if n >= 8]
    assert full and all(size < 0.6 * 8 * 190 * n for n, size in full)


@pytest.mark.parametrize("n", [1, 70_000])
def test_packed_sets_are_what_they_were(n):
    sets = [np.arange(k, n + k, dtype=np.uint64) << np.uint64(40) for k in (0, 0, 5)] + [np.empty(0, np.uint64)]
    block = op._packed(sets)
    assert [s.tolist() for s in op._unpacked(pa.py_buffer(block))] == [s.tolist() for s in sets]


def test_passages_of_a_third_of_all_rows_do_not_fill_the_buckets(documents):
    """A long passage that many different texts share makes them meet nowhere."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(80)) + (f" {passage}" if i % 3 == 0 else "")) for i in range(300)]
    rows += [(1000 + i, f"{passage} {word()}") for i in range(20)]
    assert result(op.jaccard_join(documents(rows), 4, 85)) == brute(rows, 4, 85)


def test_copies_are_one_class(documents):
    rows = corpus(8, groups=3, size=5)
    rows += [(100 + k, rows[0][1].upper()) for k in range(150)] + [(300 + k, rows[1][1] + " x") for k in range(50)]
    assert result(op.jaccard_join(documents(rows), 4, 85)) == brute(rows, 4, 85)


def test_ids_with_several_texts(documents):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(3, a), (5, a), (5, b), (7, b), (7, None), (9, "c d"), (9, "c d"), (9, "e f"), (8, "e f"), (9, "")]
    found = result(op.jaccard_join(documents(rows), 4, 85))
    assert found == brute(rows, 4, 85)
    assert {r[0]: r[2] for r in found} == {3: 3, 5: 3, 7: 3, 8: 8, 9: 8}


def test_nulls_short_empty_and_very_long_texts(documents):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (None, "one"), (None, None)]
    rows += [(7, long), (8, long + " more words at the end"), (9, "x" * 1_000_000), (10, "x" * 1_000_000 + " y"), (11, "É é"), (12, "é é")]
    assert result(op.jaccard_join(documents(rows), 4, 85)) == brute(rows, 4, 85)


def test_repeated_rows_clashing_columns_and_an_empty_table(documents, clashing):
    rows = corpus(10, groups=3, size=4) * 3
    more = {name: F.lit(1) for name in [*clashing, "cls", "gram", "n", "prefix", "a", "b", "text_hash"]}
    assert result(op.jaccard_join(documents(rows, **more), 4, 85)) == brute(rows, 4, 85)
    assert op.jaccard_join(documents([]), 4, 85).collect() == []


def test_rare_shingles_come_first(documents):
    rows = [(i, f"all of these words are there {i}{i} {i}{i + 1} {i}{i + 2}") for i in range(60)]
    ranks = op.rarity(documents(rows).select("text"), 1)
    one = np.zeros(1, dtype=np.uint64)
    assert len(ranks) == op.SKETCH and ranks.max() == np.floor(4 * np.log2(61)) and op._rank(ranks, one).shape == (1,)


def test_the_prefix_is_as_short_as_the_threshold_allows():
    assert [op.needed(n, 85) for n in (1, 6, 7, 20, 100)] == [1, 6, 6, 17, 85]
