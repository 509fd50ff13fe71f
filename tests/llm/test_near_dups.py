from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import near_dups
from shelfwise.llm.components import components
from shelfwise.llm.textscan import chunks, words


def spaced(text):
    return (text or "").encode().lower().split()


def shingles(text, size):
    w = spaced(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent=80):
    """(doc_id, n_shingles, component_id) by all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    ids = [i for i, _ in rows]
    label = {i: i for i in ids}
    links = [
        (ids[a], ids[b])
        for a in range(len(rows))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return sorted((i, len(s), label[i]) for i, s in zip(ids, sets))


def corpus(seed, groups=12, size=14):
    """Texts with groups of near copies around the threshold, and copies of copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(8, 90))]
        texts.append(" ".join(base))
        for _ in range(size):
            copy = list(base if rng.random() < 0.7 else texts[-1].split())
            for _ in range(rng.randint(0, max(1, len(copy) // 12))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size, seed", [(2, 1), (2, 2), (5, 3)])
def test_equals_all_pairs(documents, size, seed):
    rows = corpus(seed)
    found = near_dups.near_duplicates(documents(rows), size).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute(rows, size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_group_without_a_centre(documents, monkeypatch):
    """Copies that link only to some of their group are found in pairs of small blocks."""
    monkeypatch.setattr(near_dups, "SIGNATURE_BLOCK", 8)
    monkeypatch.setattr(near_dups, "SET_BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(60), 4):
            copy[k] = f"x{i}{k}"
        rows.append((i, " ".join(copy)))
    chain = [" ".join(f"c{k}" for k in range(s, s + 40)) for s in range(0, 40, 4)]
    rows += [(100 + k, t) for k, t in enumerate(chain)]
    found = near_dups.near_duplicates(documents(rows), 2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute(rows, 2)


def test_edge_rows(documents, clashing):
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "Alone"), (5, "alone"), (6, "ALONE  \x0b"), (7, "two words"),
        (8, "two\nWORDS"), (None, "two words"), (9, long), (10, long + " more"), (11, "É é"), (12, "é É"), (13, "a\xa0b"),
        (14, "two words"), (14, "two words"),
    ]
    frame = documents(rows, **{c: F.lit("x") for c in clashing})
    found = sorted(
        ((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(frame, 2).collect()),
        key=str,
    )
    expected = [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 4, False),
        (7, 1, 7, True), (8, 1, 7, False), (None, 1, None, True), (9, 59_999, 9, True), (10, 60_000, 9, False),
        (11, 1, 11, True), (12, 1, 12, True), (13, 1, 13, True), (14, 1, 7, False), (14, 1, 7, False),
    ]
    assert found == sorted(expected, key=str)


def test_empty_table(documents):
    assert near_dups.near_duplicates(documents([])).count() == 0
    assert near_dups.deduplicated(documents([])).count() == 0


def test_deduplicated_keeps_columns_and_clean_rows(documents):
    rows = [(1, "a b c d"), (2, "A b c d"), (3, "e f g h"), (None, "a b c d"), (4, None)]
    kept = near_dups.deduplicated(documents(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [
        ("1", "a b c d"), ("3", "e f g h"), ("4", None), ("None", "a b c d"),
    ]


def test_deduplicated_judges_rows_by_id_and_text(documents):
    """Equal rows become one, and a unique text stays though its id is repeated beside a copy."""
    rows = [(1, "a b c d"), (2, "e f g h"), (2, "a b c d"), (2, "e f g h"), (3, "i j k l"), (3, "i j k l"), (4, None), (4, None)]
    rows += [(None, "m n o p"), (None, "m n o p"), (5, "E f g h"), (0, "q r s t"), (0, "u v w x")]
    kept = near_dups.deduplicated(documents(rows))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect() if r["text"]) == [
        ("0", "q r s t"), ("0", "u v w x"), ("1", "a b c d"), ("2", "e f g h"), ("3", "i j k l"),
        ("None", "m n o p"), ("None", "m n o p"),
    ]
    assert kept.filter("text IS NULL").count() == 1


def test_ids_with_several_texts(documents):
    """What any text of an id links with is reachable from all."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(3, a), (5, a), (5, b), (7, b), (7, None), (9, "c d"), (9, "c d"), (9, "e f"), (8, "e f"), (9, "")]
    found = near_dups.near_duplicates(documents(rows), 2).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(3, 3), (5, 3), (7, 3), (8, 8), (9, 8)}
    assert len(found) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_deduplicated_leaves_clashing_columns(documents):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")]
    names = ["_row_key", "row_key", "own_id", "n", "component_id", "first"]
    frame = documents(rows, **{c: F.lit(5) for c in names})
    found = near_dups.deduplicated(frame)
    assert found.columns == frame.columns
    assert sorted((r["doc_id"], *(r[c] for c in names)) for r in found.collect()) == [(1, *[5] * 6), (3, *[5] * 6)]


def test_templated_texts_that_are_no_duplicates(documents, monkeypatch):
    """Many texts of one template, alike by half: all apart, with blocks much smaller than their buckets."""
    rng = random.Random(11)
    template = [f"t{k}" for k in range(40)]
    rows = [(i, " ".join(template + [f"{i}w{k}" for k in range(20 + i % 25)])) for i in range(1500)]
    rows += [(5000 + i, rows[i][1] + " tail") for i in range(0, 1500, 100)]
    rng.shuffle(rows)
    monkeypatch.setattr(near_dups, "SIGNATURE_BLOCK", 64)
    found = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(documents(rows), 2).collect()}
    assert found == {i: i - 5000 if i >= 5000 else i for i, _ in rows}


def test_size_classes_keep_fitting_sizes_together(spark):
    """Sets whose sizes allow the similarity are in the same or in neighbouring classes."""
    sizes = spark.range(1, 4001).withColumnRenamed("id", "n")
    for percent in (50, 80, 85, 99, 100):
        classes = {r["n"]: r["c"] for r in sizes.select("n", near_dups._size_class(F.col("n"), percent).alias("c")).collect()}
        for n in range(1, 4001):
            largest = min(4000, n * 100 // percent)
            assert 0 <= classes[largest] - classes[n] <= 1


def test_keys_are_shared_by_all_signatures_within_the_distance(spark):
    """The pigeonhole promise, with as many errors as allowed in random places."""
    rng = np.random.default_rng(3)
    n = 300
    left = rng.integers(0, 1 << 16, (n, near_dups.COMPONENTS), dtype=np.uint16)
    right = left.copy()
    for row in range(n):
        where = rng.choice(near_dups.COMPONENTS, near_dups.MAX_DISTANCE, replace=False)
        right[row, where] ^= np.uint16(1 + rng.integers(0, 65535))
    names = [f"sig{c}" for c in range(near_dups.CHUNKS)]
    frames = [
        spark.createDataFrame([tuple(map(int, r)) for r in side.view(np.int64)], names).select(near_dups._keys().alias("k"))
        for side in (left, right)
    ]
    a, b = ([set(r["k"]) for r in f.collect()] for f in frames)
    assert all(x & y for x, y in zip(a, b))
    slots = near_dups._first_slots(left, right)
    keys = [f.collect() for f in frames]
    for row, slot in enumerate(slots):
        equal = [x == y for x, y in zip(keys[0][row]["k"], keys[1][row]["k"])]
        assert slot == equal.index(True)


def test_pairs_that_share_a_key_are_looked_at_at_any_distance():
    import pyarrow as pa

    other = [0, *[0x0001000100010001] * 4, 0x00010001, 0, 0]
    values = {"doc_id": [1, 2], "part": [1, 2], "n_b": [10, 10], **{f"sig{c}": [0, x] for c, x in enumerate(other)}}
    fields = {name + s: pa.array([v], pa.list_(pa.int64())) for name, v in values.items() for s in ("", "_y")}
    fields |= {"key": pa.array([7], pa.int64()), "slot": pa.array([0], pa.int32()), "same": pa.array([True])}
    batch = pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields))
    found = [r for out in near_dups._partner_batches(80)([batch]) for r in out.to_pylist()]
    assert found == [{"key": 7, "slot": 0, "doc_id": 1}, {"key": 7, "slot": 0, "doc_id": 2}]


def test_common_counts(monkeypatch):
    monkeypatch.setattr(near_dups, "_SET_SLICE", 3)
    rng = np.random.default_rng(1)
    make = lambda n: [np.unique(rng.integers(0, 40, rng.integers(0, 30))) for _ in range(n)]
    left, right = make(7), make(5)
    assert near_dups.common_counts(left, right).tolist() == [[len(set(a) & set(b)) for b in right] for a in left]


def test_words_are_those_of_bytes_split():
    import pyarrow as pa

    texts = ["Ab  cD\x0b", "", None, "x\x85y \x1c z", "  ", "Été ÉTÉ"]
    hashes: dict[bytes, int] = {}
    for chunk in chunks(pa.array(texts), size=8):
        found = words(chunk)
        for k in range(len(chunk.offsets) - 1):
            own = found.hashes[found.rows[k] : found.rows[k + 1]].tolist()
            expected = spaced(texts[chunk.first + k])
            assert len(own) == len(expected)
            for word, h in zip(expected, own):
                assert hashes.setdefault(word, h) == h
    assert len(set(hashes.values())) == len(hashes)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(0, 200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (None, 7), (3, 2)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(300)}}
    assert components(edges.limit(0)).count() == 0


def test_rows_without_near_duplicates_are_not_shuffled_to_be_kept(documents):
    own = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(50)]
    frame = documents([*own, (50, own[0][1]), (7, own[7][1])])
    kept = near_dups.deduplicated(frame, 2, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(50))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT marked(" in plan or "NOT pythonUDF" in plan
