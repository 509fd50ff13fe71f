from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import spelling
from shelfwise.llm.shipping import ship

ASCII_LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def brute(rows, least_letters=5, least_n=3, misspell=None):
    """word -> (form, root, n, n_near, form_n), by all words one edit away."""
    counts = Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if misspell and h % misspell == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least_letters:
                counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= least_n}
    near = {w: [v for v in words if edits(w, v) == 1] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
    return line[-1]


def as_dict(found):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()}


def corpus(seed, alphabet="abné", words=60, n=400):
    """Texts of words over few letters, so that many are anagrams or one edit apart."""
    rng = random.Random(seed)
    known = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(words)]
    pick = lambda: known[int(rng.random() ** 3 * len(known))]
    return [(i, " ".join(pick() if rng.random() < 0.8 else pick().upper() for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("seed, least_letters, misspell", [(1, 5, 97), (2, 5, 7), (3, 1, 5), (4, 2, None)])
def test_equals_brute_force(documents, seed, least_letters, misspell):
    rows = corpus(seed)
    found = spelling.spelling_variants(documents(rows), least_letters, 3, misspell)
    assert as_dict(found) == brute(rows, least_letters, 3, misspell)


def test_whole_table_equals_brute_force(spark, sf_dir):
    ship(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert as_dict(spelling.spelling_variants(documents, least_n=12, misspell=97)) == brute(rows, 5, 12, 97)


def test_all_kinds_of_edits_and_chains(documents):
    text = " ".join(["garden"] * 40 + ["gardan"] * 20 + ["gurdan"] * 10 + ["garde"] * 9 + ["gardens"] * 8 + ["danger"] * 30)
    found = as_dict(spelling.spelling_variants(documents([(1, text)])))
    assert found == brute([(1, text)])
    assert found["gurdan"][:2] == ("gardan", "garden")  # a chain
    assert found["garde"][0] == found["gardens"][0] == "garden"
    assert found["danger"][3] == 0  # an anagram is not near


def test_ties_go_to_the_first_word(documents):
    text = " ".join(["bbbbb"] * 6 + ["bbbbc"] * 6 + ["bbbbd"] * 3)
    found = as_dict(spelling.spelling_variants(documents([(1, text)])))
    assert found["bbbbd"][0] == "bbbbb" and found["bbbbb"][0] is None


@pytest.mark.parametrize("word_bytes", [3, 64, 65, 300])
def test_checksums_of_long_words(documents, word_bytes):
    rows = [(i, "w" * word_bytes) for i in range(200)]
    assert as_dict(spelling.spelling_variants(documents(rows), 1, 1, 3)) == brute(rows, 1, 1, 3)


def test_nulls_empty_and_very_long_texts(documents):
    rows = [(None, "words words words words"), (1, None), (2, ""), (3, " \t123"), (4, "many words " * 200_000), (4, "word×s " * 3)]
    assert as_dict(spelling.spelling_variants(documents(rows), misspell=97)) == brute(rows, misspell=97)


def test_letters_beyond_the_pattern_end_a_word(documents):
    rows = [(1, "naïvełabcde 中abcdef’ghijk \U0001f600zzzzz " * 3)]
    assert as_dict(spelling.spelling_variants(documents(rows))) == brute(rows)


def test_clashing_columns_and_an_empty_table(documents, clashing):
    rows = corpus(5, n=50)
    more = {name: F.lit(1) for name in [*clashing, "word", "n", "form", "root"]}
    assert as_dict(spelling.spelling_variants(documents(rows, **more))) == brute(rows)
    assert spelling.spelling_variants(documents([])).collect() == []


def test_a_word_of_a_third_of_all_rows_is_counted_before_the_shuffle(documents):
    rows = [(i, "common " * 50 + f"rare{'abcde'[i % 5] * 5}") for i in range(600)]
    assert as_dict(spelling.spelling_variants(documents(rows)))["common"][2] == 30_000


def test_near_words_are_any_words(spark, documents):
    documents([])  # ships the code
    words = ["", None, "a", "b", "ab", "ba", "中文", "中文字", "x" * 2000, "x" * 1999 + "y"]
    found = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    known = [w for w in words if w]
    assert {tuple(sorted(p)) for p in found} == {tuple(sorted((a, b))) for a in known for b in known if a < b and edits(a, b) == 1}
    assert len(found) == len({tuple(sorted(p)) for p in found})


def test_signatures_and_words_are_never_broadcast(spark, documents, monkeypatch):
    """A word has many signatures, which are not in the size Catalyst goes by."""
    found = spark.createDataFrame([("heart",), ("heat",), ("beat",)], "word string")
    plan = spelling.near_words(found)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    plans, table = [], spelling.Staging.table

    def noted(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, name)

    monkeypatch.setattr(spelling.Staging, "table", noted)
    texts = ["heart heart heart heart heart heart heart heart heart heart", "hearts hearts hearts hearts", "heartsy"]
    rows = as_dict(spelling.spelling_variants(documents(list(enumerate(texts))), least_n=1))
    assert {w: r[1] for w, r in rows.items()} == {"heart": "heart", "hearts": "heart", "heartsy": "heart"}
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
