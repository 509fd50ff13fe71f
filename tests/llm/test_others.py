"""Mixing, main text, top-k, token counts, licenses and the pipeline."""

from __future__ import annotations

import base64
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import html_text, licenses, mixing, token_counts, topk
from shelfwise.llm.shipping import ship
from shelfwise.llm.tables import table

# -- mixing


def test_margins_and_expected_tokens(spark, sf_dir):
    docs = mixing.described(table(spark, "/root/testdata/sf0.01", "documents"))
    cells = mixing.cells(docs)
    targets = {
        "source": mixing.tempered_targets(cells, "source"),
        "lang": spark.createDataFrame([("en", 0.4), ("de", 0.3), ("fr", 0.2), ("es", 0.1)], "value string, share double"),
        "topic": mixing.tempered_targets(cells, "topic", 0.0),
    }
    fitted = mixing.raked(cells, targets, rounds=12).cache()
    for name, target in targets.items():
        held = {r[0]: r[1] for r in fitted.groupBy(name).agg(F.sum("weight")).collect()}
        for row in target.collect():
            assert math.isclose(held[row["value"]], row["share"], abs_tol=2e-3)
    made = mixing.calibrated(fitted, 0.3)
    sums = made.agg(F.sum("tokens").alias("all"), F.sum(F.col("tokens") * F.col("probability")).alias("kept")).first()
    assert math.isclose(sums["kept"], 0.3 * sums["all"], rel_tol=1e-6)
    open_cells = made.filter((F.col("probability") > 0) & (F.col("probability") < 1))
    rate = open_cells.select((F.col("probability") * F.col("tokens") / F.col("weight")).alias("r"))
    low, high = rate.agg(F.min("r"), F.max("r")).first()
    assert math.isclose(low, high, rel_tol=1e-9)


def test_sampling_follows_the_probabilities(spark):
    rows = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.lit("a b c").alias("text"),
        F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("source"), F.lit("en").alias("lang"),
    )
    mixed = mixing.mixed(rows, rounds=3, keep_share=0.4)
    for row in mixed.groupBy("source").agg(F.avg("probability").alias("p"), F.avg(F.col("kept").cast("double")).alias("k")).collect():
        assert abs(row["p"] - row["k"]) < 0.03


def test_mixing_edge_rows(documents, clashing):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "x " * 100_000)]
    frame = documents(rows, **{c: F.lit("x") for c in clashing}).withColumn(
        "source", F.when(F.col("doc_id") == 3, F.lit(None)).otherwise(F.col("source"))
    )
    found = mixing.mixed(frame, rounds=2)
    assert found.count() == len(rows) and set(frame.columns) <= set(found.columns)
    assert all(r["kept"] is not None and 0 <= r["probability"] <= 1 for r in found.collect())
    assert {r["doc_id"]: r["n_tokens"] for r in found.collect()} == {1: 0, 2: 0, None: 2, 3: 2, 4: 100_000}
    assert mixing.mixed(documents([])).count() == 0


def test_margins_hold_with_the_defaults(spark):
    """A hot source nearly all in one language and topic, as are the others."""
    counts = [(s, lang, t, 20_000) for s in ("hot", "a", None) for lang in ("en", "de") for t in ("note", "prose")]
    counts += [("hot", "en", "prose", 300_000), ("a", "de", "note", 200_000), (None, "de", "prose", 100_000)]
    facts = spark.createDataFrame(counts, "source string, lang string, topic string, n_tokens long")
    found = mixing.fitted_cells(facts).cache()
    for name in mixing.DIMENSIONS:
        held = {r[0]: r[1] for r in found.groupBy(name).agg(F.sum("weight")).collect()}
        for row in mixing.tempered_targets(mixing.cells(facts), name).collect():
            assert math.isclose(held[row["value"]], row["share"], abs_tol=1e-8)


def test_rounds_leave_little_with_the_driver(spark, monkeypatch):
    """A round joins the sums of each dimension and nothing else; the driver is settled now and then."""
    rows = [(s, lang, t, 10 + k) for k, (s, lang, t) in enumerate((s, lang, t) for s in ("a", None) for lang in "xy" for t in "pq")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {name: mixing.tempered_targets(cells, name, 0.5) for name in mixing.DIMENSIONS}
    joins, settled = [], []
    staged, settle = mixing.stage, mixing.Staging.settle

    def noted(df, name):
        if name == "cells":
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return staged(df, name)

    monkeypatch.setattr(mixing, "stage", noted)
    monkeypatch.setattr(mixing.Staging, "settle", lambda self: (settled.append(1), settle(self)))
    fitted = mixing.raked(cells, targets, rounds=9)
    assert fitted.columns == [*mixing.DIMENSIONS, "tokens", "weight"] and fitted.count() == 8
    # the plan shows what a dimension starts from twice, for its sums and for its cells: 1, 3, 7 joins
    assert joins[1:] == [2 ** len(mixing.DIMENSIONS) - 1] * 8 and len(settled) == 3


def test_a_round_is_one_query(spark, monkeypatch):
    """How much a round changes is seen as it is written, and fitting ends as soon as nothing changes."""
    rows = [(s, lang, "p", n) for s, lang, n in (("a", "x", 30), ("a", "y", 10), (None, "x", 20), (None, "y", 5))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {name: mixing.tempered_targets(cells, name, 0.5) for name in mixing.DIMENSIONS}
    rounds, asked, staged = [], [], mixing.stage
    monkeypatch.setattr(mixing, "stage", lambda df, name: (rounds.append(name), staged(df, name))[1])
    first = type(cells).first
    monkeypatch.setattr(type(cells), "first", lambda self: (asked.append(1), first(self))[1])
    fitted = mixing.raked(cells, targets, strict=False)
    n = rounds.count("cells")
    assert 2 < n < mixing.MAX_ROUNDS and not asked
    assert fitted.count() == 4 and mixing.raked(cells.limit(0), targets).count() == 0
    again = {(r["source"], r["lang"]): r["weight"] for r in mixing.raked(cells, targets, rounds=n).collect()}
    assert {(r["source"], r["lang"]): r["weight"] for r in fitted.collect()} == pytest.approx(again)


def test_few_cells_are_fitted_without_a_shuffle(spark, monkeypatch):
    """Rounds over few cells shuffle nothing and join no goals; over many they stay spread out, with the same weights."""
    rows = [(s, lang, t, 10 + 7 * k) for k, (s, lang, t) in enumerate((s, lang, t) for s in ("a", None) for lang in "xy" for t in "pq")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").repartition(3)
    targets = {name: mixing.tempered_targets(cells, name, 0.5) for name in mixing.DIMENSIONS}
    plans, staged = [], mixing.stage

    def noted(df, name):
        if name == "cells":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(mixing, "stage", noted)
    found = []
    for most in (mixing.TASK_CELLS, 7):
        monkeypatch.setattr(mixing, "TASK_CELLS", most)
        plans.clear()
        found.append({r[:3]: r["weight"] for r in mixing.raked(cells, targets, rounds=3).collect()})
        shuffles = [plan.count("Exchange hashpartitioning") for plan in plans]
        assert shuffles == [0] * 3 if most > 7 else all(shuffles)
        assert [plan.count("HashJoin") + plan.count("SortMergeJoin") for plan in plans] == [7] * 3
    assert found[0] == pytest.approx(found[1]) and len(found[0]) == 8


def test_values_without_a_target_and_targets_without_a_value(spark):
    rows = [("a", "x", "p", 30), ("a", "y", "p", 10), (None, "x", "p", 20), ("b", "x", "p", 40), ("c", "y", "p", 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    goal = lambda rows: spark.createDataFrame(rows, "value string, share double")
    targets = {"source": goal([("a", 0.6), (None, 0.4), ("z", 5.0)]), "lang": goal([("x", 0.8), ("y", 0.2)]), "topic": goal([("p", 1.0)])}
    found = {(r["source"], r["lang"]): r["weight"] for r in mixing.raked(cells, targets, rounds=40).collect()}
    assert found["b", "x"] == 0 and found["c", "y"] == 0 and len(found) == 5
    assert math.isclose(found["a", "y"], 0.2, abs_tol=1e-9) and math.isclose(found["a", "x"] + found[None, "x"], 0.8, abs_tol=1e-9)


def test_contradicting_targets(spark, documents):
    """A language with one source of its own: own targets end in the nearest fit, a caller's raise."""
    rows = [("a", "en", "x", 900), ("a", "de", "x", 50), ("b", "fr", "x", 100), ("c", "de", "x", 70)]
    facts = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")
    cells = mixing.cells(facts)
    targets = {name: mixing.tempered_targets(cells, name) for name in mixing.DIMENSIONS}
    found = mixing.fitted_cells(facts)
    assert found.count() == 4 and found.filter("probability > 0").count() == 4
    off = {(r["dimension"], r["value"]): r["held"] - r["target"] for r in mixing.residuals(found, targets).collect()}
    assert abs(off["topic", "x"]) < 1e-9 and abs(off["source", "b"]) + abs(off["lang", "fr"]) > 1e-3
    with pytest.raises(ValueError, match="contradict"):
        mixing.raked(cells, targets)
    names = [("src0", "en"), ("src1", "de"), ("src2", "fr")]
    own = documents([(i, "some words " * (1 + i % 3)) for i in range(60)])
    for source, lang in names:
        own = own.withColumn("lang", F.when(F.col("source") == source, lang).otherwise(F.col("lang")))
    assert mixing.mixed(own).count() == 60


def test_calibration_goes_on_while_cells_fill_up(spark):
    """Each round fills one cell more."""
    rows = [("s", "en", str(k), 100, 100.0**-k) for k in range(20)]
    fitted = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, weight double")
    kept = mixing.calibrated(fitted, 0.95).agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    assert math.isclose(kept, 0.95 * 2000, rel_tol=1e-6)


# -- main text


@pytest.fixture(scope="module")
def pages(spark):
    ship(spark)
    return table(spark, "/root/testdata/sf0.01", "pages")


def test_main_text_is_the_article(pages):
    import html

    found = {r["page_id"]: r for r in html_text.extracted(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S).group(1)
        blocks = [
            " ".join(html.unescape(re.sub("<[^>]*>", "", part.replace("<br>", " "))).split())
            for part in re.split(r"</?(?:p|h1)>", article)
        ]
        expected = "\n".join(b for b in blocks if b)
        assert found[row["page_id"]]["text"] == expected
        assert found[row["page_id"]]["n_chars"] == len(expected)


def test_tree_messages_equal_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    parents = [-1, 0, 0, 1, 1, 4]
    features = [([k], [k + 10]) for k in range(6)]
    model = html_text.Model(rng.normal(size=html_text.BUCKETS).tolist(), 0.2, rng.normal(size=(2, 2)).tolist())
    total, content = 0.0, np.zeros(6)
    for labels in itertools.product((0, 1), repeat=6):
        own = sum(model.bias + model.weights[k] + model.weights[k + 10] for k, y in enumerate(labels) if y)
        p = math.exp(own + sum(model.edges[labels[parents[k]]][labels[k]] for k in range(1, 6)))
        total += p
        content += p * np.array(labels)
    assert np.allclose(html_text.marginals(model, features, parents), content / total)


def test_all_naming_words_count():
    """The telling word comes after twelve others in the alphabet."""
    words = "bg block border col d flex font gap grid h item m"

    def page(more):
        nodes, parents = html_text.flat(html_text.parsed(f'<div class="{words} {more}"><p>Some text here</p></div>'))
        return html_text.node_features(nodes, parents), parents

    own = set(page("sidebar")[0][1][0])
    assert len(own) == 2 + 13 and own != set(page("story")[0][1][0])
    examples = [(*page(word), [0] + [int(word == "story")] * 2) for word in ("sidebar", "story")] * 20
    model = html_text.train(examples)
    sure = {word: html_text.marginals(model, *page(word)) for word in ("sidebar", "story")}
    assert sure["sidebar"][1] < 0.5 < sure["story"][1] and sure["sidebar"][2] < 0.5 < sure["story"][2]


def test_page_edge_rows(spark, pages):
    rows = [
        (1, "u", None), (1, "u", ""), (None, None, "no markup at all"), (2, "u", "<p>a &am"), (3, "u", "<" * 50 + "p"),
        (4, "u", "<div>" * 3000 + "deep"), (5, "u", "<script>if (a<b) x('</p>')"), (6, "u", "<a href='x\">y"),
    ]
    extra = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(7))
    model = html_text.trained_model(pages, 50)
    found = html_text.extracted(extra, model).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    texts = {r["page_id"]: r["text"] for r in found}
    assert texts[None] == "no markup at all" and texts[1] == "" and texts[5] == ""
    assert html_text.extracted(extra.limit(0), model).count() == 0
    assert html_text.extracted(extra.limit(0)).count() == 0


# -- top k


def brute_top(vectors, k=5):
    whole = {}
    for n, (i, v) in enumerate(vectors):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[n] = (i, [math.floor(256 * x) for x in v])
    out = []
    for i, q in whole.values():
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole.values() if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [5, 4096])
def test_top_k_equals_brute_force(spark, monkeypatch, size):
    ship(spark)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", size)
    monkeypatch.setattr(topk, "QUERY_ROWS", size)
    monkeypatch.setattr(topk, "COLUMN_BLOCKS", 1)
    rng = random.Random(6)
    vectors = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1), 0.5]) for _ in range(12)]) for i in range(240)]
    vectors += [(300 + i, [0.5] * 12) for i in range(20)]
    vectors += [
        (400, None), (450, [0.1, None]), (500, [float("nan")]), (550, [float("inf")] * 12), (None, [1.0] * 12),
        (600, []), (650, [0.25, 0.5]), (651, [1000000.0] * 12),
    ]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
    found = topk.exact_top_k(frame, F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute_top(vectors)
    few = [(0, [1.0]), (1, [2.0]), (50, [1.0])]
    frame = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.exact_top_k(frame, F.col("vec_id") % 50 == 0).collect()) == brute_top(few)
    assert topk.exact_top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_blocks_dealt_out_are_never_broadcast(spark):
    """Copies for every line are not in the size Catalyst goes by."""
    ship(spark)
    frame = spark.createDataFrame([(i, [0.5, i / 7]) for i in range(100)], "vec_id long, embedding array<double>")
    plan = topk.exact_top_k(frame, F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("largest, width", [(32767, 2), (-32768, 4), (1 << 31, 8), (1 << 40, 8)])
def test_weights_are_kept_as_they_are(largest, width):
    weights = topk._narrowed(np.array([1, -2, largest], dtype=np.int64))
    rows = np.arange(3, dtype=np.int32)
    held = topk.Postings(b"", b"", b"", rows.tobytes(), weights.tobytes())
    assert weights.dtype.itemsize == width
    assert held.weights.tolist() == [1, -2, largest] and held.largest == abs(largest)


@pytest.mark.parametrize("share", [0.1, 0.6, 1.0])
def test_lists_of_some_most_or_all_rows(share):
    """Accumulated term by term, whether lists are filled up or not, against a product of matrices."""
    rng = np.random.default_rng(6)
    queries, candidates = (rng.integers(-9, 9, (n, 7)) * (rng.random((n, 7)) < share) for n in (5, 40))
    lists = lambda m: {t: (np.flatnonzero(m[:, t]), m[m[:, t] != 0, t]) for t in range(7)}
    block = topk.Postings(np.arange(40).tobytes(), b"", b"", b"", b"")
    of = lists(candidates)
    block.rows, block.weights = (np.concatenate([of[t][i] for t in range(7)]) for i in (0, 1))
    ends = np.cumsum([len(of[t][0]) for t in range(7)])
    block.lists = {t: slice(int(ends[t] - len(of[t][0])), int(ends[t])) for t in range(7)}
    for kind in (np.int32, np.int64):
        assert (topk.accumulated(lists(queries), 5, block, kind) == queries @ candidates.T).all()


# -- token counts


@pytest.mark.parametrize("run", [1, 3, 256])
def test_counts_of_flat_files(spark, monkeypatch, tmp_path, run):
    """Raw files cut into tiny blocks against a split of the whole file."""
    ship(spark)
    monkeypatch.setattr(token_counts, "RUN_BLOCKS", run)
    rng = np.random.default_rng(run)
    files = [
        rng.choice([7, 8, 9], size=300, p=[0.1, 0.5, 0.4]), np.array([7, 7, 8]), np.array([8] * 50), np.array([7]), np.array([8, 7]),
    ]
    for k, tokens in enumerate(files):
        (tmp_path / f"f{k}").write_bytes(tokens.astype("<u4").tobytes())
    (tmp_path / "empty").write_bytes(b"")
    blocks = token_counts.read_flat_files(spark, str(tmp_path), block_bytes=16)
    found = token_counts.token_counts(blocks, separator=7, width="<u4").collect()
    for k, tokens in enumerate(files):
        text = "".join("|" if t == 7 else "x" for t in tokens).split("|")
        expected = [(i, len(p), True) for i, p in enumerate(text[:-1])] + ([(len(text) - 1, len(text[-1]), False)] if text[-1] else [])
        own = sorted((r["ordinal"], r["n_tokens"], r["ended"]) for r in found if r["file"].endswith(f"f{k}"))
        assert own == expected
    assert not [r for r in found if r["file"].endswith("empty")]


def test_very_long_runs_keep_their_tokens(documents):
    """Runs that the encoder's pattern cannot take whole, and shorter ones it can."""
    import tiktoken

    with open(token_counts.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.read().splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=token_counts.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = token_counts.LONG_RUN
    for run in (" ", "\n", "\t", "\u3000", " \n", "\xa0"):
        for n in (size - 1, size, size + 1, 2 * size):
            for before, behind in (("", ""), ("a", ""), ("", "b"), ("a.", " b"), ("x" * 50, "9"), ("\x1c", "\x1f"), ("a", "'s")):
                text = before + run * n + behind
                assert token_counts._ids(encoding, text) == encoding.encode_ordinary(text)
    rows = [(1, " " * 2_000_000), (2, "\n" * 1_000_000 + "x"), (3, "w" * 1_000_000), (4, ("word" + " " * 5000) * 300)]
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.document_token_counts(documents(rows)).collect()}
    assert set(found) == {1, 2, 3, 4} and min(found.values()) > 1000


def test_document_counts_equal_the_tokenizer(documents, clashing, monkeypatch):
    import tiktoken

    with open(token_counts.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=token_counts.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["été", "the", "<|endoftext|>", "x9", "\n"]) for _ in range(rng.randrange(200)))) for k in range(60)]
    rows += [(100, None), (101, ""), (None, "a b c"), (102, "word " * 3000), (5, "again five")]
    blocks = token_counts.flat_files(documents(rows, **{c: F.lit("x") for c in clashing}).repartition(3), block_tokens=64)
    found = token_counts.token_counts(blocks).select("doc_id", "n_tokens").collect()
    expected = [(str(i), len(encoding.encode_ordinary(t or ""))) for i, t in rows]
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in found) == sorted(expected)
    assert token_counts.document_token_counts(documents([])).count() == 0


# -- licenses


def test_every_template_is_found_in_running_text(documents):
    rng = random.Random(9)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "the", "of", "été"]) for _ in range(n))
    names = sorted(licenses.TEMPLATES)
    rows = [(k, f"{filler(k % 40)} {licenses.TEMPLATES[name].upper() if k % 2 else licenses.TEMPLATES[name]}\n{filler(80)}") for k, name in enumerate(names * 4)]
    rows += [(1000 + k, filler(120)) for k in range(20)]
    found = {r["doc_id"]: r["licenses"].split(",") for r in licenses.licenses(documents(rows)).collect()}
    for k, name in enumerate(names * 4):
        assert name in found[k]
    assert all(found[1000 + k] == [""] for k in range(20))


def test_edited_copies_and_pieces(documents):
    words = licenses.TEMPLATES["mit-permission"].split()
    edited = list(words)
    edited[40] = "CHANGED"
    rows = [(1, " ".join(edited)), (2, " ".join(words[:50])), (3, " ".join(words[20:30])), (4, "x " * 50 + " ".join(edited) + " y" * 50)]
    found = {r["doc_id"]: r["licenses"] for r in licenses.licenses(documents(rows)).collect()}
    assert found == {1: "mit-permission", 2: "", 3: "", 4: "mit-permission"}


def test_gate_words_meet_every_sufficient_part():
    gate = set(licenses.gate_words(licenses.TEMPLATES))
    for text in licenses.TEMPLATES.values():
        words = licenses.plain_words(text)
        size = min(licenses.SHINGLE_WORDS, len(words))
        shingles = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        without = [s for s in shingles if not gate & set(s)]
        assert 100 * len(without) < licenses.PERCENT * len(shingles)


def test_license_edge_rows(documents, clashing):
    rows = [(1, None), (2, ""), (None, "All rights reserved."), (3, "reserved rights all"), (4, "z " * 60_000 + "all rights RESERVED")]
    frame = documents([*rows, (5, "a"), (5, "a")], **{c: F.lit("x") for c in clashing})
    found = sorted((str(r["doc_id"]), r["n_licenses"], r["licenses"]) for r in licenses.licenses(frame).collect())
    hit = "all-rights-reserved"
    assert found == [("1", 0, ""), ("2", 0, ""), ("3", 0, ""), ("4", 1, hit), ("5", 0, ""), ("None", 1, hit)]
    assert licenses.licenses(documents([])).count() == 0
    assert [r["n_licenses"] for r in licenses.licenses(documents(rows[:1]), {}).collect()] == [0]


def test_license_plan_has_no_python(documents):
    plan = licenses.licenses(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


# -- pipeline


def test_pipeline(spark, sf_dir):
    """Every stage's decisions hold in what the next one reads."""
    docs = table(spark, sf_dir, "documents")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stage(step(spark, docs, sf_dir), name)
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] and counts[0] > counts[1] > counts[2] > counts[3] > counts[5] > 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r["doc_id"] for r in docs.collect()}
