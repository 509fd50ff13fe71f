"""Pairing rules from a table, and replies told by their prompts."""

from __future__ import annotations

import random

import pytest

import shelfwise
from shelfwise import fixed_values as fixed
from shelfwise.operators import rule_tables

RULES = shelfwise.InsightConfig(fallback_to_rules=True)


def product(k, *tags):
    return {"barcode": str(k), "product_name": f"Food {k}", "categories_tags": list(tags)}


def rules_of(spark, *rows):
    return spark.createDataFrame(list(rows), rule_tables.RULE_SCHEMA)


def paired(catalog, rules):
    return {r.barcode: r.pairings for r in shelfwise.pair(catalog, config=RULES, rules=rules).collect()}


def test_the_fixed_rules_as_a_table_give_the_same(spark, products):
    words = [*fixed.CATEGORY_PAIRINGS, "ham", "x", "", "peanut-butters", "snacks", "é"]
    rng = random.Random(1)
    tag = lambda: "en:" + "".join(rng.sample(["-", "a", "s", "", rng.choice(words)], 5))
    catalog = products(*[product(k, *(tag() for _ in range(rng.randint(0, 4)))) for k in range(300)])
    plain = {r.barcode: r.pairings for r in shelfwise.pair(catalog, config=RULES).collect()}
    assert paired(catalog, shelfwise.fixed_rules(spark)) == plain
    assert len({tuple(v) for v in plain.values()}) > 20


@pytest.mark.parametrize("seed", [1, 2])
def test_longest_key_then_position(spark, products, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abc") for _ in range(n))
    rows = [(text(rng.randint(1, 7)), rng.randrange(50), [f"item{k}"]) for k in range(60)]
    catalog = {str(k): [text(rng.randint(1, 9)) for _ in range(3)] for k in range(80)}

    def best(slugs):
        fits = [(-len(key), at, key, items) for key, at, items in rows if any(key in s for s in slugs)]
        return min(fits)[3] if fits else fixed.DEFAULT_PAIRINGS

    found = paired(products(*[product(k, *(f"en:{s}" for s in v)) for k, v in catalog.items()]), rules_of(spark, *rows))
    assert found == {k: best(v) for k, v in catalog.items()}


def test_empty_null_and_unmatched_keys(spark, products):
    catalog = products(product(1, "en:jams"), product(2, "en:oils"), product(3), product(4, "fr:"))
    rules = rules_of(spark, ("", 0, ["none"]), (None, 1, ["null"]), ("jam", 2, ["toast"]), ("jamsession", 3, ["x"]), ("oi", 4, ["salad"]))
    default = fixed.DEFAULT_PAIRINGS
    assert paired(catalog, rules) == {"1": ["toast"], "2": ["salad"], "3": default, "4": default}
    assert set(map(tuple, paired(catalog, rules.limit(0)).values())) == {tuple(default)}


def test_a_large_table_plans_no_nested_loop(spark, products):
    rules = spark.range(100_000).selectExpr(
        "concat('key-', cast(id AS string)) AS key", "cast(id AS int) AS position", "array(concat('item ', cast(id AS string))) AS items"
    )
    catalog = products(*[product(k, f"en:some-key-{k * 997}-goods", "en:plain") for k in range(50)])
    found = shelfwise.pair(catalog, config=RULES, rules=rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.barcode: r.pairings for r in found.collect()} == {str(k): [f"item {k * 997}"] for k in range(50)}


def test_replies_go_with_the_prompt_they_answer(spark, products):
    before = products(product(1, "en:jams"), product(2, "en:oils"))
    now = products(product(1, "en:jams", "en:berry-jams"), product(2, "en:oils"))
    asked = shelfwise.with_hash(shelfwise.prompts(before))
    replies = asked.selectExpr("task", "prompt_hash", "1 AS attempt", "concat('about ', barcode) AS reply")
    current = shelfwise.current_replies(shelfwise.prompts(now), replies)
    tasks = {(r.barcode, r.task) for r in current.collect()}
    assert ("2", "summary") in tasks and ("1", "summary") not in tasks
    texts = {r.barcode: r.summary for r in shelfwise.summarise(now, current, RULES).collect()}
    assert texts["2"] == "about 2" and texts["1"].startswith("Food 1")


def test_only_unanswered_prompts_are_asked_and_twice_at_most(spark):
    prompts = spark.createDataFrame(
        [("1", "pairings", "p1"), ("2", "pairings", "p2"), ("3", "pairings", "p3"), ("4", "pairings", "p1"), ("1", "summary", "s1"),
         ("2", "summary", "s2"), ("3", "summary", "s3")],
        "barcode string, task string, prompt string",
    )
    text = {"p1": [None], "p2": ["no json", '{"pairings": []}'], "p3": ["x", '{"pairings": ["Rice"]}'], "s1": ["Text."], "s2": [None]}
    rows = [("pairings" if p[0] == "p" else "summary", p, n, r) for p, replies in text.items() for n, r in enumerate(replies, 1)]
    replies = spark.createDataFrame(rows, "task string, prompt string, attempt int, reply string")
    replies = shelfwise.with_hash(replies).drop("prompt")
    found = shelfwise.unanswered(prompts, replies).collect()
    assert sorted((r.task, r.prompt, r.attempt) for r in found) == [("pairings", "p1", 2), ("summary", "s2", 2), ("summary", "s3", 1)]
    assert shelfwise.unanswered(prompts, replies.limit(0)).count() == 6
