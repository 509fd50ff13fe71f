"""Prompts out, replies in."""

import json

import pytest
from pyspark.sql import functions as F

import shelfwise
from shelfwise import fixed_values as fixed
from shelfwise.functions import replies as reply_fn
from shelfwise.sources.schema import REPLY_SCHEMA

RULES = shelfwise.InsightConfig(fallback_to_rules=True)
CANDY = ["en:snacks", "en:candies"]
SOUP = ["en:soups"]
FILLED = fixed.CANDY_FILLERS[:5]


def replies(spark, *rows):
    """Rows (product number, task, reply[, attempt])."""
    return spark.createDataFrame(
        [(f"{n:013d}", task, (more or [1])[0], reply) for n, task, reply, *more in rows], REPLY_SCHEMA
    )


def pairings(spark, products, tags, *texts, config=RULES):
    catalog = products({"categories_tags": tags})
    rows = [(0, "pairings", text, attempt) for attempt, text in enumerate(texts, 1)]
    return shelfwise.pair(catalog, replies(spark, *rows), config).first().pairings


def listing(*items):
    return json.dumps({"pairings": list(items)})


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('{"pairings": ["a", " B "]}', ["a", "b"]),
        ('Sure!\n```json\n{"pairings":\n ["a"]}\n```', ["a"]),
        ('{"pairings": ["a"]} tail }', []),
        ('{"pairings": ["a"]},{"x": 1}', []),
        ('{"pairings": ["x"]}], Option B: [{"pairings": ["y"]}', []),
        ('{"pairings": ["x"]}]}', []),
        ('{"pairings": ["x"]}}, {"y": 1}', []),
        ('{"pairings": ["a", ', []),
        ('{"pairings": [1, null, true, ["x"], {"y": 1}, "", "  ", "b"]}', ["b"]),
        ('{"pairings": "a"}', []),
        ('{"pairings": {"a": 1}}', []),
        ('{"other": ["a"]}', []),
        ("no object", []),
        ("", []),
        (None, []),
    ],
)
def test_pairing_items(spark, text, expected):
    df = spark.createDataFrame([(text,)], "reply string")
    assert df.select(reply_fn.pairing_items(F.col("reply"))).first()[0] == expected


@pytest.mark.parametrize(
    ("reply", "risks", "positives"),
    [
        ({"enhanced_risks": ["", "a", "b"], "enhanced_positives": ["c", "d", "e"]}, ["a"], ["c", "d"]),
        ({"enhanced_risks": [1, " "], "enhanced_positives": ["", "c"]}, [" "], ["c"]),
        ({"enhanced_risks": None, "enhanced_positives": ["c"]}, [], []),
        ({"enhanced_risks": ["a"], "enhanced_positives": 3}, [], []),
        ({"enhanced_risks": ["a"], "enhanced_positives": False}, [], []),
        ({"enhanced_risks": "text", "enhanced_positives": ["c"]}, [], ["c"]),
        ({"enhanced_risks": {"x": 1}, "enhanced_positives": ["c"]}, [], ["c"]),
        ({"enhanced_positives": ["c"]}, [], ["c"]),
    ],
)
def test_insight_items(spark, reply, risks, positives):
    df = spark.createDataFrame([(json.dumps(reply),)], "reply string")
    items = df.select(reply_fn.insight_items(F.col("reply"))).first()[0]
    assert (items.risks, items.positives) == (risks, positives)


def test_pairings_come_from_the_reply(spark, products):
    many = listing("Bread", " bread", "Tea", "c", "d", "e", "f")
    assert pairings(spark, products, SOUP, many) == ["bread", "tea", "c", "d", "e"]
    assert pairings(spark, products, SOUP, "junk") == fixed.CATEGORY_PAIRINGS["soups"]
    assert pairings(spark, products, SOUP, "junk", config=shelfwise.InsightConfig()) == []
    assert pairings(spark, products, None, many) == fixed.DEFAULT_PAIRINGS


def test_second_attempt_counts_if_the_first_is_unusable(spark, products):
    assert pairings(spark, products, SOUP, "junk", listing("second")) == ["second"]
    assert pairings(spark, products, SOUP, listing("first"), listing("second")) == ["first"]
    assert pairings(spark, products, SOUP, "junk", None, listing("third")) == fixed.CATEGORY_PAIRINGS["soups"]


def test_sweets_get_simple_pairings(spark, products):
    reply = listing("Steak", "Fruit salad", "Fruit tea", "Water")
    assert pairings(spark, products, CANDY, reply) == [
        "fruit salad", "water", "fresh fruit", "fresh citrus slices", "plain yogurt"
    ]
    nuts = [f"nuts {n}" for n in range(7)]
    assert pairings(spark, products, CANDY, listing(*nuts)) == nuts[:5]


def test_sweets_asked_in_vain_are_filled_up_but_not_if_never_asked(spark, products):
    assert pairings(spark, products, CANDY, None) == FILLED
    assert pairings(spark, products, CANDY, "junk") == FILLED
    assert pairings(spark, products, CANDY) == fixed.DEFAULT_PAIRINGS
    assert pairings(spark, products, CANDY, config=shelfwise.InsightConfig()) == []


def test_blank_last_category_is_not_asked_about(spark, products):
    tags = ["en:candies", "fr:"]
    assert pairings(spark, products, tags, listing("water"), config=shelfwise.InsightConfig()) == []
    assert pairings(spark, products, tags, listing("water")) == fixed.DEFAULT_PAIRINGS


def test_insights_are_checked_against_the_nutrients(spark, products):
    poor = {"nutriments": {"sugars_100g": 30, "proteins_100g": 10, "fiber_100g": 6}}
    rich = {"nutriments": {"sugars_100g": 5, "proteins_100g": 10.1, "fiber_100g": 6.1}}
    reply = json.dumps({"enhanced_risks": ["Salty"], "enhanced_positives": ["Plant protein", " Fiber source "]})
    low = json.dumps({"enhanced_positives": ["Very LOW SUGAR", "Fine"]})
    again = json.dumps({"enhanced_positives": ["HIGH FIBER", "Fresh", "Never reached"]})
    twice = json.dumps({"enhanced_positives": ["Fresh", " fresh "]})
    catalog = products(
        poor, rich, {**rich, "categories_tags": CANDY}, poor, rich, rich, poor
    )
    found = shelfwise.analyse(
        catalog,
        replies(spark, *[(n, "insights", t) for n, t in enumerate([reply, reply, reply, low, again, twice])]),
        RULES,
    ).orderBy("barcode").collect()
    rules = shelfwise.analyse(catalog, config=RULES).orderBy("barcode").collect()
    more = [
        (f.risk_indicators[len(r.risk_indicators):], f.positive_indicators[len(r.positive_indicators):])
        for f, r in zip(found, rules)
    ]
    assert more == [
        (["Salty"], []), (["Salty"], ["Plant protein", "Fiber source"]), (["Salty"], ["Fiber source"]),
        ([], ["Fine"]), ([], ["Fresh"]), ([], ["Fresh"]), ([], []),
    ]


def test_text_replies(spark, products):
    catalog = products({"nutriscore_grade": "A", "nova_group": "1"}, {"nutriscore_grade": "x", "nova_group": "7"}, {})
    given = replies(spark, *[(n, task, " Said.\n") for n in (0, 1) for task in ("summary", "nutriscore", "nova")],
                    (2, "summary", "  "))
    texts = shelfwise.explain(catalog, given).orderBy("barcode").collect()
    assert [(t.nutriscore, t.nova) for t in texts] == [
        ("Said.", "Said."),
        (fixed.NUTRISCORE_UNAVAILABLE, fixed.NOVA_UNAVAILABLE),
        (fixed.NUTRISCORE_UNAVAILABLE, fixed.NOVA_UNAVAILABLE),
    ]
    summaries = shelfwise.summarise(catalog, given, RULES).orderBy("barcode").collect()
    assert [s.summary for s in summaries] == ["Said.", "Said.", "This product is a food product."]


def test_prompts(products, seed_spread):
    catalog = products(
        {**seed_spread, "nutriments": {**seed_spread["nutriments"], "salt_100g": 0.0005, "carbohydrates_100g": 0,
                                         "proteins_100g": None, "proteins": 3}},
        {"categories_tags": ["en:a", "fr:"], "nutriscore_grade": "x", "product_name": ""},
        {"nutriscore_grade": "b", "nova_group": "2", "product_name": ""},
    )
    rows = {(r.barcode, r.task): r.prompt for r in shelfwise.prompts(catalog).collect()}
    tasks = [[t for b, t in sorted(rows) if b.endswith(str(n))] for n in range(3)]
    assert tasks == [
        ["insights", "nova", "nutriscore", "pairings", "summary"],
        ["insights", "summary"],
        ["insights", "nova", "nutriscore", "summary"],
    ]
    first = {task: rows["0" * 13, task] for task in tasks[0]}
    assert "Category: spreads\nNutrients:\n  - Energy: 401.0g/100g\n  - Fat: 20.5g/100g\n  - Fiber: 6.0g/100g\n\nReturn" in first["pairings"]
    assert "combinations for spreads." in first["pairings"] and '{\n  "pairings": ["food1"' in first["pairings"]
    assert "Category: spreads\nNutriScore: C\nNOVA Group: 4\n" in first["summary"]
    assert "- Protein: 3.0g\n" in first["nutriscore"] and first["nutriscore"].endswith("products.\n")
    assert "NOVA Group: 4 (ultra-processed food)\nAdditives: 2\n" in first["nova"]
    assert (
        "Nutrients (per 100g): {'fat': 20.5, 'sugar': 15.0, 'salt': 0.0005, 'protein': 3.0, 'fiber': 6.0, 'saturated_fat': 5.5}"
        in first["insights"]
    )
    assert "Risks: ['High fat', 'High saturated fat', " in first["insights"]
    assert "Positives: ['Balanced" not in first["insights"] and "Positives: None detected" in first["insights"]
    blank = rows["0000000000001", "summary"]
    assert "Product: This product\nCategory: \nNutriScore: X\nNOVA Group: Unknown\n" in blank
    assert "Product: \nNutriScore: B" in rows["0000000000002", "nutriscore"]
    assert "Product: product\nCategory: food\n" in rows["0000000000002", "insights"]
    only = shelfwise.prompts(catalog, tasks=["nova"])
    assert {r.task for r in only.collect()} == {"nova"}


def test_a_null_reply_hides_no_real_one(spark, products):
    rows = replies(
        spark, (0, "summary", None, 1), (0, "summary", "Good text", 2), (0, "nova", None), (0, "nutriscore", "Later", 2),
        (0, "nutriscore", "First", 1), (0, "insights", None, 1), (0, "insights", '{"enhanced_risks": ["Watch it"]}', 2),
    )
    catalog = products({"nutriscore_grade": "a", "nova_group": "4"})
    assert shelfwise.summarise(catalog, rows).first().summary == "Good text"
    assert shelfwise.explain(catalog, rows).first().nutriscore == "First"
    assert shelfwise.explain(catalog, rows).first().nova == fixed.NOVA_UNAVAILABLE
    assert "Watch it" in shelfwise.analyse(catalog, rows).first().risk_indicators


def test_two_bracketed_options_are_no_insights(spark, products):
    text = '{"enhanced_positives": ["Great taste"]}], or [{"enhanced_risks": ["x"]}'
    row = shelfwise.analyse(products({}), replies(spark, (0, "insights", text))).first()
    assert "Great taste" not in row.positive_indicators


def test_repeats_are_dropped_in_lists_of_any_length(spark):
    df = spark.createDataFrame([(["a", "B", "A", "b", "c", "a"],)], "items array<string>")
    assert df.select(reply_fn.without_repeat("items")).first()[0] == ["a", "B", "c"]
