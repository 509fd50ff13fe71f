"""Indicators, explanations, summaries and rule pairings."""

import pytest

import shelfwise
from shelfwise import fixed_values as fixed

RULES = shelfwise.InsightConfig(fallback_to_rules=True)


def indicators(catalog):
    rows = shelfwise.analyse(catalog, config=RULES).orderBy("barcode").collect()
    return [(r.risk_indicators, r.positive_indicators) for r in rows]


def test_fixture_indicators(products, seed_spread, flakes):
    assert indicators(products(seed_spread, flakes)) == [
        (
            ["High fat", "High saturated fat", "High calorie density", "Ultra-processed food (NOVA 4)"],
            ["High protein"],
        ),
        (
            [],
            ["High protein", "Low sugar content", "High fiber", "Organic label",
             "Balanced fat, sugar, and salt levels", "Minimally processed (NOVA 1)", "Good NutriScore (A)"],
        ),
    ]


def test_thresholds_are_strict(products):
    at = {"fat_100g": 20, "sugars_100g": 15, "salt_100g": 1.5, "saturated-fat_100g": 5,
          "proteins_100g": 10, "fiber_100g": 6, "energy-kcal_100g": 400}
    above = {k: v + 0.1 for k, v in at.items()}
    got = indicators(products({"nutriments": at}, {"nutriments": above}, {"nutriments": {"sugars_100g": 5}}, {}))
    balanced = "Balanced fat, sugar, and salt levels"
    assert got == [
        ([], [balanced]),
        (["High fat", "High sugar", "High salt", "High saturated fat", "High calorie density"], ["High protein", "High fiber"]),
        ([], ["Low sugar content", balanced]),
        ([], ["Low sugar content", balanced]),
    ]


def test_nova_additives_labels_and_grade(products):
    six, five = [f"en:e{n}" for n in range(6)], [f"en:e{n}" for n in range(5)]
    sugary = {"sugars_100g": 16}
    got = indicators(products(
        {"nova_group": "5", "additives_tags": six, "nutriments": sugary},
        {"nova_group": "2", "additives_tags": five, "labels_tags": ["en:biodegradable", "en:FairTrade-x"], "nutriments": sugary},
        {"nutriscore_grade": " B ", "labels_tags": None, "additives_tags": None, "nutriments": sugary},
    ))
    assert got == [
        (["High sugar", "Ultra-processed food (NOVA 4)", "Many additives (6 found)"], []),
        (["High sugar"], ["Organic label", "Fair trade certified", "Processed culinary ingredient (NOVA 2)"]),
        (["High sugar"], ["Good NutriScore (B)"]),
    ]


def test_fixture_explanations(products, seed_spread, flakes):
    rows = shelfwise.explain(products(seed_spread, flakes, {}), config=RULES).orderBy("barcode").collect()
    assert rows[0].nutriscore == (
        "NutriScore C means moderate nutritional quality. This product has high fat content, "
        "high saturated fat, good protein content."
    )
    assert rows[0].nova.startswith("NOVA Group 4: This product is classified as a ultra-processed food. Ultra-")
    assert rows[0].nutrient_density == "Energy: 401 kcal per 100 g. Protein: 12.2 g per 100 g. Fiber: 6.0 g per 100 g."
    assert rows[1].nutriscore == (
        "NutriScore A means excellent nutritional quality. This product has good dietary fiber, good protein content."
    )
    assert rows[1].nova == (
        "NOVA Group 1: This product is classified as a unprocessed or minimally processed food. "
        "These foods are in their natural state with minimal processing."
    )
    assert [rows[2].nutriscore, rows[2].nova, rows[2].nutrient_density] == [
        fixed.NUTRISCORE_MISSING, fixed.NOVA_MISSING, fixed.DENSITY_MISSING
    ]


def test_good_protein_density(products):
    rows = shelfwise.explain(products({"nutriments": {"energy-kcal_100g": 99.5, "proteins_100g": 5.25}})).collect()
    assert rows[0].nutrient_density == (
        "Energy: 100 kcal per 100 g. Protein: 5.2 g per 100 g. Good protein-to-calorie ratio."
    )


def test_fixture_summaries(products, seed_spread, flakes):
    catalog = products(seed_spread, flakes, {"product_name": "", "nova_group": "3"}, {"nutriscore_grade": "unknown"})
    rows = shelfwise.summarise(catalog, config=RULES).orderBy("barcode").collect()
    assert [r.summary for r in rows] == [
        "Roasted Seed Spread is a product with moderate nutritional quality (NutriScore C). It is classified "
        "as an ultra-processed food, which may contain additives, artificial flavors, and emulsifiers. It contains "
        "high levels of fat, a good source of protein. Contains allergens: sesame seeds, nuts.",
        "Barley Flakes is a product with excellent nutritional quality (NutriScore A). It is unprocessed or minimally "
        "processed food with little to no industrial processing. It contains a good source of protein. "
        "Contains allergens: gluten.",
        "This product is a food product. It is a processed food.",
        "This product is a food product.",
    ]


def test_without_fallback_texts_are_unavailable(products, flakes):
    catalog = products(flakes)
    assert shelfwise.summarise(catalog).first().summary == fixed.SUMMARY_UNAVAILABLE
    first = shelfwise.explain(catalog).first()
    assert (first.nutriscore, first.nova) == (fixed.NUTRISCORE_UNAVAILABLE, fixed.NOVA_UNAVAILABLE)
    assert shelfwise.pair(catalog).first().pairings == []


@pytest.mark.parametrize(
    ("tags", "expected"),
    [
        (["en:nut-butters", "en:spreads"], fixed.CATEGORY_PAIRINGS["nut-butters"]),
        (["en:unknown-category-xyz"], fixed.DEFAULT_PAIRINGS),
        ([], fixed.DEFAULT_PAIRINGS),
        (None, fixed.DEFAULT_PAIRINGS),
        (["en:extra-virgin-olive-oils"], fixed.CATEGORY_PAIRINGS["extra-virgin-olive-oils"]),
        (["en:Milk-Chocolates"], fixed.CATEGORY_PAIRINGS["chocolate"]),
        (["en:sour-creams", "fr:"], fixed.CATEGORY_PAIRINGS["sour-cream"]),
        (["en:oat-milk", "en:fish"], fixed.CATEGORY_PAIRINGS["milk"]),
        # A key may not arise from two neighbouring slugs.
        (["en:x-mi", "en:lk-y"], fixed.DEFAULT_PAIRINGS),
    ],
)
def test_rule_pairings(products, tags, expected):
    assert shelfwise.pair(products({"categories_tags": tags}), config=RULES).first().pairings == expected
