"""Summary and score texts of the typed product frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.scalars import decimals_text, strip, text_or
from shelfwise.functions.tags import allergen_names


def lookup(key: Column, entries: dict) -> Column:
    """Entry of a small fixed table, null for other keys."""
    found = F.lit(None).cast("string")
    for entry, text in reversed(entries.items()):
        found = F.when(key == entry, F.lit(text)).otherwise(found)
    return found


def grade_description() -> Column:
    return lookup(F.col("grade"), fixed.GRADE_DESCRIPTIONS)


def nova_description() -> Column:
    return lookup(F.col("nova"), fixed.NOVA_DESCRIPTIONS)


def _listing(lead: str, parts: list[Column]) -> Column:
    """``lead`` and the non-null parts joined by commas; null without any part."""
    joined = F.concat_ws(", ", *parts)
    return F.when(joined != "", F.concat(F.lit(lead), joined, F.lit(".")))


def nutriscore_explanation() -> Column:
    details = _listing(
        "This product has ",
        [
            F.when(F.col("fat") > fixed.FAT_HIGH, "high fat content"),
            F.when(F.col("saturated_fat") > fixed.SATURATED_FAT_HIGH, "high saturated fat"),
            F.when(F.col("sugars") > fixed.SUGARS_HIGH, "high sugar content"),
            F.when(F.col("fiber") > fixed.FIBER_HIGH, "good dietary fiber"),
            F.when(F.col("proteins") > fixed.PROTEIN_HIGH, "good protein content"),
        ],
    )
    opening = F.concat(
        F.lit("NutriScore "), F.upper("grade"), F.lit(" means "), grade_description(), F.lit(".")
    )
    return F.when(grade_description().isNull(), fixed.NUTRISCORE_MISSING).otherwise(
        F.concat_ws(" ", opening, details)
    )


def nova_explanation() -> Column:
    opening = F.concat(
        F.lit("NOVA Group "),
        F.col("nova").cast("string"),
        F.lit(": This product is classified as a "),
        nova_description(),
        F.lit("."),
    )
    return F.when(nova_description().isNull(), fixed.NOVA_MISSING).otherwise(
        F.concat_ws(" ", opening, lookup(F.col("nova"), fixed.NOVA_SENTENCES))
    )


def nutrient_density() -> Column:
    energy, proteins, fiber = F.col("energy_kcal"), F.col("proteins"), F.col("fiber")
    # Null where energy is zero: the sentence is left out without dividing.
    density = F.try_divide(proteins, energy) * 100
    sentences = F.concat_ws(
        " ",
        F.concat(F.lit("Energy: "), decimals_text(energy, 0), F.lit(" kcal per 100 g.")),
        F.when(
            proteins > 0,
            F.concat(F.lit("Protein: "), decimals_text(proteins, 1), F.lit(" g per 100 g.")),
        ),
        F.when(
            fiber > 0, F.concat(F.lit("Fiber: "), decimals_text(fiber, 1), F.lit(" g per 100 g."))
        ),
        F.when(density > fixed.GOOD_PROTEIN_DENSITY, "Good protein-to-calorie ratio."),
    )
    return F.when(energy <= 0, fixed.DENSITY_MISSING).otherwise(sentences)


def product_summary() -> Column:
    name = text_or(F.col("product_name"), "This product")
    quality, processing = grade_description(), nova_description()
    allergens = F.array_join(allergen_names(F.col("allergens_tags")), ", ")
    return F.concat_ws(
        " ",
        F.when(
            quality.isNotNull(),
            F.concat(
                name,
                F.lit(" is a product with "),
                quality,
                F.lit(" (NutriScore "),
                F.upper("grade"),
                F.lit(")."),
            ),
        ).otherwise(F.concat(name, F.lit(" is a food product."))),
        F.when(
            F.col("nova") == 4,
            F.concat(
                F.lit("It is classified as an "),
                processing,
                F.lit(", which may contain additives, artificial flavors, and emulsifiers."),
            ),
        )
        .when(
            F.col("nova") == 1,
            F.concat(
                F.lit("It is "), processing, F.lit(" with little to no industrial processing.")
            ),
        )
        .otherwise(F.concat(F.lit("It is a "), processing, F.lit("."))),
        _listing(
            "It contains ",
            [
                F.when(F.col("fat") > fixed.FAT_HIGH, "high levels of fat"),
                F.when(F.col("sugars") > fixed.SUGARS_HIGH, "high sugar content"),
                F.when(F.col("proteins") > fixed.PROTEIN_HIGH, "a good source of protein"),
            ],
        ),
        F.when(
            F.size("allergens_tags") > 0,
            F.concat(F.lit("Contains allergens: "), allergens, F.lit(".")),
        ),
    )


def reply_or_rule(reply: Column, rule_text: Column, unavailable: str, fallback: bool) -> Column:
    """Reply text if not blank, else the rule text if allowed, else a fixed text."""
    return F.coalesce(
        F.nullif(strip(reply), F.lit("")), rule_text if fallback else F.lit(unavailable)
    )
