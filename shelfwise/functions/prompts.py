"""Prompt texts for an external language model."""

from __future__ import annotations

from string import Template

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.scalars import decimals_text, shortest_text, text_or
from shelfwise.functions.tags import last_name, last_slug
from shelfwise.functions.texts import grade_description, nova_description

TASKS = ["pairings", "summary", "nutriscore", "nova", "insights"]


def fill(template: str, **values: Column) -> Column:
    """The template with its ``$name`` marks replaced by columns."""
    parts, end = [], 0
    for mark in Template.pattern.finditer(template):
        parts += [F.lit(template[end : mark.start()]), values[mark["named"] or mark["braced"]]]
        end = mark.end()
    return F.concat(*parts, F.lit(template[end:]))


# Amounts as the prompts name them, in their order.
LISTED = {"Energy": "energy", "Protein": "protein", "Fat": "fat", "Carbs": "carbs", "Fiber": "fiber"}
GRADED = ["fat", "saturated_fat", "sugars", "proteins", "fiber"]
ANALYSED = {
    "fat": "fat",
    "sugar": "sugars",
    "salt": "salt",
    "protein": "proteins",
    "fiber": "fiber",
    "saturated_fat": "saturated_fat",
}


def printed_amounts() -> dict[str, Column]:
    """Columns with the printed amounts, to add before the prompts are put together.

    They are lists, as number formatting is bulky generated code: written out
    for each amount it would make a method too large for the JVM to compile.
    """

    def line(entry: Column) -> Column:
        text = F.concat(
            F.lit("  - "), entry["label"], F.lit(": "), decimals_text(entry["amount"], 1), F.lit("g/100g")
        )
        return F.when(entry["amount"] > 0, text)

    entries = [
        F.struct(F.lit(label).alias("label"), F.col(f"per_100g_{name}").alias("amount"))
        for label, name in LISTED.items()
    ]
    return {
        "listed_amounts": F.transform(F.array(*entries), line),
        "graded_amounts": F.transform(F.array(*GRADED), lambda v: decimals_text(v, 1)),
        "analysed_amounts": F.transform(F.array(*ANALYSED.values()), shortest_text),
    }


def pairings_prompt() -> Column:
    """Null for products without a specific category: none is asked for them."""
    category = last_slug(F.col("categories_tags"))
    listed = F.array_join("listed_amounts", "\n")
    prompt = fill(
        fixed.PAIRINGS_PROMPT,
        name=text_or(F.col("product_name"), "Unknown product"),
        category=category,
        nutrients=F.when(listed == "", "").otherwise(F.concat(F.lit("\nNutrients:\n"), listed)),
    )
    return F.when(category != "", prompt)


def summary_prompt() -> Column:
    nova = F.col("nova")
    return fill(
        fixed.SUMMARY_PROMPT,
        name=text_or(F.col("product_name"), "This product"),
        category=last_name(F.col("categories_tags"), "food product"),
        grade=F.coalesce(F.upper("grade"), F.lit("Unknown")),
        nova=F.when(nova > 0, nova.cast("string")).otherwise("Unknown"),
    )


def nutriscore_prompt() -> Column:
    """Null unless the grade is one of the five."""
    amounts = {name: F.get("graded_amounts", F.lit(i)) for i, name in enumerate(GRADED)}
    prompt = fill(
        fixed.NUTRISCORE_PROMPT,
        name=F.coalesce("product_name", F.lit("product")),
        grade=F.upper("grade"),
        **amounts,
    )
    return F.when(grade_description().isNotNull(), prompt)


def nova_prompt() -> Column:
    """Null unless the processing group is one of the four."""
    prompt = fill(
        fixed.NOVA_PROMPT,
        name=F.coalesce("product_name", F.lit("product")),
        category=last_name(F.col("categories_tags"), ""),
        nova=F.col("nova").cast("string"),
        description=nova_description(),
        additives=F.size("additives_tags").cast("string"),
    )
    return F.when(nova_description().isNotNull(), prompt)


def _listed(items: Column) -> Column:
    """Bracketed list of quoted items, as the prompt shows it."""
    quoted = F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
    return F.when(F.size(items) > 0, quoted).otherwise("None detected")


def insights_prompt(risks: Column, positives: Column) -> Column:
    entries = [
        F.concat(F.lit(f"'{label}': "), F.get("analysed_amounts", F.lit(i)))
        for i, label in enumerate(ANALYSED)
    ]
    return fill(
        fixed.INSIGHTS_PROMPT,
        name=text_or(F.col("product_name"), "product"),
        category=last_name(F.col("categories_tags"), "food"),
        nutrients=F.concat(F.lit("{"), F.concat_ws(", ", *entries), F.lit("}")),
        risks=_listed(risks),
        positives=_listed(positives),
    )
