"""Risk and positive indicators of the typed product frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.tags import contains_any


def _texts(rules: dict[str, Column], texts: dict[str, str], values: dict[str, Column]) -> Column:
    """Texts of the rules that hold, in the order of ``texts``; some have a value put in."""
    shown = []
    for name, text in texts.items():
        if name in values:
            before, after = text.replace("%d", "%s").split("%s")
            printed = F.concat(F.lit(before), values[name], F.lit(after))
        else:
            printed = F.lit(text)
        shown.append(F.when(rules[name], printed))
    return F.array_compact(F.array(*shown))


def risk_indicators() -> Column:
    additives = F.size("additives_tags")
    rules = {
        "fat": F.col("fat") > fixed.FAT_HIGH,
        "sugars": F.col("sugars") > fixed.SUGARS_HIGH,
        "salt": F.col("salt") > fixed.SALT_HIGH,
        "saturated_fat": F.col("saturated_fat") > fixed.SATURATED_FAT_HIGH,
        "calories": F.col("energy_kcal") > fixed.CALORIES_HIGH,
        "nova": F.col("nova") >= fixed.NOVA_ULTRA_PROCESSED,
        "additives": additives > fixed.MANY_ADDITIVES,
    }
    return _texts(rules, fixed.RISK_TEXTS, {"additives": additives.cast("string")})


def positive_indicators() -> Column:
    labels = F.col("labels_text")
    rules = {
        "protein": F.col("proteins") > fixed.PROTEIN_HIGH,
        "sugars": F.col("sugars") <= fixed.SUGARS_LOW,
        "fiber": F.col("fiber") > fixed.FIBER_HIGH,
        "organic": contains_any(labels, fixed.ORGANIC_WORDS),
        "fair_trade": contains_any(labels, fixed.FAIR_TRADE_WORDS),
        "balanced": (F.col("fat") <= fixed.FAT_HIGH)
        & (F.col("sugars") <= fixed.SUGARS_HIGH)
        & (F.col("salt") <= fixed.SALT_HIGH),
        "nova_1": F.col("nova") == 1,
        "nova_2": F.col("nova") == 2,
        "grade": F.col("grade").isin("a", "b"),
    }
    return _texts(rules, fixed.POSITIVE_TEXTS, {"grade": F.upper("grade")})
