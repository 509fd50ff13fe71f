"""Food pairings from category rules and from replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.scalars import strip
from shelfwise.functions.tags import contains_any, is_candy_like


def text_array(items: list[str]) -> Column:
    return F.array(*[F.lit(item) for item in items])


def ranked_keys() -> list[str]:
    """Category keys, longest first; equal lengths in table order."""
    return sorted(fixed.CATEGORY_PAIRINGS, key=len, reverse=True)


def rule_pairings(slugs_text: Column) -> Column:
    """Pairings of the longest key found in any slug, else the default ones.

    One chain of substring tests over the joined slugs; it runs inside generated
    code, where a lookup by lambda over a key array would be interpreted.
    """
    choice = text_array(fixed.DEFAULT_PAIRINGS)
    for key in reversed(ranked_keys()):
        choice = F.when(
            slugs_text.contains(key), text_array(fixed.CATEGORY_PAIRINGS[key])
        ).otherwise(choice)
    return choice


def clean_items(items: Column) -> Column:
    """Stripped, lowercased, non-blank items, first of equal ones kept."""
    return F.array_distinct(
        F.filter(F.transform(items, lambda item: F.lower(strip(item))), lambda item: item != "")
    )


def plausible_pairings(items: Column, tags: Column) -> Column:
    """Reply items fit for the product, at most five.

    Sweets keep only simple accompaniments and are filled up from a fixed list.
    """
    cleaned = clean_items(items)
    kept = F.filter(
        cleaned,
        lambda item: contains_any(item, fixed.CANDY_PAIRING_WORDS)
        & ~item.contains(fixed.CANDY_BLOCKED_WORD),
    )
    filled = F.array_distinct(F.concat(kept, text_array(fixed.CANDY_FILLERS)))
    return F.slice(F.when(is_candy_like(tags), filled).otherwise(cleaned), 1, fixed.MAX_PAIRINGS)


def pairings(from_reply: Column, fallback: bool, from_table: Column | None = None) -> Column:
    """Default without tags; else the reply's items; else rules if allowed, or nothing.

    ``from_reply`` is the cleaned item list of a reply, null where none was asked for;
    ``from_table`` that of a rule of a table, null where none fits, in place of the
    built-in rules.
    """
    nothing = F.array().cast("array<string>")
    if not fallback:
        rules = nothing
    elif from_table is None:
        rules = rule_pairings(F.col("slugs_text"))
    else:
        rules = F.coalesce(from_table, text_array(fixed.DEFAULT_PAIRINGS))
    return (
        F.when(F.size("categories_tags") == 0, text_array(fixed.DEFAULT_PAIRINGS))
        .when(F.size(from_reply) > 0, from_reply)
        .otherwise(rules)
    )
