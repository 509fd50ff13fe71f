"""Reading model replies: free text that should hold one JSON object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.scalars import strip


def no_texts() -> Column:
    return F.array().cast("array<string>")


def one_json(text: Column) -> Column:
    """A text that is one JSON value and nothing else as a one-element array variant, else null.

    The parser ignores what follows a complete value, so the text is parsed in two wraps:
    after the value, one needs a bracket and the other a brace, and no further text can be
    both.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    wrapped = F.try_parse_json(F.concat(F.lit('{"w":'), text, F.lit("}")))
    one = (F.size(parsed.cast("array<variant>")) == 1) & wrapped.isNotNull()
    return F.when(one, parsed)


def reply_object(reply: Column) -> Column:
    """The JSON from the first ``{`` to the last ``}`` as a one-element array variant."""
    return one_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0))


def text_items(parsed: Column, field: str) -> Column:
    """The text elements of a list field; empty if it is missing or no list."""
    elements = F.try_variant_get(parsed, f"$[0].{field}", "array<variant>")
    texts = F.transform(
        F.filter(elements, lambda e: F.schema_of_variant(e) == "STRING"),
        lambda e: e.cast("string"),
    )
    return F.coalesce(texts, no_texts())


def _cannot_be_listed(parsed: Column, field: str) -> Column:
    """Whether the field is there but holds null, a number or a truth value."""
    kind = F.schema_of_variant(F.try_variant_get(parsed, f"$[0].{field}", "variant"))
    listable = kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "STRING")
    return F.coalesce(~listable, F.lit(False))


def pairing_items(reply: Column) -> Column:
    """Stripped, lowercased, non-blank pairings of a reply."""
    items = F.transform(
        text_items(reply_object(reply), "pairings"), lambda item: strip(F.lower(item))
    )
    return F.filter(items, lambda item: item != "")


def insight_items(reply: Column) -> Column:
    """Struct of the risks and positives of a reply, cut to one and two.

    The cut comes before the positives are checked, so a rejected item is not
    replaced by a later one. A field that cannot be read as a list voids both.
    """
    parsed = reply_object(reply)
    void = _cannot_be_listed(parsed, "enhanced_risks") | _cannot_be_listed(
        parsed, "enhanced_positives"
    )

    def items(field: str, most: int) -> Column:
        texts = F.filter(text_items(parsed, field), lambda item: item != "")
        return F.when(~void, F.slice(texts, 1, most)).otherwise(no_texts())

    return F.struct(
        items("enhanced_risks", fixed.MAX_REPLY_RISKS).alias("risks"),
        items("enhanced_positives", fixed.MAX_REPLY_POSITIVES).alias("positives"),
    )


def accepted(item: Column) -> Column:
    """Whether the nutrients bear a stripped positive out, and no rule says it already.

    Reads the columns ``rule_texts`` (lowercase) and ``candy`` of the product.
    """
    lower = F.lower(item)
    weak_protein = (F.col("proteins") <= fixed.PROTEIN_HIGH) | F.col("candy")
    wrong = (
        (lower.contains("protein") & weak_protein)
        | (lower.contains("fiber") & (F.col("fiber") <= fixed.FIBER_HIGH))
        | (lower.contains("low sugar") & (F.col("sugars") > fixed.SUGARS_LOW))
    )
    return (item != "") & ~wrong & ~F.array_contains("rule_texts", lower)


def without_repeat(items: str) -> Column:
    """The items without those equal to an earlier one, letter case aside."""
    lower = F.transform(items, F.lower)
    return F.filter(items, lambda item, i: F.array_position(lower, F.lower(item)) == i + 1)
