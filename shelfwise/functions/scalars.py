"""Conversions and number formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.fixed_values import WHITESPACE

_LARGEST_DOUBLE = 1.7976931348623157e308


def strip(text: Column) -> Column:
    """Text without white space at both ends (Spark's ``trim`` removes blanks only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def text_or(text: Column, default: str) -> Column:
    """The text, or ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def finite(number: Column) -> Column:
    """The number as a double; null for NaN and the infinities."""
    number = number.cast("double")
    return F.when(F.abs(number) <= _LARGEST_DOUBLE, number)


# Read as part of a number by the JVM (``1.5d``, ``0x1p3``), but not numbers here.
_JVM_ONLY = "dDfFxXpP"


def number_in(text: Column) -> Column:
    """Double written in a text, else null. Any white space around it is ignored."""
    plain = F.translate(text, _JVM_ONLY + WHITESPACE, "?" * len(_JVM_ONLY) + " " * len(WHITESPACE))
    return plain.try_cast("double")


def to_double(value: Column, default: float = 0.0) -> Column:
    """Any value as a double, ``default`` where it is missing or no finite number."""
    return F.coalesce(finite(number_in(value.cast("string"))), F.lit(default))


def to_int(value: Column, default: int = 0) -> Column:
    """Any value as an int: text must hold a whole number, numbers are truncated."""
    return F.coalesce(value.try_cast("int"), F.lit(default))


def _formatted(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value, F.lit(pattern))


def decimals_text(value: Column, places: int) -> Column:
    """The number with a fixed count of decimals.

    ``format_number`` rounds the exact binary value, halves to even, as C and
    Python do; ``format_string`` rounds halves of the printed decimal up.
    """
    return _formatted(value, "0." + "0" * places if places else "0")


def shortest_text(value: Column) -> Column:
    """The shortest decimal text that reads back as the same double.

    Plain notation from 1e-4 up to 1e16 and ``1.5e-05`` outside; a cast to
    string changes to exponents at 1e-3 and 1e7 already.
    """
    size = F.abs(value)
    plain = _formatted(value, "0.0" + "#" * 20)
    exponent = _formatted(value, "0." + "#" * 16 + "E00")
    return (
        F.when((size == 0) | ((size >= 1e-4) & (size < 1e16)), plain)
        .when(size < 1, F.replace(exponent, F.lit("E"), F.lit("e")))
        .otherwise(F.replace(exponent, F.lit("E"), F.lit("e+")))
    )
