"""Comparing a product with the candidates of its categories.

The product side are columns of the typed frame and of ``product_side``, the
candidate side the fields of one element of its candidate array. These
expressions run as lambdas, which Spark interprets node by node, so what does
not depend on the pair is computed beforehand, and an unknown metric or
processing group is a null that drops out by itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.scalars import decimals_text, strip

# How metrics are written in a reason: field, label, decimals, in order of mention.
REASON_METRICS = [
    ("sugars", "Sugar", 1),
    ("fat", "Fat", 1),
    ("salt", "Salt", 2),
    ("fiber", "Fiber", 1),
    ("proteins", "Protein", 1),
]


DISCOVERY_CONFIDENCE = fixed.DISCOVERY_CONFIDENCE


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def known_metrics() -> Column:
    """How many of the compared metrics the product states."""
    flags = [F.col(f"has_{name}").cast("int") for name in fixed.METRIC_WEIGHTS]
    return sum(flags[1:], flags[0])


def _shared_fields() -> dict[str, Column]:
    """What both sides of a comparison need: metrics if stated."""
    fields = {
        "enough_metrics": known_metrics() >= fixed.MIN_KNOWN_METRICS,
        "known_nova": F.when(F.col("nova") > 0, F.col("nova").cast("double")),
    }
    for name in fixed.METRIC_WEIGHTS:
        fields[f"known_{name}"] = F.when(F.col(f"has_{name}"), F.col(name))
    return fields


def candidate_struct() -> Column:
    """What a comparison needs to know about a candidate, its ``position`` first.

    ``key`` stands for name and address, by which repeats are told.
    """
    url = F.coalesce("url", F.lit(""))
    fields = {
        "position": F.col("position"),
        "name": strip(F.coalesce("product_name", F.lit(""))),
        "name_key": F.col("name_key"),
        "url": url,
        "key": F.concat("name_key", F.lit("\u0000"), F.lower(strip(url))),
        "grade_rank": F.col("grade_rank"),
        "grade_text": F.upper("grade"),
    }
    return F.struct(*[c.alias(n) for n, c in (fields | _shared_fields()).items()])


def product_side() -> dict[str, Column]:
    """Columns to add to a product before it is compared.

    ``grade_terms`` holds the grade part of the score for each candidate rank.
    """
    spans = {
        f"span_{name}": F.greatest(F.abs(F.col(name)), F.lit(1.0)) for name in fixed.METRIC_WEIGHTS
    }
    rank = F.col("grade_rank")
    terms = [
        clamp((rank - other) / fixed.GRADE_STEPS, -1.0, 1.0) * fixed.GRADE_WEIGHT
        for other in fixed.GRADE_RANKS.values()
    ]
    graded = F.when(rank < fixed.UNGRADED_RANK, F.array(*terms))
    printed = {
        f"{name}_text": _amount_text(F.col(name), places) for name, _, places in REASON_METRICS
    }
    return _shared_fields() | spans | printed | {"grade_terms": graded}


def _amount_text(amount: Column, places: int) -> Column:
    return F.concat(decimals_text(amount, places), F.lit("g"))


def _nova_text(known: Column) -> Column:
    return known.cast("int").cast("string")


def is_better(c: Column) -> Column:
    return c["grade_rank"] < F.col("grade_rank")


def other_name(c: Column) -> Column:
    return c["name_key"] != F.col("name_key")


def is_detailed(c: Column) -> Column:
    """Both sides state enough metrics, and at least one of them in common."""
    shared = F.coalesce(
        *[F.col(f"known_{name}") + c[f"known_{name}"] for name in fixed.METRIC_WEIGHTS]
    )
    return F.col("enough_metrics") & c["enough_metrics"] & shared.isNotNull()


def relative_improvement(name: str, c: Column) -> Column:
    """Change for the better relative to the product's amount, within [-1, 1].

    Zero where a side does not state the metric.
    """
    current, other = F.col(f"known_{name}"), c[f"known_{name}"]
    change = (current - other) if name in fixed.LOWER_IS_BETTER else (other - current)
    return clamp(F.coalesce(change / F.col(f"span_{name}"), F.lit(0.0)), -1.0, 1.0)


def _nova_steps(c: Column) -> Column:
    """How far the candidate is less processed; zero if either group is unknown."""
    return F.coalesce(F.col("known_nova") - c["known_nova"], F.lit(0.0))


def detailed_score(c: Column) -> Column:
    """Weighted metric changes plus grade and processing terms.

    A metric that one side lacks adds nothing, and keeps its weight.
    """
    score = F.lit(0.0)
    for name, weight in fixed.METRIC_WEIGHTS.items():
        score = score + relative_improvement(name, c) * weight
    score = score + F.coalesce(F.get("grade_terms", c["grade_rank"]), F.lit(0.0))
    return score + clamp(_nova_steps(c) / fixed.NOVA_STEPS, -1.0, 1.0) * fixed.NOVA_WEIGHT


def simple_score(c: Column) -> Column:
    return (F.col("grade_rank") - c["grade_rank"]) * fixed.SIMPLE_SCORE_PER_GRADE


def better_score(c: Column) -> Column:
    return F.when(is_detailed(c), detailed_score(c)).otherwise(simple_score(c))


def discovery_score(c: Column) -> Column:
    by_grade = (F.col("grade_rank") - c["grade_rank"]) * fixed.DISCOVERY_PER_GRADE
    by_nova = _nova_steps(c) * fixed.DISCOVERY_PER_NOVA
    score = F.lit(fixed.DISCOVERY_BASE) + F.when(
        c["grade_rank"] < fixed.UNGRADED_RANK,
        F.greatest(F.lit(fixed.DISCOVERY_GRADE_FLOOR), by_grade),
    ).otherwise(0.0)
    return score + clamp(by_nova, *fixed.DISCOVERY_NOVA_RANGE)


def detailed_confidence(score: Column) -> Column:
    """Whole percent; fractions are cut off."""
    percent = (score * fixed.CONFIDENCE_PER_SCORE + fixed.CONFIDENCE_BASE).cast("int")
    return clamp(percent, *fixed.CONFIDENCE_RANGE)


def _change_text(label: str, current: Column, other: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), current, F.lit(" → "), other)


def _less_processed(c: Column) -> Column:
    return c["known_nova"] < F.col("known_nova")


def _nova_step(c: Column) -> Column:
    return F.concat(
        F.lit("lower processing (NOVA "),
        _nova_text(F.col("known_nova")),
        F.lit(" -> "),
        _nova_text(c["known_nova"]),
        F.lit(")"),
    )


def _graded(lead: str, c: Column) -> Column:
    """``lead`` and the grade in brackets; null without a grade."""
    return F.concat(F.lit(f"{lead} ("), c["grade_text"], F.lit(")"))


def _parts_or(default: str, parts: list[Column]) -> Column:
    return F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit(default))


def detailed_reason(c: Column, confident: Column) -> Column:
    """Every improvement with both amounts.

    Unlike the score it takes a metric the candidate lacks as zero.
    """
    parts = [F.concat(F.lit("NutriScore "), c["grade_text"])]
    for name, label, places in REASON_METRICS:
        current, other = F.col(name), F.coalesce(c[f"known_{name}"], F.lit(0.0))
        better = (other < current) if name in fixed.LOWER_IS_BETTER else (other > current)
        parts.append(
            F.when(better, _change_text(label, F.col(f"{name}_text"), _amount_text(other, places)))
        )
    nova_change = _change_text(
        "NOVA", _nova_text(F.col("known_nova")), _nova_text(c["known_nova"])
    )
    parts.append(F.when(_less_processed(c), nova_change))
    return F.concat(
        _parts_or("Better overall nutrition profile", parts),
        F.lit(" (confidence: "),
        confident.cast("string"),
        F.lit("%)"),
    )


def simple_reason(c: Column) -> Column:
    steps = F.col("grade_rank") - c["grade_rank"]
    return _parts_or(
        "better overall nutrition profile",
        [
            _graded("Better NutriScore", c),
            F.when(steps >= 2, "significantly better nutritional quality").when(
                steps == 1, "better nutritional quality"
            ),
            F.when(_less_processed(c), _nova_step(c)),
        ],
    )


def discovery_reason(c: Column) -> Column:
    same_nova = F.concat(
        F.lit("similar processing (NOVA "), _nova_text(c["known_nova"]), F.lit(")")
    )
    return F.concat_ws(
        "; ",
        F.lit("Category discovery option"),
        F.when(is_better(c), _graded("better NutriScore", c)).when(
            c["grade_rank"] == F.col("grade_rank"), _graded("same NutriScore", c)
        ),
        F.when(_less_processed(c), _nova_step(c)).when(
            c["known_nova"] == F.col("known_nova"), same_nova
        ),
    )


def better_confidence(c: Column, score: Column) -> Column:
    return F.when(is_detailed(c), detailed_confidence(score)).otherwise(fixed.SIMPLE_CONFIDENCE)


def better_reason(c: Column, score: Column) -> Column:
    return F.when(is_detailed(c), detailed_reason(c, detailed_confidence(score))).otherwise(
        simple_reason(c)
    )
