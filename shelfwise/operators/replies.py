"""Model replies per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.fixed_values import PAIRING_ATTEMPTS
from shelfwise.functions.pairings import plausible_pairings
from shelfwise.functions.replies import (
    accepted,
    insight_items,
    no_texts,
    pairing_items,
    without_repeat,
)
from shelfwise.functions.scalars import strip
from shelfwise.functions.tags import is_candy_like, last_slug
from shelfwise.sources.schema import REPLY_SCHEMA, conform


def replies_by_product(replies: DataFrame) -> DataFrame:
    """One row per barcode with the reply to each task.

    A null reply says that the model gave none; no row means it was not asked. Of
    several rows the earliest attempt with a reply counts, of pairings the first of
    at most two attempts that holds any. Replies are parsed before the shuffle, and
    the grouping keeps one value per task on the map side.
    """
    df = conform(replies, REPLY_SCHEMA)
    task = F.col("task")
    attempt = F.coalesce("attempt", F.lit(1))

    def first(condition: Column, value: Column) -> Column:
        given = condition & F.col("reply").isNotNull()
        earliest = F.min(F.when(given, F.struct(attempt.alias("attempt"), value.alias("value"))))
        return earliest["value"]

    items = F.when(task == "pairings", pairing_items(F.col("reply")))
    usable = (F.size("pairing_items") > 0) & (attempt <= PAIRING_ATTEMPTS)
    insights = F.when(task == "insights", insight_items(F.col("reply")))
    return (
        df.withColumns({"pairing_items": items, "insight_items": insights})
        .groupBy("barcode")
        .agg(
            first(task == "summary", F.col("reply")).alias("reply_summary"),
            first(task == "nutriscore", F.col("reply")).alias("reply_nutriscore"),
            first(task == "nova", F.col("reply")).alias("reply_nova"),
            first(task == "insights", F.col("insight_items")).alias("reply_insights"),
            first((task == "pairings") & usable, F.col("pairing_items")).alias("reply_pairings"),
            F.max(task == "pairings").alias("asked_pairings"),
        )
        .select(
            "*",
            F.col("reply_insights.risks").alias("reply_risks"),
            F.col("reply_insights.positives").alias("reply_positives"),
        )
        .drop("reply_insights")
    )


def with_replies(subjects: DataFrame, replies: DataFrame) -> DataFrame:
    """Add the reply columns; all null for products nothing was asked about."""
    return subjects.join(replies_by_product(replies), "barcode", "left")


def reply_pairings() -> Column:
    """Pairings of the reply, fit for the product; null where none were asked for.

    An unusable reply counts as an empty list, which sweets still fill up.
    Products whose last category is blank are not asked about.
    """
    items = F.coalesce("reply_pairings", no_texts())
    tags = F.col("categories_tags")
    asked = F.col("asked_pairings") & (last_slug(tags) != "")
    return F.when(asked, plausible_pairings(items, tags))


def with_reply_insights(subjects: DataFrame) -> DataFrame:
    """Append the reply's risks, and those of its positives that are accepted."""
    checked = subjects.withColumns(
        {
            "rule_texts": F.transform("positive_indicators", F.lower),
            "candy": is_candy_like(F.col("categories_tags")),
            "stripped": F.transform(F.coalesce("reply_positives", no_texts()), strip),
        }
    ).withColumn("accepted", F.filter("stripped", accepted))
    return checked.withColumns(
        {
            "risk_indicators": F.concat("risk_indicators", F.coalesce("reply_risks", no_texts())),
            "positive_indicators": F.concat("positive_indicators", without_repeat("accepted")),
        }
    )
