"""Pairing rules that come as a table: the longest key that is part of a category.

A key is part of a slug if all its q-grams are, so keys and slugs are joined on one q-gram, by
equality, and the text is compared in that join. Each key waits under the one of its q-grams
that the fewest slugs have; a key with a q-gram that no slug has can match nothing and goes.
Slugs are the distinct ones of the catalog, far fewer than products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.fixed_values import CATEGORY_PAIRINGS
from shelfwise.functions import tags as tag_fn

#: Letters of a q-gram; shorter keys are q-grams of their own length.
GRAM = 4

RULE_SCHEMA = "key string, position int, items array<string>"


def fixed_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules as a table: (key, position, items)."""
    rows = [(key, k, items) for k, (key, items) in enumerate(CATEGORY_PAIRINGS.items())]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _grams(text: Column, size: Column) -> Column:
    """The distinct q-grams of a text that has at least that many letters."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    parts = F.array_distinct(F.transform(places, lambda i: F.substr(text, i, size)))
    return F.when(F.length(text) >= size, parts)


def matched_slugs(slugs: DataFrame, rules: DataFrame) -> DataFrame:
    """(slug, items, loss, position, key): of every slug that holds a key the rule that counts.

    That is the one of the longest key, of equally long ones that of the least position. Null
    and empty keys match nothing. ``slugs`` are distinct.
    """
    size = F.least(F.length("key"), F.lit(GRAM))
    known = rules.filter(F.length("key") > 0).select("key", "position", "items", size.alias("size"))
    # at most GRAM rows
    sizes = sorted(row["size"] for row in known.select("size").distinct().collect())
    if not sizes:
        nothing = "slug string, items array<string>, loss int, position int, key string"
        return slugs.sparkSession.createDataFrame([], nothing)
    lists = F.concat(*(F.coalesce(_grams(F.col("slug"), F.lit(s)), F.array().cast("array<string>")) for s in sizes))
    held = slugs.select("slug", F.explode(lists).alias("gram"))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    waiting = (
        known.select("*", F.explode(_grams(F.col("key"), F.col("size"))).alias("gram"))
        .join(counts, "gram", "left")
        .groupBy("key", "position")
        .agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min(F.struct("n", "gram")).alias("rarest"), F.first("items").alias("items"))
        .filter(F.col("least") > 0)
        .select("key", "position", "items", F.col("rarest.gram").alias("gram"))
    )
    met = held.alias("h").join(
        waiting.alias("w"), (F.col("h.gram") == F.col("w.gram")) & F.contains("h.slug", "w.key")
    )
    best = F.min(F.struct((-F.length("key")).alias("loss"), "position", "key", "items")).alias("best")
    return met.groupBy("slug").agg(best).select("slug", "best.items", "best.loss", "best.position", "best.key")


def table_pairings(catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """(barcode, rule_items) of products with a category that holds a key.

    Of several categories of a product the rule of the longest key counts, as of one.
    """
    slugs = F.array_distinct(tag_fn.slugs(F.col("categories_tags")))
    carried = catalog.select("barcode", F.explode(slugs).alias("slug"))
    matched = matched_slugs(carried.select("slug").distinct(), rules)
    best = F.min(F.struct("loss", "position", "key", "items")).alias("best")
    return carried.join(matched, "slug").groupBy("barcode").agg(best).select(
        "barcode", F.col("best.items").alias("rule_items")
    )
